"""Results, names and appearances in every writing, against what a reader gets."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.plans import load_registry
from touchline.plans import adapters as A

QUERIES = load_registry().queries
DAY = dt.date(2021, 5, 1)


@pytest.fixture()
def odd_results(spark, tmp_path):
    rows = [
        (1, "Alkovia vs Dradovia", "2-1", "H"), (2, "ALKOVIA - Dradovia", "2 : 0", None), (3, "Alkovia vs. Drаdovia", "3–4 aet", " a"),
        (4, "Dradovia – Alkvia", None, "Draw"), (5, "Dradovia v AKA", "0-0 (4-3 pens)", None), (6, "Alkovia vs Dradovia", None, None),
    ]
    teams = [("AKA", "Alko\u200bvia", "AK", "X", True), ("DRD", "Dradovia", "DR", "X", True)]
    full = [(n, DAY, m, s, a, False, None, 0.5, 0.2, 0.3, "H", dt.datetime(2021, 5, 2)) for n, m, s, a in rows]
    kinds = "match_no bigint, match_date date, match string, score string, actual string, is_ko boolean, tier string, elo_h double, elo_d double, elo_a double, elo_pred string, loaded_at timestamp"
    spark.createDataFrame(full, kinds).write.parquet(f"{tmp_path}/match_results.parquet")
    spark.createDataFrame(teams, "team_code string, team_name string, iso2_code string, confederation string, is_wc2026_qualifier boolean").write.parquet(f"{tmp_path}/teams.parquet")
    spark.createDataFrame([("Old Alkovia", "AKA")], "alias string, team_code string").write.parquet(f"{tmp_path}/team_aliases.parquet")
    return str(tmp_path)


def test_results_keep_every_row_and_one_name_a_team(spark, odd_results):
    got = {r.match_no: (r.home, r.away, r.hg, r.ag, r.actual) for r in A.results(spark, odd_results).collect()}
    a, b = "alkovia", "dradovia"
    assert got == {1: (a, b, 2, 1, "H"), 2: (a, b, 2, 0, "H"), 3: (a, b, 3, 4, "A"), 4: (b, a, None, None, "D"), 5: (b, a, 0, 0, "H"), 6: (a, b, None, None, None)}


def test_queries_leave_out_only_what_they_cannot_use(spark, odd_results):
    run = lambda name: QUERIES[name](spark, odd_results)
    for name in ("x19_variation", "x20_confidence_label", "m05_form_outcomes", "j07_unordered_pair_lookup"):
        assert run(name).count() == 6
    assert run("u07_wide_to_outcomes").count() == 18
    assert run("x18_head_to_head_share").count() == 4
    assert {(r.team, r.conceded, r.n_matches) for r in run("a10_opponent_credited").collect()} == {("alkovia", 5, 4), ("dradovia", 7, 4)}
    assert {(r.team, r.n_used) for r in run("w02_form_before_date").collect()} == {("alkovia", 5), ("dradovia", 5)}
    assert {(r.team_code, r.attack, r.defence) for r in run("q03_attack_against_defence_of_teams").collect()} == {("AKA", 1.75, 1.25), ("DRD", 1.25, 1.75)}
    assert {(r.match_no, r.label) for r in run("x20_confidence_label").collect()} >= {(2, "host"), (4, "high")}


NAMES = ["José Núñez", "Tava, Vik (jr.)", "Ｆull Width", "Zo\u200be Ana", "Козлов Иван", "A. B.", "Smith & <Sons>", "Ångström Bjo\u0308rn", "  Two   Spaces ", None]
CLUBS = ["Real Norte", None, "St. Mary, (B) & Co", "F<C", "Ñandú", " ", "Plain Club", "O'X", "A-B", "Last"]


@pytest.fixture()
def odd_players(spark, tmp_path):
    rows = [(i, n, "Iñland & Co" if i % 2 else "Two Word", c, ("GK", "DF", "MF", "FW")[i % 4]) for i, (n, c) in enumerate(zip(NAMES, CLUBS))]
    spark.createDataFrame(rows, "row_id bigint, display_name string, nation_name string, current_club string, position string").write.parquet(f"{tmp_path}/players.parquet")
    return str(tmp_path), rows


def test_names_are_normalized_in_every_writing(spark, odd_players):
    import unicodedata

    from touchline.functions.text import normalize, simplify

    folder, rows = odd_players
    for query, column, brute in (("e01_normalized_name", "nn", normalize), ("e08_first_and_last_word", "short", simplify)):
        got = {r["row_id"]: r[column] for r in QUERIES[query](spark, folder).collect()}
        assert got == {r[0]: None if r[1] is None else brute(r[1]) for r in rows}
    assert unicodedata.normalize("NFKD", "Ｆ")[0] == "F" and normalize("Ｆull Width") == "full width"


def test_pages_carry_every_player(spark, odd_players):
    folder, rows = odd_players
    read = lambda s: " ".join((s or "").split())
    named = [r for r in rows if r[1]]
    got = {(r.nation, r.position_bucket, r.name, r.club) for r in QUERIES["s11_roster_pages"](spark, folder).collect()}
    assert got == {(r[2], r[4], r[1].strip(), (r[3] or "").strip() or None) for r in named}
    got = {(r.player_name, r.club_team) for r in QUERIES["s12_wiki_tables"](spark, folder).collect()}
    assert got == {(read(r[1]), read(r[3])) for r in rows}
    got = {(r.position, r["name"], r.club) for r in QUERIES["s13_rows_by_pattern"](spark, folder).collect()}
    assert got == {(r[4], read(r[1]), read(r[3])) for r in rows}
    got = {(r.nation, r["name"], r.club) for r in QUERIES["e21_player_lists"](spark, folder).collect()}
    assert got == {(r[2], r[1].strip(), (r[3] or "").strip() or None) for r in named}


def appearance(roster_id, name, nation, team="Norte", **more):
    row = dict(roster_id=roster_id, player_name=name, nation=nation, team_title=team, season="2024", minutes="90", goals="1", xg="0.5", shots="2", loaded_at=dt.datetime(2024, 5, 2))
    return {**row, **more}


@pytest.fixture()
def warehouse(spark, tmp_path):
    def write(players, seen):
        full = [(i, pid, nn, nn, code, club, "FW", dt.date(1999, 1, 1), 1999, None, True, dt.datetime(2024, 1, 1)) for i, (pid, nn, code, club) in enumerate(players)]
        kinds = "row_id bigint, player_id string, display_name string, normalized_name string, country_code string, current_club string, position string, birth_date date, birth_year int, understat_id string, is_active boolean, loaded_at timestamp"
        spark.createDataFrame(full, kinds).write.parquet(f"{tmp_path}/players.parquet")
        spark.createDataFrame(seen, "roster_id string, player_name string, nation string, team_title string, season string, minutes string, goals string, xg string, shots string, loaded_at timestamp").write.parquet(f"{tmp_path}/player_matches.parquet")
        spark.createDataFrame([("AKA", "Alkovia", "AK", True), ("DRD", "Dradovia", "DR", True)], "team_code string, team_name string, iso2_code string, is_wc2026_qualifier boolean").write.parquet(f"{tmp_path}/teams.parquet")
        spark.createDataFrame([("Old Alkovia", "AKA")], "alias string, team_code string").write.parquet(f"{tmp_path}/team_aliases.parquet")
        return str(tmp_path)

    return write


PLAYERS = [("P000001", "jose nunez", "AKA", "Norte"), ("P000002", "jose nunez", "DRD", "Sur"), ("P000003", "bjorn astrom", "DRD", "Sur")]
SEEN = [appearance("a", "José Núñez", "Old Alkovia"), appearance("b", "JOSÉ NUÑEZ", " alkvia"), appearance("c", "Jose  Nunez", "DR"), appearance("d", "Björn Åström", None), appearance("e", "José Núñez", None, "Este")]


def test_accents_and_typed_nations_resolve(spark, warehouse):
    from touchline.plans import pipeline as P

    folder = warehouse(PLAYERS, SEEN)
    want = {"a": ("P000001", "name_country"), "b": ("P000001", "name_country"), "c": ("P000002", "name_country"), "d": ("P000003", "name"), "e": (None, None)}
    assert {r.roster_id: (r.match_id, r.match_tier) for r in P.appearances(spark, folder).collect()} == want
    assert {r.roster_id: (r.match_id, r.match_tier) for r in QUERIES["e04_tier_cascade"](spark, folder).collect()} == want
    assert {r.match_reason for r in P.appearances(spark, folder).where("match_id is null").collect()} == {"ambiguous_name_2"}


def test_refresh_updates_people_in_every_writing(spark, warehouse):
    got = QUERIES["e12_master_refresh"](spark, warehouse(PLAYERS, SEEN[:3])).collect()
    assert {(r.player_id, r.club) for r in got} == {("P000001", "norte"), ("P000002", "norte"), ("P000003", "sur")}


def test_sorts_keep_every_row(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else 1980 + i % 20, ("GK", "DF", "MF", "FW", None)[i % 5], f"n{i}", "xyz"[i % 3]) for i in range(500)]
    spark.createDataFrame(rows, "row_id bigint, birth_year int, position string, display_name string, nation_name string").write.parquet(f"{tmp_path}/players.parquet")
    got = [r.row_id for r in QUERIES["w06_nulls_last"](spark, str(tmp_path)).collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    place = {"GK": 0, "DF": 1, "MF": 2, "FW": 3}
    got = [r.row_id for r in QUERIES["w07_bucket_order"](spark, str(tmp_path)).collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (place.get(r[2], 9), r[4], r[0]))]


@pytest.mark.parametrize("kind, least", [("set", 90.0), ("sort", 70.0)])
def test_fuzzy_names_lose_no_pair(spark, kind, least):
    import random

    from touchline.functions.text import token_set_ratio, token_sort_ratio
    from touchline.operators import entity as E

    draw = random.Random(7)
    names = ["eduardo tuwomuel", "ibrahim galaesi", "turvagua", "north fritabania", "ana lo", "jean-luc mora"]

    def miswritten(name: str) -> str:
        at = draw.randrange(len(name) - 1)
        name = name[:at] + name[at + 1] + name[at] + name[at + 2:] if draw.random() < 0.5 else name[:at] + draw.choice("aeiou") + name[at + 1:]
        return " ".join(sorted(name.split(), reverse=draw.random() < 0.3))

    left = sorted({("B", miswritten(n)) for n in names for _ in range(40)} | {("B", "edaurdo twomuel"), ("B", "iurahim gaalaesi"), ("C", "turvagua"), ("B", "")})
    x = spark.createDataFrame(left, "b string, a string").withColumn("l", F.col("a"))
    y = spark.createDataFrame([("B", n, n) for n in names], "b string, c string, r string")
    ratio = {"set": token_set_ratio, "sort": token_sort_ratio}[kind]
    want = {(n, m) for b, n in left for m in names if b == "B" and ratio(n, m) >= least}
    assert {(r.l, r.r) for r in E.fuzzy_within(x, y, "b", "a", "c", "l", "r", least, 10, kind).collect()} == want


def test_fuzzy_names_of_one_large_block_meet_by_keys(spark):
    import random

    from touchline.functions.text import token_set_ratio
    from touchline.operators import entity as E

    draw = random.Random(11)
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "ae", "sta")]
    first = ["eduardo", "ana", "bartholomew", "jo", "li", "maria", "jean-luc", "a"]
    names = sorted({" ".join(draw.sample(first, draw.choice([0, 1, 1, 2])) + ["".join(draw.choices(syllables, k=draw.choice([1, 2, 3, 4, 5])))]) for _ in range(1500)} | {"a b c d e", "jo li xu do", "jo li xu da", "a"})

    def miswritten(name: str) -> str:
        for _ in range(draw.choice([1, 2, 3])):
            at = draw.randrange(len(name) + 1)
            name = draw.choice([name[:at] + draw.choice("aeiou ") + name[at:], name[:at] + name[at + 1:], name[:at] + draw.choice("aeiou") + name[at + 1:]])
        words = name.split()
        draw.shuffle(words)
        return " ".join(words)

    left = sorted({miswritten(n) for n in names[::4] for _ in range(2)} | {"a b c d f", "li jo xu do"})
    x = spark.createDataFrame([("B", n) for n in left], "b string, a string").withColumn("l", F.col("a"))
    y = spark.createDataFrame([("B", n) for n in names], "b string, c string").withColumn("r", F.col("c"))
    got = {(r.l, r.r) for r in E.fuzzy_within(x, y, "b", "a", "c", "l", "r", 90.0, None).collect()}
    assert got == {(n, m) for n in left for m in names if token_set_ratio(n, m) >= 90.0} and len(got) > 500
    # names meet by keys; the block as a whole would meet in len(left) * len(names) pairs
    met = E._set_pairs(x.select(F.col("b").alias("_b"), F.col("a").alias("_s")), y.select(F.col("b").alias("_b"), F.col("c").alias("_t")), 90.0)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_key" in plan[plan.index("Join"):].split("\n")[0]
    chosen = E.SetKeys(np.ones(E.SetKeys.BUCKETS), 90.0)
    meet = sum(bool(set(chosen.left(" ".join(sorted(set(n.split()))))) & set(chosen.right(" ".join(sorted(set(m.split())))))) for n in left[:50] for m in names if n)
    assert meet < 0.4 * 50 * len(names)


def test_similar_names_match_in_their_context(spark, warehouse):
    people = [*PLAYERS, ("P000004", "alisson ramses becker", "AKA", "Norte"), ("P000005", "mario rossi", "AKA", "Norte"), ("P000006", "mario rossi neto", "AKA", "Este")]
    seen = [
        appearance("f", "Alisson Becker", "Alkovia"), appearance("g", "Alisson Becker", None, "NORTE"), appearance("h", "Alisson Becker", "Dradovia", "Sur"),
        appearance("i", "Rossi Mario", "AK", "Oeste"), appearance("j", None, "AK"), appearance("k", "Unknown Person", "AK"),
    ]
    got = {r.roster_id: (r.match_id, r.match_tier, r.match_reason) for r in QUERIES["e04_fuzzy_tier"](spark, warehouse(people, seen)).collect()}
    nobody = (None, None, "unmatched")
    assert got == {
        "f": ("P000004", "fuzzy", "unique"), "g": ("P000004", "fuzzy", "unique"), "h": nobody, "i": (None, None, "ambiguous_fuzzy_2"), "j": nobody, "k": nobody,
    }


def test_refresh_claims_each_similar_entity_once(spark, warehouse):
    people = [*PLAYERS, ("P000004", "alisson ramses becker", "AKA", "Norte")]
    seen = [appearance("a", "José Núñez", "Alkovia", "Este"), appearance("f", "Alisson Becker", "Alkovia", "Oeste"), appearance("g", "Becker Ramses", "Alkovia", "Sur"), appearance("h", "New One", "Alkovia", "Sur")]
    got = {(r.player_id, r.nn, r.club) for r in QUERIES["e12_master_refresh"](spark, warehouse(people, seen)).collect()}
    assert {p for p, _, _ in got} == {f"P00000{i}" for i in range(1, 7)}
    assert ("P000001", "jose nunez", "este") in got and ("P000002", "jose nunez", "sur") in got
    assert [c for p, _, c in got if p == "P000004"][0] in ("oeste", "sur")
