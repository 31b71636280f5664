import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm.linkage import LEVELS, estimate, link_appearances, pattern
from touchline.llm.ranking import add_rank, match_outcomes, rank_items, rank_teams, solve_local, stationary
from touchline.llm.variants import best_channel, linked_pairs, same_people


def minorise(n, win, lose, w, rounds=4000):
    """Maximum-likelihood strengths by the classic minorisation updates."""
    p = np.ones(n)
    for _ in range(rounds):
        total = w / (p[win] + p[lose])
        p = np.bincount(win, w, n) / (np.bincount(win, total, n) + np.bincount(lose, total, n))
        p /= math.exp(np.log(p).mean())
    return p


def games(n=8, m=400, seed=4):
    rng = np.random.default_rng(seed)
    skill = np.exp(rng.normal(0, 1, n))
    out = []
    for _ in range(m):
        i, j = rng.choice(n, 2, replace=False, p=np.array([0.4] + [0.6 / (n - 1)] * (n - 1)))
        out.append((f"t{i}", f"t{j}", 1.0) if rng.random() < skill[i] / (skill[i] + skill[j]) else (f"t{j}", f"t{i}", 1.0))
    return out


def test_spectral_solution_is_the_maximum_likelihood(spark):
    rows = games()
    names = sorted({x for r in rows for x in r[:2]})
    at = {t: i for i, t in enumerate(names)}
    win, lose = (np.array([at[r[k]] for r in rows]) for k in (0, 1))
    want = minorise(len(names), win, lose, np.ones(len(rows)))
    df = spark.createDataFrame(rows + [("t1", "t1", 1.0), (None, "t1", 1.0), ("t1", "t2", 0.0)], "winner string, loser string, w double")
    got = {r.item: r.strength for r in rank_items(df).collect()}
    assert [got[t] for t in names] == pytest.approx(list(want), rel=1e-5)


RESULTS = {
    "connected": games(5, 120, 9),
    "never lost": [("a", "b", 2.0), ("b", "c", 1.0), ("c", "b", 1.0)],
    "two groups": [("a", "b", 2.0), ("b", "a", 1.0), ("x", "y", 0.5), ("y", "x", 1.5)],
}


@pytest.mark.parametrize("kind", sorted(RESULTS))
def test_distributed_solution_agrees(spark, kind):
    df = spark.createDataFrame(RESULTS[kind], "winner string, loser string, w double")
    near = {r.item: (r.strength, r.rank) for r in rank_items(df).collect()}
    far = {r.item: (r.strength, r.rank) for r in rank_items(df, max_local_pairs=0).collect()}
    assert {i: r for i, (_, r) in far.items()} == {i: r for i, (_, r) in near.items()}
    assert {i: s for i, (s, _) in far.items()} == pytest.approx({i: s for i, (s, _) in near.items()}, rel=1e-6)


def test_no_answer_without_convergence():
    win, lose = np.array([0, 1, 2, 0]), np.array([1, 2, 0, 2])
    with pytest.raises(RuntimeError):
        solve_local(3, win, lose, np.ones(4), rounds=1)


def test_unbeaten_items_stay_finite(spark):
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 0.5), ("y", "x", 0.5)], "winner string, loser string, w double")
    got = {r.item: (r.strength, r.rank) for r in rank_items(df).collect()}
    assert got["a"][1] == 1 and got["c"][1] == 5 and all(math.isfinite(s) for s, _ in got.values())
    assert rank_items(df.limit(0)).count() == 0


def test_power_steps_agree_with_the_direct_solution(monkeypatch):
    import touchline.llm.ranking as ranking

    rows = games(6, 200, 2)
    at = {t: i for i, t in enumerate(sorted({x for r in rows for x in r[:2]}))}
    win, lose = (np.array([at[r[k]] for r in rows]) for k in (0, 1))
    direct = solve_local(len(at), win, lose, np.ones(len(rows)))
    monkeypatch.setattr(ranking, "MAX_DENSE", 0)
    assert solve_local(len(at), win, lose, np.ones(len(rows))) == pytest.approx(direct, rel=1e-6)
    assert stationary(2, np.array([0, 1]), np.array([1, 0]), np.array([1.0, 3.0]), np.array([0.5, 0.5])) == pytest.approx([0.75, 0.25], rel=1e-6)


def test_rank_over_many_partitions(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("item"), (F.col("id") % 50).cast("double").alias("strength"))
    got = add_rank(df.repartition(7)).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 501))
    assert [(r.strength, r.item) for r in got] == sorted(((r.strength, r.item) for r in got), key=lambda x: (-x[0], x[1]))


TEAMS = [("AAA", "Alandia", "AL"), ("BBB", "Borland", "BO"), ("CCC", "Curland", "CU")]


def test_reports_of_one_match_count_once(spark):
    day, late = dt.date(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [
        (1, day, "Alandia vs Borland", "2-1", "H", late), (2, day, "BORLAND v Alandia ", "1 : 2", None, late), (3, day, "Alandia – Curland", None, "d", late), (4, day, "Borland - Curland", "1–1 (3-4 pens)", None, late),
        (5, day, "Nowhere vs Borland", "1-0", "H", late), (6, day, "Alandia vs Alandia", "1-0", "H", late), (7, day, None, None, None, None), (8, day, "Curland vs. Alandia", None, None, late),
        (9, dt.date(2024, 1, 5), "Alandia vs Borland", "0-3", "A", late), (9, dt.date(2024, 1, 5), "Alandia vs Borland", "0-3", "A", late),
    ]
    df = spark.createDataFrame(rows, "match_no bigint, match_date date, match string, score string, actual string, loaded_at timestamp")
    teams = spark.createDataFrame(TEAMS, "team_code string, team_name string, iso2_code string")
    aliases = spark.createDataFrame([("Old", "AAA")], "alias string, team_code string")
    got = {(r.match_date.day, r.a, r.b): r.half_a for r in match_outcomes(df, teams, aliases).collect()}
    assert got == {(1, "AAA", "BBB"): 2, (1, "AAA", "CCC"): 1, (1, "BBB", "CCC"): 0, (5, "AAA", "BBB"): 0}
    assert rank_teams(df.limit(0), teams, aliases).count() == 0


FIRST = ["anna", "boris", "carlos", "dmitri", "emma", "felix", "greta", "hector"]
LAST = ["varolensen", "mitrakov", "chelubanin", "pradesteros", "kolavitsu", "zermatten", "quillandar", "sofrenico"]


def people(n=60):
    rng = random.Random(8)
    out = []
    for i in range(n):
        name = f"{FIRST[i % 8].capitalize()} {LAST[(i // 8 + i) % 8].capitalize()}{'aeiou'[i % 5]}"
        out.append((f"P{i:03d}", name, ["AAA", "BBB", "CCC"][i % 3], dt.date(1985 + i % 20, 1 + i % 12, 1 + i % 28), ["DF", "MF", "FW"][i % 3], f"FC Club{chr(65 + i % 10)}town", rng))
    return out


PLAYER = "player_id string, display_name string, normalized_name string, statsbomb_name string, understat_name string, country_code string, birth_date date, birth_year int, position string, current_club string, last_updated_at date, understat_id string, espn_player_id string, nation string"


def player_rows():
    rows = []
    for pid, name, cc, born, pos, club, _ in people():
        for k in range(3):
            rows.append((pid, name, name.lower(), name if k else None, None, cc, born, born.year, pos, club, dt.date(2024, 1, 1) + dt.timedelta(90 * k), None, None, "clash"))
    return rows


def test_appearances_find_their_players(spark):
    rows, want = [], {}
    for i, (pid, name, cc, _, pos, club, _) in enumerate(people()):
        first, last = name.split()
        for k, typed in enumerate((name, f"{last.upper()}, {first}", f"{first[0]}. {last}", name[:-3] + name[-2] + name[-3] + name[-1])):
            rid = f"r{i}_{k}"
            rows.append((rid, typed, cc if k != 1 else None, club if k != 3 else club.replace("FC ", ""), {"DF": "DC", "MF": "AMC", "FW": "FWL"}[pos], "2024-03-01", dt.datetime(2024, 3, 2), "x"))
            want[rid] = pid
        rows.append((f"u{i}", f"Wanda Unknownova{'aeiou'[i % 5]}", cc, club, "GK", "2024-03-01", dt.datetime(2024, 3, 2), "x"))
    rows += [rows[0], ("n1", None, None, None, None, None, None, "x"), ("n2", "", "AAA", "", "", "", None, "x"), (None, "Anna", None, None, None, None, None, "x")]
    m = spark.createDataFrame(rows, "roster_id string, player_name string, nation string, team_title string, position string, match_date string, loaded_at timestamp, player_id string")
    p = spark.createDataFrame(player_rows(), PLAYER)
    teams = spark.createDataFrame(TEAMS, "team_code string, team_name string, iso2_code string")
    aliases = spark.createDataFrame([("Old", "AAA")], "alias string, team_code string")
    got = {r.roster_id: r.player_id for r in link_appearances(m, p, teams, aliases).collect()}
    assert not [r for r in got if r.startswith(("u", "n"))]
    right = sum(got.get(r) == pid for r, pid in want.items())
    assert right >= 0.95 * len(want) and all(got[r] == want[r] for r in got)
    assert link_appearances(m.limit(0), p, teams, aliases).count() == 0
    assert link_appearances(m, p.limit(0), teams, aliases).count() == 0


def test_pattern_numbers_and_estimates(spark):
    import pandas as pd

    top = {k: F.lit(len(v[0]) - 1) for k, v in LEVELS.items()}
    size = int(np.prod([len(v[0]) for v in LEVELS.values()]))
    assert spark.range(1).select(pattern(top)).first()[0] == size - 1
    rows = [(5, 3, 2, 2, 900), (1, 0, 0, 0, 3000), (0, 0, 0, 0, 500)]
    share, prob = estimate(pd.DataFrame(rows, columns=[*LEVELS, "count"]))
    assert 0.1 < share < 0.4 and prob["name"][0][5] > 0.8 > prob["name"][1][5]
    assert estimate(pd.DataFrame([], columns=[*LEVELS, "count"]))[0] == pytest.approx(0.3)


def test_ids_of_one_person(spark):
    rows = player_rows()
    base = people()
    extra = [
        ("Q1", "V. " + base[0][1].split()[1], base[0]), ("Q2", base[1][1].split()[1] + ", " + base[1][1].split()[0], base[1]),
    ]
    for qid, name, (_, true, cc, born, pos, club, _) in extra:
        rows.append((qid, name, None, true.replace("a", "aa", 1), true, cc, born, born.year, pos, club, dt.date(2024, 5, 1), None, None, ""))
    a = base[2]
    rows.append(("R1", "Zora " + a[1].split()[1], None, None, None, a[2], a[3] + dt.timedelta(400), a[3].year + 1, a[4], a[5], dt.date(2024, 5, 1), None, None, ""))
    rows += [(None, "Nobody", None, None, None, None, None, None, None, None, None, None, None, ""), ("Z", None, "", None, None, None, None, None, None, None, None, None, None, "")]
    rows += rows[:5]
    got = {(r.player_id_a, r.player_id_b) for r in same_people(spark.createDataFrame(rows, PLAYER)).collect()}
    assert got == {("P000", "Q1"), ("P001", "Q2")}
    assert same_people(spark.createDataFrame(rows, PLAYER).limit(0)).count() == 0


def test_chains_end_at_one_root(spark):
    links = spark.createDataFrame([("e", "d"), ("d", "c"), ("c", "b"), ("b", "a"), ("y", "x")], "a string, b string")
    got = {(r.id_a, r.id_b) for r in linked_pairs(links).collect()}
    assert len(got) == 11 and ("a", "e") in got and ("x", "y") in got
    assert linked_pairs(links.limit(0)).count() == 0


def test_channel_keeps_relatives_apart():
    assert best_channel(["anna varolensen"], ["varolensen a"], {}) > 0
    assert best_channel(["anna varolensen"], ["boris varolensen"], {}) < best_channel(["anna varolensen"], ["anna varolenzen"], {})
    assert best_channel([], ["x"], {}) < 0


def test_common_words_lose_no_candidate(spark):
    from touchline.llm import linkage as L

    syllables = [a + b for a in "bdfgklmnprtvz" for b in "aeiou"]
    families = ["".join(syllables[(i * k + j) % 65] for j, k in enumerate((1, 7, 11, 17))) for i in range(60)]
    known = [(f"m{i}", 1, f"maria {f}") for i, f in enumerate(families)] + [(f"s{i}", 1, f"{f[::-1]} silva") for i, f in enumerate(families)]
    known += [("garbled", 1, "maria lemikeara"), ("shorter", 1, "maria silva"), ("nation", None, "maria lemikeara")]
    schema = "player_id string, p_nation bigint, p_line int, stays array<struct<club:string,first_day:date,last_day:date>>, spelled array<string>"
    master = spark.createDataFrame([(i, n, None, [("norte", None, None)] if i != "nation" else [], [s]) for i, n, s in known], schema)
    assert L.common_words(master) == ["maria", "silva"]
    # neither beginning nor end of the rare word is spared; all words of the shorter name are common
    seen = [("maria leimkeara", "norte", None), ("maria silva lopez", "norte", None), ("leimkeara maria", None, None), ("silva mariaa lopez", None, 1)]
    apps = spark.createDataFrame(seen, "folded string, club string, nation bigint")
    got = {r.folded: {c.player_id: c.name for c in r.found} for r in L.candidates(apps, master).collect()}
    assert got["maria leimkeara"]["garbled"] == 4
    assert {got["leimkeara maria"].get(p) for p in ("garbled", "nation")} == {4}
    assert got["maria silva lopez"]["shorter"] == 4
    # a name of common words only agrees by all of them
    plain = L.candidates(spark.createDataFrame([("silva maria", "norte", 1), ("maria silva", None, 1)], "folded string, club string, nation bigint"), spark.createDataFrame([*master.collect(), ("longer", 1, None, [], ["maria silva lopez"])], schema))
    got = {r.folded: {c.player_id: c.name for c in r.found} for r in plain.collect()}
    assert got["maria silva"]["longer"] == got["silva maria"]["longer"] == 4 and "m3" not in got["maria silva"]


def test_spellings_of_a_common_word_share_blocks(spark):
    from touchline.llm import linkage as L

    syllables = [a + b for a in "bdfgklmnprtvz" for b in "aeiou"]
    families = ["".join(syllables[(i * k + j) % 65] for j, k in enumerate((1, 7, 11, 17))) for i in range(60)]
    known = [(f"a{i}", f"mariana {f}") for i, f in enumerate(families)] + [(f"e{i}", f"marianne {f[::-1]}") for i, f in enumerate(families)] + [("garbled", "mariana lemikeara")]
    schema = "player_id string, p_nation bigint, p_line int, stays array<struct<club:string,first_day:date,last_day:date>>, spelled array<string>"
    master = spark.createDataFrame([(i, 1, None, [("norte", None, None)], [s]) for i, s in known], schema)
    assert L.families(L.common_words(master)) == {"mariana": "mariana", "marianne": "mariana"}
    # neither club nor nation, the other spelling, and no end of the rare word spared
    apps = spark.createDataFrame([("marianne leimkeara", None, None)], "folded string, club string, nation bigint")
    got = {c.player_id: c.name for r in L.candidates(apps, master).collect() for c in r.found}
    assert got["garbled"] == 4


def test_a_pair_meets_in_few_blocks(spark):
    from touchline.llm import linkage as L

    common = ["mariana", "silva"]
    spots = [("x", ["mariana lemikeara", "lemikeara mariana"], [1], [2], [3], None), ("y", ["mariana silva"], [1], [2], [3], None)]
    df = spark.createDataFrame(spots, "id string, names array<string>, at array<bigint>, inside array<bigint>, anywhere array<bigint>, lost array<bigint>")
    keys = L._keys(df, "id", F.col("names"), common)
    assert keys.groupBy("id", "k", "w").count().where("count > 1").count() == 0
    ours, theirs = keys.where("id = 'x'"), keys.where("id = 'x'").selectExpr("k", "w as v")
    both = ours.join(theirs, "k")
    # by the rare word's beginning, and by both words inside a nation and anywhere; of
    # all other keys that are equal it is known that one of these is
    assert both.where(L._meets(F.col("w"), F.col("v"))).count() == 3 < both.count()
    # common words only: each beside the other, and the first letter of either in the
    # other's block; each word serves for want of a rare one besides
    ours, theirs = keys.where("id = 'y'"), keys.where("id = 'y'").selectExpr("k", "w as v")
    assert ours.join(theirs, "k").where(L._meets(F.col("w"), F.col("v"))).count() == 8
