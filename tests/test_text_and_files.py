import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from touchline.functions import scalars as X
from touchline.functions import text as TX
from touchline.operators import entity as E
from touchline.operators import relational as R
from touchline.operators.semantic import Model
from touchline.sources import files, html, sinks


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_indel_ratio_counts_the_common_subsequence(a, b):
    want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
    assert TX.indel_ratio(a, b) == pytest.approx(want)


def test_token_ratios():
    assert TX.token_set_ratio("kevin de bruyne", "de bruyne") == 100.0
    assert TX.token_sort_ratio("bruyne de kevin", "kevin de bruyne") == 100.0
    assert TX.token_set_ratio("", "a") == 0.0
    assert TX.normalize("José  Müller-Šmit!") == "jose muller-smit"
    assert TX.simplify("Ángel Fabián Di María") == "angel maria"


def test_cascade_stops_at_ambiguity(spark):
    master = spark.createDataFrame([("1", "a", "X", "c1"), ("2", "b", "X", "c1"), ("3", "b", "X", "c2"), ("4", "d", None, "c4")], "pid string, nn string, cc string, club string")
    rows = spark.createDataFrame([("r1", "a", "X", None), ("r2", "b", "X", "c1"), ("r3", "d", "Y", "c4"), ("r4", "z", "X", "c1"), ("r5", None, None, None)], "rid string, nn string, cc string, club string")
    got = {r.rid: (r.match_id, r.match_tier, r.match_reason) for r in E.resolve_in_tiers(rows, master, "pid", [("t1", ["nn", "cc"]), ("t2", ["nn", "club"])]).collect()}
    assert got == {"r1": ("1", "t1", "unique"), "r2": (None, None, "ambiguous_t1_2"), "r3": ("4", "t2", "unique"), "r4": (None, None, "unmatched"), "r5": (None, None, "unmatched")}
    good, bad = E.split_matches(E.resolve_in_tiers(rows.limit(0), master, "pid", [("t1", ["nn"])]))
    assert good.count() == bad.count() == 0 and "match_tier" in good.columns


def test_master_refresh_adds_and_updates(spark):
    master = spark.createDataFrame([("P000007", "a", "X", "old")], "player_id string, nn string, cc string, club string")
    rows = spark.createDataFrame([("a", "X", "new"), ("b", "Y", "c"), ("c", "Y", " ")], "nn string, cc string, club string")
    got = {r.nn: (r.player_id, r.club) for r in E.refresh_master(master, rows, "player_id", [("t", ["nn", "cc"])], ["club"], [F.asc("nn")]).collect()}
    assert got["a"] == ("P000007", "new") and got["b"][0] == "P000008" and got["c"][0] == "P000009"


def test_locked_fields_and_stamp(spark):
    m = spark.createDataFrame([("1", "x", None, dt.date(2024, 1, 1)), ("2", "y", "k", dt.date(2024, 1, 1))], "id string, a string, b string, t date")
    u = spark.createDataFrame([("1", "new", "q"), ("2", " ", "z")], "id string, a string, b string")
    got = {r.id: (r.a, r.b, r.t) for r in E.fill_fields(m, u, "id", ["a", "b"], ["b"], "2025-01-01", "t").collect()}
    assert got == {"1": ("new", "q", dt.date(2025, 1, 1)), "2": ("y", "k", dt.date(2024, 1, 1))}


def test_ambiguous_candidates_are_spared(spark):
    m = spark.createDataFrame([("1", "X", True), ("2", "X", True), ("3", "X", True), ("4", "Y", True)], "id string, cc string, act boolean")
    one = lambda x: spark.createDataFrame([(x,)], "id string")
    got = {r.id: r.act for r in E.sweep_inactive(m, one("1"), one("2"), "id", "cc", "act").collect()}
    assert got == {"1": True, "2": True, "3": False, "4": True}


def test_player_lists():
    rows = html.split_players("Ann Lee (FC A, B), Bo (C), Cy, Di (Open", {"Bo": "7"}, "GK")
    assert [(r["name"], r["club"], r["espn_player_id"]) for r in rows] == [("Ann Lee", "FC A, B", None), ("Bo", "C", "7"), ("Cy", None, None), ("Di", "Open", None)]
    assert html.split_players("") == []


PAGE = """<h2>GROUP B</h2><h3>Alkovia</h3><p>Final squad</p><p><strong>Goalkeepers:</strong> <a href="/soccer/player/_/id/9/x">Ann Lee</a> (FC A), Bo (B)</p>
<p><strong>Defenders:</strong> Bo (B), <a href="/soccer/team/_/id/4">Cy</a> (C)</p><h3>Empty</h3>"""


def test_roster_page():
    rows = html.parse_roster(PAGE)
    assert [(r["nation"], r["group"], r["name"], r["position_bucket"], r["espn_player_id"], r["club"]) for r in rows] == [
        ("Alkovia", "B", "Ann Lee", "GK", "9", "FC A"), ("Alkovia", "B", "Bo", "GK", None, "B"), ("Alkovia", "B", "Cy", "DF", None, "C")]
    assert html.parse_roster(None) == []


def test_tables_and_rows(spark):
    page = '<table class="wikitable"><tr><th>Pos.</th><th>Player</th></tr><tr><td>GK</td><td><b>Ann</b></td></tr></table><table><tr><td>no</td></tr></table>'
    assert html.parse_tables(page) == [{"pos": "GK", "player": "Ann"}]
    df = spark.createDataFrame([("<tr><td>gk</td><td><a>Ann</a></td><td>FC</td></tr><tr><td>x</td></tr>",), (None,)], "html string")
    assert html.row_scan(df).collect() == [("GK", "Ann", "FC")]


def test_scalar_rules(spark):
    df = spark.createDataFrame([("KXWCGAME-26JUN11MEXRSA-TIE", "will-group-c-win", "UEFA Euro qualification", "1,234.5")], "t string, s string, k string, n string")
    r = df.select(
        X.ticker_day(F.col("t")).alias("day"), X.suffix(F.col("t")).alias("tail"), X.group_letter(F.col("s")).alias("g"), X.plain_number(F.col("n")).alias("n"),
        X.keyword_weight(F.col("k"), [("uefa euro", 0.9), ("uefa euro qualification", 0.65)], 0.3).alias("first"),
        X.keyword_weight(F.col("k"), [("uefa euro", 0.9), ("uefa euro qualification", 0.65)], 0.3, longest=True).alias("longest"),
        X.json_price(F.lit('["Yes","No"]'), F.lit('["0.4","0.6"]')).alias("p"), X.json_price(F.lit("["), F.lit("[]")).alias("bad"), X.json_price(F.lit('["No"]'), F.lit('["1"]')).alias("none"),
        X.half_even(F.lit(0.125), 2).alias("he"), F.round(F.lit(0.125), 2).alias("hu"), X.share_percent(F.lit(0.0), F.lit(0.0)).alias("half"),
    ).first()
    assert (r.day, r.tail, r.g, r.n, r.first, r.longest) == ("2026-06-11", "TIE", "C", 1234.5, 0.9, 0.65)
    assert (r.p, r.bad, r.none, r.he, r.hu, r.half) == (0.4, None, 0.0, 0.12, 0.13, 50.0)
    assert X.clean_names([("Unnamed: 0", "Player"), "Save%", "Min/90s"]) == ["player", "savepct", "min_90s"]


def test_form_window_equals_walk(spark):
    rows = [("a", dt.date(2024, 1, d), d, float(d % 3 == 0)) for d in range(1, 20)] + [("b", dt.date(2024, 1, 5), 1, 1.0)]
    t = spark.createDataFrame(rows, "team string, day date, no int, v double")
    refs = spark.createDataFrame([("a", dt.date(2024, 1, 15)), ("b", dt.date(2024, 1, 5)), ("c", dt.date(2024, 1, 5)), ("a", dt.date(2024, 1, 3))], "team string, ref date")
    got = {(r.team, r.ref.day): (round(r.f, 9), r.n_used) for r in R.last_n_before(refs, t, "team", "day", "ref", "v", 10, ["no"], 0.5, "f").collect()}
    last = [v for _, d, _, v in rows[:19] if d < dt.date(2024, 1, 15)][-10:]
    assert got == {("a", 15): (sum(last) / 10, 10), ("b", 5): (0.5, 0), ("c", 5): (0.5, 0), ("a", 3): (0.0, 2)}


def test_semantic_paths(spark):
    m = Model(spark)
    m.add("t", spark.createDataFrame([(1, "A"), (2, "B")], "k int, name string"))
    m.add("f", spark.createDataFrame([(1, 10), (1, 20), (3, 5)], "k int, v int"), one={"dim": ("t", {"k": "k"})})
    got = m.query("f", {"name": "dim.name", "total": "sum(v)"}, where="coalesce(dim.name, 'a.b') <> 'B'", order_by=["-total"]).collect()
    assert got == [("A", 30), (None, 5)]
    assert m.check_one("f", "dim")
    with pytest.raises(ValueError):
        m.query("f", {"x": "nowhere.name"})


def test_files(spark, tmp_path):
    (tmp_path / "2026-04-01").mkdir()
    (tmp_path / "2026-05-01").mkdir()
    (tmp_path / "2026-04-01" / "a.csv").write_text("x\n1\n")
    (tmp_path / "notes").mkdir()
    assert files.latest_snapshot(spark, str(tmp_path), "a.csv").endswith("2026-04-01")
    assert files.load_all(spark, str(tmp_path), ["nope"]) == -1
    (tmp_path / "m.tsv").write_text("1\tx\tAAA\t1800\nshort\n2\ty\tBBB\tn/a\n")
    assert files.by_position(spark, str(tmp_path / "m.tsv"), {"code": 2, "rating": 3}, ["rating"]).collect() == [("AAA", 1800)]
    (tmp_path / "e.json").write_text('[{"id": "1", "location": [1.0, 2.0]}, {"id": "2"}]')
    got = files.json_arrays(spark, str(tmp_path / "e.json"), "id string, location array<double>").orderBy("id").collect()
    assert [(r.id, r.location, r.file) for r in got] == [("1", [1.0, 2.0], "e.json"), ("2", None, "e.json")]
    with pytest.raises(FileNotFoundError):
        files.existing_union(spark, ["/nope"], lambda p: None)
    out = str(tmp_path / "o")
    sinks.write_csv(spark.createDataFrame([(2, "b"), (1, None)], "k int, v string"), out, [F.asc("k")], single=True)
    assert files.typed_csv(spark, out, "k int, v string").orderBy("k").collect() == [(1, None), (2, "b")]
    assert sinks.write_report(spark.range(3), str(tmp_path / "r"), "n", [F.asc("id")])["rows"] == 3
    assert len(files.discover(spark, str(tmp_path), "*/a.csv")) == 1
    assert files.step_sample(spark.range(50).selectExpr("cast(id as string) s"), "s", 1).count() == 50


def test_one_value_of_a_pair_from_both_sides(spark):
    k = spark.createDataFrame([("a", "b", 1, 2, 1), ("b", "a", 5, 6, 2)], "x string, y string, gx int, gy int, no int")
    got = {(r.x, r.y): (r.gx, r.gy) for r in R.mirrored(k, "x", "y", {"gx": "gy", "gy": "gx"}, [F.desc("no")]).collect()}
    assert got == {("b", "a"): (5, 6), ("a", "b"): (6, 5)}


def test_scripts_are_parted_outside_quotes():
    assert files.statements("a; -- b;\n c ';--' ;; \"x;y\"") == ["a", "c ';--'", '"x;y"']
    assert files.statements("") == []


def test_announcements(spark):
    said = {
        "Final squad was announced May 18": ("final", "May 18"), "Roster announced on May 21": ("final", "May 21"), "Roster announced May 19": ("final", "May 19"),
        "Preliminary squad was announced May 12": ("preliminary", "May 12"), "Preliminary roster announced on May 11": ("preliminary", "May 11"),
        "Provisional toster announced on May 21": ("preliminary", "May 21"), "Roster yet to be announced": (None, None), "": (None, None),
    }
    from touchline.functions.scalars import announcement

    df = spark.createDataFrame([(t,) for t in said] + [(None,)], "t string").select("t", announcement(F.col("t")).alias("a"))
    assert {r.t: (r.a.type, r.a.day) for r in df.collect()} == {**said, None: (None, None)}


def test_an_unclosed_club_swallows_nobody():
    read = lambda t: [(p["name"], p["club"]) for p in html.split_players(t)]
    assert read("A B (C (D), E F (G), H I (J") == [("A B", "C"), ("E F", "G"), ("H I", "J")]
    assert read("Ha Ca (Inter, Ka Ay (Gala), Me (B)") == [("Ha Ca", "Inter"), ("Ka Ay", "Gala"), ("Me", "B")]
    assert read("P A (Foo, Inc.), P B (Bar).") == [("P A", "Foo, Inc."), ("P B", "Bar")]


def test_model_types(spark):
    from touchline.operators.entity import model_type

    kinds = {"elo-baseline": "baseline", "ensemble-v2": "compound", "compound-x": "compound", "manual-tier-list": "human", "wc2026-sim": "simulation", "poisson-xg": "single-source"}
    df = spark.createDataFrame([(k,) for k in kinds], "m string").select("m", model_type(F.col("m")).alias("k"))
    assert {r.m: r.k for r in df.collect()} == kinds


def test_search_takes_the_best_of_the_first_results(spark):
    from touchline.operators.entity import best_results

    rows = [
        ("José Paz", 1, "Paz Team", 9e9, True), ("José Paz", 2, "Jose Pazos", 0.0, False), ("José Paz", 3, "Ana Pazos", 4e5, False), ("José Paz", 6, "Jose Paz", 1e6, False),
        ("No One", 1, "Else", 0.0, None), ("No One", 2, None, 9e9, False), ("Al Bo Cruz", 1, "Cruz D", 1e5, False), ("Al Bo Cruz", 2, "Cruz E", 1e5, False),
    ]
    df = spark.createDataFrame(rows, "q string, place int, name string, fans double, national boolean")
    got = {r.q: (r.name, r.score) for r in best_results(df, "q", "place", "name", "fans", "national").collect()}
    assert got == {"José Paz": ("Jose Pazos", 10.0), "Al Bo Cruz": ("Cruz D", 6.0)}
