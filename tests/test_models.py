import math
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import edges as B
from touchline.operators import evaluation as V
from touchline.operators import features as FT
from touchline.operators import models as M
from touchline.operators.bracket import assign_thirds

MATCH = "match_date date, match_no bigint, home string, away string, hg int, ag int"


def games(n=400, seed=3):
    import datetime as dt

    rng = random.Random(seed)
    out = []
    for i in range(n):
        h, a = rng.sample("ABCDEFGH", 2)
        out.append((dt.date(2024, 1, 1) + dt.timedelta(i // 3), i, h, a, rng.randrange(5), rng.randrange(4)))
    return out


def test_elo_equals_loop_and_keeps_its_sum(spark):
    rows = games()
    want = {}
    for _, _, h, a, x, y in rows:
        rh, ra = want.get(h, 1500.0), want.get(a, 1500.0)
        s = M.elo_step(rh, ra, x, y)
        want[h], want[a] = rh + s, ra - s
    df = spark.createDataFrame(rows + [(None, 999, None, "A", 1, 1)], MATCH).repartition(3)
    got = {r.team: r.rating for r in M.elo(df, ["match_date", "match_no"]).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    assert sum(got.values()) == pytest.approx(1500 * len(got))
    assert M.elo(df.limit(0), ["match_date", "match_no"]).count() == 0


def test_pools_are_rated_apart(spark):
    df = spark.createDataFrame(games(60), MATCH)
    two = df.withColumn("pool", F.lit("x")).unionByName(df.withColumn("pool", F.lit("y")))
    got = M.elo(two, ["match_date", "match_no"], pool="pool")
    assert got.groupBy("team").agg(F.countDistinct(F.round("rating", 9)).alias("n")).where("n > 1").isEmpty()


def test_poisson_fit_balances_goals(spark):
    df = spark.createDataFrame(games(800), MATCH)
    fit = {r.team: r for r in M.poisson_fit(df, "home", "away", "hg", "ag").collect()}
    edge = next(iter(fit.values())).home_edge
    rows = games(800)
    assert sum(fit[h].attack * fit[a].defence * edge for _, _, h, a, _, _ in rows) == pytest.approx(sum(r[4] for r in rows), rel=1e-6)
    for t in "ABC":
        made = sum(r[4] for r in rows if r[2] == t) + sum(r[5] for r in rows if r[3] == t)
        want = sum(fit[t].attack * fit[r[3]].defence * edge for r in rows if r[2] == t) + sum(fit[t].attack * fit[r[2]].defence for r in rows if r[3] == t)
        assert want == pytest.approx(made, rel=1e-5)
    assert M.poisson_fit(df.limit(0), "home", "away", "hg", "ag").count() == 0


def test_outcomes_sum_to_one(spark):
    df = spark.createDataFrame([(1400.0, 1700.0, 1.2, 0.8), (1500.0, 1500.0, 1.0, 1.0)], "r1 double, r2 double, l double, m double")
    for o in (M.elo_outcomes(F.col("r1"), F.col("r2"), F.lit(True)), M.elo_outcomes_with_hosts(F.col("r1"), F.col("r2"), F.lit(False)), M.poisson_outcomes(F.col("l"), F.col("m")), M.corrected_outcomes(F.col("l"), F.col("m"), 0.05)):
        assert all(r.s == pytest.approx(1.0) for r in df.select((o["h"] + o["d"] + o["a"]).alias("s")).collect())
    even = df.select(M.elo_outcomes(F.col("r1"), F.col("r2"), F.lit(True)).alias("o")).collect()[1].o
    assert even.d == pytest.approx(0.565, abs=1e-3)


def test_simulation_is_the_same_in_any_partitioning(spark):
    field = [(f"T{i}", 1500.0 + 20 * i) for i in range(6)]
    runs = [M.stage_shares(M.simulate_knockout(spark, field, 200, 42, p), 3).orderBy("team").collect() for p in (1, 5)]
    assert runs[0] == runs[1]
    assert sum(r.p_stage3 for r in runs[0]) == pytest.approx(1.0)


@pytest.mark.parametrize("how", ["power", "shin"])
def test_fair_prices_sum_to_one(spark, how):
    df = spark.createDataFrame([("m", "h", 0.45), ("m", "d", 0.30), ("m", "a", 0.30), ("n", "h", None), ("n", "a", 0.5)], "id string, o string, p double")
    got = B.devig(df, ["id"], "o", "p", how)
    assert got.select("id").distinct().collect() == [("m",)]
    assert got.agg(F.sum("fair")).first()[0] == pytest.approx(1.0, abs=1e-9)
    if how == "power":
        k = math.log(got.where("o = 'h'").first().fair) / math.log(0.45)
        assert k == pytest.approx(1.0474, abs=1e-3)


def test_stake_needs_an_edge_and_is_capped(spark):
    df = spark.createDataFrame([(0.6, 0.5, 0.5), (0.51, 0.5, 0.5), (0.6, 0.5, 0.6), (0.9, 0.1, 0.1)], "p double, price double, sharp double")
    got = [r[0] for r in df.select(B.half_kelly(F.col("p"), F.col("price"), F.col("sharp"))).collect()]
    assert got == pytest.approx([0.02, 0.0, 0.0, 0.02])


def test_student_tail():
    assert V.student_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert V.student_tail(0.0, 5) == pytest.approx(1.0)
    assert math.isnan(V.student_tail(float("nan"), 3))


def test_bootstrap_ignores_partitioning(spark):
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("v"))
    a, b = (V.bootstrap(df.repartition(p), "v", 200).first() for p in (1, 7))
    assert [round(x, 9) for x in a[1:]] == [round(x, 9) for x in b[1:]]
    assert a.low < a.mean < a.high


def test_calibration_bins_are_half_open(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, "H"), (0.6, 0.2, 0.2, "H")], "h double, d double, a double, actual string")
    got = V.calibration_error(df, [], "h", "d", "a", "actual").first().ece
    # 1.0 has no bin; 0.6 is in the third; a zero is in the first
    assert got == pytest.approx(((0.4) / 2 + (0.0 + 0.2) / 2 + (0.0 + 0.2) / 2) / 3)


def test_shrinkage_and_thirds(spark):
    df = spark.createDataFrame([(0.5, 90.0), (0.5, 900.0)], "r double, m double")
    got = [r[0] for r in df.select(FT.shrunk(F.col("r"), F.col("m"))).collect()]
    assert got == pytest.approx([(90 * 0.5 + 75) / 590, 0.5])
    assert assign_thirds(["C", "A"], {"x": ["A", "B"], "y": ["A"], "z": ["C"]}) == {"x": "A", "y": "TBD", "z": "C"}


def test_prediction_contract(spark):
    from touchline.functions import constants as C
    from touchline.operators import quality as Q

    good = ("2026-04-01", "WC26-MEX-RSA-2026-06-11", "match_1x2", "home", "0.4", "High", "v1", "")
    rows = [good, ("2026-4-1", *good[1:]), (good[0], "WC26-F", "totals", "over_2_5", "1.0", "0.3", "v", None), (good[0], "X", "match_1x2", "HOME", "nan", "sure", " ", None), (None,) * 8]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{c} string" for c in C.PREDICTION_COLUMNS))
    got = {}
    for r in Q.row_issues(df, "id", Q.prediction_rules()).collect():
        got.setdefault(r.id, set()).add(r.issue)
    assert set(got) == {1, 3, 4}
    assert got[1] == {"as_of_date"} and got[3] == {"match_id", "outcome", "p_model", "confidence", "model_version"}
    assert len(got[4]) == 7 - ("outcome" not in got[4])
