"""Scalar rules, models, evaluation and market queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from touchline.functions import constants as C
from touchline.functions import scalars as X
from touchline.operators import edges as B
from touchline.operators import evaluation as V
from touchline.operators import features as FT
from touchline.operators import models as M
from touchline.operators.relational import broadcast_if_small
from touchline.plans import adapters as A
from touchline.plans.registry import Registry
from touchline.sources.tables import table

#: Outcome probabilities of three models for each result, from integers only, so
#: both engines agree to the last digit that is compared.
PROBS_SQL = f"""
WITH r AS ({A.RESULTS_SQL}),
w AS (SELECT *, 1 + match_no % 7 AS x1, 1 + match_no % 5 AS x2, 1 + match_no % 3 AS x3 FROM r WHERE actual IN ('H', 'D', 'A'))
SELECT match_no, actual, is_ko, 'elo' AS model, elo_h AS h, elo_d AS d, elo_a AS a FROM w
UNION ALL SELECT match_no, actual, is_ko, 'cycle', CAST(x1 AS DOUBLE) / (x1 + x2 + x3), CAST(x2 AS DOUBLE) / (x1 + x2 + x3), CAST(x3 AS DOUBLE) / (x1 + x2 + x3) FROM w
UNION ALL SELECT match_no, actual, is_ko, 'flat', CAST(0.45 AS DOUBLE), CAST(0.25 AS DOUBLE), CAST(0.3 AS DOUBLE) FROM w
"""

#: Prices of a market: the share of each event type in a user's day.
PRICES_SQL = """
WITH v AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS outcome, CAST(sum(1 + event_id % 9) AS DOUBLE) AS v FROM events GROUP BY 1, 2, 3),
g AS (SELECT user_id, day, sum(v) AS s, count(*) AS n FROM v GROUP BY 1, 2)
SELECT v.user_id, v.day, v.outcome, round(v.v / g.s * 1.05, 6) AS price FROM v JOIN g ON v.user_id = g.user_id AND v.day = g.day WHERE g.n >= 2
"""


def probs(spark: SparkSession, d: str) -> DataFrame:
    w = A.results(spark, d).where(F.col("actual").isin("H", "D", "A"))
    x = [(1 + F.col("match_no") % k).cast("double") for k in (7, 5, 3)]
    s = x[0] + x[1] + x[2]
    rows = F.array(
        F.struct(F.lit("elo").alias("model"), F.col("elo_h").alias("h"), F.col("elo_d").alias("d"), F.col("elo_a").alias("a")),
        F.struct(F.lit("cycle").alias("model"), (x[0] / s).alias("h"), (x[1] / s).alias("d"), (x[2] / s).alias("a")),
        F.struct(F.lit("flat").alias("model"), F.lit(0.45).alias("h"), F.lit(0.25).alias("d"), F.lit(0.3).alias("a")),
    )
    return w.select("match_no", "actual", "is_ko", F.explode(rows).alias("p")).select("match_no", "actual", "is_ko", "p.*")


def prices(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", ["event_id", "user_id", "ts", "event_type"])
    v = e.groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("outcome")).agg(F.sum(1 + F.col("event_id") % 9).cast("double").alias("v"))
    w = Window.partitionBy("user_id", "day")
    return v.withColumn("s", F.sum("v").over(w)).withColumn("n", F.count("*").over(w)).where("n >= 2").select("user_id", "day", "outcome", F.round(F.col("v") / F.col("s") * 1.05, 6).alias("price"))


def elo_sql(pool: str) -> str:
    """The ratings of each pool by a recursive query: one step a match."""
    step = """30e0 * ln(greatest(abs(hg - ag), 1) + 1) * CASE WHEN abs(hg - ag) >= 3 THEN 1.75e0 WHEN abs(hg - ag) = 2 THEN 1.5e0 ELSE 1e0 END
        * (CASE WHEN hg > ag THEN 1e0 WHEN hg = ag THEN 0.5e0 ELSE 0e0 END - 1e0 / (1e0 + pow(10e0, (s.r[g.a] - s.r[g.h]) / 400e0)))"""
    return f"""
WITH RECURSIVE m AS MATERIALIZED (SELECT pool, row_number() OVER (PARTITION BY pool ORDER BY match_date, match_no) AS i, home, away, hg, ag FROM (SELECT *, CAST({pool} AS VARCHAR) AS pool FROM ({A.SCORED_SQL}))),
t AS MATERIALIZED (SELECT pool, team, count(*) AS games, row_number() OVER (PARTITION BY pool ORDER BY team) AS k FROM (SELECT pool, home AS team FROM m UNION ALL SELECT pool, away FROM m) GROUP BY 1, 2),
g AS MATERIALIZED (SELECT m.pool, i, h.k AS h, a.k AS a, hg, ag FROM m JOIN t h ON h.pool = m.pool AND h.team = home JOIN t a ON a.pool = m.pool AND a.team = away),
s(pool, i, r) AS (
  SELECT pool, CAST(0 AS BIGINT), list_transform(range(count(*)), lambda x: 1500e0) FROM t GROUP BY pool
  UNION ALL
  SELECT pool, i, list_transform(r, lambda x, n: CASE WHEN n = h THEN x + step WHEN n = a THEN x - step ELSE x END)
  FROM (SELECT g.pool, g.i, s.r, g.h, g.a, {step} AS step FROM s JOIN g ON g.pool = s.pool AND g.i = s.i + 1)),
f AS (SELECT pool, arg_max(r, i) AS r FROM s GROUP BY pool)
SELECT t.pool, team, round(f.r[k], 6) AS rating, games FROM t JOIN f ON t.pool = f.pool"""


def register(registry: Registry) -> None:
    add = registry.add
    _scalars(add)
    _models(add)
    _evaluation(add)
    _markets(add)


def _scalars(add) -> None:
    @add("x01_two_roundings", "SELECT c_custkey, round(CAST(c_custkey AS DOUBLE) / 8, 2) AS half_away FROM customer")
    def x01(spark, d):
        return table(spark, d, "customer", ["c_custkey"]).select("c_custkey", F.round(F.col("c_custkey") / 8, 2).alias("half_away"))

    @add("x01_half_even", "SELECT c_custkey, round_even(CAST(c_custkey AS DOUBLE) / 8, 2) AS half_even FROM customer")
    def x01b(spark, d):
        return table(spark, d, "customer", ["c_custkey"]).select("c_custkey", X.half_even(F.col("c_custkey") / 8, 2).alias("half_even"))

    @add("x02_safe_casts", "SELECT roster_id, coalesce(TRY_CAST(xg AS DOUBLE), 0) AS xg, CASE WHEN TRY_CAST(minutes AS INTEGER) >= 60 THEN 'starter' WHEN minutes IS NULL THEN 'unknown' ELSE 'sub' END AS part FROM player_matches")
    def x02(spark, d):
        p = table(spark, d, "player_matches", ["roster_id", "xg", "minutes"])
        part = F.when(F.col("minutes").try_cast("int") >= 60, "starter").when(F.col("minutes").isNull(), "unknown").otherwise("sub")
        return p.select("roster_id", F.coalesce(F.col("xg").try_cast("double"), F.lit(0.0)).alias("xg"), part.alias("part"))

    @add("x03_as_of_day", "SELECT team_code, DATE '2026-06-11' AS as_of FROM teams")
    def x03(spark, d):
        return table(spark, d, "teams", ["team_code"]).withColumn("as_of", F.lit("2026-06-11").cast("date"))

    @add("x04_ticker_parts", """
        SELECT pull_id, regexp_extract(payload, 'KXFIFAADVANCE-([0-9]{2})([A-Z]{3})([0-9]{2})([A-Z]{3})', 1) AS yy, regexp_extract(payload, 'KXFIFAADVANCE-([0-9]{2})([A-Z]{3})([0-9]{2})([A-Z]{3})', 2) AS mon,
               regexp_extract(payload, 'KXFIFAADVANCE-([0-9]{2})([A-Z]{3})([0-9]{2})([A-Z]{3})', 3) AS dd FROM kxfifaadvance_markets""")
    def x04(spark, d):
        k = table(spark, d, "kxfifaadvance_markets", ["pull_id", "payload"])
        pattern = "KXFIFAADVANCE-([0-9]{2})([A-Z]{3})([0-9]{2})([A-Z]{3})"
        return k.select("pull_id", *[F.regexp_extract("payload", pattern, i).alias(n) for i, n in ((1, "yy"), (2, "mon"), (3, "dd"))])

    @add("x05_match_day_of_ticker", """
        WITH t AS (SELECT pull_id, regexp_extract(payload, 'KXFIFAADVANCE-[0-9]{2}[A-Z]{3}[0-9]{2}[A-Z]{6}') AS t FROM kxfifaadvance_markets)
        SELECT pull_id, CASE WHEN t <> '' THEN '20' || substr(t, 15, 2) || '-' || lpad(CAST(list_position(['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'], substr(t, 17, 3)) AS VARCHAR), 2, '0') || '-' || substr(t, 20, 2) END AS day FROM t""")
    def x05(spark, d):
        k = table(spark, d, "kxfifaadvance_markets", ["pull_id", "payload"])
        t = F.regexp_extract("payload", "KXFIFAADVANCE-[0-9]{2}[A-Z]{3}[0-9]{2}[A-Z]{6}", 0)
        return k.select("pull_id", X.ticker_day(t).alias("day"))

    @add("x06_suffix", "SELECT snap_id, split_part(slug, '-', -1) AS tail FROM polymarket_snapshot WHERE slug IS NOT NULL")
    def x06(spark, d):
        return table(spark, d, "polymarket_snapshot", ["snap_id", "slug"]).where("slug is not null").select("snap_id", X.suffix(F.col("slug")).alias("tail"))

    @add("x07_group_letter", "SELECT snap_id, upper(nullif(regexp_extract(lower(match_id), 'group-([a-l])(-|$)', 1), '')) AS grp FROM polymarket_snapshot")
    def x07(spark, d):
        return table(spark, d, "polymarket_snapshot", ["snap_id", "match_id"]).select("snap_id", X.group_letter(F.col("match_id")).alias("grp"))

    @add("x08_price_by_name_in_json", """
        SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(event_id % 100 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS yes_price FROM events""")
    def x08(spark, d):
        e = table(spark, d, "events", ["event_id", "event_type"])
        names = F.to_json(F.array(F.lit("No"), F.when(F.col("event_type") == "view", "Yes").otherwise("Maybe")))
        prices_ = F.to_json(F.array(F.lit("0.5"), (F.col("event_id") % 100 / 100).cast("string")))
        return e.select("event_id", X.json_price(names, prices_).alias("yes_price"))

    @add("x08_field_of_json_text", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
    def x08b(spark, d):
        return table(spark, d, "events", ["event_id", "props"]).select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))

    @add("x09_keyword_weight", "SELECT doc_id, CASE WHEN lower(source) LIKE '%match%' THEN 1.0 WHEN lower(source) LIKE '%market%' THEN 0.7 WHEN lower(source) LIKE '%feed%' THEN 0.5 ELSE 0.2 END::DOUBLE AS weight FROM documents WHERE source IS NOT NULL")
    def x09(spark, d):
        return table(spark, d, "documents", ["doc_id", "source"]).where("source is not null").select("doc_id", X.keyword_weight(F.col("source"), [("match", 1.0), ("market", 0.7), ("feed", 0.5)], 0.2).alias("weight"))

    @add("x09_tournament_weight", """
        SELECT match_no, CASE match_no % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.6 ELSE 0.35 END::DOUBLE AS w, CASE match_no % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.6 ELSE 0.35 END::DOUBLE AS w_longest FROM match_results""")
    def x09b(spark, d):
        from touchline.functions.constants import IMPORTANCE, IMPORTANCE_OF_OTHERS

        k = F.col("match_no") % 4
        name = F.when(k == 0, "FIFA World Cup").when(k == 1, "FIFA World Cup qualification").when(k == 2, "UEFA Nations League").otherwise("Friendly")
        m = table(spark, d, "match_results", ["match_no"])
        return m.select("match_no", X.keyword_weight(name, IMPORTANCE, IMPORTANCE_OF_OTHERS).alias("w"), X.keyword_weight(name, IMPORTANCE, IMPORTANCE_OF_OTHERS, longest=True).alias("w_longest"))

    @add("x10_time_decay", "SELECT match_no, round(exp(-0.002 * date_diff('day', match_date, DATE '2026-06-11')), 9) AS w FROM match_results")
    def x10(spark, d):
        return table(spark, d, "match_results", ["match_no", "match_date"]).select("match_no", F.round(X.time_decay(F.datediff(F.lit("2026-06-11").cast("date"), "match_date"), C.DECAY), 9).alias("w"))

    @add("x11_clip", "SELECT c_custkey, greatest(0, least(5000, c_acctbal)) AS clipped, round(ln(1 + abs(c_acctbal)), 6) AS lg FROM customer")
    def x11(spark, d):
        return table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select("c_custkey", X.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"), F.round(F.log(1 + F.abs("c_acctbal")), 6).alias("lg"))

    @add("x12_clean_column_names", "SELECT r_regionkey AS standard_region_key, r_name AS unit_name_pct FROM region")
    def x12(spark, d):
        return table(spark, d, "region", ["r_regionkey", "r_name"]).toDF(*X.clean_names([("Standard", "Region Key"), "Unit/Name %"]))

    @add("x13_pitch_flags", """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, (l_partkey % 120) - (l_suppkey % 120) >= 9.14 AS progressive, l_partkey % 120 >= 80 AS final_third,
               (l_partkey % 120 >= 102 AND l_suppkey % 80 BETWEEN 18 AND 62) AS box FROM lineitem""")
    def x13(spark, d):
        li = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
        x, x0, y = F.col("l_partkey") % 120, F.col("l_suppkey") % 120, F.col("l_suppkey") % 80
        return li.select("*", X.is_progressive(x0, x).alias("progressive"), X.in_final_third(x).alias("final_third"), X.in_box(x, y).alias("box"))

    @add("x14_accents_off", "SELECT row_id, lower(strip_accents(nation_name)) AS plain FROM players WHERE nation_name IS NOT NULL AND regexp_full_match(nation_name, '[A-Za-zàáâãäèéêëìíîïòóôõöùúûüçñšžÀ-Ý ]+')")
    def x14(spark, d):
        p = table(spark, d, "players", ["row_id", "nation_name"]).where(F.col("nation_name").rlike("^[A-Za-zàáâãäèéêëìíîïòóôõöùúûüçñšžÀ-Ý ]+$"))
        return p.select("row_id", X.accents_off(F.col("nation_name")).alias("plain"))

    phrases = ["Final squad was announced ", "Roster announced on ", "Roster announced ", "Preliminary squad was announced ", "Preliminary roster announced on ", "Provisional toster announced on ", "Roster yet to be announced ", "Final list, roster announced "]
    said = "row_id, list_extract([" + ", ".join(f"'{p}'" for p in phrases) + "], CAST(row_id % 8 + 1 AS INTEGER)) || 'May ' || CAST(1 + row_id % 28 AS VARCHAR) AS t"

    @add("x15_announcement", f"""
        WITH p AS (SELECT {said} FROM players),
        x AS (SELECT row_id, nullif(regexp_extract(t, '(Preliminary|Provisional) (squad|roster|toster) (was )?announced (on )?([A-Z][a-z]+ [0-9]+)', 5), '') AS a,
              nullif(regexp_extract(t, 'Final squad (was )?announced (on )?([A-Z][a-z]+ [0-9]+)', 3), '') AS b, nullif(regexp_extract(t, 'Roster (was )?announced (on )?([A-Z][a-z]+ [0-9]+)', 3), '') AS c FROM p)
        SELECT row_id, CASE WHEN a IS NOT NULL THEN 'preliminary' WHEN b IS NOT NULL OR c IS NOT NULL THEN 'final' END AS type, coalesce(a, b, c) AS day FROM x""")
    def x15(spark, d):
        p = table(spark, d, "players", ["row_id"])
        text = F.concat(F.element_at(F.array(*map(F.lit, phrases)), (F.col("row_id") % 8 + 1).cast("int")), F.lit("May "), (1 + F.col("row_id") % 28).cast("string"))
        return p.select("row_id", X.announcement(text).alias("a")).select("row_id", "a.*")

    @add("x16_epoch_day", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
    def x16(spark, d):
        return table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", X.epoch_day(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("day"))

    @add("x17_fallback_with_source", "SELECT roster_id, round(coalesce(TRY_CAST(xg AS DOUBLE), TRY_CAST(shots AS DOUBLE) * 0.1, 0), 6) AS xg, CASE WHEN TRY_CAST(xg AS DOUBLE) IS NOT NULL THEN 'xg' ELSE 'shots' END AS src FROM player_matches")
    def x17(spark, d):
        p = table(spark, d, "player_matches", ["roster_id", "xg", "shots"])
        xg = F.col("xg").try_cast("double")
        return p.select("roster_id", F.round(F.coalesce(xg, F.col("shots").try_cast("double") * 0.1, F.lit(0.0)), 6).alias("xg"), F.when(xg.isNotNull(), "xg").otherwise("shots").alias("src"))

    @add("x18_head_to_head_share", f"SELECT match_no, CASE WHEN hg + ag > 0 THEN round_even(CAST(hg AS DOUBLE) / (hg + ag) * 100, 1) ELSE 50.0 END AS share FROM ({A.SCORED_SQL})")
    def x18(spark, d):
        return A.scored(spark, d).select("match_no", X.share_percent(F.col("hg").cast("double"), F.col("ag").cast("double")).alias("share"))

    @add("x19_variation", f"SELECT match_no, round(sqrt((pow(elo_h - m, 2) + pow(elo_d - m, 2) + pow(elo_a - m, 2)) / 3) / m, 6) AS cv FROM (SELECT *, (elo_h + elo_d + elo_a) / 3 AS m FROM ({A.RESULTS_SQL}))")
    def x19(spark, d):
        return A.results(spark, d).select("match_no", F.round(X.variation(F.array("elo_h", "elo_d", "elo_a")), 6).alias("cv"))

    @add("x20_confidence_label", f"SELECT match_no, CASE WHEN home IN ('alkovia', 'istalimar') THEN 'host' WHEN elo_h >= 0.45 THEN 'high' WHEN elo_h IS NOT NULL THEN 'medium' ELSE 'low' END AS label FROM ({A.RESULTS_SQL})")
    def x20(spark, d):
        return A.results(spark, d).select("match_no", X.confidence_label(F.col("home"), ["alkovia", "istalimar"], F.col("elo_h")).alias("label"))

    @add("x21_thousands_separators", "SELECT c_custkey, CAST(c_custkey * 1234 AS DOUBLE) AS n FROM customer")
    def x21(spark, d):
        c = table(spark, d, "customer", ["c_custkey"])
        return c.select("c_custkey", X.plain_number(F.format_number(F.col("c_custkey") * 1234, 0)).alias("n"))

    @add("x22_sql_script", "SELECT r_regionkey, 'a;b--c' AS tag FROM region")
    def x22(spark, d):
        from touchline.sources.files import run_script

        table(spark, d, "region").createOrReplaceTempView("region")
        script = "-- a view first\nCREATE OR REPLACE TEMP VIEW script_region AS SELECT * FROM region; -- then\nSELECT r_regionkey, 'a;b--c' AS tag FROM script_region;"
        return run_script(spark, script)

    @add("x23_canonical_name", "SELECT s.snap_id, coalesce(t.team_code, s.outcome) AS canon FROM polymarket_snapshot s LEFT JOIN team_aliases t ON t.alias = s.outcome")
    def x23(spark, d):
        s = table(spark, d, "polymarket_snapshot", ["snap_id", "outcome"])
        t = broadcast_if_small(table(spark, d, "team_aliases").dropDuplicates(["alias"]))
        return s.join(t, s["outcome"] == t["alias"], "left").select("snap_id", F.coalesce("team_code", "outcome").alias("canon"))


def _models(add) -> None:
    @add("m01_elo", elo_sql("'all'"))
    def m01(spark, d):
        return M.elo(A.results(spark, d), ["match_date", "match_no"]).withColumn("rating", F.round("rating", 6))

    @add("m01_elo_by_pool", elo_sql("year(match_date)"))
    def m01b(spark, d):
        m = A.results(spark, d).withColumn("pool", F.year("match_date"))
        return M.elo(m, ["match_date", "match_no"], pool="pool").withColumn("rating", F.round("rating", 6))

    @add("m02_elo_outcomes", """
        WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 1 / (1 + pow(10.0, ((1400 + l_partkey % 200) - (1400 + l_suppkey % 200) - CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 50 END) / 400.0)) AS e FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(pow(e, 2.2), 6) AS h, round(1 - pow(e, 2.2) - pow(1 - e, 2.2), 6) AS d, round(pow(1 - e, 2.2), 6) AS a FROM e""")
    def m02(spark, d):
        li = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
        o = M.elo_outcomes(F.lit(1400.0) + F.col("l_suppkey") % 200, F.lit(1400.0) + F.col("l_partkey") % 200, F.col("l_linenumber") % 2 == 0)
        return li.select("*", o.alias("o")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[F.round(f"o.{k}", 6).alias(k) for k in "hda"])

    @add("m03_elo_outcomes_with_hosts", """
        WITH p AS (SELECT c_custkey, 1 / (1 + pow(10.0, ((1400 + c_custkey % 300) - (1400 + c_custkey % 170) - CASE WHEN c_nationkey < 3 THEN 65 ELSE 0 END) / 400.0)) AS p FROM customer),
        q AS (SELECT *, greatest(0.15, 0.30 - 0.6 * abs(p - 0.5)) AS dr FROM p)
        SELECT c_custkey, round(p * (1 - dr), 6) AS h, round(dr, 6) AS d, round((1 - p) * (1 - dr), 6) AS a FROM q""")
    def m03(spark, d):
        c = table(spark, d, "customer", ["c_custkey", "c_nationkey"])
        o = M.elo_outcomes_with_hosts(F.lit(1400.0) + F.col("c_custkey") % 170, F.lit(1400.0) + F.col("c_custkey") % 300, F.col("c_nationkey") < 3)
        return c.select("c_custkey", o.alias("o")).select("c_custkey", *[F.round(f"o.{k}", 6).alias(k) for k in "hda"])

    @add("m04_outright_shares", """
        WITH t AS (SELECT c_custkey AS team, c_acctbal AS rating FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 32)
        SELECT team, rating, round(exp((rating - max(rating) OVER ()) / 200) / sum(exp((rating - (SELECT max(rating) FROM t)) / 200)) OVER (), 6) AS share FROM t""")
    def m04(spark, d):
        c = table(spark, d, "customer", ["c_custkey", "c_acctbal"]).toDF("team", "rating")
        return M.outright_shares(c, "team", "rating").withColumn("share", F.round("share", 6))

    @add("m05_form_outcomes", f"""
        SELECT match_no, round((0.3 + 0.5 * elo_h) / t, 9) AS h, round(0.25 / t, 9) AS d, round((0.3 + 0.5 * elo_a) / t, 9) AS a FROM (SELECT *, 0.85 + 0.5 * elo_h + 0.5 * elo_a AS t FROM ({A.RESULTS_SQL}))""")
    def m05(spark, d):
        r = A.results(spark, d)
        return r.select("match_no", M.form_outcomes(F.col("elo_h"), F.col("elo_a")).alias("o")).select("match_no", *[F.round(f"o.{k}", 9).alias(k) for k in "hda"])

    @add("m06_hybrid_target", "SELECT roster_id, coalesce(TRY_CAST(xg AS DOUBLE), TRY_CAST(goals AS DOUBLE)) AS target, TRY_CAST(xg AS DOUBLE) IS NOT NULL AS is_xg FROM player_matches")
    def m06(spark, d):
        p = table(spark, d, "player_matches", ["roster_id", "xg", "goals"])
        return p.select("roster_id", M.hybrid_target(F.col("xg").try_cast("double"), F.col("goals").try_cast("double")).alias("t")).select("roster_id", "t.*")

    @add("m07_poisson_fit")
    def m07(spark, d):
        m = A.scored(spark, d).withColumn("w", M.match_weight(F.col("match_date"), "2026-06-11", C.DECAY, F.when(F.col("is_ko"), 1.0).otherwise(0.7)))
        fit = M.poisson_fit(m, "home", "away", "hg", "ag", "w")
        return fit.select("team", *[F.round(c, 6).alias(c) for c in ("attack", "defence", "home_edge")])

    @add("m08_poisson_outcomes", """
        WITH l AS (SELECT c_custkey, 0.7 + CAST(c_custkey % 12 AS DOUBLE) / 10 AS lam, 0.7 + CAST(c_custkey % 7 AS DOUBLE) / 10 AS mu FROM customer),
        g AS (SELECT i, j, CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) AS fi, CAST(factorial(CAST(j AS INTEGER)) AS DOUBLE) AS fj FROM range(0, 9) a(i), range(0, 9) b(j)),
        p AS (SELECT c_custkey, i, j, exp(-lam) * pow(lam, i) / fi * exp(-mu) * pow(mu, j) / fj AS p FROM l, g)
        SELECT c_custkey, round(sum(CASE WHEN i > j THEN p END) / sum(p), 6) AS h, round(sum(CASE WHEN i = j THEN p END) / sum(p), 6) AS d, round(sum(CASE WHEN i < j THEN p END) / sum(p), 6) AS a FROM p GROUP BY 1""")
    def m08(spark, d):
        c = table(spark, d, "customer", ["c_custkey"])
        lam, mu = F.lit(0.7) + F.col("c_custkey") % 12 / 10, F.lit(0.7) + F.col("c_custkey") % 7 / 10
        return c.select("c_custkey", M.poisson_outcomes(lam, mu).alias("o")).select("c_custkey", *[F.round(f"o.{k}", 6).alias(k) for k in "hda"])

    @add("m09_xg_rate", f"""
        WITH r AS ({A.RATINGS_SQL}), k AS (SELECT avg(m1) AS a, avg(m2) AS b FROM r)
        SELECT n_nationkey, round(greatest(0.7, least(1.9, 1.15 * (m1 / a) * (m2 / b))), 6) AS lam FROM r, k""")
    def m09(spark, d):
        r = A.ratings(spark, d)
        means = F.broadcast(r.agg(F.avg("m1").alias("a"), F.avg("m2").alias("b")))  # one row
        return r.crossJoin(means).select("n_nationkey", F.round(M.xg_rate(F.col("m1"), F.col("a"), F.col("m2"), F.col("b")), 6).alias("lam"))

    @add("m10_three_way_blend", f"""
        WITH p AS (SELECT match_no, max(CASE WHEN model = 'elo' THEN h END) AS eh, max(CASE WHEN model = 'cycle' THEN h END) AS ch, max(CASE WHEN model = 'elo' THEN d END) AS ed, max(CASE WHEN model = 'cycle' THEN d END) AS cd,
            max(CASE WHEN model = 'elo' THEN a END) AS ea, max(CASE WHEN model = 'cycle' THEN a END) AS ca FROM ({PROBS_SQL}) GROUP BY 1),
        b AS (SELECT match_no, eh * 0.35 + ch * 0.45 + 0.45 * 0.2 AS h, ed * 0.35 + cd * 0.45 + 0.25 * 0.2 AS d, ea * 0.35 + ca * 0.45 + 0.3 * 0.2 AS a FROM p)
        SELECT match_no, round(h / (h + d + a), 6) AS h, round(d / (h + d + a), 6) AS d, round(a / (h + d + a), 6) AS a FROM b""")
    def m10(spark, d):
        p = probs(spark, d).groupBy("match_no").agg(*[F.max(F.when(F.col("model") == m, F.struct("h", "d", "a"))).alias(m) for m in ("elo", "cycle", "flat")])
        return p.select("match_no", M.blend_outcomes([(F.col("elo"), 0.35), (F.col("cycle"), 0.45), (F.col("flat"), 0.20)]).alias("o")).select("match_no", *[F.round(f"o.{k}", 6).alias(k) for k in "hda"])

    @add("m11_equal_blend", f"""
        WITH b AS (SELECT match_no, avg(h) AS h, avg(d) AS d, avg(a) AS a FROM ({PROBS_SQL}) GROUP BY 1)
        SELECT match_no, round(h / (h + d + a), 6) AS h, round(d / (h + d + a), 6) AS d, round(a / (h + d + a), 6) AS a FROM b""")
    def m11(spark, d):
        b = probs(spark, d).groupBy("match_no").agg(*[F.avg(k).alias(k) for k in "hda"])
        t = F.col("h") + F.col("d") + F.col("a")
        return b.select("match_no", *[F.round(F.col(k) / t, 6).alias(k) for k in "hda"])

    @add("m12_shrinkage", """
        WITH p AS (SELECT player_name, coalesce(sum(TRY_CAST(minutes AS DOUBLE)), 0) AS m, coalesce(sum(TRY_CAST(xg AS DOUBLE)), 0) AS x FROM player_matches WHERE player_name IS NOT NULL GROUP BY 1)
        SELECT player_name, round(CASE WHEN m < 180 THEN (m * r + 500 * 0.15) / (m + 500) ELSE r END, 6) AS rate FROM (SELECT *, x / greatest(m, 1) * 90 AS r FROM p)""")
    def m12(spark, d):
        p = table(spark, d, "player_matches", ["player_name", "minutes", "xg"]).where("player_name is not null")
        num = lambda c: F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0))
        agg = p.groupBy("player_name").agg(num("minutes").alias("m"), num("xg").alias("x"))
        return agg.select("player_name", F.round(FT.shrunk(F.col("x") / F.greatest("m", F.lit(1.0)) * 90, F.col("m")), 6).alias("rate"))

    @add("m13_blend_with_one_side", "SELECT n_nationkey, round(coalesce(m1 * 0.6 + m3 * 0.4, m1, m3), 6) AS v FROM (" + A.RATINGS_SQL + ")")
    def m13(spark, d):
        return A.ratings(spark, d).select("n_nationkey", F.round(FT.blend(F.col("m1"), F.col("m3")), 6).alias("v"))

    @add("m14_attack_rating_with_fallback", """
        WITH b AS (SELECT l_suppkey AS team, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey) AS rn, l_orderkey FROM lineitem WHERE l_discount >= 0.09),
        m AS (SELECT team, avg(v) AS v, count(*) AS n FROM b WHERE rn <= 5 GROUP BY 1), q AS (SELECT quantile_cont(v, 0.25) AS q FROM m WHERE n >= 3)
        SELECT team, round(CASE WHEN n >= 3 THEN v ELSE (SELECT q FROM q) END, 4) AS rating, n < 3 AS fallback, n AS n_used FROM m""")
    def m14(spark, d):
        li = table(spark, d, "lineitem", ["l_suppkey", "l_extendedprice", "l_orderkey", "l_discount"]).where("l_discount >= 0.09").select(F.col("l_suppkey").alias("team"), "l_extendedprice", "l_orderkey")
        return FT.squad_ratings(li, "team", "l_orderkey", "l_extendedprice", 5, 3).withColumn("rating", F.round("rating", 4))

    @add("m15_defence_rating_with_median", f"""
        WITH m AS ({A.SCORED_SQL}), t AS (SELECT home AS team, ag AS c FROM m UNION ALL SELECT away, hg FROM m), a AS (SELECT team, avg(c) AS v, count(*) AS n FROM t GROUP BY 1)
        SELECT team, round(CASE WHEN n >= 20 THEN v ELSE (SELECT median(v) FROM a WHERE n >= 20) END, 6) AS rating FROM a""")
    def m15(spark, d):
        c = FT.opponent_credited(A.scored(spark, d), "home", "away", "hg", "ag")
        v = c.withColumn("v", F.when(F.col("n_matches") >= 20, F.col("conceded") / F.col("n_matches")))
        return FT.with_quantile_fallback(v.select("team", "v"), "v", 0.5).select("team", F.round("rating", 6).alias("rating"))

    @add("m16_squad_ratings", """
        WITH p AS (SELECT team_title AS team, player_name AS player, coalesce(sum(TRY_CAST(xg AS DOUBLE)), 0) AS x, coalesce(sum(TRY_CAST(minutes AS DOUBLE)), 0) AS m FROM player_matches WHERE team_title IS NOT NULL AND player_name IS NOT NULL GROUP BY 1, 2),
        s AS (SELECT team, player, CASE WHEN m < 180 THEN (m * r + 75) / (m + 500) ELSE r END AS r FROM (SELECT *, x / greatest(m, 1) * 90 AS r FROM p)),
        b AS (SELECT team, r, row_number() OVER (PARTITION BY team ORDER BY r DESC, player) AS rn FROM s), g AS (SELECT team, avg(r) AS v, count(*) AS n FROM b WHERE rn <= 5 GROUP BY 1)
        SELECT team, round(CASE WHEN n >= 3 THEN v ELSE (SELECT quantile_cont(v, 0.25) FROM g WHERE n >= 3) END, 6) AS rating, n AS n_used FROM g""")
    def m16(spark, d):
        p = table(spark, d, "player_matches", ["team_title", "player_name", "minutes", "xg"]).where("team_title is not null and player_name is not null")
        num = lambda c: F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0))
        agg = p.groupBy(F.col("team_title").alias("team"), F.col("player_name").alias("player")).agg(num("xg").alias("x"), num("minutes").alias("m"))
        rated = agg.select("team", "player", FT.shrunk(F.col("x") / F.greatest("m", F.lit(1.0)) * 90, F.col("m")).alias("r"))
        return FT.squad_ratings(rated, "team", "player", "r", 5, 3).select("team", F.round("rating", 6).alias("rating"), "n_used")

    @add("m17_league_factor_and_cap", "SELECT row_id, round(least(CAST(row_id % 9 AS DOUBLE) * CASE current_league WHEN 'Liga Alta' THEN 1.0 WHEN 'Primera Sol' THEN 0.9 WHEN 'Nordserie' THEN 0.75 ELSE 0.6 END, 6.0), 6) AS rate FROM players")
    def m17(spark, d):
        p = table(spark, d, "players", ["row_id", "current_league"])
        return p.select("row_id", F.round(FT.league_adjusted((F.col("row_id") % 9).cast("double"), F.col("current_league"), {"Liga Alta": 1.0, "Primera Sol": 0.9, "Nordserie": 0.75}, 0.6), 6).alias("rate"))

    @add("m18_pedigree_with_leak_count", """
        SELECT player_name, team_title, round(coalesce(sum(TRY_CAST(xg AS DOUBLE)), 0), 5) AS total, CAST(sum(CASE WHEN TRY_CAST(substr(match_date, 1, 10) AS DATE) >= DATE '2024-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS leaks
        FROM player_matches WHERE player_name IS NOT NULL GROUP BY 1, 2""")
    def m18(spark, d):
        p = table(spark, d, "player_matches", ["player_name", "team_title", "xg", "minutes", "match_date"]).where("player_name is not null")
        p = p.select("player_name", "team_title", F.coalesce(F.col("xg").try_cast("double"), F.lit(0.0)).alias("x"), F.coalesce(F.col("minutes").try_cast("double"), F.lit(0.0)).alias("m"), F.substring("match_date", 1, 10).try_cast("date").alias("day"))
        return FT.pedigree(p, "player_name", "team_title", "x", "m", "day", "2024-01-01").select("player_name", "team_title", F.round("total", 5).alias("total"), "leaks")

    @add("m19_bracket")
    def m19(spark, d):
        from touchline.operators.bracket import assign_thirds, group_ranks, play_rounds, resolve_slots

        n = table(spark, d, "nation", ["n_nationkey", "n_regionkey"])
        c = table(spark, d, "customer", ["c_nationkey", "c_acctbal"]).groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("strength"))
        teams = n.join(c, n["n_nationkey"] == c["c_nationkey"]).select(F.col("n_nationkey").cast("string").alias("team"), F.substring(F.lit("ABCDE"), F.col("n_regionkey") + 1, F.lit(1)).alias("grp"), "strength")
        ranks = group_ranks(teams, "grp", "strength", "team")
        thirds = assign_thirds(["C", "A", "E", "B", "D"], {"3a": ["A", "B"], "3b": ["C", "D"]})
        slots = resolve_slots(ranks, "grp", "team", thirds)
        games = [("1", 1, "1A", "2B"), ("2", 1, "1C", "3a"), ("3", 1, "1B", "2A"), ("4", 1, "1D", "3b"), ("5", 2, "W1", "W2"), ("6", 2, "W3", "W4"), ("7", 3, "W5", "W6")]
        matches = spark.createDataFrame(games, "match string, round int, slot1 string, slot2 string")
        return play_rounds(matches, slots, teams.select("team", "strength"), 3)

    @add("m20_model_agreement_top", f"SELECT match_no, round(cv, 6) AS cv, cv < 0.12 AS converge FROM (SELECT match_no, stddev_pop(h) / avg(h) AS cv FROM ({PROBS_SQL}) GROUP BY 1) ORDER BY cv, match_no LIMIT 16")
    def m20(spark, d):
        p = probs(spark, d).groupBy("match_no").agg(F.collect_list("h").alias("x"))
        cv = X.variation(F.col("x"))
        return p.select("match_no", F.round(cv, 6).alias("cv"), (cv < 0.12).alias("converge"), cv.alias("k")).orderBy("k", "match_no").limit(16).drop("k")

    @add("m21_simulated_stages")
    def m21(spark, d):
        c = table(spark, d, "customer", ["c_nationkey", "c_acctbal"]).groupBy("c_nationkey").agg((1500 + F.sum("c_acctbal") / 1e5).alias("s"))
        field = [(str(r["c_nationkey"]), float(r["s"])) for r in c.orderBy(F.desc("s"), "c_nationkey").limit(16).collect()]
        return M.stage_shares(M.simulate_knockout(spark, field, 10_000), 4)

    @add("m22_low_score_correction_and_temperature", """
        WITH l AS (SELECT c_custkey, 0.7 + CAST(c_custkey % 12 AS DOUBLE) / 10 AS lam, 0.7 + CAST(c_custkey % 7 AS DOUBLE) / 10 AS mu, 0.03 AS r FROM customer),
        g AS (SELECT i, j, CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE) AS fi, CAST(factorial(CAST(j AS INTEGER)) AS DOUBLE) AS fj FROM range(0, 9) a(i), range(0, 9) b(j)),
        p AS (SELECT c_custkey, i, j, exp(-lam) * pow(lam, i) / fi * exp(-mu) * pow(mu, j) / fj
              * CASE WHEN i = 0 AND j = 0 THEN 1 - lam * mu * r WHEN i = 0 AND j = 1 THEN 1 + lam * r WHEN i = 1 AND j = 0 THEN 1 + mu * r WHEN i = 1 AND j = 1 THEN 1 - r ELSE 1 END AS p FROM l, g),
        o AS (SELECT c_custkey, pow(sum(CASE WHEN i > j THEN p END) / sum(p), 1 / 1.2e0) AS h, pow(sum(CASE WHEN i = j THEN p END) / sum(p), 1 / 1.2e0) AS d, pow(sum(CASE WHEN i < j THEN p END) / sum(p), 1 / 1.2e0) AS a FROM p GROUP BY 1)
        SELECT c_custkey, round(h / (h + d + a), 6) AS h, round(d / (h + d + a), 6) AS d, round(a / (h + d + a), 6) AS a FROM o""")
    def m22(spark, d):
        c = table(spark, d, "customer", ["c_custkey"])
        o = M.corrected_outcomes(F.lit(0.7) + F.col("c_custkey") % 12 / 10, F.lit(0.7) + F.col("c_custkey") % 7 / 10, 0.03)
        t = c.select("c_custkey", o.alias("o")).select("c_custkey", M.temperature(F.col("o"), 1.2).alias("t"))
        return t.select("c_custkey", *[F.round(f"t.{k}", 6).alias(k) for k in "hda"])


def _evaluation(add) -> None:
    fav = "CASE WHEN h >= d AND h >= a THEN 'H' WHEN d >= a THEN 'D' ELSE 'A' END"

    @add("v01_log_loss", f"SELECT model, count(*) AS n, round(avg(-ln(greatest(CASE actual WHEN 'H' THEN h WHEN 'D' THEN d ELSE a END / (h + d + a), 1e-15))), 6) AS log_loss FROM ({PROBS_SQL}) GROUP BY 1")
    def v01(spark, d):
        return V.scores(probs(spark, d), ["model"], "h", "d", "a", "actual").select("model", "n", F.round("log_loss", 6).alias("log_loss"))

    @add("v02_accuracy", f"SELECT model, round(avg(CASE WHEN {fav} = actual THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({PROBS_SQL}) GROUP BY 1")
    def v02(spark, d):
        return V.scores(probs(spark, d), ["model"], "h", "d", "a", "actual").select("model", F.round("accuracy", 6).alias("accuracy"))

    @add("v03_brier_home", f"SELECT model, round(avg(pow(h - CASE WHEN actual = 'H' THEN 1 ELSE 0 END, 2)), 6) AS brier FROM ({PROBS_SQL}) GROUP BY 1")
    def v03(spark, d):
        return V.scores(probs(spark, d), ["model"], "h", "d", "a", "actual").select("model", F.round("brier", 6).alias("brier"))

    @add("v04_rps", f"SELECT model, round(avg(0.5 * (pow(h - CASE WHEN actual = 'H' THEN 1 ELSE 0 END, 2) + pow(h + d - CASE WHEN actual IN ('H', 'D') THEN 1 ELSE 0 END, 2))), 6) AS rps FROM ({PROBS_SQL}) GROUP BY 1")
    def v04(spark, d):
        return V.scores(probs(spark, d), ["model"], "h", "d", "a", "actual").select("model", F.round("rps", 6).alias("rps"))

    @add("v05_calibration_error", f"""
        WITH x AS (SELECT model, 'H' AS k, h AS p, CASE WHEN actual = 'H' THEN 1.0 ELSE 0 END AS y FROM ({PROBS_SQL}) UNION ALL SELECT model, 'D', d, CASE WHEN actual = 'D' THEN 1.0 ELSE 0 END FROM ({PROBS_SQL})
                   UNION ALL SELECT model, 'A', a, CASE WHEN actual = 'A' THEN 1.0 ELSE 0 END FROM ({PROBS_SQL})),
        b AS (SELECT *, CASE WHEN p < 0 OR p >= 1 THEN NULL WHEN p < 0.2 THEN 0 WHEN p < 0.4 THEN 1 WHEN p < 0.6000000000000001::DOUBLE THEN 2 WHEN p < 0.8 THEN 3 ELSE 4 END AS b FROM x),
        g AS (SELECT model, k, b, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM b GROUP BY 1, 2, 3),
        e AS (SELECT model, k, coalesce(sum(CASE WHEN b IS NOT NULL THEN n * abs(mp - my) END), 0) / sum(n) AS e FROM g GROUP BY 1, 2)
        SELECT model, round(avg(e), 6) AS ece FROM e GROUP BY 1""")
    def v05(spark, d):
        return V.calibration_error(probs(spark, d), ["model"], "h", "d", "a", "actual").select("model", F.round("ece", 6).alias("ece"))

    @add("v06_bootstrap_interval")
    def v06(spark, d):
        r = V.rps(F.col("h"), F.col("d"), F.col("a"), F.col("actual"))
        models = ["elo", "cycle", "flat"]
        wide = probs(spark, d).groupBy(F.col("match_no").alias("row_id")).agg(*[F.max(F.when(F.col("model") == m, r)).alias(m) for m in models])
        return V.bootstrap(wide, models, 10_000).select("value", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])

    @add("v07_paired_t")
    def v07(spark, d):
        r = V.rps(F.col("h"), F.col("d"), F.col("a"), F.col("actual"))
        p = probs(spark, d).groupBy("match_no").agg(F.max(F.when(F.col("model") == "elo", r)).alias("x"), F.max(F.when(F.col("model") == "flat", r)).alias("y"))
        return V.paired_t(p, "x", "y")

    @add("v08_agreement_tiers", f"""
        SELECT match_no, CASE count(DISTINCT f) WHEN 1 THEN 'golden_zone' WHEN 2 THEN 'two_agree' ELSE 'split' END AS tier FROM (SELECT match_no, {fav} AS f FROM ({PROBS_SQL})) GROUP BY 1""")
    def v08(spark, d):
        f = V.favourite(F.col("h"), F.col("d"), F.col("a"))
        return probs(spark, d).groupBy("match_no").agg(F.collect_list(f).alias("f")).select("match_no", V.agreement_tier(F.col("f")).alias("tier"))

    @add("v09_tier_report", f"""
        WITH f AS (SELECT match_no, actual, {fav} AS f, model FROM ({PROBS_SQL})),
        t AS (SELECT match_no, max(actual) AS actual, count(DISTINCT f) AS k, max(CASE WHEN model = 'elo' THEN f END) AS e FROM f GROUP BY 1)
        SELECT CASE k WHEN 1 THEN 'golden_zone' WHEN 2 THEN 'two_agree' ELSE 'split' END AS tier, count(*) AS n, CAST(sum(CASE WHEN e = actual THEN 1 ELSE 0 END) AS BIGINT) AS correct,
               CAST(sum(CASE WHEN k = 1 AND e <> actual THEN 1 ELSE 0 END) AS BIGINT) AS false_consensus FROM t GROUP BY 1""")
    def v09(spark, d):
        f = V.favourite(F.col("h"), F.col("d"), F.col("a"))
        t = probs(spark, d).groupBy("match_no").agg(F.max("actual").alias("actual"), F.collect_list(f).alias("f"), F.max(F.when(F.col("model") == "elo", f)).alias("e"))
        t = t.select(V.agreement_tier(F.col("f")).alias("tier"), (F.col("e") == F.col("actual")).alias("ok"))
        # what turned out wrong is a column of its own: it is known only afterwards
        return t.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("int")).alias("correct"), F.sum(F.when((F.col("tier") == "golden_zone") & ~F.col("ok"), 1).otherwise(0)).alias("false_consensus"))

    @add("v10_stage_split", f"SELECT is_ko, model, count(*) AS n, round(avg(CASE WHEN {fav} = actual THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({PROBS_SQL}) GROUP BY 1, 2")
    def v10(spark, d):
        return V.scores(probs(spark, d), ["is_ko", "model"], "h", "d", "a", "actual").select("is_ko", "model", "n", F.round("accuracy", 6).alias("accuracy"))

    @add("v11_best_model", f"SELECT model FROM (SELECT model, avg(0.5 * (pow(h - CASE WHEN actual = 'H' THEN 1 ELSE 0 END, 2) + pow(h + d - CASE WHEN actual IN ('H', 'D') THEN 1 ELSE 0 END, 2))) AS r FROM ({PROBS_SQL}) GROUP BY 1) ORDER BY r LIMIT 1")
    def v11(spark, d):
        s = V.scores(probs(spark, d), ["model"], "h", "d", "a", "actual")
        return s.agg(F.min_by("model", "rps").alias("model"))

    @add("v12_calibration_table", f"""
        WITH b AS (SELECT CASE WHEN h < 0.2 THEN 0 WHEN h < 0.35 THEN 1 WHEN h < 0.5 THEN 2 WHEN h < 0.65 THEN 3 ELSE 4 END AS bin, h, CASE WHEN actual = 'H' THEN 1.0 ELSE 0 END AS y FROM ({PROBS_SQL}) WHERE model = 'elo' AND h IS NOT NULL)
        SELECT bin, count(*) AS n, round(avg(h), 6) AS forecast, round(avg(y), 6) AS observed FROM b GROUP BY 1""")
    def v12(spark, d):
        t = V.calibration_table(probs(spark, d).where("model = 'elo'"), "h", F.when(F.col("actual") == "H", 1.0).otherwise(0.0))
        return t.select("bin", "n", F.round("forecast", 6).alias("forecast"), F.round("observed", 6).alias("observed"))


def _markets(add) -> None:
    @add("b01_market_rows", """
        SELECT DISTINCT event_ticker, ticker, status, last_price FROM (SELECT json_extract_string(m, '$.event_ticker') AS event_ticker, json_extract_string(m, '$.ticker') AS ticker, json_extract_string(m, '$.status') AS status,
               TRY_CAST(json_extract_string(m, '$.last_price_dollars') AS DOUBLE) AS last_price FROM (SELECT unnest(CAST(json_extract(payload, '$.markets') AS JSON[])) AS m FROM kxfifaadvance_markets WHERE json_valid(payload) AND json_type(payload, '$.markets') = 'ARRAY'))""")
    def b01(spark, d):
        from touchline.sources.files import nested_markets

        schema = "markets array<struct<event_ticker:string,ticker:string,status:string,last_price_dollars:string>>"
        k = nested_markets(table(spark, d, "kxfifaadvance_markets", ["payload"]), "payload", schema)
        return k.select("market.event_ticker", "market.ticker", "market.status", F.col("market.last_price_dollars").try_cast("double").alias("last_price")).distinct()

    @add("b02_snapshot_rows", """
        SELECT snap_id, match_id, market_type, trim(outcome) AS outcome, yes_price, coalesce(volume, 0) AS volume FROM polymarket_snapshot WHERE nullif(trim(outcome), '') IS NOT NULL""")
    def b02(spark, d):
        s = table(spark, d, "polymarket_snapshot", ["snap_id", "match_id", "market_type", "outcome", "yes_price", "volume"])
        return s.where(F.trim("outcome") != "").select("snap_id", "match_id", "market_type", F.trim("outcome").alias("outcome"), "yes_price", F.coalesce("volume", F.lit(0.0)).alias("volume"))

    @add("b03_golden_zone", f"""
        WITH o AS (SELECT match_no, model, k, p, row_number() OVER (PARTITION BY match_no, model ORDER BY p DESC, CASE k WHEN 'home' THEN 0 WHEN 'draw' THEN 1 ELSE 2 END) AS rn FROM
          (SELECT match_no, model, 'home' AS k, h AS p FROM ({PROBS_SQL}) UNION ALL SELECT match_no, model, 'draw', d FROM ({PROBS_SQL}) UNION ALL SELECT match_no, model, 'away', a FROM ({PROBS_SQL})) WHERE p IS NOT NULL)
        SELECT match_no, CASE WHEN count(*) = 3 AND count(DISTINCT k) = 1 THEN 1 ELSE 0 END AS golden_zone, max(CASE WHEN model = 'elo' THEN k END) AS pick FROM o WHERE rn = 1 GROUP BY 1""")
    def b03(spark, d):
        return B.golden_zone(_wide(spark, d), ["match_no"], "outcome", ["elo", "cycle", "flat"], ["home", "draw", "away"])

    @add("b04_blend_and_edge", f"""
        WITH o AS (SELECT match_no, 'home' AS outcome, max(CASE WHEN model = 'elo' THEN h END) AS e, max(CASE WHEN model = 'cycle' THEN h END) AS c, max(CASE WHEN model = 'flat' THEN h END) AS f FROM ({PROBS_SQL}) GROUP BY 1)
        SELECT match_no, outcome, round((e + c + f) / 3, 6) AS p, round((e + c + f) / 3 - f, 6) AS edge FROM o""")
    def b04(spark, d):
        w = _wide(spark, d).where("outcome = 'home'")
        p = B.blend_if_complete([F.col("elo"), F.col("cycle"), F.col("flat")])
        return w.select("match_no", "outcome", F.round(p, 6).alias("p"), F.round(p - F.col("flat"), 6).alias("edge"))

    @add("b05_opportunities", f"""
        WITH l AS (SELECT match_no, model, 'home' AS k, h AS p, 0 AS o FROM ({PROBS_SQL}) UNION ALL SELECT match_no, model, 'draw', d, 1 FROM ({PROBS_SQL}) UNION ALL SELECT match_no, model, 'away', a, 2 FROM ({PROBS_SQL})),
        t AS (SELECT match_no, k, row_number() OVER (PARTITION BY match_no, model ORDER BY p DESC, o) AS rn FROM l WHERE p IS NOT NULL), z AS (SELECT match_no, count(*) = 3 AND count(DISTINCT k) = 1 AS gz FROM t WHERE rn = 1 GROUP BY 1),
        w AS (SELECT match_no, k AS outcome, max(CASE WHEN model = 'elo' THEN p END) AS e, max(CASE WHEN model = 'cycle' THEN p END) AS c, max(CASE WHEN model = 'flat' THEN p END) AS f FROM l GROUP BY 1, 2)
        SELECT w.match_no, w.outcome, CASE WHEN z.gz AND (e + c + f) / 3 - f > 0.03 THEN 'yes' ELSE 'no' END AS opportunity FROM w JOIN z USING (match_no)""")
    def b05(spark, d):
        w = _wide(spark, d)
        zone = B.golden_zone(w, ["match_no"], "outcome", ["elo", "cycle", "flat"], ["home", "draw", "away"])
        p = B.blend_if_complete([F.col("elo"), F.col("cycle"), F.col("flat")])
        return w.join(zone, "match_no").select("match_no", "outcome", B.opportunity(F.col("golden_zone"), p - F.col("flat")).alias("opportunity"))

    @add("b06_comparison", f"""
        SELECT match_no, outcome, round(elo, 6) AS p_elo, round(cycle, 6) AS p_cycle, round(flat, 6) AS p_market FROM (
          SELECT match_no, k AS outcome, max(CASE WHEN model = 'elo' THEN p END) AS elo, max(CASE WHEN model = 'cycle' THEN p END) AS cycle, max(CASE WHEN model = 'flat' THEN p END) AS flat FROM
          (SELECT match_no, model, 'home' AS k, h AS p FROM ({PROBS_SQL}) UNION ALL SELECT match_no, model, 'draw', d FROM ({PROBS_SQL}) UNION ALL SELECT match_no, model, 'away', a FROM ({PROBS_SQL})) GROUP BY 1, 2)""")
    def b06(spark, d):
        return _wide(spark, d).select("match_no", "outcome", F.round("elo", 6).alias("p_elo"), F.round("cycle", 6).alias("p_cycle"), F.round("flat", 6).alias("p_market")).orderBy("match_no", "outcome")

    @add("b07_cross_book", """
        WITH x AS (SELECT match_id, market_type, outcome, as_of_date, max(yes_price) AS p, max(volume) AS v FROM polymarket_snapshot WHERE yes_price IS NOT NULL GROUP BY 1, 2, 3, 4)
        SELECT a.match_id, a.market_type, a.outcome, a.p AS price_a, a.v AS volume_a, b.p AS price_b, b.v AS volume_b, round(abs(a.p - b.p), 6) AS gap
        FROM (SELECT * FROM x WHERE as_of_date < '2026-04-01') a JOIN (SELECT * FROM x WHERE as_of_date >= '2026-04-01') b USING (match_id, market_type, outcome) WHERE a.v > 0 AND b.v > 0 AND round(abs(a.p - b.p), 6) >= 0.015""")
    def b07(spark, d):
        s = table(spark, d, "polymarket_snapshot", ["match_id", "market_type", "outcome", "as_of_date", "yes_price", "volume"]).where("yes_price is not null")
        x = s.groupBy("match_id", "market_type", "outcome", "as_of_date").agg(F.max("yes_price").alias("p"), F.max("volume").alias("v"))
        return B.cross_book(x.where("as_of_date < '2026-04-01'"), x.where("as_of_date >= '2026-04-01'"), ["match_id", "market_type", "outcome"], "p", "v")

    @add("b08_devig_multiplicative", f"""
        WITH p AS ({PRICES_SQL}) SELECT user_id, day, outcome, round(price / sum(price) OVER (PARTITION BY user_id, day), 6) AS fair FROM p""")
    def b08(spark, d):
        return B.multiplicative(prices(spark, d), ["user_id", "day"], "price").select("user_id", "day", "outcome", F.round("fair", 6).alias("fair"))

    @add("b08_devig_power")
    def b08b(spark, d):
        return B.devig(prices(spark, d), ["user_id", "day"], "outcome", "price", "power").withColumn("fair", F.round("fair", 6))

    @add("b08_devig_informed_money")
    def b08c(spark, d):
        return B.devig(prices(spark, d), ["user_id", "day"], "outcome", "price", "shin").withColumn("fair", F.round("fair", 6))

    @add("b09_half_kelly", f"""
        WITH p AS ({PRICES_SQL}), k AS (SELECT *, least(price * 1.12, 0.999) AS p, price * 1.02 AS sharp FROM p), f AS (SELECT *, ((1 / price - 1) * p - (1 - p)) / (1 / price - 1) * 0.5 AS f FROM k)
        SELECT user_id, day, outcome, round(CASE WHEN p - price >= 0.03 AND p - sharp >= 0.015 AND f > 0 AND price BETWEEN 1e-9 AND 1 - 1e-9 THEN least(f, 0.02) ELSE 0 END, 6) AS stake FROM f WHERE price < 1""")
    def b09(spark, d):
        q = prices(spark, d).where("price < 1")
        stake = B.half_kelly(F.least(F.col("price") * 1.12, F.lit(0.999)), F.col("price"), F.col("price") * 1.02)
        return q.select("user_id", "day", "outcome", F.round(stake, 6).alias("stake"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """One row a match and outcome with the three models side by side."""
    from touchline.operators.relational import outer_by_tag

    long = probs(spark, d).select("match_no", "model", F.expr("stack(3, 'home', h, 'draw', d, 'away', a) as (outcome, p)"))
    return outer_by_tag({m: long.where(F.col("model") == m) for m in ("elo", "cycle", "flat")}, ["match_no", "outcome"], "p")
