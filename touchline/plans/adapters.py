"""Football shapes over the driver's tables.

Each adapter is plain integer or string arithmetic, written once for Spark and
once as SQL, so that generic operators can be checked on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.functions.text import with_normalized
from touchline.operators.teams import codes_sql, key_sql, own_name, team_list, with_team_codes
from touchline.sources.tables import table

#: Matches from line items: two of twenty teams that are never equal.
MATCHES_SQL = """
SELECT CAST(l_shipdate AS DATE) AS match_date, l_orderkey AS k1, l_linenumber AS k2, l_partkey AS k3, l_suppkey AS k4,
       CAST(l_extendedprice * 100 AS BIGINT) AS k5,
       CAST(l_suppkey % 20 AS INTEGER) AS home, CAST((l_suppkey + 1 + l_partkey % 18) % 20 AS INTEGER) AS away,
       CAST(CAST(l_quantity AS INTEGER) % 4 AS INTEGER) AS hg, CAST(l_linenumber % 4 AS INTEGER) AS ag
FROM lineitem
"""


def matches(spark: SparkSession, folder: str) -> DataFrame:
    """``match_date, k1..k5, home, away, hg, ag``; the keys give a total order."""
    cols = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return table(spark, folder, "lineitem", cols).select(
        F.to_date("l_shipdate").alias("match_date"),
        F.col("l_orderkey").alias("k1"),
        F.col("l_linenumber").alias("k2"),
        F.col("l_partkey").alias("k3"),
        F.col("l_suppkey").alias("k4"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("k5"),
        (F.col("l_suppkey") % 20).cast("int").alias("home"),
        ((F.col("l_suppkey") + 1 + F.col("l_partkey") % 18) % 20).cast("int").alias("away"),
        (F.col("l_quantity").cast("int") % 4).cast("int").alias("hg"),
        (F.col("l_linenumber") % 4).cast("int").alias("ag"),
    )


#: How sides, goals and shoot-outs are written.
_SIDES = r"(?i)^\s*(.+?)\s+(?:vs\.?|v\.?|-|–|—)\s+(.+?)\s*$"
_SCORE = r"^\D*(\d+)\s*[-–—:]\s*(\d+)"
_PENS = r"(?i)\((\d+)\s*[-–—:]\s*(\d+)\s*p"

_GOAL_SQL = {k: f"TRY_CAST(nullif(regexp_extract(score, '{p}', {i}), '') AS INTEGER)" for k, p, i in (("hg", _SCORE, 1), ("ag", _SCORE, 2), ("hp", _PENS, 1), ("ap", _PENS, 2))}
_SIDE_SQL = f"""SELECT *, regexp_extract(match, '{_SIDES}', 1) AS lt, regexp_extract(match, '{_SIDES}', 2) AS rt, upper(substr(trim(actual), 1, 1)) AS told,
  {", ".join(f"{v} AS {k}" for k, v in _GOAL_SQL.items())} FROM match_results"""
#: What :func:`results` gives.
RESULTS_SQL = f"""
SELECT match_no, match_date, coalesce({key_sql("th.team_name")}, nullif(lower(trim(lt)), '')) AS home, coalesce({key_sql("ta.team_name")}, nullif(lower(trim(rt)), '')) AS away, hg, ag,
       is_ko, tier, elo_h, elo_d, elo_a, elo_pred,
       CASE WHEN told IN ('H', 'D', 'A') THEN told WHEN hg > ag THEN 'H' WHEN hg < ag THEN 'A' WHEN hp > ap THEN 'H' WHEN hp < ap THEN 'A' WHEN hg = ag THEN 'D' END AS actual,
       ch.code AS home_code, ca.code AS away_code
FROM ({_SIDE_SQL}) sd
LEFT JOIN {codes_sql(f"SELECT lt AS typed FROM ({_SIDE_SQL}) UNION ALL SELECT rt FROM ({_SIDE_SQL})")} ch ON ch.typed = lt
LEFT JOIN {codes_sql(f"SELECT lt AS typed FROM ({_SIDE_SQL}) UNION ALL SELECT rt FROM ({_SIDE_SQL})")} ca ON ca.typed = rt
LEFT JOIN teams th ON th.team_code = ch.code LEFT JOIN teams ta ON ta.team_code = ca.code
"""
#: What :func:`scored` and :func:`decided` give.
SCORED_SQL = f"SELECT * FROM ({RESULTS_SQL}) WHERE home IS NOT NULL AND away IS NOT NULL AND hg IS NOT NULL AND ag IS NOT NULL"
DECIDED_SQL = f"""SELECT * EXCLUDE (hg, ag), CASE WHEN hg IS NULL OR ag IS NULL THEN CASE WHEN actual = 'H' THEN 1 ELSE 0 END ELSE hg END AS hg,
  CASE WHEN hg IS NULL OR ag IS NULL THEN CASE WHEN actual = 'A' THEN 1 ELSE 0 END ELSE ag END AS ag FROM ({RESULTS_SQL}) WHERE home IS NOT NULL AND away IS NOT NULL AND actual IS NOT NULL"""


def results(spark: SparkSession, folder: str) -> DataFrame:
    """``match_no, match_date, home, away, hg, ag``, the model columns and the
    teams' codes, of every row.

    A side is the key of the listed name of the team it means, so that all
    writings of a team are one; what means no listed team stays as written. Goals are null
    without a score. ``actual`` is H, D or A as told, else by score and shoot-out.
    """
    df = table(spark, folder, "match_results").withColumns({"left": F.regexp_extract("match", _SIDES, 1), "right": F.regexp_extract("match", _SIDES, 2)})
    listed = team_list(table(spark, folder, "teams"), table(spark, folder, "team_aliases"))
    coded = with_team_codes(df, {"left": "home_code", "right": "away_code"}, listed)
    written = lambda c, code: F.coalesce(own_name(F.col(code), listed), F.when(F.trim(c) != "", F.lower(F.trim(c))))
    goals = [F.regexp_extract("score", _SCORE, i).try_cast("int") for i in (1, 2)]
    pens = [F.regexp_extract("score", _PENS, i).try_cast("int") for i in (1, 2)]
    by_goals = F.when(goals[0] > goals[1], "H").when(goals[0] < goals[1], "A").when(pens[0] > pens[1], "H").when(pens[0] < pens[1], "A").when(goals[0] == goals[1], "D")
    told = F.upper(F.substring(F.trim("actual"), 1, 1))
    return coded.select(
        "match_no", "match_date", written("left", "home_code").alias("home"), written("right", "away_code").alias("away"), goals[0].alias("hg"), goals[1].alias("ag"),
        "is_ko", "tier", "elo_h", "elo_d", "elo_a", "elo_pred", F.coalesce(F.when(told.isin("H", "D", "A"), told), by_goals).alias("actual"), "home_code", "away_code",
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The results with two sides and their goals."""
    return results(spark, folder).dropna(subset=["home", "away", "hg", "ag"])


def decided(spark: SparkSession, folder: str) -> DataFrame:
    """The results with two sides and an outcome; where no score is given, ``hg``
    and ``ag`` only say who won."""
    r = results(spark, folder).dropna(subset=["home", "away", "actual"])
    won = lambda side: F.when(F.col("actual") == side, 1).otherwise(0)
    unknown = F.col("hg").isNull() | F.col("ag").isNull()
    return r.withColumns({"hg": F.when(unknown, won("H")).otherwise(F.col("hg")), "ag": F.when(unknown, won("A")).otherwise(F.col("ag"))})


def with_person_keys(rows: DataFrame, folder: str, name: str = "player_name", nation: str = "nation") -> DataFrame:
    """Add ``nn``, the normalized name, and ``cc``, the code of the nation as typed;
    what means no listed nation has none."""
    spark = rows.sparkSession
    coded = with_team_codes(rows, {nation: "cc"}, team_list(table(spark, folder, "teams"), table(spark, folder, "team_aliases")))
    return with_normalized(coded, name, "nn").withColumn("nn", F.when(F.col("nn") != "", F.col("nn")))


#: Player facts of two sources, long: orders are one source, line items of an
#: order the other.
FACTS_SQL = """
SELECT o_custkey AS player_id, 'orders' AS source, o_totalprice AS metric, CAST(1 AS BIGINT) AS games FROM orders
UNION ALL
SELECT o.o_custkey, 'lines', sum(l.l_extendedprice * (1 - l.l_discount)), count(*)
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey
"""


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """``player_id, source, metric, games`` in long form."""
    orders = table(spark, folder, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    lines = table(spark, folder, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"])
    one = orders.select(F.col("o_custkey").alias("player_id"), F.lit("orders").alias("source"), F.col("o_totalprice").alias("metric"), F.lit(1).cast("bigint").alias("games"))
    # lines are summed by order before the join, so the join moves one row an order
    per_order = lines.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("m"), F.count("*").alias("g"))
    two = (
        per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("player_id"))
        .agg(F.sum("m").alias("metric"), F.sum("g").alias("games"))
        .select("player_id", F.lit("lines").alias("source"), "metric", "games")
    )
    return one.unionByName(two)


#: Three rating layers of every nation, wide.
RATINGS_SQL = """
SELECT n.n_nationkey, n.n_name, round(sum(c.c_acctbal), 2) AS m1, round(avg(c.c_acctbal), 4) AS m2,
       CASE WHEN count(*) % 2 = 0 THEN CAST(count(*) AS DOUBLE) END AS m3
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name
"""


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """``n_nationkey, n_name, m1, m2, m3``; m3 is null for odd counts."""
    customer = table(spark, folder, "customer", ["c_nationkey", "c_acctbal"])
    nation = table(spark, folder, "nation", ["n_nationkey", "n_name"])
    agg = customer.groupBy("c_nationkey").agg(
        F.round(F.sum("c_acctbal"), 2).alias("m1"), F.round(F.avg("c_acctbal"), 4).alias("m2"), F.count("*").alias("n")
    )
    return agg.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_nationkey", "n_name", "m1", "m2", F.when(F.col("n") % 2 == 0, F.col("n").cast("double")).alias("m3")
    )
