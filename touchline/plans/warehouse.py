"""Scans, filters, joins, aggregates, windows, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from touchline.operators import relational as R
from touchline.operators.semantic import Model
from touchline.plans import adapters as A
from touchline.plans.registry import Registry
from touchline.sources.tables import table

#: Codes of the finals' qualifiers come from ``teams``; markets of one snapshot day.
LATEST = "(SELECT max(as_of_date) FROM polymarket_snapshot)"


def register(registry: Registry) -> None:
    add = registry.add

    # ---- aggregates -------------------------------------------------------
    @add("a01_top_by_total_across_sources", f"""
        WITH f AS ({A.FACTS_SQL})
        SELECT c.c_custkey, c.c_name, CAST(sum(f.games) AS BIGINT) AS games, round(sum(f.metric), 4) AS total,
               CAST(count(DISTINCT f.source) AS BIGINT) AS n_sources,
               round(sum(CASE WHEN f.source = 'orders' THEN f.metric ELSE 0 END), 4) AS from_orders
        FROM f JOIN customer c ON c.c_custkey = f.player_id
        GROUP BY c.c_custkey, c.c_name HAVING sum(f.games) >= 5
        ORDER BY total DESC, c.c_custkey LIMIT 20""")
    def a01(spark: SparkSession, d: str) -> DataFrame:
        f = A.facts(spark, d)
        per = f.groupBy("player_id").agg(
            F.sum("games").alias("games"),
            F.round(F.sum("metric"), 4).alias("total"),
            F.countDistinct("source").alias("n_sources"),
            F.round(F.sum(F.when(F.col("source") == "orders", F.col("metric")).otherwise(0.0)), 4).alias("from_orders"),
        ).where("games >= 5")
        top = per.orderBy(F.desc("total"), "player_id").limit(20)
        names = table(spark, d, "customer", ["c_custkey", "c_name"])
        return names.join(F.broadcast(top), F.col("c_custkey") == F.col("player_id")).select("c_custkey", "c_name", "games", "total", "n_sources", "from_orders")

    @add("a02_any_value_and_count", """
        SELECT n_regionkey, any_value(n_name) IS NOT NULL AS has_name, count(*) AS n FROM nation GROUP BY n_regionkey""")
    def a02(spark, d):
        return table(spark, d, "nation").groupBy("n_regionkey").agg(F.any_value("n_name", F.lit(True)).isNotNull().alias("has_name"), F.count("*").alias("n"))

    @add("a03_ordered_list", """
        SELECT country_code, string_agg(DISTINCT position, ',' ORDER BY position) AS positions, count(DISTINCT player_id) AS n
        FROM players WHERE country_code IS NOT NULL AND position IS NOT NULL GROUP BY country_code""")
    def a03(spark, d):
        p = table(spark, d, "players", ["player_id", "country_code", "position"]).where("country_code is not null and position is not null")
        return p.groupBy("country_code").agg(F.array_join(F.array_sort(F.collect_set("position")), ",").alias("positions"), F.countDistinct("player_id").alias("n"))

    @add("a04_match_rate", """
        SELECT round(100.0 * (SELECT count(*) FROM players WHERE understat_id IS NOT NULL) / (SELECT count(*) FROM players), 4) AS rate""")
    def a04(spark, d):
        return table(spark, d, "players", ["understat_id"]).agg(F.round(F.lit(100.0) * F.count("understat_id") / F.count("*"), 4).alias("rate"))

    @add("a05_uniqueness", """
        SELECT CAST(count(*) - count(DISTINCT row_id) AS BIGINT) AS dup_rows, CAST(count(*) - count(DISTINCT player_id) AS BIGINT) AS dup_players FROM players""")
    def a05(spark, d):
        return table(spark, d, "players", ["row_id", "player_id"]).agg(
            (F.count("*") - F.countDistinct("row_id")).alias("dup_rows"), (F.count("*") - F.countDistinct("player_id")).alias("dup_players"))

    @add("a06_duplicate_groups", """
        SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING n > 1""")
    def a06(spark, d):
        return table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")

    @add("a07_event_counters", """
        SELECT user_id, CAST(ts AS DATE) AS match_day,
               CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
               CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views,
               CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases,
               round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0), 4) AS purchase_value,
               CAST(count(*) AS BIGINT) AS n_events
        FROM events GROUP BY 1, 2""")
    def a07(spark, d):
        from touchline.operators.features import event_counters

        rules = {"clicks": F.col("event_type") == "click", "views": F.col("event_type") == "view", "purchases": F.col("event_type") == "purchase"}
        sums = {"purchase_value": (F.col("event_type") == "purchase", F.col("value"))}
        e = table(spark, d, "events", ["user_id", "ts", "event_type", "value"]).withColumn("match_day", F.to_date("ts"))
        out = event_counters(e, ["user_id", "match_day"], rules, sums)
        return out.withColumn("purchase_value", F.round("purchase_value", 4))

    @add("a08_minutes_span", """
        SELECT user_id, CAST(ts AS DATE) AS match_day,
               CAST(greatest(1, max(hour(ts) * 60 + minute(ts)) - min(hour(ts) * 60 + minute(ts)) + 1) AS BIGINT) AS minutes
        FROM events GROUP BY 1, 2""")
    def a08(spark, d):
        from touchline.operators.features import minutes_span

        e = table(spark, d, "events", ["user_id", "ts"]).select("user_id", F.to_date("ts").alias("match_day"), (F.hour("ts") * 60 + F.minute("ts")).cast("bigint").alias("minute"))
        return minutes_span(e, ["user_id", "match_day"], "minute")

    @add("a09_distinct_minutes", """
        SELECT user_id, CAST(greatest(1, count(DISTINCT hour(ts) * 60 + minute(ts))) AS BIGINT) AS minutes FROM events GROUP BY 1""")
    def a09(spark, d):
        return table(spark, d, "events", ["user_id", "ts"]).groupBy("user_id").agg(F.greatest(F.lit(1), F.countDistinct(F.hour("ts") * 60 + F.minute("ts"))).cast("bigint").alias("minutes"))

    @add("a10_opponent_credited", f"""
        WITH m AS ({A.SCORED_SQL}), t AS (
          SELECT home AS team, ag AS conceded FROM m UNION ALL SELECT away, hg FROM m)
        SELECT team, CAST(sum(conceded) AS BIGINT) AS conceded, count(*) AS n_matches FROM t GROUP BY team""")
    def a10(spark, d):
        from touchline.operators.features import opponent_credited

        return opponent_credited(A.scored(spark, d), "home", "away", "hg", "ag")

    @add("a11_sum_all_numeric", """
        SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber, round(sum(l_quantity), 4) AS l_quantity,
               round(sum(l_extendedprice), 2) AS l_extendedprice, round(sum(l_discount), 4) AS l_discount,
               round(sum(l_tax), 4) AS l_tax, count(DISTINCT l_orderkey) AS n_orders
        FROM lineitem GROUP BY l_suppkey""")
    def a11(spark, d):
        from touchline.operators.features import sum_numeric

        cols = ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
        out = sum_numeric(table(spark, d, "lineitem", cols), ["l_suppkey"], "l_orderkey", "n_orders")
        return out.select("l_suppkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), *[F.round(c, 2 if "price" in c else 4).alias(c) for c in cols[3:]], "n_orders")

    @add("a12_per_90", """
        SELECT player, nation, round(g / greatest(mins, 1) * 90, 4) AS goals_per_90, round(xg / greatest(mins, 1) * 90, 4) AS xg_per_90, mins
        FROM (SELECT player_name AS player, nation, coalesce(sum(TRY_CAST(goals AS DOUBLE)), 0) AS g,
                     coalesce(sum(TRY_CAST(xg AS DOUBLE)), 0) AS xg, coalesce(sum(TRY_CAST(minutes AS DOUBLE)), 0) AS mins
              FROM player_matches WHERE player_name IS NOT NULL GROUP BY 1, 2)""")
    def a12(spark, d):
        from touchline.operators.features import per_90

        p = table(spark, d, "player_matches", ["player_name", "nation", "goals", "xg", "minutes"]).where("player_name is not null")
        num = lambda c: F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0))
        agg = p.groupBy(F.col("player_name").alias("player"), "nation").agg(num("goals").alias("g"), num("xg").alias("xg"), num("minutes").alias("mins"))
        return agg.select("player", "nation", per_90(F.col("g"), F.col("mins")).alias("goals_per_90"), per_90(F.col("xg"), F.col("mins")).alias("xg_per_90"), "mins")

    @add("a13_team_match_stats", """
        SELECT match_ref, team_title, CAST(sum(TRY_CAST(shots AS BIGINT)) AS BIGINT) AS shots, CAST(sum(TRY_CAST(goals AS BIGINT)) AS BIGINT) AS goals,
               round(sum(TRY_CAST(xg AS DOUBLE)), 5) AS xg, count(DISTINCT roster_id) AS players
        FROM player_matches GROUP BY 1, 2""")
    def a13(spark, d):
        p = table(spark, d, "player_matches", ["match_ref", "team_title", "shots", "goals", "xg", "roster_id"])
        return p.groupBy("match_ref", "team_title").agg(
            F.sum(F.col("shots").try_cast("bigint")).alias("shots"), F.sum(F.col("goals").try_cast("bigint")).alias("goals"),
            F.round(F.sum(F.col("xg").try_cast("double")), 5).alias("xg"), F.countDistinct("roster_id").alias("players"))

    @add("a14_shot_grain", "SELECT event_id, user_id, CAST(ts AS DATE) AS day, value FROM events WHERE event_type = 'purchase'")
    def a14(spark, d):
        return table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.to_date("ts").alias("day"), "value")

    @add("a15_across_seasons", """
        WITH s AS (SELECT player_name, season, team_title, sum(TRY_CAST(minutes AS BIGINT)) AS m FROM player_matches
                   WHERE player_name IS NOT NULL AND team_title IS NOT NULL GROUP BY 1, 2, 3),
             r AS (SELECT *, row_number() OVER (PARTITION BY player_name ORDER BY m NULLS LAST, season NULLS LAST, team_title) AS least,
                          row_number() OVER (PARTITION BY player_name ORDER BY season DESC NULLS LAST, m DESC NULLS LAST, team_title) AS latest FROM s)
        SELECT player_name, CAST(sum(m) AS BIGINT) AS minutes, count(*) AS n_stints,
               max(CASE WHEN least = 1 THEN team_title END) AS last_team, max(CASE WHEN latest = 1 THEN team_title END) AS newest_team
        FROM r GROUP BY player_name""")
    def a15(spark, d):
        from touchline.operators.features import across_seasons

        p = table(spark, d, "player_matches", ["player_name", "season", "team_title", "minutes"]).where("player_name is not null and team_title is not null")
        return across_seasons(p, "player_name", "season", "team_title", F.col("minutes").try_cast("bigint"))

    @add("a16_quantile_fallback", f"""
        WITH r AS ({A.RATINGS_SQL}), q AS (SELECT quantile_cont(m3, 0.25) AS q FROM r)
        SELECT n_nationkey, round(coalesce(m3, q), 4) AS rating, m3 IS NULL AS fallback FROM r, q""")
    def a16(spark, d):
        from touchline.operators.features import with_quantile_fallback

        return with_quantile_fallback(A.ratings(spark, d).select("n_nationkey", "m3"), "m3", 0.25).select("n_nationkey", F.round("rating", 4).alias("rating"), "fallback")

    @add("a17_median_fallback", f"""
        WITH r AS ({A.RATINGS_SQL}), q AS (SELECT median(m3) AS q FROM r)
        SELECT n_nationkey, round(coalesce(m3, q), 4) AS rating FROM r, q""")
    def a17(spark, d):
        from touchline.operators.features import with_quantile_fallback

        return with_quantile_fallback(A.ratings(spark, d).select("n_nationkey", "m3"), "m3", 0.5).select("n_nationkey", F.round("rating", 4).alias("rating"))

    @add("a18_group_mean_and_sum", """
        SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean_balance, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1""")
    def a18(spark, d):
        return table(spark, d, "customer", ["c_nationkey", "c_acctbal"]).groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.round(F.sum("c_acctbal"), 2).alias("total"))

    @add("a19_coverage_audit", """
        SELECT nation_name AS nation, count(*) AS players, count(understat_id) AS matched,
               round(CAST(count(understat_id) AS DOUBLE) / count(*), 4) AS match_rate,
               CAST(sum(CASE WHEN nullif(trim(current_club), '') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_club,
               CAST(sum(CASE WHEN NOT is_active THEN 1 ELSE 0 END) AS BIGINT) AS inactive
        FROM players WHERE nation_name IS NOT NULL GROUP BY 1""")
    def a19(spark, d):
        from touchline.operators.quality import coverage

        p = table(spark, d, "players", ["nation_name", "understat_id", "current_club", "is_active"]).where("nation_name is not null")
        return coverage(p.withColumnRenamed("nation_name", "nation"), "nation")

    @add("a20_records_with_floor_and_cap", """
        SELECT player_name, CAST(sum(TRY_CAST(minutes AS BIGINT)) AS BIGINT) AS minutes, round(sum(TRY_CAST(xg AS DOUBLE)), 5) AS xg,
               round(avg(TRY_CAST(xa AS DOUBLE)), 5) AS mean_xa
        FROM player_matches WHERE player_name IS NOT NULL GROUP BY 1
        HAVING sum(TRY_CAST(minutes AS BIGINT)) >= 90 AND sum(TRY_CAST(xg AS DOUBLE)) / sum(TRY_CAST(minutes AS BIGINT)) * 90 <= 6""")
    def a20(spark, d):
        p = table(spark, d, "player_matches", ["player_name", "minutes", "xg", "xa"]).where("player_name is not null")
        agg = p.groupBy("player_name").agg(
            F.sum(F.col("minutes").try_cast("bigint")).alias("minutes"), F.sum(F.col("xg").try_cast("double")).alias("x"), F.round(F.avg(F.col("xa").try_cast("double")), 5).alias("mean_xa"))
        return agg.where((F.col("minutes") >= 90) & (F.col("x") / F.col("minutes") * 90 <= 6)).select("player_name", "minutes", F.round("x", 5).alias("xg"), "mean_xa")

    @add("a21_describe", """
        SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS least,
               round(quantile_cont(c_acctbal, 0.25), 4) AS q25, round(quantile_cont(c_acctbal, 0.5), 4) AS q50,
               round(quantile_cont(c_acctbal, 0.75), 4) AS q75, max(c_acctbal) AS most FROM customer""")
    def a21(spark, d):
        from touchline.operators.features import describe

        return describe(table(spark, d, "customer", ["c_acctbal"]), "c_acctbal")

    @add("a22_by_dotted_dimensions", """
        SELECT r.r_name AS region, round(avg(c.c_acctbal), 4) AS mean_balance, count(DISTINCT n.n_name) AS nations, count(*) AS n
        FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
        WHERE c.c_acctbal > 0 GROUP BY 1""")
    def a22(spark, d):
        return _model(spark, d).query(
            "customer", where="c_acctbal > 0",
            select={"region": "nation.region.r_name", "mean_balance": "round(avg(c_acctbal), 4)", "nations": "count(distinct nation.n_name)", "n": "count(*)"})

    @add("a23_confederation_rollup", """
        SELECT confederation, count(DISTINCT team_code) AS teams, CAST(sum(CASE WHEN is_wc2026_qualifier THEN 1 ELSE 0 END) AS BIGINT) AS qualifiers FROM teams GROUP BY 1""")
    def a23(spark, d):
        return table(spark, d, "teams").groupBy("confederation").agg(F.countDistinct("team_code").alias("teams"), F.sum(F.when(F.col("is_wc2026_qualifier"), 1).otherwise(0)).alias("qualifiers"))

    # ---- filters and projections ------------------------------------------
    @add("p01_project_cast_constants", """
        SELECT CAST(c_custkey AS INTEGER) AS id, CAST('base' AS VARCHAR) AS source, CAST(c_acctbal AS DOUBLE) AS metric, CAST(NULL AS DOUBLE) AS unknown FROM customer""")
    def p01(spark, d):
        return table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select(F.col("c_custkey").cast("int").alias("id"), F.lit("base").alias("source"), F.col("c_acctbal").alias("metric"), F.lit(None).cast("double").alias("unknown"))

    @add("p02_null_filters", "SELECT row_id, player_id FROM players WHERE birth_date IS NOT NULL AND espn_player_id IS NULL")
    def p02(spark, d):
        return table(spark, d, "players", ["row_id", "player_id", "birth_date", "espn_player_id"]).where("birth_date is not null and espn_player_id is null").select("row_id", "player_id")

    @add("p03_flag_and_in_list", "SELECT team_code, team_name FROM teams WHERE is_wc2026_qualifier AND confederation IN ('INLAND', 'ISLES')")
    def p03(spark, d):
        t = table(spark, d, "teams")
        return t.where(F.col("is_wc2026_qualifier") & F.col("confederation").isin("INLAND", "ISLES")).select("team_code", "team_name")

    @add("p04_like_and_dotted_flag", """
        SELECT p.row_id FROM players p JOIN teams t ON p.country_code = t.team_code WHERE p.position LIKE '%D%' AND p.birth_year >= 1990 AND t.is_wc2026_qualifier""")
    def p04(spark, d):
        t = table(spark, d, "teams", ["team_code", "is_wc2026_qualifier"]).where("is_wc2026_qualifier")
        p = table(spark, d, "players", ["row_id", "position", "birth_year", "country_code"]).where(F.col("position").contains("D") & (F.col("birth_year") >= 1990))
        return p.join(t, p["country_code"] == t["team_code"], "left_semi").select("row_id")

    @add("p05_date_windows", """
        SELECT match_no FROM match_results WHERE (match_date >= DATE '2019-01-01' AND match_date < DATE '2020-01-01') OR (match_date BETWEEN DATE '2021-06-01' AND DATE '2021-06-30' AND is_ko)""")
    def p05(spark, d):
        m = table(spark, d, "match_results", ["match_no", "match_date", "is_ko"])
        return m.where("(match_date >= date'2019-01-01' and match_date < date'2020-01-01') or (match_date between date'2021-06-01' and date'2021-06-30' and is_ko)").select("match_no")

    @add("p06_thresholds", "SELECT roster_id, minutes FROM player_matches WHERE TRY_CAST(minutes AS INTEGER) >= 60 AND TRY_CAST(xg AS DOUBLE) <= 0.5")
    def p06(spark, d):
        p = table(spark, d, "player_matches", ["roster_id", "minutes", "xg"])
        return p.where((F.col("minutes").try_cast("int") >= 60) & (F.col("xg").try_cast("double") <= 0.5)).select("roster_id", "minutes")

    @add("p07_anchored_regex", """
        SELECT regexp_full_match(player_id, 'P[0-9]{8}') AS ok, count(*) AS n FROM players GROUP BY 1""")
    def p07(spark, d):
        return table(spark, d, "players", ["player_id"]).groupBy(F.col("player_id").rlike("^P[0-9]{8}$").alias("ok")).agg(F.count("*").alias("n"))

    @add("p08_prefix_and_exact_exclusion", "SELECT snap_id, outcome FROM polymarket_snapshot WHERE outcome IS NOT NULL AND NOT starts_with(outcome, 'Team ') AND outcome <> 'Other'")
    def p08(spark, d):
        p = table(spark, d, "polymarket_snapshot", ["snap_id", "outcome"])
        return p.where(~F.col("outcome").startswith("Team ") & (F.col("outcome") != "Other"))

    @add("p09_case_and_default", "SELECT team_code, CASE WHEN NOT is_wc2026_qualifier THEN NULL ELSE coalesce(iso2_code, 'pending') END AS status FROM teams")
    def p09(spark, d):
        return table(spark, d, "teams").select("team_code", F.when(~F.col("is_wc2026_qualifier"), None).otherwise(F.coalesce("iso2_code", F.lit("pending"))).alias("status"))

    @add("p10_finals_only", "SELECT t.team_code, count(DISTINCT p.player_id) AS players FROM teams t JOIN players p ON p.country_code = t.team_code WHERE t.is_wc2026_qualifier GROUP BY 1")
    def p10(spark, d):
        t = table(spark, d, "teams", ["team_code", "is_wc2026_qualifier"]).where("is_wc2026_qualifier")
        p = table(spark, d, "players", ["player_id", "country_code"])
        return p.join(t, p["country_code"] == t["team_code"], "left_semi").groupBy(F.col("country_code").alias("team_code")).agg(F.countDistinct("player_id").alias("players"))

    @add("p11_rows_of_listed_fixtures", """
        SELECT snap_id FROM polymarket_snapshot s WHERE EXISTS (SELECT 1 FROM teams t WHERE t.is_wc2026_qualifier AND t.team_name = s.outcome)""")
    def p11(spark, d):
        t = table(spark, d, "teams", ["team_name", "is_wc2026_qualifier"]).where("is_wc2026_qualifier")
        s = table(spark, d, "polymarket_snapshot", ["snap_id", "outcome"])
        return s.join(t, s["outcome"] == t["team_name"], "left_semi").select("snap_id")

    @add("p12_least_volume", "SELECT snap_id, volume FROM polymarket_snapshot WHERE volume >= 10000")
    def p12(spark, d):
        return table(spark, d, "polymarket_snapshot", ["snap_id", "volume"]).where("volume >= 10000")

    # ---- joins ------------------------------------------------------------
    @add("j01_dim_left_aggregate", """
        SELECT t.team_code, t.team_name, a.n AS squad_rows, a.latest FROM teams t
        LEFT JOIN (SELECT country_code, count(*) AS n, max(last_updated_at) AS latest FROM players GROUP BY 1) a ON a.country_code = t.team_code""")
    def j01(spark, d):
        agg = table(spark, d, "players", ["country_code", "last_updated_at"]).groupBy("country_code").agg(F.count("*").alias("squad_rows"), F.max("last_updated_at").alias("latest"))
        t = table(spark, d, "teams", ["team_code", "team_name"])
        return t.join(agg, t["team_code"] == agg["country_code"], "left").select("team_code", "team_name", "squad_rows", "latest")

    @add("j02_resolve_then_drop", "SELECT s.snap_id, t.team_code FROM polymarket_snapshot s LEFT JOIN teams t ON lower(trim(s.outcome)) = lower(t.team_name) WHERE t.team_code IS NOT NULL")
    def j02(spark, d):
        s, t = table(spark, d, "polymarket_snapshot", ["snap_id", "outcome"]), table(spark, d, "teams", ["team_code", "team_name"])
        return s.join(t, F.lower(F.trim(s["outcome"])) == F.lower(t["team_name"]), "inner").select("snap_id", "team_code")

    @add("j03_fact_to_dim", "SELECT c.c_mktsegment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1")
    def j03(spark, d):
        # pre-aggregated by key: the join moves one row a customer
        per = table(spark, d, "orders", ["o_custkey", "o_totalprice"]).groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
        c = table(spark, d, "customer", ["c_custkey", "c_mktsegment"])
        return per.join(c, per["o_custkey"] == c["c_custkey"]).groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))

    @add("j04_coverage_gaps", """
        SELECT c.c_custkey, c.c_name FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') o
        ON o.o_custkey = c.c_custkey WHERE o.o_custkey IS NULL""")
    def j04(spark, d):
        o = table(spark, d, "orders", ["o_custkey", "o_orderpriority", "o_orderstatus"]).where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
        c = table(spark, d, "customer", ["c_custkey", "c_name"])
        return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")

    @add("j05_attack_against_defence", f"""
        WITH m AS ({A.SCORED_SQL}), t AS (SELECT home AS team, hg AS f, ag AS a FROM m UNION ALL SELECT away, ag, hg FROM m),
        att AS (SELECT team, avg(f) AS v FROM t GROUP BY 1), def AS (SELECT team, avg(a) AS v FROM t GROUP BY 1)
        SELECT att.team, round(att.v, 4) AS attack, round(def.v, 4) AS defence, round(att.v - def.v, 4) AS net FROM att JOIN def USING (team)""")
    def j05(spark, d):
        m = A.scored(spark, d)
        t = m.select(F.explode(F.array(F.struct(F.col("home").alias("team"), F.col("hg").alias("f"), F.col("ag").alias("a")), F.struct(F.col("away").alias("team"), F.col("ag").alias("f"), F.col("hg").alias("a")))).alias("x")).select("x.*")
        # one conditional aggregate instead of a self-join of two filtered scans
        return t.groupBy("team").agg(F.round(F.avg("f"), 4).alias("attack"), F.round(F.avg("a"), 4).alias("defence"), F.round(F.avg("f") - F.avg("a"), 4).alias("net"))

    @add("j06_home_away_self_join", """
        WITH t AS (SELECT match_ref, team_title, max(h_team) AS h, max(a_team) AS a, round(sum(TRY_CAST(xg AS DOUBLE)), 5) AS xg FROM player_matches WHERE team_title IS NOT NULL AND h_team IS NOT NULL GROUP BY 1, 2)
        SELECT x.match_ref, x.team_title AS home, y.team_title AS away, x.xg AS xg_home, y.xg AS xg_away FROM t x JOIN t y ON x.match_ref = y.match_ref AND x.team_title = x.h AND y.team_title = y.a AND x.team_title <> y.team_title""")
    def j06(spark, d):
        p = table(spark, d, "player_matches", ["match_ref", "team_title", "h_team", "a_team", "xg"]).where("team_title is not null and h_team is not null")
        t = p.groupBy("match_ref", "team_title").agg(F.max("h_team").alias("h"), F.max("a_team").alias("a"), F.round(F.sum(F.col("xg").try_cast("double")), 5).alias("xg"))
        x, y = t.where("team_title = h").alias("x"), t.where("team_title = a").alias("y")
        return x.join(y, (F.col("x.match_ref") == F.col("y.match_ref")) & (F.col("x.team_title") != F.col("y.team_title"))).select(
            "x.match_ref", F.col("x.team_title").alias("home"), F.col("y.team_title").alias("away"), F.col("x.xg").alias("xg_home"), F.col("y.xg").alias("xg_away"))

    @add("j07_unordered_pair_lookup", f"""
        WITH m AS ({A.RESULTS_SQL}), k AS (SELECT match_no, match_date, home, away, hg, ag FROM m WHERE is_ko AND hg IS NOT NULL AND ag IS NOT NULL),
        b AS (SELECT home AS x, away AS y, hg AS gx, ag AS gy, match_date, match_no, 0 AS side FROM k UNION ALL SELECT away, home, ag, hg, match_date, match_no, 1 FROM k),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY match_date DESC, match_no DESC, side DESC) AS rn FROM b) WHERE rn = 1)
        SELECT m.match_no, l.gx AS ref_home, l.gy AS ref_away FROM m LEFT JOIN l ON m.home = l.x AND m.away = l.y""")
    def j07(spark, d):
        m = A.results(spark, d)
        k = m.where("is_ko and hg is not null and ag is not null").select(F.col("home").alias("x"), F.col("away").alias("y"), F.col("hg").alias("ref_home"), F.col("ag").alias("ref_away"), "match_date", F.col("match_no").alias("no"))
        look = R.mirrored(k, "x", "y", {"ref_home": "ref_away", "ref_away": "ref_home"}, [F.desc("match_date"), F.desc("no")])
        return m.join(look, (m["home"] == look["x"]) & (m["away"] == look["y"]), "left").select("match_no", "ref_home", "ref_away")

    @add("j08_lookup_with_default", """
        SELECT p.row_id, coalesce(t.confederation, 'NONE') AS confederation FROM players p LEFT JOIN teams t ON p.country_code = t.team_code""")
    def j08(spark, d):
        t = table(spark, d, "teams", ["team_code", "confederation"])
        p = table(spark, d, "players", ["row_id", "country_code"])
        return p.join(t, p["country_code"] == t["team_code"], "left").select("row_id", F.coalesce("confederation", F.lit("NONE")).alias("confederation"))

    @add("j09_n_way_outer_join", """
        WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2),
             b AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
             c AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
        SELECT user_id, day, a.v AS model, b.v AS market_a, c.v AS market_b FROM a FULL JOIN b USING (user_id, day) FULL JOIN c USING (user_id, day)""")
    def j09(spark, d):
        e = table(spark, d, "events", ["user_id", "ts", "event_type", "value"]).withColumn("day", F.to_date("ts"))
        part = lambda t: e.where(F.col("event_type") == t)
        return R.outer_by_tag({"model": part("click"), "market_a": part("view"), "market_b": part("purchase")}, ["user_id", "day"], "value")

    @add("j10_dotted_path", """
        SELECT o.o_orderkey, n.n_name AS nation, r.r_name AS region FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
        LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name LIKE '%A%'""")
    def j10(spark, d):
        return _model(spark, d).query("orders", where="customer.nation.region.r_name like '%A%'", select={"o_orderkey": "o_orderkey", "nation": "customer.nation.n_name", "region": "customer.nation.region.r_name"})

    @add("j11_one_pass_for_three_aggregates", """
        SELECT country_code, count(DISTINCT player_id) AS players, count(DISTINCT CASE WHEN is_active THEN player_id END) AS active,
               count(DISTINCT CASE WHEN espn_player_id IS NOT NULL THEN player_id END) AS with_id FROM players GROUP BY 1""")
    def j11(spark, d):
        p = table(spark, d, "players", ["country_code", "player_id", "is_active", "espn_player_id"])
        # one row a player first, so the three distinct counts need one shuffle
        one = p.groupBy("country_code", "player_id").agg(F.coalesce(F.bool_or("is_active"), F.lit(False)).alias("act"), F.max(F.col("espn_player_id").isNotNull()).alias("ext"))
        return one.groupBy("country_code").agg(F.count("player_id").alias("players"), F.count(F.when(F.col("act"), F.col("player_id"))).alias("active"), F.count(F.when(F.col("ext"), F.col("player_id"))).alias("with_id"))

    @add("j12_metrics_by_key", """
        SELECT a.tier, a.n, round(b.ko_share, 6) AS ko_share FROM (SELECT tier, count(*) AS n FROM match_results GROUP BY 1) a
        JOIN (SELECT tier, avg(CASE WHEN is_ko THEN 1.0 ELSE 0.0 END) AS ko_share FROM match_results GROUP BY 1) b USING (tier)""")
    def j12(spark, d):
        m = table(spark, d, "match_results", ["tier", "is_ko"]).where("tier is not null")
        return m.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("is_ko"), 1.0).otherwise(0.0)), 6).alias("ko_share"))

    @add("j13_join_by_renamed_key", """
        SELECT p.row_id, p.player_id, m.source_id FROM players p JOIN (SELECT understat_id AS source_id, min(player_id) AS pid FROM players WHERE understat_id IS NOT NULL GROUP BY 1) m ON m.pid = p.player_id""")
    def j13(spark, d):
        p = table(spark, d, "players", ["row_id", "player_id", "understat_id"])
        m = p.where("understat_id is not null").groupBy(F.col("understat_id").alias("source_id")).agg(F.min("player_id").alias("pid"))
        return p.join(m, p["player_id"] == m["pid"]).select("row_id", "player_id", "source_id")

    @add("j14_name_and_club", """
        SELECT DISTINCT m.roster_id, p.player_id FROM player_matches m JOIN (SELECT DISTINCT player_id, lower(normalized_name) AS n, lower(trim(current_club)) AS c FROM players WHERE normalized_name IS NOT NULL AND current_club IS NOT NULL) p
        ON lower(m.player_name) = p.n AND lower(trim(replace(m.team_title, 'R. ', 'Real '))) = p.c""")
    def j14(spark, d):
        p = table(spark, d, "players", ["player_id", "normalized_name", "current_club"]).where("normalized_name is not null and current_club is not null")
        p = p.select("player_id", F.lower("normalized_name").alias("n"), F.lower(F.trim("current_club")).alias("c")).distinct()
        m = table(spark, d, "player_matches", ["roster_id", "player_name", "team_title"])
        return m.join(p, (F.lower("player_name") == p["n"]) & (F.lower(F.trim(F.replace("team_title", F.lit("R. "), F.lit("Real ")))) == p["c"])).select("roster_id", "player_id").distinct()

    # ---- windows, sorts, limits ---------------------------------------------
    @add("w01_first_of_partition", "SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1")
    def w01(spark, d):
        li = table(spark, d, "lineitem", ["l_suppkey", "l_orderkey", "l_extendedprice", "l_linenumber", "l_partkey"])
        return R.keep_best(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_suppkey", "l_orderkey", "l_extendedprice")

    @add("w02_form_before_date", f"""
        WITH m AS ({A.DECIDED_SQL}), t AS (SELECT home AS team, match_date, match_no, CASE WHEN hg > ag THEN 1.0 WHEN hg = ag THEN 1.0 / 3 ELSE 0 END AS p FROM m
          UNION ALL SELECT away, match_date, match_no, CASE WHEN ag > hg THEN 1.0 WHEN hg = ag THEN 1.0 / 3 ELSE 0 END FROM m),
        refs AS (SELECT DISTINCT team, DATE '2022-11-20' AS ref FROM t),
        r AS (SELECT refs.team, refs.ref, t.p, row_number() OVER (PARTITION BY refs.team, refs.ref ORDER BY t.match_date DESC, t.match_no DESC) AS rn
              FROM refs LEFT JOIN t ON t.team = refs.team AND t.match_date < refs.ref)
        SELECT team, ref AS ref_day, round(coalesce(avg(p), 0.5), 6) AS form, CAST(count(p) AS BIGINT) AS n_used FROM r WHERE rn <= 10 GROUP BY 1, 2""")
    def w02(spark, d):
        from touchline.operators.models import team_points

        t = team_points(A.decided(spark, d))
        refs = t.select("team").distinct().withColumn("ref_day", F.lit("2022-11-20").cast("date"))
        out = R.last_n_before(refs, t, "team", "match_date", "ref_day", "points", 10, ["match_no"], 0.5, "form")
        return out.select("team", "ref_day", F.round("form", 6).alias("form"), F.col("n_used").cast("bigint").alias("n_used"))

    @add("w03_top_n_mean", "SELECT o_custkey, round(avg(o_totalprice), 4) AS best_mean, count(*) AS n_used FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5 GROUP BY 1")
    def w03(spark, d):
        return R.top_n_mean(table(spark, d, "orders", ["o_custkey", "o_totalprice", "o_orderkey"]), ["o_custkey"], "o_totalprice", ["o_orderkey"], 5, "best_mean").withColumn("best_mean", F.round("best_mean", 4))

    @add("w04_keep_best", """
        SELECT roster_id, player_name, team_title, minutes FROM (SELECT *, row_number() OVER (PARTITION BY roster_id ORDER BY TRY_CAST(minutes AS INTEGER) DESC NULLS LAST, loaded_at DESC, player_name NULLS LAST, team_title NULLS LAST) AS rn FROM player_matches WHERE roster_id IS NOT NULL) WHERE rn = 1""")
    def w04(spark, d):
        p = table(spark, d, "player_matches", ["roster_id", "player_name", "team_title", "minutes", "loaded_at"]).where("roster_id is not null")
        order = [F.desc_nulls_last(F.col("minutes").try_cast("int")), F.desc("loaded_at"), F.asc_nulls_last("player_name"), F.asc_nulls_last("team_title")]
        return R.keep_best(p, ["roster_id"], order).drop("loaded_at")

    @add("w05_global_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
    def w05(spark, d):
        return table(spark, d, "orders", ["o_orderkey", "o_totalprice"]).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)

    @add("w06_nulls_last", "SELECT row_id, birth_year FROM players ORDER BY birth_year DESC NULLS LAST, row_id")
    def w06(spark, d):
        return table(spark, d, "players", ["row_id", "birth_year"]).orderBy(F.desc_nulls_last("birth_year"), "row_id")

    @add("w07_bucket_order", """
        SELECT row_id, position, display_name FROM players ORDER BY CASE position WHEN 'GK' THEN 0 WHEN 'DF' THEN 1 WHEN 'MF' THEN 2 WHEN 'FW' THEN 3 ELSE 9 END, nation_name NULLS LAST, row_id""")
    def w07(spark, d):
        bucket = F.when(F.col("position") == "GK", 0).when(F.col("position") == "DF", 1).when(F.col("position") == "MF", 2).when(F.col("position") == "FW", 3).otherwise(9)
        p = table(spark, d, "players", ["row_id", "position", "display_name", "nation_name"])
        return p.orderBy(bucket, F.asc_nulls_last("nation_name"), "row_id").select("row_id", "position", "display_name")

    @add("w08_rank_from_one", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n DESC, n_nationkey) AS INTEGER) AS place FROM (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer GROUP BY 1)")
    def w08(spark, d):
        counts = table(spark, d, "customer", ["c_nationkey"]).groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
        return counts.select("n_nationkey", F.row_number().over(Window.orderBy(F.desc("n"), "n_nationkey")).alias("place"))

    @add("w09_best_thirds", """
        WITH g AS (SELECT n_regionkey, n_nationkey, n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, n_nationkey) AS rk FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c JOIN nation ON n_nationkey = c_nationkey)
        SELECT n_regionkey, n_nationkey, n FROM g WHERE rk = 3 ORDER BY n DESC, n_nationkey LIMIT 3""")
    def w09(spark, d):
        from touchline.operators.bracket import best_thirds

        n = table(spark, d, "nation", ["n_nationkey", "n_regionkey"])
        c = table(spark, d, "customer", ["c_nationkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))
        return best_thirds(c.join(n, c["c_nationkey"] == n["n_nationkey"]), "n_regionkey", "n", "n_nationkey", 3).select("n_regionkey", "n_nationkey", "n")

    @add("w10_spread_of_models", f"""
        WITH r AS ({A.RESULTS_SQL}) SELECT match_no, round(greatest(elo_h, elo_d, elo_a) - least(elo_h, elo_d, elo_a), 6) AS spread FROM r ORDER BY spread DESC, match_no LIMIT 15""")
    def w10(spark, d):
        r = A.results(spark, d)
        return r.select("match_no", F.round(F.greatest("elo_h", "elo_d", "elo_a") - F.least("elo_h", "elo_d", "elo_a"), 6).alias("spread")).orderBy(F.desc("spread"), "match_no").limit(15)

    @add("w11_largest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
    def w11(spark, d):
        return table(spark, d, "customer", ["c_custkey", "c_acctbal"]).orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)

    # ---- sets and reshapes ----------------------------------------------------
    @add("u01_union_all", f"SELECT player_id, source, round(metric, 4) AS metric, games FROM ({A.FACTS_SQL})")
    def u01(spark, d):
        return A.facts(spark, d).withColumn("metric", F.round("metric", 4))

    @add("u02_tagged_union", """
        SELECT 'players' AS src, count(*) AS n, count(DISTINCT player_id) AS ids FROM players WHERE espn_player_id IS NULL
        UNION ALL SELECT 'appearances', count(*), count(DISTINCT roster_id) FROM player_matches WHERE nation IS NULL""")
    def u02(spark, d):
        a = table(spark, d, "players", ["player_id", "espn_player_id"]).where("espn_player_id is null").agg(F.count("*").alias("n"), F.countDistinct("player_id").alias("ids"))
        b = table(spark, d, "player_matches", ["roster_id", "nation"]).where("nation is null").agg(F.count("*").alias("n"), F.countDistinct("roster_id").alias("ids"))
        return a.select(F.lit("players").alias("src"), "n", "ids").union(b.select(F.lit("appearances"), "n", "ids")).orderBy("src")

    @add("u03_unpivot", f"WITH r AS ({A.RATINGS_SQL}) SELECT n_nationkey, 'm1' AS model, m1 AS rating FROM r UNION ALL SELECT n_nationkey, 'm2', m2 FROM r UNION ALL SELECT n_nationkey, 'm3', m3 FROM r")
    def u03(spark, d):
        return R.unpivot(A.ratings(spark, d).drop("n_name"), ["n_nationkey"], ["m1", "m2", "m3"], "model", "rating")

    @add("u04_pivot", """
        SELECT user_id, round(max(CASE WHEN event_type = 'click' THEN value END), 3) AS click, round(max(CASE WHEN event_type = 'view' THEN value END), 3) AS view,
               round(max(CASE WHEN event_type = 'purchase' THEN value END), 3) AS purchase FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1""")
    def u04(spark, d):
        e = table(spark, d, "events", ["user_id", "event_type", "value"]).where("event_type in ('click', 'view', 'purchase')")
        return R.pivot(e, ["user_id"], "event_type", ["click", "view", "purchase"], F.round(F.max("value"), 3))

    @add("u05_key_set_union", "SELECT country_code AS code FROM players WHERE country_code IS NOT NULL UNION SELECT team_code FROM documents WHERE team_code IS NOT NULL")
    def u05(spark, d):
        a = table(spark, d, "players", ["country_code"]).where("country_code is not null").select(F.col("country_code").alias("code"))
        return a.union(table(spark, d, "documents", ["team_code"]).where("team_code is not null")).distinct()

    @add("u06_concat", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
    def u06(spark, d):
        a = table(spark, d, "customer", ["c_custkey", "c_name"]).toDF("id", "name")
        return a.unionByName(table(spark, d, "supplier", ["s_suppkey", "s_name"]).toDF("id", "name"))

    @add("u07_wide_to_outcomes", f"""
        WITH r AS ({A.RESULTS_SQL}) SELECT match_no, 'home' AS outcome, elo_h AS p FROM r UNION ALL SELECT match_no, 'draw', elo_d FROM r UNION ALL SELECT match_no, 'away', elo_a FROM r""")
    def u07(spark, d):
        return A.results(spark, d).select("match_no", F.expr("stack(3, 'home', elo_h, 'draw', elo_d, 'away', elo_a) as (outcome, p)"))

    @add("u08_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
    def u08(spark, d):
        return table(spark, d, "lineitem", ["l_partkey", "l_suppkey"]).distinct()


def _model(spark: SparkSession, d: str) -> Model:
    model = Model(spark)
    model.add("region", table(spark, d, "region"))
    model.add("nation", table(spark, d, "nation"), one={"region": ("region", {"n_regionkey": "r_regionkey"})})
    model.add("customer", table(spark, d, "customer"), one={"nation": ("nation", {"c_nationkey": "n_nationkey"})}, many={"orders": ("orders", {"c_custkey": "o_custkey"})})
    model.add("orders", table(spark, d, "orders"), one={"customer": ("customer", {"o_custkey": "c_custkey"})})
    return model
