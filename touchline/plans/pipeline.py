"""The warehouse, end to end: dims, resolved appearances, facts, checks.

``build`` gives every table as a lazy frame; ``publish`` writes them and
registers them as views, so that plain SQL runs on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.functions import text as TX
from touchline.functions.text import with_normalized
from touchline.operators import entity as E
from touchline.operators import quality as Q
from touchline.operators.relational import keep_best, unpivot
from touchline.operators.teams import codes_sql
from touchline.plans import adapters as A
from touchline.plans.registry import Registry
from touchline.session import cut
from touchline.sources.tables import table

TIERS = [("name_country", ["nn", "cc"]), ("name", ["nn"])]


def dim_player(spark: SparkSession, d: str) -> DataFrame:
    """One row a player: the last one loaded."""
    cols = ["player_id", "display_name", "normalized_name", "country_code", "current_club", "position", "birth_date", "is_active", "loaded_at", "row_id"]
    return keep_best(table(spark, d, "players", cols), ["player_id"], [F.desc("loaded_at"), F.desc("row_id")]).drop("loaded_at", "row_id")


def dim_team(spark: SparkSession, d: str) -> DataFrame:
    """Teams with the number of their players; squads of others have no status."""
    squads = table(spark, d, "players", ["country_code", "player_id"]).distinct().groupBy("country_code").agg(F.count("*").alias("squad_player_count"))
    t = table(spark, d, "teams")
    status = F.when(~F.col("is_wc2026_qualifier"), None).otherwise(F.when(F.col("squad_player_count").isNotNull(), "listed").otherwise("pending"))
    return t.join(squads, t["team_code"] == squads["country_code"], "left").drop("country_code").withColumn("squad_status", status)


def appearances(spark: SparkSession, d: str) -> DataFrame:
    """Appearances with the player that the tiers give them."""
    cols = ["roster_id", "player_name", "nation", "team_title", "season", "minutes", "goals", "xg", "shots", "loaded_at"]
    p = table(spark, d, "player_matches", cols).where("roster_id is not null")
    one = keep_best(p, ["roster_id"], [F.desc("loaded_at"), F.asc_nulls_last("player_name"), F.asc_nulls_last("team_title"), F.asc_nulls_last("xg")])
    rows = A.with_person_keys(one, d)
    players = with_normalized(dim_player(spark, d), "normalized_name", "nn").select("player_id", "nn", F.col("country_code").alias("cc"))
    return E.resolve_in_tiers(rows, players, "player_id", TIERS)


def fact_player_xg(staging: DataFrame) -> DataFrame:
    """Long: one row a player, source and period."""
    num = lambda c, t: F.sum(F.col(c).try_cast(t))
    season = staging.groupBy(F.col("match_id").alias("player_id"), F.lit("club").alias("source"), F.coalesce("season", F.lit("unknown")).alias("period_id"))
    agg = [num("minutes", "bigint").alias("minutes"), num("goals", "bigint").alias("goals"), num("shots", "bigint").alias("shots"), num("xg", "double").alias("xg_total")]
    by_season = season.agg(*agg)
    career = by_season.groupBy("player_id", F.lit("career").alias("source"), F.lit("career").alias("period_id")).agg(*[F.sum(c).alias(c) for c in ("minutes", "goals", "shots", "xg_total")])
    return by_season.unionByName(career)


def fact_team_rating(spark: SparkSession, d: str) -> DataFrame:
    """Long ratings of the listed teams, by the results of all their writings."""
    m = A.scored(spark, d)
    sides = F.explode(F.array(
        F.struct(F.col("home_code").alias("team_code"), F.col("hg").alias("f"), F.col("ag").alias("a"), "match_date"), F.struct(F.col("away_code").alias("team_code"), F.col("ag").alias("f"), F.col("hg").alias("a"), "match_date")
    )).alias("s")
    recent = F.col("match_date") >= F.lit("2022-01-01").cast("date")
    wide = m.select(sides).select("s.*").where("team_code is not null").groupBy("team_code").agg(F.avg("f").alias("attack"), F.avg("a").alias("defence"), F.avg(F.when(recent, F.col("f"))).alias("recent_form"))
    return unpivot(wide, ["team_code"], ["attack", "defence", "recent_form"], "rating_type", "rating_value")


def build(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    resolved = cut(appearances(spark, d))
    staging, quarantine = E.split_matches(resolved)
    return {
        "dim_player": dim_player(spark, d),
        "dim_team": dim_team(spark, d),
        "staging_appearances": staging,
        "quarantine_appearances": quarantine,
        "fact_player_xg": fact_player_xg(staging),
        "fact_team_rating": fact_team_rating(spark, d),
    }


def publish(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Write every table once and register it as a view."""
    out = {}
    for name, df in build(spark, d).items():
        out[name] = cut(df)
        out[name].createOrReplaceTempView(name)
    return out


CHECKS = [
    Q.Assertion("player ids are unique", "SELECT count(*) - count(DISTINCT player_id) FROM dim_player", 0, 0),
    Q.Assertion("team codes are unique", "SELECT count(*) - count(DISTINCT team_code) FROM dim_team", 0, 0),
    Q.Assertion("fact grain", "SELECT count(*) - count(DISTINCT player_id, source, period_id) FROM fact_player_xg", 0, 0),
    Q.Assertion("facts have players", "SELECT count(*) FROM fact_player_xg f LEFT ANTI JOIN dim_player p ON f.player_id = p.player_id", 0, 0),
    Q.Assertion("ratings have teams", "SELECT count(*) FROM fact_team_rating f LEFT ANTI JOIN dim_team t ON f.team_code = t.team_code", 0, 0),
    Q.Assertion("staging has no open rows", "SELECT count(*) FROM staging_appearances WHERE match_id IS NULL", 0, 0),
    Q.Assertion("half of the appearances match", "SELECT 100.0 * (SELECT count(*) FROM staging_appearances) / ((SELECT count(*) FROM staging_appearances) + (SELECT count(*) FROM quarantine_appearances))", 50, 100, "WARN"),
]

DIM_SQL = """SELECT player_id, display_name, normalized_name, country_code, current_club, is_active FROM
  (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY loaded_at DESC, row_id DESC) AS rn FROM players) WHERE rn = 1"""
STAGE_SQL = f"""
dp AS ({DIM_SQL}),
r0 AS (SELECT *, nullif({TX.normal_sql('player_name')}, '') AS nn FROM (SELECT *, row_number() OVER (PARTITION BY roster_id ORDER BY loaded_at DESC, player_name NULLS LAST, team_title NULLS LAST, xg NULLS LAST) AS rn FROM player_matches WHERE roster_id IS NOT NULL) WHERE rn = 1),
r AS (SELECT r0.*, c.code AS cc FROM r0 LEFT JOIN {codes_sql('SELECT nation AS typed FROM player_matches')} c ON c.typed = r0.nation),
k1 AS (SELECT {TX.normal_sql('normalized_name')} AS nn, country_code AS cc, count(DISTINCT player_id) AS n, min(player_id) AS id FROM dp WHERE normalized_name IS NOT NULL AND country_code IS NOT NULL GROUP BY 1, 2),
k2 AS (SELECT {TX.normal_sql('normalized_name')} AS nn, count(DISTINCT player_id) AS n, min(player_id) AS id FROM dp WHERE normalized_name IS NOT NULL GROUP BY 1),
st AS (SELECT r.*, CASE WHEN k1.n = 1 THEN k1.id WHEN k1.n > 1 THEN NULL WHEN k2.n = 1 THEN k2.id END AS match_id,
   CASE WHEN k1.n = 1 THEN 'unique' WHEN k1.n > 1 THEN 'ambiguous_name_country_' || k1.n WHEN k2.n = 1 THEN 'unique' WHEN k2.n > 1 THEN 'ambiguous_name_' || k2.n ELSE 'unmatched' END AS match_reason
   FROM r LEFT JOIN k1 ON r.nn = k1.nn AND r.cc = k1.cc LEFT JOIN k2 ON r.nn = k2.nn),
s1 AS (SELECT match_id AS player_id, coalesce(season, 'unknown') AS period_id, sum(TRY_CAST(minutes AS BIGINT)) AS minutes, sum(TRY_CAST(xg AS DOUBLE)) AS xg_total FROM st WHERE match_id IS NOT NULL GROUP BY 1, 2),
fx AS (SELECT player_id, 'club' AS source, period_id, minutes, xg_total FROM s1 UNION ALL SELECT player_id, 'career', 'career', sum(minutes), sum(xg_total) FROM s1 GROUP BY 1)"""
RATING_SQL = f"""
m AS ({A.SCORED_SQL}), sd AS (SELECT home_code AS t, hg AS f, ag AS a, match_date FROM m UNION ALL SELECT away_code, ag, hg, match_date FROM m),
w AS (SELECT t AS team_code, avg(f) AS attack, avg(a) AS defence, avg(CASE WHEN match_date >= DATE '2022-01-01' THEN f END) AS recent_form FROM sd WHERE t IS NOT NULL GROUP BY 1),
fr AS (SELECT * FROM w)"""


def register(registry: Registry) -> None:
    add = registry.add

    @add("q01_top_scorers_blended", f"""
        WITH {STAGE_SQL}
        SELECT p.player_id, p.display_name, p.country_code, count(DISTINCT f.source) AS sources, round(sum(CASE WHEN f.source = 'club' THEN f.xg_total ELSE 0 END), 6) AS xg_club,
               round(sum(f.xg_total), 6) AS xg_all, CAST(sum(f.minutes) AS BIGINT) AS minutes
        FROM fx f JOIN dp p ON f.player_id = p.player_id WHERE f.xg_total IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(f.xg_total) > 0 ORDER BY xg_all DESC, p.player_id LIMIT 20""")
    def q01(spark, d):
        publish(spark, d)
        return spark.sql("""
            SELECT p.player_id, p.display_name, p.country_code, count(DISTINCT f.source) AS sources, round(sum(CASE WHEN f.source = 'club' THEN f.xg_total ELSE 0 END), 6) AS xg_club,
                   round(sum(f.xg_total), 6) AS xg_all, sum(f.minutes) AS minutes
            FROM fact_player_xg f JOIN dim_player p ON f.player_id = p.player_id WHERE f.xg_total IS NOT NULL
            GROUP BY 1, 2, 3 HAVING sum(f.xg_total) > 0 ORDER BY xg_all DESC, p.player_id LIMIT 20""")

    @add("q02_squad_coverage_gaps", f"""
        WITH {STAGE_SQL} SELECT p.country_code, count(*) AS players_without, string_agg(p.player_id, ',' ORDER BY p.player_id) AS players
        FROM dp p WHERE p.is_active AND p.player_id NOT IN (SELECT player_id FROM fx) GROUP BY 1""")
    def q02(spark, d):
        t = build(spark, d)
        missing = t["dim_player"].where("is_active").join(t["fact_player_xg"], "player_id", "left_anti")
        return missing.groupBy("country_code").agg(F.count("*").alias("players_without"), F.array_join(F.array_sort(F.collect_list("player_id")), ",").alias("players"))

    @add("q03_attack_against_defence_of_teams", f"""
        WITH {RATING_SQL} SELECT t.team_code, t.confederation, round(fr.attack, 4) AS attack, round(fr.defence, 4) AS defence, round(fr.attack - fr.defence, 4) AS net
        FROM teams t JOIN fr USING (team_code) WHERE t.is_wc2026_qualifier AND fr.attack IS NOT NULL""")
    def q03(spark, d):
        ratings = fact_team_rating(spark, d)
        side = {k: F.max(F.when(F.col("rating_type") == k, F.col("rating_value"))) for k in ("attack", "defence")}
        wide = ratings.groupBy("team_code").agg(side["attack"].alias("a"), side["defence"].alias("b")).where("a is not null")
        t = table(spark, d, "teams", ["team_code", "confederation", "is_wc2026_qualifier"]).where("is_wc2026_qualifier")
        out = t.join(wide, "team_code").select("team_code", "confederation", F.round("a", 4).alias("attack"), F.round("b", 4).alias("defence"), F.round(F.col("a") - F.col("b"), 4).alias("net"))
        return out.orderBy(F.desc_nulls_last("net"), "team_code")

    @add("q04_rating_matrix", f"""
        WITH {RATING_SQL} SELECT t.team_code, round(fr.attack, 4) AS attack, round(fr.defence, 4) AS defence, round(fr.recent_form, 4) AS recent_form FROM teams t JOIN fr USING (team_code) WHERE t.is_wc2026_qualifier""")
    def q04(spark, d):
        from touchline.operators.relational import pivot

        t = table(spark, d, "teams", ["team_code", "is_wc2026_qualifier"]).where("is_wc2026_qualifier").select("team_code")
        rows = fact_team_rating(spark, d).join(t, "team_code", "left_semi")
        return pivot(rows, ["team_code"], "rating_type", ["attack", "defence", "recent_form"], F.round(F.max("rating_value"), 4)).orderBy(F.desc_nulls_last("recent_form"), "team_code")

    @add("q05_quarantine_report", f"WITH {STAGE_SQL} SELECT 'appearances' AS source, match_reason, count(*) AS n FROM st WHERE match_id IS NULL GROUP BY 2")
    def q05(spark, d):
        q = build(spark, d)["quarantine_appearances"]
        return q.groupBy(F.lit("appearances").alias("source"), "match_reason").agg(F.count("*").alias("n")).orderBy("source", F.desc("n"))

    @add("q06_warehouse_checks")
    def q06(spark, d):
        publish(spark, d)
        return Q.run_assertions(spark, CHECKS)
