"""Entity resolution, sources, sinks, data quality and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from touchline.functions import text as TX
from touchline.operators import entity as E
from touchline.operators import quality as Q
from touchline.operators.teams import codes_sql
from touchline.plans import adapters as A
from touchline.plans.registry import Registry
from touchline.session import cut, scratch_dir
from touchline.sources import files, html, sinks
from touchline.sources.tables import register as register_views
from touchline.sources.tables import table

#: The master as an entity list: the last row of each player.
MASTER_SQL = """SELECT player_id, normalized_name AS nn, country_code AS cc, lower(trim(current_club)) AS club, birth_year AS byr, understat_id AS uid
FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY loaded_at DESC, row_id DESC) AS rn FROM players) WHERE rn = 1"""


#: Rows of one page or roster, so that no page grows with the data.
ROSTER = 200


# what a page's reader gives of a field: white space of any kind trimmed, or also joined
_SPACE_SQL = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NAME_SQL = f"regexp_replace(regexp_replace(display_name, '^{_SPACE_SQL}+', ''), '{_SPACE_SQL}+$', '')"
CLUB_SQL = NAME_SQL.replace("display_name", "nullif(trim(current_club), '')")
CELL_SQL = "coalesce(trim(regexp_replace({0}, '" + _SPACE_SQL.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g')), '')"
ROW_SQL = "coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '')"


def _line() -> Column:
    """``Name (Club)`` of a player; without a name there is nothing to list."""
    club = F.when(F.trim("current_club") != "", F.concat(F.lit(" ("), html.listed(F.col("current_club")), F.lit(")")))
    return F.concat(html.listed(F.col("display_name")), F.coalesce(club, F.lit("")))


def master(spark: SparkSession, d: str) -> DataFrame:
    from touchline.operators.relational import keep_best

    p = table(spark, d, "players", ["player_id", "normalized_name", "country_code", "current_club", "birth_year", "understat_id", "loaded_at", "row_id"])
    last = keep_best(p, ["player_id"], [F.desc("loaded_at"), F.desc("row_id")])
    return last.select("player_id", F.col("normalized_name").alias("nn"), F.col("country_code").alias("cc"), F.lower(F.trim("current_club")).alias("club"), F.col("birth_year").alias("byr"), F.col("understat_id").alias("uid"))


def _folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def register(registry: Registry) -> None:
    _entities(registry.add)
    _sources(registry.add)
    _sinks(registry.add)
    _quality(registry.add)
    _streams(registry.add)


TIERS_SQL = f"""
        WITH m AS (SELECT * REPLACE ({TX.normal_sql('nn')} AS nn) FROM ({MASTER_SQL})), pc AS (SELECT p.*, nullif({TX.normal_sql('player_name')}, '') AS nn, c.code AS cc FROM player_matches p LEFT JOIN {codes_sql('SELECT nation AS typed FROM player_matches')} c ON c.typed = p.nation WHERE roster_id IS NOT NULL),
        r AS (SELECT roster_id, nn, cc, lower(trim(team_title)) AS club FROM (SELECT *, row_number() OVER (PARTITION BY roster_id ORDER BY loaded_at DESC, player_name NULLS LAST, team_title NULLS LAST, nation NULLS LAST) AS rn FROM pc) WHERE rn = 1),
        k1 AS (SELECT nn, cc, count(DISTINCT player_id) AS n, min(player_id) AS id FROM m WHERE nn IS NOT NULL AND cc IS NOT NULL GROUP BY 1, 2),
        k2 AS (SELECT nn, club, count(DISTINCT player_id) AS n, min(player_id) AS id FROM m WHERE nn IS NOT NULL AND club IS NOT NULL GROUP BY 1, 2),
        k3 AS (SELECT nn, count(DISTINCT player_id) AS n, min(player_id) AS id FROM m WHERE nn IS NOT NULL GROUP BY 1)
        SELECT r.roster_id, CASE WHEN k1.n = 1 THEN k1.id WHEN k1.n > 1 THEN NULL WHEN k2.n = 1 THEN k2.id WHEN k2.n > 1 THEN NULL WHEN k3.n = 1 THEN k3.id END AS match_id,
          CASE WHEN k1.n = 1 THEN 'name_country' WHEN k1.n > 1 THEN NULL WHEN k2.n = 1 THEN 'name_club' WHEN k2.n > 1 THEN NULL WHEN k3.n = 1 THEN 'name' END AS match_tier,
          CASE WHEN k1.n = 1 THEN 'unique' WHEN k1.n > 1 THEN 'ambiguous_name_country_' || k1.n WHEN k2.n = 1 THEN 'unique' WHEN k2.n > 1 THEN 'ambiguous_name_club_' || k2.n WHEN k3.n = 1 THEN 'unique' WHEN k3.n > 1 THEN 'ambiguous_name_' || k3.n ELSE 'unmatched' END AS match_reason
        FROM r LEFT JOIN k1 ON r.nn = k1.nn AND r.cc = k1.cc LEFT JOIN k2 ON r.nn = k2.nn AND r.club = k2.club LEFT JOIN k3 ON r.nn = k3.nn"""


def _entities(add) -> None:
    @add("e01_normalized_name", f"SELECT row_id, {TX.normal_sql('display_name')} AS nn FROM players")
    def e01(spark, d):
        p = table(spark, d, "players", ["row_id", "display_name"])
        return TX.with_normalized(p, "display_name", "nn").select("row_id", "nn")

    @add("e02_country_code", """
        SELECT row_id, CASE WHEN regexp_full_match(trim(nation_name), '[A-Z]{3}') THEN trim(nation_name) WHEN upper(trim(nation_name)) = 'AK' THEN 'AKA' WHEN lower(trim(nation_name)) = 'molneland' THEN 'MNE'
               WHEN lower(trim(nation_name)) = 'istalimar' THEN 'ITR' END AS code FROM players""")
    def e02(spark, d):
        p = table(spark, d, "players", ["row_id", "nation_name"])
        return p.select("row_id", TX.country_code(F.col("nation_name"), {"Molneland": "MNE", "Istalimar": "ITR"}, {"AK": "AKA"}).alias("code"))

    @add("e03_birth_year", "SELECT row_id, CASE WHEN TRY_CAST(substr(CAST(birth_date AS VARCHAR), 1, 4) AS INTEGER) BETWEEN 1900 AND 2030 THEN TRY_CAST(substr(CAST(birth_date AS VARCHAR), 1, 4) AS INTEGER) END AS y FROM players")
    def e03(spark, d):
        from touchline.functions.scalars import birth_year

        return table(spark, d, "players", ["row_id", "birth_date"]).select("row_id", birth_year(F.col("birth_date").cast("string")).alias("y"))

    @add("e04_tier_cascade", TIERS_SQL)
    def e04(spark, d):
        return _tiers(spark, d).select("roster_id", "match_id", "match_tier", "match_reason")

    @add("e04_fuzzy_tier")
    def e04b(spark, d):
        players = TX.with_normalized(master(spark, d), "nn", "nn")
        out = E.resolve_fuzzy(cut(_tiers(spark, d)), players, "player_id", "nn", ["cc", "club"])
        return out.select("roster_id", "match_id", "match_tier", "match_reason")

    @add("e05_ambiguity_report", f"SELECT match_reason, count(*) AS n FROM ({TIERS_SQL}) GROUP BY 1")
    def e05(spark, d):
        return _tiers(spark, d).groupBy("match_reason").agg(F.count("*").alias("n"))

    @add("e06_fuzzy_in_country")
    def e06(spark, d):
        p = table(spark, d, "players", ["player_id", "country_code", "normalized_name", "understat_name"])
        left = TX.with_normalized(p.select("country_code", "understat_name").where("understat_name is not null").distinct(), "understat_name", "a")
        right = p.select("player_id", "country_code", F.col("normalized_name").alias("b")).where("b is not null").distinct()
        return E.fuzzy_within(left, right, "country_code", "a", "b", "understat_name", "player_id")

    @add("e07_best_sorted_ratio")
    def e07(spark, d):
        teams = TX.with_normalized(table(spark, d, "teams", ["team_code", "team_name"]), "team_name", "b").withColumn("all", F.lit(1))
        names = table(spark, d, "players", ["nation_name"]).where("nation_name is not null").distinct()
        left = TX.with_normalized(names, "nation_name", "a").withColumn("all", F.lit(1))
        return E.fuzzy_within(left, teams, "all", "a", "b", "nation_name", "team_code", 70.0, 1, "sort")

    @add("e08_first_and_last_word", f"SELECT row_id, {TX.simple_sql('display_name')} AS short FROM players")
    def e08(spark, d):
        p = table(spark, d, "players", ["row_id", "display_name"])
        return TX.with_simplified(p, "display_name", "short").select("row_id", "short")

    @add("e09_search_score", f"""
        WITH q AS (SELECT player_id, min(understat_name) AS query FROM players GROUP BY 1),
        r AS (SELECT q.query, p.player_id, row_number() OVER (PARTITION BY p.player_id ORDER BY row_id) AS place, display_name AS name, row_id % 7 * 90000.0 AS fans, position = 'GK' AS national FROM players p JOIN q USING (player_id) WHERE q.query IS NOT NULL),
        b AS (SELECT *, {TX.bare_sql('query')} AS q, {TX.bare_sql('name')} AS n FROM r WHERE place <= 5 AND NOT coalesce(national, false) AND name IS NOT NULL),
        s AS (SELECT *, CASE WHEN contains(n, q) OR contains(q, n) THEN 10.0 WHEN len(list_filter(string_split_regex(q, '\\s+'), lambda w: length(w) > 2 AND contains(n, w))) > 0 THEN 5.0 ELSE 0.0 END + least(fans / 1e5, 5.0) AS score FROM b)
        SELECT query, player_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY query || player_id ORDER BY score DESC, place) AS rn FROM s WHERE score > 0) WHERE rn = 1""")
    def e09(spark, d):
        p = table(spark, d, "players", ["row_id", "player_id", "understat_name", "display_name", "position"])
        q = p.groupBy("player_id").agg(F.min("understat_name").alias("query")).where("query is not null")
        place = F.row_number().over(Window.partitionBy("player_id").orderBy("row_id"))
        found = p.join(q, "player_id").select(F.struct("query", "player_id").alias("asked"), "query", "player_id", place.alias("place"), F.col("display_name").alias("name"), (F.col("row_id") % 7 * 90000.0).alias("fans"), (F.col("position") == "GK").alias("national"))
        best = E.best_results(found, "query", "place", "name", "fans", "national", key="asked")
        return best.select("query", "player_id", "name", "score")

    @add("e10_key_index", f"WITH m AS ({MASTER_SQL}) SELECT nn, cc, count(DISTINCT player_id) AS n, min(player_id) AS id FROM m WHERE nn IS NOT NULL AND cc IS NOT NULL GROUP BY 1, 2")
    def e10(spark, d):
        return E.key_counts(master(spark, d), ["nn", "cc"], "player_id").withColumnsRenamed({"_n": "n", "_id": "id"})

    @add("e11_surrogate_keys", "SELECT supplier_name, 'P' || lpad(CAST(100 + row_number() OVER (ORDER BY supplier_name, s_suppkey) AS VARCHAR), 6, '0') AS player_id FROM (SELECT s_name AS supplier_name, s_suppkey FROM supplier)")
    def e11(spark, d):
        s = table(spark, d, "supplier", ["s_name", "s_suppkey"]).withColumnRenamed("s_name", "supplier_name")
        return E.assign_ids(s, [F.asc("supplier_name"), F.asc("s_suppkey")], 100).select("supplier_name", "player_id")

    @add("e12_master_refresh")
    def e12(spark, d):
        m = TX.with_normalized(master(spark, d).select("player_id", "nn", "cc", "club"), "nn", "nn")
        rows = A.with_person_keys(table(spark, d, "player_matches", ["player_name", "nation", "team_title"]), d).withColumn("club", F.lower(F.trim("team_title")))
        one = rows.where("nn is not null").groupBy("nn", "cc").agg(F.max("club").alias("club"))
        return E.refresh_master(m, one, "player_id", [("name_country", ["nn", "cc"])], ["club"], [F.asc("nn"), F.asc_nulls_last("cc")], similar=("nn", "cc"))

    @add("e13_birth_tolerant", f"""
        WITH m AS ({MASTER_SQL}), r AS (SELECT DISTINCT nn, cc, byr FROM m WHERE nn IS NOT NULL AND cc IS NOT NULL)
        SELECT r.nn, r.cc, r.byr, arg_min(m.player_id, (CASE WHEN m.byr = r.byr THEN '0' ELSE '1' END) || m.player_id) AS match_id
        FROM r JOIN m ON r.nn = m.nn AND r.cc = m.cc AND (m.byr IS NULL OR r.byr IS NULL OR m.byr = r.byr) GROUP BY 1, 2, 3""")
    def e13(spark, d):
        m = master(spark, d).where("nn is not null and cc is not null")
        return E.birth_tolerant(m.select("nn", "cc", "byr").distinct(), m, ["nn", "cc"], "byr", "player_id")

    @add("e14_field_updates", f"""
        WITH m AS ({MASTER_SQL}), u AS (SELECT player_id, max(nullif(trim(espn_player_id), '')) AS club FROM players GROUP BY 1)
        SELECT m.player_id, coalesce(u.club, m.club) AS club, m.uid FROM m LEFT JOIN u USING (player_id)""")
    def e14(spark, d):
        m = master(spark, d).select("player_id", "club", "uid")
        u = table(spark, d, "players", ["player_id", "espn_player_id"]).groupBy("player_id").agg(F.max(F.when(F.trim("espn_player_id") != "", F.trim("espn_player_id"))).alias("club"))
        return E.fill_fields(m, u, "player_id", ["club"])

    @add("e15_inactive_sweep", f"""
        WITH m AS (SELECT player_id, cc, true AS act FROM ({MASTER_SQL})), t AS (SELECT DISTINCT player_id FROM players WHERE espn_player_id IS NOT NULL), c AS (SELECT DISTINCT m.cc FROM m JOIN t USING (player_id))
        SELECT m.player_id, m.cc, CASE WHEN m.cc IN (SELECT cc FROM c WHERE cc IS NOT NULL) AND m.player_id NOT IN (SELECT player_id FROM t) THEN false ELSE act END AS act FROM m""")
    def e15(spark, d):
        m = master(spark, d).select("player_id", "cc", F.lit(True).alias("act"))
        t = table(spark, d, "players", ["player_id", "espn_player_id"]).where("espn_player_id is not null").select("player_id").distinct()
        return E.sweep_inactive(m, t, t.limit(0), "player_id", "cc", "act")

    @add("e16_name_collisions", f"WITH m AS ({MASTER_SQL}) SELECT cc, nn, string_agg(player_id, ',' ORDER BY player_id) AS ids FROM m GROUP BY 1, 2 HAVING count(DISTINCT player_id) > 1")
    def e16(spark, d):
        return E.collisions(master(spark, d), ["cc", "nn"], "player_id").select("cc", "nn", F.array_join("ids", ",").alias("ids"))

    @add("e17_nested_roster_rows", "SELECT country_code AS nation, player_id, display_name AS name FROM players WHERE country_code IS NOT NULL")
    def e17(spark, d):
        p = table(spark, d, "players", ["row_id", "country_code", "player_id", "display_name"]).where("country_code is not null")
        # rosters of a bounded size, however large a nation is
        nested = p.groupBy("country_code", F.floor(F.col("row_id") / ROSTER)).agg(F.to_json(F.collect_list(F.struct("player_id", F.col("display_name").alias("name")))).alias("players"))
        rows = nested.select(F.col("country_code").alias("nation"), F.explode(F.from_json("players", "array<struct<player_id:string,name:string>>")).alias("p"))
        return rows.select("nation", "p.*")

    @add("e18_names_of_all_sources", """
        SELECT name, CASE WHEN regexp_full_match(trim(name), '[A-Z]{3}') THEN trim(name) END AS code FROM (SELECT nation AS name FROM player_matches UNION SELECT nation_name FROM players UNION SELECT outcome FROM polymarket_snapshot) WHERE name IS NOT NULL""")
    def e18(spark, d):
        sources = [(table(spark, d, "player_matches", ["nation"]), "nation"), (table(spark, d, "players", ["nation_name"]), "nation_name"), (table(spark, d, "polymarket_snapshot", ["outcome"]), "outcome")]
        return E.name_resolution(sources, lambda c: TX.country_code(c, {}, {}))

    @add("e19_first_name_of_each_code", "SELECT team_code, min(alias) AS name, count(*) AS n FROM team_aliases GROUP BY 1")
    def e19(spark, d):
        return table(spark, d, "team_aliases").groupBy("team_code").agg(F.min("alias").alias("name"), F.count("*").alias("n"))

    @add("e20_model_type", """
        WITH m AS (SELECT coalesce(source, 'wc2026-sim') AS model FROM documents UNION ALL SELECT r_name || '-baseline' FROM region UNION ALL SELECT 'ensemble-' || n_name FROM nation UNION ALL SELECT 'compound-' || n_name FROM nation UNION ALL SELECT 'manual-tier-list' FROM region)
        SELECT model, CASE WHEN model LIKE '%baseline%' THEN 'baseline' WHEN model LIKE '%ensemble%' OR model LIKE '%compound%' THEN 'compound' WHEN model = 'manual-tier-list' THEN 'human' WHEN model = 'wc2026-sim' THEN 'simulation' ELSE 'single-source' END AS kind, count(*) AS n FROM m GROUP BY 1, 2""")
    def e20(spark, d):
        region, nation = table(spark, d, "region", ["r_name"]), table(spark, d, "nation", ["n_name"])
        named = [table(spark, d, "documents", ["source"]).select(F.coalesce("source", F.lit("wc2026-sim"))), region.select(F.concat("r_name", F.lit("-baseline"))), nation.select(F.concat(F.lit("ensemble-"), "n_name")), nation.select(F.concat(F.lit("compound-"), "n_name")), region.select(F.lit("manual-tier-list"))]
        models = reduce(DataFrame.union, named).toDF("model")
        return models.groupBy("model", E.model_type(F.col("model")).alias("kind")).agg(F.count("*").alias("n"))

    @add("e21_player_lists", f"SELECT nation_name AS nation, {NAME_SQL} AS name, {CLUB_SQL} AS club FROM players WHERE {NAME_SQL} <> ''")
    def e21(spark, d):
        p = table(spark, d, "players", ["row_id", "display_name", "nation_name", "current_club"])
        lists = p.groupBy("nation_name", F.floor(F.col("row_id") / ROSTER)).agg(F.array_join(F.collect_list(_line()), ", ").alias("text"))
        return html.list_scan(lists, "nation_name", "text").select(F.col("nation_name").alias("nation"), "name", "club")

    @add("e22_dedupe_in_team", """
        SELECT country_code, key, row_id FROM (SELECT country_code, coalesce(espn_player_id, lower(display_name)) AS key, row_id, row_number() OVER (PARTITION BY country_code, coalesce(espn_player_id, lower(display_name)) ORDER BY row_id) AS rn FROM players) WHERE rn = 1""")
    def e22(spark, d):
        from touchline.operators.relational import keep_best

        p = table(spark, d, "players", ["country_code", "espn_player_id", "display_name", "row_id"]).select("country_code", F.coalesce("espn_player_id", F.lower("display_name")).alias("key"), "row_id")
        return keep_best(p, ["country_code", "key"], [F.asc("row_id")])

    @add("e23_alias_overrides", "SELECT s.snap_id, coalesce(a.team_code, s.outcome) AS outcome FROM polymarket_snapshot s LEFT JOIN (SELECT lower(trim(alias)) AS k, min(team_code) AS team_code FROM team_aliases GROUP BY 1) a ON lower(trim(s.outcome)) = a.k")
    def e23(spark, d):
        return E.apply_overrides(table(spark, d, "polymarket_snapshot", ["snap_id", "outcome"]), table(spark, d, "team_aliases"), "alias", "team_code", "outcome")


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    from touchline.operators.relational import keep_best

    p = table(spark, d, "player_matches", ["roster_id", "player_name", "nation", "team_title", "loaded_at"]).where("roster_id is not null")
    one = keep_best(p, ["roster_id"], [F.desc("loaded_at"), F.asc_nulls_last("player_name"), F.asc_nulls_last("team_title"), F.asc_nulls_last("nation")])
    rows = A.with_person_keys(one, d).select("roster_id", "nn", "cc", F.lower(F.trim("team_title")).alias("club"))
    return E.resolve_in_tiers(rows, TX.with_normalized(master(spark, d), "nn", "nn"), "player_id", [("name_country", ["nn", "cc"]), ("name_club", ["nn", "club"]), ("name", ["nn"])])


def _sources(add) -> None:
    @add("s01_parquet_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
    def s01(spark, d):
        if files.load_all(spark, d, ["nation", "region"]) < 0:
            raise FileNotFoundError(d)
        return spark.sql("SELECT n_nationkey, n_name, n_regionkey FROM nation")

    @add("s02_typed_csv", "SELECT team_code, team_name, iso2_code, is_wc2026_qualifier FROM teams")
    def s02(spark, d):
        out = _folder(spark)
        table(spark, d, "teams", ["team_code", "team_name", "iso2_code", "is_wc2026_qualifier"]).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
        return files.typed_csv(spark, out, "team_code string, team_name string, iso2_code string, is_wc2026_qualifier boolean")

    @add("s03_results_csv", f"SELECT match_date AS date, home AS home_team, away AS away_team, hg AS home_score, ag AS away_score, CAST('x' AS VARCHAR) AS tournament, false AS neutral FROM ({A.RESULTS_SQL}) WHERE hg IS NOT NULL AND ag IS NOT NULL AND match_no % 5 <> 0")
    def s03(spark, d):
        out = _folder(spark)
        r = A.results(spark, d)
        score = lambda c: F.when(F.col("match_no") % 5 == 0, "NA").otherwise(F.col(c).cast("string"))
        r.select(F.col("match_date").cast("string").alias("date"), F.col("home").alias("home_team"), F.col("away").alias("away_team"), score("hg").alias("home_score"), score("ag").alias("away_score"), F.lit("x").alias("tournament"), F.lit("FALSE").alias("neutral")).write.option("header", True).csv(out)
        return files.results_csv(spark, out)

    @add("s04_text_by_position", "SELECT team_code AS code, CAST(1500 + length(team_name) AS BIGINT) AS rating FROM teams WHERE length(team_name) % 3 <> 0")
    def s04(spark, d):
        out = _folder(spark)
        t = table(spark, d, "teams", ["team_code", "team_name"])
        rating = F.when(F.length("team_name") % 3 == 0, "n/a").otherwise((1500 + F.length("team_name")).cast("string"))
        t.select(F.concat_ws("\t", F.lit("1"), F.lit("x"), "team_code", rating)).write.text(out)
        return files.by_position(spark, out, {"code": 2, "rating": 3}, ["rating"])

    @add("s05_event_json", "SELECT event_id, user_id, event_type, value FROM events")
    def s05(spark, d):
        out = _folder(spark)
        e = table(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
        # one array a line of bounded size, as one match has one array
        arrays = e.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("k")).agg(F.to_json(F.collect_list(F.struct("event_id", "user_id", "event_type", "value"))).alias("v"))
        arrays.select("v").write.text(out)
        return spark.read.text(out).select(F.explode(F.from_json("value", "array<struct<event_id:bigint,user_id:bigint,event_type:string,value:double>>")).alias("e")).select("e.*")

    @add("s06_nested_scan", """
        SELECT DISTINCT pull_id, json_extract_string(m, '$.ticker') AS ticker FROM (SELECT pull_id, unnest(CAST(json_extract(payload, '$.markets') AS JSON[])) AS m FROM kxfifaadvance_markets WHERE json_valid(payload) AND json_type(payload, '$.markets') = 'ARRAY')""")
    def s06(spark, d):
        k = files.nested_markets(table(spark, d, "kxfifaadvance_markets", ["pull_id", "payload"]), "payload", "markets array<struct<ticker:string>>")
        return k.select("pull_id", "market.ticker").distinct()

    @add("s07_first_seen_of_many_files", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
    def s07(spark, d):
        e = table(spark, d, "events", ["user_id", "event_type", "event_id", "ts"])
        return files.first_seen(e, ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")

    @add("s08_existing_league_files", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
    def s08(spark, d):
        out = _folder(spark)
        table(spark, d, "customer", ["c_custkey", "c_mktsegment"]).withColumn("part", F.col("c_mktsegment")).write.partitionBy("part").parquet(out)
        df, _ = files.existing_union(spark, [f"{out}/part=BUILDING", f"{out}/part=NONE", f"{out}/part=MACHINERY"], lambda p: spark.read.parquet(p))
        return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"))

    @add("s09_latest_snapshot", "SELECT snap_id, as_of_date FROM polymarket_snapshot WHERE as_of_date = (SELECT max(as_of_date) FROM polymarket_snapshot)")
    def s09(spark, d):
        return files.latest_rows(table(spark, d, "polymarket_snapshot", ["snap_id", "as_of_date"]), "as_of_date")

    @add("s10_first_source_with_rows", "SELECT s_suppkey, s_name FROM supplier")
    def s10(spark, d):
        s = table(spark, d, "supplier", ["s_suppkey", "s_name"])
        return files.first_non_empty([lambda: None, lambda: s.where("s_suppkey < 0"), lambda: s])

    @add("s11_roster_pages")
    def s11(spark, d):
        return html.roster_scan(_pages(spark, d, "roster")).select("nation", "position_bucket", "name", "club")

    @add("s12_wiki_tables", f"SELECT {CELL_SQL.format('display_name')} AS player_name, {CELL_SQL.format('current_club')} AS club_team FROM players")
    def s12(spark, d):
        return html.table_scan(_pages(spark, d, "wiki"), ["player_name", "club_team"])

    @add("s13_rows_by_pattern", f"SELECT position, {ROW_SQL.format('display_name')} AS name, {ROW_SQL.format('current_club')} AS club FROM players WHERE position IN ('GK', 'DF', 'MF', 'FW')")
    def s13(spark, d):
        return html.row_scan(_pages(spark, d, "rows"))

    @add("s14_model_cards", "SELECT 'name' AS key, r_name AS value FROM region UNION ALL SELECT 'id', CAST(r_regionkey AS VARCHAR) FROM region")
    def s14(spark, d):
        out = _folder(spark)
        r = table(spark, d, "region")
        r.select(F.concat(F.lit("# Card\n\n| Field | Value |\n|---|---|\n| **Name** | "), "r_name", F.lit(" |\n| **Id** | "), F.col("r_regionkey").cast("string"), F.lit(" |\n"))).write.text(out)
        return files.model_cards(spark, out).select("key", "value")

    @add("s15_prediction_files", "SELECT r_name AS model, '2026-04-28' AS day FROM region")
    def s15(spark, d):
        out = _folder(spark)
        table(spark, d, "region").withColumn("m", F.col("r_name")).select("r_regionkey", "m").write.partitionBy("m").csv(out)
        found = [p.rsplit("m=", 1)[-1] for p in files.glob(spark, f"{out}/m=*")]
        return spark.createDataFrame([(m.replace("%20", " "), "2026-04-28") for m in found], "model string, day string")

    @add("s18_fresh_files")
    def s18(spark, d):
        import datetime as dt

        out = _folder(spark)
        table(spark, d, "region").write.csv(out)
        return files.fresh_files(spark, out, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).select(F.lit("region").alias("name"), F.col("age_days") < 1)

    @add("s19_table_inspection", "SELECT 'nation' AS tbl, count(*) AS n, CAST(3 AS BIGINT) AS cols FROM nation UNION ALL SELECT 'region', count(*), CAST(2 AS BIGINT) FROM region")
    def s19(spark, d):
        rows = []
        for name in ("nation", "region"):
            seen = files.inspect(table(spark, d, name))
            rows.append((name, seen["rows"], len(seen["columns"])))
        return spark.createDataFrame(rows, "tbl string, n bigint, cols bigint")


def _pages(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Roster pages of the nations, of a bounded size, written from all players.

    What a page has no place for its reader can't give: rosters need a nation, a
    position and a name, rows by pattern a position.
    """
    p = table(spark, d, "players", ["row_id", "display_name", "nation_name", "current_club", "position"])
    cell = lambda c: F.coalesce(html.escaped(F.col(c)), F.lit(""))
    page = F.floor(F.col("row_id") / ROSTER)
    if kind == "roster":
        names = {"GK": "Goalkeepers", "DF": "Defenders", "MF": "Midfielders", "FW": "Forwards"}
        label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("position")]
        line = F.concat(F.lit("<p><strong>"), label, F.lit(":</strong> "), html.escaped(_line()), F.lit("</p>"))
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", line.alias("h")))), lambda x: x["h"]), "\n")
        return p.groupBy("nation_name", page).agg(body.alias("b")).select(F.concat(F.lit("<h2>Group A</h2><h3>"), html.escaped(F.col("nation_name")), F.lit("</h3>"), "b").alias("html"))
    if kind == "wiki":
        line = F.concat(F.lit("<tr><td>"), cell("display_name"), F.lit("</td><td>"), cell("current_club"), F.lit("</td></tr>"))
        return p.groupBy("nation_name", page).agg(F.array_join(F.collect_list(line), "").alias("b")).select(F.concat(F.lit('<table class="wikitable sortable"><tr><th>Player name</th><th>Club/Team</th></tr>'), "b", F.lit("</table>")).alias("html"))
    line = F.concat(F.lit("<tr class=x><td>"), cell("position"), F.lit("</td><td><a href='#'>"), cell("display_name"), F.lit("</a></td>\n<td>"), cell("current_club"), F.lit("</td></tr>"))
    return p.groupBy("nation_name", page).agg(F.array_join(F.collect_list(line), "\n").alias("html"))


def _sinks(add) -> None:
    @add("k01_replace_table", "SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
    def k01(spark, d):
        return cut(table(spark, d, "supplier", ["s_nationkey"]).groupBy("s_nationkey").agg(F.count("*").alias("n")))

    @add("k02_staging_and_quarantine", f"SELECT 'staging' AS part, count(match_id) AS n FROM ({TIERS_SQL}) UNION ALL SELECT 'quarantine', count(*) - count(match_id) FROM ({TIERS_SQL})")
    def k02(spark, d):
        out = _folder(spark)
        resolved = cut(_tiers(spark, d))
        sinks.write_split(*E.split_matches(resolved), out, "appearances")
        good = spark.read.parquet(f"{out}/staging/matched_appearances").agg(F.count("*").alias("n"))
        bad = spark.read.parquet(f"{out}/quarantine/unmatched_appearances").agg(F.count("*").alias("n"))
        return good.select(F.lit("staging").alias("part"), "n").union(bad.select(F.lit("quarantine"), "n"))

    @add("k03_parquet_write", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
    def k03(spark, d):
        out = _folder(spark)
        sinks.write_parquet(table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]), out, ["o_orderstatus"])
        return spark.read.parquet(out).groupBy("o_orderstatus").agg(F.count("*").alias("n"))

    @add("k04_ordered_csv", "SELECT p_partkey, p_name, p_size FROM part")
    def k04(spark, d):
        out = _folder(spark)
        sinks.write_csv(table(spark, d, "part", ["p_partkey", "p_name", "p_size"]), out, [F.asc("p_partkey")])
        return files.typed_csv(spark, out, "p_partkey bigint, p_name string, p_size int")

    @add("k05_report", "SELECT n_nationkey, n_name FROM nation")
    def k05(spark, d):
        out = _folder(spark)
        sinks.write_report(table(spark, d, "nation", ["n_nationkey", "n_name"]), out, "nations", [F.asc("n_nationkey")])
        return spark.read.schema("n_nationkey int, n_name string").json(f"{out}/nations.json")

    @add("k06_write_back", f"""
        WITH u AS (SELECT match_id AS player_id, min(roster_id) AS uid FROM ({TIERS_SQL}) WHERE match_id IS NOT NULL GROUP BY 1)
        SELECT mm.player_id, mm.nn, coalesce(u.uid, mm.uid) AS uid, CASE WHEN coalesce(u.uid, mm.uid) IS DISTINCT FROM mm.uid THEN DATE '2026-06-11' ELSE DATE '2026-01-01' END AS last_updated_at
        FROM ({MASTER_SQL}) mm LEFT JOIN u USING (player_id)""")
    def k06(spark, d):
        m = master(spark, d).select("player_id", "nn", "uid", F.lit("2026-01-01").cast("date").alias("last_updated_at"))
        found = _tiers(spark, d).where("match_id is not null").select(F.col("match_id").alias("player_id"), "roster_id")
        return sinks.write_back(m, found, "player_id", {"roster_id": "uid"}, "2026-06-11", "last_updated_at", _folder(spark))


def _quality(add) -> None:
    @add("d01_assertions", """
        SELECT 'one region key' AS name, 0.0 AS value, 'PASS' AS status UNION ALL SELECT 'nations without region', 0.0, 'PASS' UNION ALL SELECT 'orders without customer', 0.0, 'PASS'
        UNION ALL SELECT 'players have an id', CAST((SELECT count(*) FROM players WHERE player_id IS NULL) AS DOUBLE), 'PASS'""")
    def d01(spark, d):
        register_views(spark, d, ["region", "nation", "orders", "customer", "players"])
        return Q.run_assertions(spark, [
            Q.Assertion("one region key", "SELECT count(*) - count(DISTINCT r_regionkey) FROM region", 0, 0),
            Q.Assertion("nations without region", "SELECT count(*) FROM nation LEFT ANTI JOIN region ON n_regionkey = r_regionkey", 0, 0),
            Q.Assertion("orders without customer", "SELECT count(*) FROM orders LEFT ANTI JOIN customer ON o_custkey = c_custkey", 0, 0),
            Q.Assertion("players have an id", "SELECT count(*) FROM players WHERE player_id IS NULL", 0, 0, "WARN"),
        ])

    @add("d02_row_rules", """
        SELECT snap_id, 'price' AS issue FROM polymarket_snapshot WHERE NOT coalesce(yes_price BETWEEN 0 AND 1, false) UNION ALL SELECT snap_id, 'outcome' FROM polymarket_snapshot WHERE NOT coalesce(length(trim(outcome)) > 0, false)
        UNION ALL SELECT snap_id, 'day' FROM polymarket_snapshot WHERE NOT coalesce(regexp_full_match(as_of_date, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), false)""")
    def d02(spark, d):
        s = table(spark, d, "polymarket_snapshot", ["snap_id", "yes_price", "outcome", "as_of_date"])
        return Q.row_issues(s, "snap_id", {"price": F.col("yes_price").between(0, 1), "outcome": F.length(F.trim("outcome")) > 0, "day": F.col("as_of_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")})

    ids = "^(WC26-[A-Z]{3}-[A-Z]{3}-[0-9]{4}-[0-9]{2}-[0-9]{2}|WC26-(R32|R16|QF|SF)-[0-9]{2}|WC26-F|OUTRIGHT-WC2026|GROUP-[A-L]-WC2026|ADVANCE-[A-Z]{3}-WC2026|GOLDENBOOT-WC2026)$"

    @add("d02_prediction_contract", f"""
        WITH s AS (SELECT snap_id, as_of_date, match_id, market_type, outcome, yes_price AS p FROM polymarket_snapshot)
        SELECT snap_id, 'match_id' AS issue FROM s WHERE NOT coalesce(regexp_matches(match_id, '{ids}'), false)
        UNION ALL SELECT snap_id, 'as_of_date' FROM s WHERE NOT coalesce(regexp_matches(as_of_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'), false)
        UNION ALL SELECT snap_id, 'market_type' FROM s WHERE NOT coalesce(market_type IN ('match_1x2', 'outright_winner', 'group_winner', 'team_advances', 'top_scorer', 'totals', 'btts'), false)
        UNION ALL SELECT snap_id, 'p_model' FROM s WHERE NOT coalesce(p BETWEEN 0 AND 1, false)
        UNION ALL SELECT snap_id, 'outcome' FROM s WHERE NOT coalesce(CASE WHEN market_type = 'match_1x2' THEN outcome IN ('home', 'draw', 'away')
            WHEN market_type IN ('outright_winner', 'group_winner') THEN regexp_matches(outcome, '^[A-Z]{{3}}$') OR outcome = 'OTHER' WHEN market_type IN ('team_advances', 'btts') THEN outcome IN ('yes', 'no')
            WHEN market_type = 'totals' THEN regexp_matches(outcome, '^(over|under)_[0-9]+(_[0-9]+)?$') WHEN market_type = 'top_scorer' THEN trim(outcome) <> '' ELSE true END, false)""")
    def d02b(spark, d):
        s = table(spark, d, "polymarket_snapshot", ["snap_id", "as_of_date", "match_id", "market_type", "outcome", "yes_price"])
        return Q.row_issues(s.withColumns({"p_model": F.col("yes_price").cast("string"), "confidence": F.lit("0.5"), "model_version": F.lit("v")}), "snap_id", Q.prediction_rules())

    @add("d03_group_sums", "SELECT match_id, market_type, as_of_date, round(sum(yes_price), 6) AS total, count(*) AS n FROM polymarket_snapshot WHERE market_type IN ('match_1x2', 'outright_winner', 'group_winner', 'totals', 'btts') GROUP BY 1, 2, 3 HAVING NOT (round(sum(yes_price), 6) BETWEEN 0.99 AND 1.01)")
    def d03(spark, d):
        return Q.group_sum_issues(table(spark, d, "polymarket_snapshot", ["match_id", "market_type", "as_of_date", "yes_price"]), ["match_id", "market_type", "as_of_date"], "yes_price")

    @add("d04_header_and_rows", "SELECT true AS header_ok, count(*) > 0 AS not_empty FROM region")
    def d04(spark, d):
        r = table(spark, d, "region")
        return r.agg(F.lit(Q.header_equals(r, ["r_regionkey", "r_name"])).alias("header_ok"), (F.count("*") > 0).alias("not_empty"))

    @add("d05_required_columns", "SELECT 'no_such_column' AS missing")
    def d05(spark, d):
        return spark.createDataFrame([(c,) for c in Q.missing_columns(table(spark, d, "teams"), ["team_code", "no_such_column"])], "missing string")

    @add("d06_leaks", "SELECT count(*) AS leaks FROM player_matches WHERE TRY_CAST(substr(match_date, 1, 10) AS DATE) > CAST(loaded_at AS DATE)")
    def d06(spark, d):
        p = table(spark, d, "player_matches", ["match_date", "loaded_at"])
        return p.where(F.substring("match_date", 1, 10).try_cast("date") > F.to_date("loaded_at")).agg(F.count("*").alias("leaks"))

    @add("d07_expected_count", "SELECT count(*) AS n, count(*) = 128 AS ok FROM teams")
    def d07(spark, d):
        return table(spark, d, "teams", ["team_code"]).agg(F.count("*").alias("n"), (F.count("*") == 128).alias("ok"))

    @add("d08_unresolved", "SELECT DISTINCT country_code FROM players WHERE country_code IS NULL OR country_code NOT IN (SELECT team_code FROM teams)")
    def d08(spark, d):
        return Q.orphans(table(spark, d, "players", ["country_code"]).distinct(), "country_code", table(spark, d, "teams", ["team_code"]), "team_code")


def _streams(add) -> None:
    @add("t01_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
    def t01(spark, d):
        from touchline.streaming.live import drain, windowed_counts

        return drain(spark, windowed_counts(spark, d), "complete").select("day", "event_type", "n", F.round("total", 4).alias("total"))

    @add("t02_dedupe_within_watermark", "SELECT DISTINCT event_id, user_id FROM events")
    def t02(spark, d):
        from touchline.streaming.live import deduplicated, drain

        return drain(spark, deduplicated(spark, d), "append")

    @add("t03_sessions", """
        WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
        s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
    def t03(spark, d):
        from touchline.streaming.live import drain, sessions

        return drain(spark, sessions(spark, d), "complete")
