"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.operators.history import attribute_history
from touchline.operators.markets import KINDS, TEAM_KINDS, market_nodes, markets, named_teams, ranges
from touchline.plans.registry import Registry
from touchline.sources.tables import table


def _history(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["player_id", "last_updated_at", "loaded_at", "row_id", "current_club", "is_active"]
    return attribute_history(table(spark, folder, "players", columns), "player_id", "last_updated_at", ["current_club", "is_active"], ["loaded_at", "row_id"])


def _nodes(spark: SparkSession, folder: str, kinds: dict[str, str] = KINDS) -> DataFrame:
    return market_nodes(table(spark, folder, "kxfifaadvance_markets", ["pull_id", "payload"]), kinds)


def register(registry: Registry) -> None:
    """Add the queries to ``registry``."""

    @registry.add("p2_found", P2_SQL)
    def p2_found(spark: SparkSession, folder: str) -> DataFrame:
        return _history(spark, folder).select("player_id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))

    @registry.add("p2_history", P2_HISTORY_SQL)
    def p2_history(spark: SparkSession, folder: str) -> DataFrame:
        return _history(spark, folder)

    @registry.add("p4_found", P4_SQL)
    def p4_found(spark: SparkSession, folder: str) -> DataFrame:
        return named_teams(_nodes(spark, folder, TEAM_KINDS)).select("event_ticker", "ticker", "soccer_team").distinct()

    @registry.add("p4_markets")
    def p4_markets(spark: SparkSession, folder: str) -> DataFrame:
        return markets(_nodes(spark, folder))

    @registry.add("p4_ranges")
    def p4_ranges(spark: SparkSession, folder: str) -> DataFrame:
        return ranges(_nodes(spark, folder))


P2_SQL = """
WITH day AS (
  SELECT player_id, last_updated_at AS d, current_club, is_active,
         row_number() OVER (PARTITION BY player_id, last_updated_at ORDER BY loaded_at DESC, row_id DESC) AS rn
  FROM players WHERE player_id IS NOT NULL AND last_updated_at IS NOT NULL
), clean AS (
  SELECT player_id, d, nullif(lower(trim(regexp_replace(current_club, '\\s+', ' ', 'g'))), '') AS c, is_active AS a
  FROM day WHERE rn = 1
), filled AS (
  SELECT player_id, d,
         coalesce(last_value(c IGNORE NULLS) OVER w, first_value(c IGNORE NULLS) OVER v) AS c,
         coalesce(last_value(a IGNORE NULLS) OVER w, first_value(a IGNORE NULLS) OVER v) AS a
  FROM clean
  WINDOW w AS (PARTITION BY player_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         v AS (PARTITION BY player_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), marked AS (
  SELECT player_id, d, c, a,
         lag(c) OVER (PARTITION BY player_id ORDER BY d) AS pc,
         lag(a) OVER (PARTITION BY player_id ORDER BY d) AS pa,
         row_number() OVER (PARTITION BY player_id ORDER BY d) AS n
  FROM filled
)
SELECT player_id, strftime(d, '%Y-%m-%d') AS valid_from
FROM marked WHERE n = 1 OR c IS DISTINCT FROM pc OR a IS DISTINCT FROM pa
"""

P2_HISTORY_SQL = """
WITH day AS (
  SELECT player_id, last_updated_at AS d, current_club, is_active,
         row_number() OVER (PARTITION BY player_id, last_updated_at ORDER BY loaded_at DESC, row_id DESC) AS rn
  FROM players WHERE player_id IS NOT NULL AND last_updated_at IS NOT NULL
), clean AS (
  SELECT player_id, d, CASE WHEN trim(regexp_replace(current_club, '\\s+', ' ', 'g')) <> '' THEN current_club END AS raw, is_active AS a FROM day WHERE rn = 1
), filled AS (
  SELECT player_id, d, coalesce(last_value(raw IGNORE NULLS) OVER w, first_value(raw IGNORE NULLS) OVER v) AS raw, coalesce(last_value(a IGNORE NULLS) OVER w, first_value(a IGNORE NULLS) OVER v) AS a
  FROM clean
  WINDOW w AS (PARTITION BY player_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         v AS (PARTITION BY player_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), keyed AS (SELECT *, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS c FROM filled
), marked AS (
  SELECT *, lag(c) OVER o AS pc, lag(a) OVER o AS pa, row_number() OVER o AS n FROM keyed WINDOW o AS (PARTITION BY player_id ORDER BY d)
), begun AS (SELECT * FROM marked WHERE n = 1 OR c IS DISTINCT FROM pc OR a IS DISTINCT FROM pa
), ended AS (SELECT *, lead(d) OVER (PARTITION BY player_id ORDER BY d) AS following FROM begun)
SELECT player_id, d AS valid_from, CAST(following - INTERVAL 1 DAY AS DATE) AS valid_to, following IS NULL AS is_current, raw AS current_club, a AS is_active FROM ended
"""

P4_SQL = """
WITH v AS (SELECT CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM kxfifaadvance_markets),
p AS (SELECT CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(j, '$')) THEN CAST(json_extract_string(j, '$') AS JSON) END ELSE j END AS j FROM v),
e AS (
  SELECT unnest(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END) AS e FROM (
    SELECT json_extract(j, '$.event') AS x FROM p UNION ALL SELECT json_extract(j, '$.events') FROM p UNION ALL SELECT json_extract(j, '$.data.series.events') FROM p)
), m AS (
  SELECT t, unnest(CASE json_type(x) WHEN 'ARRAY' THEN CAST(x AS JSON[]) WHEN 'OBJECT' THEN [x] ELSE [] END) AS m FROM (
    SELECT json_extract_string(e, '$.event_ticker') AS t, json_extract(e, '$.markets') AS x FROM e UNION ALL SELECT NULL, json_extract(j, '$.markets') FROM p)
), c AS (
  SELECT coalesce(json_extract_string(m, '$.event_ticker'), t) AS event_ticker, json_extract_string(m, '$.ticker') AS ticker,
         CASE WHEN json_type(m, '$.custom_strike') = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(m, '$.custom_strike')) THEN CAST(json_extract_string(m, '$.custom_strike') AS JSON) END
              ELSE json_extract(m, '$.custom_strike') END AS cs
  FROM m WHERE json_type(m) = 'OBJECT'
), s AS (SELECT event_ticker, ticker, json_extract(cs, '$.soccer_team') AS st FROM c),
n AS (
  SELECT event_ticker, ticker, list_filter(list_transform(CASE json_type(st) WHEN 'ARRAY' THEN CAST(st AS JSON[]) ELSE [st] END,
           lambda x: CASE json_type(x) WHEN 'OBJECT' THEN json_extract_string(x, '$.name') WHEN 'NULL' THEN NULL ELSE json_extract_string(x, '$') END), lambda y: y IS NOT NULL) AS names FROM s)
SELECT DISTINCT event_ticker, ticker, unnest(CASE WHEN coalesce(len(names), 0) = 0 THEN [''] ELSE names END) AS soccer_team FROM n
"""
