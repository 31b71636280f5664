"""Queries of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from touchline.llm.canon import asked_names, market_teams, team_matches
from touchline.llm.encode import decode_corpus, encode_corpus
from touchline.llm.leaks import find_leaks
from touchline.llm.linkage import link_appearances
from touchline.llm.pieces import oversized, rejoin, split_oversized
from touchline.llm.ranking import rank_teams
from touchline.llm.unify import find_inconsistent, unify_column
from touchline.llm.variants import same_people
from touchline.operators.markets import TEAM_KINDS, market_nodes, named_teams
from touchline.plans.registry import Registry
from touchline.session import cut
from touchline.sources.tables import table

registry = Registry()


@registry.add("p8_ids")
def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents", ["doc_id", "text"]))


#: Texts as they are, null as the empty one: what goes through an operator and back.
TEXTS_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@registry.add("p8_decoded", TEXTS_SQL)
def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every text from its own token ids."""
    return decode_corpus(p8_ids(spark, folder))


@registry.add("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    players = find_inconsistent(table(spark, folder, "players", ["row_id", "display_name"]), "row_id", "display_name", "players")
    teams = find_inconsistent(table(spark, folder, "teams", ["team_code", "team_name"]), "team_code", "team_name", "teams")
    return players.unionByName(teams)


@registry.add("p6_names")
def p6_names(spark: SparkSession, folder: str) -> DataFrame:
    players = table(spark, folder, "players", ["row_id", "display_name"]).select(F.lit("players").alias("table_name"), F.col("row_id").cast("string").alias("row_key"), F.col("display_name").alias("name"))
    teams = table(spark, folder, "teams", ["team_code", "team_name"]).select(F.lit("teams").alias("table_name"), F.col("team_code").alias("row_key"), F.col("team_name").alias("name"))
    return unify_column(players.unionByName(teams), "name", "form")


@registry.add("p9_found")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    items = table(spark, folder, "eval_items", ["item_id", "passage"])
    return find_leaks(docs, items).select("doc_id", "item_id")


@registry.add("p9_leaks")
def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Each affected document with the items that it holds and their words."""
    docs = table(spark, folder, "documents", ["doc_id", "text"])
    items = table(spark, folder, "eval_items", ["item_id", "passage"])
    found = find_leaks(docs, items).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "words"))).alias("items"))
    return found.select("doc_id", F.size("items").alias("n_items"), F.transform("items", lambda i: i["item_id"]).alias("item_ids"), F.transform("items", lambda i: i["words"]).alias("words"))


@registry.add("p10_found")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return oversized(split_oversized(table(spark, folder, "documents", ["doc_id", "text"])))


@registry.add("p10_pieces")
def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents", ["doc_id", "text"]))


@registry.add("p10_rejoined", TEXTS_SQL)
def p10_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Every text from its pieces, without their overlaps."""
    return rejoin(p10_pieces(spark, folder))


def _team_lists(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "teams", ["team_code", "team_name", "iso2_code"]), table(spark, folder, "team_aliases", ["alias", "team_code"])


@registry.add("p1_ranking")
def p1_ranking(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["match_no", "match_date", "match", "score", "actual", "loaded_at"]
    return rank_teams(table(spark, folder, "match_results", columns), *_team_lists(spark, folder)).withColumnRenamed("item", "team_code")


@registry.add("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_ranking(spark, folder).where("rank <= 12").select("team_code")


@registry.add("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    teams, aliases = _team_lists(spark, folder)
    snaps = table(spark, folder, "polymarket_snapshot", ["snap_id", "outcome"]).where(F.length(F.trim("outcome")) > 0)
    nodes = market_nodes(table(spark, folder, "kxfifaadvance_markets", ["pull_id", "payload"]), TEAM_KINDS)
    named = cut(named_teams(nodes).select("ticker", "yes_sub_title", "soccer_team").distinct())
    # one matching pass over the distinct texts of both sources
    texts = snaps.select(F.col("outcome").alias("text")).unionByName(asked_names(named).select(F.col("asked").alias("text")))
    codes = cut(team_matches(texts, "text", teams, aliases).select("typed", "code"))
    typed = snaps.join(codes, snaps["outcome"] == codes["typed"]).select(
        F.lit("polymarket_snapshot").alias("origin"), F.col("snap_id").cast("string").alias("rec_key"), "typed", F.col("code").alias("team_code")
    )
    markets = market_teams(named, teams, aliases, codes).select(
        F.lit("kxfifaadvance_markets").alias("origin"), "rec_key", "typed", F.col("code").alias("team_code")
    )
    # each source's rows are distinct, and no row is of both
    return typed.distinct().unionByName(markets)


@registry.add("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["player_id", "display_name", "normalized_name", "statsbomb_name", "understat_name", "birth_date", "birth_year"]
    columns += ["country_code", "position", "current_club", "understat_id", "espn_player_id"]
    return same_people(table(spark, folder, "players", columns))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    seen = ["roster_id", "player_name", "nation", "team_title", "position", "match_date", "loaded_at"]
    known = ["player_id", "display_name", "normalized_name", "statsbomb_name", "understat_name", "country_code", "position", "current_club", "last_updated_at"]
    return link_appearances(table(spark, folder, "player_matches", seen), table(spark, folder, "players", known), *_team_lists(spark, folder))


@registry.add("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder).select("roster_id", "player_id")


@registry.add("p3_links")
def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    return _links(spark, folder)
