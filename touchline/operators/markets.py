"""Flat tables of an exchange's nested market payloads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from touchline.operators.nested import inside, label_nodes, nodes_of
from touchline.session import cut

#: The keys of the payload and the kind of node under each.
KINDS = {"event": "event", "events": "event", "markets": "market", "price_ranges": "range", "soccer_team": "team"}
#: The kinds that :func:`named_teams` needs.
TEAM_KINDS = {k: v for k, v in KINDS.items() if v != "range"}
KEYS = ["pull_id"]


def market_nodes(df: DataFrame, kinds: Mapping[str, str] = KINDS) -> DataFrame:
    """Labelled nodes of ``pull_id, payload`` rows, written once.

    Several tables are taken from them, so they are kept in the shared folder
    instead of parsing every payload for each. Kinds that nothing is taken from
    need not be kept.
    """
    return cut(label_nodes(df, KEYS, "payload", kinds))


def events(nodes: DataFrame) -> DataFrame:
    fields = {"event_ticker": "event_ticker", "series_ticker": "series_ticker", "title": "title"}
    return nodes_of(nodes, KEYS, "event", fields)


def markets(nodes: DataFrame) -> DataFrame:
    """Markets with their event: the ticker they carry, else the event's that
    holds them."""
    names = ["ticker", "status", "market_type", "close_time", "yes_sub_title", "last_price_dollars", "yes_ask_dollars", "volume_fp"]
    flat = nodes_of(nodes, KEYS, "market", {"own_event": "event_ticker", **{n: n for n in names}})
    held = inside(flat, events(nodes).select(*KEYS, "doc", "pre", "post", "text", "event_ticker"), KEYS)
    return held.withColumn("event_ticker", F.coalesce("own_event", "event_ticker")).drop("own_event", "text")


def ranges(nodes: DataFrame) -> DataFrame:
    flat = nodes_of(nodes, KEYS, "range", {"range_start": "start", "range_end": "end", "step": "step"}).drop("text")
    return inside(flat, markets(nodes).select(*KEYS, "doc", "pre", "post", F.lit(None).alias("text"), "event_ticker", "ticker"), KEYS, "inner")


def named_teams(nodes: DataFrame) -> DataFrame:
    """``event_ticker, ticker, yes_sub_title, soccer_team``: every market with each
    team that it names, or with the empty string if it names none."""
    teams = nodes_of(nodes, KEYS, "team", {"name": "name"}, records=False)
    teams = teams.withColumn("soccer_team", F.coalesce("name", "text")).where(F.col("soccer_team").isNotNull()).drop("name", "text")
    flat = markets(nodes)
    parents = flat.select(*KEYS, "doc", "pre", "post", F.lit(None).alias("text"))
    linked = inside(teams, parents, KEYS, "inner").select(*KEYS, "doc", F.col("parent_pre").alias("pre"), "soccer_team")
    m, t = flat.alias("m"), linked.alias("t")
    same = F.lit(True)
    for c in (*KEYS, "doc", "pre"):
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"t.{c}"))
    return m.join(t, same, "left").select("event_ticker", "ticker", "yes_sub_title", F.coalesce("soccer_team", F.lit("")).alias("soccer_team"))
