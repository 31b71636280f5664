"""Knock-out brackets from group tables and slot references."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from touchline.operators.relational import top_n


def group_ranks(df: DataFrame, group: str, points: str, team: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc(points), F.asc(team))
    return df.withColumn("rank", F.row_number().over(w))


def best_thirds(df: DataFrame, group: str, points: str, team: str, n: int) -> DataFrame:
    """The ``n`` best of those ranked third in their groups."""
    thirds = group_ranks(top_n(df, [group], [F.desc(points), F.asc(team)], 3), group, points, team).where("rank = 3")
    return thirds.orderBy(F.desc(points), team).limit(n)


def assign_thirds(order: Sequence[str], slots: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """Third-placed groups to slots, greedily in slot order: each slot takes the
    best third still free that it allows, or ``TBD``. A bracket has eight slots."""
    free = list(order)
    out = {}
    for slot, allowed in slots.items():
        pick = next((g for g in free if g in allowed), None)
        if pick is not None:
            free.remove(pick)
        out[slot] = pick if pick is not None else "TBD"
    return out


def resolve_slots(ranks: DataFrame, group: str, team: str, thirds: Mapping[str, str]) -> DataFrame:
    """``slot, team``: ``1A`` for the winner of A, ``2B`` for the second of B, and
    the slots of the thirds."""
    direct = ranks.where("rank <= 2").select(F.concat(F.col("rank").cast("string"), F.col(group)).alias("slot"), F.col(team).alias("team"))
    spark = ranks.sparkSession
    table = spark.createDataFrame([(s, g) for s, g in thirds.items()] or [("", "")], "slot string, g string")
    third = table.join(ranks.where("rank = 3"), table["g"] == ranks[group], "left").select("slot", F.col(team).alias("team")).where("slot <> ''")
    return direct.unionByName(third)


def play_rounds(matches: DataFrame, slots: DataFrame, strength: DataFrame, rounds: int = 5) -> DataFrame:
    """``match, round, team1, team2, winner`` of a bracket.

    ``matches`` has ``match, round, slot1, slot2``; ``W73`` refers to a match of
    an earlier round. The stronger side wins, of equal ones the first. One join a
    round, and the number of rounds is fixed.
    """
    known, played = slots, None
    for r in range(1, rounds + 1):
        now = matches.where(F.col("round") == r)
        for side in ("1", "2"):
            now = now.join(known.select(F.col("slot").alias(f"slot{side}"), F.col("team").alias(f"team{side}")), f"slot{side}", "left")
            now = now.join(strength.select(F.col("team").alias(f"team{side}"), F.col("strength").alias(f"s{side}")), f"team{side}", "left")
        done = now.select(
            "match", "round", "team1", "team2",
            F.when(F.col("team2").isNull() | (F.coalesce("s1", F.lit(0.0)) >= F.coalesce("s2", F.lit(0.0))), F.col("team1")).otherwise(F.col("team2")).alias("winner"),
        )
        known = known.unionByName(done.select(F.concat(F.lit("W"), "match").alias("slot"), F.col("winner").alias("team")))
        played = done if played is None else played.unionByName(done)
    return played
