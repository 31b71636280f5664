"""Joins, windows and reshapes that the warehouse queries are made of."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Side of a join that may be broadcast, in rows, where a caller proves it.
SMALL_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast hint for a side whose size is checked by a bounded count.

    The check stops at ``rows + 1`` rows; beyond, the plain frame comes back and
    the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``order`` must be total.

    Catalyst limits each group before the shuffle (WindowGroupLimit), so a hot
    group sends at most ``n`` rows a task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def keep_best(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in ``order``."""
    return top_n(df, key, order, 1)


def top_n_mean(df: DataFrame, group: Sequence[str], value: str, tie: Sequence[str], n: int, into: str) -> DataFrame:
    """Mean of the ``n`` greatest values of each group and how many there were."""
    best = top_n(df.where(F.col(value).isNotNull()), group, [F.desc(value), *[F.asc(t) for t in tie]], n)
    return best.groupBy(*group).agg(F.avg(value).alias(into), F.count("*").alias("n_used"))


def mirrored(pairs: DataFrame, a: str, b: str, swap: Mapping[str, str], order: Sequence[Column]) -> DataFrame:
    """A lookup that finds a pair from either side; of several the last counts.

    ``swap`` names the columns that change places in the mirrored row.
    """
    other = pairs.select(*[F.col(swap.get(c, b if c == a else a if c == b else c)).alias(c) for c in pairs.columns])
    both = pairs.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)))
    return keep_best(both, [a, b], [*order, F.desc("_side")]).drop("_side")


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long in one scan; rows with null values are kept."""
    return df.unpivot(list(ids), list(values), name, value)


def pivot(df: DataFrame, ids: Sequence[str], name: str, names: Sequence[str], value: Column) -> DataFrame:
    """Long to wide; the fixed list of names saves a pass over the data."""
    return df.groupBy(*ids).pivot(name, list(names)).agg(value)


def outer_by_tag(sources: Mapping[str, DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Full outer join of any number of sources on ``keys`` in one shuffle.

    Each source is tagged and the union is pivoted, so every further source adds
    rows, not another join. Of repeated keys the greatest value counts.
    """
    tagged = None
    for tag, df in sources.items():
        one = df.select(*keys, F.lit(tag).alias("_tag"), F.col(value).cast("double").alias("_v"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(*keys).agg(*[F.max(F.when(F.col("_tag") == t, F.col("_v"))).alias(t) for t in sources])


def last_n_before(refs: DataFrame, rows: DataFrame, group: str, day: str, ref_day: str, value: str, n: int, order: Sequence[str], default: float, into: str) -> DataFrame:
    """Mean of the last ``n`` values of a group strictly before a reference day.

    References are rows of the same ordered stream, so the window looks back from
    them: one sort by group instead of a join of every reference with every row.
    """
    events = rows.select(F.col(group).alias("_g"), F.col(day).alias("_d"), F.lit(0).alias("_ref"), F.col(value).cast("double").alias("_v"), *[F.col(o) for o in order])
    marks = refs.select(F.col(group).alias("_g"), F.col(ref_day).alias("_d"), F.lit(-1).alias("_ref"), F.lit(None).cast("double").alias("_v"), *[F.lit(None).cast(rows.schema[o].dataType).alias(o) for o in order]).distinct()
    w = Window.partitionBy("_g").orderBy("_d", "_ref", *order)
    seen = events.unionByName(marks).withColumn("_k", F.sum(F.when(F.col("_ref") == 0, 1).otherwise(0)).over(w))
    total = F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    # running sums at count k and k - n give the mean of the last n events
    cum = seen.withColumn("_s", F.coalesce(total, F.lit(0.0)))
    ends = cum.where("_ref = 0").select("_g", F.col("_k").alias("_k2"), F.col("_s").alias("_s2"))
    at = cum.where("_ref = -1").select("_g", "_d", "_k", "_s")
    joined = at.join(ends, (at["_g"] == ends["_g"]) & (ends["_k2"] == at["_k"] - n), "left").select(at["_g"], "_d", "_k", "_s", "_s2")
    used = F.least(F.col("_k"), F.lit(n))
    mean = F.when(used > 0, (F.col("_s") - F.coalesce("_s2", F.lit(0.0))) / used).otherwise(F.lit(default))
    return joined.select(F.col("_g").alias(group), F.col("_d").alias(ref_day), mean.alias(into), used.alias("n_used"))
