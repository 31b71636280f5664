"""Market comparison: prices, margins and stakes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

EDGE, STAKE_CAP, KELLY_PART = 0.03, 0.02, 0.5
GROUP = ["match_id", "market_type"]


def golden_zone(df: DataFrame, keys: Sequence[str], outcome: str, models: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Groups in which every model is there and has the same favourite.

    Of equal probabilities the outcome first in ``order`` wins.
    """
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(outcome))
    tops = [F.max(F.when(F.col(m).isNotNull(), F.struct(F.col(m), -place, F.col(outcome).alias("o"))))["o"].alias(f"_{m}") for m in models]
    best = df.groupBy(*keys).agg(*tops)
    picks = F.array(*[F.col(f"_{m}") for m in models])
    all_there = F.size(F.array_compact(picks)) == len(models)
    same = F.size(F.array_distinct(F.array_compact(picks))) == 1
    return best.select(*keys, F.when(all_there & same, 1).otherwise(0).alias("golden_zone"), F.col(f"_{models[0]}").alias("pick"))


def blend_if_complete(parts: Sequence[Column]) -> Column:
    """Mean of all parts, null where one is missing."""
    return sum(parts[1:], parts[0]) / len(parts)


def opportunity(zone: Column, edge: Column, least: float = EDGE) -> Column:
    return F.when((zone == 1) & (edge > least), "yes").otherwise("no")


def multiplicative(prices: DataFrame, keys: Sequence[str], price: str) -> DataFrame:
    """Prices divided by their sum in the group: the margin spread evenly."""
    total = prices.groupBy(*keys).agg(F.sum(price).alias("_total"))
    return prices.join(total, list(keys)).withColumn("fair", F.when(F.col("_total") > 0, F.col(price) / F.col("_total"))).drop("_total")


def _bisect(low: float, high: float, steps: int, too_low) -> Column:
    """Root between two bounds, as a fold over a fixed number of steps."""
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = too_low(mid)
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)


def power_exponent(prices: Column) -> Column:
    """The power ``k`` for which an array of prices sums to one."""
    summed = lambda k: F.aggregate(prices, F.lit(0.0), lambda acc, p: acc + F.pow(p, k))
    return _bisect(0.05, 20.0, 60, lambda k: summed(k) > 1.0)


def shin_share(prices: Column) -> Column:
    """The share of informed money under which an array of prices is fair."""
    booked = F.aggregate(prices, F.lit(0.0), lambda acc, p: acc + p)
    summed = lambda z: F.aggregate(prices, F.lit(0.0), lambda acc, p: acc + (F.sqrt(z * z + 4 * (1 - z) * p * p / booked) - z) / (2 * (1 - z)))
    return _bisect(0.0, 0.4, 60, lambda z: summed(z) > 1.0)


def devig(prices: DataFrame, keys: Sequence[str], outcome: str, price: str, how: str) -> DataFrame:
    """``keys, outcome, price, fair`` by the power or the informed-money rule.

    A group is one market with its few outcomes. Groups with a price that isn't
    positive have no fair prices and are left out.
    """
    groups = prices.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(outcome).alias("o"), F.col(price).alias("p")))).alias("x"))
    groups = groups.where(F.forall("x", lambda e: F.coalesce(e["p"] > 0, F.lit(False)))).withColumn("p", F.transform("x", lambda e: e["p"]))
    if how == "power":
        solved = groups.withColumn("k", power_exponent(F.col("p")))
        fair = lambda e: F.pow(e["p"], F.col("k"))
    elif how == "shin":
        solved = groups.withColumn("k", shin_share(F.col("p"))).withColumn("b", F.aggregate("p", F.lit(0.0), lambda acc, p: acc + p))
        z = F.col("k")
        fair = lambda e: (F.sqrt(z * z + 4 * (1 - z) * e["p"] * e["p"] / F.col("b")) - z) / (2 * (1 - z))
    else:
        raise ValueError(how)
    rows = solved.select(*keys, F.explode(F.transform("x", lambda e: F.struct(e["o"].alias("o"), e["p"].alias("p"), fair(e).alias("fair")))).alias("e"))
    return rows.select(*keys, F.col("e.o").alias(outcome), F.col("e.p").alias(price), F.col("e.fair").alias("fair"))


def half_kelly(p: Column, price: Column, sharp: Column, least: float = EDGE, least_sharp: float = 0.015) -> Column:
    """Part of the bank to stake: half the optimal fraction, capped, and nothing
    without an edge over the price and over the sharp book."""
    odds = 1 / price - 1
    f = (odds * p - (1 - p)) / odds * KELLY_PART
    ok = (p - price >= least) & (p - sharp >= least_sharp) & (f > 0) & price.between(1e-9, 1 - 1e-9)
    return F.when(ok, F.least(f, F.lit(STAKE_CAP))).otherwise(F.lit(0.0))


def cross_book(a: DataFrame, b: DataFrame, keys: Sequence[str], price: str, volume: str, least: float = 0.015) -> DataFrame:
    """Rows of two books whose prices differ by at least ``least``, both traded."""
    x = a.select(*keys, F.col(price).alias("price_a"), F.col(volume).alias("volume_a"))
    y = b.select(*keys, F.col(price).alias("price_b"), F.col(volume).alias("volume_b"))
    gap = F.round(F.abs(F.col("price_a") - F.col("price_b")), 6)
    return x.join(y, list(keys)).where((F.col("volume_a") > 0) & (F.col("volume_b") > 0)).withColumn("gap", gap).where(F.col("gap") >= least)
