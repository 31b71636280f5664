"""Scores of probabilistic forecasts with three outcomes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from touchline.session import ship

#: Bin edges as computed by evenly spaced floating steps, so that a
#: probability of 0.6 lies in the third of five bins.
EDGES = (0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0)


def p_actual(h: Column, d: Column, a: Column, actual: Column) -> Column:
    return F.when(actual == "H", h).when(actual == "D", d).when(actual == "A", a)


def log_loss(h: Column, d: Column, a: Column, actual: Column) -> Column:
    """Loss of one forecast after scaling it to one; kept off zero."""
    return -F.log(F.greatest(p_actual(h, d, a, actual) / (h + d + a), F.lit(1e-15)))


def favourite(h: Column, d: Column, a: Column) -> Column:
    """The likeliest outcome; of ties the first in the order H, D, A."""
    return F.when((h >= d) & (h >= a), "H").when(d >= a, "D").otherwise("A")


def brier_home(h: Column, actual: Column) -> Column:
    return F.pow(h - F.when(actual == "H", 1.0).otherwise(0.0), F.lit(2.0))


def rps(h: Column, d: Column, a: Column, actual: Column) -> Column:
    """Ranked probability score of one forecast."""
    first = h - F.when(actual == "H", 1.0).otherwise(0.0)
    second = h + d - F.when(actual.isin("H", "D"), 1.0).otherwise(0.0)
    return 0.5 * (first * first + second * second)


def scores(df: DataFrame, by: list[str], h: str, d: str, a: str, actual: str) -> DataFrame:
    """Log-loss, accuracy, home Brier score and RPS by group, in one aggregate."""
    cols = [F.col(x) for x in (h, d, a, actual)]
    hit = F.when(favourite(*cols[:3]) == cols[3], 1.0).otherwise(0.0)
    return df.where(cols[3].isin("H", "D", "A") & cols[0].isNotNull() & cols[1].isNotNull() & cols[2].isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(log_loss(*cols)).alias("log_loss"), F.avg(hit).alias("accuracy"), F.avg(brier_home(cols[0], cols[3])).alias("brier"), F.avg(rps(*cols)).alias("rps")
    )


def calibration_error(df: DataFrame, by: list[str], h: str, d: str, a: str, actual: str) -> DataFrame:
    """Expected calibration error: five half-open bins, mean over the outcomes."""
    rows = df.where(F.col(actual).isin("H", "D", "A")).select(
        *by, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("p"), F.when(F.col(actual) == k, 1.0).otherwise(0.0).alias("y")) for k, c in (("H", h), ("D", d), ("A", a))])).alias("x")
    ).select(*by, "x.*")
    place = F.lit(None).cast("int")
    for i in reversed(range(len(EDGES) - 1)):
        place = F.when((F.col("p") >= EDGES[i]) & (F.col("p") < EDGES[i + 1]), i).otherwise(place)
    bins = rows.withColumn("b", place).groupBy(*by, "k", "b").agg(F.count("*").alias("n"), F.avg("p").alias("mp"), F.avg("y").alias("my"))
    total = bins.groupBy(*by, "k").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("b").isNotNull(), F.col("n") * F.abs(F.col("mp") - F.col("my")))).alias("e"))
    per = total.select(*by, (F.coalesce("e", F.lit(0.0)) / F.col("n")).alias("e"))
    return per.groupBy(*by).agg(F.avg("e").alias("ece"))


def calibration_table(df: DataFrame, p: str, y: Column, edges: tuple[float, ...] = (0.0, 0.2, 0.35, 0.5, 0.65, 1.0000001)) -> DataFrame:
    """Forecast and observed frequency in uneven bins."""
    place = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        place = F.when((F.col(p) >= edges[i]) & (F.col(p) < edges[i + 1]), i).otherwise(place)
    return df.withColumn("bin", place).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("forecast"), F.avg(y).alias("observed"))


def bootstrap(df: DataFrame, values: str | list[str], resamples: int = 10_000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """``value, mean, low, high``: percentile interval of the mean of each column.

    Each row draws its weight in every resample from a Poisson distribution seeded
    by the row itself, the same for all columns, so resamples are sums over
    partitions: no sample is ever gathered, and the result doesn't depend on the
    partitioning. ``df`` needs ``row_id`` and the ``values``; nulls are left out.
    """
    import numpy as np

    ship(df.sparkSession)
    values = [values] if isinstance(values, str) else values

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = np.zeros((len(values), resamples)), np.zeros((len(values), resamples))
        for batch in batches:
            held = batch[values].to_numpy(float)
            for key, row in zip(batch["row_id"], held):
                w = np.random.default_rng((seed, int(key))).poisson(1.0, resamples)
                known = ~np.isnan(row)
                s[known] += row[known, None] * w
                n[known] += w
        for k, name in enumerate(values):
            yield pd.DataFrame({"value": name, "resample": range(resamples), "s": s[k], "n": n[k]})

    rows = df.select("row_id", *[F.col(v).cast("double").alias(v) for v in values])
    sums = rows.mapInPandas(run, "value string, resample int, s double, n double").groupBy("value", "resample").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0")
    # as many values as resamples
    spread = sums.groupBy("value").agg(F.percentile(F.col("s") / F.col("n"), F.array(F.lit(low), F.lit(high))).alias("q"))
    means = rows.unpivot([], values, "value", "v").groupBy("value").agg(F.avg("v").alias("mean"))
    return means.join(spread, "value").select("value", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def student_tail(t: float, dof: int) -> float:
    """Two-sided tail of Student's distribution, by the incomplete beta function."""
    if dof <= 0 or math.isnan(t):
        return float("nan")
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d = 1 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def paired_t(df: DataFrame, x: str, y: str) -> DataFrame:
    """``n, mean_diff, t, p`` of paired differences."""
    n, mean, sd = df.agg(F.count(F.col(x) - F.col(y)), F.avg(F.col(x) - F.col(y)), F.stddev_samp(F.col(x) - F.col(y))).first()
    t = float("nan") if n < 2 else float("inf") if not sd else mean / (sd / math.sqrt(n))
    return df.sparkSession.createDataFrame([(n, mean, t, student_tail(t, n - 1))], "n bigint, mean_diff double, t double, p double")


def agreement_tier(picks: Column) -> Column:
    """``golden_zone``, ``two_agree`` or ``split`` from an array of three picks."""
    n = F.size(F.array_distinct(picks))
    return F.when(n == 1, "golden_zone").when(n == 2, "two_agree").otherwise("split")
