"""Ratings and match models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from touchline.functions.scalars import clip
from touchline.session import ship

# Fixed values of the rating and outcome rules.
START, K, SCALE, HOME_EDGE = 1500.0, 30.0, 400.0, 50.0
SHAPE = 2.2
FORM_BASE, FORM_SLOPE, FORM_DRAW = 0.3, 0.5, 0.25
GOALS = 8


def team_points(matches: DataFrame) -> DataFrame:
    """Long form: ``team, match_date, match_no, points`` with a win worth one."""
    share = lambda f, a: F.when(F.col(f) > F.col(a), 1.0).when(F.col(f) == F.col(a), 1.0 / 3).otherwise(0.0)
    sides = F.array(F.struct(F.col("home").alias("team"), share("hg", "ag").alias("points")), F.struct(F.col("away").alias("team"), share("ag", "hg").alias("points")))
    return matches.select("match_date", "match_no", F.explode(sides).alias("s")).select("s.team", "match_date", "match_no", "s.points")


def elo(matches: DataFrame, order: Sequence[str], pool: str | None = None, home: str = "home", away: str = "away", hg: str = "hg", ag: str = "ag") -> DataFrame:
    """``pool, team, rating, games`` after all matches, in ``order``.

    A recurrence: each match needs the ratings before it. The rows of a pool
    stream through one task in order and only the ratings are held, so memory is
    bounded by the teams; teams of different pools never meet, so pools run side
    by side. ``order`` must be total. Null sides or goals are skipped.
    """
    ship(matches.sparkSession)
    key = F.col(pool).cast("string") if pool else F.lit("all")
    rows = matches.select(key.alias("pool"), *[F.col(c) for c in order], F.col(home).cast("string").alias("h"), F.col(away).cast("string").alias("a"), F.col(hg).cast("int").alias("hg"), F.col(ag).cast("int").alias("ag"))
    rows = rows.dropna(subset=["h", "a", "hg", "ag"])
    placed = (rows.repartition("pool") if pool else rows.repartition(1)).sortWithinPartitions("pool", *order).select("pool", "h", "a", "hg", "ag")
    schema = "pool string, team string, rating double, games bigint"

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratings: dict[str, float] = {}
        games: dict[str, int] = {}
        at = None

        def out() -> pd.DataFrame:
            return pd.DataFrame({"pool": at, "team": list(ratings), "rating": list(ratings.values()), "games": [games[t] for t in ratings]})

        for batch in batches:
            for p, h, a, x, y in zip(*[batch[c].tolist() for c in ("pool", "h", "a", "hg", "ag")]):
                if p != at:
                    if ratings:
                        yield out()
                    ratings, games, at = {}, {}, p
                rh, ra = ratings.get(h, START), ratings.get(a, START)
                step = elo_step(rh, ra, x, y)
                ratings[h], ratings[a] = rh + step, ra - step
                games[h], games[a] = games.get(h, 0) + 1, games.get(a, 0) + 1
        if ratings:
            yield out()

    return placed.mapInPandas(fold, schema)


def elo_step(rh: float, ra: float, hg: int, ag: int) -> float:
    """What the first side gains and the other loses."""
    expected = 1.0 / (1.0 + 10.0 ** ((ra - rh) / SCALE))
    actual = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
    gap = abs(hg - ag)
    weight = math.log(max(gap, 1) + 1) * (1.75 if gap >= 3 else 1.5 if gap == 2 else 1.0)
    return K * weight * (actual - expected)


def elo_outcomes(rating_home: Column, rating_away: Column, neutral: Column) -> Column:
    """``struct(h, d, a)`` from two ratings: powers of the expectation, rest a draw."""
    edge = F.when(neutral, 0.0).otherwise(HOME_EDGE)
    e = 1 / (1 + F.pow(F.lit(10.0), (rating_away - rating_home - edge) / SCALE))
    h, a = F.pow(e, F.lit(SHAPE)), F.pow(1 - e, F.lit(SHAPE))
    return F.struct(h.alias("h"), (1 - h - a).alias("d"), a.alias("a"))


def elo_outcomes_with_hosts(rating_home: Column, rating_away: Column, is_host: Column, edge: float = 65.0) -> Column:
    """The weekly variant: a host's edge and a draw share that falls with the gap."""
    p = 1 / (1 + F.pow(F.lit(10.0), (rating_away - rating_home - F.when(is_host, edge).otherwise(0.0)) / SCALE))
    draw = F.greatest(F.lit(0.15), F.lit(0.30) - 0.6 * F.abs(p - 0.5))
    return F.struct((p * (1 - draw)).alias("h"), draw.alias("d"), ((1 - p) * (1 - draw)).alias("a"))


def outright_shares(ratings: DataFrame, team: str, rating: str, top: int = 32, temperature: float = 200.0) -> DataFrame:
    """Softmax over the ``top`` ratings; a bounded list, so one task is enough."""
    best = ratings.orderBy(F.desc(rating), team).limit(top)
    every = Window.partitionBy()
    lift = F.exp((F.col(rating) - F.max(rating).over(every)) / temperature)
    return best.withColumn("_e", lift).select(team, rating, (F.col("_e") / F.sum("_e").over(every)).alias("share"))


def form_outcomes(form_home: Column, form_away: Column) -> Column:
    h, a = FORM_BASE + FORM_SLOPE * form_home, FORM_BASE + FORM_SLOPE * form_away
    total = h + a + FORM_DRAW
    return F.struct((h / total).alias("h"), (F.lit(FORM_DRAW) / total).alias("d"), (a / total).alias("a"))


def hybrid_target(xg: Column, goals: Column) -> Column:
    """``struct(target, is_xg)``: expected goals where known, else goals."""
    return F.struct(F.coalesce(xg, goals.cast("double")).alias("target"), xg.isNotNull().alias("is_xg"))


def match_weight(day: Column, ref: str, xi: float, importance: Column) -> Column:
    return F.exp(-F.lit(xi) * F.datediff(F.lit(ref).cast("date"), day)) * importance


def poisson_fit(matches: DataFrame, home: str, away: str, hg: str, ag: str, weight: str | None = None, rounds: int = 60, tol: float = 1e-9) -> DataFrame:
    """``team, attack, defence, home_edge``: weighted Poisson goals by cyclic updates.

    Goals depend on attack times the other's defence times the home edge. All
    matches shrink to one row for each ordered pair of teams first (weights and
    weighted goals), combined map-side; the updates then run over these pairs,
    whose number is the square of the teams and not of the matches. Parameters
    are identified up to a constant: only products mean anything.
    """
    import numpy as np

    w = F.col(weight) if weight else F.lit(1.0)
    pairs = matches.groupBy(F.col(home).cast("string").alias("h"), F.col(away).cast("string").alias("a")).agg(
        F.sum(w).alias("w"), F.sum(w * F.col(hg)).alias("gh"), F.sum(w * F.col(ag)).alias("ga")
    ).where("w > 0 and h is not null and a is not null").toPandas()
    names = np.unique(np.concatenate([pairs["h"], pairs["a"]])) if len(pairs) else np.array([], dtype=object)
    spark = matches.sparkSession
    schema = "team string, attack double, defence double, home_edge double"
    if not len(names):
        return spark.createDataFrame([], schema)
    i, j = np.searchsorted(names, pairs["h"]), np.searchsorted(names, pairs["a"])
    weights, gh, ga = (pairs[c].to_numpy(float) for c in ("w", "gh", "ga"))
    n = len(names)
    att, dfc, edge = np.ones(n), np.ones(n), 1.3
    small = 1e-12
    for _ in range(rounds):
        old = np.concatenate([np.log(att), np.log(dfc), [math.log(edge)]])
        att = (np.bincount(i, gh, n) + np.bincount(j, ga, n) + small) / (np.bincount(i, weights * dfc[j] * edge, n) + np.bincount(j, weights * dfc[i], n) + small)
        dfc = (np.bincount(j, gh, n) + np.bincount(i, ga, n) + small) / (np.bincount(j, weights * att[i] * edge, n) + np.bincount(i, weights * att[j], n) + small)
        edge = float((gh.sum() + small) / ((weights * att[i] * dfc[j]).sum() + small))
        level = math.exp(float(np.log(np.maximum(att, small)).mean()))
        att, dfc = att / level, dfc * level
        if np.abs(np.concatenate([np.log(att), np.log(dfc), [math.log(edge)]]) - old).max() < tol:
            break
    rows = [(str(t), float(x), float(y), edge) for t, x, y in zip(names, att, dfc)]
    return spark.createDataFrame(rows, schema)


def poisson_outcomes(lam: Column, mu: Column, most: int = GOALS) -> Column:
    """``struct(h, d, a)`` of independent Poisson goals up to ``most`` each."""

    def pmf(mean: Column) -> list[Column]:
        return [F.exp(-mean) * F.pow(mean, F.lit(float(k))) / math.factorial(k) for k in range(most + 1)]

    p, q = pmf(lam), pmf(mu)
    below = [sum((q[j] for j in range(i)), F.lit(0.0)) for i in range(most + 1)]
    above = [sum((p[j] for j in range(i)), F.lit(0.0)) for i in range(most + 1)]
    h = sum((p[i] * below[i] for i in range(1, most + 1)), F.lit(0.0))
    a = sum((q[i] * above[i] for i in range(1, most + 1)), F.lit(0.0))
    d = sum((p[i] * q[i] for i in range(most + 1)), F.lit(0.0))
    total = h + d + a
    return F.struct((h / total).alias("h"), (d / total).alias("d"), (a / total).alias("a"))


def corrected_outcomes(lam: Column, mu: Column, rho: float, most: int = GOALS) -> Column:
    """Poisson outcomes with the low-score correction of factor ``rho``, kept where
    no score's probability falls below zero."""
    bounded = F.greatest(F.least(F.lit(rho), F.lit(1.0), 1 / (lam * mu)), -1 / F.greatest(lam, mu))
    mass = lambda rate: F.exp(-rate) * sum((F.pow(rate, F.lit(float(k))) / math.factorial(k) for k in range(1, most + 1)), F.lit(1.0))
    # 0-0 and 1-1 lose what 1-0 and 0-1 gain, inside the same grid of scores
    shift = F.exp(-lam - mu) * lam * mu * bounded / (mass(lam) * mass(mu))
    plain = poisson_outcomes(lam, mu, most)
    return F.struct((plain["h"] + shift).alias("h"), (plain["d"] - 2 * shift).alias("d"), (plain["a"] + shift).alias("a"))


def xg_rate(attack: Column, mean_attack: Column, defence: Column, mean_defence: Column, base: float = 1.15) -> Column:
    """Goal rate of a squad against another, between 0.70 and 1.90."""
    return clip(F.lit(base) * (attack / mean_attack) * (defence / mean_defence), 0.70, 1.90)


def blend_outcomes(parts: Sequence[tuple[Column, float]]) -> Column:
    """Weighted mean of outcome structs, made to sum to one; a missing part
    leaves its weight to the others."""
    out = {}
    for k in ("h", "d", "a"):
        out[k] = sum((F.coalesce(p[k] * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    total = out["h"] + out["d"] + out["a"]
    return F.struct(*[(F.when(total > 0, v / total)).alias(k) for k, v in out.items()])


def temperature(p: Column, t: float) -> Column:
    """Outcome struct with its log odds divided by ``t``."""
    powered = {k: F.pow(p[k], F.lit(1.0 / t)) for k in ("h", "d", "a")}
    total = powered["h"] + powered["d"] + powered["a"]
    return F.struct(*[(v / total).alias(k) for k, v in powered.items()])


SIM_SCHEMA = T.StructType([T.StructField("iteration", T.LongType()), T.StructField("team", T.StringType()), T.StructField("stage", T.IntegerType())])


def simulate_knockout(spark, strengths: Sequence[tuple[str, float]], iterations: int, seed: int = 42, partitions: int = 8) -> DataFrame:
    """``iteration, team, stage``: rounds that each team reached in a seeded bracket.

    Iterations are rows; the generator of each is seeded by its number, so the
    result doesn't depend on partitions. The field is a bracket, at most 64 teams.
    """
    import numpy as np

    ship(spark)
    field = sorted(strengths, key=lambda x: (-x[1], x[0]))
    size = 1 << (len(field) - 1).bit_length() if len(field) > 1 else 1
    if size > 64:
        raise ValueError("a bracket holds at most 64 teams")
    seeds = [0]
    while len(seeds) < size:
        seeds = [s for x in seeds for s in (x, 2 * len(seeds) - 1 - x)]
    bracket = [field[s] if s < len(field) else None for s in seeds]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[int, str, int]] = []
            for it in batch["id"]:
                rng = np.random.default_rng((seed, int(it)))
                alive, stage, reached = list(bracket), 0, {t[0]: 0 for t in field}
                while len(alive) > 1:
                    stage += 1
                    nxt = []
                    for x, y in zip(alive[::2], alive[1::2]):
                        if x is None or y is None:
                            win = x or y
                        else:
                            win = x if rng.random() < 1 / (1 + 10 ** ((y[1] - x[1]) / SCALE)) else y
                        nxt.append(win)
                        if win is not None:
                            reached[win[0]] = stage
                    alive = nxt
                out.extend((int(it), t, s) for t, s in reached.items())
            yield pd.DataFrame(out, columns=["iteration", "team", "stage"])

    return spark.range(0, iterations, 1, partitions).mapInPandas(run, SIM_SCHEMA)


def stage_shares(runs: DataFrame, stages: int) -> DataFrame:
    """``team`` with the share of iterations in which it reached each stage."""
    n = runs.select("iteration").distinct().count()
    cols = [(F.sum(F.when(F.col("stage") >= s, 1).otherwise(0)) / n).alias(f"p_stage{s}") for s in range(1, stages + 1)]
    return runs.groupBy("team").agg(*cols)
