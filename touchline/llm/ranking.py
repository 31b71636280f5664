"""One ranking with strengths from pairwise results.

Iterative Luce spectral ranking: from the strengths of the last round the rates
of a Markov chain follow, ``w_ij / (p_i + p_j)`` from loser ``j`` to winner
``i``; its stationary distribution is the next vector of strengths. The fixed
point is the maximum-likelihood solution of the Bradley-Terry model. A draw is
half a win for each side.

Results shrink to one weight for each ordered pair of items before anything
else, combined on the map side first, so neither the number of matches nor an
item that plays in a third of them matters afterwards. If the pairs fit a bound
(``MAX_LOCAL_PAIRS``, checked by a count) the chain is solved in one process;
otherwise the connectivity test, the rates and each step of the stationary
distribution are joins over the pairs with the lineage cut. Both ways end at the
same maximum; one that doesn't converge raises instead of returning less.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from touchline.llm.canon import UNMATCHED, team_matches
from touchline.session import cut, release, scale_partitions

#: Ordered pairs solved in one process, at most about 50 MB.
MAX_LOCAL_PAIRS = 1_000_000
#: Items for which the stationary distribution is solved directly.
MAX_DENSE = 1_500
PRIOR = 0.5


def pair_weights(results: DataFrame, winner: str, loser: str, weight: str) -> DataFrame:
    """``winner, loser, w``: summed weights of each ordered pair.

    Rows with a null side, with an item against itself or without a positive
    weight say nothing and are left out.
    """
    rows = results.select(F.col(winner).alias("winner"), F.col(loser).alias("loser"), F.col(weight).cast("double").alias("w"))
    return rows.where("winner <> loser and w > 0").groupBy("winner", "loser").agg(F.sum("w").alias("w"))


def strongly_connected(n: int, tail: np.ndarray, head: np.ndarray) -> bool:
    """Whether every item reaches every other along wins; only then the
    likelihood has a maximum."""

    def reached(a: np.ndarray, b: np.ndarray) -> bool:
        seen = np.zeros(n, bool)
        seen[0] = True
        while True:
            more = np.unique(b[seen[a] & ~seen[b]])
            if not len(more):
                return bool(seen.all())
            seen[more] = True

    return n < 2 or (reached(tail, head) and reached(head, tail))


def _left(change: float, before: float) -> float:
    """What is left of an error that shrinks by the ratio of its last two changes."""
    ratio = min(change / before, 0.999999) if before > 0 else 0.5
    return change * max(1.0, ratio / (1 - ratio))


def stationary(n: int, frm: np.ndarray, to: np.ndarray, rate: np.ndarray, start: np.ndarray, tol: float = 1e-12, steps: int = 1_000_000) -> np.ndarray:
    """Stationary distribution of a chain with the given rates."""
    if n <= MAX_DENSE:
        q = np.zeros((n, n))
        np.add.at(q, (frm, to), rate)
        np.fill_diagonal(q, q.diagonal() - q.sum(axis=1))
        a = q.T.copy()
        a[-1, :] = 1.0
        b = np.zeros(n)
        b[-1] = 1.0
        return np.maximum(np.linalg.solve(a, b), 1e-300)
    out = np.bincount(frm, rate, n)
    jump, y, before = rate / out[frm], start * out, 0.0
    for _ in range(steps):
        new = (y + np.bincount(to, y[frm] * jump, n)) / 2
        change = float(np.abs(new / y - 1).max())
        y = new
        if _left(change, before) <= tol:
            p = y / out
            return p / p.sum()
        before = change
    raise RuntimeError(f"the stationary distribution was not reached in {steps} steps")


def solve_local(n: int, winner: np.ndarray, loser: np.ndarray, w: np.ndarray, tol: float = 1e-10, rounds: int = 10_000) -> np.ndarray:
    """Strengths of items ``0..n-1``, with mean log 0."""
    p = np.full(n, 1.0 / n)
    for _ in range(rounds):
        new = stationary(n, loser, winner, w / (p[winner] + p[loser]), p)
        done = np.abs(np.log(new) - np.log(p)).max() < tol
        p = new
        if done:
            return np.exp(np.log(p) - np.log(p).mean())
    raise RuntimeError(f"the strengths did not converge in {rounds} rounds")


def strongly_connected_distributed(pairs: DataFrame, items: DataFrame) -> bool:
    """Whether one item reaches all others along wins, and is reached by them.

    One join a step from the items of the last step, as many steps as the graph
    is wide; only counts come to the driver.
    """
    total, first = items.agg(F.count("*"), F.min("item")).first()
    for a, b in (("loser", "winner"), ("winner", "loser")):
        seen = front = cut(items.where(F.col("item") == F.lit(first)))
        held = 1
        while held < total:
            ahead = pairs.join(front.select(F.col("item").alias(a)), a).select(F.col(b).alias("item")).distinct()
            new = cut(ahead.join(seen, "item", "left_anti"))
            more = new.count()
            if not more:
                return False
            old, seen, front = seen, cut(seen.union(new)), new
            release(old)
            held += more
    return True


def solve_distributed(pairs: DataFrame, items: DataFrame, tol: float = 1e-8, rounds: int = 10_000, unrolled: int = 4) -> DataFrame:
    """``item, strength`` with mean log 0, each step as joins.

    A round fixes the rates by the last strengths. Its stationary distribution is
    found by steps of the lazy jump chain: every item keeps half of its weight and
    passes on the other half, so the chain has no period. The distribution of a
    round is found to a tenth of what the last round changed, at the end to
    ``tol``. Strengths are one row an item; what comes to the driver is the
    largest change.
    """
    pairs = cut(pairs)
    state, moved = cut(items.select("item", F.lit(1.0).alias("p"))), 1.0
    for _ in range(rounds):
        rated = pairs.join(state.select(F.col("item").alias("winner"), F.col("p").alias("pw")), "winner").join(
            state.select(F.col("item").alias("loser"), F.col("p").alias("pl")), "loser"
        ).select(F.col("loser").alias("frm"), F.col("winner").alias("to"), (F.col("w") / (F.col("pw") + F.col("pl"))).alias("rate"))
        rated = cut(rated)
        out = rated.groupBy(F.col("frm").alias("item")).agg(F.sum("rate").alias("out"))
        y = cut(state.join(out, "item").select("item", "p", "out", (F.col("p") * F.col("out")).alias("y"), F.lit(0.0).alias("last")))
        before, near = 0.0, max(tol, moved / 10)
        for _ in range(rounds):
            new = y
            for _ in range(unrolled):
                flow = rated.join(new.select(F.col("item").alias("frm"), (F.col("y") / F.col("out")).alias("share")), "frm").groupBy(F.col("to").alias("item")).agg(
                    F.sum(F.col("rate") * F.col("share")).alias("inflow")
                )
                new = new.join(flow, "item").select("item", "p", "out", ((F.col("y") + F.col("inflow")) / 2).alias("n"), F.col("y").alias("last")).withColumnRenamed("n", "y")
            new = cut(new)
            change = new.agg(F.max(F.abs(F.col("y") / F.col("last") - 1))).first()[0] or 0.0
            release(y)
            y = new
            # the change of one step, and its ratio to that of ``unrolled`` steps ago
            ratio = min((change / before) ** (1 / unrolled), 0.999999) if before > 0 else 0.9
            if change * max(1.0, ratio / (1 - ratio)) <= near:
                break
            before = change
        else:
            raise RuntimeError(f"the stationary distribution was not reached in {rounds * unrolled} steps")
        strength = F.col("y") / F.col("out")
        mean, base = y.agg(F.avg(F.log(strength)), F.avg(F.log("p"))).first()
        new_state = cut(y.select("item", (strength / F.exp(F.lit(mean))).alias("p"), (F.col("p") / F.exp(F.lit(base))).alias("q")))
        moved = new_state.agg(F.max(F.abs(F.log("p") - F.log("q")))).first()[0] or 0.0
        for done in (rated, y, state):
            release(done)
        state = new_state
        if moved < tol * 10 and near <= tol:
            return state.select("item", F.col("p").alias("strength"))
    raise RuntimeError(f"the strengths did not converge in {rounds} rounds")


def rank_items(
    results: DataFrame,
    winner: str = "winner",
    loser: str = "loser",
    weight: str = "w",
    prior: float = PRIOR,
    max_local_pairs: int = MAX_LOCAL_PAIRS,
) -> DataFrame:
    """``item, strength, rank`` of all items, from weighted results.

    Where some items never lose to the rest, or were never compared with it, no
    maximum exists; then each item gets ``prior`` wins and losses against one
    phantom, which isn't returned. Equal strengths are ranked by item. Null
    sides and other columns are ignored; no results give no items.
    """
    spark = results.sparkSession
    pairs = cut(pair_weights(results, winner, loser, weight))
    kind = pairs.schema["winner"].dataType.simpleString()
    if pairs.count() <= max_local_pairs:
        table = pairs.toPandas()
        names = np.unique(np.concatenate([table["winner"], table["loser"]])) if len(table) else np.array([])
        win, lose = np.searchsorted(names, table["winner"]), np.searchsorted(names, table["loser"])
        w, n = table["w"].to_numpy(float), len(names)
        if n and not strongly_connected(n, lose, win):
            every, phantom = np.arange(n), np.full(n, n)
            win, lose = np.concatenate([win, every, phantom]), np.concatenate([lose, phantom, every])
            w = np.concatenate([w, np.full(2 * n, prior)])
            strengths = solve_local(n + 1, win, lose, w)[:n]
        else:
            strengths = solve_local(n, win, lose, w) if n else np.zeros(0)
        rows = [(x.item() if hasattr(x, "item") else x, float(s)) for x, s in zip(names, strengths)]
        scored = spark.createDataFrame(rows, f"item {kind}, strength double")
    else:
        text = cut(pairs.select(F.col("winner").cast("string").alias("winner"), F.col("loser").cast("string").alias("loser"), "w"))
        items = cut(text.select(F.col("winner").alias("item")).union(text.select("loser")).distinct())
        if strongly_connected_distributed(text, items):
            scored = solve_distributed(text, items)
        else:
            # greater than every item, so it is none of them
            phantom = F.lit((items.agg(F.max("item")).first()[0] or "") + "\U0010ffff")
            anchored = text.unionByName(items.select(F.col("item").alias("winner"), phantom.alias("loser"), F.lit(prior).alias("w"))).unionByName(
                items.select(phantom.alias("winner"), F.col("item").alias("loser"), F.lit(prior).alias("w"))
            )
            everyone = items.union(items.limit(1).select(phantom))
            scored = solve_distributed(anchored, everyone).where(F.col("item") != phantom)
        scored = scored.select(F.col("item").cast(kind).alias("item"), "strength")
    return add_rank(scored)


def add_rank(scored: DataFrame) -> DataFrame:
    """Global position by falling strength, without one task that sorts all.

    Rows are range-partitioned by strength; the partitions' sizes, one number
    each, give the offset of each partition's own numbering.
    """
    spark = scored.sparkSession
    placed = cut(
        scored.repartitionByRange(scale_partitions(spark), F.desc("strength"), F.asc("item"))
        .sortWithinPartitions(F.desc("strength"), "item")
        .withColumn("_part", F.spark_partition_id())
    )
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, size in sizes:
        offsets.append((part, total))
        total += size
    shift = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))  # one row a partition
    order = Window.partitionBy("_part").orderBy(F.desc("strength"), "item")
    return placed.join(shift, "_part").select("item", "strength", (F.row_number().over(order) + F.col("_before")).cast("int").alias("rank"))


_SIDES = r"(?i)^\s*(.+?)\s+(?:vs\.?|v\.?|-|–|—)\s+(.+?)\s*$"
_SCORE = r"^\D*(\d+)\s*[-–—:]\s*(\d+)"
_PENS = r"(?i)\((\d+)\s*[-–—:]\s*(\d+)\s*p"


def match_outcomes(matches: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """``a, b, half_a``: one row a match, ``half_a`` 0, 1 or 2 half wins of ``a``.

    ``actual`` counts, else the score with its shoot-out. Reports of one match
    (same day, same two teams, from either side) are one; of reports that
    disagree the one loaded last counts. Matches of names that mean no team, of
    a team with itself, or without any result are left out.
    """
    sides = matches.select(
        "match_no", "match_date", "loaded_at", "score",
        F.regexp_extract("match", _SIDES, 1).alias("left"), F.regexp_extract("match", _SIDES, 2).alias("right"),
        F.upper(F.substring(F.trim("actual"), 1, 1)).alias("told"),
    )
    names = sides.select(F.explode(F.array("left", "right")).alias("typed")).where("typed <> ''")
    codes = cut(team_matches(names, "typed", teams, aliases).where(F.col("code") != UNMATCHED).select("typed", "code"))
    goals = [F.regexp_extract("score", _SCORE, i).try_cast("int") for i in (1, 2)]
    pens = [F.regexp_extract("score", _PENS, i).try_cast("int") for i in (1, 2)]
    by_goals = F.when(goals[0] > goals[1], "H").when(goals[0] < goals[1], "A").when(pens[0] > pens[1], "H").when(pens[0] < pens[1], "A").when(goals[0] == goals[1], "D")
    result = F.coalesce(F.when(F.col("told").isin("H", "D", "A"), F.col("told")), by_goals)
    known = (
        sides.withColumn("result", result)
        .where(F.col("result").isNotNull())
        .join(codes.select(F.col("typed").alias("left"), F.col("code").alias("x")), "left")
        .join(codes.select(F.col("typed").alias("right"), F.col("code").alias("y")), "right")
        .where("x <> y")
    )
    first = F.least("x", "y")
    points = F.when(F.col("result") == "D", 1).when((F.col("result") == "H") == (F.col("x") == first), 2).otherwise(0)
    return (
        known.select("match_date", first.alias("a"), F.greatest("x", "y").alias("b"), F.struct("loaded_at", "match_no", points.alias("half_a")).alias("s"))
        .groupBy("match_date", "a", "b")
        .agg(F.max("s").alias("s"))
        .select("match_date", "a", "b", F.col("s.half_a").alias("half_a"))
    )


def rank_teams(matches: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """``item, strength, rank`` of the national teams."""
    games = match_outcomes(matches, teams, aliases)
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("winner"), F.col("b").alias("loser"), (F.col("half_a") / 2).alias("w")),
        F.struct(F.col("b").alias("winner"), F.col("a").alias("loser"), (1 - F.col("half_a") / 2).alias("w")),
    ))
    return rank_items(games.select(ends.alias("e")).select("e.*"))
