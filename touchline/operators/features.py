"""Feature aggregates: event logs to player and team statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from touchline.operators.relational import keep_best

SHRINK_GAMES, SHRINK_UNDER, PRIOR_RATE = 500.0, 180.0, 0.15
LEAGUE_CAP = 6.0


def event_counters(events: DataFrame, keys: Sequence[str], rules: Mapping[str, Column], sums: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """All counters of an event log in one pass.

    ``rules`` count where a condition holds, ``sums`` add a value there. A null
    condition counts as false, so a missing flag is no hit.
    """
    counts = [F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)).alias(n) for n, c in rules.items()]
    totals = [F.coalesce(F.sum(F.when(c, v)), F.lit(0.0)).alias(n) for n, (c, v) in sums.items()]
    return events.groupBy(*keys).agg(*counts, *totals, F.count("*").alias("n_events"))


def minutes_span(events: DataFrame, keys: Sequence[str], minute: str) -> DataFrame:
    """Minutes from first to last event, at least 1."""
    return events.groupBy(*keys).agg(F.greatest(F.lit(1), F.max(minute) - F.min(minute) + 1).cast("bigint").alias("minutes"))


def opponent_credited(matches: DataFrame, home: str, away: str, for_home: str, for_away: str) -> DataFrame:
    """What the opponents made against each team."""
    sides = F.explode(F.array(F.struct(F.col(home).alias("team"), F.col(for_away).alias("v")), F.struct(F.col(away).alias("team"), F.col(for_home).alias("v")))).alias("s")
    return matches.select(sides).groupBy(F.col("s.team").alias("team")).agg(F.sum("s.v").alias("conceded"), F.count("*").alias("n_matches"))


def sum_numeric(df: DataFrame, keys: Sequence[str], distinct: str, into: str) -> DataFrame:
    """Sum of every numeric column by key and a distinct count of one column."""
    numeric = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") and c not in keys and c != distinct]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numeric], F.countDistinct(distinct).alias(into))


def per_90(value: Column, minutes: Column, digits: int = 4) -> Column:
    return F.round(value / F.greatest(minutes, F.lit(1)) * 90, digits)


def across_seasons(df: DataFrame, player: str, season: str, team: str, minutes: Column) -> DataFrame:
    """Minutes over all stints, the club of the stint with the fewest minutes
    (``last_team``, as the ported code had it) and of the newest season."""
    stints = df.groupBy(player, season, team).agg(F.sum(minutes).alias("m"))
    big = F.lit(1 << 60)
    low = F.struct(F.coalesce("m", big).alias("m"), F.col(season).isNull().alias("n"), F.col(season).alias("s"), F.col(team).alias("t"))
    # newest season first, then most minutes, then the name: min_by on negated keys
    newest = F.struct(F.col(season).isNull().alias("n"), (-F.coalesce(F.col(season).try_cast("int"), F.lit(0))).alias("s"), F.col("m").isNull().alias("mn"), (-F.coalesce("m", F.lit(0))).alias("m"), F.col(team).alias("t"))
    return stints.groupBy(player).agg(F.sum("m").alias("minutes"), F.count("*").alias("n_stints"), F.min(low)["t"].alias("last_team"), F.min(newest)["t"].alias("newest_team"))


def with_quantile_fallback(df: DataFrame, value: str, q: float) -> DataFrame:
    """``rating``: the value, or the exact ``q`` quantile of all where unknown."""
    fill = df.agg(F.percentile(value, F.lit(q)).alias("_q"))
    return df.crossJoin(F.broadcast(fill)).select(*df.columns, F.coalesce(value, "_q").alias("rating"), F.col(value).isNull().alias("fallback"))  # one row


def describe(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    qs = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = df.agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("least"), qs.alias("q"), F.max(c).alias("most"))
    return one.select("n", "mean", "std", "least", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "most")


def shrunk(rate: Column, minutes: Column) -> Column:
    """A rate pulled to the prior where fewer than ``SHRINK_UNDER`` minutes back it."""
    pulled = (minutes * rate + SHRINK_GAMES * PRIOR_RATE) / (minutes + SHRINK_GAMES)
    return F.when(minutes < SHRINK_UNDER, pulled).otherwise(rate)


def blend(club: Column, national: Column, club_weight: float = 0.6) -> Column:
    """Weighted mean of two rates, the other one where one is unknown."""
    both = club * club_weight + national * (1 - club_weight)
    return F.coalesce(both, club, national)


def league_adjusted(rate: Column, league: Column, factors: Mapping[str, float], default: float, cap: float = LEAGUE_CAP) -> Column:
    table = F.create_map(*[F.lit(x) for kv in factors.items() for x in kv])
    return F.least(rate * F.coalesce(table[league], F.lit(default)), F.lit(cap))


def squad_ratings(players: DataFrame, team: str, player: str, rating: str, top: int, floor: int) -> DataFrame:
    """Mean of a team's best; the first quartile of all teams where fewer than
    ``floor`` players are rated."""
    from touchline.operators.relational import top_n_mean

    rated = top_n_mean(players, [team], rating, [player], top, "mean_top")
    teams = players.select(team).distinct().join(rated, team, "left")
    usable = teams.withColumn("mean_top", F.when(F.col("n_used") >= floor, F.col("mean_top")))
    return with_quantile_fallback(usable, "mean_top", 0.25).select(team, "rating", "fallback", F.coalesce("n_used", F.lit(0)).alias("n_used"))


def pedigree(records: DataFrame, player: str, team: str, value: str, minutes: str, before: str, cutoff: str) -> DataFrame:
    """Totals before a cutoff day; a record at or after it is an error upstream,
    so the number of such records comes along for the leakage check."""
    leak = F.sum(F.when(F.col(before) >= F.lit(cutoff).cast("date"), 1).otherwise(0))
    return records.groupBy(player, team).agg(F.sum(value).alias("total"), F.sum(minutes).alias("minutes"), per_90(F.sum(value), F.sum(minutes)).alias("per_90"), leak.alias("leaks"))


def keep_best_season(df: DataFrame, player: str, minutes: str, tie: Sequence[str]) -> DataFrame:
    return keep_best(df, [player], [F.desc_nulls_last(minutes), *[F.asc_nulls_last(t) for t in tie]])
