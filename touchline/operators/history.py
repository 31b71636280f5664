"""Full history of changing attributes, built from snapshots.

Tree-reduction coalescing: the last snapshot of each entity and day becomes a
unit interval; neighbouring runs of an entity are merged in rounds, ``fan_in``
blocks at a time, wherever the end of one and the start of the next carry an
equal payload. An entity with n days takes ``log(n) / log(fan_in)`` rounds.

The group of one entity is bounded by the number of distinct days, since
snapshots of a day are reduced to one before anything is gathered (map side
first), so an entity with a third of all rows is no hot spot. All rounds keep
the partitioning by entity: there are two shuffles, however many rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

FAN_IN = 16


def known(column: Column, kind: str) -> Column:
    """The value, or null where it is blank; text loses case and extra space."""
    if kind != "string":
        return column
    spare = F.lower(F.trim(F.regexp_replace(column, r"[\s ]+", " ")))
    return F.when(spare != "", spare)


def last_of_day(df: DataFrame, entity: str, day: str, attributes: Sequence[str], loaded: Sequence[str]) -> DataFrame:
    """One row for each entity and day: the snapshot loaded last.

    Ties of all ``loaded`` columns are settled by the payload itself, so the
    result doesn't depend on the order of rows.
    """
    names = [f"_raw{i}" for i in range(len(attributes))]
    rows = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(
        F.col(entity).alias("_e"),
        F.col(day).alias("_d"),
        F.struct(*[F.col(c) for c in loaded], *[F.col(c).alias(n) for c, n in zip(attributes, names)]).alias("_s"),
    )
    return rows.groupBy("_e", "_d").agg(F.max("_s").alias("_s")).select("_e", "_d", *[F.col(f"_s.{n}") for n in names])


def most_units(df: DataFrame, entity: str, day: str) -> int:
    """A bound of the units of one entity: the days between the first and the
    last of all, or the largest count where ``day`` is no date."""
    if dict(df.dtypes)[day] == "date":
        first, last = df.agg(F.min(day), F.max(day)).first()
        return 0 if first is None else (last - first).days + 1
    counts = df.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).select(entity, day).distinct().groupBy(entity).count()
    return counts.agg(F.max("count")).first()[0] or 0


def _merge(left: Column, right: Column) -> Column:
    """Two neighbouring lists of runs; the runs that touch become one if equal."""
    a, b = F.element_at(left, -1), F.element_at(right, 1)
    joined = F.struct(a["start"].alias("start"), b["last"].alias("last"), a["key"].alias("key"), a["shown"].alias("shown"))
    return F.when(F.size(left) == 0, right).when(
        a["key"].eqNullSafe(b["key"]),
        F.concat(F.slice(left, 1, F.size(left) - 1), F.array(joined), F.slice(right, 2, F.size(right))),
    ).otherwise(F.concat(left, right))


def attribute_history(
    df: DataFrame,
    entity: str,
    day: str,
    attributes: Sequence[str],
    loaded: Sequence[str],
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``entity, valid_from, valid_to, is_current`` and the attributes.

    A version is a longest run of days in which no attribute changes. Null and
    blank values say nothing new: they carry the last known value on, and at the
    start of a history the first one known. Text is compared without case and
    extra space and shown as first written in the version. ``valid_to`` is the
    last day before the next version, null for the current one. Rows without an
    entity or a day are left out, repeated and re-delivered rows change nothing,
    of ties in ``loaded`` the greatest payload counts, other columns are
    ignored, and an empty table gives an empty result.
    """
    kinds = dict(df.dtypes)
    names = [f"_raw{i}" for i in range(len(attributes))]
    most = most_units(df, entity, day)
    order = Window.partitionBy("_e").orderBy("_d")
    before, after = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    days = last_of_day(df, entity, day, attributes, loaded)
    shown = []
    for name, attribute in zip(names, attributes):
        value = F.when(known(F.col(name), kinds[attribute]).isNotNull(), F.col(name))
        shown.append(F.coalesce(F.last(value, ignorenulls=True).over(before), F.first(value, ignorenulls=True).over(after)).alias(name))
    units = days.select("_e", "_d", (F.row_number().over(order) - 1).alias("_block"), *shown)
    key = F.struct(*[known(F.col(n), kinds[a]).alias(n) for n, a in zip(names, attributes)])
    runs = units.select(
        "_e", "_block", F.array(F.struct(F.col("_d").alias("start"), F.col("_d").alias("last"), key.alias("key"), F.struct(*names).alias("shown"))).alias("runs")
    )
    empty = F.array().cast(runs.schema["runs"].dataType)
    blocks = 1
    while blocks < most:
        blocks *= fan_in
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_block", "runs"))), lambda x: x["runs"])
        runs = (
            runs.groupBy("_e", F.expr(f"cast(_block div {fan_in} as int)").alias("_up"))
            .agg(F.aggregate(ordered, empty, _merge).alias("runs"))
            .withColumnRenamed("_up", "_block")
        )
    # versions follow each other, so the end of one is the start of the next
    flat = runs.select("_e", F.col("runs"), F.posexplode("runs").alias("_i", "_r"))
    follows = F.try_element_at("runs", F.col("_i") + 2)["start"]
    return flat.select(
        F.col("_e").alias(entity),
        F.col("_r.start").alias("valid_from"),
        F.date_sub(follows, 1).alias("valid_to") if kinds[day] == "date" else follows.alias("valid_to"),
        follows.isNull().alias("is_current"),
        *[F.col("_r.shown")[n].alias(a) for n, a in zip(names, attributes)],
    )
