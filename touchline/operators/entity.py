"""Master data: resolving source rows to a master, and keeping the master."""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from touchline.functions.text import with_bare, with_ratio
from touchline.operators.relational import top_n
from touchline.session import cut, scale_partitions, ship

FUZZY, TOP_SCAN = 90.0, 10


def key_counts(master: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """For each key of the master: how many entities have it, and one of them."""
    known = master
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.countDistinct(entity).alias("_n"), F.min(entity).alias("_id"))


def resolve_in_tiers(rows: DataFrame, master: DataFrame, entity: str, tiers: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Add ``match_id, match_tier, match_reason`` by the first tier with an answer.

    A tier is a name and the columns that must agree. One entity in the master is
    a match; several are an ambiguity, which ends the search; none passes on to
    the next tier. Each tier is one join with a table of one row a key, so
    nothing fans out. Null keys never match.
    """
    out = rows.withColumns({"match_id": F.lit(None).cast(master.schema[entity].dataType), "match_tier": F.lit(None).cast("string"), "match_reason": F.lit(None).cast("string")})
    for name, keys in tiers:
        counts = key_counts(master, keys, entity)
        open_ = F.col("match_reason").isNull()
        hit = open_ & F.col("_n").isNotNull()
        out = (
            out.join(counts, list(keys), "left")
            .withColumn("match_id", F.when(hit & (F.col("_n") == 1), F.col("_id")).otherwise(F.col("match_id")))
            .withColumn("match_tier", F.when(hit & (F.col("_n") == 1), F.lit(name)).otherwise(F.col("match_tier")))
            .withColumn("match_reason", F.when(hit & (F.col("_n") == 1), F.lit("unique")).when(hit, F.concat(F.lit(f"ambiguous_{name}_"), F.col("_n").cast("string"))).otherwise(F.col("match_reason")))
            .drop("_n", "_id")
        )
    return out.withColumn("match_reason", F.coalesce("match_reason", F.lit("unmatched")))


def split_matches(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matched rows and the quarantine; an empty part keeps the schema."""
    return resolved.where(F.col("match_id").isNotNull()), resolved.where(F.col("match_id").isNull())


def _words_of(column: Column, kind: str) -> Column:
    words = F.filter(F.split(column, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")
    return F.array_sort(F.array_distinct(words) if kind == "set" else words)


def _grams(word: str) -> list[str]:
    """Three letters each of a word with the space before it."""
    padded = " " + word
    return [padded[i : i + 3] for i in range(max(1, len(padded) - 2))]


class SetKeys:
    """Keys by which two names of a block meet if their set ratio can reach ``least``.

    A ratio of whole names leaves ``room`` single-letter edits, each of which spoils
    one of the disjoint grams of the left name at most, so of one gram more the right
    name holds one. A ratio with the shared words leaves a proven length of words
    out, so one of the rarest words beyond that length is shared. ``counts`` of the
    right side's grams, in buckets, choose which grams and words stand for a name;
    they decide how few pairs meet, never which are found.
    """

    BUCKETS = 1 << 16

    def __init__(self, counts: np.ndarray, least: float):
        self.counts, self.room, self.spare = counts, 2 * (100 - least) / least, (200 - 2 * least) / (200 - least)
        self.known: dict[str, int] = {}

    def cost(self, gram: str) -> int:
        found = self.known.get(gram)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[gram] = 1 + int(self.counts[zlib.crc32(gram.encode()) % self.BUCKETS])
        return found

    def rare(self, words: list[str], length: int) -> tuple[set[str], set[str]]:
        """A gram for each of the rarest words, of which one is shared, and for the others."""
        marks = sorted((self.cost(g), g, w) for w in words for g in [min(_grams(w), key=lambda g: (self.cost(g), g))])
        first, rest, spent = set(), set(), 0
        for _, gram, word in marks:
            (first if spent <= self.spare * length + 1e-6 else rest).add(gram)
            spent += len(word) + 1
        return first, rest

    def left(self, name: str) -> list[str]:
        words = name.split(" ")
        first, rest = self.rare(words, len(name))
        need = math.floor(self.room * len(name) + 1e-6) + 1
        # best[k]: least cost of k disjoint grams so far, with the grams
        best: list[list[tuple[int, tuple]]] = [[(0, ())]]
        for word in words:
            padded = " " + word
            for end in range(1, len(padded) + 1):
                before = best[-1]
                row = list(before)
                if end >= 3:
                    gram, cost = padded[end - 3 : end], self.cost(padded[end - 3 : end])
                    for k, (spent, taken) in enumerate(best[-3][:need]):
                        if k + 1 == len(row):
                            row.append((spent + cost, (gram, taken)))
                        elif spent + cost < row[k + 1][0]:
                            row[k + 1] = (spent + cost, (gram, taken))
                best.append(row)
        if len(best[-1]) <= need:
            first.add("*")  # too many short words: meets its whole block
        else:
            taken = best[-1][need][1]
            while taken:
                first.add(taken[0])
                taken = taken[1]
        return [*first, *("=" + g for g in rest)]

    def right(self, name: str) -> list[str]:
        words = name.split(" ")
        return [*{g for w in words for g in _grams(w)}, *("=" + g for g in self.rare(words, len(name))[0]), "*"]


def _bucket(column: Column) -> Column:
    return F.pmod(F.crc32(F.encode(column, "utf-8")), F.lit(SetKeys.BUCKETS)).cast("int")


def _set_pairs(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """``_b, _s, _t``: pairs of names, as sorted words, that may reach ``least``.

    All that comes to the driver are counts of a fixed number of buckets.
    """
    spark = x.sparkSession
    ship(spark)
    # blocks of one side only have no pairs
    blocks = x.select("_b", F.lit(1).alias("k")).union(y.select("_b", F.lit(2))).distinct().groupBy(_bucket(F.col("_b")).alias("bucket")).agg(F.bit_or("k").alias("k")).where("k = 3").toPandas()
    flags = np.zeros(SetKeys.BUCKETS // 32, dtype=np.int64)
    np.bitwise_or.at(flags, blocks["bucket"].to_numpy(int) // 32, 1 << (blocks["bucket"].to_numpy(np.int64) % 32))
    listed, at = f"array({', '.join(f'{v}L' for v in flags.tolist())})", f"cast(pmod(crc32(encode(_b, 'utf-8')), {SetKeys.BUCKETS}) as int)"
    both = F.expr(f"get({listed}, shiftright({at}, 5)) & shiftleft(1L, pmod({at}, 32)) <> 0")
    # one row a name; its keys are chosen once
    sides = [df.where(both).groupBy(n).agg(F.collect_set("_b").alias("_blocks")) for df, n in ((x, "_s"), (y, "_t"))]
    grams = F.flatten(F.transform(F.split("_t", " "), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 1)), lambda i: F.concat(F.lit(" "), w).substr(i, F.lit(3)))))
    table = y.where(both).select(F.explode(grams).alias("gram")).groupBy(_bucket(F.col("gram")).alias("bucket")).count().toPandas()
    counts = np.zeros(SetKeys.BUCKETS, dtype=np.int64)
    counts[table["bucket"].to_numpy(int)] = table["count"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def keys(side: str):
        @pandas_udf("array<string>")
        def run(s: pd.Series) -> pd.Series:
            choose = getattr(SetKeys(shared.value, least), side)
            return pd.Series([choose(n) for n in s], dtype=object)

        return run.asNondeterministic()  # else filters of what follows choose them again

    def spread(df: DataFrame, name: str, side: str, block: str, mask: str, size: str) -> DataFrame:
        # in one number the kinds of letters, and above them the words
        letters = F.expr(f"aggregate(split({name}, ''), 0L, (m, i) -> m | shiftleft(1L, pmod(ascii(i), 32)))")
        words = F.expr(f"aggregate(split({name}, ' '), 0L, (m, i) -> m | shiftleft(1L, 32 + pmod(hash(i), 32)))")
        keyed = df.select(name, letters.bitwiseOR(words).alias(mask), F.length(name).alias(size), "_blocks", keys(side)(name).alias("_keys"))
        rows = keyed.select(name, mask, size, "_keys", F.explode("_blocks").alias(block)).select(name, mask, size, block, F.explode("_keys").alias("_k"))
        return rows.select(F.xxhash64(block, "_k").alias("_key"), name, mask, size, block)

    met = spread(sides[0], "_s", "left", "_b", "_m", "_i").join(spread(sides[1], "_t", "right", "_c", "_n", "_j"), "_key")
    room = f"cast(floor((_i + _j) * {(100 - least) / 100!r}D + 1e-6D) as int)"
    spare = (200 - 2 * least) / (200 - least)
    fewer = lambda m, n, size: f"bit_count({m} & ~{n} & 4294967295L) <= {size} * {spare!r}D + 1e-6D"
    common = "length(array_join(array_intersect(split(_s, ' '), split(_t, ' ')), ' '))"
    within = f"shiftrightunsigned(_m & _n, 32) <> 0 and ({fewer('_m', '_n', '_i')} or {fewer('_n', '_m', '_j')}) and {common} > 0 and {common} * {200 - least!r}D + 1e-6D >= {least!r}D * least(_i, _j)"
    rest = lambda s, t: f"array_join(array_except(split({s}, ' '), split({t}, ' ')), ' ')"
    close = f"abs(_i - _j) <= {room} and bit_count((_m ^ _n) & 4294967295L) <= {room} and levenshtein({rest('_s', '_t')}, {rest('_t', '_s')}, {room}) >= 0"
    return met.where(F.expr(f"_b = _c and (({close}) or ({within}))")).select("_b", "_s", "_t").distinct()


def fuzzy_within(left: DataFrame, right: DataFrame, block: str, a: str, b: str, left_key: str, right_key: str, least: float = FUZZY, keep: int | None = TOP_SCAN, kind: str = "set") -> DataFrame:
    """``left_key, right_key, score``: best similar names inside a block, all of them
    where ``keep`` is None.

    Both ratios look at sorted words, so each name of that form counts once in its
    block. Set ratios meet by :class:`SetKeys`, which lose no pair that reaches
    ``least``; sort ratios compare every pair of the block. The JVM drops only what
    can't reach ``least``: a ratio of r percent leaves no more edits than the rest of
    both lengths, and each kind of letter that only one name has is an edit.
    """
    def side(df: DataFrame, key: str, name: str, k: str, s: str) -> DataFrame:
        words = F.array_join(_words_of(F.col(name), kind), " ")
        named = df.where(F.col(name).isNotNull() & F.col(block).isNotNull()).select(F.col(block).alias("_b"), F.col(key).alias(k), words.alias(s))
        return (named.where(F.col(s) != "") if kind == "set" and least > 0 else named).distinct()

    x, y = side(left, left_key, a, "_l", "_s"), cut(side(right, right_key, b, "_r", "_t"))
    if kind == "set" and least > 0:
        pairs = _set_pairs(x.select("_b", "_s").distinct(), y.select("_b", "_t").distinct(), least)
    else:
        room = f"cast(floor((length(_s) + length(_t)) * {(100 - least) / 100!r}D + 1e-6D) as int)"
        close = F.expr(f"bit_count(_m ^ _n) <= {room} and abs(length(_s) - length(_t)) <= {room} and levenshtein(_s, _t) <= {room}") if kind == "sort" else F.lit(True)
        bits = lambda s: F.expr(f"aggregate(split({s}, ''), 0L, (m, i) -> m | shiftleft(1L, pmod(ascii(i), 64)))")
        pairs = x.select("_b", "_s").distinct().withColumn("_m", bits("_s")).join(y.select("_b", "_t").distinct().withColumn("_n", bits("_t")), "_b").where(close).select("_b", "_s", "_t")
    scored = with_ratio(pairs, "_s", "_t", "score", kind).where(F.col("score") >= least)
    best = scored.join(x, ["_b", "_s"]).join(y, ["_b", "_t"]).groupBy("_l", "_r").agg(F.max("score").alias("score"))
    best = top_n(best, ["_l"], [F.desc("score"), F.asc("_r")], keep) if keep is not None else best
    return best.select(F.col("_l").alias(left_key), F.col("_r").alias(right_key), F.round("score", 4).alias("score"))


def best_pairing(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are the best of both their sides, so nobody is claimed twice."""
    wl = Window.partitionBy(left).orderBy(F.desc(score), F.asc(right))
    wr = Window.partitionBy(right).orderBy(F.desc(score), F.asc(left))
    return pairs.withColumn("_l", F.row_number().over(wl)).withColumn("_r", F.row_number().over(wr)).where("_l = 1 and _r = 1").drop("_l", "_r")


def resolve_fuzzy(resolved: DataFrame, master: DataFrame, entity: str, name: str, contexts: Sequence[str], least: float = FUZZY, tier: str = "fuzzy") -> DataFrame:
    """The last tier: rows that no tier matched, by a similar name in one of the
    ``contexts`` (country, club) that they share with the entity.

    One entity is a match; several are an ambiguity. Names are compared once for
    each distinct name and context; rows without a name or a context stay
    unmatched. Takes and gives what :func:`resolve_in_tiers` does.
    """
    key = F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("\x02")) for c in (name, *contexts)])
    rows = resolved.withColumn("_key", F.when((F.col("match_reason") == "unmatched") & F.col(name).isNotNull(), key))
    open_ = rows.where("_key is not null").select("_key", name, *contexts).distinct()

    def placed(df: DataFrame, *keep: Column) -> DataFrame:
        """A row for each context that is known."""
        places = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}\x01"), F.col(c))) for c in contexts]))
        return df.where(F.col(name).isNotNull()).select(*keep, F.explode(places).alias("_c"))

    left = placed(open_, F.col("_key"), F.col(name).alias("_a"))
    right = placed(master, F.col(entity).alias("_id"), F.col(name).alias("_n"))
    pairs = fuzzy_within(left, right, "_c", "_a", "_n", "_key", "_id", least, None)
    counts = pairs.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_id").alias("_id"))
    joined = rows.join(counts, "_key", "left")
    hit, one = F.col("_n").isNotNull(), F.col("_n") == 1
    return joined.select(
        *[c for c in resolved.columns if not c.startswith("match_")],
        F.when(hit & one, F.col("_id")).otherwise(F.col("match_id")).alias("match_id"),
        F.when(hit & one, F.lit(tier)).otherwise(F.col("match_tier")).alias("match_tier"),
        F.when(hit & one, F.lit("unique")).when(hit, F.concat(F.lit(f"ambiguous_{tier}_"), F.col("_n").cast("string"))).otherwise(F.col("match_reason")).alias("match_reason"),
    )


def claim_similar(rows: DataFrame, master: DataFrame, entity: str, name: str, group: str, least: float = FUZZY) -> DataFrame:
    """``name, group, _claimed``: rows with the one entity of their group that has a similar
    name. A row with several such entities claims none, and of the rows that claim
    one entity the most similar one has it."""
    left = rows.where(F.col(name).isNotNull() & F.col(group).isNotNull()).select(F.struct(name, group).alias("_row"), F.col(name).alias("_a"), F.col(group).alias("_c"), F.concat_ws("\x01", name, group).alias("_left")).distinct()
    right = master.select(F.col(group).alias("_c"), F.col(name).alias("_b"), F.col(entity).alias("_claimed"))
    pairs = fuzzy_within(left, right, "_c", "_a", "_b", "_left", "_claimed", least, None)
    single = pairs.join(pairs.groupBy("_left").agg(F.count("*").alias("_n")).where("_n = 1").select("_left"), "_left")
    best = best_pairing(single, "_left", "_claimed", "score")
    return best.join(left, "_left").select(F.col(f"_row.{name}").alias(name), F.col(f"_row.{group}").alias(group), "_claimed")


def assign_ids(new: DataFrame, order: Sequence[Column], after: int, prefix: str = "P", width: int = 6, into: str = "player_id") -> DataFrame:
    """New surrogate keys ``P000124...`` from ``after`` on, in the given total order.

    Rows are range-partitioned by the order; the sizes of the partitions, one
    number each, give every partition its first key.
    """
    spark = new.sparkSession
    placed = cut(new.repartitionByRange(scale_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy("_part").count().collect())
    starts, total = [], after
    for part, size in sizes:
        starts.append((part, total))
        total += size
    table = F.broadcast(spark.createDataFrame(starts, "_part int, _start long"))  # one row a partition
    n = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_start")
    return placed.join(table, "_part").withColumn(into, F.format_string(f"{prefix}%0{width}d", n)).drop("_part", "_start")


def fill_fields(master: DataFrame, updates: DataFrame, key: str, fields: Sequence[str], locked: Sequence[str] = (), today: str | None = None, stamp: str | None = None) -> DataFrame:
    """Master with the updates' values: blanks never overwrite, a ``locked``
    field that is set stays, and only rows that change get the stamp."""
    u = updates.select(key, *[F.when(F.trim(F.col(f).cast("string")) != "", F.col(f)).alias(f"_new_{f}") for f in fields])
    joined = master.join(u, key, "left")
    new = {f: F.coalesce(F.col(f), F.col(f"_new_{f}")) if f in locked else F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields}
    changed = F.lit(False)
    for f, expr in new.items():
        changed = changed | ~expr.eqNullSafe(F.col(f))
    out = dict(new)
    if stamp:
        out[stamp] = F.when(changed, F.lit(today).cast(master.schema[stamp].dataType)).otherwise(F.col(stamp))
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in master.columns])


def sweep_inactive(master: DataFrame, touched: DataFrame, spared: DataFrame, key: str, group: str, flag: str) -> DataFrame:
    """Clear the flag of master rows of covered groups that no source row touched.

    ``spared`` are candidates of ambiguous rows: not knowing which one is meant
    is no sign that any of them left.
    """
    covered = touched.join(master.select(key, group), key).select(group).distinct().withColumn("_covered", F.lit(True))
    keep = touched.select(key).union(spared.select(key)).distinct().withColumn("_kept", F.lit(True))
    joined = master.join(covered, group, "left").join(keep, key, "left")
    gone = F.coalesce("_covered", F.lit(False)) & F.col("_kept").isNull()
    return joined.select(*[F.when(gone, F.lit(False)).otherwise(F.col(c)).alias(c) if c == flag else F.col(c) for c in master.columns])


def refresh_master(
    master: DataFrame, rows: DataFrame, entity: str, tiers: Sequence[tuple[str, Sequence[str]]], fields: Sequence[str], order: Sequence[Column], locked: Sequence[str] = (), similar: tuple[str, str] | None = None
) -> DataFrame:
    """The master after a load: known entities updated, new ones added with the
    next ids, ambiguous rows skipped. Rows must be one an entity.

    With ``similar``, a name and a group, rows that no tier matched may claim an
    entity of the group that no row has touched yet, before they count as new.
    """
    resolved = resolve_in_tiers(rows, master, entity, tiers)
    if similar:
        name, group = similar
        resolved = cut(resolved)
        touched = resolved.where("match_id is not null").select(F.col("match_id").alias(entity)).distinct()
        claimed = claim_similar(resolved.where("match_reason = 'unmatched'"), master.join(touched, entity, "left_anti"), entity, name, group)
        joined = resolved.join(claimed, [name, group], "left")
        resolved = joined.select(
            *[c for c in resolved.columns if not c.startswith("match_")], F.coalesce("match_id", "_claimed").alias("match_id"),
            F.when(F.col("_claimed").isNotNull(), F.lit("similar")).otherwise(F.col("match_tier")).alias("match_tier"), F.when(F.col("_claimed").isNotNull(), F.lit("unique")).otherwise(F.col("match_reason")).alias("match_reason"),
        )
    known = resolved.where(F.col("match_id").isNotNull()).withColumn(entity, F.col("match_id"))
    one = top_n(known, [entity], order, 1)
    updated = fill_fields(master, one, entity, fields, locked)
    last = master.agg(F.max(F.regexp_extract(entity, r"(\d+)$", 1).try_cast("int"))).first()[0] or 0
    fresh = assign_ids(resolved.where("match_reason = 'unmatched'"), order, last, into=entity)
    return updated.unionByName(fresh.select(*[c for c in fresh.columns if c in master.columns]), allowMissingColumns=True)


def collisions(df: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Keys that several entities share, with the entities in order."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(entity)).alias("ids")).where(F.size("ids") > 1)


def birth_tolerant(rows: DataFrame, master: DataFrame, keys: Sequence[str], year: str, entity: str) -> DataFrame:
    """``rows`` with the one master entity of equal keys whose birth year is equal
    or blank; equal years come before blank ones."""
    m = master.select(*keys, F.col(year).alias("_my"), F.col(entity).alias("_id"))
    joined = rows.join(m, list(keys), "left").where(F.col("_my").isNull() | F.col(year).isNull() | (F.col("_my") == F.col(year)))
    rank = F.when(F.col("_my") == F.col(year), 0).otherwise(1)
    base = [c for c in rows.columns]
    return joined.groupBy(*base).agg(F.min(F.struct(rank.alias("r"), F.col("_id"))).alias("m")).select(*base, F.col("m._id").alias("match_id"))


def search_score(query: Column, name: Column, popularity: Column) -> Column:
    """10 where one bare name holds the other, else 5 where a longer word of the
    query stands in the name, and up to 5 for popularity."""
    words = F.filter(F.split(query, r"\s+"), lambda w: F.length(w) > 2)
    agreement = F.when(name.contains(query) | query.contains(name), 10.0).when(F.exists(words, lambda w: name.contains(w)), 5.0).otherwise(0.0)
    return agreement + F.least(F.coalesce(popularity, F.lit(0.0)) / 1e5, F.lit(5.0))


def best_results(results: DataFrame, query: str, place: str, name: str, popularity: str, national: str, first: int = 5, key: str | None = None) -> DataFrame:
    """``results`` with their ``score``: of each query's ``first`` results the best
    one that is no national team and scores above zero, the earlier one of equals.
    ``key`` tells queries of one text apart."""
    bare = with_bare(with_bare(results.where(F.col(place) <= first), query, "_q"), name, "_n")
    rows = bare.where(~F.coalesce(F.col(national), F.lit(False)) & F.col("_q").isNotNull() & F.col("_n").isNotNull())
    scored = rows.withColumn("score", search_score(F.col("_q"), F.col("_n"), F.col(popularity))).where("score > 0")
    return top_n(scored, [key or query], [F.desc("score"), F.asc(place)], 1).drop("_q", "_n")


# Kinds of models by what their id holds, or is, in the order in which
# they are tried, and the kind of all others.
MODEL_HOLDS = [("baseline", "baseline"), ("ensemble", "compound"), ("compound", "compound")]
MODEL_IS = [("manual-tier-list", "human"), ("wc2026-sim", "simulation")]
MODEL_ELSE = "single-source"


def model_type(name: Column) -> Column:
    """Kind of a model by its id."""
    kind = F.lit(MODEL_ELSE)
    for whole, found in reversed(MODEL_IS):
        kind = F.when(name == whole, found).otherwise(kind)
    for part, found in reversed(MODEL_HOLDS):
        kind = F.when(name.contains(part), found).otherwise(kind)
    return kind


def apply_overrides(rows: DataFrame, overrides: DataFrame, alias: str, target: str, column: str) -> DataFrame:
    """Replace listed aliases before any tier; unlisted values stay."""
    table = overrides.select(F.lower(F.trim(alias)).alias("_k"), F.col(target).alias("_t")).dropDuplicates(["_k"])
    return rows.join(table, F.lower(F.trim(column)) == F.col("_k"), "left").withColumn(column, F.coalesce("_t", column)).drop("_k", "_t")


def name_resolution(sources: Sequence[tuple[DataFrame, str]], resolve) -> DataFrame:
    """``name, code`` of the distinct names over several sources."""
    names = None
    for df, column in sources:
        one = df.select(F.col(column).alias("name")).where("name is not null").distinct()
        names = one if names is None else names.unionByName(one)
    return names.distinct().withColumn("code", resolve(F.col("name")))
