"""Variant spellings of people's names, attributed through a noisy channel.

Every entity brings the spellings it was written in, with their counts. The
entities written most often are the candidate canonical forms (the frequency
prior); a rarer entity is a variant of the candidate with the greatest posterior,
if that beats the hypothesis that it is somebody new. The channel explains a
variant's name word by word: as it is, with typing errors, as an initial, by a
shortened first name, moved, or left out. What else is known of both (birth
date, nation, position, clubs, foreign ids) adds its own likelihood ratio.

Candidates come from several blocking passes on selective keys, so no pass
compares everybody with everybody; one task never holds more than the entities
of one key. Attribution is a forest: each entity points to at most one entity
written more often, and pointers are doubled until every one ends at a root.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from touchline.llm.canon import distance
from touchline.llm.unify import fold_name
from touchline.session import cut, ship

#: Attribution needs this log posterior odds.
THRESHOLD = 0.0
#: Smallest and largest log ratio of one agreeing word, by its frequency.
WORD_LOW, WORD_HIGH = 1.0, 7.5
_VOWELS = str.maketrans("", "", "aeiouyw")
#: A word this rare is a family name, not a first name.
FAMILY = 5.5
TYPO, INITIAL, LEFT_OUT, CLASH = 1.6, 3.5, 0.4, 7.0


@lru_cache(maxsize=1 << 18)
def typos(a: str, b: str) -> int:
    """Edits between two words, or 9 where they are too far for typing errors."""
    if a == b:
        return 0
    if len(a) < 4 or len(b) < 4 or abs(len(a) - len(b)) > 2 or (a[0] != b[0] and a[-1] != b[-1] and a[1:3] != b[1:3]):
        return 9
    allowed = 1 if min(len(a), len(b)) < 5 else 2 if min(len(a), len(b)) < 9 else 3
    d = distance(a, b, allowed)
    return d if d <= allowed else 9


def _skeleton(word: str) -> str:
    """Consonants of a word, which spellings of a first name in several
    languages mostly share."""
    return word.translate(_VOWELS)


def channel(variant: list[str], canon: list[str], rarity: dict[str, float]) -> float:
    """Log likelihood ratio of one spelling given another.

    Words are paired greedily, surest first. Words of both sides that stay
    without a partner clash: a different first name is another person. Words of
    one side only were left out.
    """
    rest_v, rest_c = list(variant), list(canon)
    score = 0.0
    pairs = sorted(
        ((typos(v, c), i, j) for i, v in enumerate(variant) for j, c in enumerate(canon)),
    )
    used_v: set[int] = set()
    used_c: set[int] = set()
    long_hits = 0
    surest = 0.0
    for d, i, j in pairs:
        if d > 3:
            break
        if i in used_v or j in used_c:
            continue
        used_v.add(i)
        used_c.add(j)
        word = canon[j]
        worth = rarity.get(word, WORD_HIGH)
        if len(word) == 1:
            worth = 1.5
        else:
            long_hits += 1
            surest = max(surest, worth)
        score += max(worth - TYPO * d, 0.3)
    rest_v = [w for i, w in enumerate(variant) if i not in used_v]
    rest_c = [w for j, w in enumerate(canon) if j not in used_c]
    for w in list(rest_v):
        partner = next((c for c in rest_c if c[0] == w[0] and (len(w) == 1 or len(c) == 1)), None)
        if partner is not None:
            rest_v.remove(w)
            rest_c.remove(partner)
            score += max(WORD_HIGH / 2 - INITIAL, 0.25) + 1.0
    for w in list(rest_v) if surest >= FAMILY else ():
        # beside a family name, a shortened or respelled first name still shares
        # its beginning or its end
        partner = next((c for c in rest_c if (c[:3] == w[:3] or c[-4:] == w[-4:] or _skeleton(c) == _skeleton(w)) and min(len(c), len(w)) >= 3), None)
        if partner is not None:
            rest_v.remove(w)
            rest_c.remove(partner)
            score += 0.5
    if not long_hits:
        return -CLASH
    both = min(len(rest_v), len(rest_c))
    return score - CLASH * both - LEFT_OUT * (len(rest_v) + len(rest_c) - 2 * both)


def best_channel(a: list[str], b: list[str], rarity: dict[str, float]) -> float:
    """The best explanation of any spelling of one by any of the other."""
    return max((channel(x.split(), y.split(), rarity) for x in a for y in b), default=-CLASH)


def fold_column(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add the comparison key of a name column; null and blank give empty."""
    ship(df.sparkSession)

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: fold_name(x) if x else "")

    return df.withColumn(into, run(F.coalesce(F.col(column), F.lit(""))))


def _most(column: Column) -> Column:
    return F.mode(column, deterministic=True)


def entities(df: DataFrame, entity: str, names: list[str], facts: dict[str, str], clubs: str, ids: list[str]) -> DataFrame:
    """One row an entity: its spellings, how often it was written, its facts.

    Spellings and clubs are counted by (entity, value) first, so an entity with
    very many rows is combined on the map side. Facts are the most frequent
    known values.
    """
    base = df.where(F.col(entity).isNotNull()).withColumnRenamed(entity, "id")
    spelled = (
        base.select("id", F.explode(F.array_distinct(F.array(*[F.col(c) for c in names]))).alias("raw"))
        .where(F.length(F.trim("raw")) > 0)
        .groupBy("id", "raw")
        .agg(F.count("*").alias("n"))
    )
    words = fold_column(spelled, "raw", "folded").where("folded <> ''").groupBy("id", "folded").agg(F.sum("n").alias("n"))
    bags = words.groupBy("id").agg(F.array_sort(F.collect_set("folded")).alias("spellings"))
    club = F.lower(F.trim(F.regexp_replace(clubs, r"\s+", " ")))
    known = base.groupBy("id").agg(
        F.count("*").alias("rows"),
        *[_most(F.col(c)).alias(k) for k, c in facts.items()],
        F.array_sort(F.collect_set(F.when(club != "", club))).alias("clubs"),
        *[F.array_sort(F.collect_set(F.concat(F.lit(f"{c}:"), F.col(c).cast("string")))).alias(f"id_{c}") for c in ids],
    )
    return known.join(bags, "id", "left").select(
        "id", "rows", *facts, "clubs", F.flatten(F.array(*[F.col(f"id_{c}") for c in ids])).alias("ids") if ids else F.array().cast("array<string>").alias("ids"),
        F.coalesce("spellings", F.array().cast("array<string>")).alias("spellings"),
    )


def _keys() -> Column:
    """Blocking keys of an entity; ``weak`` ones join only the underspecified."""
    words = F.array_distinct(F.flatten(F.transform("spellings", lambda s: F.filter(F.split(s, " "), lambda w: F.length(w) >= 4))))
    ends = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(F.concat(F.lit("p"), F.substring(w, 1, 4)), F.concat(F.lit("s"), F.substring(F.reverse(w), 1, 4))))))
    day, month = F.dayofmonth("birth_date"), F.month("birth_date")
    born = F.concat_ws("-", F.year("birth_date"), F.least(day, month), F.greatest(day, month))
    empty = F.array().cast("array<struct<key:string,weak:boolean>>")
    exact = F.when(F.col("birth_date").isNotNull(), F.transform(ends, lambda e: F.struct(F.concat_ws("|", F.lit("d"), born, e).alias("key"), F.lit(False).alias("weak"))))
    year = F.when(
        F.col("birth_year").isNotNull() & F.col("country").isNotNull(),
        F.transform(ends, lambda e: F.struct(F.concat_ws("|", F.lit("y"), F.col("birth_year"), F.col("country"), e).alias("key"), F.col("birth_date").isNotNull().alias("weak"))),
    )
    heads = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 3))))
    pairs = F.flatten(F.transform(heads, lambda a: F.transform(F.filter(heads, lambda b: b > a), lambda b: F.concat_ws("|", F.lit("n"), a, b))))
    full = F.col("birth_year").isNotNull() & F.col("country").isNotNull()
    named = F.transform(pairs, lambda k: F.struct(k.alias("key"), full.alias("weak")))
    return F.array_distinct(F.concat(F.coalesce(exact, empty), F.coalesce(year, empty), F.coalesce(named, empty)))


def candidate_pairs(people: DataFrame) -> DataFrame:
    """``a, b`` with ``b`` written more often (ties by the smaller id).

    Two entities meet in a key unless both sides hold it weakly: those that are
    fully described meet by birth date, the others by what they have.
    """
    rank = F.struct((-F.col("rows")).alias("r"), F.col("id").alias("i"))
    keyed = people.select("id", rank.alias("rank"), F.explode(_keys()).alias("k")).select("id", "rank", "k.key", "k.weak")
    side = lambda rows, c: rows.select("key", F.col("id").alias(c), F.col("rank").alias(f"r{c}"))
    strong, weak = keyed.where("not weak"), keyed.where("weak")
    # two joins, so that a name which very many fully described people bear never
    # meets itself
    met = side(strong, "a").join(side(keyed, "b"), "key").unionByName(side(weak, "a").join(side(strong, "b"), "key"))
    return met.where("rb < ra").select("a", "b").distinct()


def _evidence(x: str, y: str) -> Column:
    """Log likelihood ratio of the facts of two entities; unknown ones say nothing."""
    of = lambda f: (F.col(f"{x}.{f}"), F.col(f"{y}.{f}"))
    (born, also), (year, other) = of("birth_date"), of("birth_year")
    swapped = (F.year(born) == F.year(also)) & (F.month(born) == F.dayofmonth(also)) & (F.dayofmonth(born) == F.month(also))
    by_date = F.when(born.isNotNull() & also.isNotNull(), F.when(born == also, 8.5).when(swapped, 7.0).otherwise(-9.0))
    by_year = F.when(year == other, 2.8).when(year != other, -8.0)
    same = lambda f, yes, no: F.coalesce(F.when(of(f)[0] == of(f)[1], yes).when(of(f)[0] != of(f)[1], no), F.lit(0.0))
    shared = lambda f, yes: F.when(F.coalesce(F.arrays_overlap(*of(f)), F.lit(False)), yes).otherwise(0.0)
    return F.coalesce(by_date, by_year, F.lit(0.0)) + same("country", 2.5, -6.0) + same("position", 0.8, -2.5) + shared("clubs", 2.0) + shared("ids", 6.0)


def word_rarity(people: DataFrame) -> DataFrame:
    """``word, worth``: log of how rare a word is among the entities."""
    total = F.lit(max(1, people.count())).cast("double")
    words = people.select("id", F.explode(F.flatten(F.transform("spellings", lambda s: F.split(s, " ")))).alias("word")).distinct()
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.select("word", F.least(F.lit(WORD_HIGH), F.greatest(F.lit(WORD_LOW), F.log(total / F.col("n")))).alias("worth"), "n")


def attribute(people: DataFrame, prior: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``a, b, odds``: each variant with its most probable canonical entity.

    Without a ``prior`` each of the entities is as likely to be meant as any other:
    its log odds are those of one among all.
    What the facts leave of the odds is settled by columns; only spellings of
    pairs that a spelling could still link go to Python.

    Words held by more than one in a thousand entities have a worth below the
    ceiling; there are at most a few thousand of these, so they are broadcast.
    """
    spark = people.sparkSession
    common = word_rarity(people).where(F.col("worth") < WORD_HIGH - 1e-9)
    shared = spark.sparkContext.broadcast({r["word"]: r["worth"] for r in common.toLocalIterator()})
    if prior is None:
        prior = -math.log(max(people.count(), 2))
    side = lambda p: people.select(F.col("id").alias(p), F.struct("birth_date", "birth_year", "country", "position", "clubs", "ids", "spellings", "rows").alias(f"{p}_facts"))
    met = candidate_pairs(people).join(side("a"), "a").join(side("b"), "b")
    before = F.lit(prior) + _evidence("a_facts", "b_facts") + 0.2 * F.log("b_facts.rows")
    # a spelling can't be worth more than its words
    words = lambda p: F.array_max(F.transform(f"{p}_facts.spellings", lambda s: F.size(F.split(s, " "))))
    room = F.coalesce(F.least(words("a"), words("b")), F.lit(0)) * WORD_HIGH
    pairs = met.select("a", "b", before.alias("before"), F.col("a_facts.spellings").alias("x"), F.col("b_facts.spellings").alias("y"), room.alias("room")).where(F.col("before") + F.col("room") > threshold).drop("room")
    kind = people.schema["id"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("odds", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            keep, odds = [], []
            for i, (score, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("before", "x", "y")))):
                score += best_channel(x, y, rarity)
                if score > threshold:
                    keep.append(i)
                    odds.append(score)
            at = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(odds, pa.float64())], ["a", "b", "odds"])

    scored = pairs.mapInArrow(run, schema)
    return scored.groupBy("a").agg(F.max(F.struct("odds", "b")).alias("m")).select("a", F.col("m.b").alias("b"), F.col("m.odds").alias("odds"))


def roots(links: DataFrame) -> DataFrame:
    """``id, root`` of a forest of ``a -> b`` links, by pointer doubling.

    A chain of length n takes log2(n) rounds; every round is one join with the
    lineage cut, and nothing but one flag comes to the driver.
    """
    state = cut(links.select(F.col("a").alias("id"), F.col("b").alias("root")))
    while True:
        step = state.alias("s").join(state.alias("t"), F.col("s.root") == F.col("t.id"), "left")
        state = cut(step.select(F.col("s.id").alias("id"), F.coalesce("t.root", "s.root").alias("root"), F.col("t.root").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("id", "root")
        state = state.drop("moved")


def linked_pairs(links: DataFrame) -> DataFrame:
    """``id_a, id_b`` of all pairs under one root, the smaller id first.

    A root with its variants is one person under several ids, a handful.
    """
    tree = roots(links)
    members = tree.unionByName(tree.select(F.col("root").alias("id"), "root").distinct())
    x, y = members.withColumnRenamed("id", "id_a"), members.withColumnRenamed("id", "id_b")
    return x.join(y, "root").where("id_a < id_b").select("id_a", "id_b")


PLAYER_FACTS = {"birth_date": "birth_date", "birth_year": "birth_year", "country": "country_code", "position": "position"}
PLAYER_NAMES = ["display_name", "normalized_name", "statsbomb_name", "understat_name"]


def players(df: DataFrame) -> DataFrame:
    return entities(df, "player_id", PLAYER_NAMES, PLAYER_FACTS, "current_club", ["understat_id", "espn_player_id"])


def same_people(df: DataFrame) -> DataFrame:
    """``player_id_a, player_id_b``: ids of the player master that are one person.

    Blank and null names, facts and ids say nothing; rows without an id are left
    out; repeated rows change only how often an entity was written; ties of the
    posterior go to the greater id; an empty table gives no pairs; other columns
    are ignored.
    """
    people = cut(players(df))
    return linked_pairs(attribute(people)).select(F.col("id_a").alias("player_id_a"), F.col("id_b").alias("player_id_b"))
