"""Typed values mapped to the closest entry of a reference list.

The reference entries form a BK-tree under a true metric, the unrestricted
Damerau-Levenshtein distance; the triangle inequality prunes the search and
every entry within the threshold is returned. All values of a batch walk the tree
together: at each node one table of distances is filled for those that reach it.

A list of a bounded size (``MAX_BROADCAST`` entries, checked) travels to the
workers whole. A longer one is cut into shards by the folded key of its entries;
each shard builds its own tree, all distinct values visit every shard, and what
the shards found is merged by the same decision, so both ways agree.

Only distinct values are searched, so repeated ones cost a hash join.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from touchline.llm.unify import fold_name, unify
from touchline.session import cut, scale_partitions, ship

UNMATCHED = "UNMATCHED"
#: Reference entries that are broadcast as one tree.
MAX_BROADCAST = 50_000
#: Values that meet one shard in one task, and that walk a tree at once.
GROUP_VALUES = 200_000
AT_ONCE = 4_096
#: Largest distance of a match, by the length of the typed value.
THRESHOLDS = ((4, 0), (6, 1), (1 << 30, 2))

# Short and inverted ways of writing parts of a country's name,
# and what is typed around a name without belonging to it.
SHORT = {
    "n": ("north", "new"), "nth": ("north",), "northern": ("north",), "s": ("south", "saint"), "sth": ("south",), "southern": ("south",),
    "st": ("saint",), "isl": ("islands",), "is": ("islands",), "island": ("islands",), "u": ("upper",), "rep": ("republic",),
    "gr": ("greater",), "g": ("greater",), "dr": ("democratic republic",), "dem": ("democratic",),
}
LINKS = ("and", "of", "the")
_AROUND = re.compile(r"\b(?:to (?:win|advance|qualify)|wins?|nt|national (?:football )?team|host|side|team)\b")
_SINGLE = re.compile(r"\((?:m|w|f|h|host)\)", re.I)
_CODE = re.compile(r"[\[(]\s*([^\W\d_]{2,3})\s*[\])]")
_PLACEHOLDER = re.compile(r"^team [a-z]{1,3}$")


def distance(a: str, b: str, limit: int = 1 << 30) -> int:
    """Unrestricted Damerau-Levenshtein distance, a true metric.

    A value above ``limit`` may be returned as any value above it.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    # what both begin and end with costs nothing
    start, least = 0, min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < least - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    top = n + m
    last: dict[str, int] = {}
    rows = [[top] * (m + 2), [top, *range(m + 1)]]
    for i in range(1, n + 1):
        row = [top, i] + [0] * m
        prev = rows[i]
        seen = 0
        ch = a[i - 1]
        for j in range(1, m + 1):
            k, l = last.get(b[j - 1], 0), seen
            if ch == b[j - 1]:
                best = prev[j]
                seen = j
            else:
                best = 1 + min(prev[j], row[j], prev[j + 1])
            swap = rows[k][l] + (i - k - 1) + 1 + (j - l - 1)
            row[j + 1] = swap if swap < best else best
        last[ch] = i
        rows.append(row)
        if min(row) > limit and min(prev) > limit:
            return limit + 1
    return rows[n + 1][m + 1]


class _Words:
    """Texts as a matrix of character numbers, one column a text, and their letter counts."""

    def __init__(self, texts: list[str], alphabet: dict[str, int]) -> None:
        self.length = np.array([len(t) for t in texts], np.int32)
        #: Row ``j`` holds the ``j``-th character; -1 stands behind the end.
        self.chars = np.full((int(self.length.max(initial=0)), len(texts)), -1, np.int32)
        self.counts = np.zeros((len(texts), len(alphabet) + 1), np.int32)
        for k, text in enumerate(texts):
            codes = [alphabet.get(c, len(alphabet)) for c in text]
            # characters that no entry has are all different from every entry's
            self.chars[: len(text), k] = codes
            np.add.at(self.counts[k], codes, 1)


def _distances(entry: np.ndarray, chars: np.ndarray, length: np.ndarray, letters: int) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of one entry to many texts.

    Row by row of the table; inside a row what comes from the left is a running
    minimum, so each row is a few operations on all texts at once.
    """
    n, (m, q) = len(entry), chars.shape
    far = n + m + 1
    kind = np.int16 if far < 1 << 14 else np.int32
    table = np.full((n + 2, m + 2, q), far, kind)
    table[1, 1:] = np.arange(m + 1)[:, None]
    last = np.zeros(letters + 2, kind)
    columns = np.arange(1, m + 1, dtype=kind)[:, None]
    steps = np.arange(m + 1, dtype=kind)[:, None]
    each = np.arange(q)[None, :]
    for i in range(1, n + 1):
        same = chars == entry[i - 1]
        k = last[chars]
        seen = np.zeros((m + 1, q), kind)
        np.maximum.accumulate(np.where(same, columns, 0), axis=0, out=seen[1:])
        l = seen[:-1]
        swap = table[k, l, each] + (i - k) + (columns - l - 1)
        row = np.empty((m + 1, q), kind)
        row[0] = i
        row[1:] = np.minimum(np.minimum(table[i, 1:-1] + ~same, table[i, 2:] + 1), swap)
        table[i + 1, 1:] = np.minimum.accumulate(row - steps, axis=0) + steps
        last[entry[i - 1]] = i
    return table[n + 1, length + 1, np.arange(q)]


@dataclass
class BKTree:
    """Entries hung under each other by their distance."""

    entries: list[str] = field(default_factory=list)
    children: list[dict[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, entries: Iterable[str]) -> BKTree:
        """The tree of the entries in order; each one's distances to all that
        hang below it are taken at once."""
        tree = cls(sorted(set(entries)))
        tree.children = [{} for _ in tree.entries]
        words = tree._words(tree.entries)
        todo = [np.arange(len(tree.entries))] if tree.entries else []
        while todo:
            group = todo.pop()
            at, below = group[0], group[1:]
            if not len(below):
                continue
            d = np.concatenate([tree._far(int(at), words, part) for part in np.array_split(below, -(-len(below) // AT_ONCE))])
            for step in np.unique(d):
                part = below[d == step]
                tree.children[at][int(step)] = int(part[0])
                todo.append(part)
        return tree

    def _words(self, texts: list[str]) -> _Words:
        if not hasattr(self, "_alphabet"):
            self._alphabet = {c: i for i, c in enumerate(sorted(set().union(*self.entries)))} if self.entries else {}
            self._codes = [np.array([self._alphabet[c] for c in e], np.int32) for e in self.entries]
            self._bags = np.array([np.bincount(c, minlength=len(self._alphabet) + 1) for c in self._codes], np.int32).reshape(len(self.entries), len(self._alphabet) + 1)
        return _Words(texts, self._alphabet)

    def __getstate__(self) -> dict:
        return {"entries": self.entries, "children": self.children}

    def _far(self, at: int, words: _Words, who: np.ndarray) -> np.ndarray:
        length = words.length[who]
        return _distances(self._codes[at], words.chars[: int(length.max(initial=0)), who], length, len(self._alphabet))

    def within_many(self, values: list[str], thresholds: list[int]) -> list[list[tuple[int, str]]]:
        """For each value every entry within its threshold, nearest first."""
        found: list[list[tuple[int, str]]] = [[] for _ in values]
        longest = max(map(len, self.entries), default=-1)
        # a value that is longer by more than its threshold is near nothing
        able = [i for i, v in enumerate(values) if self.entries and len(v) <= longest + thresholds[i]]
        for start in range(0, len(able), AT_ONCE):
            rows = able[start : start + AT_ONCE]
            words = self._words([values[i] for i in rows])
            room = np.array([thresholds[i] for i in rows], np.int32)
            todo = [(0, np.arange(len(rows)))]
            while todo:
                at, who = todo.pop()
                below = self.children[at]
                # letters that either side has too few of are edits, so a value may be
                # too far for the entry and for all that hangs below it
                gap = words.counts[who] - self._bags[at]
                least = np.maximum(np.where(gap > 0, gap, 0).sum(axis=1), np.where(gap < 0, -gap, 0).sum(axis=1))
                who = who[least <= max(below, default=0) + room[who]]
                if not len(who):
                    continue
                d, t = self._far(at, words, who), room[who]
                for k in np.flatnonzero(d <= t):
                    found[rows[who[k]]].append((int(d[k]), self.entries[at]))
                for step, child in below.items():
                    near = who[np.abs(d - step) <= t]
                    if len(near):
                        todo.append((child, near))
        return [sorted(f) for f in found]

    def within(self, value: str, threshold: int) -> list[tuple[int, str]]:
        return self.within_many([value], [threshold])[0]


def threshold_of(text: str) -> int:
    return next(t for length, t in THRESHOLDS if len(text.replace(" ", "")) < length)


def _key(words: Iterable[str]) -> str:
    return " ".join(w for w in words if w not in LINKS)


def readings(typed: str, most_words: int = 8) -> list[str]:
    """Keys that a typed value may stand for, the most literal first.

    A text of more than two words above ``most_words``, the words of the longest
    entry, is beyond the threshold of every entry and isn't spelled out.
    """
    text = _SINGLE.sub(" ", unify(typed) or "")
    if "," in text:
        head, _, tail = text.partition(",")
        text = f"{tail} {head}"
    words = fold_name(text).split()
    if words[:2] == ["d", "r"]:
        words = ["dr", *words[2:]]
    if len(words) > 1 and words[-1] in ("dr", "republic", "rep"):
        words = words[-1:] + words[:-1]
    if words[:2] == ["islands", "of"]:
        words = words[2:] + words[:1]
    plain = " ".join(_AROUND.sub(" ", " ".join(words)).split())
    out: list[str] = []
    for start in dict.fromkeys((" ".join(words), plain)):
        parts = start.split()
        if sum(w not in LINKS for w in parts) > most_words + 2:
            continue
        options = [[]]
        for w in parts:
            options = [o + [x] for o in options for x in ((w, *SHORT[w]) if w in SHORT else (w,))]
        out.extend(_key(" ".join(o).split()) for o in options)
    return [k for k in dict.fromkeys(out) if k]


# How a value was matched, by rising order; within a way the smaller number of the
# reading, or the smaller distance, comes first.
CODE, EXACT, INNER, SHORTENED, NEAR = range(1, 6)
_HOW = {CODE: "code", EXACT: "exact", INNER: "code", SHORTENED: "shortened", NEAR: "near"}
Evidence = tuple[int, int, tuple[str, ...]]


def decide(evidence: Iterable[Evidence]) -> tuple[str, int, str]:
    """``(code, distance, how)`` by the first evidence that means one code.

    ``evidence`` holds ways, orders and the codes meant, first ones first; two
    codes stand for any number of them. Of what is near only the nearest counts.
    """
    for way, order, codes in evidence:
        if len(codes) == 1:
            return codes[0], order if way == NEAR else 0, _HOW[way]
        if way == NEAR:
            break
    return UNMATCHED, -1, "none"


@dataclass
class Matcher:
    """A reference list, or a shard of one, with its tree; codes match only exactly."""

    names: dict[str, str]
    codes: dict[str, str]
    tree: BKTree
    #: Words of the longest entry of the whole list.
    most_words: int = 0

    @classmethod
    def of(cls, names: Iterable[tuple[str, str]], codes: Iterable[tuple[str, str]], most_words: int | None = None) -> Matcher:
        table: dict[str, str] = {}
        for name, code in sorted(names):
            if name and code:
                table.setdefault(name_key(name), code)
        table.pop("", None)
        short: dict[str, str] = {}
        for text, code in sorted(codes):
            if text and code:
                short.setdefault(text.casefold(), code)
        if most_words is None:
            most_words = max((k.count(" ") + 1 for k in table), default=0)
        return cls(table, short, BKTree.of(table), most_words)

    def __post_init__(self) -> None:
        self.sorted = sorted(self.names)

    def _beginning(self, key: str) -> tuple[str, ...]:
        """Codes of the names that begin with ``key``, two at most."""
        meant: list[str] = []
        for i in range(bisect_left(self.sorted, key), len(self.sorted)):
            if not self.sorted[i].startswith(key) or len(meant) > 1:
                break
            if self.names[self.sorted[i]] not in meant:
                meant.append(self.names[self.sorted[i]])
        return tuple(meant)

    def literal(self, typed: str, folded: str, keys: list[str]) -> list[Evidence]:
        """All evidence but what is near; nothing can come before a code or an
        exact reading, so it ends there."""
        if folded in self.codes and len(folded) <= 3:
            return [(CODE, 0, (self.codes[folded],))]
        for i, key in enumerate(keys):
            if key in self.names:
                return [(EXACT, i, (self.names[key],))]
        unified = unify(typed) or ""
        inner = _CODE.search(unified)
        if inner and inner.group(1).casefold() in self.codes:
            return [(INNER, 0, (self.codes[inner.group(1).casefold()],))]
        if not unified.rstrip("*\"' ").endswith("."):
            return []
        begun = [(SHORTENED, i, self._beginning(key)) for i, key in enumerate(keys) if len(key) >= 4]
        return [e for e in begun if e[2]]

    def evidence(self, values: list[str | None], near: bool = True, shard: bool = False) -> list[list[Evidence] | str]:
        """The evidence for each value; ``blank`` or ``placeholder`` where there
        can be none. A shard also searches where only it is sure by a beginning."""
        out: list[list[Evidence] | str] = []
        searched: dict[str, list[int]] = {}
        for at, typed in enumerate(values):
            if typed is None or not unify(typed):
                out.append("blank")
                continue
            folded = fold_name(typed)
            if _PLACEHOLDER.match(folded):
                out.append("placeholder")
                continue
            keys = readings(typed, self.most_words)
            held = self.literal(typed, folded, keys)
            out.append(held)
            sure = any(way < SHORTENED or (not shard and len(codes) == 1) for way, _, codes in held)
            if near and not sure:
                for key in keys:
                    searched.setdefault(key, []).append(at)
        todo = list(searched)
        nearest: dict[int, dict[str, int]] = {}
        for key, hits in zip(todo, self.tree.within_many(todo, [threshold_of(k) for k in todo])):
            for at in searched[key] if hits else ():
                best = nearest.setdefault(at, {})
                for d, name in hits:
                    best[self.names[name]] = min(d, best.get(self.names[name], d))
        for at, best in nearest.items():
            least = min(best.values())
            out[at].append((NEAR, least, tuple(sorted(c for c, d in best.items() if d == least)[:2])))
        return out

    def match_all(self, values: list[str | None], near: bool = True) -> list[tuple[str, int, str]]:
        """``(code, distance, how)`` of each value; the code is UNMATCHED where
        nothing, or more than one thing, is meant. Without ``near`` the tree isn't
        searched."""
        return [(UNMATCHED, -1, e) if isinstance(e, str) else decide(e) for e in self.evidence(values, near)]

    def match(self, typed: str | None, near: bool = True) -> tuple[str, int, str]:
        return self.match_all([typed], near)[0]


def name_key(name: str) -> str:
    """The key of a reference entry."""
    return _key(fold_name(name).split())


def _rows(df: DataFrame) -> list[tuple[str, str]]:
    return [tuple(r) for r in df.toLocalIterator()]


def match_values(
    values: DataFrame,
    typed: str,
    names: DataFrame,
    codes: DataFrame,
    max_broadcast: int = MAX_BROADCAST,
    near: bool = True,
) -> DataFrame:
    """``typed, code, distance, how`` for each distinct non-blank value.

    ``names`` and ``codes`` are two-column frames (text, code): names match
    within a distance, codes only exactly. Values that mean no entry, or more
    than one equally, get UNMATCHED, so they are reported. Null and blank
    values give no row, ties between entries of one code are no tie, repeated
    values give one row, and an empty list leaves every value unmatched. Other
    columns are ignored.
    """
    spark = values.sparkSession
    ship(spark)
    # few values, much work on each: spread them evenly, whatever their bytes
    distinct = values.where(F.length(F.trim(typed)) > 0).select(F.col(typed).alias("typed")).distinct().repartition(scale_partitions(spark))
    count = names.count() + codes.count()
    schema = "typed string, code string, distance int, how string"
    if count <= max_broadcast:
        shared = spark.sparkContext.broadcast(Matcher.of(_rows(names), _rows(codes)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shared.value
            for batch in batches:
                texts = batch.column(0).to_pylist()
                found = matcher.match_all(texts, near)
                keep = [i for i, f in enumerate(found) if f[2] != "blank"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([texts[i] for i in keep], pa.string()),
                        pa.array([found[i][0] for i in keep], pa.string()),
                        pa.array([found[i][1] for i in keep], pa.int32()),
                        pa.array([found[i][2] for i in keep], pa.string()),
                    ],
                    ["typed", "code", "distance", "how"],
                )

        return distinct.mapInArrow(run, schema)

    @pandas_udf("string")
    def folded(kind: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([name_key(t) if k == "name" else t.casefold() for k, t in zip(kind, text)], dtype=object)

    shards = -(-count // max_broadcast)
    label = lambda df, kind: df.toDF("text", "code").dropna().select(F.lit(kind).alias("kind"), "text", "code")
    keyed = label(names, "name").unionByName(label(codes, "code")).withColumn("key", folded("kind", "text"))
    # entries of one key meet in one shard
    entries = cut(keyed.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")))
    most_words = entries.where("kind = 'name'").agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0
    # a group holds one shard and a bounded part of the values
    parts = distinct.count() // GROUP_VALUES + 1
    visits = distinct.select("typed", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("typed"), F.lit(parts)).cast("int").alias("part"))
    spread = entries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1).cast("int"))))

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs = lambda kind: [(t, c) for k, t, c in zip(right["kind"], right["text"], right["code"]) if k == kind]
        matcher = Matcher.of(pairs("name"), pairs("code"), most_words)
        rows: list[tuple] = []
        for typed, held in zip(left["typed"], matcher.evidence(list(left["typed"]), near, shard=True)):
            if held == "blank":
                continue
            # a value without evidence keeps one row, so it is reported
            rows.append((typed, 0, 0, held if isinstance(held, str) else None))
            if not isinstance(held, str):
                rows.extend((typed, way, order, code) for way, order, meant in held for code in meant)
        return pd.DataFrame(rows, columns=["typed", "way", "order", "code"])

    found = visits.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInPandas(one, "typed string, way int, order int, code string")
    # codes of one way and order from all shards, two at most
    one_way = found.groupBy("typed", "way", "order").agg(F.min("code").alias("a"), F.max("code").alias("b"))
    meant = F.when(F.col("a").isNull(), F.array().cast("array<string>")).when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    gathered = one_way.groupBy("typed").agg(F.array_sort(F.collect_list(F.struct("way", "order", meant.alias("codes")))).alias("all"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                stated = next((e["codes"] for e in row["all"] if e["way"] == 0 and e["codes"]), None)
                held = [(e["way"], e["order"], tuple(e["codes"])) for e in row["all"] if e["way"]]
                rows.append((row["typed"], *((UNMATCHED, -1, stated[0]) if stated else decide(held))))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.string()))], ["typed", "code", "distance", "how"])

    return gathered.mapInArrow(merge, schema)


def _team_lists(teams: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    names = teams.select("team_name", "team_code").union(aliases.select("alias", "team_code"))
    codes = teams.select("team_code", F.col("team_code").alias("code")).union(teams.select("iso2_code", "team_code")).where("team_code is not null")
    return names.dropna(), codes.dropna()


def team_matcher(teams: DataFrame, aliases: DataFrame, most: int = MAX_BROADCAST) -> Matcher:
    """One matcher of a bounded reference list, for a Python stage of its own."""
    names, codes = _team_lists(teams, aliases)
    if names.count() + codes.count() > most:
        raise ValueError("the reference list is too long to be held by each worker; use match_values")
    return Matcher.of(_rows(names), _rows(codes))


def team_matches(values: DataFrame, typed: str, teams: DataFrame, aliases: DataFrame, near: bool = True) -> DataFrame:
    """:func:`match_values` against teams with their names, aliases and codes."""
    names, codes = _team_lists(teams, aliases)
    return match_values(values, typed, names, codes, near=near)


#: Fixed value: how an id is written where a name is meant.
_ID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def asked_names(named: DataFrame) -> DataFrame:
    """The rows of ``ticker, yes_sub_title, soccer_team`` that name a team, with
    ``asked``: the text that tells which one, the market's subtitle for an id."""
    rows = named.where(F.length(F.trim("soccer_team")) > 0).withColumn("is_id", F.col("soccer_team").rlike(_ID))
    return rows.withColumn("asked", F.when(F.col("is_id"), F.col("yes_sub_title")).otherwise(F.col("soccer_team")))


def market_teams(named: DataFrame, teams: DataFrame, aliases: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """``rec_key, typed, code`` of ``ticker, yes_sub_title, soccer_team`` rows.

    A name is matched itself. For an id the market's subtitle is matched; an id
    means one team, so a market without a readable subtitle gets the team that
    most markets of the id name. ``codes`` may hold ``typed, code`` of all asked
    texts already.
    """
    rows = asked_names(named)
    if codes is None:
        codes = team_matches(rows, "asked", teams, aliases)
    read = cut(rows.join(codes.select(F.col("typed").alias("asked"), "code"), "asked", "left").select("ticker", "soccer_team", "is_id", F.coalesce("code", F.lit(UNMATCHED)).alias("code")))
    plain = read.where(~F.col("is_id")).select(F.col("ticker").alias("rec_key"), F.col("soccer_team").alias("typed"), "code")
    ids = read.where(F.col("is_id")).groupBy("ticker", "soccer_team", "code").agg(F.count("*").alias("n"))
    ranked = F.struct((F.col("code") != UNMATCHED).alias("ok"), F.col("n"), F.col("code"))
    own = ids.groupBy("ticker", "soccer_team").agg(F.max(ranked).alias("best"))
    overall = ids.groupBy("soccer_team", "code").agg(F.sum("n").alias("n")).groupBy("soccer_team").agg(F.max(ranked)["code"].alias("common"))
    solved = own.join(overall, "soccer_team").select(
        F.col("ticker").alias("rec_key"),
        F.col("soccer_team").alias("typed"),
        F.when(F.col("best.ok"), F.col("best.code")).otherwise(F.col("common")).alias("code"),
    )
    return plain.unionByName(solved).distinct()
