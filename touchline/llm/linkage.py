"""Probabilistic linkage of two sources that share no key.

Appearances are linked to the players of a master:

1. *Blocking* in several passes: the beginnings of two words of the name; the
   nation with short beginnings of these; the club with the beginning or the end of
   a word; for rows without a club the nation with that; for rows without
   both, a word itself. Every word gives keys: where a common word and its other
   spellings would make a large block, the block is split by an outer letter of
   another word, of which two names that agree share one. A block travels as one hash.
2. *Comparison* by agreement levels of name, club and time, nation and position.
   Names are compared once for each distinct written name, not for each
   appearance.
3. *Expectation-maximisation* of the match and non-match probabilities of the
   levels. The table of level patterns, at most a few hundred rows, is all that
   comes to the driver.
4. The posterior of a candidate, in competition with the other candidates of the
   same appearance and with no match at all, is the confidence of the link.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from touchline.llm.canon import UNMATCHED, team_matcher
from touchline.llm.unify import fold_name
from touchline.session import cut, ship

THRESHOLD = 0.5
#: Least name level of a link: at level 1 only a family name agrees, which is what
#: relatives share.
LEAST_NAME = 2
#: A word that more than this share of the players bear is no rare word. At most
#: (words of a player) / COMMON_SHARE words are common, so their list is bounded.
COMMON_SHARE = 0.003
COMMON_LEAST = 20
#: Days by which a stay at a club may reach beyond the refreshes that show it.
SLACK_DAYS = 200

# Starting probabilities of the levels, lowest level first, for matches and for
# non-matches. They also act as pseudo-counts, so a level that a small input
# lacks keeps a sensible weight.
NAME_M, NAME_U = (0.005, 0.02, 0.045, 0.06, 0.12, 0.75), (0.50, 0.38, 0.05, 0.02, 0.02, 0.03)
CLUB_M, CLUB_U = (0.03, 0.08, 0.09, 0.80), (0.55, 0.08, 0.22, 0.15)
NATION_M, NATION_U = (0.01, 0.14, 0.85), (0.70, 0.14, 0.16)
POSITION_M, POSITION_U = (0.02, 0.18, 0.80), (0.55, 0.18, 0.27)
LEVELS = {"name": (NAME_M, NAME_U), "club": (CLUB_M, CLUB_U), "nation": (NATION_M, NATION_U), "position": (POSITION_M, POSITION_U)}
PSEUDO = 200.0

#: How the other source shortens parts of a club's name, parts that
#: it leaves out, and the lines of its positions.
CLUB_PARTS = {"sp": "sporting", "r": "real", "cit": "city", "uni": "united", "utd": "united", "ath": "athletic", "rov": "rovers"}
CLUB_EXTRAS = frozenset({"fc", "sv", "cf", "sc", "afc"})
LINES = {"GK": "GK", "DL": "DF", "DR": "DF", "DC": "DF", "DF": "DF", "DMC": "MF", "MC": "MF", "AMC": "MF", "ML": "MF", "MR": "MF", "MF": "MF", "FW": "FW", "FWL": "FW", "FWR": "FW"}


@lru_cache(maxsize=1 << 16)
def club_key(title: str) -> str | None:
    """One key for a club in either source's writing; None where unknown."""
    words = [CLUB_PARTS.get(w, w) for w in fold_name(title).split()]
    return " ".join(w for w in words if w not in CLUB_EXTRAS and not (len(w) == 4 and w.isdigit())) or None


def folded_name(column: str) -> Column:
    """Comparison key of a name column; empty for null."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([fold_name(x) if x is not None else "" for x in s], dtype=object)

    return run(F.col(column))


def folded_club(column: str) -> Column:
    """Club key of a column; null for null and unknown."""

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([club_key(x) if x is not None else None for x in s], dtype=object)

    return run(F.col(column))


def _words(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda w: F.length(w) >= 4)


def _is_common(common: Sequence[str]) -> Callable[[Column], Column]:
    # a list of literals becomes a hash set, also inside of a lambda
    return (lambda w: w.isin(list(common))) if common else (lambda w: F.lit(False))


def _rare_words(folded: Column, common: Sequence[str]) -> Column:
    """Words of at least four letters that few players bear; of a name that has
    none, all of them."""
    every, frequent = _words(folded), _is_common(common)
    if not common:
        return every
    rare = F.filter(every, lambda w: ~frequent(w))
    return F.when(F.size(rare) > 0, rare).otherwise(every)


def _plain(folded: Column, common: Sequence[str]) -> Column:
    """Whether all long words of a name are common."""
    return F.forall(_words(folded), _is_common(common))


def families(common: Sequence[str]) -> dict[str, str]:
    """Of each common word one for all that share its beginning or its end, by
    whatever steps."""
    head: dict[str, str] = {}

    def top(x: str) -> str:
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for word in common:
        for end in ("p" + word[:5], "s" + word[-6:]):
            head[top(end)] = top(" " + word)
    first: dict[str, str] = {}
    return {word: first.setdefault(top(" " + word), word) for word in common}


# A key may carry a word, behind two letters: the kind of the key, and whether the word
# is rare and long enough for keys of its own.
#: Of a word beside a rare one, which needs no agreement if both sides have that.
ALONE = "~"
#: Of a word beside a common one, which has to be the same on both sides.
BESIDE = "="
#: Of a word in the block of a common one, by its first and by its last letter.
FIRST, LAST = "f", "l"
#: Of the word itself, by its end.
END = "s"


def _carried(kind: Column | str, word: Column, own: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.when(own, "r").otherwise("-"), word)


def _meets(w: Column, v: Column) -> Column:
    """Whether two players' keys that are equal make a candidate, from what they
    carry. A pair of which another key says the same for certain is left to that."""
    kind, s, t = F.substring(w, 1, 1), F.expr("substring(w, 3)"), F.expr("substring(v, 3)")
    own = (F.substring(w, 2, 1) == "r") & (F.substring(v, 2, 1) == "r")
    begin = lambda n: F.substring(s, 1, n) == F.substring(t, 1, n)
    elsewhere = (
        F.when(kind.isin(ALONE, BESIDE), own & begin(4))  # the key of the two words turned round
        .when(own & (begin(5) | (F.substring(s, -6, 6) == F.substring(t, -6, 6))), True)  # the word's own ends
        .otherwise((kind == LAST) & begin(1))
    )
    return (
        F.when(w.isNull() | v.isNull(), True)
        .when(kind == END, ~begin(5))
        .when((kind == ALONE) & v.startswith(ALONE), True)
        .otherwise(_same(s, t) & ~elsewhere)
    )


def _tokens(names: Column, common: Sequence[str]) -> Column:
    """What keys are made of, each once: each longer word with each other word, ``a b``;
    each rare word, ``a``; a name of one long word as ``=`` and all its words."""

    def beside(s: Column) -> Column:
        words = F.split(s, " ")
        return F.flatten(F.transform(_words(s), lambda a: F.transform(F.filter(words, lambda b: b != a), lambda b: F.concat_ws(" ", a, b))))

    def single(s: Column) -> Column:
        return (F.size(_words(s)) == 0) | (F.size(F.array_distinct(F.filter(F.split(s, " "), lambda w: F.length(w) >= 3))) < 2)

    whole = F.transform(F.filter(names, single), lambda s: F.concat(F.lit("="), _sorted_words(s)))
    each = lambda of: F.flatten(F.transform(names, of))
    return F.array_distinct(F.flatten(F.array(each(beside), each(lambda s: _rare_words(s, common)), whole)))


#: Where keys hold: at the place of a row, inside a nation, anywhere, and anywhere for
#: lack of a place. Each is an array of numbers that a key is made with.
SPOTS = ("at", "inside", "anywhere", "lost")


def _keys(df: DataFrame, row: str, names: Column, common: Sequence[str]) -> DataFrame:
    """``row, k, w``: the keys of the ``names`` at the ``SPOTS`` of each row, and the word
    that a key carries.

    Anywhere hold the beginnings of a longer word and of another word, wherever they
    stand; for a name of one long word, all its words. Inside a nation short beginnings
    do, so an error in the middle of a short family name breaks none of them. Unless the
    longer word is rare on both sides, the other word has to be the same; a longer word
    that begins like no common one carries none.

    At a place hold the beginning and the end of a rare word, of which a typing error
    mostly spares one, and the family of a common word with the first and with the last
    letter of each other word: the block of the family, split. Names that agree beyond
    the common word have another word that is :func:`_same`, which shares one of these
    letters, so no such pair is lost. Without a place whole rare words serve like that.
    """
    frequent, shared, of = _is_common(common), _is_common(sorted({c[:3] for c in common})), families(common)
    token, a, b = F.col("token"), F.col("a"), F.col("b")
    family = F.when(frequent(a), F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[a]) if of else F.lit(None).cast("string")
    told = df.select(row, *SPOTS, F.explode(_tokens(names, common)).alias("token")).select(
        row, *SPOTS, "token", F.substring_index("token", " ", 1).alias("a"), F.when(token.contains(" "), F.substring_index("token", " ", -1)).alias("b"),
    ).select(row, *SPOTS, "token", "a", "b", family.alias("family"), ((F.length(b) >= 4) & ~frequent(b)).alias("own"))

    whole, pair = token.startswith("="), b.isNotNull()
    beside = F.when(shared(F.substring(a, 1, 3)), _carried(F.when(F.col("family").isNull(), ALONE).otherwise(BESIDE), b, F.col("own")))
    block = lambda kind, at: F.xxhash64(F.col("family"), F.lit(kind), F.substring(b, at, 1))
    split, none = pair & F.col("family").isNotNull() & (F.length(b) >= 3), F.lit(None).cast("string")
    made = [
        ("anywhere", whole, F.xxhash64("token"), none),
        ("anywhere", ~whole & pair & (F.length(b) >= 3), F.xxhash64(F.substring(a, 1, 4), F.substring(b, 1, 3)), beside),
        ("inside", ~whole & pair, F.xxhash64(F.substring(a, 1, 3), F.substring(b, 1, 1)), beside),
        ("at", ~whole & ~pair, F.xxhash64(F.lit("p"), F.substring(a, 1, 5)), none),
        ("at", ~whole & ~pair, F.xxhash64(F.lit("s"), F.substring(a, -6, 6)), _carried(END, a, F.lit(False))),
        ("lost", ~whole & ~pair, F.xxhash64("a"), none),
        *[("at", ~whole & split, block(kind, at), _carried(kind, b, F.col("own"))) for kind, at in ((FIRST, 1), (LAST, -1))],
        *[("lost", ~whole & split, block(kind, at), _carried(kind, b, F.lit(False))) for kind, at in ((FIRST, 1), (LAST, -1))],
    ]
    each = told.select(row, *SPOTS, F.inline(F.array(*[
        F.when(where & (F.size(spots) > 0), F.struct(F.lit(SPOTS.index(spots)).alias("where"), key.alias("key"), word.alias("w"))) for spots, where, key, word in made
    ]))).where(F.col("where").isNotNull())
    spots = F.coalesce(*[F.when(F.col("where") == i, F.col(name)) for i, name in enumerate(SPOTS)])
    return each.select(row, "key", "w", F.explode(spots).alias("spot")).select(row, F.xxhash64("spot", "key").alias("k"), "w")


def _sorted_words(folded: Column) -> Column:
    return F.array_join(F.array_sort(F.split(folded, " ")), " ")


def _skeleton(word: Column) -> Column:
    """Consonants of a word: spellings of one first name in several languages
    mostly differ in the vowels."""
    return F.translate(word, "aeiouyw", "")


def _same(s: Column, t: Column) -> Column:
    """Two words that are equal but for typing errors."""
    # typing errors seldom reach both ends of a word, so most words that
    # differ are told apart without counting edits
    end = s.startswith(F.substring(t, 1, 1)) | s.endswith(F.substring(t, -1, 1))
    near = (F.length(s) >= 4) & (F.length(t) >= 4) & end & F.levenshtein(s, t, 2).between(0, F.when(F.least(F.length(s), F.length(t)) < 6, 1).otherwise(2))
    return (s == t) | near


def _rare_hit(x: Column, rare: Column) -> Column:
    return F.exists(rare, lambda t: F.exists(x, lambda s: _same(s, t)))


def name_level(x: Column, y: Column, rare: Column, plain: Column | None = None) -> Column:
    """0 no rare word shared .. 4 all words of the shorter name, of two lists of
    words; equal names are level 5 and are told apart before.

    ``rare`` are the words of ``y`` that few bear. A family name is among them;
    agreement of common first names alone says nothing, unless ``plain`` says that
    ``x`` has common words only, and all of them agree.
    """

    def initial(s: Column, t: Column) -> Column:
        return ((F.length(s) == 1) & t.startswith(s)) | ((F.length(t) == 1) & s.startswith(t))

    def respelled_word(s: Column, t: Column) -> Column:
        least = F.least(F.length(s), F.length(t))
        return (
            s.startswith(F.substring(t, 1, 2))
            | (F.substring(s, -4, 4) == F.substring(t, -4, 4))
            | (_skeleton(s) == _skeleton(t))
            | ((least <= 4) & (F.substring(s, 1, 1) == F.substring(t, 1, 1)))
            | ((least <= 5) & (s.contains(F.substring(t, 1, 3)) | t.contains(F.substring(s, 1, 3))))
        )

    long_hits = F.size(F.filter(x, lambda s: (F.length(s) >= 3) & F.exists(y, lambda t: _same(s, t))))
    hits = F.size(F.filter(x, lambda s: F.exists(y, lambda t: _same(s, t) | initial(s, t))))
    respelled = F.size(F.filter(x, lambda s: (F.length(s) >= 2) & F.exists(y, lambda t: (F.length(t) >= 2) & respelled_word(s, t))))
    short = F.least(F.size(x), F.size(y))
    return (
        F.when(~_rare_hit(x, rare), 0 if plain is None else F.when(plain & (F.size(x) >= 2) & (F.size(x) <= F.size(y)) & (long_hits >= short), 4).otherwise(0))
        .when((short >= 2) & (long_hits >= short), 4)
        .when((short >= 2) & (hits >= short), 3)
        .when(respelled >= F.greatest(F.lit(2), short), 2)
        .otherwise(1)
    )


def estimate(patterns: pd.DataFrame, rounds: int = 100, tol: float = 1e-7) -> tuple[float, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Share of matches and the level probabilities of both classes, by EM.

    ``patterns`` has a column for each comparison and ``count``. Comparisons are
    independent within a class; starting values are pseudo-counts.
    """
    share = 0.3
    prob = {k: (np.array(m) / sum(m), np.array(u) / sum(u)) for k, (m, u) in LEVELS.items()}
    start = {k: (m.copy(), u.copy()) for k, (m, u) in prob.items()}
    n = patterns["count"].to_numpy(float)
    if not n.sum():
        return share, prob
    level = {k: patterns[k].to_numpy(int) for k in LEVELS}
    for _ in range(rounds):
        m = share * np.prod([prob[k][0][level[k]] for k in LEVELS], axis=0)
        u = (1 - share) * np.prod([prob[k][1][level[k]] for k in LEVELS], axis=0)
        g = n * m / (m + u)
        new_share = (g.sum() + 0.3 * PSEUDO) / (n.sum() + PSEUDO)
        for k in LEVELS:
            size = len(start[k][0])
            a = np.bincount(level[k], g, size) + PSEUDO * start[k][0]
            b = np.bincount(level[k], n - g, size) + PSEUDO * start[k][1]
            prob[k] = (a / a.sum(), b / b.sum())
        done = abs(new_share - share) < tol
        share = new_share
        if done:
            break
    return share, prob


def odds_of(share: float, prob: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """Odds of a match for every pattern, at its :func:`pattern` number."""
    out = []
    for levels in itertools.product(*[range(len(LEVELS[k][0])) for k in LEVELS]):
        ratio = share / (1 - share)
        for k, at in zip(LEVELS, levels):
            ratio *= prob[k][0][at] / prob[k][1][at]
        out.append(float(ratio))
    return out


def pattern(levels: dict[str, Column]) -> Column:
    """One number for a combination of levels, name first."""
    number = F.lit(0)
    for k in LEVELS:
        number = number * len(LEVELS[k][0]) + levels[k]
    return number.cast("int")


def _number(text: Column) -> Column:
    """A number for a text: numbers are aggregated without sorting."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def _nation_key(column: str) -> Column:
    return _number(F.col(column))


def _line(column: str) -> Column:
    """The line of a position, 1 to 4; null where it names none."""
    numbers = {p: "GK DF MF FW".split().index(line) + 1 for p, line in LINES.items()}
    return F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])[F.upper(F.trim(column))]


def player_profiles(players: DataFrame) -> DataFrame:
    """Of the master, one row a player: ``player_id, p_nation, p_line, stays,
    spelled``. Stays are clubs with the first and last day seen."""
    base = players.where(F.col("player_id").isNotNull())
    names = F.array_compact(F.array_distinct(F.array("display_name", "normalized_name", "statsbomb_name", "understat_name")))
    raw = base.select("player_id", F.explode(names).alias("raw")).distinct()
    bags = raw.select("player_id", folded_name("raw").alias("folded")).where("folded <> ''").groupBy("player_id").agg(F.collect_set("folded").alias("spelled"))
    seen = base.groupBy("player_id", "current_club").agg(
        F.min("last_updated_at").alias("first_day"), F.max("last_updated_at").alias("last_day"),
        F.max(_nation_key("country_code")).alias("nation"), F.max(_line("position")).alias("line"),
    )
    facts = (
        seen.withColumn("club", _number(folded_club("current_club")))
        .groupBy("player_id")
        .agg(F.max("nation").alias("p_nation"), F.max("line").alias("p_line"), F.collect_list(F.struct("club", "first_day", "last_day")).alias("stays"))
        .select("player_id", "p_nation", "p_line", F.filter("stays", lambda s: s["club"].isNotNull()).alias("stays"))
    )
    return facts.join(bags, "player_id")


def appearance_profiles(matches: DataFrame, teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """``roster_id, folded, club, nation, line, day``: one row an appearance.

    Of repeated and late rows of a ``roster_id`` the one loaded last counts. The
    list of nations is the bounded reference list; each worker keeps one matcher
    and reads every distinct writing once.
    """
    shared = matches.sparkSession.sparkContext.broadcast(team_matcher(teams, aliases))

    @pandas_udf("string")
    def code(s: pd.Series) -> pd.Series:
        matcher = shared.value
        seen = matcher.__dict__.setdefault("seen", {})
        out = []
        for text in s:
            if text is None:
                out.append(None)
                continue
            if text not in seen:
                if len(seen) > 200_000:
                    seen.clear()
                found = matcher.match(text, near=False)[0]
                seen[text] = None if found == UNMATCHED else found
            out.append(seen[text])
        return pd.Series(out, dtype=object)

    fields = ["player_name", "nation", "team_title", "position", "match_date"]
    one = (
        matches.where(F.col("roster_id").isNotNull())
        .groupBy("roster_id")
        .agg(F.max(F.struct("loaded_at", *fields)).alias("s"))
        .select("roster_id", *[F.col(f"s.{c}").alias(c) for c in fields])
    )
    coded = one.withColumn("nation", code("nation"))
    return coded.select(
        "roster_id", folded_name("player_name").alias("folded"), _number(folded_club("team_title")).alias("club"), _nation_key("nation").alias("nation"), _line("position").alias("line"),
        F.substring("match_date", 1, 10).try_cast("date").alias("day"),
    ).where("folded <> ''")


def common_words(master: DataFrame) -> list[str]:
    """Words that more than ``COMMON_SHARE`` of the players bear, in order."""
    words = F.array_distinct(F.flatten(F.transform("spelled", _words)))
    counts = master.select(F.explode(words).alias("word")).groupBy("word").count().where(F.col("count") > max(COMMON_LEAST, COMMON_SHARE * master.count()))
    return sorted(r["word"] for r in counts.toLocalIterator())


def candidates(apps: DataFrame, master: DataFrame) -> DataFrame:
    """``folded, found``: for each written name the players that it meets in a
    block, with the level of their best spelling and what is known of them."""
    common = common_words(master)
    at_club, at_nation = lambda c: F.xxhash64(F.lit("c"), c), lambda n: F.xxhash64(F.lit("n"), n)
    inside, anywhere, lost = lambda n: F.xxhash64(F.lit("g"), n), F.array(F.xxhash64(F.lit("h"))), F.array(F.xxhash64(F.lit("w")))
    numbers = lambda *of: F.array_distinct(F.array_compact(F.concat(*of)))
    if_known = lambda n, number: F.when(n.isNotNull(), number(n))

    nation = F.col("p_nation")
    known = master.select(
        "player_id", "spelled", numbers(F.transform("stays", lambda s: at_club(s["club"])), F.array(if_known(nation, at_nation))).alias("at"),
        numbers(F.array(if_known(nation, inside))).alias("inside"), anywhere.alias("anywhere"), lost.alias("lost"),
    )
    master_keys = _keys(known, "player_id", F.col("spelled"), common).withColumnRenamed("w", "v")

    nation = F.col("nation")
    spot = F.when(F.col("club").isNotNull(), at_club(F.col("club"))).otherwise(if_known(nation, at_nation))
    names = apps.groupBy("folded").agg(F.collect_set(F.struct(spot.alias("at"), if_known(nation, inside).alias("inside"))).alias("places"))
    # a name that is always written with its nation needs no key without one,
    # unless it is too short for a key inside the nation
    bare = F.exists("places", lambda p: p["inside"].isNull()) | ~F.col("folded").contains(" ")
    seen = names.select(
        "folded", numbers(F.col("places.at")).alias("at"), numbers(F.col("places.inside")).alias("inside"),
        F.when(bare, anywhere).alias("anywhere"), F.when(F.exists("places", lambda p: p["at"].isNull()), lost).alias("lost"),
    )
    name_keys = _keys(seen, "folded", F.array("folded"), common)

    # one exchange serves the distinct and the join with the players
    met = name_keys.join(master_keys, "k").where(_meets(F.col("w"), F.col("v"))).select("folded", "player_id").repartition("player_id").distinct()
    split = master.select(
        "player_id", "p_nation", "p_line", "stays",
        F.transform("spelled", _sorted_words).alias("sorted"),
        F.transform("spelled", lambda s: F.struct(F.split(s, " ").alias("w"), _rare_words(s, common).alias("r"))).alias("bags"),
    ).withColumn("rare", F.array_distinct(F.flatten("bags.r")))
    # most pairs of a block end at the first two tests
    level = F.when(F.array_contains("sorted", F.col("_key")), 5).when(~_rare_hit(F.col("_words"), F.col("rare")) & ~_plain(F.col("folded"), common), 0).otherwise(F.array_max(F.transform("bags", lambda b: name_level(F.col("_words"), b["w"], b["r"], _plain(F.col("folded"), common)))))
    scored = (
        met.select("folded", "player_id", F.split("folded", " ").alias("_words"), _sorted_words(F.col("folded")).alias("_key"))
        .join(split, "player_id")
        .select("folded", "player_id", "p_nation", "p_line", "stays", level.alias("name"))
        .where("name > 0")
    )
    return scored.groupBy("folded").agg(F.collect_list(F.struct("player_id", "name", "p_nation", "p_line", "stays")).alias("found"))


def link_appearances(matches: DataFrame, players: DataFrame, teams: DataFrame, aliases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``roster_id, player_id, confidence`` of the appearances that are linked.

    Unknown values of either side are a level of their own and speak for
    neither. Nameless appearances and those whose best candidate stays at or
    below ``threshold`` are unlinked, so two equally good players leave an
    appearance unlinked too. Empty sides give an empty result, extra columns are
    ignored, repeated rows change nothing.
    """
    ship(matches.sparkSession)
    master = cut(player_profiles(players))
    apps = cut(appearance_profiles(matches, teams, aliases))

    def compare(c: Column) -> Column:
        stays = F.filter(c["stays"], lambda s: s["club"] == F.col("club"))
        here = F.exists(stays, lambda s: F.col("day").between(F.date_sub(s["first_day"], SLACK_DAYS), F.date_add(s["last_day"], SLACK_DAYS)))
        levels = {
            "name": c["name"],
            "club": F.when(F.col("club").isNull(), 1).when(F.size(stays) == 0, 0).when(F.coalesce(here, F.lit(False)), 3).otherwise(2),
            "nation": F.when(F.col("nation").isNull() | c["p_nation"].isNull(), 1).when(F.col("nation") == c["p_nation"], 2).otherwise(0),
            "position": F.when(F.col("line").isNull() | c["p_line"].isNull(), 1).when(F.col("line") == c["p_line"], 2).otherwise(0),
        }
        return F.struct(c["player_id"].alias("player_id"), pattern(levels).alias("pattern"))

    # everything from here on happens inside the row of an appearance
    compared = cut(apps.join(candidates(apps, master), "folded").select("roster_id", F.transform("found", compare).alias("found")))
    counts = compared.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").count().toPandas()
    at = counts["pattern"].to_numpy(int)
    for k in reversed(list(LEVELS)):
        counts[k] = at % len(LEVELS[k][0])
        at = at // len(LEVELS[k][0])
    odds = F.lit(odds_of(*estimate(counts)))
    least = LEAST_NAME * int(np.prod([len(LEVELS[k][0]) for k in list(LEVELS)[1:]]))
    rated = F.transform(F.filter("found", lambda c: c["pattern"] >= least), lambda c: F.struct(F.element_at(odds, c["pattern"] + 1).alias("odds"), c["player_id"].alias("player_id")))
    top, total = F.array_max(F.col("rated")), F.aggregate("rated", F.lit(0.0), lambda acc, c: acc + c["odds"])
    best = compared.select("roster_id", rated.alias("rated")).where(F.size("rated") > 0)
    linked = best.select("roster_id", top["player_id"].alias("player_id"), (top["odds"] / (1 + total)).alias("confidence"))
    return linked.where(F.col("confidence") > threshold)
