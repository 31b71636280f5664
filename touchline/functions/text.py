"""Name keys and similarities for matching people, teams and clubs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from touchline.session import ship

_OTHER = re.compile(r"[^a-z0-9\s-]")


@lru_cache(maxsize=1 << 16)
def normalize(name: str) -> str:
    """Lower-case ASCII words and hyphens, accents dropped."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return " ".join(_OTHER.sub(" ", plain.lower()).split())


# Ligatures and the letters that their compatibility form has.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: What an accent stripper of SQL drops although it is no accent, and spaces beyond ASCII.
_UNSEEN = "\u00ad\u034f\u061c" + "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10)])) + "\ufeff"
_SPACES = "\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


_TO_SPACE = str.maketrans(_SPACES, " " * len(_SPACES))


def normal_sql(text: str) -> str:
    """SQL of :func:`normalize`."""
    full, plain = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
    seen = f"translate({text}, '{_UNSEEN}{_SPACES}{full}', '{' ' * len(_UNSEEN + _SPACES)}{plain}')"
    for one, two in LIGATURES.items():
        seen = f"replace({seen}, '{one}', '{two}')"
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({seen})), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def bare_sql(text: str) -> str:
    """SQL of :func:`bare`; characters that SQL would drop with the accents stand
    aside in the private area meanwhile."""
    aside = "".join(chr(0xE000 + i) for i in range(len(_UNSEEN)))
    return f"lower(translate(strip_accents(translate({text}, '{_UNSEEN}{_SPACES}', '{aside}{' ' * len(_SPACES)}')), '{aside}', '{_UNSEEN}'))"


def simple_sql(text: str) -> str:
    """SQL of :func:`simplify`."""
    words = f"string_split_regex(trim({bare_sql(text)}), '\\s+')"
    return f"CASE WHEN len({words}) < 2 THEN {words}[1] ELSE {words}[1] || ' ' || {words}[-1] END"


@lru_cache(maxsize=1 << 16)
def bare(name: str) -> str:
    """Lower case without accents, with ordinary spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).lower()
    return plain.translate(_TO_SPACE)


@lru_cache(maxsize=1 << 16)
def simplify(name: str) -> str:
    """First and last word, in lower case without accents."""
    plain = bare(name).split()
    return " ".join(plain if len(plain) < 2 else (plain[0], plain[-1]))


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the total length, in percent.

    The subsequence is counted with bit vectors, one machine operation a
    character of ``b`` for names of usual length.
    """
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & masks.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    common = len(a) - bin(state).count("1")
    return 200.0 * common / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and each side's words with them."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_x or not only_y):
        return 100.0
    left, right = f"{shared} {only_x}".strip(), f"{shared} {only_y}".strip()
    best = indel_ratio(left, right)
    if shared:
        best = max(best, indel_ratio(shared, left), indel_ratio(shared, right))
    return best


def _text_udf(fn):
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return run


def _ratio_udf(fn):
    @pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def with_normalized(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add the normalized name; plain ASCII rows never leave the JVM."""
    ship(df.sparkSession)
    col = F.col(column)
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^a-z0-9\s-]", " "), r"\s+", " "))
    odd = F.when(col.rlike(r"[^\x00-\x7f]"), col)
    return df.withColumn(into, F.coalesce(_text_udf(normalize)(odd), plain))


def with_bare(df: DataFrame, column: str, into: str) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(into, _text_udf(bare)(F.col(column)))


def with_simplified(df: DataFrame, column: str, into: str) -> DataFrame:
    ship(df.sparkSession)
    return df.withColumn(into, _text_udf(simplify)(F.col(column)))


def with_ratio(df: DataFrame, a: str, b: str, into: str, kind: str = "set") -> DataFrame:
    """Add the token-set or token-sort ratio of two name columns."""
    ship(df.sparkSession)
    return df.withColumn(into, _ratio_udf({"set": token_set_ratio, "sort": token_sort_ratio}[kind])(F.col(a), F.col(b)))


def country_code(value: Column, names: dict[str, str], iso2: dict[str, str]) -> Column:
    """A three-letter code from a code, a two-letter code or a known name.

    Both tables are short fixed lists. Unknown values give null.
    """
    text = F.trim(value)
    lookup = lambda table, key: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key] if table else F.lit(None).cast("string")
    return F.when(text.rlike("^[A-Z]{3}$"), text).otherwise(F.coalesce(lookup(iso2, F.upper(text)), lookup({k.lower(): v for k, v in names.items()}, F.lower(text))))
