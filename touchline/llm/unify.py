"""One consistent form for text that only looks the same.

Each token's script set is resolved as the intersection of its characters'
script sets. A token whose set is empty mixes scripts; a token wholly in another
script than the name, of which every letter has a look-alike in the name's
script, is a whole-script confusable. Both are spelled in the name's own script.
Compatibility forms become plain, accents are composed, invisible characters go
and every kind of space becomes the ordinary one.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from touchline.session import ship

# Letters of other scripts that look like a Latin letter.
_GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικχϲγωτ", "ABEZHIKMNOPTYXavopuikxcywt"))
_CYRILLIC_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХЫЗаеѕіјорсухкԁԛԝһӏѵгпт", "ABESIJKMHOPCTYX\0\0aesijopcyxkdqwhlv\0\0\0"))
_ARMENIAN_LATIN = dict(zip("ՕՍօսոցզհ", "OUounght"))
#: Hyphens and quotes that stand for the plain ones.
_MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "’": "'", "‘": "'", "ʼ": "'", "ʹ": "'"}
#: Only these hyphens can't be told from the plain one.
_SAME_MARKS = {"‐": "-", "‑": "-", "−": "-"}

# Letter-by-letter Latin spelling of the two scripts.
_CYRILLIC_SPELLED = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i j k l m n o p r s t u f h c ch sh sch _ y _ e yu ya".split()))
_GREEK_SPELLED = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z i th i k l m n x o p r s s t u f h ps o".split()))
SPELLED = {k: "" if v == "_" else v for k, v in {**_CYRILLIC_SPELLED, **_GREEK_SPELLED, "і": "i", "ѕ": "s", "ј": "j"}.items()}

TO_LATIN = {k: v for t in (_GREEK_LATIN, _CYRILLIC_LATIN, _ARMENIAN_LATIN) for k, v in t.items() if v != "\0"}
TO_GREEK = {v: k for k, v in _GREEK_LATIN.items()}
TO_CYRILLIC = {v: k for k, v in _CYRILLIC_LATIN.items() if v != "\0"}
#: Letters of the third script go to the second through Latin.
_TO = {
    "Latin": TO_LATIN,
    "Greek": {**TO_GREEK, **{k: TO_GREEK[v] for k, v in _CYRILLIC_LATIN.items() if v in TO_GREEK}},
    "Cyrillic": {**TO_CYRILLIC, **{k: TO_CYRILLIC[v] for k, v in _GREEK_LATIN.items() if v in TO_CYRILLIC}},
}
_AMBIGUOUS = set(TO_LATIN) | set(TO_LATIN.values())


@lru_cache(maxsize=1 << 16)
def script(char: str) -> str:
    """Script of a character by its Unicode name; empty for common ones."""
    if not char.isalpha():
        return ""
    if char.isascii():
        return "Latin"
    first = unicodedata.name(char, "").split(" ")[0]
    return {"LATIN": "Latin", "GREEK": "Greek", "CYRILLIC": "Cyrillic", "FULLWIDTH": "Latin"}.get(first, first.capitalize())


@lru_cache(maxsize=1 << 16)
def invisible(char: str) -> bool:
    """Format controls, the grapheme joiner, fillers and variation selectors."""
    code = ord(char)
    return (
        unicodedata.category(char) in ("Cf", "Cc") and char not in "\t\n\r\v\f\x85"
        or code in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= code <= 0x180F
        or 0xFE00 <= code <= 0xFE0F
        or 0xE0000 <= code <= 0xE0FFF
    )


def resolved_scripts(token: str) -> set[str] | None:
    """Intersection of the script sets of a token; None stands for any script.

    A look-alike belongs only to its own script here: that it could be read as
    another is what :func:`unify` decides by.
    """
    out: set[str] | None = None
    for char in token:
        own = script(char)
        if own:
            out = {own} if out is None else out & {own}
    return out


def own_script(text: str) -> str:
    """Script of most letters, those without a look-alike first."""
    sure: dict[str, int] = {}
    every: dict[str, int] = {}
    for char in text:
        base = unicodedata.normalize("NFD", char)[0]
        s = script(base)
        if s:
            every[s] = every.get(s, 0) + 1
            if base not in _AMBIGUOUS:
                sure[s] = sure.get(s, 0) + 1
    counts = sure or every
    return max(sorted(counts), key=lambda s: (counts[s], every[s])) if counts else ""


def _spell(token: str, own: str) -> str:
    table = _TO.get(own)
    scripts = resolved_scripts(token)
    if table is None or scripts is None or scripts == {own}:
        return token
    letters = [c for c in token if script(c)]
    if scripts and not all(unicodedata.normalize("NFD", c)[0] in table for c in letters):
        return token
    out = []
    for char in token:
        base, *rest = unicodedata.normalize("NFD", char)
        out.append(table[base] + "".join(rest) if script(base) not in ("", own) and base in table else char)
    return unicodedata.normalize("NFC", "".join(out))


#: Printable ASCII and composed accented Latin letters that have no plainer form:
#: such a text can only be spaced wrongly.
_PLAIN_LATIN = re.compile("[ -~À-ÖØ-öø-ıĴ-ľŁ-ňŊ-ž]*")


def unify(text: str | None) -> str | None:
    """The consistent form of a name; null stays null, blank becomes empty."""
    if text is None:
        return None
    if _PLAIN_LATIN.fullmatch(text):
        return " ".join(text.split()) if "  " in text or text[:1] == " " or text[-1:] == " " else text
    text = "".join(c for c in text if not invisible(c))
    text = unicodedata.normalize("NFKC", text)
    text = "".join(_SAME_MARKS.get(c, c) for c in text if not invisible(c))
    own = own_script(text)
    return " ".join(_spell(t, own) for t in text.split())


_ASCII_WORD = re.compile(r"[a-z0-9]+")
_RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=1 << 16)
def _fold_run(run: str) -> str:
    out = []
    for char in unicodedata.normalize("NFKD", run):
        if unicodedata.combining(char) or invisible(char):
            continue
        char = _MARKS.get(char, char)
        out.append(TO_LATIN.get(char, char))
    return "".join(out)


def fold_text(text: str) -> str:
    """A key for comparing long texts: lower case, without accents, invisible
    characters and look-alikes. Only runs beyond ASCII cost anything."""
    if not text.isascii():
        text = _RUN.sub(lambda m: _fold_run(m.group()), text)
    return text.lower() if text.isascii() else text.casefold()


@lru_cache(maxsize=1 << 16)
def fold_name(text: str) -> str:
    """A key for comparing names: unified, spelled in Latin, words of [a-z0-9]."""
    if _PLAIN_LATIN.fullmatch(text):
        return " ".join(_ASCII_WORD.findall(fold_text(text).replace("'", "")))
    text = unify(text) or ""
    if own_script(text) in ("Greek", "Cyrillic"):
        text = "".join(SPELLED.get(c, c) for c in text.casefold())
    return " ".join(re.findall(r"[^\W_]+", fold_text(text).replace("'", "")))


def needs_unifying(col):
    """A cheap JVM-side test: False only where the text surely is in form."""
    return F.coalesce(col.rlike(r"[^ -~]|  |^ | $"), F.lit(False))


def unify_column(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add ``into``, the consistent form of ``column``.

    Plain ASCII rows, nearly all in most data, never leave the JVM: the Python
    stage sees null for them. Null stays null; other columns are kept, and
    ``into`` replaces a column of that name.
    """
    ship(df.sparkSession)

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(unify, na_action="ignore")

    odd = F.when(needs_unifying(F.col(column)), F.col(column))
    return df.withColumn(into, F.coalesce(run(odd), F.col(column)))


def find_inconsistent(df: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """``table_name, row_key``: rows whose ``column`` isn't in the consistent form.

    Null names are no case. Rows that ASCII clears are dropped before the
    Python stage. Repeated rows give one row.
    """
    odd = df.where(needs_unifying(F.col(column))).select(F.col(key).cast("string").alias("row_key"), F.col(column).alias("_name"))
    return (
        unify_column(odd, "_name", "_form")
        .where(F.col("_form") != F.col("_name"))
        .select(F.lit(label).alias("table_name"), "row_key")
        .distinct()
    )
