"""Names of national teams as somebody wrote them, resolved to listed codes.

The list of teams is a dimension: its size is checked and it travels to the
workers whole, so resolving is a narrow stage without a shuffle, whatever share
of the rows one writing has. :func:`codes_sql` states the same rule as SQL.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from touchline.session import ship

#: Entries of the list (names, aliases and codes) that each worker may hold.
MAX_ENTRIES = 50_000

# Letters of other scripts that look like a Latin letter, and that letter.
LOOK_ALIKES = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικχωτ" + "АВЕЅІЈКМНОРСТУХаеѕіјорсухкԁԛԝһѵ", "ABEZHIKMNOPTYXavopuikxwt" + "ABESIJKMHOPCTYXaesijopcyxkdqwhv")
# What is written around a name without belonging to it.
AROUND = r"\b(?:to (?:win|advance|qualify)|national team|nt|team|side|the|host|m|w|f)\b"
#: Shortest beginning that a full stop may stand for, and the edits that a key
#: below or from ``NEAR_FROM`` characters may have.
SHORTENED, NEAR_FROM, NEAR = 4, 7, (1, 2)

_FULL_WIDTH = ("".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))
_PLAIN = str.maketrans(*LOOK_ALIKES)
_OTHER = re.compile("[^a-z0-9]+")
_AROUND = re.compile(AROUND)


def name_key(text: str) -> str:
    """Words of [a-z0-9] of a name: look-alikes, accents and invisible characters
    taken off; ``Name, North`` is read as ``North Name``."""
    head, comma, tail = text.partition(",")
    text = f"{tail} {head}" if comma else text
    text = unicodedata.normalize("NFKD", text.translate(_PLAIN))
    kept = "".join(c for c in text if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf")
    return _OTHER.sub(" ", kept.lower()).strip()


def edits(a: str, b: str) -> int:
    """Levenshtein distance, one machine word a row."""
    if not a or not b:
        return len(a) + len(b)
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for ch in b:
        eq = masks.get(ch, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(flat | up) & full, up & flat
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, (less << 1) & full
        up, down = less | ~(eq | down | more) & full, more & (eq | down)
    return score


@dataclass
class TeamList:
    """Keys of names, and codes, of the listed teams."""

    names: dict[str, str] = field(default_factory=dict)
    codes: dict[str, str] = field(default_factory=dict)
    #: The key of each team's own name.
    own: dict[str, str] = field(default_factory=dict)
    seen: dict[str, str | None] = field(default_factory=dict)

    @classmethod
    def of(cls, teams: list[tuple[str, str, str | None]], aliases: list[tuple[str, str]]) -> TeamList:
        """From ``(code, name, two-letter code)`` and ``(alias, code)`` rows; the
        least code counts where two teams share a writing."""
        out = cls()
        for code, name, iso in sorted((c, n or "", i or "") for c, n, i in teams if c):
            out.own.setdefault(code, name_key(name))
            for short in (code, iso):
                if short.strip():
                    out.codes[short.strip().lower()] = min(code, out.codes.get(short.strip().lower(), code))
        for name, code in [(n, c) for c, n, _ in teams if c and n] + [(a, c) for a, c in aliases if a and c]:
            if key := name_key(name):
                out.names[key] = min(code, out.names.get(key, code))
        return out

    def code(self, typed: str | None) -> str | None:
        """The code that a writing means; None where it means none or several."""
        if typed is None:
            return None
        if typed not in self.seen:
            if len(self.seen) > 1 << 17:
                self.seen.clear()
            self.seen[typed] = self._read(typed)
        return self.seen[typed]

    def _read(self, typed: str) -> str | None:
        key = name_key(typed)
        clean = " ".join(_AROUND.sub(" ", key).split())
        head, _, last = clean.rpartition(" ")
        exact = self.names.get(key) or self.codes.get(key) or self.names.get(clean) or self.codes.get(clean)
        exact = exact or (self.names.get(head) if last in self.codes else None)
        if exact or not clean:
            return exact
        if typed.rstrip().endswith(".") and len(clean) >= SHORTENED:
            meant = {code for name, code in self.names.items() if name.startswith(clean)}
            if len(meant) == 1:
                return meant.pop()
        room = NEAR[len(clean) >= NEAR_FROM]
        best: dict[int, set[str]] = {}
        letters = set(clean)
        for name, code in self.names.items():
            if abs(len(name) - len(clean)) <= room and len(letters.symmetric_difference(name)) <= 2 * room:
                best.setdefault(edits(clean, name), set()).add(code)
        least = min(best, default=room + 1)
        return best[least].pop() if least <= room and len(best[least]) == 1 else None


def team_list(teams: DataFrame, aliases: DataFrame, most: int = MAX_ENTRIES) -> TeamList:
    """The list of a teams table and an aliases table, of a checked size."""
    a, b = teams.select("team_code", "team_name", "iso2_code"), aliases.select("alias", "team_code")
    if 3 * a.count() + b.count() > most:
        raise ValueError("the list of teams is too long to be held by each worker")
    return TeamList.of([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()])


def with_team_codes(df: DataFrame, columns: dict[str, str], listed: TeamList) -> DataFrame:
    """Add a code column for each written column; what means no listed team has null.

    ``columns`` maps written columns to the names of their code columns. Rows are
    neither moved nor multiplied; other columns stay.
    """
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(listed)

    @pandas_udf("string")
    def code(s: pd.Series) -> pd.Series:
        known = shared.value.code
        return pd.Series([known(x) for x in s], dtype=object)

    return df.withColumns({into: code(F.col(c)) for c, into in columns.items()})


def own_name(code: Column, listed: TeamList) -> Column:
    """The key of the listed name of a code."""
    return F.create_map(*[F.lit(x) for kv in listed.own.items() for x in kv])[code] if listed.own else F.lit(None).cast("string")


def key_sql(text: str) -> str:
    """SQL of :func:`name_key`."""
    ordered = f"CASE WHEN contains({text}, ',') THEN substr({text}, strpos({text}, ',') + 1) || ' ' || split_part({text}, ',', 1) ELSE {text} END"
    unseen = f"regexp_replace({ordered}, '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g')"
    frm, to = (a + b.replace("'", "''") for a, b in zip(LOOK_ALIKES, _FULL_WIDTH))
    return f"trim(regexp_replace(lower(strip_accents(translate({unseen}, '{frm}', '{to}'))), '[^a-z0-9]+', ' ', 'g'))"


def codes_sql(values: str) -> str:
    """SQL ``typed, code`` of the distinct ``typed`` of a query, by the rule of
    :class:`TeamList`; rows that mean no team are left out."""
    return f"""
(WITH nm AS (SELECT k, min(c) AS c FROM (SELECT {key_sql('team_name')} AS k, team_code AS c FROM teams UNION ALL SELECT {key_sql('alias')}, team_code FROM team_aliases) WHERE k <> '' AND c IS NOT NULL GROUP BY 1),
cd AS (SELECT k, min(c) AS c FROM (SELECT lower(trim(team_code)) AS k, team_code AS c FROM teams UNION ALL SELECT lower(trim(iso2_code)), team_code FROM teams) WHERE k <> '' AND c IS NOT NULL GROUP BY 1),
v0 AS (SELECT typed, {key_sql('typed')} AS k FROM (SELECT DISTINCT typed FROM ({values}) WHERE typed IS NOT NULL)),
v AS (SELECT typed, k, trim(regexp_replace(regexp_replace(k, '{AROUND}', ' ', 'g'), ' +', ' ', 'g')) AS q FROM v0),
w AS (SELECT *, regexp_replace(q, ' ?[^ ]*$', '') AS head, regexp_extract(q, '[^ ]*$') AS last FROM v),
x AS (SELECT w.*, coalesce(a.c, b.c, d.c, e.c, CASE WHEN g.c IS NOT NULL THEN f.c END) AS c FROM w LEFT JOIN nm a ON a.k = w.k LEFT JOIN cd b ON b.k = w.k LEFT JOIN nm d ON d.k = q LEFT JOIN cd e ON e.k = q LEFT JOIN nm f ON f.k = head LEFT JOIN cd g ON g.k = last),
s AS (SELECT typed, min(nm.c) AS c FROM x JOIN nm ON starts_with(nm.k, q) WHERE x.c IS NULL AND rtrim(typed) LIKE '%.' AND length(q) >= {SHORTENED} GROUP BY 1 HAVING count(DISTINCT nm.c) = 1),
n0 AS (SELECT typed, nm.c, levenshtein(q, nm.k) AS d FROM x JOIN nm ON levenshtein(q, nm.k) <= CASE WHEN length(q) >= {NEAR_FROM} THEN {NEAR[1]} ELSE {NEAR[0]} END WHERE x.c IS NULL AND q <> ''),
n AS (SELECT typed, min(c) AS c FROM n0 WHERE d = (SELECT min(d) FROM n0 o WHERE o.typed = n0.typed) GROUP BY 1 HAVING count(DISTINCT c) = 1)
SELECT x.typed, coalesce(x.c, s.c, n.c) AS code FROM x LEFT JOIN s USING (typed) LEFT JOIN n USING (typed) WHERE coalesce(x.c, s.c, n.c) IS NOT NULL)"""
