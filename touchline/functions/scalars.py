"""Scalar rules as column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Months of a ticker, tournament weights in the order in which they
# are tried, pitch bounds in yards and the league factors.
MONTHS = {"JAN": 1, "FEB": 2, "MAR": 3, "APR": 4, "MAY": 5, "JUN": 6, "JUL": 7, "AUG": 8, "SEP": 9, "OCT": 10, "NOV": 11, "DEC": 12}
FINAL_THIRD_X, BOX_X, BOX_Y, PROGRESS = 80.0, 102.0, (18.0, 62.0), 9.14
TICKER = r"^KX[A-Z]+-(\d{2})([A-Z]{3})(\d{2})([A-Z]{3})([A-Z]{3})"


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_even(x: Column, digits: int) -> Column:
    """Rounding of ported data-frame code; SQL's own is half away from zero."""
    return F.bround(x, digits)


def ticker_part(ticker: Column, i: int) -> Column:
    """Part ``i`` of a game ticker (year, month, day, two sides), null if it is none."""
    part = F.regexp_extract(ticker, TICKER, i)
    return F.when(part != "", part)


def ticker_day(ticker: Column) -> Column:
    """ISO day of a game ticker."""
    months = F.create_map(*[F.lit(x) for m, n in MONTHS.items() for x in (m, f"{n:02d}")])
    month = months[ticker_part(ticker, 2)]
    return F.when(month.isNotNull(), F.concat(F.lit("20"), ticker_part(ticker, 1), F.lit("-"), month, F.lit("-"), ticker_part(ticker, 3)))


def suffix(text: Column, sep: str = "-") -> Column:
    return F.element_at(F.split(text, re.escape(sep)), -1)


def group_letter(slug: Column) -> Column:
    """The group of a slug like ``...group-b...``, in upper case."""
    letter = F.upper(F.regexp_extract(F.lower(slug), r"group-([a-l])(?:-|$)", 1))
    return F.when(letter != "", letter)


def json_price(names: Column, prices: Column, wanted: str = "Yes") -> Column:
    """The price at the position of ``wanted`` in two JSON-in-string lists.

    0 if the name isn't there, null if either text is no JSON list.
    """
    n, p = F.from_json(names, "array<string>"), F.from_json(prices, "array<string>")
    at = F.array_position(n, wanted)
    return F.when(n.isNotNull() & p.isNotNull(), F.coalesce(F.when(at > 0, F.try_element_at(p, at.cast("int"))).try_cast("double"), F.lit(0.0)))


def keyword_weight(text: Column, weights: Sequence[tuple[str, float]], default: float, longest: bool = False) -> Column:
    """Weight of the first keyword that the text holds, or of the longest one."""
    order = sorted(weights, key=lambda kv: -len(kv[0])) if longest else weights
    low = F.lower(text)
    out = F.lit(default)
    for word, weight in reversed(order):
        out = F.when(low.contains(word.lower()), F.lit(float(weight))).otherwise(out)
    return out


def time_decay(days: Column, xi: float) -> Column:
    return F.exp(-F.lit(xi) * days)


def clean_names(names: Sequence[object]) -> list[str]:
    """Column names in one form; tuples of a two-level header are joined."""
    out = []
    for name in names:
        parts = name if isinstance(name, (tuple, list)) else (name,)
        text = "_".join(str(p) for p in parts if p and not str(p).startswith("Unnamed"))
        out.append(re.sub(r"[^0-9a-z]+", "_", text.lower().replace("%", "pct")).strip("_"))
    return out


def is_progressive(x0: Column, x1: Column) -> Column:
    """Forward by at least ten yards; unknown positions are not."""
    return F.coalesce(x1 - x0 >= PROGRESS, F.lit(False))


def in_final_third(x: Column) -> Column:
    return F.coalesce(x >= FINAL_THIRD_X, F.lit(False))


def in_box(x: Column, y: Column) -> Column:
    return F.coalesce((x >= BOX_X) & y.between(*BOX_Y), F.lit(False))


def epoch_day(seconds: Column) -> Column:
    """UTC day of epoch seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def share_percent(a: Column, b: Column) -> Column:
    """Share of ``a`` in percent; half where there is nothing to share."""
    total = a + b
    return F.when(total > 0, F.bround(a / total * 100, 1)).otherwise(F.lit(50.0))


def variation(values: Column) -> Column:
    """Population coefficient of variation of an array of numbers."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / n
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n)
    return F.when((n > 0) & (mean != 0), spread / mean)


def confidence_label(team: Column, hosts: Sequence[str], rating: Column, high: float = 0.45) -> Column:
    return F.when(team.isin(*hosts), "host").when(rating >= high, "high").when(rating.isNotNull(), "medium").otherwise("low")


def plain_number(text: Column) -> Column:
    """A number without thousands separators; null where there is none."""
    return F.regexp_replace(text, r"[,\s ']", "").try_cast("double")


def birth_year(text: Column) -> Column:
    """First four digits as a year between 1900 and 2030."""
    year = F.substring(text, 1, 4).try_cast("int")
    return F.when(year.between(1900, 2030), year)


def accents_off(text: Column, pairs: Mapping[str, str] | None = None) -> Column:
    """Accents of Latin letters dropped, for columns that hold no others."""
    plain = pairs or {"àáâãäåāăą": "a", "çćč": "c", "ďđ": "d", "èéêëēęě": "e", "ğ": "g", "ìíîïīı": "i", "ł": "l", "ñńň": "n", "òóôõöøō": "o", "ř": "r", "śşš": "s", "ťţ": "t", "ùúûüūů": "u", "ýÿ": "y", "źżž": "z"}
    frm = "".join(plain)
    to = "".join(v * len(k) for k, v in plain.items())
    return F.translate(F.lower(text), frm, to)


# What is announced, the kind that it tells, in the order in which they
# are tried, and how the day follows.
ANNOUNCED = [(r"\b(?:Preliminary|Provisional)\s+(?:squad|roster|toster)", "preliminary"), (r"\bFinal\s+squad", "final"), (r"\bRoster", "final")]
ANNOUNCED_DAY = r"\s+(?:was\s+)?announced(?:\s+on)?\s+([A-Z][a-z]+\s+\d{1,2})"


def announcement(text: Column) -> Column:
    """``struct(type, day)`` of an announcement; nulls where it says nothing."""
    kind, day = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name in reversed(ANNOUNCED):
        found = F.regexp_extract(text, what + ANNOUNCED_DAY, 1)
        kind, day = F.when(found != "", name).otherwise(kind), F.when(found != "", found).otherwise(day)
    return F.struct(kind.alias("type"), day.alias("day"))
