"""Rosters in HTML: headings and paragraphs, tables, and rows by pattern."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from touchline.session import ship

POSITIONS = {"goalkeepers": "GK", "defenders": "DF", "midfielders": "MF", "forwards": "FW", "gk": "GK", "df": "DF", "mf": "MF", "fw": "FW"}
_ID = re.compile(r"/player/_/id/(\d+)")
_ESCAPED, _KEPT = re.compile(r"\\(.)", re.S), re.compile("\0(\\d+)\0")


def split_players(text: str, ids: dict[str, str] | None = None, bucket: str | None = None) -> list[dict[str, str | None]]:
    """Players of ``Name (Club), Name (Club)``; a comma inside parentheses parts
    nothing. Clubs hold no parentheses, so a second opening one shows that the first
    was never closed: the player before the last comma ends there, and without a
    comma the club does. A missing parenthesis at the end is closed. A character
    after a backslash stands for itself."""
    kept: list[str] = []
    text = _ESCAPED.sub(lambda m: kept.append(m.group(1)) or f"\0{len(kept) - 1}\0", text)
    whole = lambda s: _KEPT.sub(lambda m: kept[int(m.group(1))], s)
    parts, depth, part = [], 0, ""
    for ch in text:
        if ch == "," and depth <= 0:
            parts.append(part)
            part, depth = "", 0
            continue
        if ch == "(" and depth > 0:
            ended, comma, begun = part.rpartition(",")
            parts.append(f"{ended if comma and '(' in ended else part})")
            part, depth = begun if comma and "(" in ended else "", 0
        depth = max(0, depth + (ch == "(") - (ch == ")"))
        part += ch
    out = []
    for entry in (p.strip().strip(".").strip() for p in [*parts, part]):
        m = re.match(r"^(.*?)\s*(?:\((.*?)\)?)?\s*$", entry)
        name = whole(m.group(1) if m else entry).strip()
        club = whole(m.group(2)).strip() or None if m and m.group(2) else None
        if name:
            out.append({"espn_player_id": (ids or {}).get(name), "name": name, "position_bucket": bucket, "club": club})
    return out


class _Roster(HTMLParser):
    """A walk over headings (nation), bold text (position) and paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict[str, str | None]] = []
        self.group = self.nation = None
        self.tag: str | None = None
        self.text = ""
        self.strong = ""
        self.in_strong = False
        self.link: str | None = None
        self.label = ""
        self.ids: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("h1", "h2", "h3", "h4", "p"):
            self._flush()
            self.tag, self.text, self.strong, self.ids = tag, "", "", {}
        elif tag in ("strong", "b"):
            self.in_strong = True
        elif tag == "a":
            m = _ID.search(dict(attrs).get("href") or "")
            self.link, self.label = (m.group(1) if m else None), ""

    def handle_endtag(self, tag: str) -> None:
        if tag in ("strong", "b"):
            self.in_strong = False
        elif tag == "a":
            if self.link and self.label.strip():
                self.ids[self.label.strip()] = self.link
            self.link = None
        elif tag == self.tag:
            self._flush()

    def handle_data(self, data: str) -> None:
        if self.tag is None:
            return
        if self.in_strong:
            self.strong += data
        else:
            self.text += data
        if self.link is not None:
            self.label += data

    def _flush(self) -> None:
        tag, self.tag = self.tag, None
        words = " ".join((self.strong + " " + self.text).split())
        if tag in ("h1", "h2", "h3", "h4") and words:
            m = re.match(r"(?i)^group ([a-l])$", words)
            if m:
                self.group = m.group(1).upper()
            else:
                self.nation = words
        elif tag == "p" and self.nation:
            bucket = POSITIONS.get(self.strong.strip().rstrip(":").lower())
            if bucket:
                for player in split_players(self.text.lstrip(" :"), self.ids, bucket):
                    self.rows.append({"nation": self.nation, "group": self.group, **player})


class _Tables(HTMLParser):
    """Cells of every table of a class, row by row."""

    def __init__(self, css: str) -> None:
        super().__init__(convert_charrefs=True)
        self.css, self.depth = css, 0
        self.rows: list[list[str]] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            if self.depth or self.css in (dict(attrs).get("class") or "").split():
                self.depth += 1
        elif self.depth and tag == "tr":
            self.row = []
        elif self.depth and tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.rows.append(self.row)
            self.row = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def parse_roster(html: str | None) -> list[dict[str, str | None]]:
    """Players of a roster page; within a nation each once, by id, else by name."""
    walk = _Roster()
    walk.feed(html or "")
    walk.close()
    walk._flush()
    seen, out = set(), []
    for row in walk.rows:
        key = (row["nation"], row["espn_player_id"] or row["name"].lower())
        if key not in seen:
            seen.add(key)
            out.append(row)
    return out


def parse_tables(html: str | None, css: str = "wikitable") -> list[dict[str, str]]:
    """Rows of the tables as records under cleaned header names."""
    from touchline.functions.scalars import clean_names

    walk = _Tables(css)
    walk.feed(html or "")
    out, header = [], None
    for row in walk.rows:
        if header is None or (len(row) == len(header) and clean_names(row) == header):
            header = clean_names(row)
        elif len(row) == len(header):
            out.append(dict(zip(header, row)))
        else:
            header = clean_names(row) if len(row) > 1 else None
    return out


_ROSTER_SCHEMA = "nation string, `group` string, espn_player_id string, name string, position_bucket string, club string"


def roster_scan(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row a player of every roster page."""
    ship(pages.sparkSession)
    names = ["nation", "group", "espn_player_id", "name", "position_bucket", "club"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for page in batch["page"] for r in parse_roster(page)], columns=names)

    return pages.select(F.col(html).alias("page")).mapInPandas(run, _ROSTER_SCHEMA)


def table_scan(pages: DataFrame, columns: list[str], html: str = "html", css: str = "wikitable") -> DataFrame:
    """The named columns of every table row of every page, as text."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[r.get(c) for c in columns] for page in batch["page"] for r in parse_tables(page, css)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.select(F.col(html).alias("page")).mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))


def escaped(text: Column) -> Column:
    """``text`` as it can stand in a page."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def listed(text: Column) -> Column:
    """``text`` as it can stand in a list of players."""
    return F.regexp_replace(text, r"([\\,().])", r"\\$1")


def _plain(text: Column) -> Column:
    for written, meant in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def row_scan(pages: DataFrame, html: str = "html") -> DataFrame:
    """``position, name, club`` of ``<tr>`` rows, by pattern alone and in the JVM."""
    rows = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: _plain(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"\s+", " "))))
    out = rows.select(cells.alias("c")).where(F.size("c") >= 3)
    return out.select(F.upper(F.element_at("c", 1)).alias("position"), F.element_at("c", 2).alias("name"), F.element_at("c", 3).alias("club")).where(F.col("position").isin("GK", "DF", "MF", "FW"))


def list_scan(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, name, club`` of ``Name (Club), ...`` lists, one row a player."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, p["name"], p["club"]) for k, t in zip(batch["k"], batch["t"]) for p in split_players(t or "")]
            yield pd.DataFrame(rows, columns=[key, "name", "club"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, name string, club string")
