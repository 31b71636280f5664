"""Pieces under a token limit, cut at natural boundaries, with an overlap.

Balanced targets: the least piece count that the limit and the overlap allow
sets equal-length targets; each target moves to the strongest boundary nearby
(paragraph, line, sentence, clause, word, then any character) that leaves this
piece and the rest within the limit; if a piece still breaks it, one more piece is
tried, so the number of pieces only grows as far as it must.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from touchline.llm.tokenizer import PATTERN, TOKENIZER_DIR, encoding
from touchline.session import ship

LIMIT = 2000
OVERLAP = 100

#: Boundaries by strength, strongest first. A cut lies at the end of a match.
_BOUNDARIES = [
    re.compile(r"\n\s*\n+|\n(?=#{1,6} |```)"),
    re.compile(r"\n"),
    re.compile(r"[.!?。！？…]+[\"'”’)\]]*\s+|[。！？]"),
    re.compile(r"[,;:–—、，；]\s*"),
    re.compile(r"\s+"),
]
#: Tokens that an overlap may have more to begin with a word.
MORE = 4
#: How far a cut may move from its target, as a share of the piece length.
_REACH = (0.25, 0.2, 0.15, 0.08, 0.05)


def _offsets(text: str, encode) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets at which pre-token words begin, and the tokens before
    each; the last entry is the end of the text."""
    import regex

    pattern = _offsets.__dict__.setdefault("pattern", regex.compile(PATTERN))
    cache = _offsets.__dict__.setdefault("cache", {})
    if len(cache) > 200_000:
        cache.clear()
    starts, counts = [], []
    for m in pattern.finditer(text):
        word = m.group()
        n = cache.get(word)
        if n is None:
            n = len(encode(word))
            if len(word) <= 64:
                cache[word] = n
        starts.append(m.start())
        counts.append(n)
    return np.array([*starts, len(text)], np.int64), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _overlap_begin(text: str, starts: np.ndarray, before: np.ndarray, cut: int, overlap: int, encoder) -> int:
    """Where the piece behind ``cut`` begins: ``overlap`` tokens before it, at the
    beginning of a word if that is at most ``MORE`` tokens further, else inside
    the word."""
    i = bisect_right(starts, cut) - 1
    inside = encoder.encode_ordinary(text[starts[i] : cut]) if cut > starts[i] else []
    upto = int(before[i]) + len(inside)
    j = max(bisect_right(before, upto - overlap) - 1, 0)
    if upto - overlap - before[j] <= MORE:
        return int(starts[j])
    end = cut if j >= i else int(starts[j + 1])
    behind = 0 if j >= i else upto - int(before[j + 1])
    word = text[starts[j] : end]
    pieces = encoder.decode_tokens_bytes(encoder.encode_ordinary(word))
    # the last tokens of the word, from the next whole character on
    tail = b"".join(pieces[len(pieces) - (overlap - behind) :])
    return end - len(tail.decode("utf-8", "ignore"))


def _spans(text: str, limit: int, overlap: int, encoder) -> list[tuple[int, int, int]]:
    """``(begin, end, tokens)`` of each piece, in order."""
    encode = encoder.encode_ordinary
    whole = len(encode(text))
    if whole <= limit:
        return [(0, len(text), whole)]
    starts, before = _offsets(text, encode)
    marks = [np.array(sorted({m.end() for m in b.finditer(text)}), np.int64) for b in _BOUNDARIES]
    tokens_at = lambda c: float(np.interp(c, starts, before))
    char_at = lambda t: int(np.interp(t, before, starts))
    room = limit - overlap
    count = max(2, -(-(whole - overlap) // room))
    while True:
        step = whole / count
        spans: list[tuple[int, int, int]] = []
        begin = last = 0
        for k in range(1, count + 1):
            if k == count:
                cut = len(text)
            else:
                target = step * k
                # this piece must hold it, the rest must hold what is behind, and every
                # piece keeps at least one character of its own
                most = min(char_at(tokens_at(begin) + limit), len(text) - (count - k))
                least = max(last + 1, char_at(whole - (count - k) * room))
                cut = min(max(char_at(target), least), max(most, last + 1))
                for marked, reach in zip(marks, _REACH):
                    lo, hi = max(char_at(target - step * reach), least), min(char_at(target + step * reach), most)
                    i, j = bisect_left(marked, lo), bisect_right(marked, hi)
                    if j > i:
                        near = marked[i:j]
                        cut = int(near[np.argmin(np.abs(near - char_at(target)))])
                        break
            n = len(encode(text[begin:cut]))
            if n > limit and begin < last and cut - last == 1:
                # one character alone may need most of the limit: then no overlap
                begin, n = last, len(encode(text[last:cut]))
            if n > limit:
                break
            spans.append((begin, cut, n))
            last = cut
            begin = _overlap_begin(text, starts, before, cut, overlap, encoder) if overlap and k < count else cut
        else:
            return spans
        if count >= len(text):
            raise ValueError("the limit is below the tokens of one character")
        count += 1


def split_oversized(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    folder: str = TOKENIZER_DIR,
    name: str = "byte_bpe_50k",
) -> DataFrame:
    """``id_col, piece, pieces, begin, end, tokens, text`` of every document.

    ``begin`` and ``end`` are character offsets; a piece starts ``overlap``
    tokens before the end of the one before, or up to ``MORE`` more at the
    beginning of a word, and dropping that part gives the text back. A text within the limit is one piece. A token has at
    least one byte, so texts of no more than ``limit`` bytes are passed on by
    the JVM without being tokenized by Python; their ``tokens`` is null. Null
    and empty texts give one piece with an empty text. Repeated rows give
    repeated pieces; other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    ship(df.sparkSession)
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([
        T.StructField("id", base.schema["id"].dataType),
        *[T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "begin", "end", "tokens")],
        T.StructField("text", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoding(folder, name)
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = _spans(body, limit, overlap, encoder)
                for k, (a, b, n) in enumerate(spans):
                    for column, value in zip(rows, (key, k, len(spans), a, b, n, body[a:b])):
                        column.append(value)
            types = [batch.schema.field(0).type, *[pa.int32()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], [f.name for f in schema])

    small = F.octet_length("text") <= limit
    whole = base.where(small).select(
        "id",
        F.lit(0).alias("piece"),
        F.lit(1).alias("pieces"),
        F.lit(0).alias("begin"),
        F.length("text").alias("end"),
        F.lit(None).cast("int").alias("tokens"),
        "text",
    )
    return base.where(~small).mapInArrow(run, schema).unionByName(whole).withColumnRenamed("id", id_col)


def oversized(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the documents that had to be cut."""
    return pieces.where((F.col("pieces") > 1) & (F.col("piece") == 0)).select(id_col).distinct()


def rejoin(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, text``: the text of each document from its pieces; ``id_col`` must
    tell documents apart. What a piece repeats of the one before is left out."""
    one = F.struct("piece", "begin", "end", "text")
    held = pieces.groupBy(id_col).agg(F.array_sort(F.collect_set(one)).alias("p"))
    before = lambda i: F.when(i > 0, F.get("p", i - 1)["end"]).otherwise(0)
    own = F.transform("p", lambda x, i: F.substr(x["text"], before(i) - x["begin"] + 1))
    return held.select(id_col, F.array_join(own, "").alias("text"))
