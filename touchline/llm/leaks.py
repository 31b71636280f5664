"""Passages of held-out items inside the documents of a corpus.

Both sides are brought to plain lower-case words first (markup, case, accents,
look-alike letters and punctuation differ, words don't; in scripts written
without spaces every character is a word). Then, by the q-gram lemma with
diagonal bands:

1. *Bound.* ``min_words`` words of an item in order, with at most ``max_edits``
   exchanged or added words, a foreign sentence counting as one, leave at least so
   many q-grams of the item: those inside the words' window less those that the
   worst edits touch, at the worst place of the item. The bound holds for any
   selection of q-grams, so what many items share is left out as far as
   ``LEAST_KEPT`` of the bound remain; short words get shorter q-grams.
2. *Filter.* A hit of a document position ``x`` and an item position ``y`` lies
   on diagonal ``x - y``. Diagonals are gathered in bands of ``2 * BAND`` that
   overlap by half. A foreign sentence parts the stretch into two bands, so the
   document holds the bound, one band half of it (an anchor), and another band
   what is missing.
3. *Verification.* The region around these bands is aligned with the passage word
   by word in a band, locally, with one jump over a foreign sentence. If that
   falls short, two regions are aligned one behind the other, with a jump from one
   to the other, over a sentence of up to ``max_sentence`` words. Beyond ``JUMP``
   words a second part must have ``SECOND`` hits. ``min_words`` matched words make a
   leak.

Items up to ``max_index`` characters (checked by a sum) are indexed once and
broadcast; documents stream through one Python stage and nothing but the found
pairs is shuffled. A larger set stays distributed: q-grams of both sides are
joined by hash, hits are counted by band with map-side combine, and the texts of
what has an anchor are joined again for verification. Both ways find the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from touchline.llm.unify import fold_text
from touchline.session import cut, ship

MIN_WORDS = 28
#: Exchanged or added words, the foreign sentence among them, that never hide a stretch.
MAX_EDITS = 5
#: Lengths of q-grams, of which the first one is taken that leaves ``LEAST_LEFT`` in
#: the bound of an item, and what its selected q-grams leave at least.
LENGTHS, LEAST_LEFT, LEAST_KEPT = (12, 10, 8, 6, 4, 3, 2), 32, 32
#: Half the width of a band, in characters, and the hits of a second part's band.
BAND, SECOND = 64, 4
#: Words of a foreign sentence within the band of the first alignment.
JUMP = 40
#: Scores in tenths; the last word of either end counts across one exchanged or added
#: word, although it doesn't outweigh it.
MATCH, MISMATCH, EXTRA, SENTENCE, BEFORE = 10, -15, -10, -20, 30
#: Words of one foreign sentence. What lies further apart are two shorter quotations.
MAX_SENTENCE = 100
#: Words that a band reaches beyond its jump.
SLACK = 12
#: Characters of items in the broadcast index, about 24 bytes each.
MAX_INDEX = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
_POINT = re.compile(r"(?<=\d)[.,](?=\d)")
_TO_SPACE = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_MARKUP = re.compile(r"<[/!?a-zA-Z][^<>]*>|&[a-zA-Z#0-9]{2,8};")
# characters of scripts that part no words: Han, kana, Thai, Lao, Myanmar and Khmer
_UNPARTED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def plain(text: str) -> str:
    """Lower-case words parted by single spaces, without markup."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    text = _POINT.sub("", fold_text(text).replace("'", ""))
    if text.isascii():
        return b" ".join(text.encode().translate(_TO_SPACE).split()).decode()
    return " ".join(_WORD.findall(_UNPARTED.sub(r" \g<0> ", text)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every q-gram, by doubling."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    power: dict[int, np.ndarray] = {1: codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)}
    factor = {1: _BASE}
    step = 1
    while step * 2 <= q:
        cur = power[step]
        power[step * 2] = cur[:-step] + factor[step] * cur[step:]
        factor[step * 2] = factor[step] * factor[step]
        step *= 2
    out, done, f = None, 0, np.uint64(1)
    n = len(codes) - q + 1
    for size in sorted(power, reverse=True):
        if q & size:
            part = power[size][done : done + n]
            out = part if out is None else out + f * part
            f = f * factor[size]
            done += size
    return out * np.uint64(0xFF51AFD7ED558CCD)


def _most(values: np.ndarray, width: int, k: int) -> np.ndarray:
    """Sum of the ``k`` greatest values in each window of ``width`` values."""
    if k == 0 or width <= 0:
        return np.zeros(max(len(values) - width + 1, 0), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(values, width)
    k = min(k, width)
    return np.partition(windows, width - k, axis=1)[:, width - k :].sum(axis=1)


def bound(text: str, q: int, kept: np.ndarray, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> int:
    """Kept q-grams that every stretch of a plain passage leaves; ``kept`` tells of
    each q-gram whether it counts. Zero or less bounds nothing."""
    spaces = np.flatnonzero(_codes(text) == 32)
    start, end = np.concatenate([[0], spaces + 1]), np.append(spaces, len(text))
    before = np.concatenate([[0], np.cumsum(kept)])
    # q-grams that begin in [a, b)
    between = lambda a, b: before[np.clip(b, 0, len(kept))] - before[np.clip(np.minimum(a, b), 0, len(kept))]
    touched, parted = between(start - q + 1, end), between(end[:-1] - q + 1, start[1:])
    least = None
    for exchanged in range(max_edits + 1):
        width = min_words + exchanged
        if width > len(start):
            break
        inside = between(start[: len(start) - width + 1], end[width - 1 :] - q + 1)
        lost = _most(touched, width, exchanged) + _most(parted, width - 1, max_edits - exchanged)
        least = min(int((inside - lost).min()), 1 << 30 if least is None else least)
    return least or 0


def gram_length(text: str, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> int | None:
    """The length of a plain passage's q-grams; None where it has too few words."""
    if text.count(" ") + 1 < min_words or not text:
        return None
    return next((q for q in LENGTHS if bound(text, q, np.ones(max(len(text) - q + 1, 0), bool), min_words, max_edits) >= LEAST_LEFT), LENGTHS[-1])


def select_grams(text: str, q: int, shared: np.ndarray, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> tuple[np.ndarray, int]:
    """``(kept, left)``: which q-grams of a plain passage count, and how many of them
    every stretch leaves. ``shared`` tells how many items have each."""
    level = 1
    while True:
        kept = shared <= level
        left = bound(text, q, kept, min_words, max_edits)
        if left >= LEAST_KEPT or kept.all():
            return kept, max(1, left)
        level *= 2


@dataclass
class Grams:
    """Where each q-gram of the items with this ``q`` stands."""

    q: int
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    #: Hits that a stretch of any of these items leaves at least.
    least: int
    bits: int = 22

    def bitmap(self) -> np.ndarray:
        bitmap = np.zeros(1 << self.bits, np.bool_)
        bitmap[(self.keys >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        return bitmap


@dataclass
class Index:
    """The q-grams of a set of items."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    #: Word number of every character of every passage, and where each passage begins.
    word_at: np.ndarray
    word_first: np.ndarray
    #: Hits that a stretch of each item leaves at least.
    left: np.ndarray
    grams: list[Grams] = field(default_factory=list)


def build_index(items: list[tuple[int, str]], min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> Index:
    """The index of ``(id, passage)`` pairs; passages of too few words hold nothing."""
    texts = [plain(p or "") for _, p in items]
    lengths = [gram_length(t, min_words, max_edits) for t in texts]
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.split()], np.int32) for t in texts]
    word_at = [np.cumsum(_codes(t) == 32).astype(np.int32) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in word_at])])[:-1].astype(np.int64)
    index = Index([i for i, _ in items], words, vocabulary, np.concatenate(word_at) if word_at else np.zeros(0, np.int32), first, np.zeros(len(items), np.int64))
    with np.errstate(over="ignore"):
        for q in sorted({p for p in lengths if p}):
            every = {k: _hashes(_codes(t), q) for k, (t, p) in enumerate(zip(texts, lengths)) if p}
            known, spread = np.unique(np.concatenate([np.unique(g) for g in every.values()]), return_counts=True)
            keys, item, at = [], [], []
            for k, grams in every.items():
                if lengths[k] == q:
                    kept, index.left[k] = select_grams(texts[k], q, spread[np.searchsorted(known, grams)], min_words, max_edits)
                    keys.append(grams[kept])
                    at.append(np.flatnonzero(kept).astype(np.int32))
                    item.append(np.full(len(at[-1]), k, np.int32))
            flat = np.concatenate(keys)
            order = np.argsort(flat, kind="stable")
            keys, starts = np.unique(flat[order], return_index=True)
            index.grams.append(Grams(q, keys, np.append(starts, len(flat)), np.concatenate(item)[order], np.concatenate(at)[order], int(min(index.left[k] for k in every if lengths[k] == q))))
    return index


def _hits(index: Index, bitmaps: list[np.ndarray], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Item, document and item position of every q-gram that both sides share."""
    items, xs, ys = [], [], []
    for grams, bitmap in zip(index.grams, bitmaps):
        h = _hashes(codes, grams.q)
        spots = np.flatnonzero(bitmap[(h >> np.uint64(64 - grams.bits)).astype(np.int64)])
        # each q-gram that a stretch leaves has its own place in the document
        if len(spots) < grams.least:
            continue
        at = np.searchsorted(grams.keys, h[spots])
        at[at == len(grams.keys)] = 0
        good = grams.keys[at] == h[spots]
        spots, at = spots[good], at[good]
        if len(spots) < grams.least:
            continue
        counts = grams.first[at + 1] - grams.first[at]
        ends = np.cumsum(counts)
        where = np.repeat(grams.first[at] - (ends - counts), counts) + np.arange(int(ends[-1]))
        items.append(grams.item[where].astype(np.int64))
        xs.append(np.repeat(spots, counts))
        ys.append(grams.at[where].astype(np.int64))
    return (np.concatenate(items), np.concatenate(xs), np.concatenate(ys)) if items else None


def chains(bands: list[tuple[int, int, int, int]], left: int, max_sentence: int = MAX_SENTENCE) -> list[tuple[int, int]]:
    """Spans of word diagonals from the bands ``(number, lowest, highest, hits)`` of one
    document and item, of which a stretch leaves ``left`` hits.

    An anchor has half of ``left`` itself, and all of it with the bands beside it or
    with one band within a sentence. Bands further from every anchor are left out,
    neighbouring bands are one chain, and a long chain is walked in steps that
    overlap by a jump.
    """
    hits = {number: n for number, _, _, n in bands}
    few = min(SECOND, (left + 1) // 2) - 1
    anchors = []
    for number, lo, hi, n in bands:
        if 2 * n < left:
            continue
        # the two halves of the band and one on either side
        if number - 1 in hits:
            around = hits[number - 1] + (hits[number + 1] if number + 1 in hits else hits.get(number + 2, few) + few)
        else:
            around = n + hits.get(number + 2, few) + few
        if around >= left or any(n + other >= left for at, low, high, other in bands if abs(at - number) > 1 and low <= hi + max_sentence and high >= lo - max_sentence):
            anchors.append((number, lo, hi))
    if not anchors:
        return []
    taken = {number for number, _, _ in anchors}
    bands = [(number, lo, hi) for number, lo, hi, n in bands if number in taken or any(lo <= high + max_sentence and hi >= low - max_sentence for _, low, high in anchors)]
    out: list[tuple[int, int]] = []
    run: list[int] | None = None
    for band, lo, hi in [*sorted(bands), (1 << 60, 0, 0)]:
        if run is not None and band <= run[2] + 2:
            run = [min(run[0], lo), max(run[1], hi), band]
            continue
        if run is not None:
            low, high = run[0], run[1]
            while high > low + 2 * JUMP:
                out.append((low, low + 2 * JUMP))
                low += JUMP
            out.append((low, high))
        run = [lo, hi, band]
    return out


def candidates(index: Index, bitmaps: list[np.ndarray], text: str, max_sentence: int = MAX_SENTENCE) -> list[tuple[int, int, int]]:
    """``(item number, lowest, highest word diagonal)`` of every anchored span."""
    codes = _codes(text)
    hits = _hits(index, bitmaps, codes)
    if hits is None:
        return []
    item, x, y = hits
    # an item with fewer hits in the whole document than a stretch leaves is not in it
    many = np.bincount(item, minlength=len(index.left)) >= np.maximum(index.left, 1)
    kept = many[item]
    if not kept.any():
        return []
    item, x, y = item[kept], x[kept], y[kept]
    # half bands are told by their item and number; numbers start above zero
    key = (item << 32) | ((x - y) // BAND + (1 << 30))
    order = np.argsort(key, kind="stable")
    halves, starts, size = np.unique(key[order], return_index=True, return_counts=True)
    after = np.searchsorted(halves, halves + 1)
    after[after == len(halves)] = 0
    joined = halves[after] == halves + 1
    of = halves >> 32
    both = size + np.where(joined, size[after], 0)
    most = np.zeros(len(index.left), np.int64)
    np.maximum.at(most, of, both)
    full = (2 * most >= index.left)[of] & (both >= np.minimum(SECOND, (index.left + 1) // 2)[of])
    if not full.any():
        return []
    words = np.searchsorted(np.flatnonzero(codes == 32), x) - index.word_at[index.word_first[item] + y]
    low, high = np.minimum.reduceat(words[order], starts), np.maximum.reduceat(words[order], starts)
    anchors: dict[int, list[tuple[int, int, int, int]]] = {}
    for b in np.flatnonzero(full):
        lo, hi = int(low[b]), int(high[b])
        if joined[b]:
            lo, hi = min(lo, int(low[after[b]])), max(hi, int(high[after[b]]))
        anchors.setdefault(int(halves[b] >> 32), []).append((int(halves[b] & 0xFFFFFFFF), lo, hi, int(both[b])))
    return [(k, lo, hi) for k, bands in anchors.items() for lo, hi in chains(bands, int(index.left[k]), max_sentence)]


def align(docs: list[np.ndarray], items: list[np.ndarray], spans: list[tuple[int, int]], jump: int = JUMP) -> np.ndarray:
    """Matched words of the best local alignment of each pair, in its band.

    All pairs move together: row ``i`` of the band holds the cells of passage
    word ``i`` on the diagonals ``low - jump .. high + jump``. A cell is one
    integer, the score above and the matched words in the low bits, so taking
    the maximum carries both. The second layer is reached by one jump along the
    row, over a foreign sentence.
    """
    if not docs:
        return np.zeros(0, np.int64)
    rows = max(len(i) for i in items)
    width = max(hi - lo for lo, hi in spans) + 2 * (jump + SLACK) + 1
    n = len(docs)
    window = np.full((n, rows + width), -1, np.int32)
    passage = np.full((n, rows), -2, np.int32)
    for k, (doc, item, (lo, _)) in enumerate(zip(docs, items, spans)):
        passage[k, : len(item)] = item
        start = lo - jump - SLACK
        a, b = max(0, start), min(len(doc), start + rows + width)
        if b > a:
            window[k, a - start : b - start] = doc[a:b]
    # the low bits count up to the words of the longest passage, scores stand above them;
    # the running maximum adds a ramp as high as the band is wide
    unit = 1 << int(rows).bit_length()
    kind = np.int32 if 10 * unit * (rows + width + 64) < 1 << 28 else np.int64
    match, mismatch, extra = kind(MATCH * unit + 1), kind(MISMATCH * unit), kind(EXTRA * unit)
    low = kind(-(1 << 28) if kind is np.int32 else -(1 << 60))
    ramp = (np.arange(width, dtype=kind) * -extra)[None, :]
    first = np.zeros((n, width), kind)
    second = np.full((n, width), low, kind)
    best = np.zeros(n, kind)

    def spread(cells: np.ndarray) -> np.ndarray:
        lifted = cells + ramp
        np.maximum.accumulate(lifted, axis=1, out=lifted)
        return lifted - ramp

    before, last = np.zeros((n, width), bool), [np.zeros((n, width), kind)] * 2
    for i in range(rows):
        same = window[:, i : i + width] == passage[:, i : i + 1]
        gain = np.where(same, match, mismatch)
        ahead = np.maximum.accumulate(first, axis=1)
        jumped = np.full_like(first, low)
        jumped[:, 1:] = np.where(ahead[:, :-1] > BEFORE * unit + unit - 1, ahead[:, :-1] + SENTENCE * unit, low)
        second_up = np.full_like(second, low)
        second_up[:, :-1] = second[:, 1:] + extra
        second = spread(np.maximum(np.maximum(second, jumped) + gain, second_up))
        np.maximum(second, low, out=second)
        first_up = np.zeros_like(first)
        first_up[:, :-1] = first[:, 1:] + extra
        # a stretch may begin behind one word and one exchanged or added word
        begun = before & ~same
        begun[:, 1:] |= same[:, :-1]
        first = np.maximum(spread(np.maximum(first + gain, first_up)), begun)
        # and end with one word behind such a word
        ended = last[0].copy()
        np.maximum(ended[:, 1:], last[1][:, :-1], out=ended[:, 1:])
        here = np.maximum(first, second)
        best = np.maximum(best, np.maximum(here.max(axis=1), np.where(same, ended + 1, 0).max(axis=1)))
        before, last = same, [last[1], here]
    return best & (unit - 1)


def _in_order(words: np.ndarray, masks: dict[int, int], size: int) -> int:
    """Longest common subsequence of a document's words and a passage of ``size``
    words, given by the places of each word: no alignment matches more."""
    full = (1 << size) - 1
    state = full
    for mask in map(masks.get, words.tolist()):
        if mask:
            hit = state & mask
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def _places(item: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(item.tolist()):
        masks[word] = masks.get(word, 0) | (1 << i)
    return masks


def verify(jobs: list[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]], min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS, max_sentence: int = MAX_SENTENCE, at_once: int = 128) -> list[int]:
    """Matched words of each (document, passage, anchored spans) in coded words.

    The best of the spans; if that falls short, the best of two of them in order.
    """
    found = [0] * len(jobs)
    places = {id(item): _places(item) for _, item, _ in jobs}

    def window(j: int, lo: int, hi: int) -> np.ndarray:
        doc, item, _ = jobs[j]
        return doc[max(0, lo - JUMP - SLACK) : max(0, hi + len(item) + JUMP + SLACK)]

    def aligned(spans: list[tuple[int, int, int, int, int]]) -> dict[tuple[int, int, int], int]:
        out = {}
        spans = sorted(spans)
        for start in range(0, len(spans), at_once):
            part = spans[start : start + at_once]
            got = align([jobs[j][0] for _, _, j, _, _ in part], [jobs[j][1] for _, _, j, _, _ in part], [(lo, hi) for *_, lo, hi in part])
            for (_, _, j, lo, hi), matched in zip(part, got.tolist()):
                found[j] = max(found[j], matched)
                out[j, lo, hi] = matched
        return out

    every = [(len(jobs[j][1]), hi - lo, j, lo, hi) for j in range(len(jobs)) for lo, hi in jobs[j][2]]
    # words in common, in order: a span with too few is never aligned
    most = {(j, lo, hi): _in_order(window(j, lo, hi), places[id(jobs[j][1])], size) for size, _, j, lo, hi in every}
    best = aligned([s for s in every if most[s[2:]] >= min_words])
    # two regions, the second one on later diagonals, put one behind the other
    joint = []
    for j, (_, _, spans) in enumerate(jobs):
        if found[j] < min_words:
            joint += [(j, a, b) for a in spans for b in spans if a[1] < b[0] <= a[1] + max_sentence and most[j, *a] + most[j, *b] >= min_words]
    open_ = {(j, *s) for j, *both in joint for s in both} - best.keys()
    best.update(aligned([(len(jobs[j][1]), hi - lo, j, lo, hi) for j, lo, hi in open_]))
    pairs: list[tuple[int, np.ndarray]] = []
    for j, (lo, hi), (low, high) in joint:
        if found[j] < min_words and best[j, lo, hi] + best[j, low, high] >= min_words - max_edits:
            doc, item, _ = jobs[j]
            reach = len(item) + JUMP
            a, b = doc[max(0, lo - JUMP) : max(0, hi + reach)], doc[max(0, hi + reach, low - JUMP) : max(0, high + reach)]
            pairs.append((j, np.concatenate([a, b])))
    pairs.sort(key=lambda p: (len(jobs[p[0]][1]), len(p[1])))
    for start in range(0, len(pairs), 64):
        part = pairs[start : start + 64]
        got = align([words for _, words in part], [jobs[j][1] for j, _ in part], [(-len(jobs[j][1]), len(words)) for j, words in part], jump=0)
        for (j, _), matched in zip(part, got.tolist()):
            found[j] = max(found[j], matched)
    return found


def find_in(index: Index, bitmaps: list[np.ndarray], texts: list[str], min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS, max_sentence: int = MAX_SENTENCE) -> list[tuple[int, int, int]]:
    """``(text number, item id, matched words)`` of the items that plain texts hold."""
    jobs, who = [], []
    for t, text in enumerate(texts):
        spots = candidates(index, bitmaps, text, max_sentence)
        if not spots:
            continue
        words = text.split(" ")
        coded = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), np.int32, len(words))
        spans: dict[int, list[tuple[int, int]]] = {}
        for k, lo, hi in spots:
            spans.setdefault(k, []).append((lo, hi))
        for k, each in spans.items():
            jobs.append((coded, index.words[k], each))
            who.append((t, k))
    return [(t, index.ids[k], m) for (t, k), m in zip(who, verify(jobs, min_words, max_edits, max_sentence)) if m >= min_words]


def _find_joined(source: DataFrame, held: DataFrame, schema: str, min_words: int, max_edits: int, max_sentence: int) -> DataFrame:
    """:func:`find_leaks` for an item set of any size: nothing of it is collected."""
    item_type, doc_type = to_arrow_type(held.schema["item_id"].dataType), to_arrow_type(source.schema["doc_id"].dataType)
    item_type_name = held.schema["item_id"].dataType.simpleString()

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [plain(p or "") for p in batch.column("passage").to_pylist()]
            lengths = [gram_length(t, min_words, max_edits) for t in texts]
            keep = [i for i, q in enumerate(lengths) if q]
            part = batch.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("_item"), pa.array([texts[i] for i in keep], pa.string()), pa.array([lengths[i] for i in keep], pa.int32())], ["item_id", "_item", "words", "q"])

    hashed = held.select("item_id", F.xxhash64("item_id", "passage").alias("_item"), "passage")
    items = cut(hashed.mapInArrow(planned, f"item_id {item_type_name}, _item bigint, words string, q int"))
    sizes = sorted(r[0] for r in items.select("q").distinct().collect())  # at most those of LENGTHS

    def plain_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_doc"), pa.array([plain(t) for t in batch.column("text").to_pylist()], pa.string())], ["doc_id", "_doc", "words"])

    keyed = source.select("doc_id", F.xxhash64("doc_id", "text").alias("_doc"), "text").dropDuplicates(["_doc"])
    docs = cut(keyed.mapInArrow(plain_docs, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, _doc bigint, words string"))

    def grams(key: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with np.errstate(over="ignore"):
                for batch in batches:
                    for k, text in zip(batch.column(key).to_pylist(), batch.column("words").to_pylist()):
                        codes = _codes(text)
                        spaces = np.flatnonzero(codes == 32)
                        for q in sizes:
                            h = _hashes(codes, q)
                            at = np.arange(len(h), dtype=np.int64)
                            word = np.searchsorted(spaces, at).astype(np.int32)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int64)), pa.array(np.full(len(h), q, np.int32)), pa.array(h.view(np.int64)), pa.array(at), pa.array(word)], [key, "q", "gram", "at", "word"])

        return run

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shared = np.zeros(len(row["spread"]), np.int64)
                for g in row["spread"]:
                    shared[g["at"]] = g["n"]
                kept, left = select_grams(row["words"], row["q"], shared, min_words, max_edits)
                rows = [g for g in row["spread"] if kept[g["at"]]]
                columns = [[row["_item"]] * len(rows), [row["q"]] * len(rows), [g["gram"] for g in rows], [g["at"] for g in rows], [g["word"] for g in rows], [left] * len(rows)]
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["_item", "q", "gram", "y", "wy", "left"])

    gram_schema = "{} bigint, q int, gram bigint, at bigint, word int"
    left = docs.select("_doc", "words").mapInArrow(grams("_doc"), gram_schema.format("_doc")).withColumnsRenamed({"at": "x", "word": "wx"})
    every = cut(items.select("_item", "words").mapInArrow(grams("_item"), gram_schema.format("_item")))
    spread = every.select("q", "gram", "_item").distinct().groupBy("q", "gram").agg(F.count("*").alias("n"))
    own = every.join(items.select("_item", "q"), ["_item", "q"]).join(spread, ["q", "gram"])
    # one row an item, as large as its passage
    by_item = own.groupBy("_item", "q").agg(F.collect_list(F.struct("at", "gram", "word", "n")).alias("spread")).join(items.select("_item", "words"), "_item")
    right = cut(by_item.select("_item", "q", "words", "spread").mapInArrow(selected, "_item bigint, q int, gram bigint, y bigint, wy int, left int"))
    half = F.floor((F.col("x") - F.col("y")) / BAND) + (1 << 30)
    counted = (
        left.join(right, ["q", "gram"]).select("_doc", "_item", half.alias("h"), (F.col("wx") - F.col("wy")).alias("d"))
        .groupBy("_doc", "_item", "h").agg(F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    )
    # each half belongs to the band that begins with it and to the one before
    bands = counted.select("_doc", "_item", F.explode(F.array("h", F.col("h") - 1)).alias("band"), "h", "n", "lo", "hi").groupBy("_doc", "_item", "band").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("h").alias("least"))
    # half of what an item's stretch leaves in one band, all of it in the document
    enough = counted.groupBy("_doc", "_item").agg(F.sum("n").alias("every")).join(right.select("_item", "left").distinct(), "_item").where("every >= left")
    least_hits = F.least(F.lit(SECOND), F.ceil(F.col("left") / 2))
    held_bands = bands.where("least = band").join(enough, ["_doc", "_item"]).where(F.col("n") >= least_hits)
    # one row a document and item, no longer than the document
    gathered = held_bands.groupBy("_doc", "_item", "left").agg(F.collect_list(F.struct("band", "lo", "hi", "n")).alias("all"), F.max("n").alias("most")).where("2 * most >= left")
    anchored = gathered.withColumnRenamed("all", "bands")
    pairs = anchored.join(docs.withColumnRenamed("words", "text"), "_doc").join(items.select("_item", "item_id", F.col("words").alias("passage")), "_item").select("doc_id", "item_id", "text", "passage", "bands", "left")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            jobs = []
            for row in batch.select(["text", "passage", "bands", "left"]).to_pylist():
                vocabulary: dict[str, int] = {}
                item = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in row["passage"].split()], np.int32)
                words = row["text"].split(" ")
                coded = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words))
                jobs.append((coded, item, chains([(b["band"], b["lo"], b["hi"], b["n"]) for b in row["bands"]], row["left"], max_sentence)))
            matched = pa.array(verify(jobs, min_words, max_edits, max_sentence), pa.int32())
            found = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(doc_type), batch.column("item_id").cast(item_type), matched], ["doc_id", "item_id", "words"])
            yield found.filter(pc.greater_equal(matched, min_words))

    return pairs.mapInArrow(check, schema)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    min_words: int = MIN_WORDS,
    max_edits: int = MAX_EDITS,
    max_sentence: int = MAX_SENTENCE,
    max_index: int = MAX_INDEX,
) -> DataFrame:
    """``doc_id, item_id, words``: each document with the items that it holds.

    Null, empty and blank texts and passages hold nothing; repeated rows give
    one row; other columns of either side are ignored. Both ids keep their
    types. An empty side gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    held = items.select(F.col(item_id).alias("item_id"), F.col(passage).alias("passage")).where(F.length("passage") >= min_words).distinct()
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, words int"
    item_type = to_arrow_type(items.schema[item_id].dataType)
    # each word has a character at least, in scripts without spaces no more
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= min_words)
    size = held.agg(F.sum(F.length("passage"))).first()[0] or 0
    if size > max_index:
        found = _find_joined(source, held, schema, min_words, max_edits, max_sentence)
        return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
    shared = spark.sparkContext.broadcast(build_index([(r[0], r[1]) for r in held.collect()], min_words, max_edits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        bitmaps = [g.bitmap() for g in index.grams]
        with np.errstate(over="ignore"):
            for batch in batches:
                d, i, w = [], [], []
                ids = batch.column(0).to_pylist()
                for t, item, matched in find_in(index, bitmaps, [plain(x) for x in batch.column(1).to_pylist()], min_words, max_edits, max_sentence):
                    d.append(ids[t])
                    i.append(item)
                    w.append(matched)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d, batch.schema.field(0).type), pa.array(i, item_type), pa.array(w, pa.int32())], ["doc_id", "item_id", "words"]
                )

    return source.mapInArrow(scan, schema).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))
