import os
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from touchline.llm.encode import decode_corpus, distinct_words, encode_corpus
from touchline.llm.pieces import _spans, oversized, split_oversized
from touchline.llm.tokenizer import TOKENIZER_DIR, encoding

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no vocabulary files")

TEXTS = [
    None, "", " ", "\n\n \t", "The coach's plan didn't work; 12% of 3,456.\r\n\r\nNext  line ", "Матч начался, 試合は終わった。 مباراة", "a​b c d 　 e\x85f", "👍🏽 ok <|endoftext|>", "x" * 5000,
    "word " * 3000, "  lead", "trail  ", "tab\tsep", "ﬁne ﬂow ①②", "é combining", "'s 'll 'RE don't", "a  b   c\n\n\nd",
]


def frame(spark):
    rows = [(i if i != 3 else None, t, "n") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "again"), (4, TEXTS[4], "again")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)


@pytest.mark.parametrize("head", [1 << 18, 3, 0])
def test_ids_equal_the_encoder(spark, head):
    enc = encoding()
    got = encode_corpus(frame(spark), head_words=head).collect()
    want = sorted((str(i if i != 3 else None), enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS))
    assert sorted((str(r.doc_id), r.ids) for r in got)[:0] == []
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r.ids)
    assert len(got) == len(TEXTS) + 2 if head != 0 and head != 3 else len(got) >= len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert all(ids == enc.encode_ordinary(t or "") for ids in found[i if i != 3 else None]), (i, t)
    assert want


def test_round_trip(spark):
    ids = encode_corpus(frame(spark).where("doc_id is not null").dropDuplicates(["doc_id"]))
    back = {r.doc_id: r.text for r in decode_corpus(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS) if i != 3}


def test_every_word_once(spark):
    words = distinct_words(frame(spark))
    assert words.groupBy("word").count().where("count > 1").isEmpty()
    assert encode_corpus(frame(spark).limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["alpha ", "beta, ", "gamma. ", "delta\n", "end.\n\n", "世界", "xxxxxxxxxxxxxxxx", "  "]), max_size=120), st.integers(8, 40), st.integers(0, 4))
def test_pieces_lose_nothing(parts, limit, overlap):
    text = "".join(parts)
    encode = encoding().encode_ordinary
    spans = _spans(text, limit, overlap, encoding())
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b, n), (c, d, _) in zip(spans, spans[1:]):
        assert c <= b < d and a < b
    assert all(n <= limit and n == len(encode(text[a:b])) for a, b, n in spans)
    if len(encode(text)) <= limit:
        assert len(spans) == 1


ALIKE = {"words": "alpha beta gamma ", "letters": "qzxvkjwp", "runs": "x" * 40, "long words": "qzxvkjwpbnmdfgh" * 30 + " ", "characters": "世界文字", "lines": "one two. three, four\n", "mixed": "word " * 9 + "zqxjkvbpyg" * 50 + " "}


@pytest.mark.parametrize("kind", sorted(ALIKE))
@pytest.mark.parametrize("limit, overlap", [(200, 30), (500, 100)])
def test_every_join_overlaps_and_pieces_are_few(kind, limit, overlap):
    encode = encoding().encode_ordinary
    unit = ALIKE[kind]
    text = unit * (6 * limit // len(encode(unit)) + 1)
    spans = _spans(text, limit, overlap, encoding())
    for (a, b, n), (c, _, m) in zip(spans, spans[1:]):
        assert max(n, m) <= limit
        # one token of slack inside a word, one character where it has several tokens
        assert overlap - 3 <= len(encode(text[c:b])) <= overlap + 6
    least = -(-(len(encode(text)) - overlap) // (limit - overlap))
    assert len(spans) <= least + 1


def test_split_of_a_table(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "short", 0), (4, "A sentence here. " * 900, 0), (5, "x" * 9000, 0), (5, "x" * 9000, 0), (6, "世" * 2500, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    pieces = split_oversized(df, limit=500, overlap=20)
    assert pieces.where("tokens > 500").isEmpty()
    by = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.max("pieces").alias("n")).collect()}
    assert by[1] == by[2] == by[3] == 1 and by[4] > 5
    four = [r for r in pieces.where("doc_id = 4").orderBy("piece").collect()]
    text, end = "", 0
    for r in four:
        text += r.text[end - r.begin :]
        end = r.end
    assert text == "A sentence here. " * 900
    assert all(r.text.rstrip().endswith(".") for r in four)
    enc = encoding()
    assert {r.doc_id for r in oversized(pieces).collect()} == {i for i, t, _ in rows if len(enc.encode_ordinary(t or "")) > 500}
    with pytest.raises(ValueError):
        split_oversized(df, limit=10, overlap=10)
