"""Encoding of a corpus through a table of its distinct words.

The text is cut into pre-token words by a Java regular expression inside the
scan stage. The distinct words are counted (map-side combine first), each is
encoded exactly once, and the ids come back to the documents by position:

* the most frequent words, at most ``head_words``, travel to the workers as one
  broadcast table; a whole Arrow batch of words is joined to it at once;
* every other word is joined through a shuffle, by (document, gap). Only rare
  words take this way, so no key is hot and the shuffle stays small; with no
  more than ``head_words`` distinct words this branch isn't planned at all.

Decoding explodes the ids, joins the id-to-piece table and concatenates the
bytes in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from touchline.llm.tokenizer import JAVA_PATTERN, TOKENIZER_DIR, encoding, ranks
from touchline.session import cut, ship

#: Words in the broadcast table. With at most 64 bytes a word (longer ones are
#: always joined by the shuffle) the table is bounded by about 30 MB.
HEAD_WORDS = 1 << 18
HEAD_WORD_BYTES = 64


def words_of(text) -> F.Column:
    """The pre-token words of a text column, in order."""
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))


def distinct_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: every distinct word of the corpus with its count.

    Counted by partial aggregation, so a hot word is one row per task in the
    shuffle.
    """
    return df.where(F.length(text) > 0).select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def encode_words(words: DataFrame, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """``word, n, ids``: each distinct word encoded once."""
    ship(words.sparkSession)
    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(folder, name).encode_ordinary
        for batch in batches:
            ids = [encode(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word").cast(pa.string()), batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

    return words.select("word", "n").mapInArrow(run, schema)


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``flat[starts[i]:starts[i]+lengths[i]]``, one after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[shift + np.arange(total)]


def _head_table(encoded: DataFrame, head_words: int, total: int) -> pa.Table:
    head = encoded.where(F.octet_length("word") <= HEAD_WORD_BYTES).select("word", "n", "ids")
    if total > head_words:
        head = head.orderBy(F.desc("n"), "word").limit(head_words)
    return head.select("word", "ids").toArrow()


def encode_corpus(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    folder: str = TOKENIZER_DIR,
    name: str = "byte_bpe_50k",
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """``id_col, ids array<int>``: one row for each row of ``df``.

    Null and empty texts give an empty list. Repeated rows stay repeated, ties
    don't arise, null ids are kept; any other column of ``df`` is ignored, so
    clashing names are harmless. Texts of any length are encoded whole. An
    empty table gives an empty result.
    """
    spark: SparkSession = df.sparkSession
    base = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    encoded = cut(encode_words(distinct_words(base, "_text"), folder, name))
    total = encoded.count()
    head = _head_table(encoded, head_words, total)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, head.schema) as writer:
        writer.write_table(head)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    out = T.StructType([
        T.StructField("_id", base.schema["_id"].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("gaps", T.ArrayType(T.StringType())),
    ])

    def join_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.ipc.open_stream(shared.value).read_all().combine_chunks()
        keys = table.column("word").combine_chunks() if table.num_rows else pa.array([], pa.string())
        keys = keys.cast(pa.string())
        lists = table.column("ids").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        # one more entry: the placeholder of a word that the table doesn't hold
        starts = np.append(starts, len(flat))
        lengths = np.append(lengths, 1)
        flat = np.append(flat, np.int32(-1))
        for batch in batches:
            words = batch.column("words")
            values = words.flatten().cast(pa.string())
            bounds = words.offsets.to_numpy()
            bounds = bounds - bounds[0]
            found = pc.index_in(values, value_set=keys) if len(keys) else pa.nulls(len(values), pa.int32())
            missing = np.asarray(pc.is_null(found))
            at = np.asarray(pc.fill_null(found, len(keys))).astype(np.int64)
            ids = _gather(flat, starts[at], lengths[at])
            ends = np.concatenate([[0], np.cumsum(lengths[at])])[bounds]
            gap_bounds = np.concatenate([[0], np.cumsum(missing)])[bounds]
            gaps = values.filter(pa.array(missing))
            holes = np.flatnonzero(ids == -1)
            if len(holes):
                # the k-th gap of a document is written as -(k + 1)
                owner = np.searchsorted(ends, holes, side="right") - 1
                ids[holes] = -(np.arange(len(holes)) - gap_bounds[owner] + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(gap_bounds, pa.int32()), gaps),
                ],
                ["_id", "ids", "gaps"],
            )

    split = base.select("_id", F.when(F.length("_text") > 0, words_of(F.col("_text"))).otherwise(F.array().cast("array<string>")).alias("words"))
    joined = split.mapInArrow(join_head, out)
    if total <= head.num_rows:
        return joined.select(F.col("_id").alias(id_col), "ids")

    # A rare word's way back: one row for each gap, joined to the word table,
    # gathered under a key that tells repeated rows apart only by content.
    keyed = cut(joined.withColumn("_key", F.xxhash64("_id", "ids", "gaps")))
    open_rows = keyed.where(F.size("gaps") > 0)
    filled = (
        open_rows.select("_id", "_key", F.posexplode("gaps").alias("_k", "word"))
        .join(encoded.select("word", F.col("ids").alias("_piece")), "word")
        .groupBy("_id", "_key")
        .agg(F.array_sort(F.collect_set(F.struct("_k", "_piece"))).alias("_filled"))
    )
    done = (
        open_rows.alias("a")
        .join(filled.alias("b"), F.col("a._id").eqNullSafe(F.col("b._id")) & (F.col("a._key") == F.col("b._key")))
        .select(
            F.col("a._id").alias(id_col),
            F.flatten(
                F.transform("a.ids", lambda x: F.when(x >= 0, F.array(x)).otherwise(F.element_at("b._filled", -x)["_piece"]))
            ).alias("ids"),
        )
    )
    return keyed.where(F.size("gaps") == 0).select(F.col("_id").alias(id_col), "ids").unionByName(done)


def pieces(spark: SparkSession, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k") -> DataFrame:
    """``id, piece binary``: the vocabulary, about 50,000 rows."""
    import pandas as pd

    rows = pd.DataFrame([(i, bytes(p)) for p, i in ranks(folder, name).items()], columns=["id", "piece"])
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_corpus(
    df: DataFrame, id_col: str = "doc_id", ids: str = "ids", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k"
) -> DataFrame:
    """``id_col, text``: the inverse of :func:`encode_corpus`.

    ``id_col`` must tell rows apart. An empty or null list gives the empty
    text. The vocabulary has a fixed size, so it is broadcast.
    """
    base = df.select(F.col(id_col).alias("_id"), F.col(ids).alias("_ids"))
    rows = base.select("_id", F.posexplode_outer("_ids").alias("_pos", "id"))
    glued = (
        rows.join(F.broadcast(pieces(df.sparkSession, folder, name)), "id", "left")
        .groupBy("_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("_pos", F.hex("piece").alias("_hex"))))).alias("_parts"))
    )
    text = F.decode(F.unhex(F.array_join(F.transform("_parts", lambda p: p["_hex"]), "")), "UTF-8")
    return glued.select(F.col("_id").alias(id_col), text.alias("text"))
