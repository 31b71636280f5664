"""The queries of this folder on the smallest tables: columns and plain facts."""

import pytest

from touchline.llm import registry
from touchline.llm.tokenizer import encoding

COLUMNS = {
    "p1_found": ["team_code"], "p3_found": ["roster_id", "player_id"], "p5_found": ["origin", "rec_key", "typed", "team_code"], "p6_found": ["table_name", "row_key"],
    "p7_found": ["player_id_a", "player_id_b"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(registry.queries))
def test_query_runs(name, spark, data):
    df = registry.queries[name](spark, data)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
    if name not in ("p10_found", "p9_found", "p9_leaks"):
        assert rows


def test_found_rows_agree_with_plain_counts(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    enc = encoding()
    counts = {i: len(enc.encode_ordinary(t or "")) for i, t in texts.items()}
    assert {r.doc_id for r in registry.queries["p10_found"](spark, data).collect()} == {i for i, n in counts.items() if n > 2000}
    ids = {r.doc_id: r.ids for r in registry.queries["p8_ids"](spark, data).collect()}
    assert {i: len(x) for i, x in ids.items()} == counts
    pairs = registry.queries["p7_found"](spark, data).collect()
    assert all(r.player_id_a < r.player_id_b for r in pairs)
