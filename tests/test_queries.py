"""Every registered query of the core against its SQL."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from touchline.plans import load_registry

REGISTRY = load_registry()


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, Decimal)):
        f = float(value)
        return "nan" if math.isnan(f) else repr(round(f, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(name, spark, data, duck):
    df = REGISTRY.queries[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in REGISTRY.sql:
        assert rows or name in ("p4_ranges",)
        return
    result = duck.execute(REGISTRY.sql[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
