"""File scans: CSV, delimited text, JSON, snapshots, fallbacks, inspection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order."""
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return sorted(str(x.getPath()) for x in found) if found is not None else []


def load_all(spark: SparkSession, folder: str, names: Sequence[str]) -> int:
    """Register every table, or -1 and none if one is missing."""
    if any(not exists(spark, f"{folder}/{n}.parquet") for n in names):
        return -1
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)
    return len(names)


def typed_csv(spark: SparkSession, path: str, schema: T.StructType | str, null: str = "") -> DataFrame:
    """CSV with a header and a fixed schema; the empty string is null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", null).option("mode", "PERMISSIVE").csv(path)


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    """Match results: dates parsed, rows without a score left out, scores whole."""
    schema = "date string, home_team string, away_team string, home_score string, away_score string, tournament string, neutral string"
    raw = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(path)
    num = lambda c: F.col(c).try_cast("double").cast("int").alias(c)
    return raw.select(F.col("date").try_cast("date").alias("date"), "home_team", "away_team", num("home_score"), num("away_score"), "tournament", F.lower("neutral").isin("true", "1").alias("neutral")).where("home_score is not null and away_score is not null")


def by_position(spark: SparkSession, path: str, columns: Mapping[str, int], numbers: Sequence[str], sep: str = "\t") -> DataFrame:
    """Delimited text without a header by position; short rows and rows whose
    numbers don't parse are skipped."""
    parts = F.split("value", sep)
    text = spark.read.text(path)
    cols = [(F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") if n in numbers else F.try_element_at(parts, F.lit(i + 1))).alias(n) for n, i in columns.items()]
    out = text.select(*cols)
    for n in columns:
        out = out.where(F.col(n).isNotNull())
    return out


def json_arrays(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold one JSON array; ``file`` tells which."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def nested_markets(df: DataFrame, payload: str, schema: T.DataType | str, path: str = "markets") -> DataFrame:
    """One row a market of payloads with a list of markets."""
    return df.withColumn("_p", F.from_json(payload, schema)).select(*df.columns, F.explode(F.col(f"_p.{path}")).alias("market"))


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Repeated ids once, the first in a stated order of files and rows."""
    from touchline.operators.relational import keep_best

    return keep_best(df, key, order)


def existing_union(spark: SparkSession, paths: Sequence[str], read: Callable[[str], DataFrame]) -> tuple[DataFrame, list[str]]:
    """The union of the paths that exist, and those that don't; none is an error."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"none of {list(paths)} exists")
    out = read(there[0])
    for p in there[1:]:
        out = out.unionByName(read(p))
    return out, [p for p in paths if p not in there]


def latest_snapshot(spark: SparkSession, folder: str, name: str) -> str | None:
    """The newest ``YYYY-MM-DD`` subfolder that holds ``name``."""
    days = []
    for path in glob(spark, f"{folder}/*"):
        day = path.rstrip("/").rsplit("/", 1)[-1]
        try:
            dt.date.fromisoformat(day)
        except ValueError:
            continue
        if len(day) == 10 and exists(spark, f"{path}/{name}"):
            days.append((day, path))
    return max(days)[1] if days else None


def latest_rows(df: DataFrame, day: str) -> DataFrame:
    """Rows of the newest day; the day is found by one small aggregate, so a
    table partitioned by it is pruned to one partition."""
    newest = df.agg(F.max(day)).first()[0]
    return df.where(F.col(day) == F.lit(newest)) if newest is not None else df.limit(0)


def first_non_empty(readers: Sequence[Callable[[], DataFrame | None]]) -> DataFrame | None:
    """The first source that has rows, by priority."""
    for read in readers:
        df = read()
        if df is not None and not df.isEmpty():
            return df
    return None


def fresh_files(spark: SparkSession, path: str, now: dt.datetime, days: int = 7) -> DataFrame:
    """Files of at most ``days`` days, with their age."""
    meta = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("modificationTime").cast("double")) / 86400
    return meta.withColumn("age_days", age).where(F.col("age_days") <= days)


def inspect(df: DataFrame, sample: int = 3) -> dict[str, object]:
    """Columns, types, row count and a few rows of a table."""
    return {"columns": df.columns, "types": dict(df.dtypes), "rows": df.count(), "sample": [r.asDict() for r in df.limit(sample).collect()]}


def step_sample(df: DataFrame, column: str, step: int) -> DataFrame:
    """Every ``step``-th distinct value, in order of its hash: a sampling report."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.where(F.pmod(F.xxhash64(column), F.lit(step)) == 0)


def model_cards(spark: SparkSession, path: str) -> DataFrame:
    """``file, key, value`` of the ``| **Key** | Value |`` rows of Markdown files."""
    lines = spark.read.text(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    pattern = r"^\s*\|\s*\*\*(.+?)\*\*\s*\|\s*(.*?)\s*\|\s*$"
    return lines.select("file", F.lower(F.regexp_extract("value", pattern, 1)).alias("key"), F.regexp_extract("value", pattern, 2).alias("value")).where("key <> ''")


def discover(spark: SparkSession, root: str, pattern: str = "*/*/predictions.csv") -> list[tuple[str, str, str]]:
    """``(model, day, path)`` of the prediction files of a results folder."""
    out = []
    for path in glob(spark, f"{root}/{pattern}"):
        *_, model, day, _ = path.split("/")
        out.append((model, day, path))
    return out


def statements(text: str) -> list[str]:
    """Statements of a SQL script without its line comments; a semicolon or two
    dashes inside a quoted text part nothing."""
    out, part, quote, i = [], "", "", 0
    while i < len(text):
        ch = text[i]
        if quote:
            part += ch
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote, part = ch, part + ch
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
            continue
        elif ch == ";":
            out.append(part.strip())
            part = ""
        else:
            part += ch
        i += 1
    return [s for s in [*out, part.strip()] if s]


def run_script(spark: SparkSession, text: str) -> DataFrame | None:
    """Run every statement; the last one's result comes back."""
    result = None
    for statement in statements(text):
        result = spark.sql(statement)
    return result
