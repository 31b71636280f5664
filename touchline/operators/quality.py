"""Data quality: audits, row rules, group sums and assertions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from touchline.functions import constants as C


def coverage(players: DataFrame, group: str) -> DataFrame:
    """Counts and match rate by group in one aggregate."""
    no_club = F.col("current_club").isNull() | (F.trim("current_club") == "")
    return players.groupBy(group).agg(
        F.count("*").alias("players"),
        F.count("understat_id").alias("matched"),
        F.round(F.count("understat_id") / F.count("*"), 4).alias("match_rate"),
        F.sum(F.when(no_club, 1).otherwise(0)).alias("missing_club"),
        F.sum(F.when(~F.col("is_active"), 1).otherwise(0)).alias("inactive"),
    )


def row_issues(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """``key, issue`` for each broken rule; a rule that is null is broken.

    All rules are tried in one scan.
    """
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.select(F.col(key), F.explode(F.array_compact(F.array(*broken))).alias("issue"))


def group_sum_issues(df: DataFrame, keys: Sequence[str], value: str, market: str = "market_type", low: float = 0.99, high: float = 1.01) -> DataFrame:
    """Groups whose probabilities don't add up, of the markets whose must."""
    sums = df.where(F.col(market).isin(*C.SUM_TO_ONE)).groupBy(*keys).agg(F.round(F.sum(value), 6).alias("total"), F.count("*").alias("n"))
    return sums.where(~F.col("total").between(low, high))


def prediction_rules() -> dict[str, Column]:
    """Rules of the prediction contract, by the name of the issue that a broken
    one gives; all fields are text."""
    outcome, market = F.col("outcome"), F.col("market_type")
    p, sure = F.col("p_model").try_cast("double"), F.lower(F.trim("confidence"))
    fits = {
        "match_1x2": outcome.isin("home", "draw", "away"),
        "outright_winner": outcome.rlike(C.CODE_FORMAT) | (outcome == "OTHER"),
        "group_winner": outcome.rlike(C.CODE_FORMAT) | (outcome == "OTHER"),
        "team_advances": outcome.isin("yes", "no"),
        "btts": outcome.isin("yes", "no"),
        "totals": outcome.rlike(C.TOTALS_FORMAT),
        "top_scorer": F.trim(outcome) != "",
    }
    by_market = F.lit(True)
    for name, ok in fits.items():
        by_market = F.when(market == name, ok).otherwise(by_market)
    return {
        "as_of_date": F.col("as_of_date").rlike(C.DAY_FORMAT),
        "market_type": market.isin(*C.MARKET_TYPES),
        "match_id": F.col("match_id").rlike("|".join(C.MATCH_ID_FORMATS)),
        "outcome": by_market,
        "p_model": p.between(0, 1) & ~F.isnan(p),
        "confidence": sure.isin(*C.CONFIDENCE_WORDS) | F.coalesce(sure.try_cast("double").between(0, 1), F.lit(False)),
        "model_version": F.trim("model_version") != "",
    }


@dataclass(frozen=True)
class Assertion:
    """One number that a query gives and the bounds in which it must lie."""

    name: str
    sql: str
    low: float | None = None
    high: float | None = None
    severity: str = "FAIL"


def run_assertions(spark: SparkSession, checks: Sequence[Assertion]) -> DataFrame:
    """``name, value, status``: PASS, the severity, or ERROR where a query fails."""
    rows = []
    for check in checks:
        try:
            value = spark.sql(check.sql).first()[0]
            value = None if value is None else float(value)
            ok = value is not None and (check.low is None or value >= check.low) and (check.high is None or value <= check.high)
            rows.append((check.name, value, "PASS" if ok else check.severity))
        except Exception as error:  # a failing check is a result, not a crash
            rows.append((check.name, None, f"ERROR: {type(error).__name__}"))
    return spark.createDataFrame(rows, "name string, value double, status string")


def failures(report: DataFrame) -> int:
    """Exit code of a report: failed and erroneous checks, warnings not counted."""
    return report.where("status = 'FAIL' or status like 'ERROR%'").count()


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def header_equals(df: DataFrame, names: Sequence[str]) -> bool:
    return df.columns == list(names)


def orphans(df: DataFrame, key: str, master: DataFrame, master_key: str) -> DataFrame:
    """Rows whose key the master doesn't hold; a null key is an orphan."""
    return df.join(master.select(F.col(master_key).alias(key)).distinct(), key, "left_anti")
