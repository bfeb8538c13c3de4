"""Counts, means and small reports over cleaned rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_summary(rows: DataFrame, by: str, score: str = "company_sentiment_score") -> DataFrame:
    """Mean score (nulls left out) and number of rows (nulls counted) per value, most rows first."""
    return (
        rows.groupBy(by)
        .agg(F.mean(score).alias("ave_sentiment_score"), F.count("*").alias("count"))
        .orderBy(F.desc("count"), by)
    )


def top_summary(rows: DataFrame, by: str, score: str = "company_sentiment_score", n: int = 15) -> DataFrame:
    """The first ``n`` rows of ``score_summary``."""
    return score_summary(rows, by, score).limit(n)


def counts_by(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).count().orderBy(F.desc("count"), by)


def distinct_values(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns).distinct()


def hour_histogram(rows: DataFrame, time: str = "TimeStamp") -> DataFrame:
    """Rows per hour of the day, in hour order."""
    return rows.groupBy(F.hour(time).alias("Hour")).count().orderBy("Hour")


def positive_ratio(rows: DataFrame, label: str, by: Iterable[str] = ()) -> DataFrame:
    """Number of rows and the share with a label above zero (or true)."""
    positive = (F.col(label).cast("double") > 0).cast("double")
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(positive).alias("positive_ratio"))


def time_range(rows: DataFrame, by: Iterable[str] = (), time: str = "Time") -> DataFrame:
    """First and last time and the number of rows."""
    return rows.groupBy(*by).agg(
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("rows")
    )


def pair_profile(rows: DataFrame, x: str, y: str) -> DataFrame:
    """The table behind a scatter of ``y`` over a few-valued ``x``: per x, count and spread of y, and corr(x, y)."""
    per_x = rows.groupBy(x).agg(
        F.count(y).alias("n"),
        F.mean(y).alias("y_mean"),
        F.min(y).alias("y_min"),
        F.max(y).alias("y_max"),
    )
    return per_x.withColumn("corr_xy", rows.select(F.corr(F.col(x).cast("double"), F.col(y).cast("double"))).scalar())
