"""Sentiment summaries per ticker and time bin. One function per set of bin rules.

Input rows carry ``TimeStamp``, ``Ticker``, ``company_sentiment_score`` and ``is_event_*`` flags.
Where a ``day`` is asked for, it is one date, or the name of a date column: then each row belongs to
its own day, such as that of its log folder, and all days are summarised in one plan.
Every variant is one partial and one final aggregation on a derived bin key, so a ticker holding
much of the data is reduced on the map side to one row per bin before it is shuffled.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetape.functions.clock import DAY, day_start, floor_div, label, micros, micros_of_day
from tonetape.schemas import EVENT_TYPES

SCORE = "company_sentiment_score"


def _event_sums(events: Iterable[str]) -> list[Column]:
    return [F.sum(f"is_event_{e}").alias(f"event_{e}_count") for e in events]


def _mean_and_sums(events: Iterable[str]) -> list[Column]:
    return [F.mean(SCORE).alias("sentiment_mean"), F.count(SCORE).alias("sentiment_count"), *_event_sums(events)]


def bin_end_summary(
    rows: DataFrame,
    *,
    width: str = "15 minutes",
    threshold: int = 5,
    events: Iterable[str] = EVENT_TYPES,
    by: Iterable[str] = (),
) -> DataFrame:
    """Bins [start, end) across midnight, named by their **end**; also the sample deviation.

    ``by`` keeps rows of different sources, such as day folders, apart.
    """
    return (
        rows.groupBy(*by, F.window("TimeStamp", width).alias("bin"), "Ticker")
        .agg(
            F.mean(SCORE).alias("sentiment_mean"),
            F.stddev(SCORE).alias("sentiment_std"),
            F.count(SCORE).alias("sentiment_count"),
            *_event_sums(events),
        )
        .filter(F.col("sentiment_count") >= threshold)
        .select(F.col("bin.end").alias("TimeInterval"), "*")
        .drop("bin")
    )


def _day_key(day: dt.date | str) -> list[str]:
    return [day] if isinstance(day, str) else []


def _labelled_by_start(grouped: DataFrame, day: dt.date | str, width: int, threshold: int) -> DataFrame:
    return (
        grouped.filter(F.col("sentiment_count") >= threshold)
        .withColumn("TimeStamp", label(day_start(day), F.col("bin") * width))
        .drop("bin")
    )


def bin_start_day_summary(
    rows: DataFrame,
    day: dt.date | str,
    *,
    width: str = "15 minutes",
    threshold: int = 5,
    events: Iterable[str] = EVENT_TYPES,
) -> DataFrame:
    """Bins of ``day`` named by their **start** as text.

    Rows before the day go; the last bin has no upper end, so later days fall into it.
    """
    step = micros(width)
    if DAY % step:
        raise ValueError("width must divide a day")
    start = day_start(day)
    bin_no = floor_div(F.unix_micros("TimeStamp") - F.unix_micros(start), step)
    grouped = (
        rows.filter(F.col("TimeStamp") >= start)
        .groupBy(*_day_key(day), F.least(bin_no, F.lit(DAY // step - 1)).alias("bin"), "Ticker")
        .agg(*_mean_and_sums(events))
    )
    return _labelled_by_start(grouped, day, step, threshold)


def bin_time_of_day_summary(
    rows: DataFrame,
    day: dt.date | str,
    *,
    width: str = "30 minutes",
    threshold: int = 5,
    events: Iterable[str] = EVENT_TYPES,
) -> DataFrame:
    """Bins by time of day named by their **start** on ``day``; the rows' own dates are ignored."""
    step = micros(width)
    if DAY % step:
        raise ValueError("width must divide a day")
    bin_no = floor_div(micros_of_day(F.col("TimeStamp")), step)
    grouped = (
        rows.filter(F.col("TimeStamp").isNotNull())
        .groupBy(*_day_key(day), bin_no.alias("bin"), "Ticker")
        .agg(*_mean_and_sums(events))
    )
    return _labelled_by_start(grouped, day, step, threshold)


def lookback_summary(
    rows: DataFrame,
    day: dt.date | str,
    *,
    first: dt.time = dt.time(14, 30),
    anchors: int = 7,
    step: str = "1 hour",
    lookback: str = "10 hours",
    threshold: int = 5,
    events: Iterable[str] = EVENT_TYPES,
) -> DataFrame:
    """Per anchor time: rows whose time of day lies in [anchor - lookback, anchor], both ends in.

    The anchors a row counts for are a run of neighbours, so rows are first aggregated per
    (ticker, run) and only these few partial rows are spread over the anchors of their run.
    """
    zero = (first.hour * 3600 + first.minute * 60 + first.second) * 10**6 + first.microsecond
    hop, back = micros(step), micros(lookback)
    if zero < back or zero + (anchors - 1) * hop >= DAY:
        raise ValueError("anchors and their look-back must lie inside one day")
    key = _day_key(day)
    since_first = micros_of_day(F.col("TimeStamp")) - zero
    runs = (
        rows.filter(F.col("TimeStamp").isNotNull())
        .select(
            *key,
            "Ticker",
            SCORE,
            *(f"is_event_{e}" for e in events),
            F.greatest(F.lit(0), -floor_div(-since_first, hop)).alias("from_anchor"),
            F.least(F.lit(anchors - 1), floor_div(since_first + back, hop)).alias("to_anchor"),
        )
        .filter(F.col("from_anchor") <= F.col("to_anchor"))
        .groupBy(*key, "Ticker", "from_anchor", "to_anchor")
        .agg(F.sum(SCORE).alias("score_sum"), F.count(SCORE).alias("score_count"), *_event_sums(events))
    )
    spread = runs.withColumn("anchor", F.explode(F.sequence("from_anchor", "to_anchor")))
    return (
        spread.groupBy(*key, "anchor", "Ticker")
        .agg(
            F.try_divide(F.sum("score_sum"), F.sum("score_count")).alias("sentiment_mean"),
            F.sum("score_count").alias("sentiment_count"),
            *(F.sum(f"event_{e}_count").alias(f"event_{e}_count") for e in events),
        )
        .filter(F.col("sentiment_count") >= threshold)
        .withColumn("TimeStamp", label(day_start(day), F.col("anchor") * hop + zero))
        .drop("anchor")
    )


def ranked_lookback(rows: DataFrame, day: dt.date | str, **rules) -> DataFrame:
    """The look-back summary in anchor order and, within an anchor, by falling mean.

    A ticker's row count equals its score count here, because rows without a score were dropped
    when they were cleaned, so no first pass over the tickers' counts is needed.
    """
    return lookback_summary(rows, day, **rules).orderBy("TimeStamp", F.desc("sentiment_mean"), "Ticker")
