"""Fixed input and output schemas. Input numbers arrive as text and are cast with ``try_cast``."""

from __future__ import annotations

from pyspark.sql import types as T

# The categories that become 0/1 columns.
EVENT_TYPES = ("pview", "click", "search", "share")
DEVICE_TYPES = ("Personal computer", "Tablet", "Smartphone")

COMPANY = T.StructType(
    [
        T.StructField("count", T.StringType()),
        T.StructField("ric", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("sentiment_score", T.StringType()),
    ]
)

SHARE_EVENT = T.StructType(
    [
        T.StructField("stid", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("userAgent", T.StringType()),
        T.StructField("standardTimestamp", T.StringType()),
        T.StructField("deviceType", T.StringType()),
        T.StructField("mappedEvent", T.StringType()),
        T.StructField("refDomain", T.StringType()),
        T.StructField("os", T.StringType()),
        T.StructField("browserFamily", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("shortIp", T.StringType()),
        T.StructField("companies", T.ArrayType(COMPANY)),
    ]
)

STOCK_RETURN = T.StructType(
    [
        T.StructField("Lagged_Time", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("Return", T.StringType()),
    ]
)

TICKER_LIST = T.StructType([T.StructField("Ticker", T.StringType())])


def day_summary(events: tuple[str, ...] = EVENT_TYPES) -> T.StructType:
    """One row per (bin label, ticker), the bin label as text."""
    return T.StructType(
        [
            T.StructField("Ticker", T.StringType()),
            T.StructField("sentiment_mean", T.DoubleType()),
            T.StructField("sentiment_count", T.LongType()),
            *(T.StructField(f"event_{e}_count", T.LongType()) for e in events),
            T.StructField("TimeStamp", T.StringType()),
        ]
    )


def bin_sentiment(events: tuple[str, ...] = EVENT_TYPES) -> T.StructType:
    """One row per (time, ticker): the input of the rolling average when kept as CSV."""
    return T.StructType(
        [
            T.StructField("Time", T.TimestampType()),
            T.StructField("Ticker", T.StringType()),
            T.StructField("sentiment_mean", T.DoubleType()),
            T.StructField("sentiment_std", T.DoubleType()),
            T.StructField("sentiment_count", T.LongType()),
            *(T.StructField(f"event_{e}_count", T.LongType()) for e in events),
        ]
    )
