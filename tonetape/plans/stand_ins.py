"""The driver's tables in the shape of share events, bin sentiment, price panels and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetape.functions.clock import parse_minute
from tonetape.functions.text import host_of, ticker_of
from tonetape.operators.dummies import event_dummies
from tonetape.schemas import COMPANY

# Categories of the driver's tables.
EVENT_KINDS = ("click", "purchase", "error", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# Scores are divided by a prime, so that means rarely fall half-way between two rounded values.
SCORE_SCALE, PRICE_SCALE = 97.0, 499979.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sentiment_events(spark: SparkSession, folder: str, ticker: str = "event_type") -> DataFrame:
    """``events`` as cleaned share events."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("TimeStamp"),
        F.col(ticker).cast("string").alias("Ticker"),
        ((F.col("value") - 20.0) / SCORE_SCALE).alias("company_sentiment_score"),
        *event_dummies(EVENT_KINDS, "event_type"),
    )


def share_events(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as raw share events: a part and a supplier as companies, none for flag ``N``.

    Untaxed rows have an unreadable score and closed rows a supplier without a RIC.
    """
    stamp = F.timestamp_seconds(
        F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
        + 9 * 3600
        + F.col("l_linenumber") * 5820
        + F.col("l_quantity").cast("long")
    )
    part = F.struct(
        F.col("l_quantity").cast("int").cast("string").alias("count"),
        F.concat(F.lit("P"), F.col("l_partkey"), F.lit(".N")).alias("ric"),
        F.col("l_returnflag").alias("sentiment"),
        F.col("l_discount").cast("string").alias("sentiment_score"),
    )
    supplier = F.struct(
        F.lit("1").alias("count"),
        F.when(F.col("l_linestatus") != "F", F.concat(F.lit("S"), F.col("l_suppkey"), F.lit(".OQ"))).alias("ric"),
        F.col("l_returnflag").alias("sentiment"),
        F.when(F.col("l_tax") == 0, "n/a").otherwise(F.col("l_tax").cast("string")).alias("sentiment_score"),
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("https://www.s"), F.col("l_suppkey"), F.lit(".example.org:8080/p?q=1")).alias("url"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("standardTimestamp"),
        F.concat(F.lit("www.s"), F.col("l_suppkey"), F.lit(".org")).alias("refDomain"),
        F.when(F.col("l_linestatus") == "F", "Personal computer").otherwise("Tablet").alias("deviceType"),
        F.when(F.col("l_returnflag") == "A", "click").otherwise("pview").alias("mappedEvent"),
        F.when(F.col("l_returnflag") == "N", F.array().cast(T.ArrayType(COMPANY)))
        .otherwise(F.array(part, supplier))
        .alias("companies"),
    )


def event_logs(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as raw log lines with the day of their folder: one company each, named by the event type."""
    company = F.struct(
        F.lit("1").alias("count"),
        F.concat("event_type", F.lit(".N")).alias("ric"),
        F.lit("pos").alias("sentiment"),
        F.col("value").cast("string").alias("sentiment_score"),
    )
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("stid"),
        F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".example.org/x")).alias("url"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("standardTimestamp"),
        F.col("event_type").alias("mappedEvent"),
        F.array(company).alias("companies"),
        F.date_format("ts", "yyyyMMdd").alias("folder"),
    )


def domain_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``pages`` with the host as domain; pages reached by a query string have no score."""
    pages = table(spark, folder, "pages")
    return pages.select(
        "page_id",
        host_of(F.col("url")).alias("refDomain"),
        F.when(~F.contains(F.col("url"), F.lit("?")), F.length("html").cast("double") / SCORE_SCALE).alias(
            "company_sentiment_score"
        ),
    )


def bin_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` per day and priority as bin sentiment."""
    price = F.col("o_totalprice") / PRICE_SCALE
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_orderdate").cast("timestamp").alias("Time"), F.col("o_orderpriority").alias("Ticker"))
        .agg(
            F.mean(price).alias("sentiment_mean"),
            F.stddev(price).alias("sentiment_std"),
            F.count("*").alias("sentiment_count"),
            F.count_if(F.col("o_orderstatus") == "O").alias("event_share_count"),
            F.count_if(F.col("o_orderstatus") == "F").alias("event_click_count"),
        )
    )


def price_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Mean line price per ship day, one column per priority."""
    lines = table(spark, folder, "lineitem").join(
        table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return (
        lines.groupBy(F.col("l_shipdate").cast("timestamp").alias("Time"))
        .pivot("o_orderpriority", list(PRIORITIES))
        .agg(F.mean("l_extendedprice"))
    )


def stock_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Returns as text rows: tax less discount per ship day and line status, in whole cents."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_shipdate", "l_linestatus")
        .agg((F.sum(cents("l_tax")) - F.sum(cents("l_discount"))).alias("cents"))
        .select(
            F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("Lagged_Time"),
            F.col("l_linestatus").alias("variable"),
            (F.col("cents") / 100).cast("string").alias("Return"),
        )
    )


def minute_stock_rows(events: DataFrame) -> DataFrame:
    """Returns as text rows per minute and supplier ticker of share events, in whole cents."""
    flat = events.select(
        F.date_format(parse_minute(F.col("standardTimestamp")), "yyyy-MM-dd HH:mm:ss").alias("Lagged_Time"),
        F.inline("companies"),
    )
    score = F.col("sentiment_score").try_cast("double")
    return (
        flat.filter(F.col("ric").startswith("S"))
        .groupBy("Lagged_Time", ticker_of(F.col("ric")).alias("variable"))
        .agg((F.sum(F.round(score * 100).cast("long")) - 4).alias("cents"))
        .select("Lagged_Time", "variable", (F.col("cents") / 100).cast("string").alias("Return"))
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as predictions of five models, named by event type."""
    k = F.from_json("props", "k int")["k"]
    p1 = (k / 100.0 + F.col("value") / (F.col("value") + 20.0)) / 2
    return table(spark, folder, "events").select(
        F.col("event_type").alias("model"),
        ((k > 60) | F.col("event_type").isin("click", "purchase")).cast("int").alias("label"),
        (1 - p1).alias("p0"),
        p1.alias("p1"),
    )


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` with numbers of their whole text; label 2 marks toxic ones, null unlabelled ones."""
    words = F.size(F.split("text", " "))
    lines = F.size(F.split("text", "\n"))
    labels = table(spark, folder, "labels")
    return (
        table(spark, folder, "documents")
        .select(
            "doc_id",
            F.col("n_chars").cast("double").alias("chars"),
            words.cast("double").alias("words"),
            lines.cast("double").alias("lines"),
        )
        .join(labels, "doc_id", "left")
        .select(
            "doc_id",
            "chars",
            "words",
            "lines",
            (F.col("chars") / F.col("words")).alias("chars_per_word"),
            F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("Label"),
            (F.col("chars") - 1000).alias("ROE_excess_change"),
            (F.col("words") - 200).alias("ROE_change"),
        )
    )
