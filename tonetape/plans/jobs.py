"""The whole jobs: read, clean, summarise or join, write. Each is one lazy chain per stored result."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonetape.functions import clock
from tonetape.functions.text import host_of
from tonetape.operators import bins, companies, dummies, forest, frames, returns, rolling, splits, summaries
from tonetape.schemas import DEVICE_TYPES, EVENT_TYPES
from tonetape.session import shared_folder
from tonetape.sources import events as event_source
from tonetape.sources import tables
from tonetape.sources.days import counts_of, observed, restore_days


def clean_events(
    raw: DataFrame, listed: DataFrame | None = None, *, events: Iterable[str] = EVENT_TYPES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw share events as rows (score, count, ticker, event flags, minute), listed tickers only."""
    wanted = raw.select("standardTimestamp", "mappedEvent", *keep, "companies")
    rows = companies.select_company(companies.explode_companies(wanted))
    if listed is not None:
        rows = companies.keep_listed(rows, listed)
    return rows.select(
        *keep,
        "company_count",
        "company_sentiment_score",
        "Ticker",
        *dummies.event_dummies(events),
        clock.parse_minute(F.col("standardTimestamp")).alias("TimeStamp"),
    )


def with_interval(cleaned: DataFrame, width: str = "15 minutes") -> DataFrame:
    """Cleaned rows that have a stamp, with the end of their bin as ``TimeInterval``."""
    return cleaned.withColumn("TimeInterval", clock.bin_end(F.col("TimeStamp"), width))


# The ways to summarise a day's folder; each keeps the folders' days apart.
DAILY_RULES: dict[str, Callable[..., DataFrame]] = {
    "bin_end": partial(bins.bin_end_summary, by=("day",)),
    "bin_start": partial(bins.bin_start_day_summary, day="day"),
    "time_of_day": partial(bins.bin_time_of_day_summary, day="day"),
    "lookback": partial(bins.lookback_summary, day="day"),
}


def daily_bins(
    spark: SparkSession,
    root: str,
    ticker_list: str,
    first: dt.date,
    last: dt.date,
    target: str,
    *,
    rule: str = "bin_end",
    landed: str | None = None,
    spread: int | None = None,
    **settings,
) -> DataFrame:
    """Summarise a range of day folders and write CSV per day; returns the report of days read.

    The logs are parsed once and landed as Parquet by day; the summary reads that copy, and the report
    is counted while it is written. A folder's rows are summarised by themselves, as one run per day would,
    also late ones. ``settings`` (width, threshold and so on) go to the rule. A day whose files can't be read
    is reported with its reason in ``failed`` and keeps what an earlier run landed and summarised; the other
    days lose their old bins when the new ones are complete.
    """
    landed = landed or shared_folder(spark)
    days = list(clock.weekdays(first, last, weekends=False))

    def read(start: dt.date, end: dt.date) -> DataFrame:
        raw = event_source.read_days(spark, root, start, end, bad_lines=True, spread=spread)
        return raw.select("day", "standardTimestamp", "mappedEvent", "companies", event_source.BAD_LINE)

    told = event_source.land_range(spark, read, landed, days)
    good = [d for d in days if not isinstance(told[d], str)]
    stored = event_source.read_landed(spark, landed, first, last, read(first, last).schema).filter(F.col("day").isin(good))
    cleaned = clean_events(stored, tables.read_ticker_list(spark, ticker_list), keep=("day",))
    restore_days(spark, target)
    tables.write_day_csv(DAILY_RULES[rule](cleaned, **settings), target, one_file=True, days=good)
    return event_source.range_report(spark, told)


def labelled_returns(
    raw: DataFrame,
    stock: DataFrame,
    *,
    domains: int = 100,
    domain_mode: str = "intended",
    events: Iterable[str] = EVENT_TYPES,
) -> DataFrame:
    """Events with device, domain and event flags, joined to the return of their minute and ticker.

    Events are read twice, for the labels and for the rows: give this landed ones. The label list
    (at most ``domains`` names) is the only thing collected: it names columns.
    """
    clean_stock = returns.clean_returns(stock)
    wanted = raw.select("standardTimestamp", "mappedEvent", "deviceType", "refDomain", "companies")
    rows = companies.keep_listed(
        companies.select_company(companies.explode_companies(wanted)), clean_stock.select("Ticker").distinct()
    )
    labels = dummies.label_names(dummies.top_labels(rows, domains))
    stamped = rows.withColumn("TimeStamp", clock.parse_minute(F.col("standardTimestamp")))
    joined = returns.label_events(stamped, clean_stock).select(
        "*", *dummies.device_dummies(DEVICE_TYPES), *dummies.event_dummies(events)
    )
    return dummies.add_domain_dummies(joined, labels, mode=domain_mode).drop(
        "standardTimestamp", "deviceType", "refDomain", "mappedEvent"
    )


def model_rows(
    sentiment: DataFrame, panel: DataFrame, *, lookback: str = "10 hours", skip_times: int = 40
) -> DataFrame:
    """Stored bin sentiment and price panel to the frame the classifiers are trained on.

    The merged rows are stored in the shared folder, as the shifts read them twice.
    """
    rolled = rolling.rolling_weighted_sentiment(sentiment, lookback=lookback, skip_times=skip_times)
    merged = returns.merge_returns(rolled.drop("sentiment_std_root"), returns.panel_returns(panel))
    return returns.lag_delta_features(tables.write_table(merged, shared_folder(sentiment.sparkSession)))


def chain_predictions(
    rows: DataFrame,
    target: str,
    *others: str,
    time: str,
    ties: tuple[str, ...] = ("Ticker",),
    portion: float = 0.8,
    learner: forest.Learner = forest.forest,
    **settings,
) -> DataFrame:
    """A chain's stored rows split in time order, a learner fitted to the earlier ones, the later ones predicted.

    Every column but ``target``, ``time``, ``ties`` and the ``others`` is a feature. Works on labelled events
    and on rows of rolled sentiment alike; ``target`` may be a number or a truth value. Hard areas, curves and
    tables come from ``thresholds`` over the result.
    """
    features = frames.features_except(rows, target, time, *ties, *others)
    complete = rows.withColumn(target, F.col(target).cast("double")).na.drop("any", subset=[*features, target])
    train, test = splits.chronological_sides(complete, time=time, ties=ties, portion=portion)
    model = forest.fit(train, features, target, learner, **settings)
    return forest.predict(model, test, target)


def slim_days(
    spark: SparkSession, root: str, first: dt.date, last: dt.date, target: str, *, spread: int | None = None
) -> DataFrame:
    """Stamp, score and RIC of every day of the range, weekends too, as bzip2 CSV without a header.

    Returns rows and unreadable lines per day, counted while the logs are read for the output.
    """
    days = list(clock.weekdays(first, last, weekends=True))
    raw = event_source.read_days(spark, root, first, last, weekends=True, spread=spread, bad_lines=True)
    rows, seen = observed(raw, days, event_source.BAD_LINE)
    slim = companies.slim_companies(rows, keep=("day",))
    restore_days(spark, target)
    tables.write_day_csv(slim, target, header=False, compression="bzip2", days=days)
    return event_source.range_report(spark, counts_of(seen, days))


def statement_sets(
    vectors: DataFrame,
    portion: float,
    extra: Iterable[str],
    label: str,
    *,
    drop_middle: bool = False,
    first_feature: int = 1,
    last_feature: int = 300,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame, list[str], DataFrame]:
    """Stored statement vectors as (train, test, feature names, share of positive labels).

    The first column is the index: it identifies a row and is no feature.
    """
    index = vectors.columns[0]
    rows = frames.require_complete(frames.model_frame(vectors, drop_middle=drop_middle))
    names = frames.feature_names(rows, first_feature, last_feature, extra, index=index)
    split = splits.shuffled_split(rows, [index], portion, seed=seed)
    train, test = (split.filter(F.col("is_test") == side).drop("is_test") for side in (False, True))
    return train, test, names, summaries.positive_ratio(rows, label)


def local_clean(raw: DataFrame, zone: str = "America/Los_Angeles") -> DataFrame:
    """The flat, retyped table: companies as columns, local wall-clock stamp, host of the URL."""
    # Stamp and host belong to the event: once per event, not once per company.
    events = companies.with_companies(raw).withColumns(
        {"standardTimestamp": clock.parse_in_zone(F.col("standardTimestamp"), zone), "domain": host_of(F.col("url"))}
    )
    flat = companies.flatten_companies(events)
    return flat.filter(F.col("companies_ric").isNotNull()).withColumns(
        {
            "companies_sentiment_score": F.col("companies_sentiment_score").try_cast("double"),
            "companies_count": F.col("companies_count").try_cast("double"),
        }
    )


def clean_manifest(
    spark: SparkSession,
    root: str,
    names: Iterable[tuple[str, str]],
    target: str,
    zone: str = "America/Los_Angeles",
    *,
    spread: int | None = None,
    seen: Observation | None = None,
) -> DataFrame:
    """The flat table of all listed files, written by output name in files of even size; returns the stored copy.

    ``seen`` gets the ``rows`` and ``bad_lines`` that were read on the way.
    """
    pairs = list(names)
    raw = event_source.read_manifest(spark, root, pairs, spread=spread, bad_lines=True)
    if seen is not None:
        raw = raw.observe(seen, F.count("*").alias("rows"), F.count(event_source.BAD_LINE).alias("bad_lines"))
    sizes = event_source.manifest_sizes(spark, root, pairs)
    flat = local_clean(raw.drop(event_source.BAD_LINE), zone)
    return tables.write_even(flat, target, "source", sizes)
