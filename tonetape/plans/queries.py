"""Registered queries: every operator over the driver's whole tables. Keys match ``oracles.SQL``."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetape.functions import clock
from tonetape.functions.text import csv_line
from tonetape.operators import (
    bins,
    companies,
    dummies,
    forest,
    frames,
    heavy,
    returns,
    rolling,
    splits,
    summaries,
    thresholds,
)
from tonetape.plans import jobs
from tonetape.plans import stand_ins as data
from tonetape.session import pin, shared_folder
from tonetape.sources import events as event_source
from tonetape.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY = dt.date(2024, 1, 5)
FEATURES = ["chars", "words", "lines", "chars_per_word"]
#: Seven, so that one, three or five of them can be tried at a split.
GRID_FEATURES = [*FEATURES, "words_per_line", "chars_per_line", "length_step"]


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _comparable(build(pin(spark), folder))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


def _comparable(rows: DataFrame) -> DataFrame:
    """Doubles rounded, stamps without a zone: both engines then show equal values."""

    def shown(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            return F.round(column, 9).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return column.cast("timestamp_ntz").alias(field.name)
        return column

    return rows.select(*(shown(f) for f in rows.schema))


# Stored stages: what several passes of an operator read is written once to the shared folder.


def _stored_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return tables.write_table(data.bin_sentiment(spark, folder), shared_folder(spark))


def _stored_panel(spark: SparkSession, folder: str) -> DataFrame:
    return tables.write_table(data.price_panel(spark, folder), shared_folder(spark))


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    changes = returns.panel_returns(_stored_panel(spark, folder))
    return returns.merge_returns(data.bin_sentiment(spark, folder), changes)


def _stored_merged(spark: SparkSession, folder: str) -> DataFrame:
    return tables.write_table(_merged(spark, folder), shared_folder(spark))


def _stored_model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a 0/1 label."""
    rows = frames.model_frame(data.document_vectors(spark, folder), drop_middle=True)
    return tables.write_table(rows.select("doc_id", *FEATURES, "Label"), shared_folder(spark))


# Bins and look-backs


@query
def bin_end_summary(spark: SparkSession, folder: str) -> DataFrame:
    return bins.bin_end_summary(data.sentiment_events(spark, folder), width="6 hours", events=data.EVENT_KINDS)


@query
def bin_start_day_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.sentiment_events(spark, folder)
    return bins.bin_start_day_summary(rows, DAY, width="2 hours", events=data.EVENT_KINDS)


@query
def bin_time_of_day_summary(spark: SparkSession, folder: str) -> DataFrame:
    return bins.bin_time_of_day_summary(data.sentiment_events(spark, folder), DAY, events=data.EVENT_KINDS)


@query
def lookback_anchor_summary(spark: SparkSession, folder: str) -> DataFrame:
    return bins.lookback_summary(data.sentiment_events(spark, folder), DAY, events=data.EVENT_KINDS)


@query
def lookback_two_pass(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.sentiment_events(spark, folder, ticker="user_id")
    return bins.ranked_lookback(rows, DAY, events=data.EVENT_KINDS)


@query
def rolling_weighted_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return rolling.rolling_weighted_sentiment(_stored_sentiment(spark, folder), lookback="10 days")


@query
def rolled_step_by_step(spark: SparkSession, folder: str) -> DataFrame:
    """The rolling average year by year, each step reading its own rows and the tail that the one before kept."""
    stored = _stored_sentiment(spark, folder)
    first, last = stored.select(F.year(F.min("Time")), F.year(F.max("Time"))).first()
    tail, seen, found = None, 0, []
    for year in range(first, last + 1):
        new = stored.filter((F.col("Time") >= f"{year}-01-01") & (F.col("Time") < f"{year + 1}-01-01"))
        rolled, kept, seen = rolling.roll_next(tail, seen, new, lookback="10 days")
        tail = tables.write_table(kept, shared_folder(spark))
        found.append(tables.write_table(rolled, shared_folder(spark)))
    return reduce(DataFrame.unionByName, found)


# Cleaning


@query
def explode_companies(spark: SparkSession, folder: str) -> DataFrame:
    raw = data.share_events(spark, folder).select("l_orderkey", "l_linenumber", "companies")
    return companies.select_company(companies.explode_companies(raw))


@query
def slim_projection(spark: SparkSession, folder: str) -> DataFrame:
    return companies.slim_companies(data.share_events(spark, folder))


@query
def useful_fraction(spark: SparkSession, folder: str) -> DataFrame:
    return companies.useful_fraction(data.share_events(spark, folder))


@query
def ticker_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("Ticker"))
    listed = (
        data.table(spark, folder, "customer")
        .filter(F.col("c_mktsegment") == "BUILDING")
        .select(F.col("c_custkey").cast("string").alias("Ticker"))
    )
    return companies.keep_listed(rows, listed)


@query
def event_dummies(spark: SparkSession, folder: str) -> DataFrame:
    return data.share_events(spark, folder).select(
        "l_orderkey", "l_linenumber", *dummies.event_dummies(), *dummies.device_dummies()
    )


@query
def top_domain_dummies(spark: SparkSession, folder: str) -> DataFrame:
    pages = data.domain_pages(spark, folder)
    labels = dummies.label_names(dummies.top_labels(pages, 10, part=-3))
    flagged = dummies.add_domain_dummies(pages, labels, part=-3)
    sums = flagged.agg(*(F.sum(f"`{c}`").alias(c) for c in flagged.columns if c.startswith("is_domain_")))
    return sums.unpivot([], [f"`{c}`" for c in sums.columns], "dummy", "pages")


@query
def top_domains_natural_order(spark: SparkSession, folder: str) -> DataFrame:
    return dummies.natural_top_labels(data.domain_pages(spark, folder), 20, part=-3)


@query
def top_domains_by_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred most frequent referrers over all days, from one summary per day and a recount of the candidates."""
    events = data.share_events(spark, folder).select(F.to_date("standardTimestamp").alias("day"), "refDomain")
    stored = tables.write_table(events, shared_folder(spark))
    held = tables.write_table(heavy.summaries(stored, "refDomain"), shared_folder(spark))
    return heavy.top_values(stored, "refDomain", 100, held)[0]


@query
def json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    return data.table(spark, folder, "events").select(
        "event_id", F.from_json("props", "k int").alias("props")
    ).select("event_id", F.col("props.*"))


@query
def timestamp_forms(spark: SparkSession, folder: str) -> DataFrame:
    text = data.table(spark, folder, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("plain"),
    )
    return text.select(
        "event_id",
        clock.parse_minute(F.col("iso")).alias("minute"),
        clock.parse_in_zone(F.col("iso")).alias("from_los_angeles"),
        clock.parse_plain(F.col("plain")).alias("second"),
        F.hour(clock.parse_minute(F.col("iso"))).alias("hour"),
    )


@query
def weekday_scan(spark: SparkSession, folder: str) -> DataFrame:
    days = data.table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return days.filter(clock.is_weekday(F.col("day"))).groupBy(F.date_format("day", "yyyyMMdd").alias("day")).agg(
        F.count("*").alias("rows")
    )


@query
def local_clean(spark: SparkSession, folder: str) -> DataFrame:
    flat = jobs.local_clean(data.share_events(spark, folder))
    return flat.select(
        "l_orderkey",
        "l_linenumber",
        "companies_count",
        "companies_ric",
        "companies_sentiment",
        "companies_sentiment_score",
        "standardTimestamp",
        "domain",
    )


# Summaries


@query
def domain_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.top_summary(data.domain_pages(spark, folder), "refDomain")


@query
def ticker_summary(spark: SparkSession, folder: str) -> DataFrame:
    flat = jobs.local_clean(data.share_events(spark, folder))
    return summaries.score_summary(flat, "companies_ric", "companies_sentiment_score")


@query
def counts_by_user(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.counts_by(data.table(spark, folder, "events"), "user_id")


@query
def hour_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.hour_histogram(data.sentiment_events(spark, folder))


@query
def distinct_keys(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.distinct_values(data.table(spark, folder, "orders"), "o_orderdate", "o_orderpriority")


@query
def label_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.positive_ratio(data.predictions(spark, folder), "label", by=["model"])


@query
def pair_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.table(spark, folder, "lineitem").select(
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_open"),
        (F.col("l_extendedprice") / data.PRICE_SCALE).alias("price"),
    )
    return summaries.pair_profile(rows, "is_open", "price")


# Returns


@query
def labelled_events(spark: SparkSession, folder: str) -> DataFrame:
    events = data.table(spark, folder, "orders").select(
        "o_orderkey",
        F.col("o_orderdate").cast("timestamp").alias("TimeStamp"),
        F.col("o_orderstatus").alias("Ticker"),
    )
    return returns.label_events(events, returns.clean_returns(data.stock_rows(spark, folder)))


@query
def labelled_returns(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain from raw events and text returns; domain flags are shown by their sum."""
    landed = tables.write_table(data.share_events(spark, folder), shared_folder(spark))
    stock = tables.write_table(data.minute_stock_rows(landed), shared_folder(spark))
    rows = jobs.labelled_returns(landed, stock, domains=20)
    flags = [c for c in rows.columns if c.startswith("is_domain_")]
    return rows.select(
        *(c for c in rows.columns if c not in flags),
        reduce(lambda a, b: a + b, (F.col(c) for c in flags)).alias("domain_flags"),
    )


@query
def panel_returns(spark: SparkSession, folder: str) -> DataFrame:
    return returns.panel_returns(_stored_panel(spark, folder))


@query
def merged_returns(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder)


@query
def lag_delta_features(spark: SparkSession, folder: str) -> DataFrame:
    return returns.lag_delta_features(_stored_merged(spark, folder))


@query
def model_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain: rolled sentiment, returns, deltas and lags."""
    return jobs.model_rows(_stored_sentiment(spark, folder), _stored_panel(spark, folder), lookback="10 days")


# Model frames and splits


@query
def union_fill_missing(spark: SparkSession, folder: str) -> DataFrame:
    customers = data.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = data.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return frames.stack([frames.empty(spark, T.StructType([T.StructField("id", T.LongType())])), customers, suppliers])


@query
def model_frame_clean(spark: SparkSession, folder: str) -> DataFrame:
    vectors = data.document_vectors(spark, folder)
    features = frames.feature_names(vectors, 1, 4, ["ROE_change_sign", "ROE_excess_change_sign", "Label"])
    return frames.model_frame(vectors, drop_middle=True).select("doc_id", *features)


@query
def null_report(spark: SparkSession, folder: str) -> DataFrame:
    return frames.null_counts(data.document_vectors(spark, folder))


@query
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = data.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return splits.hash_split(orders, ["o_orderkey"], {"test": 0.2, "valid": 0.1, "train": 0.7})


@query
def shuffled_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = data.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return splits.shuffled_split(orders, ["o_orderkey"], 0.1)


@query
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by label, unlabelled ones as a class of their own."""
    vectors = data.document_vectors(spark, folder).select("doc_id", "Label")
    return splits.stratified_folds(vectors, ["doc_id"], "Label", 5)


@query
def chronological_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = data.table(spark, folder, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("Time"), "o_orderkey", "o_totalprice"
    )
    return splits.chronological_split(orders, ties=("o_orderkey",))


@query
def split_ranges(spark: SparkSession, folder: str) -> DataFrame:
    split = splits.chronological_split(_stored_merged(spark, folder))
    return summaries.time_range(split, by=["is_train"])


# Thresholds


@query
def confident_auc(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.confident_auc(data.predictions(spark, folder), 0.6)


@query
def probability_auc_by_model(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.probability_auc(data.predictions(spark, folder), ["model"])


@query
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.threshold_sweep(data.predictions(spark, folder))


@query
def accuracy_at_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.accuracy_at(data.predictions(spark, folder), 0.7, 0.6)


@query
def model_threshold_curves(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.auc_curves(data.predictions(spark, folder))


@query
def confidence_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return thresholds.confidence_histogram(data.predictions(spark, folder))


# Forests


def _train_and_test(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = splits.hash_split(_stored_model_rows(spark, folder), ["doc_id"], {"test": 0.2, "train": 0.8})
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


@query
def rf_predictions(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _train_and_test(spark, folder)
    return forest.predict(forest.fit_forest(train, FEATURES, seed=1), test).drop("split")


@query
def rf_report(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _train_and_test(spark, folder)
    model = forest.fit_forest(train, FEATURES, seed=1)
    report = forest.model_report(model, train)
    folds = forest.cross_validated_auc(train, FEATURES, ["doc_id"], seed=1)
    return folds.withColumns(
        {
            "train_accuracy": F.lit(report["accuracy"]),
            "train_auc": F.lit(report["auc"]),
            "test_hard_auc": F.lit(forest.hard_auc(forest.predict(model, test))),
        }
    )


@query
def rf_grid_search(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _train_and_test(spark, folder)
    rows = train.withColumns(
        {
            "words_per_line": F.col("words") / F.col("lines"),
            "chars_per_line": F.col("chars") / F.col("lines"),
            "length_step": F.floor(F.log2(F.col("words") + 1)).cast("double"),
        }
    )
    stored = tables.write_table(rows, shared_folder(spark))
    return forest.grid_search(stored, GRID_FEATURES, ["doc_id"], features_per_split=(1, 3, 5))[0]


def _facts(scored: DataFrame, *keys: str) -> DataFrame:
    """What holds of a test row's prediction whatever the trees, and that the area of the class is its closed form."""
    stored = tables.write_table(scored, shared_folder(scored.sparkSession))
    closed, ranked = thresholds.confident_auc(stored).first()["auc"], forest.hard_auc(stored)
    return stored.select(
        *keys,
        "label",
        (F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9).alias("sums_to_one"),
        (F.col("predicted") == (F.col("p1") > F.col("p0")).cast("double")).alias("takes_larger"),
        F.lit(closed == ranked or abs((closed or 0) - (ranked or 0)) < 1e-9).alias("same_auc"),
    )


@query
def event_return_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Raw events and text returns to labelled events, a forest on all their flags, its predictions of the later fifth."""
    landed = tables.write_table(data.share_events(spark, folder), shared_folder(spark))
    stock = tables.write_table(data.minute_stock_rows(landed), shared_folder(spark))
    rows = tables.write_table(jobs.labelled_returns(landed, stock, domains=20), shared_folder(spark))
    return _facts(jobs.chain_predictions(rows, "Label", "Return", time="TimeStamp", numTrees=5, seed=1), "TimeStamp", "Ticker")


@query
def sentiment_return_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Bin sentiment rolled, joined with returns and shifted, boosted trees on the sentiment alone, the later fifth predicted."""
    rows = jobs.model_rows(_stored_sentiment(spark, folder), _stored_panel(spark, folder), lookback="10 days")
    stored = tables.write_table(rows, shared_folder(spark))
    prices = [c for c in stored.columns if c.startswith(("lag_", "delta", "Return_"))]
    scored = jobs.chain_predictions(
        stored, "return_sign", *prices, time="Time", learner=forest.boosted_trees, maxIter=3, seed=1
    )
    return _facts(scored, "Time", "Ticker")


#: Small settings of each learner, for the queries about all of them.
LEARNER_SETTINGS = {"forest": {"numTrees": 5, "seed": 1}, "boosted_trees": {"maxIter": 3, "seed": 1}}


@query
def learner_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the test predictions of every learner, whatever its trees: probabilities, class, exact AUC of the class."""
    train, test = _train_and_test(spark, folder)

    def facts(name: str, learner: forest.Learner) -> DataFrame:
        model = forest.fit(train, FEATURES, learner=learner, **LEARNER_SETTINGS[name])
        scored = tables.write_table(forest.predict(model, test).drop("split"), shared_folder(spark))
        closed, ranked = thresholds.confident_auc(scored).first()["auc"], forest.hard_auc(scored)
        return scored.select(
            F.lit(name).alias("learner"),
            "doc_id",
            "label",
            (F.abs(F.col("p0") + F.col("p1") - 1) < 1e-9).alias("sums_to_one"),
            (F.col("predicted") == (F.col("p1") > F.col("p0")).cast("double")).alias("takes_larger"),
            F.lit(abs(closed - ranked) < 1e-9).alias("same_auc"),
        )

    return reduce(DataFrame.unionByName, (facts(n, make) for n, make in forest.LEARNERS.items()))


@query
def fold_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Each document is predicted once per setting, by the model fitted without its fold."""
    rows = _stored_model_rows(spark, folder)
    settings = [{"maxIter": 1, "seed": 1}, {"maxIter": 2, "seed": 1}]
    found = forest.cross_predictions(
        rows, FEATURES, ["doc_id"], learner=forest.boosted_trees, folds=3, settings=settings
    )
    return found.select("setting", "fold", "doc_id", "label", F.col("p1").between(0.0, 1.0).alias("is_probability"))


@query
def learner_search(spark: SparkSession, folder: str) -> DataFrame:
    """The grid of a boosted learner: two depths by two numbers of trees."""
    choices = {"maxDepth": [1, 3], "maxIter": [2, 4]}
    return forest.search(_stored_model_rows(spark, folder), FEATURES, ["doc_id"], choices, learner=forest.boosted_trees, seed=1)[0]


@query
def rf_importances(spark: SparkSession, folder: str) -> DataFrame:
    train, _ = _train_and_test(spark, folder)
    return forest.importances(forest.fit_forest(train, FEATURES, seed=1), spark, top=30)


# Sources and sinks


@query
def jsonl_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Share events written as gzip JSON lines and cleaned again from there.

    Gzip files cannot be split, so their rows are dealt out after reading.
    """
    path = shared_folder(spark)
    raw = data.share_events(spark, folder)
    raw.drop("l_orderkey", "l_linenumber").write.json(path, compression="gzip")
    return jobs.clean_events(event_source.read_events(spark, path, spread=int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _write_logs(spark: SparkSession, logs: DataFrame, path: str) -> None:
    """One folder of JSON lines per day, or per other name in ``folder``."""
    tables.write_day_folders(logs, path, "folder")


@query
def day_folders(spark: SparkSession, folder: str) -> DataFrame:
    """Bins of all day folders, after a second delivery in which half the days shrink, one goes and one can't be read."""
    path, landed, target, listed = (shared_folder(spark) for _ in range(4))
    logs = tables.write_table(data.event_logs(spark, folder), shared_folder(spark))
    kinds = logs.select("mappedEvent").distinct().filter("mappedEvent <> 'signup'")
    tables.write_csv(kinds, listed, header=False)
    first, last = dt.date(2024, 1, 1), dt.date(2024, 1, 31)

    def run(root: str) -> DataFrame:
        return jobs.daily_bins(spark, root, listed, first, last, target, landed=landed, width="6 hours")

    _write_logs(spark, logs, f"{path}/one")
    run(f"{path}/one")
    day, morning = F.col("folder").substr(7, 2).cast("int"), F.col("standardTimestamp").substr(12, 2) < "12"
    _write_logs(spark, logs.filter((day != 16) & ((day % 2 == 1) | morning)), f"{path}/two")
    # A gzip file that ends half-way: the day's folder can't be read as a whole.
    broken = spark.createDataFrame([(bytearray(b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\xab"),)], "content binary")
    tables.write_file(broken, f"{path}/two/20240115/broken.log.gz")
    report = run(f"{path}/two")
    schema = "TimeInterval timestamp, Ticker string, sentiment_mean double, sentiment_std double, sentiment_count long"
    found = spark.read.schema(f"{schema}, day date").csv(target, header=True, timestampFormat=tables.STAMP_FORMAT)
    told = report.select("day", F.col("rows").alias("rows_read"), F.col("failed").isNotNull().alias("has_failed"))
    return found.select("day", "TimeInterval", "Ticker", "sentiment_mean", "sentiment_count").join(told, "day")


@query
def manifest_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Log files with a space and a plus sign in their names, one of them listed under two names, cleaned by output name."""
    path, target = shared_folder(spark), shared_folder(spark)
    logs = data.event_logs(spark, folder).drop("folder").withColumn("folder", F.concat(F.lit("part 1+"), F.col("mappedEvent")))
    _write_logs(spark, logs, path)
    sizes = event_source.file_sizes(spark, f"{path}/*").select("folder", F.element_at(F.split("file", "/"), F.lit(-1)).alias("file"))
    names = [(f"{r['folder']}/{r['file']}", r["folder"].split("+")[1]) for r in sizes.collect()]  # one row per written file
    names += [(file, "twice") for file, name in names if name == "click"]
    flat = jobs.clean_manifest(spark, path, names, target)
    return flat.select("source", "stid", "companies_ric", "companies_sentiment_score", "domain")


@query
def stored_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """Ticker list without a header and returns as text, each written as gzip CSV and read in its own schema, joined."""
    listed, stock = shared_folder(spark), shared_folder(spark)
    statuses = data.table(spark, folder, "orders").select("o_orderstatus").distinct()
    tables.write_csv(statuses, listed, header=False, compression="gzip")
    tables.write_csv(data.stock_rows(spark, folder), stock, compression="gzip")
    rows = tables.read_returns(spark, stock).withColumnRenamed("variable", "Ticker")
    return companies.keep_listed(rows, tables.read_ticker_list(spark, listed))


@query
def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Bin sentiment written as bzip2 CSV with header and read in its fixed schema."""
    path = shared_folder(spark)
    rows = data.bin_sentiment(spark, folder)
    tables.write_csv(rows, path, compression="bzip2")
    return tables.read_bin_sentiment(spark, path, rows.schema)


@query
def parquet_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    orders = data.table(spark, folder, "orders")
    return tables.write_table(orders, shared_folder(spark), by=("o_orderstatus",))


@query
def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    vectors = data.document_vectors(spark, folder)
    return vectors.select(csv_line(F.col("doc_id"), F.col("Label")).alias("line"))
