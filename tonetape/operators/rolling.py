"""Rolling weighted sentiment: every (time, ticker) with any row in (time - lookback, time]."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetape.functions.clock import floor_div, micros
from tonetape.operators import salting

# A look-back is cut into this many slots to find which times a ticker is seen at, and the
# tickers of one slot are spread over this many groups.
SLOTS = 8
SALTS = 16


def rolling_weighted_sentiment(
    rows: DataFrame,
    *,
    time: str = "Time",
    ticker: str = "Ticker",
    lookback: str = "10 hours",
    skip_times: int = 40,
    measures: Iterable[str] | None = None,
) -> DataFrame:
    """Sums of all measures over the look-back, with mean and deviation weighted by the counts.

    ``sentiment_mean`` = sum(m * w) / sum(w) and ``sentiment_std`` = sum(sd^2 * w^2) / sum(w^2), a
    weighted variance under its customary name; ``sentiment_std_root`` is its square root.
    The first ``skip_times`` distinct times give no output. A ticker has a row at *every* later
    time of the data at which its look-back holds something, also where it has no row itself.

    Rows are reduced to one per (time, ticker) first. The (time, ticker) pairs to report come from
    an equi-join on short time slots, and the sums from windows over (ticker, stretch of time) in
    which each row also visits the next stretch: no window spans a ticker's whole history, and with
    stamps of whole minutes none holds more than 1200 rows for ten hours. Give this a stored table,
    as it is read once for the sums, once for the times and once for the pairs.
    """
    span = micros(lookback)
    names = list(measures) if measures is not None else _numeric(rows, (time, ticker))
    mean, dev, weight = F.col("sentiment_mean"), F.col("sentiment_std"), F.col("sentiment_count").cast("double")
    clean = rows.filter(F.col(time).isNotNull() & F.col(ticker).isNotNull())

    parts = {f"sum_{n}": F.sum(n) for n in names if n not in ("sentiment_mean", "sentiment_std")}
    parts |= {
        "mean_top": F.sum(mean * weight),
        "std_top": F.sum(dev * dev * weight * weight),
        "weight": F.sum(weight),
        "weight_sq": F.sum(weight * weight),
        "seen": F.count("*"),
    }
    at = F.unix_micros(time)
    data = (
        clean.groupBy(time, ticker)
        .agg(*(part.alias(name) for name, part in parts.items()))
        .withColumn("at", at)
        .withColumn("stretch", F.explode(F.array(floor_div(at, span), floor_div(at, span) + 1)))
        .withColumn("wanted", F.lit(False))
    )
    wanted = (
        _pairs_in_reach(clean, time, ticker, span, skip_times)
        .withColumn("stretch", floor_div(F.col("at"), span))
        .withColumn("wanted", F.lit(True))
    )
    # Placed once for both steps: a wanted time that has data becomes one row, then the window runs.
    placed = (
        data.unionByName(wanted, allowMissingColumns=True)
        .repartition(ticker, "stretch")
        .groupBy(ticker, "stretch", "at", time)
        .agg(F.bool_or("wanted").alias("wanted"), *(F.sum(name).alias(name) for name in parts))
    )
    reach = Window.partitionBy(ticker, "stretch").orderBy("at").rangeBetween(-(span - 1), 0)
    rolled = placed.select(time, ticker, "wanted", *(F.sum(name).over(reach).alias(name) for name in parts))
    variance = F.try_divide(F.coalesce("std_top", F.lit(0.0)), F.col("weight_sq"))
    return rolled.filter(F.col("wanted") & (F.col("seen") > 0)).select(
        time,
        ticker,
        F.try_divide(F.coalesce("mean_top", F.lit(0.0)), F.col("weight")).alias("sentiment_mean"),
        variance.alias("sentiment_std"),
        F.sqrt(variance).alias("sentiment_std_root"),
        *(F.col(f"sum_{n}").alias(n) for n in names if f"sum_{n}" in parts),
    )


def roll_next(
    tail: DataFrame | None, seen_times: int, new: DataFrame, *, time: str = "Time", lookback: str = "10 hours", skip_times: int = 40, **settings
) -> tuple[DataFrame, DataFrame, int]:
    """The rolling rows of new data alone, the tail to keep for the next, and how many times were seen by then.

    ``tail`` is what the step before kept: the rows of one look-back up to its last time. ``new`` must be later
    than all of it. So a day is rolled without reading history, and day by day gives the rows of one run over
    all. ``skip_times`` counts from the first step. Three numbers come to the driver; store the tail, as the
    next step reads it three times.
    """
    rows = new if tail is None else tail.unionByName(new)
    timed = lambda r: r.filter(F.col(time).isNotNull())
    at = F.unix_micros(time)
    count, last = timed(new).agg(F.count_distinct(time), F.max(at)).first()
    before = 0 if tail is None else timed(tail).agg(F.count_distinct(time)).first()[0]
    rolled = rolling_weighted_sentiment(
        rows, time=time, lookback=lookback, skip_times=before + max(0, skip_times - seen_times), **settings
    )
    kept = rows if last is None else timed(rows).filter(at > F.lit(last - micros(lookback)))
    return rolled, kept, seen_times + count


def _numeric(rows: DataFrame, keys: tuple[str, ...]) -> list[str]:
    return [f.name for f in rows.schema if f.name not in keys and isinstance(f.dataType, T.NumericType)]


def _pairs_in_reach(rows: DataFrame, time: str, ticker: str, span: int, skip_times: int) -> DataFrame:
    """(time, ticker) pairs that may have something in reach: a bounded superset of the answer.

    A row reaches at most SLOTS + 1 slots, so the pairs exceed the answer by little.
    """
    if span < SLOTS:
        raise ValueError("look-back too short")
    slot = max(span // SLOTS, 1)
    hops = -(-span // slot)
    times = rows.select(time).distinct()
    first = times.orderBy(time).offset(skip_times).limit(1).scalar()
    times = times.filter(F.col(time) >= first).select(
        time,
        F.unix_micros(time).alias("at"),
        floor_div(F.unix_micros(time), slot).alias("slot"),
    )
    reached = (
        rows.select(ticker, floor_div(F.unix_micros(time), slot).alias("slot"))
        .distinct()
        .select(ticker, F.explode(F.sequence(F.col("slot"), F.col("slot") + hops)).alias("slot"))
        .distinct()
    )
    spread, copied = salting.spread(reached, [ticker], SALTS), salting.copied(times, SALTS)
    return spread.join(copied, ["slot", salting.SALT]).select(time, ticker, "at")
