"""Stock returns: cleaning, panel to long returns, joins with sentiment, lags and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetape.operators import salting, series

# The row shifts of the lag and delta features.
SHIFTS = (4, 8, 12, 16)


def clean_returns(raw: DataFrame) -> DataFrame:
    """Text rows (Lagged_Time, variable, Return) as typed (TimeStamp, Ticker, Return)."""
    return raw.select(
        F.try_to_timestamp("Lagged_Time").alias("TimeStamp"),
        F.col("variable").alias("Ticker"),
        F.col("Return").try_cast("double").alias("Return"),
    )


def label_events(
    events: DataFrame,
    returns: DataFrame,
    keys: tuple[str, ...] = ("TimeStamp", "Ticker"),
    *,
    salts: int = 1,
    salt_by: tuple[str, ...] = (),
) -> DataFrame:
    """Events that have a return, with it and ``Label`` = 1.0 where it is above zero, else 0.0.

    A plain join on the keys: adaptive execution splits hot ones. For keys known to be hot beyond that,
    ``salts`` copies of each return meet the events, spread by a hash of the columns in ``salt_by``.
    """
    known = returns.filter(F.col("Return").isNotNull())
    if salts > 1:
        if not salt_by:
            raise ValueError("name the columns whose hash spreads the events")
        salted, copied = salting.spread(events, salt_by, salts), salting.copied(known, salts)
        joined = salted.join(copied, [*keys, salting.SALT]).drop(salting.SALT)
    else:
        joined = events.join(known, list(keys))
    return joined.withColumn("Label", (F.col("Return") > 0).cast("double"))


def panel_returns(
    panel: DataFrame,
    *,
    time: str = "Time",
    tickers: list[str] | None = None,
    holding_minutes: int = 60,
    bar_minutes: int = 15,
    size: int = series.CHUNK_ROWS,
) -> DataFrame:
    """Long (time, Ticker, Return_h_<minutes>) from a wide price panel.

    The change is against the price ``holding_minutes / bar_minutes`` **rows** earlier, whatever
    time lies between; gaps take the last price before them. A zero base gives null.
    """
    shift, rest = divmod(holding_minutes, bar_minutes)
    if rest or shift < 1:
        raise ValueError("the holding period must be a whole number of bars")
    names = tickers or [c for c in panel.columns if c != time]
    prices = series.with_position(panel.select(time, *names), [], time).unpivot(
        [time, "position"], names, "Ticker", "price"
    )
    chunked, filled = series.filled_forward(prices, ["Ticker"], "price", shift, size=size)
    order = series.chunk_order(["Ticker"])
    changes = chunked.withColumn("filled", filled).withColumn("base", F.lag("filled", shift).over(order))
    return series.drop_borrowed(changes).select(
        time, "Ticker", (F.try_divide("filled", "base") - 1).alias(f"Return_h_{holding_minutes}")
    )


def merge_returns(sentiment: DataFrame, returns: DataFrame, *, time: str = "Time") -> DataFrame:
    """Sentiment rows with their return; rows with any null go.

    (A left join followed by dropping nulls keeps exactly the matched, complete rows.)
    """
    return sentiment.join(returns, [time, "Ticker"]).na.drop("any")


def _lag_names(prefix: str) -> dict[str, int]:
    return {f"{prefix}{k}": k for k in SHIFTS}


def add_lags(
    rows: DataFrame, *, value: str = "Return_h_60", time: str = "Time", size: int = series.CHUNK_ROWS
) -> DataFrame:
    """``lag_k``: the return k rows earlier per ticker; incomplete rows go."""
    placed = series.with_position(rows, ["Ticker"], time)
    return series.with_lags(placed, ["Ticker"], value, _lag_names("lag_"), size=size).drop("position").na.drop("any")


def add_deltas(
    rows: DataFrame, *, value: str = "Return_h_60", time: str = "Time", size: int = series.CHUNK_ROWS
) -> DataFrame:
    """``deltak``: the return less the one k rows earlier per ticker; incomplete rows go."""
    placed = series.with_position(rows, ["Ticker"], time)
    lagged = series.with_lags(placed, ["Ticker"], value, _lag_names("_lag"), size=size)
    return (
        lagged.select(*rows.columns, *((F.col(value) - F.col(f"_lag{k}")).alias(f"delta{k}") for k in SHIFTS))
        .na.drop("any")
    )


def lag_delta_features(
    rows: DataFrame, *, value: str = "Return_h_60", time: str = "Time", size: int = series.CHUNK_ROWS
) -> DataFrame:
    """Deltas, then lags of the rows left, and the sign of the return.

    Each step loses the longest shift, so the first 32 rows of a ticker go. Rows must be complete,
    as ``merge_returns`` leaves them: then both steps see the same series and one shift serves both.
    """
    placed = series.with_position(rows, ["Ticker"], time)
    lagged = series.with_lags(placed, ["Ticker"], value, _lag_names("lag_"), size=size)
    return lagged.filter(F.col("position") >= 2 * max(SHIFTS)).select(
        *rows.columns,
        *((F.col(value) - F.col(f"lag_{k}")).alias(f"delta{k}") for k in SHIFTS),
        *(f"lag_{k}" for k in SHIFTS),
        (F.col(value) > 0).alias("return_sign"),
    )
