"""The bin-end summary over day folders as they arrive: the same clean-up and bin rules, kept running."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tonetape.operators import bins
from tonetape.plans.jobs import clean_events
from tonetape.schemas import SHARE_EVENT


def stream_events(spark: SparkSession, folder: str, *, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SHARE_EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stream_bins(
    raw: DataFrame, listed: DataFrame, *, late: str = "1 hour", width: str = "15 minutes", threshold: int = 5
) -> DataFrame:
    """Each bin once, when no row for it is awaited any more (``late`` behind the newest stamp)."""
    cleaned = clean_events(raw, listed).withWatermark("TimeStamp", late)
    return bins.bin_end_summary(cleaned, width=width, threshold=threshold)


def run_available(summary: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Work off what has arrived, append finished bins as Parquet, and stop; run again for more."""
    return (
        summary.writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
