"""What the training-data operators share: stored stages, free column names, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonetape.session import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a batch handed to Python. Texts vary from nothing to megabytes, so batches are short.
BATCH_ROWS = 512
DOCUMENT = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def stored(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends here, sizes are known."""
    spark = frame.sparkSession
    path = shared_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """Bound the rows that Spark hands to Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def column(frame: DataFrame, name: str, kind: str | None = None) -> Column:
    """A column by exact name, null where the frame has none."""
    kind = kind or DOCUMENT[name]
    return F.col(f"`{name}`").cast(kind) if name in frame.columns else F.lit(None).cast(kind)


def free_names(frame: DataFrame, stems: Iterable[str]) -> list[str]:
    """Column names that the frame doesn't have, so that its own columns stay as they are."""
    taken, found = {c.lower() for c in frame.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def text_key(text: Column) -> Column:
    """128 bits of a text as two longs; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(17), whole).alias("b"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
