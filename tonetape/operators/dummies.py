"""0/1 columns for fixed categories and for the most frequent domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetape.functions.text import domain_label, name_part
from tonetape.schemas import DEVICE_TYPES, EVENT_TYPES


def _flag(test: Column, name: str) -> Column:
    return F.when(test, 1).otherwise(0).alias(name)


def category_dummies(column: str, categories: Iterable[str], prefix: str, *, rename: bool = True) -> list[Column]:
    """One 0/1 column per category; null and unknown values are 0 everywhere."""
    return [_flag(F.col(column) == c, prefix + (name_part(c) if rename else c)) for c in categories]


def event_dummies(events: Iterable[str] = EVENT_TYPES, column: str = "mappedEvent") -> list[Column]:
    return category_dummies(column, events, "is_event_")


def device_dummies(
    devices: Iterable[str] = DEVICE_TYPES, column: str = "deviceType", *, rename: bool = True
) -> list[Column]:
    return category_dummies(column, devices, "is_device_", rename=rename)


def top_labels(rows: DataFrame, n: int = 100, column: str = "refDomain", part: int = -2) -> DataFrame:
    """First ``n`` distinct labels in the order of their domains' counts, with that best count.

    Domains without such a part do not use up a place. Equal counts are ordered by label.
    """
    domains = rows.groupBy(column).count()
    return (
        domains.select(domain_label(F.col(column), part).alias("label"), "count")
        .filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.max("count").alias("best_count"))
        .orderBy(F.desc("best_count"), "label")
        .limit(n)
    )


def natural_top(rows: DataFrame, n: int = 100, column: str = "refDomain") -> DataFrame:
    """The ``n`` last domains in text order, whatever their counts."""
    return rows.groupBy(column).count().orderBy(F.desc_nulls_last(column)).limit(n)


def natural_top_labels(rows: DataFrame, n: int = 100, column: str = "refDomain", part: int = -2) -> DataFrame:
    """Distinct labels of the ``n`` last domains in text order, in that order."""
    return (
        natural_top(rows, n, column)
        .select(column, domain_label(F.col(column), part).alias("label"))
        .filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.max(column).alias("domain"))
        .orderBy(F.desc("domain"))
    )


def label_names(labels: DataFrame) -> list[str]:
    """The labels as Python names. Collects at most the ``n`` rows ``top_labels`` was limited to."""
    return [row["label"] for row in labels.collect()]


def add_domain_dummies(
    rows: DataFrame, labels: Iterable[str], column: str = "refDomain", *, part: int = -2, mode: str = "intended"
) -> DataFrame:
    """One more 0/1 column per label; the domain is taken apart once per row.

    ``intended`` compares the label inside the domain. ``literal`` compares the whole domain with
    the label, so only a bare one-part domain can match.
    """
    if mode not in ("intended", "literal"):
        raise ValueError("mode must be 'intended' or 'literal'")
    value = domain_label(F.col(column), part) if mode == "intended" else F.col(column)
    flags = [_flag(F.col("_label") == label, f"is_domain_{label}") for label in labels]
    return rows.withColumn("_label", value).select("*", *flags).drop("_label")
