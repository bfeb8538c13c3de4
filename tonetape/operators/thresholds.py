"""Accuracy against confidence. Input: ``label`` and the class probabilities ``p0`` and ``p1``.

The predicted class is 1 where p1 > p0 and 0 otherwise, ties included, and the confidence is that
class's probability. Every table comes from one aggregation to a handful of cells per model.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 46 thresholds from 0.50 to 0.95.
THRESHOLDS = [float(t) for t in np.linspace(0.5, 0.95, 46)]


def _scored(predictions: DataFrame, by: list[str]) -> DataFrame:
    positive = F.col("p1") > F.col("p0")
    return predictions.select(
        *by,
        (F.col("label").cast("double") > 0).alias("truth"),
        positive.alias("positive"),
        F.when(positive, F.col("p1")).otherwise(F.col("p0")).cast("double").alias("confidence"),
    )


def _cells(kept: Column) -> list[Column]:
    positive, truth = F.col("positive"), F.col("truth")
    return [
        F.count_if(kept & positive & truth).alias("tp"),
        F.count_if(kept & positive & ~truth).alias("fp"),
        F.count_if(kept & ~positive & ~truth).alias("tn"),
        F.count_if(kept & ~positive & truth).alias("fn"),
    ]


def _ratio(top: str, bottom: str) -> Column:
    return F.try_divide(F.expr(top).cast("double"), F.expr(bottom).cast("double"))


def _hard_auc() -> Column:
    """Area under the one-point curve of hard classes: 1 if nothing is kept, null for one class only."""
    both = (_ratio("tp", "tp + fn") + _ratio("tn", "tn + fp")) / 2
    return F.when(F.expr("tp + fp + tn + fn") == 0, F.lit(1.0)).otherwise(both)


def confident_auc(predictions: DataFrame, threshold: float = 0.5, by: Iterable[str] = ()) -> DataFrame:
    """AUC of the hard classes and share of rows kept at one threshold."""
    by = list(by)
    return (
        _scored(predictions, by)
        .groupBy(*by)
        .agg(F.count("*").alias("n"), *_cells(F.col("confidence") >= threshold))
        .select(
            *by,
            F.lit(float(threshold)).alias("threshold"),
            _hard_auc().alias("auc"),
            _ratio("tp + fp + tn + fn", "n").alias("kept_share"),
        )
    )


def accuracy_at(
    predictions: DataFrame, pos_threshold: float, neg_threshold: float | None = None, by: Iterable[str] = ()
) -> DataFrame:
    """Accuracy, rows kept, and accuracy per predicted class; one threshold serves both by default."""
    by = list(by)
    neg_threshold = pos_threshold if neg_threshold is None else neg_threshold
    kept = F.col("confidence") >= F.when(F.col("positive"), pos_threshold).otherwise(neg_threshold)
    return (
        _scored(predictions, by)
        .groupBy(*by)
        .agg(*_cells(kept))
        .select(
            *by,
            _ratio("tp + tn", "tp + fp + tn + fn").alias("accuracy"),
            F.expr("tp + fp + tn + fn").alias("counts"),
            _ratio("tp", "tp + fp").alias("accuracy_pos"),
            _ratio("tn", "tn + fn").alias("accuracy_neg"),
        )
    )


def probability_auc(predictions: DataFrame, by: Iterable[str] = (), *, bits: int = 12) -> DataFrame:
    """Exact area under the curve of ``p1`` per group, with the rows of each class; null for one class only.

    It is the share of (positive, negative) pairs that ``p1`` ranks rightly, ties counting half. Rows shrink to
    one per score; the negatives below a score are summed in two levels, per coarse cell of the group and per
    fine cell of the coarse one, so that windows span 4096 cells, or the scores of one fine cell.
    """
    by = list(by)
    coarse, fine = (F.floor(F.col("p1") * (1 << b)).cast("bigint").alias(n) for b, n in ((bits, "_coarse"), (2 * bits, "_fine")))
    truth = F.col("label").cast("double") > 0
    scores = (
        predictions.select(*by, F.col("p1").cast("double").alias("p1"), truth.alias("truth"))
        .filter("p1 IS NOT NULL AND truth IS NOT NULL")
        .groupBy(*by, "p1")
        .agg(F.count_if("truth").alias("_pos"), F.count_if(~F.col("truth")).alias("_neg"))
        .select("*", coarse, fine)
    )

    def below(rows: DataFrame, inside: list[str], order: str, into: str) -> DataFrame:
        window = Window.partitionBy(*inside).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(into, F.coalesce(F.sum("_neg").over(window), F.lit(0)))

    fines = scores.groupBy(*by, "_coarse", "_fine").agg(F.sum("_neg").alias("_neg"))
    coarses = below(fines.groupBy(*by, "_coarse").agg(F.sum("_neg").alias("_neg")), by, "_coarse", "_before").drop("_neg")
    starts = below(fines, [*by, "_coarse"], "_fine", "_inside").drop("_neg")
    # One group may lack a name; equal groups meet all the same.
    meet = lambda left, right, on: left.join(
        right.withColumnsRenamed({c: f"{c}_" for c in on}), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in on]
    ).drop(*(f"{c}_" for c in on))
    placed = meet(meet(below(scores, [*by, "_fine"], "p1", "_here"), starts, [*by, "_coarse", "_fine"]), coarses, [*by, "_coarse"])
    rank = F.col("_pos") * (F.col("_before") + F.col("_inside") + F.col("_here") + F.col("_neg") / 2)
    return (
        placed.groupBy(*by)
        .agg(F.sum(rank).alias("_right"), F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
        .select(*by, F.try_divide(F.col("_right"), F.col("n_pos") * F.col("n_neg").cast("double")).alias("auc"), "n_pos", "n_neg")
    )


def _level(confidence: Column) -> Column:
    """Index of the highest threshold at or below the confidence, -1 if there is none."""
    near = F.round((confidence - THRESHOLDS[0]) * 100).cast("int")
    near = F.least(F.greatest(near, F.lit(0)), F.lit(len(THRESHOLDS) - 1))
    edge = F.get(F.array(*(F.lit(t) for t in THRESHOLDS)), near)
    return F.when(confidence >= edge, near).otherwise(near - 1)


def _swept(predictions: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn kept at each of the thresholds, and the totals ``n``, ``n_pos``, ``n_neg``.

    Rows are reduced to one per (model, level); these few are then counted at every threshold.
    """
    levels = (
        _scored(predictions, by)
        .withColumn("level", _level(F.col("confidence")))
        .groupBy(*by, "level")
        .agg(*_cells(F.lit(True)))
    )
    steps = F.posexplode(F.array(*(F.lit(t) for t in THRESHOLDS))).alias("step", "threshold")
    kept = F.col("level") >= F.col("step")
    return (
        levels.select("*", steps)
        .groupBy(*by, "threshold")
        .agg(
            F.sum(F.expr("tp + fp + tn + fn")).alias("n"),
            F.sum(F.expr("tp + fp")).alias("n_pos"),
            F.sum(F.expr("tn + fn")).alias("n_neg"),
            *(F.sum(F.when(kept, F.col(c)).otherwise(0)).alias(c) for c in ("tp", "fp", "tn", "fn")),
        )
    )


def threshold_sweep(predictions: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """Accuracies and kept shares, over all rows and per predicted class, at 46 thresholds."""
    by = list(by)
    return _swept(predictions, by).select(
        *by,
        "threshold",
        _ratio("tp + tn", "tp + fp + tn + fn").alias("accuracy"),
        _ratio("tp", "tp + fp").alias("accuracy_pos"),
        _ratio("tn", "tn + fn").alias("accuracy_neg"),
        _ratio("tp + fp + tn + fn", "n").alias("kept"),
        _ratio("tp + fp", "n_pos").alias("kept_pos"),
        _ratio("tn + fn", "n_neg").alias("kept_neg"),
    )


def auc_curves(predictions: DataFrame, by: Iterable[str] = ("model",)) -> DataFrame:
    """AUC of the hard classes and the model's own kept share at 46 thresholds per model."""
    by = list(by)
    return _swept(predictions, by).select(
        *by, "threshold", _hard_auc().alias("auc"), _ratio("tp + fp + tn + fn", "n").alias("kept_share")
    )


def confidence_histogram(predictions: DataFrame, by: Iterable[str] = (), bins: int = 10) -> DataFrame:
    """Rows per confidence bin and predicted class: equal bins from the least to the largest
    confidence of the class, the last one closed; empty bins are listed with 0."""
    by = [*by, "predicted"]
    scored = _scored(predictions, by[:-1]).withColumn("predicted", F.col("positive").cast("int"))
    low = F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low"))
    high = F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high"))
    ends = (
        scored.groupBy(*by)
        .agg(F.min("confidence").alias("low"), F.max("confidence").alias("high"))
        .select(*by, low.alias("low"), high.alias("high"))
    )
    step = (F.col("high") - F.col("low")) / bins
    edge = lambda i: F.when(i == bins, F.col("high")).otherwise(F.col("low") + i * step)
    value, guess = F.col("confidence"), F.col("guess")
    first_guess = F.least(F.floor((value - F.col("low")) / step), F.lit(bins - 1))
    found = (
        F.when(value < edge(guess), guess - 1)
        .when((value >= edge(guess + 1)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    counted = (
        scored.join(ends, by)
        .withColumn("guess", first_guess)
        .groupBy(*by, "low", "high", found.alias("found"))
        .count()
    )
    return (
        counted.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .groupBy(*by, "bin", "low", "high")
        .agg(F.sum(F.when(F.col("found") == F.col("bin"), F.col("count")).otherwise(0)).alias("count"))
        .select(*by, "bin", edge(F.col("bin")).alias("bin_low"), edge(F.col("bin") + 1).alias("bin_high"), "count")
    )
