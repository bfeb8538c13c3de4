"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix by its weight, but never more than ``most_epochs`` times its own
size; what a capped source leaves is shared among the others by weight until nobody is above its cap.
The level is found in closed form: with sources in ascending order of cap per unit of weight, a source
is capped if its cap is at most its weight times the level that the ones before it leave.

A target of 1.4 times a source's size means every document once, and a seeded sample again that holds
0.4 of the words: documents in the order of a hash of their id, up to the words wanted. Where that order
is cut is found by sums over 4096 hash cells per source, then over 4096 parts of the cell that holds the
cut; only the documents of that last part are put in order. So a source with a third of all rows never
meets in one task, and the words taken differ from the target by half a document at most.

Defined results: a null text has size 0; a null source is a source, after all others; a source without
words has target 0 and is taken 0 times; rows that repeat count each, and rows alike in id, source and
size are taken equally often; an empty table gives an empty result. Other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetape.llm.shared import WORD, column, documents, free_names, stored

#: Bits of the hash that pick a cell, and a part of a cell.
CELL_BITS = 12
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    """60 bits of md5: the same in every engine and on every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def repeating_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Adds ``weight`` to one row per ``source``: the given ones in turn, by code point, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    among = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(among, (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float, most_epochs: float) -> DataFrame:
    """Adds ``target`` to rows of (source, source_size, weight); one row per source."""
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    frame = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("wanted", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level_before", (F.col("wanted") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        .withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level_before"))
        .withColumn("cap_sum", F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole))
        .withColumn("weight_sum", F.sum(F.when(F.col("capped"), F.col("weight")).otherwise(0.0)).over(whole))
    )
    level = (F.col("wanted") - F.col("cap_sum")) / (F.col("weights") - F.col("weight_sum"))
    return frame.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level)).select(
        "source", "source_size", "weight", "target"
    )


def _cut(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Per source the first cell whose words, with those before it, exceed ``rest``: (keys, cell, before)."""
    order = Window.partitionBy("source").orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cells.withColumn("after", F.sum("words").over(order))
        .where(F.col("start") + F.col("after") > F.col("rest"))
        .groupBy(*keys)
        .agg(F.min(F.struct(cell, (F.col("start") + F.col("after") - F.col("words")).alias("before"))).alias("at"))
        .select(*keys, f"at.{cell}", "at.before")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] | DataFrame = (5, 2, 1),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times, taken.

    ``weights`` is a list that repeats over the sources, or a frame of (source, weight > 0).
    ``times`` is how often the mix takes the document and ``taken`` the words that makes.
    """
    sized = _sized(docs, seed)
    plan, cut = _plan(sized, weights, share, most_epochs)
    times, *names = free_names(sized, ["times", "source_size", "target"])
    frame = _with_times(sized, plan, cut, {c: F.col(c) for c in sized.columns}, times, names)
    return frame.select(
        "doc_id",
        "source",
        "size",
        F.col(names[0]).alias("source_size"),
        F.col(names[1]).alias("target"),
        F.col(times).alias("times"),
        (F.col("size") * F.col(times)).cast("long").alias("taken"),
    )


def repeat(
    docs: DataFrame,
    weights: Sequence[float] | DataFrame = (5, 2, 1),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: every document as often as ``mix`` takes it, with the columns it came with.

    The texts stay where they are: only the plan, one row per source, is joined to them.
    """
    plan, cut = _plan(_sized(docs, seed), weights, share, most_epochs)
    size, hash_, times, number, *names = free_names(docs, ["size", "hash", "times", "number", "source_size", "target"])
    frame = docs.withColumn(size, word_count(column(docs, "text"))).withColumn(hash_, seeded(column(docs, "doc_id"), seed))
    of = {"doc_id": column(docs, "doc_id"), "source": column(docs, "source"), "size": F.col(size), "hash": F.col(hash_)}
    frame = _with_times(frame, plan, cut, of, times, names)
    return (
        frame.where(F.col(times) > 0)
        .withColumn(number, F.explode(F.sequence(F.lit(1), F.col(times))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return stored(
        docs.select(
            column(docs, "doc_id").alias("doc_id"),
            column(docs, "source").alias("source"),
            word_count(column(docs, "text")).alias("size"),
            seeded(column(docs, "doc_id"), seed).alias("hash"),
        )
    )


def _cell(value: Column) -> Column:
    return F.shiftright(value, HASH_BITS - CELL_BITS)


def _part(value: Column) -> Column:
    return F.shiftright(value, HASH_BITS - 2 * CELL_BITS).bitwiseAND(F.lit((1 << CELL_BITS) - 1))


def _with_times(frame: DataFrame, plan: DataFrame, cut: DataFrame, of: dict[str, Column], times: str, names: list[str]) -> DataFrame:
    """The frame with ``times`` and, under ``names``, its source's size and target."""
    inner = [f"__plan_{c}" for c in plan.columns]
    frame = frame.join(plan.toDF(*inner), of["source"].eqNullSafe(F.col("__plan_source")))
    match = [of[c].eqNullSafe(F.col(f"__cut_{c}")) for c in ("source", "hash", "doc_id", "size")]
    held = [f"__cut_{c}" for c in cut.columns]
    frame = frame.join(cut.toDF(*held), match[0] & match[1] & match[2] & match[3], "left")
    cell, part = _cell(of["hash"]), _part(of["hash"])
    at, at_part = F.col("__plan_cut_cell"), F.col("__plan_cut_part")
    below = F.coalesce((cell < at) | ((cell == at) & (part < at_part)), F.lit(False))
    again = F.coalesce(F.col("__cut_again"), below.cast("int"))
    return (
        frame.withColumn(times, (F.col("__plan_whole") + again).cast("int"))
        .withColumn(names[0], F.col("__plan_source_size"))
        .withColumn(names[1], F.col("__plan_target"))
        .drop(*inner, *held)
    )


def _plan(sized: DataFrame, weights, share: float, most_epochs: float) -> tuple[DataFrame, DataFrame]:
    """One row per source: its target, whole repetitions, and where the order by hash is cut; and the
    documents of the part that holds the cut, with whether they are taken ``again``."""
    spread = stored(sized.groupBy("source", _cell(F.col("hash")).alias("cell")).agg(F.sum("size").alias("words")))
    sources = spread.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    else:
        sources = repeating_weights(sources, weights)
    some = F.col("source_size") > 0
    whole = F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = stored(
        water_fill(sources, share, most_epochs)
        .withColumn("whole", whole.cast("int"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    of = targets.select(F.col("source").alias("of"), "rest")
    cells = spread.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("start", F.lit(0))
    first = stored(_cut(cells, ["source", "rest"], "cell"))
    first = first.select(F.col("source").alias("of"), "rest", F.col("cell").alias("cut_cell"), F.col("before").alias("start"))
    inner = stored(
        sized.join(first, F.col("source").eqNullSafe(F.col("of")) & (_cell(F.col("hash")) == F.col("cut_cell")))
        .drop("of")
        .withColumn("part", _part(F.col("hash")))
    )
    parts = inner.groupBy("source", "cut_cell", "rest", "start", "part").agg(F.sum("size").alias("words"))
    second = _cut(parts, ["source", "cut_cell"], "part").select(
        F.col("source").alias("of"), "cut_cell", F.col("part").alias("cut_part"), "before"
    )
    plan = stored(targets.join(second, F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "weight"))
    place = second.select("of", "cut_part", "before")
    order = Window.partitionBy("source").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("words").over(order) - F.col("words") + F.col("words") / F.lit(2.0)
    cut = (
        inner.join(place, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("cut_part")))
        .groupBy("source", "hash", "doc_id", "size", "rest", "before")
        .agg(F.sum("size").alias("words"))
        .withColumn("again", (middle <= F.col("rest")).cast("int"))
        .select("source", "hash", "doc_id", "size", "again")
    )
    return plan, stored(cut)


def op1_mix(spark, folder: str) -> DataFrame:
    return mix(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")
