"""How filters overlap: what every order of them keeps, removes and loses, without running any order.

Each document is read once and shrinks to a bit mask of the filters it fails. Documents with one mask fare
alike under every order, so counts per (part, mask), at most 32 cells a part for five filters, carry all
there is to know. Every cell folds its mask across the literal array of all orders with ``transform`` and
``aggregate``, giving one weighted struct per order and step; the cells' arrays of a part are then summed
element by element. No order is run over documents, and nothing but the order array is sent to tasks.

The hot rows of a large source meet as partial counts per mask. Texts are compared by a 128-bit key, whose
least id is a partial minimum; the join that marks later copies has plain shuffles on both sides, so
adaptive execution can split a text that fills a third of the table.

Defined results: a null text is empty and shares its copies with empty ones; a null source is the empty
part; a null doc_id counts as the largest, so that no other row is a copy of it; rows with one id aren't
copies of each other; an id with several label rows is good (toxic) if one of them says so, a missing label
loses nothing; a text without words passes B; texts are counted whole, however long; an empty table has no
parts and gives no rows; further columns of either table are left aside whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetape.llm.shared import SPACE, column, documents, stored, text_key

#: Orders are the factorial of the filters: 720 for six.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
LAST = (1 << 63) - 1


def text_failures(words: Column, text: Column) -> dict[str, Column]:
    """Filters A to D of one text: too short, too repetitive, too many capitals, markup signs."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """(part, mask, good, toxic) per document, and the letters of the mask's bits, lowest first."""
    text = F.coalesce(column(docs, "text"), F.lit(""))
    plain = docs.select(
        column(docs, "doc_id").alias("doc_id"), text.alias("text"), F.coalesce(column(docs, "source"), F.lit("")).alias("part")
    )
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    failed = text_failures(F.col("words"), F.col("text"))
    key = text_key(F.col("text"))
    seen = stored(
        plain.withColumn("words", words).select(
            "doc_id", "part", key["a"].alias("a"), key["b"].alias("b"), _mask(failed).alias("mask")
        )
    )
    rank = F.coalesce("doc_id", F.lit(LAST))
    copied = stored(
        seen.groupBy("a", "b").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    later = F.coalesce(F.col("first") < rank, F.lit(False))
    marked = seen.join(copied, ["a", "b"], "left").select(
        "doc_id", "part", F.col("mask").bitwiseOR(F.when(later, 1 << len(failed)).otherwise(0)).alias("mask")
    )
    said = stored(
        labels.select(*(column(labels, c, "bigint").alias(c) for c in ("doc_id", "quality", "toxic")))
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")))
    )
    # Rows without an id have no label; kept apart, they don't meet in one task.
    joined = marked.where("doc_id IS NOT NULL").join(said, "doc_id", "left")
    named = joined.select("part", "mask", *(F.coalesce(c, F.lit(False)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))))
    nameless = marked.where("doc_id IS NULL").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return named.unionByName(nameless), "".join(failed) + "E"


def _mask(failed: Mapping[str, Column]) -> Column:
    mask = F.lit(0)
    for bit, fails in enumerate(failed.values()):
        mask = mask.bitwiseOR(F.when(fails, 1 << bit).otherwise(0))
    return mask


def audit(masked: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic) per document.

    ``kept`` counts what is left after the step, ``removed`` what it takes, ``redundant`` what fails its
    filter but went before, ``unique_fails`` what fails no other filter, ``good_lost`` and ``toxic_lost`` the
    labelled part of ``removed``, and ``shapley`` what its filter takes over all orders together.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"one to {MOST_FILTERS} filters of different letters")
    orders = list(permutations(range(len(letters))))
    cells = masked.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")
    )
    bits = F.array(*(F.array(*(F.lit(1 << f) for f in order)) for order in orders))
    folded = cells.select("part", F.flatten(F.transform(bits, _fold)).alias("steps"))
    nothing = F.array_repeat(_counts(F.lit(0).cast("bigint") for _ in COUNTS), len(orders) * len(letters))
    summed = F.aggregate(
        F.collect_list("steps"), nothing, lambda total, steps: F.zip_with(total, steps, lambda x, y: _counts(x[c] + y[c] for c in COUNTS))
    )
    parts = folded.groupBy("part").agg(summed.alias("steps"))
    each_bit = F.flatten(bits)

    def over_all_orders(bit: Column) -> Column:
        removed = F.zip_with("steps", each_bit, lambda step, of: F.when(of == bit, step["removed"]).otherwise(0))
        return F.aggregate(removed, F.lit(0).cast("bigint"), lambda total, n: total + n)

    shapley = F.array(*(over_all_orders(F.lit(1 << f)) for f in range(len(letters))))
    rows = parts.withColumn("shapley", shapley).select("part", "shapley", F.posexplode("steps").alias("at", "step_counts"))
    number, step = F.expr(f"at div {len(letters)}").cast("int"), F.col("at") % len(letters)
    names = F.array(*(F.lit("".join(letters[f] for f in order)) for order in orders))
    places = F.array(*(F.lit(f) for order in orders for f in order))
    return rows.select(
        "part",
        F.get(names, number).alias("filter_order"),
        (step + 1).cast("int").alias("step"),
        *(F.col("step_counts")[c].alias(c) for c in COUNTS),
        F.get("shapley", F.get(places, F.col("at"))).alias("shapley"),
    )


def _counts(values) -> Column:
    return F.struct(*(v.alias(c) for v, c in zip(values, COUNTS, strict=True)))


def _fold(order: Column) -> Column:
    """The steps of one order for a cell (mask, n, n_good, n_toxic): whether it went before, and its counts."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(F.lit(False).alias("gone"), F.expr(f"CAST(array() AS array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>)").alias("steps"))

    def step(so_far: Column, bit: Column) -> Column:
        gone, fails = so_far["gone"], F.col("mask").bitwiseAND(bit) != 0
        taken = ~gone & fails
        count = lambda when, n="n": F.when(when, F.col(n)).otherwise(zero)
        counts = _counts(
            [
                count(~(gone | fails)),
                count(taken),
                count(gone & fails),
                count(F.col("mask") == bit),
                count(taken, "n_good"),
                count(taken, "n_toxic"),
            ]
        )
        return F.struct((gone | fails).alias("gone"), F.concat(so_far["steps"], F.array(counts)).alias("steps"))

    return F.aggregate(order, start, step, lambda folded: folded["steps"])


def op12_filter_audit(spark, folder: str) -> DataFrame:
    labels = spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    return audit(*masks(documents(spark, folder), labels))
