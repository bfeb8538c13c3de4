"""Quality rules whose limits come from the data: quantile sketches per language and source.

Counts of every whole text are native expressions. Each (language, source) gets one KLL sketch per
measure, built by partial aggregation, so a source with a third of all rows is a few sketches before the
shuffle; the sketches of a language's sources merge to the language's, and those to the corpus's. A
document is held against the limits of the smallest group that has ``least_group`` documents: its source
within its language, its language, or all. A limit is the upper (or lower) quartile plus ``reach``
times the quartile distance, at least a least distance per measure, so that a group in which a measure
hardly varies doesn't reject a document for one odd sign. The limits are joined to the documents
(one row per group) and filter them.

Defined results: a null or empty text has no words and fails the base rules; a null language or source
is a group of its own; repeated rows are judged alike; an empty table gives an empty result. Extra
columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetape.llm.shared import SPACE, WORD, column, documents, free_names, stored

SIGNS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Per measure: the least distance of its limit from the quartile, and the sides that are limited.
MEASURES = {
    "symbols_per_word": (0.1, "above"),
    "dup_line_share": (0.25, "above"),
    "repeat_share": (0.2, "above"),
    "upper_share": (0.2, "above"),
    "word_length": (2.0, "both"),
}
#: Items a sketch holds at its lowest level: exact up to as many documents of a group.
SKETCH_K = 4096
QUARTILES = (0.25, 0.75)


def counts(docs: DataFrame, names: list[str]) -> DataFrame:
    """Adds the seven counts under ``names``; every other column stays."""
    words, hashes, placed, places, *_ = free_names(docs, ["words", "hashes", "placed", "places"])
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines, n_upper = names
    text = F.coalesce(column(docs, "text"), F.lit(""))
    length = F.length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    frame = (
        docs.withColumn(words, F.filter(F.split(text, SPACE), lambda w: w != ""))
        .withColumn(n_lines, F.size(lines).cast("long"))
        .withColumn(n_dup_lines, F.col(n_lines) - F.size(F.array_distinct(lines)))
        .withColumn(word_chars, F.length(F.translate(text, BLANKS, "")).cast("long"))
        .withColumn(n_symbols, (length - F.length(F.translate(text, SIGNS, ""))).cast("long"))
        .withColumn(n_upper, F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"))
        .withColumn(n_words, F.size(words).cast("long"))
    )
    # One hash per window of three words: hash of (hash of the first two, third), by position.
    w = F.col(words)
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(pairs, F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1))), lambda h, c: F.xxhash64(h, c))
    triples = F.slice(triples, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    frame = frame.withColumn(hashes, F.when(F.col(n_words) >= 3, triples).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a window twice are sorted, by (hash, place); neighbours with one hash are repeats.
    twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    frame = frame.withColumn(
        placed,
        F.when(twice, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))),
    )
    p = F.col(placed)
    both = F.zip_with(
        p,
        F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])),
    )
    found = F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    frame = frame.withColumn(places, found)
    # Every window covers its three words, or as many as lie before the next repeated window.
    q = F.col(places)
    covered = F.zip_with(
        q,
        F.slice(q, F.lit(2), F.greatest(F.size(q), F.lit(1))),
        lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)),
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return frame.withColumn(n_repeat, F.coalesce(total, F.lit(0).cast("long"))).drop(words, hashes, placed, places)


def measures(names: list[str]) -> dict[str, Column]:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines, n_upper = [F.col(n).cast("double") for n in names]
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return {
        "symbols_per_word": share(n_symbols, n_words),
        "dup_line_share": share(n_dup_lines, n_lines),
        "repeat_share": share(n_repeat, n_words),
        "upper_share": share(n_upper, word_chars),
        "word_length": share(word_chars, n_words),
    }


def base_failed(names: list[str], least_words: int = 50, most_repeats: int = 50) -> Column:
    n_words, n_repeat = F.col(names[0]), F.col(names[4])
    return (n_words < least_words) | (100 * n_repeat > most_repeats * n_words)


def sketches(counted: DataFrame, names: list[str], lang: Column, source: Column) -> DataFrame:
    """One row per (lang, source): documents and a mergeable sketch per measure, of those that pass the base rules."""
    frame = counted.where(~base_failed(names)).select(lang.alias("lang"), source.alias("source"), *[m.alias(k) for k, m in measures(names).items()])
    made = [F.expr(f"kll_sketch_agg_double({k}, {SKETCH_K})").alias(k) for k in MEASURES]
    return frame.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *made)


def limits(made: DataFrame, reach: float = 3.0, least_group: int = 200) -> DataFrame:
    """One row per (lang, source): ``low_*`` and ``high_*`` of every measure, of the smallest group that is large enough.

    The sketches of a language's sources merge to the language's, and those to the corpus's, whose quartiles
    (one row) are literals of the plan.
    """
    merged = [F.expr(f"kll_merge_agg_double({k})").alias(k) for k in MEASURES]
    by_lang = made.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    overall = by_lang.groupBy().agg(F.sum("n").alias("n"), *merged)
    rows = made.select("lang", "source", "n", *[F.col(k).alias(f"own_{k}") for k in MEASURES])
    of_lang = by_lang.select(F.col("lang").alias("of"), F.col("n").alias("n_lang"), *[F.col(k).alias(f"lang_{k}") for k in MEASURES])
    ends = [F.expr(f"kll_sketch_get_quantile_double({k}, {q}D)").alias(f"{k}_{q}") for k in MEASURES for q in QUARTILES]
    of_all = overall.select(*ends).first().asDict() if not made.isEmpty() else {}
    rows = rows.join(of_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
    found = []
    for k, (least, sides) in MEASURES.items():
        sketch = F.when(F.col("n") >= least_group, F.col(f"own_{k}")).when(F.col("n_lang") >= least_group, F.col(f"lang_{k}"))
        rows = rows.withColumn(f"q_{k}", sketch)
        low, high = (
            F.coalesce(F.expr(f"kll_sketch_get_quantile_double(q_{k}, {q}D)"), F.lit(of_all.get(f"{k}_{q}")).cast("double"))
            for q in QUARTILES
        )
        distance = F.greatest(F.lit(float(reach)) * (high - low), F.lit(float(least)))
        found.append((high + distance).alias(f"high_{k}"))
        found.append((low - distance if sides == "both" else F.lit(None).cast("double")).alias(f"low_{k}"))
    return rows.select("lang", "source", *found)


def verdict(names: list[str], table: dict[str, Column]) -> Column:
    """True unless a base rule or a limit is broken; a group without limits has base failures only."""
    good = ~base_failed(names)
    for k, value in measures(names).items():
        good = good & F.coalesce(value <= table[f"high_{k}"], F.lit(True)) & F.coalesce(value >= table[f"low_{k}"], F.lit(True))
    return good


def judge(docs: DataFrame, keep: list[str] | None = None, reach: float = 3.0, least_group: int = 200) -> tuple[DataFrame, list[str], str]:
    """Documents with their counts and the verdict: (frame, names of the seven counts, name of ``kept``).

    The counts are made once and stored with the columns in ``keep`` (all by default).
    """
    *names, kept, lang, source = free_names(docs, [*COUNTS, "kept", "of_lang", "of_source"])
    counted = counts(docs, names)
    if keep is not None:
        counted = counted.select(*[F.col(f"`{c}`") for c in keep], *names)
    counted = stored(counted)
    made = stored(sketches(counted, names, column(counted, "lang"), column(counted, "source")))
    table = stored(limits(made, reach, least_group)).withColumnsRenamed({"lang": lang, "source": source})
    limit_names = free_names(counted, [f"{side}_{k}" for k in MEASURES for side in ("high", "low")])
    plain = [f"{side}_{k}" for k in MEASURES for side in ("high", "low")]
    table = table.withColumnsRenamed(dict(zip(plain, limit_names, strict=True)))
    same = column(counted, "lang").eqNullSafe(F.col(lang)) & column(counted, "source").eqNullSafe(F.col(source))
    joined = counted.join(table, same, "left").withColumn(kept, verdict(names, dict(zip(plain, map(F.col, limit_names), strict=True))))
    return joined.drop(lang, source, *limit_names), names, kept


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The documents that pass, as they came."""
    judged, _, kept = judge(docs, **rules)
    return judged.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_quality(spark, folder: str) -> DataFrame:
    judged, names, kept = judge(documents(spark, folder), keep=["doc_id", "lang", "source"])
    return judged.select(
        "doc_id", *[F.col(n).alias(c) for n, c in zip(names[:5], COUNTS, strict=False)], base_failed(names).alias("base_failed"), F.col(kept).alias("kept")
    )
