"""Line dedup by pairwise alignment: shared runs of lines find overlapping documents, patience diff aligns them.

Every document becomes its sequence of line hashes, a few bytes a line; texts aren't shuffled until the
lines that go are known. Equal texts are one text: all but the first document of it go the way of an
alignment with itself. The shortest runs of lines that may be deleted, ``least_lines`` lines with words or
fewer of ``least_words`` words, are the keys: each run of a text leads to the earliest text that holds it,
however many do, so a run in thousands of texts makes as many pairs as it has holders, not their square.
A block that may go consists of such runs, so each of its lines with words has an earlier partner that holds
a run around it. A pair is aligned by patience diff over the whole sequences: equal ends, then lines that are
unique in both, in their longest common order, then the stretches between them. Runs of aligned lines are
blocks; a block of ``least_lines`` lines with words, or of ``least_words`` words, is deleted from the later
text. What one alignment in order leaves, such as a passage that comes again, is aligned from its shortest runs
outwards. All alignments look at the input, and nothing is deleted but what is aligned.

Defined results: a null text counts as empty and stays null if nothing is deleted from it; a null doc_id
counts as the largest; documents with one id are in the order of a hash of their text, and repeated rows
of one id and text are alike, so all of them stay; lines are split at line feeds and compared by 64-bit
hashes; an empty table gives an empty result; extra columns are carried along.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetape.llm.shared import WORD, column, documents, free_names, short_batches, stored

LEAST_LINES = 2
LEAST_WORDS = 12
LAST = (1 << 63) - 1


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience diff: ascending pairs of places with equal values."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {v: j for j, v in enumerate(b[b0:b1], b0) if in_b[v] == 1}
        single = [(i, place[v]) for i, v in enumerate(a[a0:a1], a0) if in_a[v] == 1 and v in place]
        anchors = _longest_ascent(single)
        before = (a0, b0)
        for i, j in anchors:
            todo.append((before[0], i, before[1], j))
            before = (i, j)
        if anchors:
            todo.append((before[0], a1, before[1], b1))
    return sorted(found)


def _longest_ascent(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of the pairs whose second places ascend, too."""
    tops, ends, back = [], [], [0] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at == len(tops):
            tops.append(j)
            ends.append(k)
        else:
            tops[at], ends[at] = j, k
        back[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def units(words: list[int], least_lines: int, least_words: int) -> list[tuple[int, int]]:
    """(begin, end) of the shortest runs of lines that may be deleted.

    They begin and end at lines with words. Each line with words of a block that may go lies in such a run of the block.
    """
    places = [i for i, n in enumerate(words) if n > 0]
    least_lines = max(1, least_lines)
    found = {(places[k], places[k + least_lines - 1] + 1) for k in range(len(places) - least_lines + 1)}
    for k in range(len(places)):  # fewer lines, but words enough: forwards and backwards from each line
        for ahead in (places[k : k + least_lines - 1], places[max(0, k - least_lines + 2) : k + 1][::-1]):
            total = 0
            for i in ahead:
                total += words[i]
                if total >= least_words:
                    found.add((min(i, places[k]), max(i, places[k]) + 1))
                    break
    return sorted(found)


def alignments(earlier: list[int], later: list[int], words: list[int], least_lines: int, least_words: int) -> Iterator[list[tuple[int, int]]]:
    """Patience diff of the whole texts, then of what it couldn't align: blocks that come again, stand in another
    order or have no line that is unique in both.

    There the shortest runs that may be deleted are the anchors: a run that is not aligned as a whole, and that the
    earlier text holds anywhere, is aligned with its place there, and so are the equal lines before and after it.
    """
    pairs = align(earlier, later)
    yield pairs
    partner = {j: i for i, j in pairs}
    known = dict(zip(later, words, strict=True))
    there = [known.get(h, 1) for h in earlier]
    held = {tuple(earlier[i:j]): i for i, j in units(there, least_lines, least_words)}
    for begin, end in units(words, least_lines, least_words):
        start = partner.get(begin, -end)
        if all(partner.get(j) == start + j - begin for j in range(begin, end)):
            continue
        start = held.get(tuple(later[begin:end]))
        if start is None:
            continue
        run = [(start + i, begin + j) for i, j in align(earlier[start : start + end - begin], later[begin:end])]
        if not run:
            continue
        (i, j), (m, n) = run[0], run[-1]
        while i and j and earlier[i - 1] == later[j - 1]:
            i, j = i - 1, j - 1
            run.insert(0, (i, j))
        while m + 1 < len(earlier) and n + 1 < len(later) and earlier[m + 1] == later[n + 1]:
            m, n = m + 1, n + 1
            run.append((m, n))
        partner |= {j: i for i, j in run}
        yield run


def deleted(earlier: list[int], later: list[int], words: list[int], least_lines: int, least_words: int) -> list[int]:
    """Places of the later document that lie in an aligned block large enough; ``words`` counts per line."""
    out: set[int] = set()
    for pairs in alignments(earlier, later, words, least_lines, least_words):
        block, before = [], None
        for i, j in [*pairs, (-2, -2)]:
            if before != (i - 1, j - 1):
                if sum(words[k] > 0 for k in block) >= least_lines or sum(words[k] for k in block) >= least_words:
                    out.update(block)
                block = []
            block.append(j)
            before = (i, j)
    return sorted(out)


def _sequences(docs: DataFrame) -> DataFrame:
    """(doc, a, b, lines, words): the id's rank, 128 bits of the text, a hash and the words of each line."""
    text = F.coalesce(column(docs, "text"), F.lit(""))
    lines = F.split(text, "\n")
    return docs.select(
        _rank(docs).alias("doc"),
        F.xxhash64(text).alias("a"),
        F.xxhash64(F.lit(17), text).alias("b"),
        F.transform(lines, lambda x: F.xxhash64(x)).alias("lines"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"),
    )


def _rank(docs: DataFrame) -> Column:
    return F.coalesce(column(docs, "doc_id"), F.lit(LAST))


def find_deleted(
    docs: DataFrame,
    least_lines: int = LEAST_LINES,
    least_words: int = LEAST_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """By text (a, b): ``gone``, places of lines deleted from every document of it; and ``first``, its first document.

    The second frame has the texts of two or more documents, of which all but the first go wholly.
    """
    short_batches(docs.sparkSession)
    whole = stored(_sequences(docs))
    texts = whole.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    copies = texts.where(F.col("first") < F.col("last")).select("a", "b", "first")
    # A text that comes again counts once, as its first document.
    one = whole.groupBy("a", "b").agg(F.min(F.struct("doc", "lines", "words")).alias("s")).select("a", "b", "s.doc", "s.lines", "s.words")
    one = stored(one)
    held = stored(_held(one, least_lines, least_words))
    holders = held.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "a", "b")).alias("at")).where(F.col("n") > 1)
    shared = holders.select("unit", F.col("at.a").alias("a0"), F.col("at.b").alias("b0"))
    pairs = held.join(shared, "unit").where((F.col("a") != F.col("a0")) | (F.col("b") != F.col("b0"))).select("a", "b", "a0", "b0").distinct()
    earlier = one.select(F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("lines").alias("lines0"))
    both = pairs.join(one, ["a", "b"]).join(earlier, ["a0", "b0"]).select("a", "b", "lines0", "lines", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            gone = [deleted(*row, least_lines, least_words) for row in rows]
            owner = np.repeat(np.arange(len(gone)), [len(g) for g in gone])
            of = pa.array(owner, pa.int64())
            flat = pa.array([p for g in gone for p in g], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), flat], ["a", "b", "place"])

    gone = both.mapInArrow(run, "a bigint, b bigint, place int").groupBy("a", "b").agg(F.collect_set("place").alias("gone"))
    return gone, copies


def _held(one: DataFrame, least_lines: int, least_words: int) -> DataFrame:
    """(unit, doc, a, b): the hash of each different run of lines that may go, by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lines, words in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                raw = np.array(lines, "<i8").tobytes()
                found.append({xxhash.xxh3_64_intdigest(raw[8 * i : 8 * j]) for i, j in units(words, least_lines, least_words)})
            of = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
            flat = pa.array(np.array([u for f in found for u in f], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([flat, *(batch.column(i).take(of) for i in range(3))], ["unit", "doc", "a", "b"])

    return one.select("doc", "a", "b", "lines", "words").mapInArrow(run, "unit bigint, doc bigint, a bigint, b bigint")


def mark(docs: DataFrame, **rules) -> tuple[DataFrame, str, str]:
    """The documents with the places of the lines that go, and whether all do: (frame, two column names)."""
    gone, all_, a, b, a2, b2, first = free_names(docs, ["gone", "all", "a", "b", "a2", "b2", "first"])
    parts, copies = find_deleted(docs, **rules)
    text = F.coalesce(column(docs, "text"), F.lit(""))
    keyed = docs.withColumn(a, F.xxhash64(text)).withColumn(b, F.xxhash64(F.lit(17), text))
    found = parts.join(copies.select(F.col("a"), F.col("b"), "first"), ["a", "b"], "full").select(
        F.col("a").alias(a2), F.col("b").alias(b2), F.col("gone").alias(gone), F.col("first").alias(first)
    )
    joined = keyed.join(found, (F.col(a) == F.col(a2)) & (F.col(b) == F.col(b2)), "left")
    least_lines, least_words = rules.get("least_lines", LEAST_LINES), rules.get("least_words", LEAST_WORDS)
    lines_with_words = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    large = (F.regexp_count(text, F.lit(WORD)) >= least_words) | (lines_with_words >= least_lines)
    copy = F.coalesce(F.col(first) < _rank(docs), F.lit(False))
    return joined.withColumn(all_, copy & large).drop(a, b, a2, b2, first), gone, all_


def remove_lines(docs: DataFrame, **rules) -> DataFrame:
    """The documents as they came, ``text`` without the lines that go; the number of rows stays."""
    frame, gone, all_ = mark(docs, **rules)
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            marks = zip(texts, batch.column(gone).to_pylist(), batch.column(all_).to_pylist(), strict=True)
            made = [without(text, places, whole) for text, places, whole in marks]
            columns = list(batch.drop_columns([gone, all_]).columns)
            columns[place] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return frame.select(*[F.col(f"`{c}`") for c in docs.columns], gone, all_).mapInArrow(run, docs.schema)


def without(text: str | None, places: list[int] | None, whole: bool) -> str | None:
    if whole:
        return ""
    if not places:
        return text
    drop = set(places)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)


def op3_line_dedup(spark, folder: str) -> DataFrame:
    """doc_id, the lines a document has and loses, and the sha256 of what is left."""
    docs = documents(spark, folder).select("doc_id", "text")
    frame, gone, all_ = mark(docs)
    counted = frame.select("doc_id", "text", gone, all_, F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    schema = "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            ids, texts, parts, whole, lines = (c.to_pylist() for c in batch.columns)
            rows = [
                (n if w else len(p or ()), hashlib.sha256((without(t, p, w) or "").encode()).hexdigest())
                for t, p, w, n in zip(texts, parts, whole, lines, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(lines, pa.int64()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.string()),
                ],
                ["doc_id", "n_lines", "n_removed", "kept_sha256"],
            )

    return counted.mapInArrow(run, schema)
