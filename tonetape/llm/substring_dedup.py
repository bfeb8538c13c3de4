"""Removal of long word spans that repeat across documents, by a compacted De Bruijn graph.

The edges of the graph are windows of ``WINDOW`` words. Every window belongs to the bucket of its
minimizer, the least hash among its inner ``SEED``-word runs, which depends on the window's words alone;
a run of neighbouring windows with one minimizer is a path. Equal paths collapse by a join on a 128-bit
hash of their words, whatever the number of their copies: an occurrence in any but the first document is
repeated as a whole. A path that is alone in its bucket is done. Where a bucket holds several paths the
graph branches there: the first occurrences of those paths are opened into their windows, at their
coordinates, and windows meet by their own 128-bit hash. Some 5 % of the words become rows in the first
step, and only branching places become rows per window. Spans found go back to the documents, which
drop the words.

A window is repeated if its word sequence also starts in a document with a smaller id, judged on the
input. Counts and first documents are minima under partial aggregation, so a passage in a third of all
documents is one row per task before the shuffle; no pairs are made.

Defined results: a null text has no words; a null doc_id counts as the largest; rows with one id are not
repeats of each other, and each is judged against smaller ids; texts are taken whole, however long; texts under ``WINDOW`` words stay as they
are; an empty table gives an empty result; extra columns are carried along by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetape.llm.shared import column, documents, free_names, short_batches, stored
from tonetape.llm.wordruns import Rolling, mixed, word_hashes

WINDOW = 50
SEED = 15
#: Windows of a path at most: a run of equal words has one minimizer throughout.
PATH = 64
LAST = (1 << 63) - 1
def paths(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """All paths of the texts: (text number, start word, windows, minimizer, hash 1, hash 2)."""
    words, ends = word_hashes(texts)
    total = words.shape[1]
    if total < WINDOW:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    rolling = Rolling(words)
    seeds = mixed(rolling.runs(np.arange(total - SEED + 1), SEED)[0])
    # Least seed hash among those inside each window, by doubling.
    span, least, wide = WINDOW - SEED + 1, seeds, 1
    while 2 * wide <= span:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    least = np.minimum(least[: total - WINDOW + 1], least[span - wide :][: total - WINDOW + 1])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    inside = owner[: total - WINDOW + 1] == owner[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    sizes = np.diff(first, append=len(at))
    parts = (sizes + PATH - 1) // PATH
    if (parts > 1).any():
        offset = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, left = np.repeat(first, parts) + offset * PATH, np.repeat(sizes, parts) - offset * PATH
        sizes = np.minimum(left, PATH)
    starts = at[first]
    hashes = rolling.runs(starts, sizes + WINDOW - 1)
    begins = np.concatenate([[0], ends[:-1]])[owner[starts]]
    signed = lambda x: x.view(np.int64)
    return owner[starts], starts - begins, sizes, signed(least[starts]), signed(hashes[0]), signed(hashes[1])


def windows(text: bytes, spans: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """The windows of the spans of a text: (start word, hash 1, hash 2)."""
    words, _ = word_hashes([text])
    starts = np.concatenate([np.arange(a, a + n) for a, n in spans]).astype(np.int64)
    hashes = Rolling(words).runs(starts, WINDOW)
    return starts, hashes[0].view(np.int64), hashes[1].view(np.int64)


def rank(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(LAST))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, key, text): the id's rank and a hash of the text name a row; equal rows may share a name."""
    text = F.coalesce(column(docs, "text"), F.lit(""))
    return docs.select(rank(column(docs, "doc_id")).alias("doc"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))


def find_repeats(docs: DataFrame) -> DataFrame:
    """(doc, key, spans): runs of repeated windows, as (first window, windows), of documents that have any."""
    short_batches(docs.sparkSession)
    keyed = _keyed(docs)

    def run_paths(batches):
        for batch in batches:
            owner, *rest = paths(batch.column(2).to_pylist())
            of = pa.array(owner, pa.int64())
            names = ["doc", "key", "start", "n", "bucket", "a", "b"]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            made = [pa.array(r, k) for r, k in zip(rest, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *made], names)

    found = stored(keyed.mapInArrow(run_paths, "doc bigint, key bigint, start int, n int, bucket bigint, a bigint, b bigint"))
    # Equal paths collapse; a bucket with two different ones branches.
    distinct = stored(found.groupBy("a", "b", "bucket").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
    branching = (
        distinct.groupBy("bucket")
        .agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high"))
        .where(F.col("low") != F.col("high"))
        .select("bucket")
    )
    marked = distinct.join(branching.withColumn("branches", F.lit(True)), "bucket", "left").select(
        "a", "b", "first", F.coalesce("branches", F.lit(False)).alias("branches"), "last"
    )
    marked = marked.where(F.col("branches") | (F.col("first") < F.col("last"))).drop("last")
    placed = stored(found.join(marked, ["a", "b"]).select("doc", "key", "start", "n", "first", "branches"))
    whole = placed.where(F.col("first") < F.col("doc")).select("doc", "key", "start", "n")
    opened = (
        placed.where((F.col("first") == F.col("doc")) & F.col("branches"))
        .groupBy("doc", "key")
        .agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    )

    def run_windows(batches):
        for batch in batches:
            docs_, keys, texts, spans = (c.to_pylist() for c in batch.columns)
            for doc, key, text, parts in zip(docs_, keys, texts, spans, strict=True):
                starts, a, b = windows(text, [(p["start"], p["n"]) for p in parts])
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, doc), pa.int64()), pa.array(np.full(n, key), pa.int64()), pa.array(starts, pa.int32())]
                    + [pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                    ["doc", "key", "start", "a", "b"],
                )

    texts = keyed.join(opened, ["doc", "key"]).dropDuplicates(["doc", "key"]).select("doc", "key", "text", "spans")
    single = stored(texts.mapInArrow(run_windows, "doc bigint, key bigint, start int, a bigint, b bigint"))
    shared = single.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    single = single.join(shared, ["a", "b"]).where(F.col("first") < F.col("doc")).select("doc", "key", "start", F.lit(1).alias("n"))
    return whole.unionByName(single).groupBy("doc", "key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))


def covered(n_words: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which words the windows of the spans cover."""
    change = np.zeros(n_words + 1, np.int64)
    for start, n in spans:
        change[start] += 1
        change[start + n - 1 + WINDOW] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with the spans found, null where there are none: (frame, name of spans, name of the text as bytes)."""
    spans, doc, key, text = free_names(docs, ["spans", "doc", "key", "raw"])
    found = find_repeats(docs).withColumnsRenamed({"doc": doc, "key": key, "spans": spans})
    whole = F.coalesce(column(docs, "text"), F.lit(""))
    same = (rank(column(docs, "doc_id")) == F.col(doc)) & (F.xxhash64(whole) == F.col(key))
    return docs.join(found, same, "left").drop(doc, key).withColumn(text, whole.cast("binary")), spans, text


def _kept(text: bytes, spans: list | None) -> tuple[list[bytes], int]:
    words = text.split()
    if not spans:
        return words, 0
    gone = covered(len(words), [(s["start"], s["n"]) for s in spans])
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum())


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents as they came, ``text`` without its repeated words (joined by one space); others unchanged."""
    short_batches(docs.sparkSession)
    frame, spans, raw = _with_spans(docs)
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for batch in batches:
            held = batch.column("text").to_pylist()
            for i, (text, parts) in enumerate(zip(batch.column(raw).to_pylist(), batch.column(spans).to_pylist(), strict=True)):
                if parts:
                    held[i] = b" ".join(_kept(text, parts)[0]).decode()
            columns = list(batch.drop_columns([spans, raw]).columns)
            columns[place] = pa.array(held, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return frame.mapInArrow(run, docs.schema)


def op5_substring_dedup(spark, folder: str) -> DataFrame:
    short_batches(spark)
    docs = documents(spark, folder).select("doc_id", "text")
    frame, spans, raw = _with_spans(docs)

    def run(batches):
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, gone = _kept(text, parts)
                rows.append((len(kept) + gone, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return frame.select("doc_id", raw, spans).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
