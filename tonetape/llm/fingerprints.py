"""Document fingerprints: invertible Bloom lookup sketches over paragraph digests.

A paragraph is a line, cut at ends of sentences, and a sentence of many words behind words whose hash says
so: that doesn't depend on what stands elsewhere, so an edit changes only the pieces it touches.
Every piece has a 64-bit digest of its text and of how many times it stood before in the document. A
sketch has ``CELLS`` cells in three thirds; each digest is added to one cell of each third: count, xor of
digests, xor of check sums. The sketches of two versions are subtracted cell by cell; what both have
cancels, and peeling cells that hold a single digest recovers those that differ. If peeling gets stuck,
both versions are sketched again with four times the cells. The likeness of two documents is the number
of shared digests over the number of different ones, 1 for equal texts.

Documents are dealt out by ranges of their id and stand in order there, so each one's successor is the
next row; the first document of a range also goes to the end of the range before it. Nothing but the
range bounds, one per partition, goes to the driver.

Defined results: a null text counts as empty; an empty text has no piece, and two documents without
pieces are alike (1); rows with one doc_id are ordered by their text; a null doc_id comes last; an only
document is its own successor; texts are taken whole, however long; an empty table gives an empty result; extra
columns aren't looked at. Digests that can't come apart at 64 times the cells that their number asks for, as
they share all their cells, are compared as sets; the answer is the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetape.llm.shared import column, documents, partitions, short_batches

#: Documents that are sketched together.
CHUNK = 128
CELLS = 24
GROWTH = 4
#: Words of a line part from which it is cut behind chosen words, one in so many.
LONG_PART = 48
CUT_ONE_IN = 16
SENTENCE = re.compile(rb"(?<=[.!?])[\x20\t]+")


def pieces(text: str) -> list[bytes]:
    """Sentences of the lines; one of many words is cut behind chosen words."""
    out = []
    for line in text.encode().split(b"\n"):
        for part in SENTENCE.split(line):
            if part.count(b" ") <= LONG_PART:
                if part and not part.isspace():
                    out.append(part)
                continue
            kept = []
            for word in part.split():
                kept.append(word)
                if not xxhash.xxh32_intdigest(word) % CUT_ONE_IN:
                    out.append(b" ".join(kept))
                    kept = []
            if kept:
                out.append(b" ".join(kept))
    return out


def digests(text: str) -> list[int]:
    """One 64-bit digest per piece; a piece that comes again gets another."""
    found, seen = [], {}
    for piece in pieces(text):
        number = seen[piece] = seen.get(piece, 0) + 1
        found.append(xxhash.xxh64_intdigest(piece + b"\n%d" % number))
    return found


def _check(keys: np.ndarray) -> np.ndarray:
    return ((keys ^ np.uint64(0x5BD1E9955BD1E995)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def _cells(keys: np.ndarray, third: int) -> list[np.ndarray]:
    """The cell of each key in the first, second and last third."""
    part = lambda shift: ((keys >> np.uint64(shift)) % np.uint64(third)).astype(np.int64)
    return [part(0), third + part(21), 2 * third + part(42)]


class Sketches:
    """Sketches of many documents: rows of cells (count, xor of digests, xor of check sums)."""

    def __init__(self, counts: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> None:
        self.counts, self.keys, self.checks = counts, keys, checks

    @classmethod
    def of(cls, found: list[list[int]], cells: int = CELLS) -> Sketches:
        third, n = max(1, cells // 3), len(found)
        keys = np.fromiter((k for ks in found for k in ks), np.uint64, sum(map(len, found)))
        made = cls(*(np.zeros((n, 3 * third), kind) for kind in (np.int64, np.uint64, np.uint64)))
        made._put(np.repeat(np.arange(n), [len(ks) for ks in found]), keys, np.ones(len(keys), np.int64))
        return made

    def _put(self, rows: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
        width, checks = self.counts.shape[1], _check(keys)
        counts, xors, sums = self.counts.reshape(-1), self.keys.reshape(-1), self.checks.reshape(-1)
        for cells in _cells(keys, width // 3):
            at = rows * width + cells
            np.add.at(counts, at, signs)
            np.bitwise_xor.at(xors, at, keys)
            np.bitwise_xor.at(sums, at, checks)

    def minus(self, mine: np.ndarray, theirs: np.ndarray) -> Sketches:
        """The difference of the rows ``mine`` and ``theirs``, pair by pair."""
        return Sketches(
            self.counts[mine] - self.counts[theirs], self.keys[mine] ^ self.keys[theirs], self.checks[mine] ^ self.checks[theirs]
        )

    def peel(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Which rows are taken apart wholly, and the (rows, digests, signs) recovered; empties the cells.

        A digest has one cell in each third, so the single cells of one third are distinct digests.
        """
        third, found, idle, turn = self.counts.shape[1] // 3, [], 0, 0
        while idle < 3:
            part = slice(turn * third, (turn + 1) * third)
            counts, keys = self.counts[:, part], self.keys[:, part]
            rows, cells = np.nonzero((np.abs(counts) == 1) & (_check(keys) == self.checks[:, part]))
            if len(rows):
                single, signs = keys[rows, cells], counts[rows, cells]
                found.append((rows, single, signs))
                self._put(rows, single, -signs)
                idle = 0
            else:
                idle += 1
            turn = (turn + 1) % 3
        return ~(self.counts.any(axis=1) | self.keys.any(axis=1)), found

    def texts(self, sizes: list[int]) -> list[str]:
        """The number of pieces and the cells, as strings."""
        wide = np.concatenate([self.counts.astype(">u8"), self.keys.astype(">u8"), self.checks.astype(">u8")], axis=1)
        return [f"{n:x}:{row.tobytes().hex()}" for n, row in zip(sizes, wide, strict=True)]


def differences(found: list[list[int]], pairs: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """For each pair of documents the digests that only the first and only the second has.

    Pairs whose difference doesn't come apart are sketched again with more cells.
    """
    out: list = [([], []) for _ in pairs]
    todo, cells = list(range(len(pairs))), CELLS
    while todo:
        # Digests that share all their cells at any size would never come apart; such a pair is compared outright.
        for p in [p for p in todo if cells > 64 * (CELLS + sum(len(found[i]) for i in pairs[p]))]:
            a, b = (set(found[i]) for i in pairs[p])
            out[p] = (sorted(a - b), sorted(b - a))
            todo.remove(p)
        if not todo:
            break
        used = sorted({i for p in todo for i in pairs[p]})
        at = {i: k for k, i in enumerate(used)}
        sketches = Sketches.of([found[i] for i in used], cells)
        mine, theirs = (np.array([at[pairs[p][side]] for p in todo]) for side in (0, 1))
        done, parts = sketches.minus(mine, theirs).peel()
        for rows, keys, signs in parts:
            good = done[rows]
            for row, key, sign in zip(rows[good].tolist(), keys[good].tolist(), signs[good].tolist(), strict=True):
                out[todo[row]][0 if sign > 0 else 1].append(key)
        todo = [p for p, ok in zip(todo, done.tolist(), strict=True) if not ok]
        cells *= GROWTH
    return out


def likenesses(found: list[list[int]], pairs: list[tuple[int, int]]) -> list[float]:
    """Shared digests over different ones, per pair."""
    out = []
    for (a, _), (mine, theirs) in zip(pairs, differences(found, pairs), strict=True):
        both = len(found[a]) - len(mine)
        union = both + len(mine) + len(theirs)
        out.append(both / union if union else 1.0)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, n_parts: int) -> DataFrame:
    """(range, ghost, doc_id, text): every range in descending order, its successor last.

    Bounds are quantiles of the ids. The first id of every range that has rows is looked up, and the
    rows with it are also put at the end of the range before, around the ring.
    """
    frame = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    cuts = [i / n_parts for i in range(1, n_parts)] or [0.5]
    bounds = frame.agg(F.percentile_approx("doc_id", cuts, 10_000).alias("b")).first()["b"] or []
    bounds = sorted({b for b in bounds if b is not None}, reverse=True)
    place = F.lit(0)
    if bounds:
        among = F.array(*[F.lit(b).cast("long") for b in bounds])
        place = F.size(F.filter(among, lambda b: F.col("doc_id") <= b))
    place = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(place)
    frame = frame.withColumn("range", place.cast("int"))
    firsts = frame.groupBy("range").agg(F.max("doc_id").alias("first")).orderBy("range").collect()
    ring = {r["range"]: firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    if not ring:
        return frame.withColumn("ghost", F.lit(False))
    before = F.create_map(*[F.lit(x) for pair in ring.items() for x in pair])
    head = F.create_map(*[x for r in firsts for x in (F.lit(r["range"]), F.lit(r["first"]).cast("long"))])
    is_head = F.col("doc_id").eqNullSafe(F.element_at(head, F.col("range")))
    homes = F.when(
        is_head,
        F.array(
            F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost")),
            F.struct(F.element_at(before, F.col("range")).alias("range"), F.lit(True).alias("ghost")),
        ),
    ).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))))
    return frame.withColumn("home", F.explode(homes)).select("home.range", "home.ghost", "doc_id", "text")


def compare(docs: DataFrame, n_parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness; see ``op10_fingerprints``."""
    spark = docs.sparkSession
    short_batches(spark)
    n_parts = n_parts or partitions(spark)
    rows = in_order(docs, n_parts)
    rows = rows.repartitionByRange(n_parts, "range").sortWithinPartitions("range", "ghost", F.col("doc_id").desc_nulls_last(), "text")
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def chunk(rows: list[tuple]) -> pa.RecordBatch:
        """Rows of (range, ghost, doc_id, text); each but a ghost is followed by its successor."""
        first = [i for i, (a, b) in enumerate(pairwise(rows)) if not a[1] and a[0] == b[0]]
        texts = [r[3] for r in rows]
        new = [edited(texts[i], texts[i + 1]) for i in first]
        found = [digests(t) for t in texts + new]
        prints = Sketches.of(found).texts(list(map(len, found)))
        n = len(rows)
        near = likenesses(found, [(i, n + k) for k, i in enumerate(first)] + [(i, i + 1) for i in first])
        sums = [hashlib.sha256(t.encode()).hexdigest() for t in new]
        values = [
            [rows[i][2] for i in first],
            [len(texts[i]) for i in first],
            sums,
            [prints[i] for i in first],
            prints[n:],
            near[: len(first)],
            near[len(first) :],
        ]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for start in range(0, batch.num_rows, CHUNK):
                for row in zip(*(c[start : start + CHUNK] for c in columns), strict=True):
                    # Of several rows that share the successor's id, the first is the successor.
                    if not (held and held[-1][1] and row[0] == held[-1][0]):
                        held.append(row)
                yield chunk(held)
                held = held[-1:]

    return rows.mapInArrow(run, schema)


def op10_fingerprints(spark, folder: str) -> DataFrame:
    return compare(documents(spark, folder))
