"""Byte-level BPE encoding and decoding with the ranks of a published vocabulary.

Distinct pre-tokens of a batch are put into padded matrices of token ids, one per length class. In each
round every row merges its leftmost pair of minimum rank, then the row is compacted by one place; rows
without a pair that can merge leave the matrix. Ranks of pairs come from an open-addressing hash table
in numpy arrays. Pre-tokens longer than ``LONG`` bytes merge through a heap of (rank, place), which
yields the same leftmost-minimum order at n log n. Spark deals out the texts; each row is encoded alone
from its whole text, so nothing is shuffled.

Defined results: a null text counts as empty and has no tokens; ids decode to the UTF-8 bytes of the
text exactly, however long; rows that repeat are encoded alike; a null doc_id stays null; an empty table gives
an empty result; extra columns are carried along.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tonetape.llm.pretokens import Pieces, ranks
from tonetape.llm.shared import column, documents, free_names, short_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of a pre-token from which the heap is used, and rows of a matrix.
LONG = 256
ROWS = 8192
NONE = np.int64(1 << 40)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class PairTable:
    """Rank of the token that two adjacent tokens make; linear probing in a power-of-two table."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in vocabulary.items():
            for i in range(1, len(token)):
                a, b = vocabulary.get(token[:i]), vocabulary.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        bits = max(4, (2 * len(pairs)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, EMPTY, np.uint64)
        self.ranks = np.full(1 << bits, NONE, np.int64)
        keys = np.fromiter(pairs, np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int64, len(pairs))
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] == EMPTY
            _, first = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[placed], values[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they make no token."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slots = self._slots(keys)
        found = self.keys[slots]
        ranks = np.where(found == keys, self.ranks[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != EMPTY))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            ranks[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != EMPTY)]
        return ranks


class Encoder:
    def __init__(self, path: str) -> None:
        self.vocabulary = ranks(path)
        self.table = PairTable(self.vocabulary)
        self.bytes_of = np.array([self.vocabulary[bytes([b])] for b in range(256)], np.int64)
        self.tokens = [b""] * (max(self.vocabulary.values()) + 1)
        for token, rank in self.vocabulary.items():
            self.tokens[rank] = token
        self.pieces = Pieces(self.encode_pretokens, b"".join)

    def encode_pretokens(self, pretokens: list[str]) -> list[bytes]:
        """Ids of each pre-token as little-endian 32-bit integers."""
        raw = [p.encode() for p in pretokens]
        out: list[bytes] = [b""] * len(raw)
        classes: dict[int, list[int]] = {}
        for i, piece in enumerate(raw):
            whole = self.vocabulary.get(piece)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = np.array(self.encode_long(piece), "<u4").tobytes()
            elif piece:
                classes.setdefault((len(piece) + 3) // 4, []).append(i)
        for places in classes.values():
            for start in range(0, len(places), ROWS):
                part = places[start : start + ROWS]
                for i, ids in zip(part, self.encode_matrix([raw[i] for i in part]), strict=True):
                    out[i] = ids
        return out

    def encode_matrix(self, raw: list[bytes]) -> list[bytes]:
        """Merge rows of about one length: one pair per row and round."""
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(lengths.max())
        ids = np.full((len(raw), width), -1, np.int64)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.bytes_of[np.frombuffer(b"".join(raw), np.uint8)]
        pair = np.full((len(raw), width), NONE, np.int64)
        both = inside[:, 1:]
        pair[:, :-1][both] = self.table.look_up(ids[:, :-1][both], ids[:, 1:][both])
        result = np.full((len(raw), width), -1, np.int64)
        rows = np.arange(len(raw))
        while True:
            at = pair.argmin(axis=1)
            best = pair[np.arange(len(rows)), at]
            live = best < NONE
            if not live.all():
                result[rows[~live], : ids.shape[1]] = ids[~live]
                rows, ids, pair, at, best = rows[live], ids[live], pair[live], at[live], best[live]
                if not len(rows):
                    break
            # The merged token takes the pair's left place; what follows moves up by one.
            n, last = np.arange(len(rows)), ids.shape[1] - 1
            move = np.arange(last) > at[:, None]
            ids[n, at] = best
            ids[:, :-1] = np.where(move, ids[:, 1:], ids[:, :-1])
            pair[:, :-1] = np.where(move, pair[:, 1:], pair[:, :-1])
            ids, pair = ids[:, :last], pair[:, :last]
            pair[:, -1] = NONE
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < last)
                ok[ok] = ids[n[ok], left[ok] + 1] >= 0
                i, j = n[ok], left[ok]
                pair[i, j] = self.table.look_up(ids[i, j], ids[i, j + 1])
                end = (left >= 0) & ~ok & (left < last)
                pair[n[end], left[end]] = NONE
        kept = result >= 0
        counts = kept.sum(axis=1)
        flat = result[kept].astype("<u4").tobytes()
        ends = np.cumsum(counts) * 4
        return [flat[e - c * 4 : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]

    def encode_long(self, piece: bytes) -> list[int]:
        """The same merges for a long run of bytes: a heap of (rank, place) over a linked list."""
        ids = self.bytes_of[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs = len(ids), self.table.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n:
                    r = pairs.get(ids[left] << 32 | ids[after[left]])
                    if r is not None:
                        heapq.heappush(heap, (r, left))
        return [t for t in ids if t >= 0]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.pieces.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def encoder(path: str) -> Encoder:
    """One per worker process."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the tokens of the whole text as little-endian unsigned 32-bit integers."""
    return _with_binary(docs, column(docs, text, "string"), ids, lambda: encoder(path).encode)


def decode(docs: DataFrame, path: str, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """Adds ``raw``: the bytes of the tokens in ``ids``."""

    def make():
        one = encoder(path).decode
        return lambda rows: [one(r or b"") for r in rows]

    return _with_binary(docs, F.col(ids), raw, make)


def _with_binary(docs: DataFrame, source, name: str, make) -> DataFrame:
    short_batches(docs.sparkSession)
    (given,) = free_names(docs, ["given"])
    frame = docs.withColumn(given, F.coalesce(source, F.lit("").cast(source_kind(docs, source))))
    schema = StructType([*docs.schema.fields, StructField(name, pa_binary(), True)])

    def run(batches):
        for batch in batches:
            made = make()(batch.column(given).to_pylist())
            rest = batch.drop_columns([given])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(made, pa.binary())], [*rest.schema.names, name])

    return frame.mapInArrow(run, schema)


def source_kind(docs: DataFrame, source) -> str:
    return docs.select(source.alias("x")).schema["x"].dataType.simpleString()


def pa_binary():
    from pyspark.sql.types import BinaryType

    return BinaryType()


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, and the sha256 of its ids and of what they decode to."""
    short_batches(docs.sparkSession)
    frame = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            ids = coder.encode(batch.column("text").to_pylist())
            raw = map(coder.decode, ids)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return frame.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return digests(documents(spark, folder), public_tokenizers.path(vocabulary))
