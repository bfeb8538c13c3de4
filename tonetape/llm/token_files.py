"""Token-id files: concatenated ids in blocks, with Elias-Fano coded document ends.

A dataset is a folder of Parquet files, which every store that Spark writes to can hold. A row is a
block: the ids of consecutive documents as little-endian integers (16 bits where the vocabulary allows,
else 32) and their ends as a monotone sequence in Elias-Fano form. For n documents and u ids the low
``l = floor(log2(u / n))`` bits of each end are packed, and the high parts are a unary bit vector in
which the i-th one bit stands at ``high(i) + i``: about ``2 + log2(u / n)`` bits a document and no table
of 64-bit offsets. ``select`` finds a one bit from a directory of one count per 512 bits.

Documents are dealt to partitions by range of their id and written in ascending order; a block is closed
at ``BLOCK_IDS`` ids. What lies before a block is summed from the blocks of earlier partitions (one row
per partition) and the earlier blocks of its own, so no list of documents goes through one task.

Defined results: a null text counts as empty and has the end id alone; a null doc_id comes first; rows
with one id are ordered by their text; the string of a special token gives its id, as in the library; texts
are taken whole, however long; an empty table gives an empty dataset; other columns are left aside whatever
their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonetape.llm.pretokens import Recent
from tonetape.llm.shared import column, documents, partitions, short_batches
from tonetape.session import shared_folder

VOCABULARY = "word_bpe_49k.json"
END = 1
BLOCK_IDS = 1 << 18
#: Bits covered by one entry of the select directory.
STRIDE = 512
BLOCKS = (
    "part int, block int, n_docs int, n_ids bigint, width int, ids binary, low_bits int, low binary, high binary, "
    "high_bits bigint, ranks binary, doc_ids array<bigint>"
)


# --- Elias-Fano -----------------------------------------------------------------------------------


def pack(values: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` of each value, one after the other, lowest bit first."""
    if not bits:
        return b""
    each = (values[:, None] >> np.arange(bits)) & 1
    return np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, places: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(places), np.int64)
    data = np.frombuffer(raw, np.uint8)
    at = places[:, None] * bits + np.arange(bits)
    return (((data[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(bits)).sum(axis=1)


class Ends:
    """A monotone sequence in Elias-Fano form."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, high_bits: int, ranks: bytes, n: int) -> None:
        self.low_bits, self.low, self.high, self.high_bits, self.n = low_bits, low, high, high_bits, n
        self.ranks = np.frombuffer(ranks, "<u4")

    @classmethod
    def of(cls, ends: np.ndarray) -> Ends:
        n, universe = len(ends), int(ends[-1]) if len(ends) else 0
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        size = (universe >> bits) + n + 1
        flags = np.zeros(size, np.uint8)
        flags[(ends >> bits) + np.arange(n)] = 1
        counts = np.add.reduceat(flags, np.arange(0, size, STRIDE), dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4").tobytes()
        return cls(bits, pack(ends, bits), np.packbits(flags, bitorder="little").tobytes(), size, ranks, n)

    def select(self, places: np.ndarray) -> np.ndarray:
        """The values at the given places: the directory names the stretch, counting within it the bit."""
        places = np.asarray(places, np.int64)
        if not len(places):
            return np.zeros(0, np.int64)
        stretch = np.searchsorted(self.ranks, places, side="right") - 1
        high = np.zeros(len(places), np.int64)
        for s in np.unique(stretch):
            mine = stretch == s
            part = np.frombuffer(self.high, np.uint8)[s * STRIDE // 8 : (s + 1) * STRIDE // 8]
            ones = np.flatnonzero(np.unpackbits(part, bitorder="little"))
            high[mine] = s * STRIDE + ones[places[mine] - int(self.ranks[s])] - places[mine]
        return high << self.low_bits | unpack(self.low, self.low_bits, places)

    def all(self) -> np.ndarray:
        return self.select(np.arange(self.n))


# --- Tokens ---------------------------------------------------------------------------------------


class Tokens:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's pipeline drops white space and looks at nothing beyond it, so the ids of a text are
    those of its words one after the other, and each distinct word is encoded once per worker. A word of
    plain letters, digits and signs is put into lower case, cut by the pattern of the file and handed to
    the library's model; any other word, such as one that holds the string of a special token, goes through
    the library's whole pipeline. Words are told apart and looked up per batch in Arrow's own tables; only
    the distinct ones of a batch become Python strings.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        split = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.wide = np.dtype("<u2") if self.library.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.letters = _byte_letters()
        self.code = "H" if self.wide.itemsize == 2 else "I"
        #: Latin letters that keep their place under normal form C, ASCII digits and signs.
        self.plain = re.compile("[!-~¡-¬®-įĲ-ž]+").fullmatch
        #: Strings that the library takes as one id wherever they stand.
        self.special = re.compile("|".join(re.escape(t["content"]) for t in rules["added_tokens"]) or "(?!)").search
        self.words = Recent(self._of_words)

    def _ids(self, part: str) -> bytes:
        """Ids of a cut and lower-case part by the library's model."""
        shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _of_words(self, words: list[str]) -> list[bytes]:
        out, ids = [], self._ids
        for word in words:
            if word.isascii() and word.isalpha():
                out.append(ids(word.lower()))
            elif self.plain(word) and "İ" not in word and not self.special(word):
                word = unicodedata.normalize("NFC", word).lower()
                out.append(ids(word) if word.isalpha() else b"".join(map(ids, self.pattern.findall(word))))
            else:
                out.append(array(self.code, self.library.encode(word, add_special_tokens=False).ids).tobytes())
        return out

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts, one after the other, and how many each text has."""
        # Lower case and a blank before a last sign make words alike and change no id, but where a special
        # string counts by its case, or a mark joins another letter in lower case.
        alike = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,;:!?])(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, r"<\||[\x{0300}-\x{036f}]"), texts, alike))
        coded = split.flatten().dictionary_encode()
        values = self.words.values(coded.dictionary.to_pylist())
        table = np.frombuffer(b"".join(values), self.wide)
        lengths = np.fromiter(map(len, values), np.int32, len(values)) // self.wide.itemsize
        starts, which = np.cumsum(lengths, dtype=np.int32) - lengths, coded.indices.to_numpy()
        sizes = lengths[which]
        ends = np.cumsum(sizes, dtype=np.int32)
        # Where each word's ids stand in the table, for every id.
        place = np.repeat(starts[which] - (ends - sizes), sizes)
        place += np.arange(len(place), dtype=np.int32)
        last = np.cumsum(pc.list_value_length(split).to_numpy())
        return table[place], np.diff(np.concatenate([[0], ends])[last], prepend=0)


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


@cache
def tokens(path: str) -> Tokens:
    """One per worker process."""
    return Tokens(path)


# --- Files ----------------------------------------------------------------------------------------


def write(docs: DataFrame, folder: str, path: str, end: int = END, n_parts: int | None = None) -> None:
    """Encode every whole text and write the blocks in ascending order of doc_id."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(
        column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text")
    )
    rows = rows.repartitionByRange(n_parts or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(path)
        part, block, held, sizes, doc_ids, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            return _block(part, block, coder.wide, np.concatenate(held), np.cumsum(sizes), doc_ids)

        for batch in batches:
            ids, counts = coder.encode(batch.column(1))
            names, first, last = batch.column(0).to_pylist(), np.cumsum(counts) - counts, np.cumsum(counts)
            # Each text's ids are followed by the end.
            ended = np.insert(ids, last, end)
            first, last = first + np.arange(len(first)), last + np.arange(1, len(last) + 1)
            at = 0
            while at < len(names):
                room = np.searchsorted(last, first[at] + BLOCK_IDS - total)
                stop = min(int(room) + 1, len(names))
                held.append(ended[first[at] : last[stop - 1]])
                sizes += (last - first)[at:stop].tolist()
                doc_ids += names[at:stop]
                total, at = total + len(held[-1]), stop
                if total >= BLOCK_IDS:
                    yield closed()
                    block, held, sizes, doc_ids, total = block + 1, [], [], [], 0
        if sizes:
            yield closed()

    rows.mapInArrow(run, BLOCKS).write.parquet(folder)


def _block(part: int, block: int, wide: np.dtype, ids: np.ndarray, ends: np.ndarray, doc_ids: list) -> pa.RecordBatch:
    coded = Ends.of(ends)
    row = [part, block, len(ends), int(ends[-1]), wide.itemsize, ids.astype(wide).tobytes(), coded.low_bits, coded.low, coded.high]
    row += [coded.high_bits, coded.ranks.tobytes(), doc_ids]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
    kinds += [pa.int64(), pa.binary(), pa.list_(pa.int64())]
    names = [field.split()[0] for field in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``start``: the ids before each, from the counts of earlier partitions and blocks."""
    found = spark.read.schema(BLOCKS).parquet(folder)
    sizes = found.select("part", "block", "n_ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(per_part.select("part", "base"), "part")
        .select("part", "block", (F.col("base") + F.col("inner")).alias("start"))
    )
    return found.join(starts, ["part", "block"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, and ids as little-endian unsigned 32-bit integers."""
    return _unfold(blocks(spark, folder), "ids binary", lambda raw: raw, pa.binary())


def _unfold(found: DataFrame, made: str, of, kind: pa.DataType) -> DataFrame:
    """Documents from blocks, with one value computed from the 32-bit ids of each."""
    found.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                coded = Ends(row["low_bits"], row["low"], row["high"], row["high_bits"], row["ranks"], row["n_docs"])
                ends = coded.all()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                values = [of(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["start"], pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(values, kind),
                    ],
                    ["doc_id", "start", "n_tokens", made.split()[0]],
                )

    return found.mapInArrow(run, f"doc_id bigint, start bigint, n_tokens bigint, {made}")


def op4_token_files(spark, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    target = shared_folder(spark)
    write(documents(spark, folder), target, public_tokenizers.path(vocabulary))
    return _unfold(blocks(spark, target), "ids_crc32 bigint", zlib.crc32, pa.int64())
