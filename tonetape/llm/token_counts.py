"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The tokens of a published byte-level vocabulary get the log-probabilities of Zipf's law by rank, in
whole numbers, so sums are exact. The forward score of a prefix is the best sum over all ways to cut it
into tokens; of equal sums the one with fewer tokens counts. The distinct pre-tokens of a batch, in
byte order, are the depth-first walk of their trie: a prefix that a pre-token shares with the one before
keeps its scores, and only the new nodes are computed, each once. At the end of a pre-token its number of
tokens is stored, and a document's count is the sum over its pre-tokens. Spark deals out whole texts;
nothing is shuffled.

Defined results: a null or empty text has no tokens; every byte is a token, so every text has a count;
repeated rows are counted alike; a null doc_id stays null; texts are counted whole, however long; an empty
table gives an empty result; extra columns aren't looked at.
"""

from __future__ import annotations

import math
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonetape.llm.pretokens import Pieces, ranks
from tonetape.llm.shared import column, documents, short_batches

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Scores are multiples of one millionth; below them stands the number of tokens.
SCALE = 1_000_000
COUNT_BITS = 40


class Unigram:
    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        # Cost of a token: its score above, one token below; the least sum is the best score, then the fewest tokens.
        self.cost = {t: (round(SCALE * math.log(r + 1)) << COUNT_BITS) + 1 for t, r in vocabulary.items()}
        sizes: dict[bytes, set[int]] = {}
        for token in vocabulary:
            sizes.setdefault(token[-2:], set()).add(len(token))
        #: Lengths of tokens that end in two given bytes.
        self.sizes = {k: sorted(v) for k, v in sizes.items()}
        self.pieces = Pieces(self.count_pretokens, sum)

    def count_pretokens(self, pretokens: list[str]) -> list[int]:
        """Tokens of each pre-token: one walk over the trie of all of them."""
        raw = [p.encode() for p in pretokens]
        out, mask = [0] * len(raw), (1 << COUNT_BITS) - 1
        best, before = [0], b""
        for i in sorted(range(len(raw)), key=raw.__getitem__):
            word = raw[i]
            shared = _shared(before, word)
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best.append(self._step(word, end, best))
            out[i] = best[-1] & mask
            before = word
        return out

    def _step(self, word: bytes, end: int, best: list[int]) -> int:
        cost = self.cost
        least = best[end - 1] + cost[word[end - 1 : end]]
        for size in self.sizes.get(word[max(0, end - 2) : end], ()):
            if size > end:
                break
            if size > 1 and (step := cost.get(word[end - size : end])) is not None:
                least = min(least, best[end - size] + step)
        return least


def _shared(a: bytes, b: bytes) -> int:
    """Length of the prefix that two strings share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


@cache
def unigram(path: str) -> Unigram:
    """One per worker process."""
    return Unigram(ranks(path))


def count(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_chars, n_tokens."""
    short_batches(docs.sparkSession)
    text = F.coalesce(column(docs, "text"), F.lit(""))
    frame = docs.select(column(docs, "doc_id").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), text.alias("text"))

    def run(batches):
        for batch in batches:
            counts = unigram(path).pieces.texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return frame.mapInArrow(run, "doc_id bigint, n_chars bigint, n_tokens bigint")


def op2_token_counts(spark, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return count(documents(spark, folder), public_tokenizers.path(vocabulary))
