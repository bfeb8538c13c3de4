"""Hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

from tonetape.llm.pretokens import Recent

BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64) | np.uint64(1)



@cache
def _hashes() -> Recent:
    return Recent(lambda words: [xxhash.xxh3_128_digest(w) for w in words])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(2, words) hashes of all words of all texts, and where each text ends."""
    words = [t.split() for t in texts]  # bytes are split at ASCII white space alone
    flat = [w for ws in words for w in ws]
    raw = np.frombuffer(b"".join(_hashes().values(flat)), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(raw.T), np.cumsum([len(w) for w in words])


class Rolling:
    """128-bit polynomial hashes of word runs, from sums of prefixes modulo 2^64 in two bases."""

    def __init__(self, words: np.ndarray) -> None:
        n = words.shape[1]
        # sum of words[i] * base^i; a run is compared after shifting by the inverse power of its start.
        self.up = np.stack([_series(int(b), n) for b in BASES])
        self.down = np.stack([_series(pow(int(b), -1, 1 << 64), n) for b in BASES])
        self.sums = np.zeros((2, n + 1), np.uint64)
        np.cumsum(words * self.up[:, :n], axis=1, out=self.sums[:, 1:])

    def runs(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """(2, runs) hashes."""
        return (self.sums[:, starts + lengths] - self.sums[:, starts]) * self.down[:, starts]


@cache
def _room() -> dict:
    return {}


def _series(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... (n + 1 of them), kept as long as the longest asked for."""
    held = _room().get(base)
    if held is None or len(held) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        held = np.ones(size, np.uint64)
        done = 1
        while done < size:
            held[done : 2 * done] = held[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _room()[base] = held
    return held[: n + 1]


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(27))
