"""Pre-tokens of byte-level vocabularies, and the ranks of their files.

A text is cut before every single space that something other than white space follows: the published
pattern starts a new match at each of those places, so the pieces can be looked up one by one and only
new pieces are matched. Texts with other runs of spaces are matched whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterable
from functools import cache
from itertools import accumulate

import public_tokenizers
import regex

#: Entries of one generation of a worker's cache; two generations are held.
CACHE_ENTRIES = 400_000


@cache
def matcher():
    return regex.compile(public_tokenizers.PATTERN)


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Recent:
    """A bounded cache: when the young generation is full it becomes the old one, which is let go."""

    def __init__(self, make: Callable[[list], list], entries: int = CACHE_ENTRIES) -> None:
        self.make, self.entries, self.young, self.old = make, entries, {}, {}

    def values(self, keys: list) -> list:
        """The value of every key; ``make`` gets the distinct ones that aren't held."""
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        if None not in found:
            return found
        gone = [i for i, v in enumerate(found) if v is None]
        new = []
        for key in {keys[i] for i in gone}:
            if (value := old.get(key)) is None:
                new.append(key)
            else:
                young[key] = value
        if new:
            young.update(zip(new, self.make(new), strict=True))
        for i in gone:
            found[i] = young[keys[i]]
        return found


class Pieces:
    """What ``of_pretokens`` makes of each pre-token, put together per text by ``join``.

    ``of_pretokens`` takes a list of distinct pre-tokens and returns a value for each, never None.
    """

    def __init__(self, of_pretokens: Callable[[list[str]], list], join: Callable[[list], object]) -> None:
        self.join = join
        self.pretokens, self.pieces = Recent(of_pretokens), Recent(self._of_pieces)

    def _of_pieces(self, pieces: list[str]) -> list:
        cut = list(map(_pretokens, pieces))
        return self._joined(self.pretokens.values([t for ts in cut for t in ts]), map(len, cut))

    def _joined(self, values: list, lengths: Iterable[int]) -> list:
        join, ends = self.join, list(accumulate(lengths))
        return [join(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def texts(self, texts: list[str]) -> list:
        """Per text its joined value.

        A piece is looked up without its leading space; the first of a text, which has none, is marked
        by a space at its end, as no other piece has one.
        """
        out, at, lengths, flat = [None] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if _RUN(text) is None:
                pieces = text.split(" ")
                pieces[0] += " "
                flat += pieces
                at.append(i)
                lengths.append(len(pieces))
            else:
                out[i] = self.join(self.pretokens.values(matcher().findall(text)))
        for i, value in zip(at, self._joined(self.pieces.values(flat), lengths), strict=True):
            out[i] = value
        return out


#: A space that white space or the end follows; \s of this module is wider than the pattern's, which is safe here.
_RUN = re.compile(r" (?:\s|\Z)").search


def _pretokens(piece: str) -> list[str]:
    """The matches of a piece; a word, or a word and one sign, needs no matching."""
    if piece[-1:] == " ":
        return matcher().findall(piece[:-1])
    if piece.isalpha():
        return [" " + piece]
    if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
        return [" " + piece[:-1], piece[-1]]
    return matcher().findall(" " + piece)
