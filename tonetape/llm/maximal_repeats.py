"""Removal of long byte strings that come again, by common-prefix interval trees of an enhanced suffix array.

A suffix array of every byte position would not fit any disk, so suffixes start at anchors: the leftmost
least hash of ``SEED`` bytes in each window of ``WINDOW`` bytes, which depends on the window's bytes alone.
Windows that are equal have their anchor at one place, so equal windows meet among the suffixes of one
seed. Neighbouring windows of one anchor form an extent; an extent is what is left of its anchor plus the
suffix right of it, as far as those windows reach. Some half a percent of the bytes become extents.

Equal extents collapse by a 128-bit hash, whatever the number of their copies. A seed with one distinct
extent is a tree of one leaf: all its occurrences are one group. Where a seed has several, one copy of each
is opened, and its bytes are scanned: the suffixes are sorted, common prefixes of neighbours computed, and a
stack scan lists the intervals of the common-prefix tree, children before parents. In each interval the
members are told apart by what stands left of the anchor: a second scan, over their left sides read
backwards, lists the groups that share all they can until their left neighbours differ. A group of enough
bytes that lies in one child interval only is the child's; any other is a maximal repeat with all its
occurrences, not only neighbours. A repeat that is longer than an extent is reported extent by extent.

A seed may have any number of distinct extents, as the edge of a passage that a third of all documents hold
in surroundings of their own. Seeds with more than ``GROUP`` of them are divided: extents are cut into slabs
of few neighbouring windows, and slabs meet by the hash of the bytes that all windows of the slab share.
Inside the passage the cuts are equal and collapse; at its edge the slabs grow narrower from step to step,
down to single windows, until each group is small. Nothing is capped, and each step costs the rows of the
groups that are still large.

Defined results: texts are compared as UTF-8 bytes; a null text is empty; texts shorter than a window stay;
an occurrence in the same document counts, overlapping ones too, as in a run of one letter; equal rows and
rows of one id are documents of their own, so both lose what they share; ids may be null and play no part;
texts of any length are worked on in blocks that overlap; an empty table gives an empty result; other
columns are carried along by ``remove_repeats`` whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonetape.llm.shared import column, documents, free_names, stored, text_key
from tonetape.llm.wordruns import mixed

WINDOW = 400
#: Bytes of an anchor: four words of eight.
SEED = 32
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Distinct extents that are scanned at once; more are divided into slabs of so many windows, step by step.
GROUP = 256
SLABS = (48, 6, 1)
#: Bytes that are hashed at once.
BLOCK = 1 << 20

Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def blocks(texts: Iterable[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts of at least a window as lists of (number, first byte, bytes) of some ``BLOCK`` bytes; long ones overlap."""
    held, size = [], 0
    for number, text in enumerate(texts):
        for start in range(0, len(text) - WINDOW + 1, BLOCK):
            part = text[start : start + BLOCK + WINDOW - 1]
            held.append((number, start, part))
            size += len(part)
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def extents(parts: list[bytes]) -> Found:
    """(part, start, windows, anchor, times) and (seed, hash, hash) of all extents of the parts, in order.

    Neighbouring extents of equal bytes, as in a run of one letter, are one row that stands ``times`` times.
    """
    whole = b"".join(parts)
    n, count, span = len(whole), len(whole) - WINDOW + 1, WINDOW - SEED + 1
    grams = mixed(np.ndarray((n - 7,), "<u8", whole, strides=(1,)) * FACTORS[0])
    seeds = np.zeros(n - SEED + 1, np.uint64)
    for i, factor in enumerate(FACTORS):
        seeds += grams[8 * i : 8 * i + len(seeds)] * factor
    seeds = mixed(seeds)
    # The leftmost least seed inside each window, by doubling.
    least, where, wide = seeds, np.arange(len(seeds), dtype=np.int32), 1
    while wide < span:
        shift = min(wide, span - wide)
        right = least[shift:] < least[:-shift]
        least = np.where(right, least[shift:], least[:-shift])
        where = np.where(right, where[shift:], where[:-shift])
        wide += shift
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    at = np.flatnonzero(owner[:count] == owner[WINDOW - 1 :])
    mine, anchor = owner[at], where[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (mine[1:] != mine[:-1])
    first = np.flatnonzero(new)
    windows, starts, anchor, mine = np.diff(first, append=len(at)), at[first], anchor[first], mine[first]
    ends = starts + windows + WINDOW - 1
    digest = xxhash.xxh3_128_digest
    names = np.frombuffer(b"".join([digest(whole[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]), "<i8").reshape(-1, 2)
    # Runs of equal neighbours.
    run = np.ones(len(starts), bool)
    run[1:] = (names[1:] != names[:-1]).any(axis=1) | (mine[1:] != mine[:-1])
    head = np.flatnonzero(run)
    times = np.diff(head, append=len(starts))
    begin = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[mine[head]]
    values = [mine[head], starts[head] - begin, windows[head], (anchor - starts)[head], times]
    return (*(v.astype(np.int32) for v in values), seeds[anchor[head]].view(np.int64), *names[head].T)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the tree's intervals, children first, by a stack scan.

    ``prefixes[i]`` is the common prefix of suffixes i - 1 and i in sorted order; ``prefixes[0]`` plays no part.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(prefixes) + 1):
        length, first = (prefixes[i] if i < len(prefixes) else -1), i - 1
        while stack and stack[-1][0] > length:
            deeper, first = stack.pop()
            yield deeper, first, i - 1
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def maximal(members: list[tuple[int, int, bytes]], window: int = WINDOW) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(member, offset)]) of the maximal repeats of at least a window around the members' anchors.

    A member is (times it occurs, offset of the anchor, bytes). A member that occurs more than once is a repeat as a whole.
    """
    for i, (times, _, raw) in enumerate(members):
        if times > 1:
            yield len(raw), [(i, 0)]
    if len(members) < 2:
        return
    right = [raw[anchor:] for _, anchor, raw in members]
    left = [raw[:anchor][::-1] for _, anchor, raw in members]
    order = sorted(range(len(members)), key=right.__getitem__)
    leftward = {i: rank for rank, i in enumerate(sorted(range(len(members)), key=left.__getitem__))}
    prefixes = [0, *(common(right[a], right[b]) for a, b in zip(order, order[1:]))]
    for length, first, last in intervals(prefixes):
        cuts = [i for i in range(first + 1, last + 1) if prefixes[i] == length]
        places = sorted(range(first, last + 1), key=lambda p: leftward[order[p]])
        before = [left[order[p]] for p in places]
        for ahead, start, end in intervals([0, *(common(a, b) for a, b in zip(before, before[1:]))]):
            if ahead + length < window:
                continue
            alike = places[start : end + 1]
            # In one child only: the child has it, with a longer string.
            if bisect_left(cuts, min(alike) + 1) < bisect_left(cuts, max(alike) + 1):
                yield ahead + length, [(order[p], members[order[p]][1] - ahead) for p in alike]


def united(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Disjoint (first, length) that cover what the given ones cover."""
    spans = sorted(spans)
    first = end = spans[0][0]
    for start, length in spans:
        if start > end:
            yield first, end - first
            first = start
        end = max(end, start + length)
    yield first, end - first


def _text(docs: DataFrame) -> Column:
    return F.coalesce(column(docs, "text"), F.lit(""))


def _keyed(docs: DataFrame) -> DataFrame:
    key = text_key(_text(docs))
    return docs.select(key["a"].alias("ka"), key["b"].alias("kb"), _text(docs).cast("binary").alias("raw"))


def _all_extents(keyed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for block in blocks(t.as_py() for t in batch.column(2)):
                part, start, *rest = extents([b[2] for b in block])
                number = pa.array(np.array([b[0] for b in block])[part])
                start += np.array([b[1] for b in block], np.int32)[part]
                keys = [batch.column(0).take(number), batch.column(1).take(number)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(start), *map(pa.array, rest)], names)

    names = ["ka", "kb", "start", "n", "anchor", "times", "seed", "a", "b"]
    return keyed.mapInArrow(run, "ka bigint, kb bigint, start int, n int, anchor int, times int, seed bigint, a bigint, b bigint")


PIECE = "a bigint, b bigint, offset int, seed bigint, pa bigint, pb bigint, times bigint, anchor int, raw binary"


def _opened(keyed: DataFrame, marked: DataFrame) -> DataFrame:
    """The bytes of one copy of each marked extent, as pieces that are whole extents; ``large`` is carried along."""
    wanted = marked.groupBy("ka", "kb").agg(F.collect_list(F.struct("start", "n", "anchor", "seed", "a", "b", "times", "large")).alias("wanted"))
    # One copy of each text is shuffled, however many there are.
    texts = keyed.dropDuplicates(["ka", "kb"]).join(wanted, ["ka", "kb"]).select("raw", "wanted")

    def run(batches):
        for batch in batches:
            rows = batch.column(1).flatten()
            ends = np.cumsum([0, *(len(w) for w in batch.column(1))])
            starts, lasts = rows.field("start").to_numpy(), rows.field("start").to_numpy() + rows.field("n").to_numpy() + WINDOW - 1
            first, held, size = 0, [], 0
            for i, raw in enumerate(batch.column(0)):
                raw = raw.as_py()
                held += [raw[s:e] for s, e in zip(starts[ends[i] : ends[i + 1]].tolist(), lasts[ends[i] : ends[i + 1]].tolist())]
                size += len(raw)
                if size >= BLOCK or i + 1 == batch.num_rows:
                    part = rows.slice(first, len(held))
                    a, b, seed, times, anchor, large = (part.field(c) for c in ("a", "b", "seed", "times", "anchor", "large"))
                    zero = pa.array(np.zeros(len(held), np.int32))
                    yield pa.RecordBatch.from_arrays([a, b, zero, seed, a, b, times, anchor, pa.array(held, pa.binary()), large], names)
                    first, held, size = first + len(held), [], 0

    names = [c.split()[0] for c in PIECE.split(", ")] + ["large"]
    return texts.mapInArrow(run, f"{PIECE}, large boolean")


def _divided(pieces: DataFrame, width: int) -> DataFrame:
    """The pieces cut into slabs of ``width`` windows; ``seed`` becomes the hash of the bytes that a slab's windows share."""

    def cut(a, b, offset, times, anchor, raw):
        windows = len(raw) - WINDOW + 1
        for slab in range((anchor - windows + 1) // width, anchor // width + 1):
            high, low = min(anchor, (slab + 1) * width - 1), max(anchor - windows + 1, slab * width)
            part = raw[anchor - high : anchor - low + WINDOW]
            shared = raw[anchor - slab * width : anchor + WINDOW - (slab + 1) * width + 1]
            seed = xxhash.xxh3_64_intdigest(shared, slab) - (1 << 63)
            pa_, pb = np.frombuffer(xxhash.xxh3_128_digest(part, high), "<i8").tolist()
            yield a, b, offset + anchor - high, seed, pa_, pb, times, high, part

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "offset", "times", "anchor", "raw")))
            made = list(zip(*(r for row in rows for r in cut(*row))))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema)], schema=schema)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PIECE.split(", "))])
    return pieces.mapInArrow(run, PIECE)


def _scanned(pieces: DataFrame, *, named: bool) -> DataFrame:
    """(seed, pa, pb, at, length, ra, rb): the places of the maximal repeats in every piece of its seed.

    With ``named``, one row per repeat and place, with a hash of the string; else what they cover together.
    """

    def run(batches):
        seed, members, out = None, [], []

        def scan():
            spans = defaultdict(list)
            for length, places in maximal([m[2:] for m in members]):
                if named:
                    i, at = places[0]
                    name = np.frombuffer(xxhash.xxh3_128_digest(members[i][4][at : at + length]), "<i8").tolist()
                    out.extend((seed, *members[i][:2], at, length, *name) for i, at in places)
                else:
                    for i, at in places:
                        spans[i].append((at, length))
            out.extend((seed, *members[i][:2], *span, 0, 0) for i, held in spans.items() for span in united(held))

        for batch in batches:
            for s, *member in zip(*(batch.column(c).to_pylist() for c in ("seed", "pa", "pb", "times", "anchor", "raw"))):
                if s != seed:
                    scan()
                    seed, members = s, []
                    if len(out) > 10_000:
                        yield rows(out)
                        out.clear()
                members.append(member)
        scan()
        yield rows(out)

    def rows(out):
        columns = zip(*out) if out else [()] * 7
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["seed", "pa", "pb", "at", "length", "ra", "rb"])

    sorted_ = pieces.select("seed", "pa", "pb", "times", "anchor", "raw").repartition("seed").sortWithinPartitions("seed")
    return sorted_.mapInArrow(run, "seed bigint, pa bigint, pb bigint, at int, length int, ra bigint, rb bigint")


def find_extents(docs: DataFrame, group: int = GROUP, *, named: bool = True) -> tuple[DataFrame, DataFrame]:
    """All extents, (ka, kb, start, n, times, a, b) with the text's key, and the repeats in distinct ones, (a, b, at, length, ra, rb).

    Without ``named``, the repeats are only what all of them cover, with empty names.
    """
    keyed = _keyed(docs)
    every = stored(_all_extents(keyed))
    place = F.min(F.struct("ka", "kb", "start", "n", "anchor")).alias("place")
    distinct = stored(every.groupBy("seed", "a", "b").agg(F.sum("times").alias("times"), place).select("seed", "a", "b", "times", "place.*"))
    several = stored(distinct.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed", (F.col("n") > group).alias("large")))
    marked = stored(distinct.join(several, "seed", "left").where("times > 1 OR large IS NOT NULL"))
    alone = marked.where("large IS NULL").select(
        "a", "b", F.lit(0).alias("at"), (F.col("n") + (WINDOW - 1)).alias("length"), F.col("a").alias("ra"), F.col("b").alias("rb")
    )
    opened = stored(_opened(keyed, marked.where("large IS NOT NULL")))
    small, large = opened.where("NOT large"), opened.where("large").drop("large")
    in_extent = lambda scanned: scanned.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "at", "length", "ra", "rb")
    repeats = alone.unionByName(in_extent(_scanned(small, named=named)))
    for width in SLABS:
        if large.isEmpty():
            break
        slabs = stored(_divided(large, width))
        pieces = stored(
            slabs.groupBy("seed", "pa", "pb").agg(F.sum("times").alias("times"), F.min(F.struct("anchor", "raw")).alias("piece")).select("seed", "pa", "pb", "times", "piece.*")
        )
        sizes = stored(pieces.groupBy("seed").agg(F.count("*").alias("pieces"), F.sum("times").alias("all")).where(F.col("all") > 1).drop("all"))
        # Slabs of one window are equal throughout: the last step leaves no large group.
        fits = F.lit(True) if width == 1 else F.col("pieces") <= group
        scanned = stored(_scanned(pieces.join(sizes.where(fits), "seed"), named=named))
        met = slabs.select("a", "b", "offset", "seed", "pa", "pb").join(scanned, ["seed", "pa", "pb"])
        repeats = repeats.unionByName(met.select("a", "b", (F.col("at") + F.col("offset")).alias("at"), "length", "ra", "rb"))
        large = slabs.join(sizes.where(~fits), "seed").drop("pieces")
    return every, stored(repeats)


def repeat_groups(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(repeat, length, doc_id, start): all occurrences of all maximal repeats; ``repeat`` is a 128-bit hash of its bytes."""
    every, repeats = find_extents(docs, group)
    key = text_key(_text(docs))
    named = docs.select(column(docs, "doc_id").alias("doc_id"), key["a"].alias("ka"), key["b"].alias("kb"))
    turns = F.explode(F.sequence(F.lit(0), F.col("times") - 1))
    single = every.select("ka", "kb", "start", "n", "a", "b", turns.alias("turn"))
    # Rows of one text have the same extents: one of them is joined with all rows of the text.
    placed = single.join(repeats, ["a", "b"]).select(
        "ka", "kb", (F.col("start") + F.col("turn") * F.col("n") + F.col("at")).alias("start"), "length", "ra", "rb"
    )
    name = F.concat(F.hex("ra"), F.lit("-"), F.hex("rb")).alias("repeat")
    return placed.distinct().join(named, ["ka", "kb"]).select(name, "length", "doc_id", "start")


def _with_spans(docs: DataFrame, group: int = GROUP) -> tuple[DataFrame, str, str]:
    """The documents with the spans that go, null where there are none: (frame, name of spans, name of the text as bytes)."""
    spans, ka, kb, raw = free_names(docs, ["spans", "ka", "kb", "raw"])
    every, repeats = find_extents(docs, group, named=False)
    covers = repeats.select("a", "b", "at", "length").distinct()
    # A run of equal extents goes as a whole.
    again = F.col("times") > 1
    at = F.when(again, 0).otherwise(F.col("at"))
    length = F.when(again, F.col("times") * F.col("n") + (WINDOW - 1)).otherwise(F.col("length"))
    spots = every.join(stored(covers), ["a", "b"]).select("ka", "kb", (F.col("start") + at).alias("start"), length.alias("length")).distinct()
    found = stored(spots.groupBy("ka", "kb").agg(F.collect_list(F.struct("start", "length")).alias("spans")))
    found = found.withColumnsRenamed({"ka": ka, "kb": kb, "spans": spans})
    key = text_key(_text(docs))
    keyed = docs.withColumns({raw: _text(docs).cast("binary"), ka: key["a"], kb: key["b"]})
    return keyed.join(found, [ka, kb], "left").drop(ka, kb), spans, raw


def covered(length: int, spans: list[dict]) -> np.ndarray:
    """Which bytes the spans cover."""
    change = np.zeros(length + 1, np.int32)
    np.add.at(change, [s["start"] for s in spans], 1)
    np.add.at(change, [s["start"] + s["length"] for s in spans], -1)
    return np.cumsum(change[:-1]) > 0


def _kept(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The bytes that stay and the number of runs that go."""
    if not spans:
        return raw, 0
    gone = covered(len(raw), spans)
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The documents as they came, ``text`` without its repeated bytes; a character that is cut goes as a whole."""
    frame, spans, raw = _with_spans(docs, group)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            held = batch.column(names[place]).to_pylist()
            for i, (text, parts) in enumerate(zip(batch.column(raw), batch.column(spans))):
                if parts.is_valid:
                    held[i] = _kept(text.as_py(), parts.as_py())[0].decode(errors="ignore")
            columns = list(batch.drop_columns([spans, raw]).columns)
            columns[place] = pa.array(held, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return frame.select(*[F.col(f"`{c}`") for c in names], spans, raw).mapInArrow(run, docs.schema)


def op13_maximal_repeats(spark, folder: str) -> DataFrame:
    frame, spans, raw = _with_spans(documents(spark, folder).select("doc_id", "text"))

    def run(batches):
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                kept, runs = _kept(text, parts.as_py())
                rows.append((len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            made = zip(*rows) if rows else [()] * 4
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(made, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return frame.select("doc_id", raw, spans).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
