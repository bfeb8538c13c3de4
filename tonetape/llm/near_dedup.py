"""Near duplicates by Order MinHash, verified by banded alignment.

A document is the multiset of its runs of ``k`` words; a run that comes again gets a label with its
number, so all are different. Each band takes the runs of least hash and keeps them in the order they
have in the text: a bucket. Two documents meet in a bucket with a probability that falls with their edit
distance, as both the runs and their order must survive. Runs are short, two words, as one edit breaks only
two of them; a band takes two, and in the shortest texts, where few survive, one (``TIERS``; lengths overlap,
so that texts of similar length share a tier). Texts under five words can't differ by a word and still be
similar: their bucket is their words.

Candidates are verified by edit distance over their whole word sequences, computed by bit vectors in a
band of the distance that is still allowed: similarity is 1 - distance / words of the longer one, and 0.8
or more makes a link. Equal texts are one node with one number, so copies cost one row each and no pair.
First every node is held against the least node it meets, then the next, in a few rounds that make the classes
large. Then the buckets whose nodes are of several classes have all their pairs between classes tried, none left
out: a bucket is cut by length into chunks of ``CHUNK`` nodes, each pair of chunks whose lengths allow a link is a
group of its own, and a task sieves the pairs of a group by length and by word counts, in ``COARSE`` hashed cells
of four bits, then in ``SIGNS`` cells of eight, before any text is fetched. Nodes with a pair that passes, not
pairs, are rows: they fetch their counts, then their texts, and the task of the group verifies its pairs, each in
the first bucket both nodes share. A bucket of any size is so divided; none is dropped or capped. A bucket is
named by its band and 32 bits: few rows meet by chance, and they fail the sieves.

Classes are connected components of the links, found by joins with pointer jumping over stored tables.

Defined results: a null text counts as empty; texts without a word are one class; texts of equal words are
one class whatever the white space; a null doc_id counts as the largest; rows alike in id and text
are one node; texts are compared whole, however long; an empty table gives an empty result; extra columns
are carried along by ``keep_one`` whatever their names.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonetape.llm.shared import column, documents, free_names, partitions, short_batches, stored
from tonetape.llm.wordruns import Rolling, mixed
from tonetape.session import shared_folder

#: (least words, words it ends before, words of a run, runs taken, bands): texts with a similarity of 0.8 share a tier.
BANDS = 24
TIERS = ((5, 13, 2, 1, BANDS), (10, 1 << 62, 2, 2, BANDS))
SIMILAR = 0.8
#: Rounds in which nodes are held against the least node they meet.
ROUNDS = 2
#: Nodes of a bucket that are held against each other in one group.
CHUNK = 256
#: Hashed cells of a node's word counts: with few, words that differ fall together and pairs pass that need not.
SIGNS = 512
#: Cells of the first sieve, whose counts move once for each open bucket of a node: 64 bytes.
COARSE = 128
#: Pairs that a task holds at once.
PAIRS = 1 << 17
LAST = (1 << 63) - 1
#: The bits of a bucket's name beside its band.
LOW = (1 << 32) - 1


# --- Sketches -------------------------------------------------------------------------------------


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(2, words) hashes of all words of the texts, and how many each has; each distinct word is hashed once."""
    split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
    coded = split.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    table = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, names)), "<u8").reshape(-1, 2)
    which = coded.indices.to_numpy()
    # White space at an end leaves an empty string there.
    real = np.fromiter(map(len, names), np.int64, len(names))[which] > 0
    counts = np.concatenate([[0], np.cumsum(real)])[np.cumsum([0, *pc.list_value_length(split).to_pylist()])]
    return np.ascontiguousarray(table[which[real]].T), np.diff(counts)


def buckets(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(words of each text, its buckets, its word counts in SIGNS cells); texts of few words have one bucket, their words."""
    words, sizes = hashed_words(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    cells = owner * SIGNS + (words[0] & np.uint64(SIGNS - 1)).astype(np.int64)
    # 255 of a cell at most: more would only make the sieve finer.
    signs = np.minimum(np.bincount(cells, minlength=len(texts) * SIGNS), 255).astype(np.uint8).reshape(-1, SIGNS)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for i in np.flatnonzero(sizes < TIERS[0][0]):
        out[i].append(np.array([xxhash.xxh3_64_intdigest(b" ".join(texts[i].split())) & LOW]))
    for number, (least, end, k, taken, bands) in enumerate(TIERS):
        of_tier = (sizes >= least) & (sizes < end)
        mine = np.flatnonzero(of_tier)
        if len(mine):
            part = words if len(mine) == len(texts) else np.ascontiguousarray(words[:, of_tier[owner]])
            found = sketches(part, sizes[mine], bands, k, taken)
            named = (found & LOW) | (1 + number * BANDS + np.arange(bands)) << 32
            for i, row in zip(mine, named, strict=True):
                out[i].append(row)
    return sizes, [np.concatenate(rows) for rows in out], signs


def sketches(words: np.ndarray, sizes: np.ndarray, bands: int, k: int, taken: int) -> np.ndarray:
    """(texts, bands) bucket hashes of texts of so many words each; texts under k words have zeros."""
    out = np.zeros((len(sizes), bands), np.int64)
    some = np.flatnonzero(sizes >= k)
    if not len(some):
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    last = words.shape[1] - k + 1
    at = np.flatnonzero(owner[:last] == owner[k - 1 :])
    owner = owner[at]
    runs = Rolling(words).runs(at, k)[0]
    # Number the occurrences of equal runs within a text.
    order = np.lexsort((runs, owner))
    same = (runs[order][1:] == runs[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    if same.any():
        begins = np.concatenate([[True], ~same])
        number = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
        label = np.empty(len(order), np.uint64)
        label[order] = number.astype(np.uint64)
        runs = runs + label * np.uint64(0xD6E8FEB86659FD93)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    dense = np.cumsum(np.concatenate([[False], owner[1:] != owner[:-1]]))
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for band in range(bands):
        values = mixed(runs * np.uint64((2 * band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.uint64(band))
        places = np.full((taken, len(first)), len(values), np.int64)
        for turn in range(taken):
            least = np.minimum.reduceat(values, first)
            hit = np.flatnonzero((values == least[dense]) & (values != top))
            places[turn, dense[hit[::-1]]] = hit[::-1]  # the first of equal ones
            values[places[turn][places[turn] < len(values)]] = top
        places.sort(axis=0)
        bucket = np.full(len(first), np.uint64(band + 1))
        padded = np.append(runs, np.uint64(0))
        for turn in range(taken):
            bucket = mixed((bucket ^ padded[places[turn]]) * np.uint64(0xA0761D6478BD642F) + np.uint64(turn + 1))
        out[owner[first], band] = bucket.view(np.int64)
    return out


def coarse(signs: np.ndarray) -> np.ndarray:
    """Word counts in COARSE cells, 15 of a cell at most, two cells a byte."""
    cells = np.minimum(signs.reshape(len(signs), -1, COARSE).sum(axis=1, dtype=np.int64), 15).astype(np.uint8)
    return cells[:, : COARSE // 2] | cells[:, COARSE // 2 :] << 4


def most_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits that similar texts of so many words have at most."""
    return np.floor(np.maximum(a, b) * (1 - SIMILAR) + 1e-9)


def least_edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edits between texts of such word counts at least."""
    apart = a.astype(np.int16) - b
    return np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))


# --- Alignment ------------------------------------------------------------------------------------


def distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``: bit vectors in a band of 2 * most + 1 rows."""
    low = 0
    while low < len(a) and low < len(b) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and high < len(b) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return None
    if not a:
        return len(b)
    most = min(most, len(b))
    k, m = min(most, len(a)), len(a)
    if len(b) - m > k:
        k = len(b) - m  # a band this wide holds every way; only then is it wider than the shorter one
    rows: dict = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    width = 2 * k + 1
    full = (1 << width) - 1
    # Bit r of column j is row j - k + r; up and down are the vertical steps of +1 and -1.
    up, down = full ^ ((1 << k) - 1), 0
    value, corner, across = k, 1 << 2 * k, 1 << 2 * k
    if k > m:
        value, across = m, 1 << (m - 1 + k)
    for j, x in enumerate(b, 1):
        equal = rows.get(x, 0)
        shift = j - k - 1
        equal = (equal >> shift if shift >= 0 else equal << -shift) & full
        flat = ((((equal & up) + up) ^ up) | equal | down) & full
        right = down | (full ^ (flat | up))
        left = flat & up
        if j + k <= m:
            value += not flat & corner
            if value > 2 * k + len(b) - m + most:
                return None
        else:
            bit = 1 << (m - j + k)
            value += bool(right & bit) - bool(left & bit)
        up = (left | (full ^ ((flat >> 1) | right))) & full
        down = (flat >> 1) & right
    return value if value <= most else None


def similar(a: bytes, b: bytes, least: float = SIMILAR) -> float | None:
    """Similarity of two texts by words if it reaches ``least``."""
    return alike(a.split(), b.split(), least)


def alike(x: list[bytes], y: list[bytes], least: float = SIMILAR) -> float | None:
    """Similarity of two word sequences if it reaches ``least``."""
    longest = max(len(x), len(y))
    if not longest:
        return 1.0
    most = int(longest * (1 - least) + 1e-9)
    if (Counter(x) & Counter(y)).total() < longest - most:  # each edit costs the longer one a word at most
        return None
    found = distance_within(x, y, most)
    return None if found is None else 1 - found / longest


# --- Links ----------------------------------------------------------------------------------------


def _node(docs: DataFrame) -> Column:
    text = F.coalesce(column(docs, "text"), F.lit(""))
    doc = F.coalesce(column(docs, "doc_id"), F.lit(LAST))
    return F.struct(doc.alias("doc"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(17), text).alias("b"))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(column(docs, "text"), F.lit("")).cast("binary")


def _id(seed: int, a: Column, b: Column) -> Column:
    return F.xxhash64(F.lit(seed), a, b)


def nodes_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, doc, a, b, words, sign, coarse, buckets, text) of every distinct text, stored in buckets of the id, and the id's seed.

    The id is a hash of the text's 128-bit key; should two keys share one, all are dealt anew by another seed.
    Texts are grouped by the id, so they move once and are written where they are.
    """
    node = _node(docs)
    frame = docs.select(*(node[c].alias(c) for c in ("a", "b", "doc")), _text(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(5).to_pylist()
            sizes, found, signs = buckets(texts)
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            counts = (pa.array([row.tobytes() for row in cells], pa.binary()) for cells in (signs, coarse(signs)))
            made = [pa.array(sizes, pa.int32()), *counts, lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names)

    names = ["id", "clash", "a", "b", "doc", "text", "words", "sign", "coarse", "buckets"]
    schema = "id bigint, clash boolean, a bigint, b bigint, doc bigint, text binary, words int, sign binary, coarse binary, buckets array<bigint>"
    key = F.struct("a", "b")
    for seed in count():
        one = frame.groupBy(_id(seed, F.col("a"), F.col("b")).alias("id")).agg(
            F.min(F.struct("a", "b", "doc", "text")).alias("first"), (F.min(key) != F.max(key)).alias("clash")
        )
        made = one.select("id", "clash", "first.a", "first.b", "first.doc", "first.text").mapInArrow(run, schema)
        nodes = stored_by(made, "id")
        if nodes.where("clash").isEmpty():
            return nodes.drop("clash"), seed


def stored_by(frame: DataFrame, key: str) -> DataFrame:
    """The frame, grouped by the key already, written to the shared folder in sorted buckets of it: joins on it don't move its rows."""
    spark = frame.sparkSession
    name = f"tonetape_{uuid.uuid4().hex}"
    writer = frame.write.bucketBy(partitions(spark), key).sortBy(key)
    writer.option("path", shared_folder(spark)).saveAsTable(name)
    read = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone; the files are the shared folder's
    return read


def _of_both(pairs: DataFrame, nodes: DataFrame, *names: str) -> DataFrame:
    """The pairs (u, v) with columns of both nodes, as name_u and name_v. Pairs move to the nodes, with the columns of one at most."""
    u, v = (nodes.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in names)) for x in "uv")
    return pairs.select("u", "v").join(v, "v").join(u, "u")


def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose texts are similar; texts are fetched for those alone whose word counts allow it."""

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (np.frombuffer(b"".join(batch.column(f"sign_{x}").to_pylist()), np.uint8).reshape(-1, SIGNS) for x in "uv")
            most = most_edits(batch.column("words_u").to_numpy(), batch.column("words_v").to_numpy())
            yield batch.select(["u", "v"]).filter(pa.array(least_edits(u, v) <= most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = zip(batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist(), strict=True)
            good = pa.array([similar(a, b) is not None for a, b in texts_], pa.bool_())
            yield batch.select(["u", "v"]).filter(good)

    likely = stored(_of_both(pairs, nodes, "words", "sign").mapInArrow(sieve, "u bigint, v bigint"))
    return _of_both(likely, nodes, "text").mapInArrow(run, "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component, for nodes that have links.

    Every node points at its least neighbour, if that is less; pointers are followed to their ends by doubling.
    Then only links between different ends go on, so a large group of copies is worked on once.
    """
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        ahead = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = stored(labels.join(ahead, "label").select("node", F.col("label").alias("old"), F.col("next").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.where(F.col("old") != F.col("label")).isEmpty():
            break
    of_u, of_v = (labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "uv")
    ends = links.select("u", "v").join(of_u, "u").join(of_v, "v").where(F.col("of_u") != F.col("of_v"))
    between = stored(ends.select(F.col("of_u").alias("u"), F.col("of_v").alias("v")).distinct())
    if between.isEmpty():
        return labels
    upper = components(between).select(F.col("node").alias("label"), F.col("label").alias("least"))
    return stored(labels.join(upper, "label", "left").select("node", F.coalesce("least", "label").alias("label")))


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The classes after new links; only classes that a link joins are worked on."""
    if labels is None:
        return components(links)
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    added = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    labels = stored(labels.unionByName(added))
    of_u, of_v = (labels.select(F.col("node").alias(x), F.col("label").alias(f"of_{x}")) for x in "uv")
    between = links.join(of_u, "u").join(of_v, "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    met = components(between.where(F.col("u") != F.col("v")))
    met = met.select(F.col("node").alias("label"), F.col("label").alias("least"))
    return stored(labels.join(met, "label", "left").select("node", F.coalesce("least", "label").alias("label")))


def open_rows(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows (bucket, id, words, label, n, head, place) of buckets with nodes of several classes, stored; places go by length."""
    label = F.col("id")
    if labels is not None:
        rows = rows.join(labels.withColumnRenamed("node", "id"), "id", "left")
        rows, label = rows.withColumn("label", F.coalesce("label", "id")), F.col("label")
    by_length = Window.partitionBy("bucket").orderBy("words", "id")
    whole = by_length.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = rows.withColumns(
        {
            "n": F.count(F.lit(1)).over(whole),
            "low": F.min(label).over(whole),
            "high": F.max(label).over(whole),
            "head": F.min(F.struct("id", "words", label.alias("label"))).over(whole),
            "place": F.row_number().over(by_length),
        }
    )
    return stored(told.where(F.col("low") != F.col("high")).drop("low", "high").withColumn("label", label))


def _near_in_size(a: Column, b: Column) -> Column:
    """Only such pairs can be similar."""
    return F.least(a, b) >= F.ceil(F.greatest(a, b) * F.lit(SIMILAR) - F.lit(1e-9))


def to_heads(rows: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(u, v): every node with the least node of another class that heads one of its buckets, after the one tried last."""
    other = (F.col("head.label") != F.col("label")) & _near_in_size(F.col("words"), F.col("head.words"))
    pairs = rows.where(other).select(F.col("id").alias("v"), F.col("head.id").alias("u"))
    if tried is not None:
        pairs = pairs.join(tried.select("v", F.col("u").alias("last")), "v", "left").where("last IS NULL OR u > last")
    return pairs.groupBy("v").agg(F.min("u").alias("u"))


def _meeting_chunks(rows: DataFrame) -> DataFrame:
    """(bucket, mine, others): the chunks that a chunk of a large bucket meets, itself and those of lengths that allow a link."""
    ends = rows.where(F.col("n") > CHUNK).groupBy("bucket", "mine").agg(F.min("words").alias("from"), F.max("words").alias("to"))
    ends = stored(ends)
    others = ends.select("bucket", F.col("mine").alias("other"), F.col("from").alias("from_"), F.col("to").alias("to_"))
    shorter, longer = F.least("to", "to_"), F.greatest("from", "from_")
    meet = (shorter >= longer) | _near_in_size(shorter, longer)
    return ends.join(others, "bucket").where(meet).groupBy("bucket", "mine").agg(F.collect_list("other").alias("others"))


def all_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): links that join all classes which any pair of a bucket joins.

    Every pair between classes that can be similar by length and word counts is verified, in one group: that of the
    first bucket both share. Groups list their pairs by place, so rows are nodes of groups, never pairs; a text
    moves once for each group that needs it. Pairs of classes that a link of the group joins already are passed over.
    """
    cut = rows.select("bucket", "id", "words", "label", "n", F.expr(f"int((place - 1) div {CHUNK})").alias("mine"))
    place = F.array_position("buckets", F.col("bucket"))
    # The buckets of the tier that the bucket is of, without their bands.
    tier = F.when(place > BANDS, F.slice("buckets", BANDS + 1, BANDS)).otherwise(F.slice("buckets", 1, BANDS))
    tier = F.transform(tier, lambda x: (x.bitwiseAND(F.lit(LOW)) - F.lit(1 << 31)).cast("int")).alias("tier")
    open_ = cut.join(_meeting_chunks(cut), ["bucket", "mine"], "left").join(nodes.select("id", "coarse", "buckets"), "id")
    signed = open_.select("bucket", "id", "words", "label", "coarse", "mine", tier, F.coalesce("others", F.array("mine")).alias("others"))
    signed = signed.withColumn("other", F.explode("others"))
    group = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("met")
    # Within a chunk all pairs are of interest, between two only those across.
    side = F.when(F.col("mine") == F.col("other"), -1).otherwise(F.col("mine")).alias("side")
    met = signed.select(group, "bucket", "id", "words", "label", "coarse", "tier", side).repartition("met").sortWithinPartitions("met")
    kinds = "met bigint, place int, id bigint, label bigint, partners array<int>"
    listed = stored(met.mapInArrow(_by_group(_sieved), kinds))
    counts = _in_groups(listed.join(nodes.select("id", "words", "sign"), "id"))
    listed = stored(counts.mapInArrow(_by_group(_sieved_finely), kinds))
    texts = listed.join(nodes.select("id", "text"), "id").select("met", "place", "id", "label", "partners", "text")
    return _in_groups(texts).mapInArrow(_by_group(_verified), "u bigint, v bigint")


def _in_groups(listed: DataFrame) -> DataFrame:
    return listed.repartition("met").sortWithinPartitions("met", "place")


def _by_group(work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable:
    """Work on whole groups of rows that come sorted by ``met``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # The last group may go on in the next batch.
            met = batch.column("met").to_numpy()
            if held and met[-1] == held[0].column("met")[0].as_py():
                held.append(batch)
                continue
            whole = int(np.searchsorted(met, met[-1]))
            if held or whole:
                yield from work(pa.concat_batches([*held, batch.slice(0, whole)]))
            held = [batch.slice(whole)]
        if held:
            yield from work(pa.concat_batches(held))

    return run


def _sieved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(met, place, id, label, places of later partners) of the nodes that have a pair to verify in a group."""
    met, bucket, ids, words, labels, sides = (batch.column(c).to_numpy() for c in ("met", "bucket", "id", "words", "label", "side"))
    packed = np.frombuffer(b"".join(batch.column("coarse").to_pylist()), np.uint8).reshape(-1, COARSE // 2)
    signs = np.concatenate([packed & 15, packed >> 4], axis=1)
    bucket = (bucket & LOW) - (1 << 31)
    sizes = pc.list_value_length(batch.column("tier")).to_numpy()
    tiers = np.zeros((len(met), BANDS), np.int32)
    tiers[np.arange(BANDS) < sizes[:, None]] = batch.column("tier").flatten().to_numpy()
    after = np.searchsorted(met, met, side="right") - np.arange(len(met)) - 1
    ones, twos = [], []
    for start, stop in _slices(after):
        one = np.repeat(np.arange(start, stop), after[start:stop])
        if not len(one):
            continue
        before = np.cumsum(after[start:stop]) - after[start:stop]
        two = one + 1 + np.arange(len(one)) - np.repeat(before, after[start:stop])
        most = most_edits(words[one], words[two])
        good = (labels[one] != labels[two]) & (np.abs(words[one] - words[two]) <= most)
        good &= (sides[one] != sides[two]) | (sides[one] < 0)
        one, two, most = one[good], two[good], most[good]
        # The first bucket that both share has the pair.
        shared = tiers[one] == tiers[two]
        first = shared.argmax(axis=1)
        good = (tiers[one, first] == bucket[one]) | ~shared.any(axis=1)
        one, two, most = one[good], two[good], most[good]
        good = least_edits(signs[one], signs[two]) <= most
        ones.append(one[good].astype(np.int32))
        twos.append(two[good].astype(np.int32))
    if not sum(map(len, ones)):
        return
    one, two = np.concatenate(ones), np.concatenate(twos)  # in the order of the first one
    rows = np.union1d(one, two)
    ends = np.searchsorted(one, rows, side="right")
    starts = np.searchsorted(one, rows)
    partners = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(two))
    columns = [pa.array(met[rows]), pa.array(rows.astype(np.int32)), pa.array(ids[rows]), pa.array(labels[rows]), partners]
    yield pa.RecordBatch.from_arrays(columns, ["met", "place", "id", "label", "partners"])


def _sieved_finely(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The nodes of _sieved whose pairs pass by counts in SIGNS cells too, with the partners that are left."""
    met, places, words = (batch.column(c).to_numpy() for c in ("met", "place", "words"))
    signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8).reshape(-1, SIGNS)
    at = dict(zip(zip(met.tolist(), places.tolist(), strict=True), range(len(met)), strict=True))
    left: list[list[int]] = [[] for _ in at]
    needed = np.zeros(len(met), bool)
    for i, partners in enumerate(batch.column("partners").to_pylist()):
        if not partners:
            continue
        two = np.array([at[met[i], p] for p in partners])
        two = two[least_edits(signs[i], signs[two]) <= most_edits(words[i], words[two])]
        if len(two):
            left[i] = places[two].tolist()
            needed[i] = needed[two] = True
    rows = np.flatnonzero(needed)
    partners = pa.array([left[i] for i in rows], pa.list_(pa.int32()))
    columns = [*(batch.column(c).take(pa.array(rows)) for c in ("met", "place", "id", "label")), partners]
    yield pa.RecordBatch.from_arrays(columns, ["met", "place", "id", "label", "partners"])


def _verified(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The links (u, v) of similar texts that join classes of a group which no link before has joined."""
    met, places, ids, labels = (batch.column(c).to_pylist() for c in ("met", "place", "id", "label"))
    at = dict(zip(zip(met, places, strict=True), range(len(ids)), strict=True))
    texts, links, group, joined_ = batch.column("text"), [], None, {}
    words = cache(lambda i: texts[i].as_py().split())

    def end(label: int) -> int:
        while joined_.get(label, label) != label:
            label = joined_[label]
        return label

    for i, partners in enumerate(batch.column("partners").to_pylist()):
        if met[i] != group:
            group, joined_ = met[i], {}
            words.cache_clear()
        for j in (at[group, p] for p in partners):
            a, b = end(labels[i]), end(labels[j])
            if a != b and alike(words(i), words(j)) is not None:
                joined_[max(a, b)] = min(a, b)
                links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    u, v = zip(*links, strict=True) if links else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _slices(after: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows (from, to) with some PAIRS pairs together."""
    ends = np.cumsum(after)
    start = 0
    while start < len(after):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        yield start, stop
        start = stop


def find_links(docs: DataFrame) -> tuple[DataFrame, int, DataFrame | None]:
    """The nodes, the seed of their ids, and the class (node, label) of each node that has links."""
    short_batches(docs.sparkSession)
    nodes, seed = nodes_of(docs)
    rows = open_rows(nodes.select("id", "words", F.explode("buckets").alias("bucket")), None)
    labels = tried = None
    for _ in range(ROUNDS):
        tried = stored(to_heads(rows, tried))
        links = stored(verify(tried, nodes))
        if not links.isEmpty():
            labels = joined(labels, links)
            rows = open_rows(rows.select("bucket", "id", "words"), labels)
    links = stored(all_links(rows, nodes).distinct())
    return nodes, seed, labels if links.isEmpty() else joined(labels, links)


def _members(nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, doc, a, b, label) that have links, and the least node (doc, a, b) of each label. Classes are small sets of nodes."""
    in_class = stored(nodes.select("id", "doc", "a", "b").join(labels.withColumnRenamed("node", "id"), "id"))
    return in_class, stored(in_class.groupBy("label").agg(F.min(F.struct("doc", "a", "b")).alias("least")))


def classes(docs: DataFrame) -> DataFrame:
    """One row per text: (a, b, label), the least node of its class."""
    nodes, _, labels = find_links(docs)
    node = F.struct("doc", "a", "b")
    if labels is None:
        return nodes.select("a", "b", node.alias("label"))
    # Nodes without links are classes of their own.
    in_class, first = _members(nodes, labels)
    named = in_class.join(first, "label").select("a", "b", F.col("least").alias("label"))
    alone = nodes.join(labels.select(F.col("node").alias("id")), "id", "left_anti").select("a", "b", node.alias("label"))
    return named.unionByName(alone)


def classify(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The documents with the node and its class's first node: (frame, two column names)."""
    node, label, a, b = free_names(docs, ["node", "label", "a", "b"])
    found = classes(docs).withColumnsRenamed({"label": label, "a": a, "b": b})
    frame = docs.withColumn(node, _node(docs))
    same = (F.col(f"{node}.a") == F.col(a)) & (F.col(f"{node}.b") == F.col(b))
    return frame.join(found, same, "left").drop(a, b), node, label


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document of every class, as it came.

    Texts stay where the nodes have them: the other columns of each text's first document are brought there.
    """
    nodes, seed, labels = find_links(docs)
    if labels is not None:
        in_class, first = _members(nodes, labels)
        later = in_class.join(first, "label").where(F.struct("doc", "a", "b") != F.col("least")).select("id")
        nodes = nodes.join(later, "id", "left_anti")
    node, others = _node(docs), [c for c in docs.columns if c != "text"]
    row = F.struct(column(docs, "text").isNull().alias("0"), *(F.col(f"`{c}`").alias(str(i)) for i, c in enumerate(others, 1)))
    rows = docs.select(_id(seed, node["a"], node["b"]).alias("id"), node["doc"].alias("doc"), row.alias("row"))
    firsts = rows.groupBy("id").agg(F.min_by("row", "doc").alias("row"))
    text = F.when(~F.col("row")["0"], F.col("text").cast("string"))
    made = {c: F.col("row")[str(i)] for i, c in enumerate(others, 1)} | {"text": text}
    return firsts.join(nodes.select("id", "text"), "id").select(*(made[c].alias(c) for c in docs.columns))


def op6_near_dedup(spark, folder: str) -> DataFrame:
    """doc_id and class_id, the least id of the document's class."""
    docs = documents(spark, folder).select("doc_id", "text")
    frame, _, label = classify(docs)
    first = F.col(f"{label}.doc")
    return frame.select("doc_id", F.when(first != LAST, first).alias("class_id"))
