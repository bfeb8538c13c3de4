"""Byte spans that come again, against all windows of all texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tonetape.llm import maximal_repeats as repeats

W = repeats.WINDOW
SCHEMA = "doc_id bigint, text string, raw string, start int, spans string, ka bigint, seed int"


def made_rows():
    draw = random.Random(11)
    prose = lambda n: "".join(draw.choices("abcdefgh é\n", k=n))
    passage, other, edge = prose(900), prose(460), prose(395)
    rows = [(i, prose(draw.randint(0, 2500))) for i in range(25)]
    rows += [(30 + i, prose(300) + passage + prose(200)) for i in range(12)]  # one passage in many surroundings
    rows += [(50 + i, prose(50) + other[i : i + 420] + prose(70)) for i in range(8)]  # overlapping parts of one
    rows += [(60 + i, prose(10) + edge + prose(10)) for i in range(3)]  # too short by a few bytes
    rows += [(70, rows[3][1]), (70, rows[3][1]), (None, rows[4][1]), (71, None), (72, ""), (72, ""), (73, "a" * W), (74, "b" * 3000)]
    rows += [(75, "xyz" * 700 + "q"), (76, prose(20) + passage[200:700] + prose(30) + passage[:450]), (77, passage[:W]), (78, "c" * (W - 1))]
    rows += [(79, ("to be or not " * 90000)), (80, prose(60) + "🙂" * 150 + prose(60)), (81, "🙂" * 120)]
    return [(i, t, "r", 1, "s", 2, 3) for i, t in rows]


ROWS = made_rows()


def plain(rows):
    """(doc_id, which bytes go) of every row."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(t[p : p + W] for _, t in texts for p in range(len(t) - W + 1))
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - W + 1):
            if seen[t[p : p + W]] > 1:
                gone[p : p + W] = True
        yield i, t, gone


@pytest.fixture(scope="module")
def expected():
    return list(plain([r for r in ROWS if r[0] != 79])) + [(79, t := ROWS[[r[0] for r in ROWS].index(79)][1].encode(), np.ones(len(t), bool))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def test_equals_all_windows(spark, docs, expected, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = repeats.op13_maximal_repeats(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = Counter()
    for i, t, gone in expected:
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        rows[i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(tuple(r) for r in found.collect()) == rows


@pytest.mark.parametrize("group", [1, 3])
def test_large_groups_are_divided(docs, expected, group):
    """Seeds with more distinct extents than fit at once give the same spans."""
    found = repeats.remove_repeats(docs, group)
    assert found.columns == docs.columns
    rows = Counter((i, bytes(b for b, g in zip(t, gone) if not g).decode(errors="ignore") if gone.any() else t.decode()) for i, t, gone in expected)
    assert Counter((r.doc_id, r.text or "") for r in found.collect()) == rows
    assert found.where("raw <> 'r' OR start <> 1 OR spans <> 's' OR ka <> 2 OR seed <> 3").count() == 0


@pytest.mark.parametrize("group", [2, repeats.GROUP])
def test_groups_hold_all_occurrences(spark, docs, group):
    few = docs.where("doc_id BETWEEN 30 AND 78")
    texts = defaultdict(list)
    for r in ROWS:
        if r[0] is not None and 30 <= r[0] <= 78:
            texts[r[0]].append((r[1] or "").encode())
    strings, places = {}, defaultdict(set)
    for r in repeats.repeat_groups(few, group).collect():
        string = texts[r.doc_id][0][r.start : r.start + r.length]
        assert len(string) == r.length >= W
        assert strings.setdefault(r.repeat, string) == string
        places[r.repeat].add((r.doc_id, r.start))
    for name, string in strings.items():
        everywhere = {(i, p) for i, ts in texts.items() for p in range(len(ts[0])) if ts[0].startswith(string, p)}
        assert places[name] == everywhere
        assert sum(len(texts[i]) for i, _ in everywhere) > 1
    assert any(len(p) > 8 for p in places.values())


def test_intervals_are_those_of_the_tree():
    words = sorted([b"abab", b"abac", b"abd", b"b", b"ba", b"ba", b"cab"])
    prefixes = [0, *(repeats.common(a, b) for a, b in zip(words, words[1:]))]
    found = set(repeats.intervals(prefixes))
    brute = set()
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            least = min(prefixes[i + 1 : j + 1])
            if (i == 0 or prefixes[i] < least) and (j + 1 == len(words) or prefixes[j + 1] < least):
                brute.add((least, i, j))
    assert found == brute


def test_left_extension_tells_groups_apart():
    """Two strings left of one suffix are two groups beside the common one."""
    members = [(1, 4, b"AAAAxyzw"), (1, 4, b"AAAAxyzv"), (1, 4, b"BBBAxyzw"), (1, 4, b"CCCCxyzw")]
    found = {(length, tuple(sorted(places))) for length, places in repeats.maximal(members, 5)}
    assert found == {(5, ((0, 3), (2, 3))), (7, ((0, 0), (1, 0)))}
    assert (8, ((1, 0),)) in {(n, tuple(p)) for n, p in repeats.maximal([(1, 4, b"AAAAxyzw"), (2, 4, b"AAAAxyzv")], 5)}


def test_nothing(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert repeats.op13_maximal_repeats(spark, str(tmp_path)).count() == 0
    assert repeats.repeat_groups(docs.where("doc_id = 71")).count() == 0
