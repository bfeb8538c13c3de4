"""The filter audit against orders that are run one by one over the documents."""

import itertools
import re
from collections import Counter, defaultdict

import pytest

from tonetape.llm import filter_audit

SCHEMA = "doc_id bigint, text string, lang string, source string, mask int, part string, a bigint"


def made_rows():
    long = " ".join(f"w{i}" for i in range(230))
    rows = [
        (1, long, "s1"),
        (2, long, "s1"),
        (3, long, "s2"),
        (4, "short one", "s1"),
        (5, "x " * 300, "s1"),
        (6, "SHOUT " * 30 + long, "s2"),
        (7, long + " #", "s2"),
        (8, None, None),
        (9, "", ""),
        (10, "", "s3"),
        (11, " \n\t ", "s3"),
        (12, "A|" * 500, "s3"),
        (12, "A|" * 500, "s3"),
        (None, long, "s1"),
        (None, "only here", "s1"),
        (None, "only here", "s1"),
        (13, "é  \x1c" * 250, "s2"),
        (14, ("to be %d " * 40000), "s2"),
        (0, "x " * 300, "s9"),
    ]
    return [(i, t, "de", s, 7, "p", 1) for i, t, s in rows]


LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 1, None), (5, None, 1), (7, 1, 0), (7, 0, 1), (None, 1, 1), (12, 1, 0), (99, 1, 1)]


def plain(rows, labels, letters="ABCDE"):
    """Every order run over all documents."""
    rank = lambda i: (1 << 63) - 1 if i is None else i
    first = {}
    for i, text, *_ in rows:
        first[text or ""] = min(first.get(text or "", rank(i)), rank(i))
    docs = []
    for i, text, _, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": first[text] < rank(i),
        }
        mine = [r for r in labels if i is not None and r[0] == i]
        docs.append((source or "", {f for f in letters if fails[f]}, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    shapley, found = Counter(), defaultdict(lambda: [0] * 6)
    for part in {d[0] for d in docs}:
        for order in itertools.permutations(letters):
            left, gone = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                taken = [d for d in left if f in d[1]]
                row = found[part, "".join(order), step]
                row[0], row[1], row[2] = len(left) - len(taken), len(taken), sum(f in d[1] for d in gone)
                row[3] = sum(d[1] == {f} for d in docs if d[0] == part)
                row[4], row[5] = sum(d[2] for d in taken), sum(d[3] for d in taken)
                shapley[part, f] += len(taken)
                left, gone = [d for d in left if f not in d[1]], gone + taken
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(*r, "s") for r in LABELS], "doc_id bigint, quality int, toxic int, source string")


def test_equals_all_orders(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = filter_audit.op12_filter_audit(spark, str(tmp_path))
    expected = plain(made_rows(), LABELS)
    assert found.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == 600 * 5 and set(rows) == expected


def test_other_filters(spark):
    masked = spark.createDataFrame(
        [("p", 3, True, False), ("p", 1, False, True), ("p", 0, True, True), ("q", 2, True, False)], "part string, mask int, good boolean, toxic boolean"
    )
    rows = {tuple(r) for r in filter_audit.audit(masked, "xy").collect()}
    assert ("p", "xy", 1, 1, 2, 0, 1, 1, 1, 3) in rows and ("p", "yx", 2, 1, 1, 1, 1, 0, 1, 3) in rows
    assert ("q", "xy", 1, 1, 0, 0, 0, 0, 0, 0) in rows and len(rows) == 8
    with pytest.raises(ValueError):
        filter_audit.audit(masked, "abcdefg")


def test_nothing(spark, docs, labels, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert filter_audit.op12_filter_audit(spark, str(tmp_path)).count() == 0
    assert filter_audit.audit(*filter_audit.masks(docs, labels.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


def test_plan_is_native(docs, labels):
    plan = filter_audit.audit(*filter_audit.masks(docs, labels))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
