import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from tonetape.operators import thresholds

SCHEMA = "model string, label int, p0 double, p1 double"


def cells(tp, fn, tn, fp):
    return [("m", y, 1 - p, p) for n, y, p in ((tp, 1, 0.9), (fn, 1, 0.1), (tn, 0, 0.1), (fp, 0, 0.9)) for _ in range(n)]


@pytest.fixture
def scored(frame):
    rng = random.Random(1)
    exact = [float(t) for t in np.linspace(0.5, 0.95, 46)]
    rows = []
    for i in range(600):
        p = rng.choice([rng.random(), rng.choice(exact), 1 - rng.choice(exact), round(rng.random(), 2)])
        rows.append((rng.choice("ab"), int(rng.random() < p), 1 - p, p))
    return frame(rows, SCHEMA)


def confident(rows, t):
    predicted = [int(r.p1 > r.p0) for r in rows]
    return [(r, p) for r, p in zip(rows, predicted) if (r.p1 if p else r.p0) >= t]


def ratio(hits, total):
    return hits / total if total else None


def auc(kept):
    if not kept:
        return 1.0
    tpr = ratio(sum(p for r, p in kept if r.label), sum(1 for r, _ in kept if r.label))
    tnr = ratio(sum(1 - p for r, p in kept if not r.label), sum(1 for r, _ in kept if not r.label))
    return None if tpr is None or tnr is None else (tpr + tnr) / 2


def close(a, b):
    return a == b if a is None or b is None else a == pytest.approx(b)


def test_known_cells(frame):
    (row,) = thresholds.confident_auc(frame(cells(3, 1, 4, 2), SCHEMA)).collect()
    assert row.auc == pytest.approx(0.708333, abs=1e-6) and row.kept_share == 1.0


def test_nothing_kept(frame):
    (row,) = thresholds.confident_auc(frame(cells(3, 1, 4, 2), SCHEMA), 0.95).collect()
    assert (row.auc, row.kept_share) == (1.0, 0.0)


def test_one_class_kept_has_no_auc(frame):
    assert thresholds.confident_auc(frame(cells(3, 1, 0, 0), SCHEMA)).first().auc is None


def test_tie_is_class_zero(frame):
    row = thresholds.accuracy_at(frame([("m", 0, 0.5, 0.5)], SCHEMA), 0.5).first()
    assert (row.accuracy, row.accuracy_pos, row.accuracy_neg) == (1.0, None, 1.0)


def test_equals_the_evaluator(scored):
    hard = scored.select(F.col("label").cast("double"), (F.col("p1") > F.col("p0")).cast("double").alias("predicted"))
    expected = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="predicted").evaluate(hard)
    assert thresholds.confident_auc(scored).first().auc == pytest.approx(expected)


def test_neg_threshold_defaults_to_pos(scored):
    rows = scored.collect()
    found = thresholds.accuracy_at(scored, 0.8).first()
    kept = confident(rows, 0.8)
    assert found.counts == len(kept)
    assert found.accuracy == pytest.approx(sum(r.label == p for r, p in kept) / len(kept))
    apart = thresholds.accuracy_at(scored, 0.9, 0.6).first()
    pos = [(r, p) for r, p in confident(rows, 0.9) if p]
    neg = [(r, p) for r, p in confident(rows, 0.6) if not p]
    assert apart.counts == len(pos) + len(neg)
    assert apart.accuracy_pos == pytest.approx(sum(r.label for r, _ in pos) / len(pos))
    assert apart.accuracy_neg == pytest.approx(sum(1 - r.label for r, _ in neg) / len(neg))


def test_sweep_equals_one_threshold_at_a_time(scored):
    rows = scored.collect()
    found = thresholds.threshold_sweep(scored).orderBy("threshold").collect()
    assert [r.threshold for r in found] == thresholds.THRESHOLDS
    for row in found:
        kept = confident(rows, row.threshold)
        pos, neg = [r.label for r, p in kept if p], [1 - r.label for r, p in kept if not p]
        assert row.kept == pytest.approx(len(kept) / len(rows))
        assert row.kept_pos == pytest.approx(len(pos) / sum(r.p1 > r.p0 for r in rows))
        assert row.kept_neg == pytest.approx(len(neg) / sum(r.p1 <= r.p0 for r in rows))
        assert close(row.accuracy, ratio(sum(pos) + sum(neg), len(kept)))
        assert close(row.accuracy_pos, ratio(sum(pos), len(pos)))
        assert close(row.accuracy_neg, ratio(sum(neg), len(neg)))
    shares = [r.kept for r in found]
    assert shares == sorted(shares, reverse=True)


def test_curves_per_model(scored):
    rows = scored.collect()
    found = thresholds.auc_curves(scored).collect()
    assert len(found) == 92
    for row in found:
        mine = [r for r in rows if r.model == row.model]
        kept = confident(mine, row.threshold)
        assert close(row.auc, auc(kept)) and row.kept_share == pytest.approx(len(kept) / len(mine))


def test_sweep_lists_thresholds_nothing_reaches(frame):
    found = thresholds.threshold_sweep(frame([("m", 1, 0.4, 0.6)], SCHEMA)).orderBy("threshold").collect()
    assert len(found) == 46 and found[-1].kept == 0.0 and found[-1].accuracy is None


def test_histogram_equals_numpy(scored):
    rows = scored.collect()
    found = thresholds.confidence_histogram(scored).collect()
    for predicted in (0, 1):
        confidence = [r.p1 if predicted else r.p0 for r in rows if (r.p1 > r.p0) == bool(predicted)]
        counts, edges = np.histogram(confidence, bins=10)
        mine = sorted((r for r in found if r.predicted == predicted), key=lambda r: r.bin)
        assert [r["count"] for r in mine] == list(counts)
        assert [r.bin_low for r in mine] == pytest.approx(list(edges[:-1]))
        assert mine[-1].bin_high == edges[-1]


def test_histogram_of_one_value(frame):
    found = thresholds.confidence_histogram(frame([("m", 1, 0.25, 0.75)] * 3, SCHEMA)).orderBy("bin").collect()
    counts, edges = np.histogram([0.75] * 3, bins=10)
    assert [r["count"] for r in found] == list(counts)
    assert [r.bin_low for r in found] == pytest.approx(list(edges[:-1]))


def test_exact_auc_of_many_models(frame):
    rng = random.Random(4)
    cells = []
    for model in ("a", "b", None, "flat", "one"):
        for i in range(300):
            p1 = {"a": rng.random(), "b": rng.choice([0.0, 1e-9, 2e-9, 0.5, 0.5 + 1e-8, 1.0]), "flat": 0.3}.get(model, rng.gauss(0.5, 1e-6))
            cells.append((model, float(model == "one" or rng.random() < p1), 1 - p1, p1))
    cells += [("a", None, 0.5, 0.5), ("a", 1.0, None, None)]
    rows = frame(cells, "model string, label double, p0 double, p1 double")
    found = {r.model: r for r in thresholds.probability_auc(rows, ["model"]).collect()}
    for model in ("a", "b", None, "flat"):
        mine = [c for c in cells if c[0] == model and None not in c[1:]]
        pos, neg = [c[3] for c in mine if c[1]], [c[3] for c in mine if not c[1]]
        right = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert found[model].auc == pytest.approx(right / len(pos) / len(neg), abs=1e-12)
        assert (found[model].n_pos, found[model].n_neg) == (len(pos), len(neg))
    assert found["one"].auc is None and found["flat"].auc == 0.5
    assert thresholds.probability_auc(rows).count() == 1
    plan = thresholds.probability_auc(rows, ["model"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
