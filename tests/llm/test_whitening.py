"""Whitening against a dense eigendecomposition."""

import math
from collections import Counter

import numpy as np
import pytest

from tonetape.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, whitened double, component string"


def made_rows(d=24, n=400):
    draw = np.random.default_rng(3)
    spread = np.linspace(2, 0.5, d)
    spread[0], spread[1] = 12, 6
    made = [(i, [float(np.float32(c)) for c in draw.standard_normal(d) * spread + 1]) for i in range(n)]
    made += [(500, made[0][1])] * 120  # one vector comes again and again
    made += [(0, made[5][1]), (None, made[6][1]), (501, None), (502, [None] + [1.0] * (d - 1)), (503, [math.nan] * d)]
    made += [(504, [math.inf] + [0.0] * (d - 1)), (505, []), (506, [1.0] * (d + 1)), (507, [100.0] * d), (508, [0.0] * d)]
    return [(i, v, 1, "x", 0.5, "c") for i, v in made]


def plain(rows, d=24):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    far = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in kept], n, far, centred @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8]), e[::-1][:8] / e.sum()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(made_rows(), SCHEMA).repartition(5)


def test_equals_dense(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    found = whitening.op11_whitening(spark, str(tmp_path))
    rows = found.collect()
    ids, n, far, white, share = plain(made_rows())
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(rows) == 8 * len(ids) and {r.n for r in rows} == {n}
    assert {r.identity_error < 1e-10 for r in rows} == {True}
    assert Counter((r.vec_id, r.deviation) for r in rows if r.component == 1) == Counter(zip(ids, far))
    for c in range(8):
        mine = {(r.vec_id, r.deviation): r.whitened for r in rows if r.component == c + 1}
        theirs = dict(zip(zip(ids, far), white[:, c]))
        sign = 1 if mine[507, max(far)] * theirs[507, max(far)] > 0 else -1
        assert all(abs(mine[k] - sign * theirs[k]) < 1e-9 for k in theirs)
    assert all(abs(r.explained / share[r.component - 1] - 1) < 1e-10 for r in rows)


def test_residuals_certify_and_passes_filter(frame):
    vectors = whitening.fixed_point(frame)
    model = whitening.fit(vectors, 3)
    x = np.array([r.x for r in vectors.collect()], float)
    v = np.cov(x.T, bias=True)
    assert model.rounds > 1 and model.residual <= whitening.ENOUGH
    assert np.abs(v @ model.vectors - model.vectors * model.values).max() < 1e-8 * model.values[0]
    assert np.allclose(model.values, np.linalg.eigvalsh(v)[::-1][:3], rtol=1e-12)


def test_filter_damps_the_rest():
    values = np.array([9.0, 5, 4.5, 1, 0.9, 0.5, 0.1, 0.0])
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((8, 4)))[0]
    out = whitening.chebyshev(lambda b: values[:, None] * b, q, np.array([9.0, 5, 4.5, 1.0]), 3)
    assert np.abs(out[3:]).max() < 1e-3 * np.abs(out[2]).max()


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]] * 3])
def test_without_variance(spark, vectors, tmp_path):
    rows = [(i, v) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening.op11_whitening(spark, str(tmp_path)).count() == 0


def test_low_rank(spark, tmp_path):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = whitening.op11_whitening(spark, str(tmp_path)).collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-12


def test_small_components_beside_a_huge_one(frame):
    far = frame.limit(1).selectExpr("9L AS vec_id", "transform(embedding, c -> 1e6) AS embedding")
    vectors = whitening.fixed_point(frame.select("vec_id", "embedding").union(far))
    model = whitening.fit(vectors)
    assert model.values[0] > 1e8 * model.values[1] and len(model.values) == 8
    assert whitening.identity_error(vectors, model) < 1e-6


def test_deviations_of_any_size():
    m = np.array([[1 << 50, 5], [3, 4]], np.int64)
    n, sums = 1000, [1 << 55, 7000]
    assert whitening.deviations(m, n, sums)[0] is None
    small = np.array([[100001, 99999], [100500, 99000]], np.int64)
    assert whitening.deviations(small, 3, [300000, 300000]) == [18, 1500**2 + 3000**2]
    wide = whitening.deviations(np.array([[2_000_000_000, 0]], np.int64), 1, [0, 0])
    assert wide == [4 * 10**18]
