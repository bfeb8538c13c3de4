"""The most frequent values from summaries per day."""

import random
from collections import Counter

import pytest

from tonetape.operators import heavy


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    cells = [(i % 7, f"v{int(draw.paretovariate(1.1)) % 3000}") for i in range(20_000)] + [(1, None)] * 50
    return spark.createDataFrame(cells, "day int, value string").repartition(5), cells


def exact(cells, n):
    counts = Counter(v for _, v in cells if v is not None)
    return sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:n]


@pytest.mark.parametrize(("n", "items", "proven"), [(10, 200, True), (20, 10_000, True), (100, 10_000, False), (40, 60, False), (5000, 10_000, False)])
def test_equals_the_exact_top(rows, n, items, proven):
    frame, cells = rows
    held = heavy.summaries(frame, "value", items=items)
    assert held.count() == 7
    found, sure = heavy.top_values(frame, "value", n, held, items=items)
    assert [tuple(r) for r in found.collect()] == exact(cells, n)
    assert sure is proven


def test_days_combine_to_any_range(rows):
    frame, cells = rows
    some = "day IN (2, 5)"
    found, _ = heavy.top_values(frame.filter(some), "value", 5, heavy.summaries(frame, "value").filter(some))
    assert [tuple(r) for r in found.collect()] == exact([c for c in cells if c[0] in (2, 5)], 5)


def test_no_rows(rows):
    nothing = rows[0].limit(0)
    assert heavy.top_values(nothing, "value", 5, heavy.summaries(nothing, "value"))[0].count() == 0
