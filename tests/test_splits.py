import datetime as dt
import random

import pytest

from tonetape.operators import splits

START = dt.datetime(2016, 3, 8)


@pytest.fixture
def rows(frame):
    rng = random.Random(1)
    cells = [(START + dt.timedelta(hours=rng.choice([0, 5, 30, 200]) + rng.randint(0, 3)), f"T{i}", i) for i in range(203)]
    return frame(cells, "Time timestamp, Ticker string, id int")


@pytest.mark.parametrize("portion", [0.8, 0.2, 0.001, 0.999])
def test_chronological_split_cuts_at_the_row(rows, portion):
    found = splits.chronological_split(rows, portion=portion).collect()
    order = sorted(found, key=lambda r: (r.Time, r.Ticker))
    assert [r.is_train for r in order] == [i < int(203 * portion) for i in range(203)]


def test_ten_rows(frame):
    rows = frame([(START + dt.timedelta(hours=i), "A") for i in range(10)], "Time timestamp, Ticker string")
    assert splits.chronological_split(rows).filter("is_train").count() == 8


def test_one_time_holding_most_rows(frame):
    rows = frame([(START, f"T{i:03d}") for i in range(90)] + [(START + dt.timedelta(days=i), "A") for i in range(1, 11)], "Time timestamp, Ticker string")
    found = splits.chronological_split(rows, portion=0.5).filter("is_train").collect()
    assert sorted(r.Ticker for r in found) == [f"T{i:03d}" for i in range(50)]


def test_shuffled_split_size_and_repeat(rows):
    test = lambda n, seed: sorted(
        r.id for r in splits.shuffled_split(rows.repartition(n), ["id"], 0.3, seed=seed).filter("is_test").collect()
    )
    assert len(test(1, 1)) == 60
    assert test(1, 1) == test(7, 1) != test(1, 2)


def test_hash_split(rows):
    side = lambda n: {r.id: r.split for r in splits.hash_split(rows.repartition(n), ["id"], {"a": 0.2, "b": 0.5, "c": 0.3}).collect()}
    found = side(1)
    assert found == side(5)
    sizes = [sum(v == s for v in found.values()) for s in "abc"]
    assert sum(sizes) == 203 and 25 < sizes[0] < 60 and 75 < sizes[1] < 130


def test_portion_must_cut(rows):
    with pytest.raises(ValueError):
        splits.chronological_split(rows, portion=1.0)


def test_stamps_within_a_second(frame):
    cells = [(START + dt.timedelta(microseconds=i * 7), "A") for i in range(50)]
    found = splits.chronological_split(frame(cells, "Time timestamp, Ticker string"), portion=0.5)
    assert sorted(r.Time for r in found.filter("is_train").collect()) == [t for t, _ in cells[:25]]


def test_rows_without_a_time_come_last(frame):
    cells = [(START, "A"), (None, "B"), (START + dt.timedelta(days=1), "C"), (None, "D")]
    found = splits.chronological_split(frame(cells, "Time timestamp, Ticker string"), portion=0.75).collect()
    assert {r.Ticker: r.is_train for r in found} == {"A": True, "C": True, "B": True, "D": False}


def test_no_rows(frame):
    found = splits.chronological_split(frame([], "Time timestamp, Ticker string"))
    assert found.columns == ["Time", "Ticker", "is_train"] and found.count() == 0


def test_only_equal_rows_at_the_cut_are_numbered(frame, rows):
    plan = lambda r: splits.chronological_split(r)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" not in plan(rows) and "Join" not in plan(rows)
    equal = frame([(START, "A", i) for i in range(10)], "Time timestamp, Ticker string, id int")
    assert plan(equal).count("row_number()") == 1 and "Join" not in plan(equal)
    assert splits.chronological_split(equal).filter("is_train").count() == 8


def test_cut_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    before, after = splits.chronological_sides(stored, portion=0.3)
    physical = lambda r: r._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(Time" in physical(before).split("PushedFilters")[1].split("]")[0]
    assert "GreaterThanOrEqual(Time" in physical(after).split("PushedFilters")[1].split("]")[0]
    marked = {r.id: r.is_train for r in splits.chronological_split(stored, portion=0.3).collect()}
    assert {r.id for r in before.collect()} == {i for i, first in marked.items() if first}
    assert {r.id for r in after.collect()} == {i for i, first in marked.items() if not first}


@pytest.mark.parametrize("few", [1, 3])
def test_cut_is_narrowed_step_by_step(rows, monkeypatch, few):
    """Brackets with too many values for one task are narrowed before they are counted."""
    expected = {r.id: r.is_train for r in splits.chronological_split(rows, portion=0.4).collect()}
    monkeypatch.setattr(splits, "FEW", 0)
    monkeypatch.setattr(splits, "SKETCH", few * 100)
    assert {r.id: r.is_train for r in splits.chronological_split(rows, portion=0.4).collect()} == expected


def test_ties_of_all_kinds(frame):
    cells = [(START, None if i == 3 else f"{'common prefix of texts ' if i % 2 else ''}{i:02d}", i) for i in range(40)]
    rows = frame(cells, "Time timestamp, Ticker string, id int")
    found = splits.chronological_split(rows, portion=0.5).filter("is_train").collect()
    order = sorted(cells, key=lambda c: (c[1] is not None, c[1]))
    assert {r.id for r in found} == {c[2] for c in order[:20]}
    numbers = splits.chronological_split(rows, ties=("id",), portion=0.5).filter("is_train").collect()
    assert {r.id for r in numbers} == set(range(20))


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_ties_beyond_the_whole_numbers_of_a_double(frame, kind):
    """The sketch rounds such values; the bracket around the cut must still hold them."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    numbers = [-(1 << 63), -(1 << 53) - 1, (1 << 53) + 1, (1 << 62) + 1, (1 << 63) - 1]
    cells = [(START, c) for c in (names if kind == "string" else numbers)]
    rows = frame(cells, f"Time timestamp, tie {kind}")
    for first in range(1, 5):
        found = splits.chronological_split(rows, ties=("tie",), portion=first / 5).filter("is_train").collect()
        assert [r.tie for r in sorted(found, key=lambda r: r.tie)] == [c[1] for c in cells[:first]]


def test_stratified_folds_are_even(frame):
    cells = [(i, 1 if i in (7, 41) else None if i > 54 else 0) for i in range(60)]
    rows = frame(cells, "id int, y int")
    for folds in (2, 3, 7):
        found = [tuple(r) for r in splits.stratified_folds(rows.repartition(3), ["id"], "y", folds).collect()]
        assert sorted(f[0] for f in found) == list(range(60))
        for y in (0, 1, None):
            sizes = [sum(f[1] == y and f[2] == k for f in found) for k in range(folds)]
            assert max(sizes) - min(sizes) <= 1 and sum(sizes) == sum(c[1] == y for c in cells)
    again = splits.stratified_folds(rows, ["id"], "y", 3).collect()
    assert {(r.id, r.fold) for r in again} == {(r.id, r.fold) for r in splits.stratified_folds(rows.repartition(5), ["id"], "y", 3).collect()}
    plan = splits.stratified_folds(rows, ["id"], "y", 3)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan and "NestedLoop" not in plan
