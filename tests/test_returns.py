import datetime as dt
import random

import pandas as pd
import pytest

from pyspark.sql import functions as F

from tonetape.operators import returns, series

START = dt.datetime(2016, 3, 8)


def bar(i):
    return START + dt.timedelta(minutes=15 * i)


def test_change_fills_forward_and_counts_rows(frame):
    prices = [100.0, 101.0, None, 103.0, 104.0, None, 0.0, 5.0]
    panel = frame([(bar(i), p) for i, p in enumerate(prices)], "Time timestamp, A double")
    found = [r[2] for r in returns.panel_returns(panel).orderBy("Time").collect()]
    assert found[:4] == [None] * 4
    assert found[4:] == pytest.approx([0.04, 0.029703, -1, -0.951456], abs=1e-6)


def test_zero_base_gives_null(frame):
    panel = frame([(bar(i), p) for i, p in enumerate([0.0, 1.0, 1.0, 1.0, 2.0])], "Time timestamp, A double")
    assert [r[2] for r in returns.panel_returns(panel).collect()] == [None] * 5


@pytest.mark.parametrize("size", [5, 7, 4096])
def test_panel_equals_pandas_across_chunks(frame, size):
    rng = random.Random(size)
    times = sorted(rng.sample(range(2000), 90))
    made = pd.DataFrame({"Time": [bar(t) for t in times]})
    for ticker, share in (("A", 0.2), ("B", 0.9), ("C", 1.0)):
        made[ticker] = [None if rng.random() < share else rng.randint(1, 50) * 1.0 for _ in times]
    made["C"] = [3.0] + [None] * 88 + [6.0]
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in made.itertuples(index=False)]
    panel = frame([(t.to_pydatetime(), *p) for t, *p in rows], "Time timestamp, A double, B double, C double")
    found = {(r.Time, r.Ticker): r.Return_h_60 for r in returns.panel_returns(panel, size=size).collect()}
    filled = made[["A", "B", "C"]].astype(float).ffill()
    change = filled / filled.shift(4) - 1
    assert len(found) == 270
    for i, t in enumerate(times):
        for ticker in "ABC":
            expected = change[ticker][i]
            assert found[bar(t), ticker] == (None if pd.isna(expected) else pytest.approx(expected))


def test_holding_must_be_whole_bars(frame):
    with pytest.raises(ValueError):
        returns.panel_returns(frame([(bar(0), 1.0)], "Time timestamp, A double"), holding_minutes=50)


def test_positions(frame):
    rng = random.Random(4)
    rows = [(bar(t), k) for k in "AB" for t in rng.sample(range(5000), 60)]
    found = series.with_position(frame(rows, "Time timestamp, Ticker string"), ["Ticker"], "Time").collect()
    for k in "AB":
        mine = sorted((r for r in found if r.Ticker == k), key=lambda r: r.Time)
        assert [r.position for r in mine] == list(range(60))


@pytest.fixture
def model_rows(frame):
    rng = random.Random(5)
    rows = [(bar(i * 7), k, rng.random() - 0.5, i) for k, n in (("A", 40), ("B", 33), ("C", 32)) for i in range(n)]
    return frame(rows, "Time timestamp, Ticker string, Return_h_60 double, n int")


@pytest.mark.parametrize("size", [17, 4096])
def test_lags_and_deltas(model_rows, size):
    found = returns.lag_delta_features(model_rows, size=size).collect()
    assert sorted((r.Ticker, r.n) for r in found) == [("A", n) for n in range(32, 40)] + [("B", 32)]
    truth = {(r.Ticker, r.n): r.Return_h_60 for r in model_rows.collect()}
    for r in found:
        assert r.return_sign == (r.Return_h_60 > 0)
        for k in returns.SHIFTS:
            assert r[f"lag_{k}"] == truth[r.Ticker, r.n - k]
            assert r[f"lag_{k}"] + r[f"delta{k}"] == pytest.approx(r.Return_h_60)


def test_both_steps_equal_one_after_the_other(model_rows):
    one = returns.lag_delta_features(model_rows).drop("return_sign")
    two = returns.add_lags(returns.add_deltas(model_rows)).select(*one.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert returns.add_deltas(model_rows).count() == 24 + 17 + 16


def test_clean_and_label(frame):
    stock = returns.clean_returns(
        frame(
            [("2016-03-08 12:00:00", "A", "0.1"), ("2016-03-08 12:01:00", "A", "0"), ("2016-03-08 12:02:00", "A", "-0.1"), ("2016-03-08 12:03:00", "A", "x")],
            "Lagged_Time string, variable string, Return string",
        )
    )
    events = frame(
        [(i, f"2016-03-08 12:0{m}:00", t) for i, (m, t) in enumerate([(0, "A"), (0, "A"), (1, "A"), (2, "A"), (3, "A"), (4, "A"), (0, "B")])],
        "id int, TimeStamp string, Ticker string",
        ["TimeStamp"],
    )
    for salts in (1, 16):
        found = returns.label_events(events, stock, salts=salts, salt_by=("id",)).orderBy("id").collect()
        assert [(r.id, r.Return, r.Label) for r in found] == [(0, 0.1, 1.0), (1, 0.1, 1.0), (2, 0.0, 0.0), (3, -0.1, 0.0)]


def test_merge_drops_incomplete(frame):
    sentiment = frame([(bar(0), "A", 0.1), (bar(0), "B", None), (bar(1), "A", 0.2), (bar(2), "A", 0.2)], "Time timestamp, Ticker string, s double")
    changes = frame([(bar(0), "A", 0.5), (bar(0), "B", 0.5), (bar(1), "A", None)], "Time timestamp, Ticker string, Return_h_60 double")
    assert [tuple(r) for r in returns.merge_returns(sentiment, changes).collect()] == [(bar(0), "A", 0.1, 0.5)]


def test_no_window_spans_a_whole_series(model_rows):
    plan = returns.lag_delta_features(model_rows)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_events_of_keys_alone_and_with_maps(spark, frame):
    stock = frame([("2016-03-08 12:00:00", "A", 0.1)], "TimeStamp string, Ticker string, Return double", ["TimeStamp"])
    events = frame([("2016-03-08 12:00:00", "A")], "TimeStamp string, Ticker string", ["TimeStamp"])
    assert [r.Label for r in returns.label_events(events, stock).collect()] == [1.0]
    mapped = events.withColumn("more", F.create_map(F.lit("a"), F.lit(1)))
    assert [r.more for r in returns.label_events(mapped, stock).collect()] == [{"a": 1}]
