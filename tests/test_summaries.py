import pytest

from tonetape.operators import summaries


def test_score_summary_counts_null_scores(frame):
    rows = frame([("a", 0.2), ("a", None), ("b", 1.0), (None, 0.5), (None, 0.5), (None, None)], "d string, company_sentiment_score double")
    found = [tuple(r) for r in summaries.score_summary(rows, "d").collect()]
    assert found == [(None, 0.5, 3), ("a", pytest.approx(0.2), 2), ("b", 1.0, 1)]
    assert summaries.top_summary(rows, "d", n=1).count() == 1
    assert [r["count"] for r in summaries.counts_by(rows, "d").collect()] == [3, 2, 1]
    assert summaries.distinct_values(rows, "d").count() == 3


def test_hours(frame):
    rows = frame([("2016-03-08 23:10:00",), ("2016-03-09 23:00:00",), ("2016-03-09 01:00:00",)], "TimeStamp string", ["TimeStamp"])
    assert [tuple(r) for r in summaries.hour_histogram(rows).collect()] == [(1, 1), (23, 2)]


def test_positive_ratio(frame):
    assert summaries.positive_ratio(frame([(0.1,), (0.0,), (-0.1,), (2.0,)], "y double"), "y").first().positive_ratio == 0.5
    assert summaries.positive_ratio(frame([(True,), (False,)], "y boolean"), "y").first().positive_ratio == 0.5


def test_pair_profile(frame):
    rows = frame([(0, 1.0), (0, 3.0), (1, 5.0)], "x int, y double")
    found = summaries.pair_profile(rows, "x", "y").orderBy("x").collect()
    assert [tuple(r)[:5] for r in found] == [(0, 2, 2.0, 1.0, 3.0), (1, 1, 5.0, 5.0, 5.0)]
    assert found[0].corr_xy == pytest.approx(0.8660254)
