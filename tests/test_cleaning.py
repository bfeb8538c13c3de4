import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonetape.operators import companies, dummies, frames
from tonetape.schemas import COMPANY

EVENT = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("companies", T.ArrayType(COMPANY))])


def company(count="1", ric="A.O", score="0.5"):
    return {"count": count, "ric": ric, "sentiment": "pos", "sentiment_score": score}


def test_explode_drops_events_without_companies(spark):
    rows = spark.createDataFrame([(1, [company(), company()]), (2, []), (3, None)], EVENT)
    assert [r.id for r in companies.explode_companies(rows).collect()] == [1, 1]


def test_select_company_types_and_drops(spark):
    cells = [company(ric=None), company(score=None), company(score="x"), company(ric=""), company("3.7"), company("7")]
    rows = spark.createDataFrame([(1, cells)], EVENT)
    found = companies.select_company(companies.explode_companies(rows)).collect()
    assert [(r.company_count, r.Ticker, r.company_sentiment_score) for r in found] == [
        (1, "", 0.5),
        (None, "A", 0.5),
        (7, "A", 0.5),
    ]


def test_slim_keeps_text(spark):
    rows = spark.createDataFrame([(1, [company(score="x"), company(ric=None)])], EVENT)
    slim = companies.slim_companies(rows.withColumn("standardTimestamp", F.lit("t")))
    assert [tuple(r) for r in slim.collect()] == [("t", "x", "A.O")]


def test_useful_fraction(spark):
    rows = spark.createDataFrame([(1, [company()]), (2, []), (3, None), (4, [company()] * 2)], EVENT)
    assert tuple(companies.useful_fraction(rows).first()) == (4, 2, 0.5)
    assert companies.with_companies(rows).count() == 2


def test_flatten_names(spark):
    rows = spark.createDataFrame([(1, [company()])], EVENT)
    flat = companies.flatten_companies(rows)
    assert flat.columns == ["id", *(f"companies_{f}" for f in ("count", "ric", "sentiment", "sentiment_score"))]


def test_keep_listed_is_exact_and_keeps_copies(frame):
    rows = frame([("BRK-B", 1), ("BRK-B", 2), ("BRK.B", 3), (None, 4)], "Ticker string, n int")
    listed = frame([("BRK-B",), ("BRK-B",)], "Ticker string")
    assert sorted(r.n for r in companies.keep_listed(rows, listed).collect()) == [1, 2]


def test_category_dummies(frame):
    rows = frame([("click",), (None,), ("other",)], "mappedEvent string").select(*dummies.event_dummies())
    assert [tuple(r) for r in rows.collect()] == [(0, 1, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    devices = frame([("Personal computer",)], "deviceType string")
    assert devices.select(*dummies.device_dummies()).columns[0] == "is_device_Personal_computer"
    assert devices.select(*dummies.device_dummies(rename=False)).columns[0] == "is_device_Personal computer"


def domains(frame, counts):
    return frame([(d,) for d, n in counts.items() for _ in range(n)], "refDomain string")


def test_top_labels_follow_the_best_domain(frame):
    rows = domains(frame, {"www.a.com": 9, "b.org": 7, "m.a.com": 5, "localhost": 20, "c.net": 3, None: 30})
    assert dummies.label_names(dummies.top_labels(rows, 2)) == ["a", "b"]


def test_natural_top_ignores_counts(frame):
    rows = domains(frame, {"a.com": 9, "z.org": 1, "m.net": 5, None: 2})
    assert [r.refDomain for r in dummies.natural_top(rows, 2).collect()] == ["z.org", "m.net"]
    assert dummies.label_names(dummies.natural_top_labels(rows, 2)) == ["z", "m"]


def test_domain_dummy_modes(frame):
    rows = domains(frame, {"www.google.com": 1, "google": 1})
    flag = lambda mode: dummies.add_domain_dummies(rows, ["google"], mode=mode).collect()
    assert {r.refDomain: r.is_domain_google for r in flag("intended")} == {"www.google.com": 1, "google": 0}
    assert {r.refDomain: r.is_domain_google for r in flag("literal")} == {"www.google.com": 0, "google": 1}
    with pytest.raises(ValueError):
        dummies.add_domain_dummies(rows, ["x"], mode="other")


def test_stack_fills(spark, frame):
    a, b = frame([(1, "x")], "id int, a string"), frame([(2, 0.5)], "id int, b double")
    found = frames.stack([frames.empty(spark, a.schema), a, b]).orderBy("id").collect()
    assert [tuple(r) for r in found] == [(1, "x", None), (2, None, 0.5)]


def test_model_frame_and_checks(frame):
    rows = frame(
        [(0, 1.0, 1, 0.1, -0.2), (1, 2.0, 2, 0.1, 0.2), (2, None, 0, 0.0, 0.0), (3, float("nan"), 1, 0.0, 0.1), (4, 3.0, 0, 0.0, 0.3)],
        "i int, f double, Label int, ROE_excess_change double, ROE_change double",
    )
    kept = frames.model_frame(rows, drop_middle=True)
    assert [(r.i, r.ROE_excess_change_sign, r.ROE_change_sign) for r in kept.collect()] == [(0, True, False), (4, False, True)]
    assert frames.model_frame(rows).count() == 3
    assert frames.null_counts(rows).first().f == 2
    with pytest.raises(ValueError):
        frames.require_complete(rows)
    assert frames.require_complete(kept) is kept
    assert frames.feature_names(rows, 1, 2, ["ROE_change"]) == ["f", "Label", "ROE_change"]
    assert frames.features_except(rows, "Label", "i") == ["f", "ROE_excess_change", "ROE_change"]
