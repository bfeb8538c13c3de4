import datetime as dt
import gzip
import json

import pytest

from tonetape.sources import events, tables

MONDAY, FRIDAY = dt.date(2016, 3, 7), dt.date(2016, 3, 4)


def event(stid, **fields):
    return json.dumps({"stid": stid, "standardTimestamp": "2016-03-07T12:00:00.5Z", "companies": [{"count": 3, "ric": "A.O", "sentiment_score": 0.5}], **fields})


@pytest.fixture
def logs(tmp_path):
    def write(name, lines):
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        body = "\n".join(lines)
        if name.endswith(".gz"):
            path.write_bytes(gzip.compress(body.encode()))
        else:
            path.write_text(body)

    write("20160304/part-1.log.gz", [event("fri")])
    write("20160305/part-1.log", [event("sat")])
    write("20160307/part-1.log", [event("mon1"), "{broken", event("mon2", unknown=1)])
    write("20160307/part-2.log", [event("mon3", companies=None)])
    return str(tmp_path / "logs")


def test_days_skip_weekends_and_missing_folders(spark, logs):
    rows = events.read_days(spark, logs, FRIDAY, dt.date(2016, 3, 8), bad_lines=True).cache()
    assert sorted((str(r.day), r.stid) for r in rows.filter("stid is not null").collect()) == [
        ("2016-03-04", "fri"),
        ("2016-03-07", "mon1"),
        ("2016-03-07", "mon2"),
        ("2016-03-07", "mon3"),
    ]
    report = {str(r.day): (r.rows, r.bad_lines, r.skipped) for r in events.day_report(rows, FRIDAY, dt.date(2016, 3, 8)).collect()}
    assert report == {"2016-03-04": (1, 0, False), "2016-03-07": (4, 1, False), "2016-03-08": (0, 0, True)}
    one_part = events.read_days(spark, logs, FRIDAY, MONDAY, files="part-2*")
    assert [(str(r.day), r.stid) for r in one_part.collect()] == [("2016-03-07", "mon3")]
    with_saturday = events.read_days(spark, logs, FRIDAY, MONDAY, weekends=True)
    assert "sat" in {r.stid for r in with_saturday.collect()}


def test_no_folder_at_all_gives_no_rows(spark, logs):
    rows = events.read_days(spark, logs, dt.date(2015, 1, 1), dt.date(2015, 1, 2), bad_lines=True)
    assert rows.count() == 0 and "day" in rows.columns


def test_missing_path_raises(spark, logs):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        events.read_events(spark, f"{logs}/20990101").count()


def test_numbers_arrive_as_text(spark, logs):
    (row,) = events.read_events(spark, f"{logs}/20160304", spread=3).collect()
    assert row.companies[0].asDict() == {"count": "3", "ric": "A.O", "sentiment": None, "sentiment_score": "0.5"}


def test_manifest_names_its_sources(spark, logs):
    pairs = [("20160304/part-1.log.gz", "20160304part-1"), ("20160307/part-2.log", "20160307part-2")]
    found = events.read_manifest(spark, logs, pairs).collect()
    assert sorted((r.source, r.stid) for r in found) == [("20160304part-1", "fri"), ("20160307part-2", "mon3")]


def test_landing_replaces_only_its_days(spark, logs, tmp_path):
    target = str(tmp_path / "landed")
    both = events.read_days(spark, logs, FRIDAY, MONDAY)
    events.land_events(both, target)
    events.land_events(both.filter("day = '2016-03-07' and stid = 'mon1'"), target)
    found = events.read_landed(spark, target, FRIDAY, MONDAY).collect()
    assert sorted(r.stid for r in found) == ["fri", "mon1"]
    assert events.read_landed(spark, target, MONDAY, MONDAY).count() == 1


def test_ticker_list_and_returns(spark, tmp_path):
    (tmp_path / "list.csv").write_text("MMM\nBRK-B\n")
    assert [r.Ticker for r in tables.read_ticker_list(spark, str(tmp_path / "list.csv")).collect()] == ["MMM", "BRK-B"]
    (tmp_path / "returns.csv").write_text("Lagged_Time,variable,Return\n2016-03-08 12:00:00,A,0.5\n")
    assert tuple(tables.read_returns(spark, str(tmp_path / "returns.csv")).first()) == ("2016-03-08 12:00:00", "A", "0.5")


def test_panel_and_vectors_take_names_from_the_header(spark, tmp_path):
    (tmp_path / "panel.csv").write_text("Time,A,BRK-B\n2016-03-08 12:00:00,1.5,\n")
    panel = tables.read_price_panel(spark, str(tmp_path / "panel.csv"))
    assert panel.dtypes == [("Time", "timestamp"), ("A", "double"), ("BRK-B", "double")]
    assert tuple(panel.first()) == (dt.datetime(2016, 3, 8, 12), 1.5, None)
    (tmp_path / "vectors.csv").write_text(",1,2,Label\n0,0.5,0.25,1\n")
    vectors = tables.read_vectors(spark, str(tmp_path / "vectors.csv"))
    assert tuple(vectors.first())[1:] == (0.5, 0.25, 1.0)


@pytest.mark.parametrize("compression,header", [("bzip2", False), ("gzip", True), (None, True)])
def test_csv_sinks(spark, frame, tmp_path, compression, header):
    rows = frame([(1, "a"), (2, None)], "n int, s string")
    tables.write_csv(rows, str(tmp_path / "out"), header=header, compression=compression)
    back = spark.read.schema(rows.schema).csv(str(tmp_path / "out"), header=header)
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]


def test_day_csv_and_bin_sentiment(spark, frame, tmp_path):
    rows = frame(
        [("2016-03-07 00:15:00", "A", 0.5, 0.1, 5, 1, 2, 1, 1), ("2016-03-08 00:15:00", "A", 0.25, None, 5, 1, 2, 1, 1)],
        "Time string, Ticker string, sentiment_mean double, sentiment_std double, sentiment_count long, event_pview_count long, "
        "event_click_count long, event_search_count long, event_share_count long",
        ["Time"],
    )
    out = str(tmp_path / "bins")
    dated = rows.withColumn("day", rows["Time"].cast("date"))
    tables.write_day_csv(dated, out, one_file=True)
    tables.write_day_csv(dated.filter("day = '2016-03-08'"), out)
    back = tables.read_bin_sentiment(spark, out + "/day=*")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_lines(spark, frame, tmp_path):
    tables.write_lines(frame([("a", None, "b")], "x string, y string, z string"), str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a,None,b"]
