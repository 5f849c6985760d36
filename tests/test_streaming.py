from __future__ import annotations

import datetime as dt

import pytest
from conftest import TESTDATA, rows
from pyspark.sql import functions as F

from cohortwise.operators import spanlog
from cohortwise.streaming import spans as streams

SPANS = "span_id long, ts timestamp, success boolean, client_name string, client_kind string, enduser_id string, session_id string, client_ip string"
START = dt.datetime(2024, 1, 1)


def span(i, minute, success=False, name="c"):
    return (i, START + dt.timedelta(minutes=minute), success, name, "direct", None, f"s{i % 3}", "ip")


class Log:
    """A folder to which files of spans are added, and a stream over it."""

    def __init__(self, spark, path):
        self.spark, self.path, self.files = spark, str(path / "in"), 0

    def add(self, *rows_):
        self.spark.createDataFrame(list(rows_), SPANS).coalesce(1).write.parquet(f"{self.path}/f{self.files:03d}")
        self.files += 1

    def stream(self):
        return self.spark.readStream.schema(SPANS).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/*")


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def test_stream_over_several_batches_equals_batch(spark, log, tmp_path):
    data = [span(i, i * 7 % 300 / 3, i % 2 == 0, f"c{i % 3}") for i in range(90)]
    for part in (data[:30], data[30:60], data[60:]):
        log.add(*part)
    out = str(tmp_path / "out")
    streams.run_available(streams.requests_over_time(log.stream(), "client_name"), out)
    batch = spanlog.requests_over_time(spark.createDataFrame(data, SPANS), "client_name", 100)
    assert rows(streams.latest(spark, out, ["bucket", "client_name"])) == rows(batch)


def test_restart_goes_on_where_it_stopped(spark, log, tmp_path):
    out = str(tmp_path / "out")
    log.add(*[span(i, 1) for i in range(8)])
    streams.run_available(streams.error_alerts(log.stream()), out)
    log.add(*[span(i, 2) for i in range(8, 30)])
    streams.run_available(streams.error_alerts(log.stream()), out)
    got = streams.latest(spark, out, ["window_start", "window_end", "client_name"])
    batch = spanlog.error_alerts(spark.createDataFrame([span(i, 1 if i < 8 else 2) for i in range(30)], SPANS))
    columns = ["window_start", "window_end", "client_name", "requests", "level"]
    assert rows(got, *columns) == rows(batch, *columns)


def test_too_late_spans_are_dropped(spark, log, tmp_path):
    log.add(span(1, 600), span(2, 601))
    log.add(span(3, 5), span(4, 590))
    log.add(span(5, 6), span(6, 602))
    out = str(tmp_path / "out")
    streams.run_available(streams.requests_over_time(log.stream(), "client_name"), out, allow_late=True)
    got = {r.bucket.hour: r.requests for r in streams.latest(spark, out, ["bucket", "client_name"]).collect()}
    # lateness is judged by the watermark the batch before started with: of the two spans
    # that are ten hours late, the second batch's still counts and the third's does not
    assert got == {10: 3, 9: 1, 0: 1}


def test_unattributed_and_distinct(spark, log, tmp_path):
    log.add(*[span(i, 1, name=None) for i in range(60)])
    streams.run_available(streams.unattributed_alerts(log.stream()), str(tmp_path / "a"))
    got = streams.latest(spark, str(tmp_path / "a"), ["window_start", "window_end"])
    assert got.count() == 30 and {r.level for r in got.collect()} == {"critical"}
    streams.run_available(streams.distinct_over_time(log.stream()), str(tmp_path / "d"))
    assert rows(streams.latest(spark, str(tmp_path / "d"), ["bucket"]), "requests", "users", "sessions", "ips") == [(60, 0, 3, 1)]


def test_heartbeat_opens_and_closes_over_batches(spark, log, tmp_path):
    provider = spark.conf.get(streams.PROVIDER)
    spark.conf.set(streams.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    other = spark.conf.get(streams.PROVIDER)
    try:
        for minutes in ((0, 5, 12), (40, 41), (300, 301), (500,)):
            log.add(*[span(m, m) for m in minutes], *[span(1000 + m, m + 1, name="other") for m in minutes if m < 300], span(9, minutes[0], name=None))
        out = str(tmp_path / "out")
        streams.run_available(streams.heartbeat_alerts(log.stream(), late="0 seconds"), out, "append", custom_state=True)
        assert spark.conf.get(streams.PROVIDER) == other  # as it was
        at = lambda m: START + dt.timedelta(minutes=m)
        last = rows(streams.latest(spark, out, ["client_name", "alert_start"]), "client_name", "alert_start", "alert_end")
        assert last == sorted([("c", at(27), at(40)), ("c", at(56), at(300)), ("c", at(316), at(500)), ("other", at(28), at(41)), ("other", at(57), None)], key=str)
        batch = spanlog.heartbeat_alerts(spark.read.schema(SPANS).parquet(f"{log.path}/*"), by="client_name", with_open=True)
        assert rows(batch, "client_name", "alert_start", "alert_end") == last
    finally:
        spark.conf.set(streams.PROVIDER, provider)


@pytest.mark.parametrize("k", [1, 2, None])
def test_top_per_bucket_over_several_batches(spark, log, tmp_path, k):
    """The best of early batches can fall behind later; ties go by name."""
    data = [span(i, i % 170, name=f"c{(i * i) % 7 if i < 60 else i % 5}") for i in range(150)] + [span(200 + i, 5, name=None) for i in range(9)]
    for a in range(0, 159, 40):
        log.add(*data[a:a + 40])
    out = str(tmp_path / "out")
    streams.run_available(streams.top_per_bucket(log.stream(), "client_name", k, late="4 hours"), out, custom_state=True)
    batch = spanlog.top_per_bucket(spark.createDataFrame(data, SPANS), "client_name", k)
    columns = ["bucket", "client_name", "requests", "place"]
    assert rows(streams.best_per_bucket(spark, out, "client_name", k), *columns) == rows(batch, *columns)


def test_state_of_passed_buckets_is_dropped(spark, log, tmp_path):
    for hour in range(4):
        log.add(*[span(100 * hour + i, 60 * hour + i, name=f"c{i % 3}") for i in range(30)])
    out = str(tmp_path / "out")
    streams.run_available(streams.top_per_bucket(log.stream(), "client_name", 2, late="0 seconds"), out, custom_state=True)
    batch = spanlog.top_per_bucket(spark.read.schema(SPANS).parquet(f"{log.path}/*"), "client_name", 2)
    assert rows(streams.best_per_bucket(spark, out, "client_name", 2)) == rows(batch, "bucket", "client_name", "requests", "place")


def test_first_appearances_are_exact(spark, log, tmp_path):
    data = [span(i, i * 37 % 4000) for i in range(300)]
    for a in range(0, 300, 100):
        log.add(*data[a:a + 100])
    out = str(tmp_path / "out")
    streams.run_available(streams.first_seen(log.stream(), "session_id", late="5 days"), out, "append")
    got = spark.read.parquet(f"{out}/rows").groupBy("bucket").count()
    batch = spanlog.distinct_over_time(spark.createDataFrame(data, SPANS))
    assert rows(got) == rows(batch, "bucket", "sessions")


def test_sample_log_as_stream(spark):
    stream = streams.span_stream(spark, str(TESTDATA / "sf0.001"))
    assert stream.isStreaming and "client_name" in stream.columns


def test_replay_of_unordered_files_loses_nothing(spark, tmp_path):
    events = spark.read.parquet(str(TESTDATA / "sf0.001" / "events.parquet"))
    for i in range(4):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.parquet(f"{tmp_path}/raw/{i}")
        part = next((tmp_path / "raw" / str(i)).glob("part-*.parquet"))
        (tmp_path / f"events{i}.parquet").write_bytes(part.read_bytes())
    whole = streams.requests_over_time(streams.span_stream(spark, str(tmp_path)), "client_kind")
    streams.run_available(whole, f"{tmp_path}/out", "append")
    streams.run_available(streams.requests_over_time(streams.span_stream(spark, str(tmp_path)), "client_kind"), f"{tmp_path}/upd")
    got = streams.latest(spark, f"{tmp_path}/upd", ["bucket", "client_kind"])
    assert got.agg(F.sum("requests")).first()[0] == events.count()
    with pytest.raises(RuntimeError, match="too late"):
        streams.run_available(streams.requests_over_time(streams.span_stream(spark, str(tmp_path), 1), "client_kind"), f"{tmp_path}/one")
