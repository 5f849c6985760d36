from __future__ import annotations

import base64
import datetime as dt

import pytest
from conftest import rows

from cohortwise.operators import spanlog

RAW = """span_id long, ts timestamp, tool_name string, success boolean, x_user_id string, x_user_email string,
         x_forwarded_for string, remote_host string, handshake_name string, session_id string"""
START = dt.datetime(2024, 1, 1)


def coded(text: bytes) -> str:
    return "b64:" + base64.b64encode(text).decode()


@pytest.mark.parametrize(("user", "email", "kind", "known", "address"), [
    ("507f", None, "librechat", "507f", None),
    ("abc", "user@example.com", "librechat", "abc", "user@example.com"),
    (None, coded(b"user+tag@example.com"), "direct", None, "user+tag@example.com"),
    (None, None, "direct", None, None),
    ("", "", "librechat", None, None),
    ("abc", "b64:x", "unknown", None, None),
    (None, coded(b"\xffa"), "direct", None, "�a"),
    (None, "b64:dXNl clB*leGFtcGxl", "direct", None, "userPexample"),
    ("u", "b64:dXNlckBleGFtcGxlLm9yZw", "unknown", None, None),
    (None, coded(b"x" * 1_200_000), "direct", None, "x" * 1_200_000),
])
def test_identity(spark, user, email, kind, known, address):
    raw = spark.createDataFrame([(1, START, "t", True, user, email, None, "h", "c", "s")], RAW)
    got = spanlog.normalize_spans(raw).first()
    assert (got.client_kind, got.enduser_id, got.user_email) == (kind, known, address)


@pytest.mark.parametrize(("forwarded", "ip"), [(" 1.2.3.4 , 5.6.7.8", "1.2.3.4"), ("9.9.9.9", "9.9.9.9"), ("  ", "host"), (None, "host")])
def test_client_address(spark, forwarded, ip):
    raw = spark.createDataFrame([(1, START, "t", True, None, None, forwarded, "host", "", "s")], RAW)
    got = spanlog.normalize_spans(raw).first()
    assert got.client_ip == ip and got.client_name is None


SPANS = "ts timestamp, success boolean, client_name string, client_kind string, tool_name string"


def spans(spark, minutes, success=False, name="c"):
    return spark.createDataFrame([(START + dt.timedelta(minutes=m), success, name, "direct", "t") for m in minutes], SPANS)


def test_error_levels_need_more_than_the_threshold(spark):
    at = spanlog.error_alerts(spans(spark, [0.5] * 10))
    assert at.count() == 0
    assert {r.level for r in spanlog.error_alerts(spans(spark, [0.5] * 11)).collect()} == {"warning"}
    assert {r.level for r in spanlog.error_alerts(spans(spark, [0.5] * 20)).collect()} == {"warning"}
    assert {r.level for r in spanlog.error_alerts(spans(spark, [0.5] * 21)).collect()} == {"critical"}
    # nine minutes apart they share one window, ten minutes apart none
    assert spanlog.error_alerts(spans(spark, [0] * 6 + [9] * 5)).count() == 1
    assert spanlog.error_alerts(spans(spark, [0] * 6 + [10] * 5)).count() == 0


def test_only_unattributed_requests_count(spark):
    assert spanlog.unattributed_alerts(spans(spark, [1] * 60)).count() == 0
    nameless = spanlog.unattributed_alerts(spans(spark, [1] * 51, name=None))
    assert {r.level for r in nameless.collect()} == {"critical"} and nameless.count() == 30


def test_heartbeat_gaps(spark):
    day = 24 * 60
    minutes = [0, 10, 25, 40.5, 60, day - 5, day + 5, 3 * day, 3 * day + 0.2]
    got = rows(spanlog.heartbeat_alerts(spans(spark, minutes)))
    want = [(a, b) for a, b in zip(minutes, minutes[1:]) if b - a > 15]
    assert got == sorted(((START + dt.timedelta(minutes=a + 15), START + dt.timedelta(minutes=b)) for a, b in want), key=str)


def test_missing_facet_is_dropped(spark):
    both = spans(spark, [1, 2], name=None).union(spans(spark, [3]))
    assert rows(spanlog.top_by(both, "client_name")) == [("c", 1)]
    assert spanlog.requests_cube(both).count() == 1
    assert spanlog.requests_over_time(both, "client_name").count() == 1


def test_nested_limits(spark):
    data = [(START, True, f"n{i}", f"k{j}", f"t{k}") for i in range(4) for j in range(3) for k in range(3) for _ in range(i + j + k + 1)]
    got = spanlog.requests_cube(spark.createDataFrame(data, SPANS), (2, 1, 2))
    assert rows(got, "client_name", "client_kind", "tool_name", "requests") == [
        ("n2", "k2", "t1", 6), ("n2", "k2", "t2", 7), ("n3", "k2", "t1", 7), ("n3", "k2", "t2", 8)]


def test_reports_without_a_limit(spark):
    data = spark.createDataFrame([(i, "2024-01-01 00:00:00", i % 2 == 0, f"c{i % 40}", f"k{i % 20}", f"t{i % 30}") for i in range(400)],
                                 "span_id long, ts string, success boolean, client_name string, client_kind string, tool_name string")
    assert spanlog.top_by(data, "client_name", None).count() == 40
    assert spanlog.requests_over_time(data, "client_name", None).count() == 40
    assert spanlog.errors_over_time(data, k=None).count() == 20
    every = data.select("client_name", "client_kind", "tool_name").distinct().count()
    assert spanlog.requests_cube(data, (None, None, None)).count() == every
    assert spanlog.top_per_bucket(data, "client_kind", None).count() == 20


def test_sketches_of_any_range_are_within_their_error(spark):
    data = spark.range(60_000).selectExpr(
        "timestamp_seconds(1704067200 + id * 3) as ts", "cast(hash(id) % 9000 as string) as enduser_id", "cast(id % 20000 as string) as session_id",
        "cast(id % 3 as string) as client_ip")
    sketches = spanlog.distinct_sketches(data)
    got = {r.bucket: r for r in spanlog.distinct_from_sketches(sketches, "1 day").collect()}
    for r in spanlog.distinct_over_time(data, "1 day").collect():
        near = got[r.bucket]
        assert near.requests == r.requests and near.ips == 3
        assert abs(near.users - r.users) <= 0.065 * r.users and abs(near.sessions - r.sessions) <= 0.065 * r.sessions
    some = spanlog.distinct_from_sketches(sketches, "1 day", "2024-01-01 06:00:00", "2024-01-01 07:00:00").first()
    assert some.requests == 1200 and abs(some.sessions - 1200) <= 80
