"""Request-log queries, in batch and as streams run over the whole log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortwise.operators import spanlog
from cohortwise.registry import Query
from cohortwise.session import shared_dir
from cohortwise.streaming import spans as streams

FAILED = "not success and client_name is not null"


def over_time(by: str, k: int, count: str = "requests", condition: str = "true") -> str:
    return f"""
with kept as (from spans where {by} is not null and {condition})
select time_bucket(interval 1 hour, ts) as bucket, {by}, count(*) as {count} from kept
where {by} in (select {by} from kept group by 1 order by count(*) desc, {by} limit {k}) group by 1, 2"""


def sliding(minutes: int, condition: str, by: str, critical: int, warning: int) -> str:
    keys = f"{by}, " if by else ""
    return f"""
with steps as (
  select {keys}date_trunc('minute', ts) + interval 1 minute - interval 1 minute * unnest(range(1, {minutes} + 1)) as window_start
  from spans where {condition})
select window_start, window_start + interval {minutes} minute as window_end, {keys}count(*) as requests,
  case when count(*) > {critical} then 'critical' else 'warning' end as level
from steps group by window_start, {keys.rstrip(", ") or "window_start"} having count(*) > {warning}"""


GAPS = """
  select previous + interval 15 minute as alert_start, ts as alert_end
  from (select ts, lag(ts) over (order by ts) as previous from spans) where ts - previous > interval 15 minute"""


def as_ntz(df, *columns):
    """Zone-less times, as the log stores them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def replayed(t, make, mode="update", custom_state=False):
    """Folder of the batches of a stream that has run over the whole log."""
    path = f"{shared_dir(t.spark)}/cohortwise/streams/{uuid.uuid4().hex}"
    streams.run_available(make(streams.span_stream(t.spark, t.directory)), path, mode, custom_state=custom_state)
    return path


def streamed(t, make, keys, mode="update", custom_state=False):
    """Run a stream over the whole log, one state update per batch, and read the final state."""
    return streams.latest(t.spark, replayed(t, make, mode, custom_state), keys)


def heartbeat_stream(t):
    """In a replay nothing is late, so alerts open as soon as the log has passed their start."""
    alerts = streamed(t, lambda s: streams.heartbeat_alerts(s, late="0 seconds"), ["client_name", "alert_start"], "append", True)
    return as_ntz(alerts, "alert_start", "alert_end")


def top_stream(by, k, failed=False, count="requests"):
    def build(t):
        path = replayed(t, lambda s: streams.top_per_bucket(s.where(~F.col("success")) if failed else s, by, k, shards=2), "update", True)
        return as_ntz(streams.best_per_bucket(t.spark, path, by, k).withColumnRenamed("requests", count), "bucket")

    return build


def distinct_stream(column, name):
    """Exact distinct values per day: the number of first appearances."""

    def build(t):
        path = replayed(t, lambda s: streams.first_seen(s, column), "append")
        seen = t.spark.read.parquet(f"{path}/rows")
        return as_ntz(seen.groupBy("bucket").agg(F.count("*").alias(name)), "bucket")

    return build


def near(estimated, exact, error):
    """Estimates beside exact counts: whether each is within `error` of it."""
    names = list(spanlog.PEOPLE.values())
    both = estimated.join(exact.select("bucket", *[F.col(n).alias(f"true_{n}") for n in names]), "bucket")
    return both.select("bucket", "requests", *[
        (F.abs(F.col(n) - F.col(f"true_{n}")) <= error * F.col(f"true_{n}")).alias(f"{n}_near") for n in names])


NEAR = """select time_bucket(interval 1 day, ts) as bucket, count(*) as requests, true as users_near, true as sessions_near, true as ips_near
  from spans group by 1"""


def top_over_time(by, k, count="requests", condition="true"):
    return f"""
select time_bucket(interval 1 hour, ts) as bucket, {by}, count(*) as {count},
  row_number() over (partition by bucket order by count(*) desc, {by}) as place
from spans where {by} is not null and {condition} group by 1, 2 qualify place <= {k}"""


CLIENT_GAPS = """
with steps as (
  select client_name, ts, lead(ts) over (partition by client_name order by ts) as following from spans where client_name is not null)
select client_name, ts + interval 15 minute as alert_start, following as alert_end from steps
where following - ts > interval 15 minute or following is null and ts + interval 15 minute < (select max(ts) from spans)"""


QUERIES = {
    "r01_request_total": Query(lambda t: spanlog.request_total(t.spans), "select count(*) as requests from spans"),
    "r02_distinct_users": Query(
        lambda t: spanlog.distinct_users(t.spans),
        "select count(distinct enduser_id) as users from spans where enduser_id is not null"),
    "r03_distinct_sessions": Query(
        lambda t: spanlog.distinct_sessions(t.spans), "select count(distinct session_id) as sessions from spans"),
    "r04_distinct_ips": Query(lambda t: spanlog.distinct_ips(t.spans), "select count(distinct client_ip) as ips from spans"),
    "r05_requests_over_time": Query(
        lambda t: as_ntz(spanlog.requests_over_time(t.spans, "client_name", 10), "bucket"), over_time("client_name", 10)),
    "r05_requests_over_time_top_two": Query(
        lambda t: as_ntz(spanlog.requests_over_time(t.spans, "client_name", 2), "bucket"), over_time("client_name", 2)),
    "r06_requests_by_kind_over_time": Query(
        lambda t: as_ntz(spanlog.requests_over_time(t.spans, "client_kind", 5), "bucket"), over_time("client_kind", 5)),
    "r07_top_users": Query(
        lambda t: spanlog.top_by(t.spans, "enduser_id"),
        """select enduser_id, count(*) as requests from spans where enduser_id is not null group by 1
           order by 2 desc, 1 limit 10"""),
    "r08_top_ips": Query(
        lambda t: spanlog.top_by(t.spans, "client_ip"),
        "select client_ip, count(*) as requests from spans group by 1 order by 2 desc, 1 limit 10"),
    "r09_requests_cube": Query(
        lambda t: spanlog.requests_cube(t.spans, (3, 1, 4)),
        """
with counts as (select client_name, client_kind, tool_name, count(*) as requests from spans where client_name is not null group by all),
names as (select client_name from counts group by 1 order by sum(requests) desc, 1 limit 3),
kinds as (select client_name, client_kind from counts group by 1, 2
  qualify row_number() over (partition by client_name order by sum(requests) desc, client_kind) <= 1)
select * from counts where client_name in (from names) and (client_name, client_kind) in (from kinds)
qualify row_number() over (partition by client_name, client_kind order by requests desc, tool_name) <= 4"""),
    "r10_errors_over_time": Query(
        lambda t: as_ntz(spanlog.errors_over_time(t.spans), "bucket"), over_time("client_name", 10, "errors", "not success")),
    "r11_heartbeat_alerts": Query(
        lambda t: as_ntz(spanlog.heartbeat_alerts(t.spans), "alert_start", "alert_end"), GAPS),
    "r12_error_alerts": Query(
        lambda t: as_ntz(spanlog.error_alerts(t.spans, {"critical": 2, "warning": 1}), "window_start", "window_end"),
        sliding(10, FAILED, "client_name", 2, 1)),
    "r12_error_alerts_fixed_thresholds": Query(
        lambda t: as_ntz(spanlog.error_alerts(t.spans), "window_start", "window_end"),
        sliding(10, FAILED, "client_name", 20, 10)),
    "r13_unattributed_alerts": Query(
        lambda t: as_ntz(spanlog.unattributed_alerts(t.spans, {"critical": 5, "warning": 2}), "window_start", "window_end"),
        sliding(30, "client_name is null", "", 5, 2)),
    "r14_normalize_spans": Query(
        lambda t: spanlog.normalize_spans(t.raw_spans),
        """
select span_id, ts, tool_name, success, case when x_user_id is null then 'direct' else 'librechat' end as client_kind,
  nullif(handshake_name, '') as client_name, nullif(x_user_id, '') as enduser_id,
  case when starts_with(x_user_email, 'b64:') then decode(from_base64(x_user_email[5:])) else nullif(x_user_email, '') end as user_email,
  session_id, case when trim(coalesce(x_forwarded_for, '')) = '' then remote_host
    else trim(string_split(x_forwarded_for, ',')[1]) end as client_ip
from raw_spans"""),
    "r05_top_per_bucket": Query(
        lambda t: as_ntz(spanlog.top_per_bucket(t.spans, "client_name", 3), "bucket"), top_over_time("client_name", 3)),
    "r05_requests_over_time_stream": Query(top_stream("client_name", 2), top_over_time("client_name", 2)),
    "r05_counts_over_time_stream": Query(
        lambda t: as_ntz(streamed(t, lambda s: streams.requests_over_time(s, "client_name"), ["bucket", "client_name"]), "bucket"),
        """select time_bucket(interval 1 hour, ts) as bucket, client_name, count(*) as requests from spans where client_name is not null group by 1, 2"""),
    "r06_requests_by_kind_stream": Query(top_stream("client_kind", 1), top_over_time("client_kind", 1)),
    "r10_errors_over_time_stream": Query(
        top_stream("client_name", 2, True, "errors"), top_over_time("client_name", 2, "errors", "not success")),
    "r12_error_alerts_stream": Query(
        lambda t: as_ntz(
            streamed(t, lambda s: streams.error_alerts(s, {"critical": 2, "warning": 1}), ["window_start", "window_end", "client_name"]),
            "window_start", "window_end"),
        sliding(10, FAILED, "client_name", 2, 1)),
    "r13_unattributed_alerts_stream": Query(
        lambda t: as_ntz(
            streamed(t, lambda s: streams.unattributed_alerts(s, {"critical": 5, "warning": 2}), ["window_start", "window_end"]),
            "window_start", "window_end"),
        sliding(30, "client_name is null", "", 5, 2)),
    "r02_distinct_over_time": Query(
        lambda t: as_ntz(spanlog.distinct_over_time(t.spans), "bucket"),
        """select time_bucket(interval 1 day, ts) as bucket, count(*) as requests, count(distinct enduser_id) as users,
             count(distinct session_id) as sessions, count(distinct client_ip) as ips from spans group by 1"""),
    # estimates, with a relative standard error of 1.6 % and 5 %: within four of them
    "r02_distinct_from_sketches": Query(
        lambda t: as_ntz(near(
            spanlog.distinct_from_sketches(spanlog.distinct_sketches(t.spans)), spanlog.distinct_over_time(t.spans), 0.065), "bucket"), NEAR),
    "r02_distinct_over_time_stream": Query(
        lambda t: as_ntz(near(streamed(t, streams.distinct_over_time, ["bucket"]), spanlog.distinct_over_time(t.spans), 0.2), "bucket"), NEAR),
    "r02_distinct_users_stream": Query(
        distinct_stream("enduser_id", "users"),
        "select time_bucket(interval 1 day, ts) as bucket, count(distinct enduser_id) as users from spans where enduser_id is not null group by 1"),
    "r03_distinct_sessions_stream": Query(
        distinct_stream("session_id", "sessions"),
        "select time_bucket(interval 1 day, ts) as bucket, count(distinct session_id) as sessions from spans where session_id is not null group by 1"),
    "r04_distinct_ips_stream": Query(
        distinct_stream("client_ip", "ips"),
        "select time_bucket(interval 1 day, ts) as bucket, count(distinct client_ip) as ips from spans where client_ip is not null group by 1"),
    "r11_heartbeat_by_client": Query(
        lambda t: as_ntz(spanlog.heartbeat_alerts(t.spans, by="client_name", with_open=True), "alert_start", "alert_end"), CLIENT_GAPS),
    "r11_heartbeat_stream": Query(heartbeat_stream, CLIENT_GAPS),
}
