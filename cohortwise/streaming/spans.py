"""Streaming forms of the request-log reports and alerts."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import nsmallest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cohortwise.operators.spanlog import (
    ERROR_LEVELS,
    ERROR_SPAN,
    HEARTBEAT_SPAN,
    STEP,
    UNATTRIBUTED_LEVELS,
    UNATTRIBUTED_SPAN,
    level_of,
    with_time,
)

LATE = "1 hour"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MINUTE = 60_000_000


def _windowed(spans: DataFrame, by: list[str], width: str, step: str, late: str):
    return with_time(spans).withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), *by)


def requests_over_time(spans: DataFrame, by: str, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Requests per tumbling window and value, of all values."""
    counts = _windowed(spans.where(F.col(by).isNotNull()), [by], width, width, late).agg(F.count("*").alias("requests"))
    return counts.select(F.col("w.start").alias("bucket"), by, "requests")


def errors_over_time(spans: DataFrame, by: str = "client_name", width: str = "1 hour", late: str = LATE) -> DataFrame:
    failed = spans.where(~F.col("success"))
    return requests_over_time(failed, by, width, late).withColumnRenamed("requests", "errors")


def distinct_over_time(spans: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """Approximate users, sessions and addresses per window: a stream keeps sketches, not sets."""
    counts = _windowed(spans, [], width, width, late).agg(
        F.count("*").alias("requests"),
        F.approx_count_distinct("enduser_id").alias("users"),
        F.approx_count_distinct("session_id").alias("sessions"),
        F.approx_count_distinct("client_ip").alias("ips"),
    )
    return counts.select(F.col("w.start").alias("bucket"), "requests", "users", "sessions", "ips")


def _alerts(spans: DataFrame, by: list[str], span: str, levels: dict[str, int], late: str) -> DataFrame:
    counts = _windowed(spans, by, span, STEP, late).agg(F.count("*").alias("requests"))
    return counts.where(F.col("requests") > min(levels.values())).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "requests",
        level_of(F.col("requests"), levels).alias("level"),
    )


def error_alerts(spans: DataFrame, levels: dict[str, int] = ERROR_LEVELS, span: str = ERROR_SPAN,
                 late: str = LATE) -> DataFrame:
    """Sliding windows in which a client had too many failed requests."""
    failed = spans.where(~F.col("success") & F.col("client_name").isNotNull())
    return _alerts(failed, ["client_name"], span, levels, late)


def unattributed_alerts(spans: DataFrame, levels: dict[str, int] = UNATTRIBUTED_LEVELS,
                        span: str = UNATTRIBUTED_SPAN, late: str = LATE) -> DataFrame:
    """Sliding windows with too many requests that carry no client name."""
    return _alerts(spans.where(F.col("client_name").isNull()), [], span, levels, late)


def first_seen(spans: DataFrame, column: str, width: str = "1 day", late: str = LATE) -> DataFrame:
    """(bucket, value) at the first request of a value in a period: their number per bucket is its exact distinct count.

    The state holds the values of the periods that the watermark has not passed yet.
    """
    rows = with_time(spans).withWatermark("ts", late).where(F.col(column).isNotNull())
    seen = rows.select(F.window("ts", width).alias("w"), column).dropDuplicates(["w", column])
    return seen.select(F.col("w.start").alias("bucket"), column)


class TopCounts(StatefulProcessor):
    """Counts the values of one shard of a bucket; gives its `k` most frequent ones after each batch."""

    def __init__(self, column: str, k: int | None, width_us: int):
        self.column, self.k, self.width_us = column, k, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "value string", "requests long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added: Counter = Counter()
        for frame in rows:
            added.update(frame[self.column].value_counts().to_dict())
        for value, n in added.items():
            before = self.counts.getValue((value,))[0] if self.counts.containsKey((value,)) else 0
            self.counts.updateValue((value,), (before + int(n),))
        every = ((-n, value) for (value,), (n,) in self.counts.iterator())
        best = sorted(every) if self.k is None else nsmallest(self.k, every)
        # nothing more can come once the watermark has passed the bucket's end
        self.handle.registerTimer((int(key[0]) + self.width_us) // 1000)
        yield self._best(key, best)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        yield self._best(key, [])

    def _best(self, key, best: list[tuple[int, str]]) -> pd.DataFrame:
        bucket, shard = (pd.Series([int(part)] * len(best), dtype="int64") for part in key)
        return pd.DataFrame({
            "bucket_us": bucket, "shard": shard, self.column: pd.Series([value for _, value in best], dtype="object"),
            "requests": pd.Series([-n for n, _ in best], dtype="int64")})

    def close(self) -> None:
        pass


def top_per_bucket(
    spans: DataFrame, by: str, k: int | None = 10, width: str = "1 hour", late: str = LATE, shards: int = 16,
) -> DataFrame:
    """Candidates for the `k` most frequent values of each time bucket: those of each of `shards` shards of the values.

    A value is counted by one shard only, so the best of a bucket are among the best of its shards; `best_per_bucket`
    puts them together. State is dropped when the watermark passes the bucket. Run it in update mode with `custom_state`.
    """
    width_us = int(pd.Timedelta(width) // pd.Timedelta("1us"))
    bucket = F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(width_us))
    rows = with_time(spans).withWatermark("ts", late).where(F.col(by).isNotNull())
    rows = rows.select("ts", by, bucket.alias("bucket_us"), F.pmod(F.xxhash64(by), F.lit(shards)).alias("shard"))
    return rows.groupBy("bucket_us", "shard").transformWithStateInPandas(
        statefulProcessor=TopCounts(by, k, width_us),
        outputStructType=f"bucket_us long, shard long, {by} string, requests long",
        outputMode="Update",
        timeMode="EventTime",
    )


def best_per_bucket(spark: SparkSession, path: str, by: str, k: int | None = 10) -> DataFrame:
    """(bucket, value, requests, place) from the stored batches of `top_per_bucket`: each shard's last word, cut to `k`."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    last = rows.groupBy("bucket_us", "shard").agg(F.max("batch_id").alias("batch_id"))
    rows = rows.join(last, ["bucket_us", "shard", "batch_id"], "left_semi")
    place = F.row_number().over(W.partitionBy("bucket_us").orderBy(F.desc("requests"), F.asc(by)))
    ranked = rows.withColumn("place", place)
    return (ranked if k is None else ranked.where(F.col("place") <= k)).select(
        F.timestamp_micros("bucket_us").alias("bucket"), by, "requests", "place")


class Heartbeat(StatefulProcessor):
    """Remembers a client's last request; a timer opens an alert, the next request closes it."""

    def __init__(self, key: str, span_us: int):
        self.key, self.span_us = key, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _deadline_ms(self, last_us: int) -> int:
        return -(-(last_us + self.span_us) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # first and last request of each minute: what is held follows the minutes of a batch, not its requests
        first, last = (np.concatenate(x) for x in zip(*(_minutes(frame["us"].to_numpy()) for frame in rows)))
        order = np.argsort(first, kind="stable")
        known = self.last.get()[0] if self.last.exists() else None
        if known is not None:
            self.handle.deleteTimer(self._deadline_ms(known))
        reach = np.maximum.accumulate(np.concatenate(([first.min() if known is None else known], last[order])))
        gaps = np.flatnonzero(first[order] - reach[:-1] > self.span_us)
        self.last.update((int(reach[-1]),))
        self.handle.registerTimer(self._deadline_ms(int(reach[-1])))
        yield self._alerts(key, reach[gaps] + self.span_us, first[order][gaps])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._alerts(key, [self.last.get()[0] + self.span_us], [None])

    def _alerts(self, key, start, end) -> pd.DataFrame:
        return pd.DataFrame({
            self.key: pd.Series([key[0]] * len(start), dtype="object"), "start_us": pd.Series(list(start), dtype="Int64"),
            "end_us": pd.Series(list(end), dtype="Int64")})

    def close(self) -> None:
        pass


def _minutes(us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last time of each minute that occurs."""
    us = np.sort(us)
    begins = np.flatnonzero(np.concatenate(([True], us[1:] // MINUTE != us[:-1] // MINUTE)))
    return us[begins], us[np.append(begins[1:], len(us)) - 1]


def heartbeat_alerts(spans: DataFrame, span: str = HEARTBEAT_SPAN, by: str = "client_name", late: str = LATE) -> DataFrame:
    """Alerts for periods without requests of a client: (by, alert_start, NULL) when opened, with the end when closed.

    Absence emits nothing in a window, so a timer does: an alert opens once the watermark is `span` past the
    client's last request. The state is one time per client. Run it in append mode with `custom_state`.
    """
    rows = with_time(spans).withWatermark("ts", late).where(F.col(by).isNotNull())
    alerts = rows.select(by, "ts", F.unix_micros("ts").alias("us")).groupBy(by).transformWithStateInPandas(
        statefulProcessor=Heartbeat(by, int(pd.Timedelta(span) // pd.Timedelta("1us"))),
        outputStructType=f"{by} string, start_us long, end_us long",
        outputMode="Append",
        timeMode="EventTime",
    )
    return alerts.select(
        by, F.timestamp_micros("start_us").alias("alert_start"), F.timestamp_micros("end_us").alias("alert_end")
    )


@contextmanager
def _state_in(spark: SparkSession, provider: str | None):
    """The session with another state store while a query starts, and as before afterwards."""
    before = spark.conf.get(PROVIDER, None)
    if provider is None or provider == before:
        yield
        return
    spark.conf.set(PROVIDER, provider)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_available(
    stream: DataFrame, path: str, mode: str = "update", allow_late: bool = False, custom_state: bool = False,
) -> None:
    """Process everything available and store each batch under `path/batch_id=N`.

    A batch is replaced as a whole when it runs again, so a restart stores nothing twice. Rows that
    came too late for the watermark are counted; unless `allow_late`, the run then ends with an error, because
    the stored result lacks them: replay with more files a batch, in order of time, or a later watermark.
    `custom_state` is for streams with a state of their own, which only one kind of state store holds.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")

    with _state_in(stream.sparkSession, ROCKSDB if custom_state else None):
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{path}/checkpoint")
            .foreachBatch(save)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in json.loads(p.json)["stateOperators"])
    if late and not allow_late:
        raise RuntimeError(f"{late} rows were too late for the watermark and are not in the result")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Stored updates reduced to the last one per key."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return last.select(*keys, "v.*")


def span_stream(spark: SparkSession, directory: str, files_per_batch: int | None = None) -> DataFrame:
    """Spans as a stream over the sample event files of a folder.

    By default a replay takes all files that are there as one batch, whatever their order in time.
    """
    from cohortwise.sources import projection

    pattern = f"{directory}/events*.parquet"
    schema = spark.read.parquet(pattern).schema
    reader = spark.readStream.schema(schema)
    events = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(pattern)
    return spark.sql(projection.VIEWS["spans"].replace("from events", "from {events}"), events=events)
