"""Roll-ups of the request log: totals, top lists, time series and alerts, in batch form.

A span without the facet it is grouped by is left out of that report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortwise.plans.ranking import top, top_per_group
from cohortwise.plans.scope import distinct_counts

# Alert thresholds (more than) and spans of time.
ERROR_LEVELS = {"critical": 20, "warning": 10}
ERROR_SPAN = "10 minutes"
UNATTRIBUTED_LEVELS = {"critical": 50, "warning": 20}
UNATTRIBUTED_SPAN = "30 minutes"
HEARTBEAT_SPAN = "15 minutes"
STEP = "1 minute"


def with_time(spans: DataFrame) -> DataFrame:
    """`ts` as an instant (the session time zone applies to a zone-less column)."""
    return spans.withColumn("ts", F.col("ts").cast("timestamp"))


def request_total(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count("*").alias("requests"))


def distinct_users(spans: DataFrame) -> DataFrame:
    """Users known by id; requests without one are not people."""
    return spans.agg(F.count_distinct("enduser_id").alias("users"))


def distinct_sessions(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count_distinct("session_id").alias("sessions"))


def distinct_ips(spans: DataFrame) -> DataFrame:
    return spans.agg(F.count_distinct("client_ip").alias("ips"))


#: Columns of the log whose different values are counted, and the name of their counts.
PEOPLE = {"enduser_id": "users", "session_id": "sessions", "client_ip": "ips"}
#: Log2 of a sketch's buckets: a relative standard error of 1.04 / 2**6, or 1.6 %.
SKETCH_BITS = 12


def distinct_sketches(spans: DataFrame, width: str = "1 minute") -> DataFrame:
    """(bucket, requests, and a sketch of the users, sessions and addresses): what distinct counts over any range are made of."""
    rows = with_time(spans).groupBy(F.window("ts", width).alias("w"))
    sketches = [F.hll_sketch_agg(c, F.lit(SKETCH_BITS)).alias(name) for c, name in PEOPLE.items()]
    return rows.agg(F.count("*").alias("requests"), *sketches).select(F.col("w.start").alias("bucket"), "requests", *PEOPLE.values())


def distinct_from_sketches(sketches: DataFrame, width: str = "1 day", start: str | None = None, end: str | None = None) -> DataFrame:
    """Estimated distinct users, sessions and addresses per period of `width`, from merged sketches of shorter ones.

    Only buckets from `start` to before `end` are read; the log itself is not.
    """
    rows = sketches
    if start is not None:
        rows = rows.where(F.col("bucket") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("bucket") < F.lit(end).cast("timestamp"))
    merged = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in PEOPLE.values()]
    periods = rows.groupBy(F.window("bucket", width).alias("w")).agg(F.sum("requests").alias("requests"), *merged)
    return periods.select(F.col("w.start").alias("bucket"), "requests", *PEOPLE.values())


def distinct_over_time(spans: DataFrame, width: str = "1 day") -> DataFrame:
    """Exact distinct users, sessions and addresses per period; each is counted on its own."""
    rows = with_time(spans).withColumn("bucket", F.window("ts", width)["start"])
    counts = distinct_counts(rows, ["bucket"], {name: F.col(c) for c, name in PEOPLE.items()})
    return counts.join(rows.groupBy("bucket").agg(F.count("*").alias("requests")), "bucket").select("bucket", "requests", *PEOPLE.values())


def top_by(spans: DataFrame, column: str, k: int | None = 10) -> DataFrame:
    """The `k` most frequent values of a column; with None all."""
    counts = spans.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("requests"))
    return top(counts, [F.desc("requests"), F.asc(column)], k)


def requests_over_time(spans: DataFrame, by: str, k: int | None = 10, width: str = "1 hour") -> DataFrame:
    """Requests per time bucket for the `k` most frequent values of a column; with None for all."""
    # bucket counts are made once; the top list is taken from them, not from the spans
    buckets = (
        with_time(spans)
        .where(F.col(by).isNotNull())
        .groupBy(F.window("ts", width).alias("w"), by)
        .agg(F.count("*").alias("requests"))
    )
    if k is not None:
        leaders = top(buckets.groupBy(by).agg(F.sum("requests").alias("total")), [F.desc("total"), F.asc(by)], k)
        buckets = buckets.join(leaders.select(by), by, "left_semi")
    return buckets.select(F.col("w.start").alias("bucket"), by, "requests")


def top_per_bucket(spans: DataFrame, by: str, k: int | None = 10, width: str = "1 hour") -> DataFrame:
    """Requests of the `k` most frequent values of a column in each time bucket, with their place in it; ties by value."""
    counts = requests_over_time(spans, by, None, width)
    place = F.row_number().over(W.partitionBy("bucket").orderBy(F.desc("requests"), F.asc(by)))
    ranked = counts.withColumn("place", place)
    return ranked if k is None else ranked.where(F.col("place") <= k)


def errors_over_time(spans: DataFrame, by: str = "client_name", k: int | None = 10, width: str = "1 hour") -> DataFrame:
    """Failed requests per time bucket for the values of a column with most failures."""
    return requests_over_time(spans.where(~F.col("success")), by, k, width).withColumnRenamed("requests", "errors")


def requests_cube(spans: DataFrame, limits: tuple[int | None, int | None, int | None] = (10, 5, 15)) -> DataFrame:
    """Requests by client name, kind and tool: top names, top kinds in each, top tools in each; None keeps all."""
    name, kind, tool = "client_name", "client_kind", "tool_name"
    counts = (
        spans.where(F.col(name).isNotNull() & F.col(kind).isNotNull() & F.col(tool).isNotNull())
        .groupBy(name, kind, tool)
        .agg(F.count("*").alias("requests"))
    )

    def totals(*by: str) -> DataFrame:
        return counts.groupBy(*by).agg(F.sum("requests").alias("total"))

    names = top(totals(name), [F.desc("total"), F.asc(name)], limits[0]).select(name)
    kinds = top_per_group(totals(name, kind), [name], [F.desc("total"), F.asc(kind)], limits[1]).select(name, kind)
    tools = top_per_group(counts, [name, kind], [F.desc("requests"), F.asc(tool)], limits[2])
    return tools.join(names, name, "left_semi").join(kinds, [name, kind], "left_semi")


def level_of(count: Column, levels: dict[str, int]) -> Column:
    """Name of the highest threshold the count is over; NULL under all of them."""
    chain = F
    for name, limit in sorted(levels.items(), key=lambda x: -x[1]):
        chain = chain.when(count > limit, name)
    return chain


def _sliding(spans: DataFrame, by: list[str], span: str) -> DataFrame:
    """Spans per sliding window, built from counts per minute instead of from the spans."""
    minutes = with_time(spans).groupBy(F.date_trunc("minute", "ts").alias("minute"), *by).agg(F.count("*").alias("n"))
    return (
        minutes.groupBy(F.window("minute", span, STEP).alias("w"), *by)
        .agg(F.sum("n").alias("requests"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "requests")
    )


def error_alerts(spans: DataFrame, levels: dict[str, int] = ERROR_LEVELS, span: str = ERROR_SPAN) -> DataFrame:
    """Windows in which one client had too many failed requests, with the level reached."""
    failed = spans.where(~F.col("success") & F.col("client_name").isNotNull())
    counts = _sliding(failed, ["client_name"], span)
    return counts.withColumn("level", level_of(F.col("requests"), levels)).where(F.col("level").isNotNull())


def unattributed_alerts(
    spans: DataFrame, levels: dict[str, int] = UNATTRIBUTED_LEVELS, span: str = UNATTRIBUTED_SPAN
) -> DataFrame:
    """Windows with too many requests that carry no client name."""
    counts = _sliding(spans.where(F.col("client_name").isNull()), [], span)
    return counts.withColumn("level", level_of(F.col("requests"), levels)).where(F.col("level").isNotNull())


def heartbeat_alerts(spans: DataFrame, span: str = HEARTBEAT_SPAN, by: str | None = None, with_open: bool = False) -> DataFrame:
    """Periods without requests longer than the span: the alert runs from `span` after the last one.

    With `by`, each value of that column (such as a client) has its own alerts; rows without one are left out.
    `with_open` adds alerts that are still open when the log ends, whose alert_end is null.

    Gaps are taken between minutes that have requests. The ordered step therefore sees at
    most one row per minute of the log's duration, whatever the number of requests, and
    runs per day with the last request of the previous active day carried over.
    """
    keys = [] if by is None else [by]
    rows = with_time(spans)
    minutes = (
        (rows if by is None else rows.where(F.col(by).isNotNull()))
        .groupBy(*keys, F.date_trunc("minute", "ts").alias("minute"))
        .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .withColumn("day", F.to_date("minute"))
    )
    # one row per active day; the previous day's last request opens the day's first gap
    days = minutes.groupBy(*keys, "day").agg(F.max("last_ts").alias("day_last"))
    carried = days.select(*keys, "day", F.lag("day_last").over(W.partitionBy(*keys).orderBy("day")).alias("carried"))
    previous = F.lag("last_ts").over(W.partitionBy(*keys, "day").orderBy("minute"))
    gaps = (
        minutes.withColumn("previous", previous)
        .join(carried, [*keys, "day"])
        .select(*keys, F.coalesce("previous", "carried").alias("previous"), F.col("first_ts").alias("alert_end"))
    )
    start = F.col("previous") + F.expr(f"interval {span}")
    closed = gaps.where(start < F.col("alert_end")).select(*keys, start.alias("alert_start"), "alert_end")
    if not with_open:
        return closed
    last = days.groupBy(*keys).agg((F.max("day_last") + F.expr(f"interval {span}")).alias("alert_start"))
    end = rows.agg(F.max("ts")).scalar()
    return closed.unionByName(last.where(F.col("alert_start") < end).withColumn("alert_end", F.lit(None).cast("timestamp")))


def normalize_spans(raw: DataFrame) -> DataFrame:
    """Identity columns from request headers.

    The kind depends on the id header being there, even when empty. Of a forwarded list the
    first address counts; without one, the connection's. An e-mail may be base64 text after
    `b64:`; if that does not decode, nothing about the user is known.
    """
    email = F.nullif(F.col("x_user_email"), F.lit(""))
    coded = F.coalesce(email.startswith("b64:"), F.lit(False))
    # characters outside the alphabet are skipped; what is left must be padded to fours
    text = F.regexp_replace(F.expr("substring(x_user_email, 5)"), "[^A-Za-z0-9+/=]", "")
    decoded = F.when(F.length(text) % 4 == 0, F.try_to_binary(text, F.lit("base64")))
    broken = coded & decoded.isNull()
    forwarded = F.nullif(F.trim("x_forwarded_for"), F.lit(""))
    return raw.select(
        "span_id", "ts", "tool_name", "success",
        F.when(broken, "unknown").when(F.col("x_user_id").isNotNull(), "librechat").otherwise("direct").alias("client_kind"),
        F.nullif("handshake_name", F.lit("")).alias("client_name"),
        F.when(~broken, F.nullif("x_user_id", F.lit(""))).alias("enduser_id"),
        F.when(coded, F.make_valid_utf8(decoded.cast("string"))).otherwise(email).alias("user_email"),
        "session_id",
        F.coalesce(F.trim(F.split(forwarded, ",")[0]), F.col("remote_host")).alias("client_ip"),
    )
