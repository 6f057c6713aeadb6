"""Queries of the streaming front, drained over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.plans.registry import CORE
from querymill.streaming import windows as W


@CORE.add("SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_window_counts(spark, sf):
    """Hourly counts by event type."""
    return W.drained(W.tumbling(W.source(spark, sf, "events"), "1 hour", "10 minutes", ["event_type"]))


@CORE.add("SELECT * FROM (SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def stream_sliding_counts(spark, sf):
    """Counts in hourly windows that start every half hour."""
    return W.drained(W.tumbling(W.source(spark, sf, "events"), "1 hour", "10 minutes", ["event_type"], "30 minutes"))


@CORE.add(
    "SELECT user_id, start, finish, n FROM (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s) WHERE finish <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"
)
def stream_sessions(spark, sf):
    """Sessions of users with a gap of half an hour."""
    return W.drained(W.sessions(W.source(spark, sf, "events"), "30 minutes", "10 minutes", "user_id"))


@CORE.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest(spark, sf):
    """The last event of each user and type."""
    return W.latest(W.source(spark, sf, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), ["event_id", "value"])


@CORE.add()
def stream_percentiles(spark, sf):
    """Median and 95th percentile of values per day and type."""
    p = W.drained(W.percentiles(W.source(spark, sf, "events"), "1 day", "10 minutes", ["event_type"], [0.5, 0.95]))
    return p.select("start", "event_type", "n", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


@CORE.add()
def stream_keys(spark, sf):
    """Normal forms and tokens of queries as they arrive."""
    q = W.source(spark, sf, "benchmark").where("query IS NOT NULL")
    return W.drained(q.select("item_id", T.norm_key(F.col("query")).alias("key"), F.size(T.tokens(F.col("query"))).alias("n_tokens")))
