"""Streaming queries over the event table, run over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from runeframe.session import table
from runeframe.streaming import archive as A


def _events(spark, d):  # noqa: ANN001, ANN202
    schema = table(spark, d, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    return A.read_table_stream(spark, d, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_event_counts(spark, d):  # noqa: ANN001, ANN201
    """Events per type and day, the complete table."""
    found = A.run_available(A.counts(_events(spark, d), "ts", "event_type", "1 day"), "complete")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def stream_once(spark, d):  # noqa: ANN001, ANN201
    """Events once each, by id."""
    return A.run_available(A.once(_events(spark, d), ["event_id"], "ts", "40 days")).select("event_id", "user_id", "event_type")


def stream_sessions(spark, d):  # noqa: ANN001, ANN201
    """Sessions per user that the watermark has closed: all but those that end within the gap before the last event."""
    found = A.run_available(A.sessions(_events(spark, d), "ts", "user_id"))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "closed_at")})


def stream_claims(spark, d):  # noqa: ANN001, ANN201
    entries = _events(spark, d).select(F.concat(F.lit("0."), F.col("user_id") % 5).alias("section"), F.col("event_type").alias("method"), F.when(F.col("value") > 50, "running").otherwise("solved").alias("verdict"), F.col("ts").alias("at"))
    return A.run_available(A.claims(entries), "update")


QUERIES = {f.__name__: f for f in (stream_event_counts, stream_once, stream_sessions, stream_claims)}
ORACLES = {
    "stream_event_counts": "select date_trunc('day', ts)::timestamp as start, date_trunc('day', ts)::timestamp + interval 1 day as end, event_type, count(*) n from events group by all",
    "stream_sessions": """with g as (select user_id, ts, coalesce(ts > lag(ts) over w + interval 6 hours, true) fresh from events window w as (partition by user_id order by ts)),
       s as (select user_id, ts, sum(fresh::int) over (partition by user_id order by ts rows unbounded preceding) k from g), c as (select user_id, min(ts)::timestamp start_at, max(ts)::timestamp + interval 6 hours closed_at, count(*) n from s group by user_id, k)
       select * from c where closed_at <= (select max(ts)::timestamp - interval 6 hours from events)""",
    "stream_claims": """select '0.' || (user_id % 5) as section, event_type as method, case when arg_max(value, ts) > 50 then 'running' else 'done' end state, count(*) entries from events group by 1, 2""",
    "stream_once": "select distinct event_id, user_id, event_type from events",
}
