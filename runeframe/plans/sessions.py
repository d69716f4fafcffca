"""Queries of the session operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeframe.functions.times import parse_minute, spell_minute
from runeframe.operators.sessions import sessionize
from runeframe.session import table

GAP_SECONDS = 6 * 3600


def message_times(messages: DataFrame) -> DataFrame:
    """``channel, at`` of each message once: rows of the same channel and seq are one message.

    A message without ``seq`` cannot be recognised as a repetition and counts by its own id;
    messages without channel or readable time are left out.
    """
    return (
        messages.select("channel", F.when(F.col("seq").isNull(), F.col("id")).alias("own"), "seq", parse_minute(F.col("ts")).alias("at"))
        .where("channel is not null and at is not null")
        .groupBy("channel", "seq", "own")
        .agg(F.min("at").alias("at"))
        .select("channel", "at")
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = sessionize(message_times(table(spark, sf_dir, "messages")), "channel", "at", GAP_SECONDS)
    return sessions.select("channel", spell_minute(F.col("start_at")).alias("start_ts"), spell_minute(F.col("end_at")).alias("end_ts"), F.col("n_events").alias("n_messages"))


P3_SQL = """
with m as (
  select channel, seq, case when seq is null then id end own, min(date_trunc('minute', coalesce(
      try_strptime(trim(ts), '%Y-%m-%d %H:%M'), try_strptime(trim(ts), '%Y-%m-%d %H:%M:%S'),
      try_strptime(trim(ts), '%Y-%m-%dT%H:%M'), try_strptime(trim(ts), '%Y-%m-%dT%H:%M:%S'),
      try_strptime(trim(ts), '%-m/%-d/%Y %-I:%M %p')))) as tm
  from messages where channel is not null group by all having tm is not null),
g as (select channel, tm, case when tm - lag(tm) over w > interval 6 hour then 1 else 0 end new_s from m window w as (partition by channel order by tm)),
s as (select channel, tm, sum(new_s) over (partition by channel order by tm rows unbounded preceding) sid from g)
select channel, strftime(min(tm), '%Y-%m-%d %H:%M') as start_ts, strftime(max(tm), '%Y-%m-%d %H:%M') as end_ts, count(*) as n_messages
from s group by channel, sid
"""

QUERIES = {"p3_found": p3_found}
ORACLES = {"p3_found": P3_SQL}
