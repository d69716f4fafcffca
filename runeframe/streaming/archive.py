"""Streams of messages and log entries.

Every stream is a transformation of a streaming DataFrame with an event-time watermark; state is
bounded by the watermark. ``run_available`` drives a stream over what is there and returns the
sink as a DataFrame, for tests and backfills.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runeframe.operators.notation import indexed
from runeframe.session import checkpoint_dir

WATERMARK = "6 hours"


def read_table_stream(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """Files of one table as they arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").option("recursiveFileLookup", "true").parquet(folder)


def once(events: DataFrame, keys: list[str], at: str, late: str = WATERMARK) -> DataFrame:
    """First row per key within the watermark: repeated exports of a message go."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def counts(events: DataFrame, at: str, by: str, width: str, late: str = WATERMARK) -> DataFrame:
    """``start, end, by, n`` per tumbling window."""
    window = F.window(at, width)
    return events.withWatermark(at, late).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str = WATERMARK) -> DataFrame:
    """``by, start_at, closed_at, n`` per session; a session is emitted when the watermark passes its end."""
    window = F.session_window(at, gap)
    return events.withWatermark(at, gap).groupBy(window.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start_at"), F.col("w.end").alias("closed_at"), "n")


def sequences(messages: DataFrame, id_col: str = "id", text_col: str = "body") -> DataFrame:
    """Sequences cited in arriving messages; row-wise, so no state is kept."""
    return indexed(messages, id_col, text_col)


def claims(entries: DataFrame, at: str = "at", late: str = WATERMARK) -> DataFrame:
    """``section, method, state, entries``: experiments claimed by a ``running`` entry until a final verdict, as updates.

    One state row per claim; a claim without news for the length of the watermark is dropped.
    """

    def step(key: tuple, batches, state: GroupState):  # noqa: ANN001, ANN202
        if state.hasTimedOut:
            state.remove()
            return
        current, n = state.get if state.exists else ("unclaimed", 0)
        rows = pd.concat(list(batches)).sort_values([at])
        for verdict in rows["verdict"]:
            n += 1
            current = "running" if verdict == "running" else (current if pd.isna(verdict) else "done")
        state.update((current, n))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 6 * 3600 * 1000)
        yield pd.DataFrame({"section": [key[0]], "method": [key[1]], "state": [current], "entries": [n]})

    marked = entries.withWatermark(at, late).select("section", "method", "verdict", at)
    return marked.groupBy("section", "method").applyInPandasWithState(step, "section string, method string, state string, entries long", "state string, entries long", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over the data that is there; returns what the sink holds.

    The sink and the stream's own checkpoint lie in the session's shared checkpoint folder.
    Complete and update results go through ``foreachBatch``: the last complete table, or all updates.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:

        def save(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

        query = writer.foreachBatch(save).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
