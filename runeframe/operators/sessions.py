"""Sessions by inactivity gap, as a two-level sweep line.

Every event opens an interval ``[t, t + gap]``. The deltas ``+n`` at ``t`` and ``-n`` at
``t + gap`` are summed in time order; where the running sum leaves zero a session starts and
where it returns to zero one ends. Additions sort before subtractions of the same instant, so
a gap of exactly ``gap`` does not split.

The sum is taken in two levels so that no task holds a whole hot key: deltas are pre-aggregated
per key and instant, summed by window inside a key's day, and only one row per key and day is
carried along the key. Crossings are at most ``1 day / gap`` per key and day, so the final
pairing is bounded by the calendar and not by the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def sessionize(events: DataFrame, key: str, moment: str, gap_seconds: int) -> DataFrame:
    """Sessions of each key.

    ``events`` needs ``key`` and a TIMESTAMP column ``moment``; other columns are ignored.
    Rows with a null key or moment belong to no session. Returns ``key, start_at, end_at,
    duration_s, n_events``; an empty input gives no rows.
    """
    if gap_seconds <= 0:
        raise ValueError("gap_seconds must be positive")
    ticks = (
        events.select(F.col(key).alias("k"), F.col(moment).cast("long").alias("t"))
        .where("k is not null and t is not null")
        .groupBy("k", "t")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    deltas = ticks.select(
        "k", F.inline(F.array(F.struct(F.col("t").alias("at"), F.col("n").alias("d")), F.struct((F.col("t") + gap_seconds).alias("at"), (-F.col("n")).alias("d"))))
    ).withColumn("day", F.expr(f"at div {DAY}"))
    # level 2: what each day leaves open and how many events it adds, carried along the key
    along = Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    added = F.when(F.col("d") > 0, F.col("d")).otherwise(F.lit(0))
    carry = (
        deltas.groupBy("k", "day")
        .agg(F.sum("d").alias("sum_d"), F.sum(added).alias("sum_n"))
        .select("k", "day", F.coalesce(F.sum("sum_d").over(along), F.lit(0)).alias("open_in"), F.coalesce(F.sum("sum_n").over(along), F.lit(0)).alias("n_in"))
    )
    # level 1: the sweep inside the day
    inside = Window.partitionBy("k", "day").orderBy("at", F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        deltas.select("k", "day", "at", "d", F.sum("d").over(inside).alias("s"), F.sum(added).over(inside).alias("c"))
        .join(carry, ["k", "day"])
        .select("k", "at", "d", (F.col("s") + F.col("open_in")).alias("open"), (F.col("c") + F.col("n_in")).alias("seen"))
    )
    crossings = swept.select(
        "k",
        "at",
        "seen",
        F.when((F.col("d") > 0) & (F.col("open") == F.col("d")), F.lit("start")).when((F.col("d") < 0) & (F.col("open") == 0), F.lit("end")).alias("what"),
    ).where("what is not null")
    order = Window.partitionBy("k").orderBy("at", F.col("what"))
    ends = Window.partitionBy("k", "what").orderBy("at")
    paired = crossings.select(
        "k", "what", "at", F.lag("at").over(order).alias("start_t"), (F.col("seen") - F.coalesce(F.lag("seen").over(ends), F.lit(0))).alias("n_events")
    ).where("what = 'end'")
    return paired.select(
        F.col("k").alias(key),
        F.timestamp_seconds("start_t").alias("start_at"),
        F.timestamp_seconds(F.col("at") - gap_seconds).alias("end_at"),
        (F.col("at") - gap_seconds - F.col("start_t")).alias("duration_s"),
        "n_events",
    )
