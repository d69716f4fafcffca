"""Running totals and last values over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runeframe.session import cut_lineage


def running_totals(df: DataFrame, order: list[str], value: str, out: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each row in ``order`` (unique).

    Rows are range-partitioned and written once, so that partition numbers are fixed; totals are
    taken inside partitions by window and carried over one row per partition. Nulls count as 0.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    amount = F.coalesce(F.col(value), F.lit(0))
    totals = ranged.groupBy("_p").agg(F.sum(amount).alias("_t"))
    carried = totals.select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_c"))
    inside = Window.partitionBy("_p").orderBy(*order)
    return ranged.withColumn("_i", F.sum(amount).over(inside) - amount).join(F.broadcast(carried), "_p").withColumn(out, F.col("_i") + F.col("_c")).drop("_p", "_i", "_c")


def last_before(df: DataFrame, order: list[str], value: str, out: str, itself: bool = False) -> DataFrame:
    """``df`` with the last non-null ``value`` of the rows before each row in ``order`` (unique), of the row itself first if ``itself``.

    By range partitions as ``running_totals``; one row per partition is carried over.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    key = F.struct(*order)
    ends = ranged.groupBy("_p").agg(F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), key)).alias("_e"))
    carried = ends.select("_p", F.last("_e", ignorenulls=True).over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_c"))
    return ranged.withColumn("_i", F.last(value, ignorenulls=True).over(inside)).join(F.broadcast(carried), "_p").withColumn(out, F.coalesce("_i", "_c")).drop("_p", "_i", "_c")
