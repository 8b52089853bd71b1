"""Positions in a global order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from purseflow.storage import materialize


def positions(rows: DataFrame, *order, name: str = "position") -> DataFrame:
    """``rows`` with their position from 1 in the given order: ranges of the order are
    numbered each by itself, and start after the sum of the ranges before."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").count()
    start = sizes.select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(start), "_range").withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).drop("_range", "_start", "_own")


def ranks_within(rows: DataFrame, groups: list[str], *order, name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 inside their group, without a task that sees a whole group: the
    positions in one order of groups and rows, less where the group begins."""
    placed = positions(rows, *groups, *order, name="_place")
    begins = placed.groupBy(*[F.col(g).alias(f"_{g}") for g in groups]).agg(F.min("_place").alias("_first"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return placed.join(begins, same).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first", *[f"_{g}" for g in groups])


def evenly_spaced(rows: DataFrame, n: int, *order) -> DataFrame:
    """``n`` rows at even distances in the order; halves round to the even position."""
    if n <= 0:
        raise ValueError("a sample needs a size above 0")
    placed = positions(rows, *order)
    total = placed.count()
    if n >= total:
        return placed.drop("position")
    at = [total // 2] if n == 1 else [round(i * (total - 1) / (n - 1)) for i in range(n)]
    wanted = rows.sparkSession.createDataFrame([(a + 1,) for a in at], "position long")
    return placed.join(F.broadcast(wanted), "position").drop("position")


def with_neighbours(rows: DataFrame, selected: str, partition: str, order: str) -> DataFrame:
    """The selected rows and those next to them."""
    near = F.max(F.col(selected).cast("int")).over(Window.partitionBy(partition).orderBy(order).rowsBetween(-1, 1))
    return rows.withColumn("_near", near).where("_near = 1").drop("_near")
