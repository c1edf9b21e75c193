"""Row numbers and running sums over one order of all rows, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litforge.session import materialize


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``nth`` (from 1 in the given order) and, for each name of ``sums``, the sum of that column before the row.

    Rows are ranged over partitions by the order and written with their
    partition's number; each partition is numbered by itself, and the partitions'
    totals, one row each, are added.  Equal keys are in one partition, so the
    order should end in a key.
    """
    sums = sums or {}
    placed = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    totals = placed.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in ("n", *sums)])
    inside = Window.partitionBy("__part").orderBy(*order)
    own = {k: F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for k, c in sums.items()}
    out = placed.withColumns({"nth": F.row_number().over(inside), **own}).join(F.broadcast(offsets), "__part")
    totals_added = {"nth": F.col("nth") + F.col("__before_n"), **{k: F.col(k) + F.col(f"__before_{k}") for k in sums}}
    return out.withColumns(totals_added).drop("__part", *[f"__before_{k}" for k in ("n", *sums)])
