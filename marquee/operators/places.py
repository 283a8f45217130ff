"""Exact places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.session import cut_lineage


def with_places(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with the place of every row from 0; rows alike in ``order`` are placed in any order.

    Rows are dealt by sampled ranges of the order and sorted within them; the number of rows in the ranges
    before, a table of one row per range, is added to the place within the range. The dealt rows are written to the
    checkpoint folder first, as the ranges must not be sampled anew.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = cut_lineage(dealt.withColumn("_row", F.monotonically_increasing_id()))
    split = numbered.withColumns({"_range": F.shiftright("_row", 33), "_row": F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = split.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return split.join(starts, "_range").withColumn(name, F.col("_start") + F.col("_row")).drop("_range", "_row", "_start")
