"""Numbers over a whole table without bringing it together in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def numbered(df: DataFrame, order: Sequence[Column | str] = (), name: str = "rank", start: int = 1) -> DataFrame:
    """df with a running number from start in a total order (any order, without one).

    Rows are sorted into ranges, which are written once, so that every later step sees
    the same ranges; counts of the ranges, a row each, give where a range begins.
    """
    dealt = df.repartitionByRange(*order) if order else df
    held = stored(dealt.withColumn("_range", F.spark_partition_id()), "numbered")
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    begins = held.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_begin"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*(order or [F.lit(0)])))
    number = (F.col("_begin") + inside + (start - 1)).cast("long")
    # one row a range, as many as the session has shuffle partitions
    return held.join(F.broadcast(begins), "_range").withColumn(name, number).select(*df.columns, name)
