"""Places of a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fairtag.session import cut_lineage


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Add ``place`` (from 0) in the given order, which must be total, and ``total``.

    Rows are sorted by range; only one count per partition is ever in one task.
    """
    in_part = F.monotonically_increasing_id()
    ordered = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", in_part))
    part, nth = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"),
        F.sum("count").over(Window.partitionBy()).alias("total"),
    )
    return (
        ordered.withColumn("_part", F.shiftright("_at", 33))
        .join(F.broadcast(starts), "_part")
        .withColumn("place", F.col("_start") + nth)
        .drop("_at", "_part", "_start")
    )
