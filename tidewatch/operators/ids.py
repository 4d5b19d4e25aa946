"""Ids that count across tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def counted(df: DataFrame, *order: str, name: str = "counter") -> DataFrame:
    """df with 1, 2, 3, ... by order, without gaps and without one task that sees all rows.

    Rows are dealt out by ranges of order and numbered within their range; the numbers of rows of the ranges before are
    added, of which there are as many as ranges. Rows of equal order are numbered in no certain order.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()  # a row for each range
    offsets, total = {}, 0
    for r in sizes:
        offsets[r._range] = total
        total += r.n
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long"))
    before = F.create_map(*[F.lit(v) for pair in offsets.items() for v in pair])[F.shiftright("_at", 33)]
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, (before + inside + 1).cast("long")).drop("_at")


def timed_ids(df: DataFrame, prefix: Column, time: str, *order: str, name: str = "id") -> DataFrame:
    """df with prefix-time-counter: milliseconds since 1970 and the count by time and order, as artifacts are named as they are made."""
    millis = base36(F.unix_millis(F.col(time).cast("timestamp")))
    return counted(df, time, *order, name="_count").withColumn(name, F.concat_ws("-", prefix, millis, F.col("_count").cast("string"))).drop("_count")
