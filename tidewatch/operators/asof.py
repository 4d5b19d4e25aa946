"""The last change not after a row, without ordering a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, changes: DataFrame, key: str, time: str, values: list[str], order: list[str] | None = None, bucket: int = 3600) -> DataFrame:
    """rows with values of the last change of their key whose time is not after theirs; nulls where there is none or the key or time is null.

    Both have key and time. Changes of equal time count by `order`. Time is cut into buckets of so many seconds: a row meets the changes of
    its own bucket by an equi-join and what holds before the bucket begins, which is carried over a row for each key and
    bucket; so a key with a third of all rows is spread over its buckets.
    """
    micros = lambda f: F.unix_micros(f[time].cast("timestamp"))
    at = lambda f: micros(f) - F.pmod(micros(f), F.lit(bucket * 1_000_000))
    held = changes.filter(F.col(time).isNotNull()).select(F.col(key).alias("_key"), at(changes).alias("_bucket"), F.struct(*dict.fromkeys([time, *(order or []), *values])).alias("_change"))
    held = held.groupBy("_key", "_bucket").agg(F.sort_array(F.collect_list("_change")).alias("_held"))
    asked = rows.filter(F.col(time).isNotNull()).select(F.col(key).alias("_key"), at(rows).alias("_bucket")).distinct()
    both = asked.join(held, ["_key", "_bucket"], "full")
    before = F.last(F.element_at("_held", -1), ignorenulls=True).over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = both.withColumn("_before", before)
    met = rows.withColumn("_at", at(rows)).join(carried, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bucket")), "left")
    inside = F.filter(F.coalesce("_held", F.array()), lambda c: c[time] <= F.col(time))
    found = F.coalesce(F.try_element_at(inside, F.lit(-1)), F.col("_before"))
    return met.select(*[rows[c] for c in rows.columns], *[found[v].alias(v) for v in values])
