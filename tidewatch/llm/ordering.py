"""Each row with the one that follows it in descending id order, without a global sort task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written


def _range_number(value: Column, tops: Column, held: int) -> Column:
    """How many of the held descending tops are not below value, by bisection; one more than there are for null."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(held.bit_length()))]).cast("array<int>")
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= held) & (F.get(tops, at + s - 1) >= value), at + s).otherwise(at))
    return F.when(value.isNull(), held + 1).otherwise(found)


def in_descending_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows_per_range: int = 2000, most_ranges: int = 65_536) -> DataFrame:
    """(id, text, ghost), dealt and sorted so that within a partition each row that isn't a ghost is followed at once by the next one of the descending order of ids.

    Ids (of any type that has an order) are cut into ranges, and each range ends with a ghost, a copy of the first row
    of the next one (of the first one after the last). A range has rows_per_range rows or so, more where that would
    take over most_ranges of them; ranges are sorted by Spark, which spills. The largest id of each range, one array of
    at most most_ranges ids, is all that tasks need to know of the others; it is a written table of one row. Null ids
    come last; rows of equal ids in the order of their text.
    """
    source = docs.select(F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows, known = source.agg(F.count(F.lit(1)), F.count(id_column)).first()
    if not rows:
        return source.select(id_column, "text", F.lit(False).alias("ghost"))
    ranges = min(most_ranges, max(1, -(-rows // rows_per_range)))
    cut = source.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("top")).repartitionByRange(ranges, F.desc("top"))
    each = cut.groupBy(F.spark_partition_id().alias("range")).agg(F.max("top").alias("top"))
    array = written(each.agg(F.sort_array(F.collect_set("top"), asc=False).alias("tops")))
    held = array.select(F.size("tops")).first()[0]  # the cluster may cut more or fewer ranges than asked for
    tie, tops = F.xxhash64("text"), F.col("_tops")
    source = source.withColumn("_tops", array.scalar()).withColumn("_range", _range_number(F.col(id_column), tops, held))
    # each range but that of nulls holds its top, so none is empty
    firsts = source.filter(F.get(tops, F.col("_range") - 1).eqNullSafe(F.col(id_column))).groupBy("_range").agg(F.max(id_column).alias(id_column), F.min_by("text", F.struct(tie, "text")).alias("text"))
    last = held + (known < rows)
    ghosts = firsts.select(id_column, "text", F.when(F.col("_range") == 1, last).otherwise(F.col("_range") - 1).alias("_range"), F.lit(True).alias("ghost"))
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), held)
    dealt = source.select(id_column, "text", "_range", F.lit(False).alias("ghost")).unionByName(ghosts).repartition(partitions, "_range")
    return dealt.sortWithinPartitions("_range", "ghost", F.col(id_column).desc_nulls_last(), tie, "text").select(id_column, "text", "ghost")
