"""The bounded labelled sample that the classifiers are fitted on, and the hold-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows_per_class: int, id_column: str = "doc_id", text_column: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, label, extra...) of at most rows_per_class labelled rows of each class for which train holds.

    Rows come in the order of a hash of their id, so reruns agree. The chosen ids are at most 2 * rows_per_class rows
    of a few bytes, which bounds the broadcast; the texts are met where they are read, without a shuffle. Null labels
    and null ids are left out; an id that is labelled twice counts once, with its larger label.
    """
    known = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("label")).filter("_id IS NOT NULL AND label IS NOT NULL").filter(train)
    known = known.groupBy("_id").agg(F.max("label").alias("label"))
    chosen = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("_id"), "_id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("text"), *extra)
    return texts.join(F.broadcast(chosen), "_id")


def class_sizes(labels: DataFrame, label: str, train: Column, id_column: str = "doc_id") -> tuple[int, int]:
    """Labelled training rows of class 0 and 1, for the prior that a sample by class loses."""
    row = labels.select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("label")).filter(train).agg(F.count_if(F.col("label") == 0).alias("a"), F.count_if(F.col("label") == 1).alias("b")).first()
    return int(row["a"]), int(row["b"])
