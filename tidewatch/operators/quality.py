"""Dataset audit: nulls, duplicates, labels, splits and leakage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls) of columns with nulls or empty texts; one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])
    return one.select(F.inline(pairs)).filter("nulls > 0")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def audit_verdict(df: DataFrame, key: str, text: str, label: str, needed: tuple) -> DataFrame:
    """One row: counts and PASS, or FAIL where keys or texts repeat or a needed label is missing. Nulls don't gate."""
    keys = df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(key).alias("keys"), F.count_distinct(text).alias("texts"), *[F.count_if(F.col(label) == v).alias(f"label_{v}") for v in needed])
    fine = (F.col("keys") == F.col("total")) & (F.col("texts") == F.col("total"))
    for v in needed:
        fine = fine & (F.col(f"label_{v}") > 0)
    return keys.withColumn("audit_status", F.when(fine, "PASS").otherwise("FAIL"))


def checked(verdict: DataFrame) -> DataFrame:
    """Raises where the audit failed."""
    status = F.when(F.col("audit_status") == "PASS", F.col("audit_status")).otherwise(F.raise_error(F.lit("dataset audit failed")))
    return verdict.withColumn("audit_status", status)


def with_splits(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with splits: names of all rules that a row meets; a row may be in several."""
    return df.withColumn("splits", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def split_manifest(df: DataFrame, label: str, values: dict[str, object]) -> DataFrame:
    return df.withColumn("split", F.explode("splits")).groupBy("split").agg(F.count(F.lit(1)).alias("sample_count"), *[F.count_if(F.col(label) == v).alias(n) for n, v in values.items()])


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")


def leakage(train: DataFrame, test: DataFrame, key: str) -> DataFrame:
    """Keys that are on both sides."""
    return test.select(key).distinct().join(train.select(key).distinct(), key, "left_semi")


def unioned(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
