"""Snapshots of file trees: an exclude list, contents with checksums and a manifest, and reading them back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import messages
from tidewatch.operators import store


def like(wildcard: str) -> str:
    """The expression of a wildcard of * ? and [sets], whatever the case."""
    tokens = re.findall(r"\[[^\]]*\]|.", wildcard, re.S)
    return "(?is)^" + "".join(".*" if t == "*" else "." if t == "?" else t if len(t) > 1 else re.escape(t) for t in tokens) + "$"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path has a pattern anywhere in it, or its name is like one."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(like(f"*{p}*")) | name.rlike(like(p))
    return out


def file_tree(spark: SparkSession, root: str, patterns: list[str] = (), content: bool = True) -> DataFrame:
    """path below root, size, and sha256 and content of each file that isn't excluded. Without content no file is opened. Spark's reader passes over files without a byte and names that begin with . or _."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = re.sub(r"^\w+:/*", "/", root.rstrip("/")) + "/"
    full = F.regexp_replace("path", r"^\w+:/*", "/")
    relative = F.substring(full, F.instr(full, top) + len(top), F.lit(1 << 30))
    kept = files.withColumn("path", relative).filter(~excluded(F.col("path"), list(patterns))).withColumnRenamed("length", "size")
    return kept.select("path", "size", F.sha2("content", 256).alias("sha256"), "content") if content else kept.select("path", "size")


def write_snapshot(files: DataFrame, target: str, manifest: dict[str, str]) -> None:
    """files (of file_tree) below target: contents, a line HASH  path for each, the list of paths, and the manifest with file_count."""
    files.write.mode("overwrite").parquet(f"{target}/files")
    written = files.sparkSession.read.parquet(f"{target}/files")
    written.select(F.concat(F.upper("sha256"), F.lit("  "), "path").alias("value")).write.mode("overwrite").text(f"{target}/checksums-sha256.txt")
    written.select(F.col("path").alias("value")).write.mode("overwrite").text(f"{target}/file-list.txt")
    lines = [f"{k}={v}" for k, v in manifest.items()] + [f"file_count={written.count()}"]
    files.sparkSession.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/backup-manifest.txt")


def read_manifest(spark: SparkSession, target: str) -> dict[str, str]:
    return dict(r.value.split("=", 1) for r in spark.read.text(f"{target}/backup-manifest.txt").collect())


def read_checksums(spark: SparkSession, target: str) -> DataFrame:
    """(path, sha256) of the lines of checksums; other lines don't count."""
    entries = spark.read.text(f"{target}/checksums-sha256.txt").select(messages.checksum_entry(F.col("value")).alias("e"))
    return entries.filter("e IS NOT NULL").select("e.path", F.col("e.hash").alias("sha256"))


def verified_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """(path, finding) of what is wrong: corrupted contents, listed files that are missing, files that aren't listed."""
    found = spark.read.parquet(f"{target}/files").select("path", F.sha2("content", 256).alias("sha256"))
    listed = read_checksums(spark, target)
    wrong = store.checksum_errors(found, listed, "path", "sha256").select("path", F.lit("corrupted").alias("finding"))
    gone = listed.join(found, "path", "left_anti").select("path", F.lit("missing").alias("finding"))
    return wrong.union(gone).union(found.join(listed, "path", "left_anti").select("path", F.lit("unlisted").alias("finding")))


def restore_plan(snapshot: DataFrame, current: DataFrame) -> DataFrame:
    """(path, action) of restoring a snapshot over a tree: CREATE what isn't there, OVERWRITE what is."""
    there = current.select("path", F.lit(True).alias("there"))
    return snapshot.select("path").join(there, "path", "left").select("path", F.when(F.col("there"), "OVERWRITE").otherwise("CREATE").alias("action"))
