"""Cutting lineage through the folder that the cluster shares, and keeping Python workers small."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one is set in local mode (tests); on a cluster that is an error, as executors could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Rows and bytes of an Arrow batch: with texts of several kB, the defaults (10,000 rows, 64 MB and more) make each Python worker hold hundreds of MB.

    A session setting, made by the registered queries and the pipeline for the plans they return; it changes no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


@cache
def _allocator() -> ctypes.CDLL | None:
    """The worker's C library, once told to give blocks of 1 MB and more back as soon as they are freed; Arrow takes its memory there too, not from a pool that keeps it. None where it is another library."""
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows to 32 MB with use
        library.malloc_trim(0)
    except (OSError, AttributeError):
        return None
    pa.set_memory_pool(pa.system_memory_pool())
    return library


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """function for mapInArrow in a worker that keeps no freed memory: Spark keeps workers for later tasks."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _allocator()
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if library is not None:
                library.malloc_trim(0)

    return run


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df, computed once and read back from Parquet in the shared folder: later plans start there, and a lost executor loses nothing of it.

    The shuffle files of this one execution go as soon as it ends, not when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidewatch-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_tidewatch_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written() tables that no plan reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table.__dict__["_tidewatch_path"]
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def joined_by_key(rows: DataFrame, table: DataFrame, key: str, times: str, share: int = 1000) -> DataFrame:
    """rows with the columns of table, a written table with one row for each key and how often rows have it (times, which goes).

    Keys that over one in `share` rows have, fewer than `share` of them, are broadcast, so that rows of a key that a
    third of all have stay where they are; the others meet by a shuffle. Both are read twice.
    """
    total = table.agg(F.sum(times)).first()[0] or 0
    often = F.col(times) * share > total
    hot, rest = table.filter(often).drop(times), table.filter(~often).drop(times)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))


def maybe_among(rows: DataFrame, keys: DataFrame, key: str, words: int = 1 << 18) -> DataFrame:
    """rows less most of those whose key isn't among keys, where they are read and before any shuffle; rows whose key is among them all stay, so an exact join must follow.

    A filter of 64 * words bits, 2 MB unless words says more, is all that reaches the driver and the tasks; with
    more keys than bits it lets more rows pass.
    """
    hashed = F.xxhash64(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed, F.lit(64)).cast("int"))
    filled = keys.groupBy(F.pmod(F.shiftright(hashed, 6), F.lit(words)).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(words, np.int64)
    bits[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    held, schema = rows.sparkSession.sparkContext.broadcast(bits.view(np.uint64)), rows.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(batch.num_columns - 1).to_numpy()
            there = held.value[(hashes >> 6) % words] >> (hashes % 64).astype(np.uint64) & np.uint64(1)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(there.astype(bool)))

    (name,) = free_names(rows, "hashed")
    return rows.withColumn(name, hashed).mapInArrow(lean(keep), schema)


def free_names(frame: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of frame has it (whatever the case)."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(frame: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """frame with those of its columns that have one of names (whatever the case) renamed to free ones, and the way back for withColumnsRenamed."""
    clash = [c for c in frame.columns if c.lower() in {n.lower() for n in names}]
    held = dict(zip(free_names(frame, *(f"own_{c}" for c in clash)), clash, strict=True))
    return frame.withColumnsRenamed({c: h for h, c in held.items()}), held


def text_key(text: str | Column = "text") -> Column:
    """16 bytes that identify a text; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("binary"))), F.lit(b""))  # never null, so joins add no filter below shared exchanges


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, text, copies): each different text once. Copies are combined before the shuffle, so a text that a third of all rows share isn't a hot group."""
    return (
        docs.select(text_key(text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .groupBy("key")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
