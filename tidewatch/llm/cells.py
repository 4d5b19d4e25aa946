"""Members of crowded buckets that are still in different classes, dealt to cells of two blocks.

Each pair of classes' members of a bucket meets in exactly one cell, whose size is bounded, so a bucket that a third of
all items share is spread over tasks and only what a cell finds leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean

CELL = ["bucket", "x", "y", "in_block", "item", "root"]
CELL_SQL = "bucket long, x long, y long, in_block long, item long, root long"


def dealt_to_cells(members: DataFrame, block: int, size: int) -> DataFrame:
    """members (bucket, item, root, n) of buckets with several classes, dealt to cells (bucket, x, y) in which block x meets block y; in_block says which of the two a row is of. A block has about `block` members, or so many that their n add up to `size`. The members of a bucket's largest class have blocks of their own, which never meet each other."""
    classes = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    shape = classes.groupBy("bucket").agg(F.max_by(F.struct("root", "rows", "n"), F.struct("rows", "root")).alias("major"), F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    blocks = lambda rows, n: F.expr(f"int(greatest(ceil(({rows}) / {block}), ceil(({n}) / {size})))")
    shape = shape.select("bucket", "major.root", blocks("major.rows", "major.n").alias("m"), blocks("rows - major.rows", "n - major.n").alias("r")).withColumnRenamed("root", "major")
    dealt = members.join(shape, "bucket").withColumn("in_block", F.expr("CASE WHEN root = major THEN pmod(xxhash64(item), m) ELSE m + pmod(xxhash64(item), r) END"))
    others = "CASE WHEN root = major THEN sequence(m, m + r - 1) ELSE sequence(0, m + r - 1) END"
    return dealt.withColumn("other", F.explode(F.expr(others))).select("bucket", F.least("in_block", "other").alias("x"), F.greatest("in_block", "other").alias("y"), "in_block", "item", "root")


def by_cell(rows: DataFrame, what: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, tasks: int | None = None) -> DataFrame:
    """What each cell of rows says. tasks: where cells take long for their bytes, how many tasks they are dealt to, whatever the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("bucket", "x", "y")])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))) if batch.num_rows else []
            for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = tuple(keys[:, i])
                if key != now and held:
                    yield from what(pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = key
                held.append(batch.slice(i, j - i))
        if held:
            yield from what(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition(tasks, "bucket", "x", "y") if tasks else rows.repartition("bucket", "x", "y")
    return dealt.sortWithinPartitions("bucket", "x", "y").mapInArrow(lean(run), schema)


def by_cells(rows: DataFrame, what: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, most_rows: int, most_bytes: int, tasks: int | None = None) -> DataFrame:
    """As by_cell, but what gets whole cells of a task, in order, as one table, until they have most_rows rows or most_bytes bytes: most cells have a few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size, key = [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in ("bucket", "x", "y")])
            if count >= most_rows or size >= most_bytes:
                other = np.flatnonzero((keys != key[:, None]).any(0))
                if len(other):
                    yield from what(pa.Table.from_batches([*held, batch.slice(0, other[0])]).combine_chunks())
                    batch, held, count, size = batch.slice(other[0]), [], 0, 0
            key = keys[:, -1]
            held, count, size = [*held, batch], count + batch.num_rows, size + batch.nbytes
        if held:
            yield from what(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition(tasks, "bucket", "x", "y") if tasks else rows.repartition("bucket", "x", "y")
    return dealt.sortWithinPartitions("bucket", "x", "y").mapInArrow(lean(run), schema)


def sides(table: pa.Table) -> tuple[bool, np.ndarray, np.ndarray]:
    """Of a cell's rows: whether its blocks are two, and the rows of the one with fewer and of the other."""
    x, y, block = (table.column(k).to_numpy() for k in ("x", "y", "in_block"))
    apart = bool(x[0] != y[0])
    first = np.flatnonzero(block == x[0])
    second = np.flatnonzero(block == y[0]) if apart else first
    return apart, *((first, second) if len(first) <= len(second) else (second, first))
