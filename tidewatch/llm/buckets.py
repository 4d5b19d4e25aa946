"""Items dealt to buckets in packed strings, and what shares a bucket.

Entries of 32 bytes travel by the part of the bucket's hash that they fall into, all entries of an Arrow batch for one
part as one binary value, so Spark shuffles and sorts a few rows where it would move one for each key. A task reads its
parts one after the other and sorts the entries of one part at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean

ENTRY = np.dtype([("bucket", "<u8"), ("item", "<i8"), ("sketch", "<i8"), ("size", "<i4"), ("place", "<i4")])
PACKED = "part int, entries binary"
SHARED = "bucket long, place long, size long, sketch long, item long, crowd long, near long, also long"


def parts_for(entries: int, each: int = 100_000) -> int:
    """A power of two, so that a part has `each` entries or fewer on average: a few MB."""
    return 1 << max(6, (entries // each).bit_length())


def packed(entries: np.ndarray, parts: int) -> pa.RecordBatch:
    """A row for each part that has some of the entries (an array of ENTRY)."""
    part = (entries["bucket"] >> np.uint64(64 - (parts - 1).bit_length())).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    ends = np.append(first, len(part))[: len(first) + 1] * ENTRY.itemsize
    values = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(entries[order].tobytes())]) if len(first) else pa.array([], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), values], ["part", "entries"])


def _of_part(entries: np.ndarray, allowed: Callable[..., np.ndarray], hub_above: int) -> pa.RecordBatch:
    by = np.argsort(entries["bucket"], kind="stable")
    bucket = entries["bucket"][by]
    same = bucket[1:] == bucket[:-1]
    rows = entries[by[np.append(same, False) | np.append(False, same)]]
    rows = rows[np.lexsort((rows["item"], rows["size"], rows["place"], rows["bucket"]))]
    if len(rows):
        # of rows that are one item in one bucket, the first place stays
        once = rows[np.lexsort((rows["place"], rows["item"], rows["bucket"]))]
        new = np.append(True, (once["bucket"][1:] != once["bucket"][:-1]) | (once["item"][1:] != once["item"][:-1]))
        if not new.all():
            rows = once[new]
            rows = rows[np.lexsort((rows["item"], rows["size"], rows["place"], rows["bucket"]))]
    start = np.flatnonzero(np.append(True, rows["bucket"][1:] != rows["bucket"][:-1])) if len(rows) else np.empty(0, np.int64)
    count = np.diff(np.append(start, len(rows)))
    crowd = np.repeat(count, count)
    rows, crowd = rows[crowd > 1], crowd[crowd > 1]
    first = np.flatnonzero(np.append(True, rows["bucket"][1:] != rows["bucket"][:-1])) if len(rows) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(rows)))
    at = np.arange(len(rows))
    head = np.repeat(first, size)
    if rows["sketch"].any():
        # the bits that most sketches of a bucket have, and how many of them each lacks
        bits = np.unpackbits(np.ascontiguousarray(rows["sketch"]).view(np.uint8).reshape(-1, 8), axis=1)
        middle = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int32) > size[:, None], axis=1).view(np.uint64).ravel()
        away = np.bitwise_count(rows["sketch"].view(np.uint64) ^ np.repeat(middle, size)).astype(np.int64)
        head = np.repeat(np.minimum.reduceat(away << 40 | at, first) & ((1 << 40) - 1), size)
    test = lambda x, y: allowed(*(rows[k][i].astype(np.int64) for i in (x, y) for k in ("place", "size", "sketch")))
    other, first_of = head != at, np.append(True, rows["bucket"][1:] != rows["bucket"][:-1])[: len(rows)]
    fits, large = test(head, at), crowd > hub_above
    near = np.where(other & (fits | large), head, -1)
    missed = np.flatnonzero(other & ~fits & ~first_of & (at - 1 != head))
    missed = missed[test(missed - 1, missed)]
    also = np.full(len(rows), -1)
    also[missed[large[missed]]] = missed[large[missed]] - 1
    near[missed[~large[missed]]] = missed[~large[missed]] - 1
    columns = [pa.array(rows["bucket"].view(np.int64)), *(pa.array(rows[k].astype(np.int64)) for k in ("place", "size", "sketch", "item")), pa.array(crowd.astype(np.int64)), *(pa.array(rows["item"][x], mask=x < 0) for x in (near, also))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SHARED.split(", ")])


def shared_buckets(dealt: DataFrame, allowed: Callable[..., np.ndarray], hub_above: int = 1 << 62) -> DataFrame:
    """(bucket, place, size, sketch, item, crowd, near, also) of buckets with two items or more, each item once.

    dealt: (part, entries). allowed: as in components.linked_groups. crowd: items in the bucket. near: the item to hold
    this one against at first: of its bucket the one whose sketch is nearest to the bits that most have (of several the
    first by place, size and item), or where that pair isn't allowed the one before it, if that one is. In buckets of
    over hub_above items near is that first one anyway, as distances to it rule out other pairs, and also the one before.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for now, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if now != part and held:
                    yield _of_part(np.frombuffer(b"".join(held), ENTRY), allowed, hub_above)
                    held = []
                part = now
                held.append(value.as_py())
        if held:
            yield _of_part(np.frombuffer(b"".join(held), ENTRY), allowed, hub_above)

    return dealt.repartition("part").sortWithinPartitions("part").mapInArrow(lean(read), SHARED)


def first_candidates(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: each item with those that shared_buckets names for it."""
    pairs = shared.select("item", F.explode(F.array_compact(F.array("near", "also"))).alias("other"))
    return pairs.select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")).distinct()
