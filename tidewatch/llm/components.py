"""Connected groups of items that buckets make candidates, without all pairs of a bucket.

Items that share a bucket are candidates; verify() says which candidates are linked. The groups of all links are
found in two passes that together miss none: first each item is held only against the first of its bucket's order (or,
where that can't be, its neighbour there), which joins nearly all of a large group of near copies with about one check
an item; then, for buckets that still hold items of more than one group, every allowed pair of items of different groups
is checked. Pairs inside a group need no check: they can't change it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import first_candidates
from .storage import discard, lean, written

#: Items that a task holds at once when it makes stars of its links: some 100 MB.
_HELD = 500_000


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars around their smallest members: same groups, at most a link an item. After _HELD items the stars so far go out and new ones begin."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def stars() -> Iterator[pa.RecordBatch]:
        items = [x for x in up if top(x) != x]
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.record_batch({"a": pa.array([top(x) for x in part], pa.int64()), "b": pa.array(part, pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > _HELD:
            yield from stars()
            up.clear()
    yield from stars()


def connected(links: DataFrame, most_rounds: int = 200, one_task: int = 200_000) -> DataFrame:
    """(item, root) of every item of links (a long, b long): root is the smallest item of its group.

    Stars within each task first. Where at most one_task links are left (16 bytes each), one task ends it; else large
    and small stars follow in turn (Kiveris and others) until nothing changes; their number of rounds grows with the
    logarithm of the largest group, and over most_rounds is an error. Each round is a written table; only its number of
    rows and a checksum reach the driver.
    """
    edges = written(links.select("a", "b").filter("a <> b").mapInArrow(lean(_local_stars), "a long, b long"))
    if edges.count() <= min(one_task, _HELD):
        edges = written(edges.coalesce(1).mapInArrow(lean(_local_stars), "a long, b long"))
    else:
        edges, mark = edges.distinct(), None
        for _ in range(most_rounds):
            now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
            if now == mark:
                break
            mark = now
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root"))
            large = both.filter("b > a").join(least, "a").select(F.col("root").alias("a"), "b").filter("a <> b").distinct()
            # a < b in every edge now: each b with all its smaller neighbours goes to the smallest of them
            small = large.groupBy("b").agg(F.min("a").alias("root"))
            moved = large.join(small, "b").select(F.col("root").alias("a"), F.when(F.col("a") == F.col("root"), F.col("b")).otherwise(F.col("a")).alias("b"))
            direct = small.select(F.col("root").alias("a"), "b")
            edges = written(moved.union(direct).filter("a <> b").distinct())
        else:
            raise RuntimeError(f"links still change after {most_rounds} rounds")
    pairs = edges.groupBy("b").agg(F.min("a").alias("root"))
    roots = edges.select(F.col("a").alias("item")).distinct().join(pairs.select(F.col("b").alias("item")), "item", "left_anti")
    return pairs.select(F.col("b").alias("item"), "root").union(roots.select("item", F.col("item").alias("root")))


def linked_groups(entries: DataFrame, verify: Callable[[DataFrame], DataFrame], allowed_sql: str = "true", apart_sql: str = "false", settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(item, root) of every item with a link. A written table.

    entries: a written table from buckets.shared_buckets. verify: candidate pairs (a, b) to (a, b, linked, distance,
    unit) of those that may be linked. allowed_sql (over x.place, x.size, x.sketch, y.place and so on; symmetric) says
    whether a bucket allows a pair at all, as the function given to shared_buckets does; each linked pair must be
    allowed in one bucket at least. apart_sql (over these, x.distance, x.unit and so on) says whether two items that
    were held against the same one can't be linked by the distances to it alone. settle: instead of the join over
    allowed_sql and apart_sql, from the rows of buckets that still hold several groups (bucket, item, root, size,
    sketch, near, distance, unit) to links (a, b) that join all groups which a pair of such a bucket links.
    """
    asked = written(first_candidates(entries))
    checked = written(verify(asked))
    first = written(connected(checked.filter("linked")))
    known = entries.filter("crowd > 2").join(first, "item", "left").withColumn("root", F.coalesce("root", "item"))  # a bucket of two has no other pair
    mixed = known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    left = known.join(mixed, "bucket").withColumns({"a": F.least("item", "near"), "b": F.when(F.col("near").isNotNull(), F.greatest("item", "near"))})
    left = written(left.join(checked.select("a", "b", "distance", "unit"), ["a", "b"], "left").drop("a", "b", "crowd", "also"))
    if settle:
        second = settle(left)
    else:
        x, y = left.alias("x"), left.alias("y")
        ordered = F.expr(f"x.bucket = y.bucket AND x.root <> y.root AND x.item < y.item AND {allowed_sql} AND NOT coalesce(x.near = y.near AND {apart_sql}, false)")
        across = x.join(y, ordered).select(F.col("x.item").alias("a"), F.col("y.item").alias("b")).distinct()
        second = verify(across.join(asked, ["a", "b"], "left_anti")).filter("linked")
    stars = first.filter("item <> root").select(F.col("root").alias("a"), F.col("item").alias("b"))
    out = written(connected(stars.union(second.select("a", "b"))))
    discard(asked, checked, first, left)
    return out
