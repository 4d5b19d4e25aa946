"""N-gram Jaccard join: documents whose sets of word shingles are alike, by grouped prefixes.

A set's prefix under a total order of shingles is as long as a link demands that two prefixes meet. The order puts
shingles that many documents hold last (their counts are taken over all documents; at most `ordered` frequent ones are
known by count, the others follow by hash), so prefixes consist of rare shingles. Documents with the same prefix and
the same set size are one group, and groups alone travel to the buckets of their prefixes' shingles. A bucket allows a
pair of groups if what follows its shingle in both orders is enough for a link (the first shingle that two linked sets
share always does). At first each group is held against one other of its bucket, and each member of a group against
its first; then pairs of groups that still have members of more than one class are expanded to those members, so that
every pair that could join two classes is checked, and none inside a class. A candidate pair is dropped if the sum over
256 ranges of hashes of the smaller count bounds its intersection too low, and else verified on the sets.

Links are exact: 100 * intersection >= percent * union. Sets are of 52 bits of hashes of the words' hashes, and a set
is known by 64 bits of its own. Null and empty texts have no shingles and link with nothing; fewer words than `words`
make one shingle of all. Repeated rows and rows of equal ids are rows of one set. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import ENTRY, PACKED, first_candidates, packed, parts_for, shared_buckets
from .components import connected
from .storage import discard, free_names, lean, maybe_among, text_key, written
from .words import SLICE_ROWS, Words, mix, signed, slices, window_hashes

_RANGES = 256
_BITS = 52
assert SLICE_ROWS <= 1 << (64 - _BITS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of each row of a slice, sorted by row and hash."""
    found = Words(data, offsets, lower=True)
    h = found.hashes()
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    left, row = found.left(), found.row
    full = np.flatnonzero(left >= words)
    short = np.flatnonzero((found.counts > 0) & (found.counts < words))
    rows, values = [row[full]], [window_hashes(h, words)[full]]
    for size in range(1, words):
        mine = short[found.counts[short] == size]
        rows.append(mine)
        values.append(mix(window_hashes(h, size)[found.first[:-1][mine]] + np.uint64(size)))
    both = np.sort(np.concatenate(rows).astype(np.uint64) << np.uint64(_BITS) | np.concatenate(values) >> np.uint64(64 - _BITS))
    both = both[np.append(True, both[1:] != both[:-1])]
    return (both >> np.uint64(_BITS)).astype(np.int64), both & np.uint64((1 << _BITS) - 1)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of a set of n two linked sets' prefixes share one of at least."""
    return n - (percent * n + 99) // 100 + 1


def _row_sums(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """Of sorted rows, the sums of their values."""
    out = np.zeros(rows, np.uint64)
    if len(row):
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.add.reduceat(value, first)
    return out


class Order:
    """The frequent shingles with classes of their counts (eighths of a power of two), 1 to 255; all others have class 0. Within a class shingles go by hash."""

    def __init__(self, shingles: np.ndarray, counts: np.ndarray):
        by = np.argsort(shingles)
        self.shingles = shingles[by]
        self.classes = np.minimum(1 + 8 * np.log2(np.maximum(counts[by], 1)), 255).astype(np.uint64)

    def of(self, value: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(value), np.uint64)
        at = np.minimum(np.searchsorted(self.shingles, value), len(self.shingles) - 1)
        return np.where(self.shingles[at] == value, self.classes[at], np.uint64(0))

    def sort(self, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The order of shingles of each row (rows ascending): by class, then by hash."""
        return np.lexsort((value, row.astype(np.uint64) << np.uint64(8) | self.of(value)))


def _frequent(keyed: DataFrame, words: int, least: int, ordered: int) -> Order:
    """Shingles that `least` different texts among 2000 rows in a row hold or more, with their summed counts: those in a few thousandths of all texts. The counts' histogram by powers of two says from which count on there are at most `ordered`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").filter(pa.array(~np.asarray(_repeated(batch.column("key")))))
            for at in range(0, len(texts), 2000):
                parts = [shingle_sets(data, offsets, words)[1] for _, _, data, offsets in slices(texts.slice(at, 2000))]
                value, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch({"shingle": pa.array(signed(value[n >= least])), "n": pa.array(n[n >= least].astype(np.int64))})

    counted = written(keyed.mapInArrow(lean(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")))
    power = F.floor(F.log2("n")).cast("int")
    above, cut = 0, 0
    for r in sorted(counted.groupBy(power.alias("power")).count().collect(), key=lambda r: -r["power"]):  # 64 rows at most
        above += r["count"]
        if above > ordered:
            cut = r["power"] + 1
            break
    top = counted.filter(power >= cut).toPandas()  # at most `ordered` rows of 16 bytes
    discard(counted)
    return Order(top["shingle"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64))


def _repeated(keys: pa.Array) -> np.ndarray:
    """Which keys of a batch came before in it."""
    codes = keys.dictionary_encode().indices.to_numpy()
    first = np.zeros(len(codes), bool)
    first[np.unique(codes, return_index=True)[1]] = True
    return ~first


def _sets(raw: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]


def jaccard_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = 5, percent: int = 80, least: int = 2, ordered: int = 500_000, with_key: bool = False) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id: the smallest id that links lead to, its own included; null only if all those ids are null. with_key adds key, storage.text_key of the text."""
    keyed = docs.select(F.col(id_column), text_key(text_column).alias("key"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    order = docs.sparkSession.sparkContext.broadcast(_frequent(keyed.select("key", "text"), words, least, ordered))  # 16 bytes for each ordered shingle

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                rows = j - i
                row, value = shingle_sets(data, offsets, words)
                n = np.bincount(row, minlength=rows)
                item = signed(mix(_row_sums(row, mix(value ^ np.uint64(0x5851F42D4C957F2D)), rows) + n.astype(np.uint64)))
                value = value[order.value.sort(row, value)]
                ends = np.concatenate([[0], np.cumsum(n)])
                place = np.arange(len(row)) - ends[row]
                inside = place < prefix_size(n, percent)[row]
                group = signed(mix(_row_sums(row[inside], mix(value[inside] ^ mix(place[inside].astype(np.uint64) + np.uint64(3))), rows) + n.astype(np.uint64)))
                raw, shingles, ranges = value.tobytes(), [], []
                part = (value >> np.uint64(_BITS - 8)).astype(np.int64)
                for a, b, x in zip(ends[:-1].tolist(), ends[1:].tolist(), item.tolist(), strict=True):
                    if a == b or x in seen:  # a set is described once a task
                        shingles.append(None)
                        ranges.append(None)
                        continue
                    seen.add(x)
                    counts = np.bincount(part[a:b], minlength=_RANGES)
                    shingles.append(raw[8 * a : 8 * b])
                    ranges.append(np.minimum(counts, 255).astype(np.uint8).tobytes() if counts.max() <= 255 else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, rows), batch.column(1).slice(i, rows), pa.array(n.astype(np.int64)), pa.array(item), pa.array(group), pa.array(shingles, pa.binary()), pa.array(ranges, pa.binary())],
                    [id_column, "key", "n", "item", "group", "shingles", "ranges"],
                )

    kind = keyed.dtypes[0][1]
    rows = written(keyed.mapInArrow(lean(describe), f"`{id_column}` {kind}, key binary, n long, item long, group long, shingles binary, ranges binary"))
    described = rows.filter("shingles IS NOT NULL")
    items = written(described.groupBy("item").agg(F.first("group").alias("group"), F.first("n").alias("n"), F.first("ranges").alias("ranges")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out = []
            for group, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if group not in seen:
                    seen.add(group)
                    shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                    prefix = shingles[: prefix_size(np.array(len(shingles)), percent)]
                    entry = np.zeros(len(prefix), ENTRY)
                    entry["bucket"], entry["item"], entry["size"], entry["place"] = mix(prefix), group, len(shingles), np.arange(len(prefix))
                    out.append(entry)
            if out:
                yield packed(np.concatenate(out), parts)

    def allowed(x_place: np.ndarray, x: np.ndarray, _: np.ndarray, y_place: np.ndarray, y: np.ndarray, __: np.ndarray) -> np.ndarray:
        """The intersection is at most what follows the place in either set, and must be percent / (100 + percent) of both sizes."""
        return (100 + percent) * np.minimum(x - x_place, y - y_place) >= percent * (x + y)

    allowed_sql = f"{100 + percent} * least(x.size - x.place, y.size - y.place) >= {percent} * (x.size + y.size)"
    parts = parts_for(int(items.agg(F.sum("n")).first()[0] or 0) * (110 - percent) // 100)
    entries = written(shared_buckets(described.select("group", "shingles").mapInArrow(lean(deal), PACKED), allowed).withColumnRenamed("item", "group"))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).to_numpy() for k in ("x_n", "y_n"))
            keep = 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
            known = keep & pc.and_(pc.greater(pc.binary_length(batch.column("x_ranges")), 0), pc.greater(pc.binary_length(batch.column("y_ranges")), 0)).to_numpy(zero_copy_only=False)
            at = pa.array(np.flatnonzero(known))
            if len(at):
                p, q = (np.frombuffer(b"".join(batch.column(k).take(at).to_pylist()), np.uint8).reshape(-1, _RANGES) for k in ("x_ranges", "y_ranges"))
                most = np.minimum(p, q).sum(axis=1, dtype=np.int64)
                keep[known] = 100 * most >= percent * (x[known] + y[known] - most)
            yield pa.record_batch({"a": batch.column("a").filter(pa.array(keep)), "b": batch.column("b").filter(pa.array(keep))})

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column("x")), _sets(batch.column("y")), strict=True):
                all_ = np.sort(np.concatenate([x, y]))
                both = int((all_[1:] == all_[:-1]).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch({"a": batch.column("a").filter(pa.array(keep, pa.bool_())), "b": batch.column("b").filter(pa.array(keep, pa.bool_()))})

    def verify(candidates: DataFrame) -> DataFrame:
        x = items.select(F.col("item").alias("a"), F.col("n").alias("x_n"), F.col("ranges").alias("x_ranges"))
        y = items.select(F.col("item").alias("b"), F.col("n").alias("y_n"), F.col("ranges").alias("y_ranges"))
        close = written(candidates.join(x, "a").join(y, "b").select("a", "b", "x_n", "y_n", "x_ranges", "y_ranges").mapInArrow(lean(bounded), "a long, b long"))
        asked = close.select(F.col("a").alias("item")).union(close.select("b")).distinct()
        got = written(maybe_among(described.select("item", "shingles"), asked, "item").join(asked, "item", "left_semi").groupBy("item").agg(F.first("shingles").alias("shingles")))
        both = close.join(got.select(F.col("item").alias("a"), F.col("shingles").alias("x")), "a").join(got.select(F.col("item").alias("b"), F.col("shingles").alias("y")), "b")
        out = written(both.select("a", "b", "x", "y").mapInArrow(lean(checked), "a long, b long"))
        discard(close, got)
        return out

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    groups = items.groupBy("group").agg(F.min("item").alias("rep"), F.count(F.lit(1)).alias("members"))
    held = first_candidates(entries.withColumnRenamed("group", "item"))
    reps = held.join(groups.select(F.col("group").alias("a"), F.col("rep").alias("x")), "a").join(groups.select(F.col("group").alias("b"), F.col("rep").alias("y")), "b").select(*pair("x", "y"))
    inside = items.join(groups.filter("members > 1"), "group").filter("item <> rep").select(*pair("item", "rep"))
    asked = written(reps.union(inside).distinct())
    linked = verify(asked)
    first = written(connected(linked))
    rooted = written(items.select("item", "group").join(first, "item", "left").withColumn("root", F.coalesce("root", "item")))
    classes = rooted.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"))
    # a bucket of two groups has no other pair of groups than the one that was held, whose members may be more than those checked
    few = first_candidates(entries.filter("crowd = 2").withColumnRenamed("group", "item")).withColumnsRenamed({"a": "g", "b": "h"})
    side = lambda g: classes.select(F.col("group").alias(g), *(F.col(c).alias(f"{g}_{c}") for c in ("low", "high", "members")))
    two = few.join(side("g"), "g").join(side("h"), "h").filter("(g_members > 1 OR h_members > 1) AND NOT (g_low = h_high AND g_high = h_low)").select("g", "h")
    known = entries.filter("crowd > 2").join(classes, "group").drop("near", "also")
    mixed = known.groupBy("bucket").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("bucket")
    left = written(known.join(mixed, "bucket"))
    x, y = left.alias("x"), left.alias("y")
    meet = F.expr("x.bucket = y.bucket AND x.group < y.group AND NOT (x.low = y.high AND x.high = y.low) AND " + allowed_sql)
    own = classes.filter("low < high").select(F.col("group").alias("g"), F.col("group").alias("h"))
    across = x.join(y, meet).select(F.col("x.group").alias("g"), F.col("y.group").alias("h")).union(two).distinct().union(own)
    of = lambda g, item, root: rooted.select(F.col("group").alias(g), F.col("item").alias(item), F.col("root").alias(root))
    expanded = across.join(of("g", "x", "x_root"), "g").join(of("h", "y", "y_root"), "h").filter("x_root <> y_root").select(*pair("x", "y")).distinct()
    second = verify(expanded.join(asked, ["a", "b"], "left_anti"))
    stars = first.filter("item <> root").select(F.col("root").alias("a"), F.col("item").alias("b"))
    joined = written(connected(stars.union(second)))
    discard(items, entries, asked, linked, first, rooted, left, second)
    own_columns = [id_column, *["key"] * with_key]
    final = rows.select(*own_columns, "n", "item").join(joined, "item", "left").withColumn("root", F.coalesce("root", "item"))
    least_id = rows.filter("n > 0").groupBy("item").agg(F.min(id_column).alias("least")).join(joined, "item", "left")
    least_id = least_id.groupBy(F.coalesce("root", "item").alias("root")).agg(F.min("least").alias("component_id"))
    linked_rows = final.filter("n > 0").join(least_id, "root").select(*own_columns, F.col("n").alias("n_shingles"), "component_id")
    out = written(linked_rows.union(rows.filter("n = 0").select(*own_columns, F.col("n").alias("n_shingles"), F.col(id_column).alias("component_id"))))
    discard(rows, joined)
    return out


def one_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **join: int) -> DataFrame:
    """docs without near duplicates: of each group the row of the smallest id stays (one of them, if rows of that id share its text); rows without shingles all stay."""
    own, key, of, empty = free_names(docs, "own", "key", "of", "empty")
    groups = jaccard_groups(docs, id_column, text_column, with_key=True, **join)
    kept = groups.filter(F.col(id_column).eqNullSafe(F.col("component_id"))).select(F.col(id_column).alias(own), F.col("key").alias(of), (F.col("n_shingles") == 0).alias(empty)).distinct()
    met = docs.withColumn(key, text_key(text_column)).join(kept, F.col(id_column).eqNullSafe(F.col(own)) & (F.col(key) == F.col(of)))
    first = met.filter(~F.col(empty)).dropDuplicates([id_column, key])
    return first.union(met.filter(F.col(empty))).select(*docs.columns)
