"""MinHash near-dedup with sequential Bayesian verification.

Each different text has a signature of 128 minima over its set of word shingles, kept as a byte each, and 25 bands of
five minima; two sets of Jaccard similarity 0.8 share no band with probability (1 - 0.8 ** 5) ** 25 = 5e-5. What shares
a band is a candidate. Of a candidate pair's signatures 32 places after 32 are compared; after each batch the posterior
of the similarity (uniform prior) says how likely the pair still is a link, and below `miss` it is dropped. What
survives all batches is verified on the full sets, so links are exact and a pair is lost only by the two chances named.

Groups are found without all pairs of a band's bucket. First each member is held against the smallest of its bucket.
Buckets that then still hold members of several classes are cut into blocks, the members of the largest class apart
from the rest, and pairs of blocks (never two blocks of the largest class) compare signatures of members of different
classes. So a bucket with a third of all texts in one class costs its size times what else it holds, spread over tasks.

Sets are of 64-bit hashes of `words` neighbouring words (`[^\\x20\\x09-\\x0D]+`, A-Z lowered); a text with fewer words is
one shingle of all, and one with none (null, empty, white space) has no set and links with nothing. Equal texts are one
item; which row they came from never matters, so repeated rows and rows of equal ids share a component. A null id is no
smallest id: component_id is null only where all ids of the component are. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import CELL, CELL_SQL, by_cell, dealt_to_cells, sides
from .components import connected
from .storage import discard, distinct_texts, joined_by_key, lean, text_key, written
from .words import Words, mix, signed, slices, window_hashes

PLACES, BATCH = 128, 32
BANDS, TOGETHER = 25, 5
#: Members of a block of a bucket: two blocks' signatures are half a MB.
BLOCK = 2048
#: And shingles of a block, where it has long texts: 8 MB.
SHINGLES = 1 << 20
_FACTORS = mix(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of each row of a slice, sorted by row and hash."""
    found = Words(data, offsets, lower=True)
    h = found.hashes()
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    full = np.flatnonzero(found.left() >= words)
    rows, values = [found.row[full]], [window_hashes(h, words)[full]]
    for size in range(1, words):
        mine = np.flatnonzero(found.counts == size)
        rows.append(mine)
        values.append(mix(window_hashes(h, size)[found.first[:-1][mine]] + np.uint64(size)))
    row, value = np.concatenate(rows), np.concatenate(values)
    by = np.lexsort((value, row))
    row, value = row[by], value[by]
    new = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))
    return row[new], value[new]


def signatures(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a set, a byte for each of PLACES minima, the hash of each band)."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
    least = np.empty((len(first), PLACES), np.uint64)
    at = 0
    while at < len(first):  # runs of rows whose hashes stay in the processor's cache
        to = max(at + 1, int(np.searchsorted(first, first[at] + 32_768)))
        mine, starts = value[first[at] : first[to] if to < len(first) else None], first[at:to] - first[at]
        for k in range(PLACES):
            least[at:to, k] = np.minimum.reduceat(mine * _FACTORS[k], starts)
        at = to
    bands = np.empty((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        code = np.full(len(first), b, np.uint64)
        for k in range(b * TOGETHER, (b + 1) * TOGETHER):
            code = mix(code * _SPREAD + least[:, k])
        bands[:, b] = code
    return row[first], mix(least.ravel()).astype(np.uint8).reshape(-1, PLACES), bands


@lru_cache
def least_matches(percent: int, miss: float) -> tuple[int, ...]:
    """After each batch, how many places must agree for the pair to stay.

    With m of n places equal and a uniform prior the similarity is Beta(m + 1, n - m + 1); its chance of being the
    threshold t or more is that of at most m successes in n + 1 trials of chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, PLACES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def staying(a: np.ndarray, b: np.ndarray, needed: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs (rows of a with rows of b) that no batch drops, and how many places agree."""
    left, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, least in enumerate(needed):
        span = slice(i * BATCH, (i + 1) * BATCH)
        equal = equal + (a[left, span] == b[left, span]).sum(1)
        left, equal = left[equal >= least], equal[equal >= least]
    return left, equal


def _described(docs: DataFrame, id_type: str, words: int) -> DataFrame:
    """A row for each different text of each batch: its key, the number of its shingles, signature, bands, copies and smallest id."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table({"key": batch.column(0), "at": pa.array(np.arange(batch.num_rows)), "id": batch.column(1)})
            once = rows.group_by("key").aggregate([("at", "min"), ("at", "count"), ("id", "min")])
            texts = batch.column(2).take(once.column("at_min").combine_chunks())
            for i, j, data, offsets in slices(texts, 400_000):
                row, value = shingles(data, offsets, words)
                which, places, bands = signatures(row, value)
                n = np.bincount(row, minlength=j - i)
                held = np.repeat(0, j - i)
                held[which] = 1
                sizes = np.append(0, np.cumsum(held)).astype(np.int32)
                part = once.slice(i, j - i)
                signature = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(sizes * np.int32(PLACES)), pa.py_buffer(np.ascontiguousarray(places))])
                buckets = pa.ListArray.from_arrays(pa.array(sizes * np.int32(BANDS), pa.int32()), pa.array(signed(bands.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").combine_chunks(), pa.array(n.astype(np.int64)), signature, buckets, part.column("at_count").combine_chunks(), part.column("id_min").combine_chunks()],
                    ["key", "n", "signature", "buckets", "copies", "least"],
                )

    return docs.mapInArrow(lean(describe), f"key binary, n long, signature binary, buckets array<long>, copies long, least {id_type}")


def _bytes(values: pa.Array, width: int) -> np.ndarray:
    """A column of binary values of one width as rows of bytes."""
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, width)


def _surviving(pairs: DataFrame, items: DataFrame, needed: tuple[int, ...]) -> DataFrame:
    """Those of the pairs (a, b) that the comparison of signatures, batch by batch, doesn't drop."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay, _ = staying(_bytes(batch.column(2), PLACES), _bytes(batch.column(3), PLACES), needed)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(stay)) for k in (0, 1)], ["a", "b"])

    side = lambda name: items.select(F.col("item").alias(name), F.col("signature").alias(f"of_{name}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b").mapInArrow(lean(compare), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): the pairs, each held against the full sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, b]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                linked.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    side = lambda name: sets.select(F.col("item").alias(name), F.col("members").alias(f"of_{name}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b").mapInArrow(lean(verify), "a long, b long, linked boolean")


def _sets(docs: DataFrame, text: str, wanted: DataFrame, words: int) -> DataFrame:
    """(item, members): the sorted hashes of the set of each wanted (key, item)."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), 400_000):
                row, value = shingles(data, offsets, words)
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=j - i))).astype(np.int32) * np.int32(8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), pa.py_buffer(value)])], ["item", "members"])

    return distinct_texts(docs, text).join(wanted, "key").select("item", "text").mapInArrow(lean(members), "item long, members binary")


class _Cell:
    """The members of two blocks: for each of one block (first), those of the other that are of another class and that the comparison of signatures doesn't drop."""

    def __init__(self, table: pa.Table, needed: tuple[int, ...]):
        self.table, self.needed = table, needed
        self.item, self.root = (table.column(k).to_numpy() for k in ("item", "root"))
        self.places = _bytes(table.column("signature"), PLACES)
        self.apart, self.first, self.second = sides(table)

    def candidates(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row of first, rows of second, places that agree)."""
        for i in self.first:
            mine = self.second[(self.root[self.second] != self.root[i]) & (self.apart | (self.item[self.second] > self.item[i]))]
            stay, equal = staying(np.broadcast_to(self.places[i], (len(mine), PLACES)), self.places[mine], self.needed)
            if len(stay):
                yield i, mine[stay], equal

    def _pairs(self, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(f(self.item[x], self.item[y])) for f in (np.minimum, np.maximum)], ["a", "b"])

    def nearest(self) -> Iterator[pa.RecordBatch]:
        """(a, b): each member and the candidate with most places equal."""
        most, partner = np.zeros(len(self.item), np.int64), np.full(len(self.item), -1)
        for i, stay, equal in self.candidates():
            better = equal > most[stay]
            most[stay[better]], partner[stay[better]] = equal[better], i
            if equal.max() > most[i]:
                most[i], partner[i] = equal.max(), stay[equal.argmax()]
        found = np.flatnonzero(partner >= 0)
        yield self._pairs(found, partner[found])

    def undecided(self) -> Iterator[pa.RecordBatch]:
        """The rows that have a candidate."""
        some = np.zeros(len(self.item), bool)
        for i, stay, _ in self.candidates():
            some[i] = some[stay] = True
        yield from self.table.select(CELL).filter(pa.array(some)).to_batches()

    def links(self, percent: int) -> Iterator[pa.RecordBatch]:
        """(a, b): each member with one linked member of each other class, by the full sets."""
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in self.table.column("members")]
        size = np.array([len(v) for v in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.cumsum(size) - size
        flag = np.zeros(int(codes.max()) + 1, bool)
        at = np.concatenate([np.arange(starts[k], starts[k] + size[k]) for k in self.second])
        theirs, begin = codes[at], np.cumsum(size[self.second]) - size[self.second]
        where = np.empty(len(sets), np.int64)
        where[self.second] = np.arange(len(self.second))
        for i, stay, _ in self.candidates():
            mine = codes[starts[i] : starts[i] + size[i]]
            flag[mine] = True
            shared = np.add.reduceat(flag[theirs].astype(np.int64), begin)[where[stay]]
            flag[mine] = False
            linked = stay[100 * shared >= percent * (size[i] + size[stay] - shared)]
            one = linked[np.unique(self.root[linked], return_index=True)[1]]
            yield self._pairs(np.full(len(one), i), one)


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, miss: float = 1e-6, id: str = "doc_id", text: str = "text", block: int = BLOCK, rounds: int = 2) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: size of its set, smallest id of all rows reachable by links, whether that is its own.

    A link is 100 * intersection >= percent * union of two sets of `words`-word shingles. miss: the posterior chance of
    being a link under which a pair of signatures is dropped. rounds: how often members are held against their nearest of
    another class before all pairs of classes are compared; it changes no result. The other cases are defined in the module's docstring.
    """
    docs, needed = docs.select(F.col(id).alias("id"), F.col(text).alias("text")), least_matches(percent, miss)
    described = _described(docs.select(text_key("text").alias("key"), "id", "text"), docs.schema["id"].dataType.simpleString(), words)
    once = described.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "signature", "buckets")), F.sum("copies").alias("copies"), F.min("least").alias("least"))
    items = written(once.select(F.monotonically_increasing_id().alias("item"), "*"))

    entries = items.select("item", F.explode("buckets").alias("bucket"))
    heads = entries.groupBy("bucket").agg(F.min("item").alias("head"), F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    met = written(entries.join(heads, "bucket"))
    asked = written(_surviving(met.filter("item <> head").select(F.col("head").alias("a"), F.col("item").alias("b")).distinct(), items, needed))
    wanted = met.select("item").distinct().join(items.select("item", "key"), "item")
    sets = written(_sets(docs, "text", wanted, words))
    linked = lambda pairs: written(_verified(pairs, sets, percent).filter("linked").select("a", "b"))
    more = linked(asked)
    roots = written(connected(more))
    shared = met.filter("crowd > 2").join(items.select("item", "n"), "item").select("bucket", "item", "n")
    marks = items.select("item", "signature")
    for step in range(rounds + 1):
        members = shared.join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
        cells = dealt_to_cells(members, block, SHINGLES).join(marks, "item").select(*CELL, "signature")
        discard(more)
        if step < rounds:
            across = written(by_cell(cells, lambda cell: _Cell(cell, needed).nearest(), "a long, b long").distinct().join(asked, ["a", "b"], "left_anti"))
            more = linked(across)
            asked, done = written(asked.union(across)), asked
            discard(across, done)
        else:
            open_rows = written(by_cell(cells, lambda cell: _Cell(cell, needed).undecided(), CELL_SQL))
            whole = open_rows.join(marks, "item").join(sets, "item").select(*CELL, "signature", "members")
            more = written(by_cell(whole, lambda cell: _Cell(cell, needed).links(percent), "a long, b long").distinct())
            discard(open_rows)
        before, roots = roots, written(connected(roots.filter("item <> root").select(F.col("root").alias("a"), F.col("item").alias("b")).union(more)))
        discard(before)
    discard(met, asked, sets, more)

    of_item = items.select("item", "key", "n", "copies", "least").join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    least = of_item.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(of_item.join(least, "root").select("key", "n", "copies", "component_id"))
    discard(items, roots)
    out = joined_by_key(docs.select("id", text_key("text").alias("key")), classes, "key", "copies")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
