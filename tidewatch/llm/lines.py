"""Fuzzy line dedup: SimHash of normalised lines, joined on pigeonhole blocks and MinHash bands, verified by edit similarity.

A line is normalised: lower case, every digit to 0 (with figures, digits stay and count in every comparison, so that
rows of numbers are no copies of each other; the queries ask for that), and of the rest its words (ASCII letters,
digits, and all characters beyond ASCII but the punctuation of _PUNCTUATION) joined by one space; lines without a word
are left alone. Lines of equal normal form are one item. An item's SimHash has 64 bits over its words and word pairs.
The bits are cut into `blocks` blocks; two hashes that differ in at most `blocks - together` bits agree in `together`
blocks at least, so each choice of that many blocks is a key, and items with equal keys are candidates.

One changed word in ten moves some ten of the 64 bits, far more than pigeonhole blocks can find. So with `bands` items
are candidates too if they share a band: the words that come first under 4 random orders, in which words of 4 bytes and
more are 8 times as likely to come first. A candidate then needs sizes that the similarity allows and a SimHash distance of at
most `far`, both tested where buckets are joined, and is verified: edit distance of the normal forms at most
(100 - percent) % of the longer one (edits.alike: over characters, at any length). Without bands only pairs within `blocks - together` bits are candidates. Groups
come from components.linked_groups; of each group the first line by (id, line number) stays.

Null texts have no lines and stay null. Rows of equal ids count as rows of one document: their lines are ordered by
line number, then by text. Other columns are never read. Copies of a line in one task are described once. A line is known by 64 bits in
the groups and 128 bits in all: where lines of unlike second halves share the first, they all stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import ENTRY, PACKED, packed, parts_for, shared_buckets
from .cells import CELL, CELL_SQL, by_cells, dealt_to_cells
from .components import linked_groups
from .edits import alike, distances
from .storage import discard, free_names, lean, maybe_among, text_key, written
from .words import Words, mix, signed, slices

#: First and last code points of what is no word character beyond ASCII: C1 controls to the inverted question mark less letters and digits, times and division signs, general and CJK punctuation.
_PUNCTUATION = [(0x80, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x206F), (0x3000, 0x303F)]
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[128:] = True
_WORD_BYTE[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = True
_MASKED = np.arange(256, dtype=np.uint8)
_MASKED[48:58] = 48
_ODD2 = {lead: np.array([any(a <= (lead & 31) << 6 | b & 63 <= z for a, z in _PUNCTUATION) and 128 <= b < 192 for b in range(256)]) for lead in (0xC2, 0xC3)}
_ODD3 = {(0xE2, 0x80): np.arange(256) >= 128, (0xE2, 0x81): (np.arange(256) >= 128) & (np.arange(256) <= 0xAF), (0xE3, 0x80): np.arange(256) >= 128}
#: Words of a line that are summed up in 8 bits, with their pairs.
_LANE = 127
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
#: Bytes of text that are described at once: arrays of 8 bytes a word stay below the megabyte from which `lean` workers map memory anew.
_AT_ONCE_BYTES = 400_000
_BAND_WORDS = 4
#: Lines of a block of a bucket, each pair of which may take up to a millisecond.
BLOCK = 256
#: And their characters, where lines are long: 1 MB.
CHARACTERS = 1 << 20
#: Pairs of a cell that are compared at once, at first and at most; of several cells twice as many.
FIRST_PAIRS, AT_ONCE = 64, 2048
#: Pairs of which numbers are compared at once.
PAIRS = 1 << 16
#: Rows and bytes of cells that are compared together.
TOGETHER, TOGETHER_BYTES = 2000, 8 << 20


def cleaned(data: np.ndarray, figures: bool) -> np.ndarray:
    """Lower-case UTF-8 bytes with punctuation beyond ASCII as spaces and, without figures, digits as 0."""
    out = data.copy() if figures else _MASKED[data]
    for lead, odd in _ODD2.items():
        at = np.flatnonzero(data[:-1] == lead)
        at = at[odd[data[at + 1]]]
        out[at] = out[at + 1] = 32
    for (one, two), odd in _ODD3.items():
        at = np.flatnonzero((data[:-2] == one) & (data[1:-1] == two))
        at = at[odd[data[at + 2]]]
        out[at] = out[at + 1] = out[at + 2] = 32
    return out


class Lines:
    """The lines with a word of a slice of lower-case texts: row (of the text), number (of the line in it), words; count and size (words, characters of the normal form)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, figures: bool):
        ends = np.flatnonzero(data == 10)
        start = np.concatenate([ends + 1, offsets[:-1]])
        by = np.argsort(start, kind="stable")  # an empty last line before the next text's first
        row = np.concatenate([np.searchsorted(offsets[:-1], ends, "right") - 1, np.arange(len(offsets) - 1)])[by]
        number = np.arange(len(row)) - np.searchsorted(row, row)
        data = cleaned(data, figures)
        self.words = words = Words(data, np.append(start[by], len(data)), word_byte=_WORD_BYTE)
        full = np.flatnonzero(words.counts)
        self.row, self.number, self.count, self.first = row[full], number[full], words.counts[full], words.first[full]
        letters = np.concatenate([[0], np.cumsum(words.inside & ((data & 0xC0) != 0x80))])
        self.size = letters[words.end[self.first + self.count - 1]] - letters[words.start[self.first]] + self.count - 1 if len(full) else np.empty(0, np.int64)
        self.hash = words.hashes(5)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each line in two halves."""
        if not len(self.first):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place = np.arange(len(self.hash)) - np.repeat(self.words.first[:-1], self.words.counts)
        at = mix(place.astype(np.uint64) * np.uint64(7) + np.uint64(1))
        return tuple(signed(mix(np.add.reduceat(mix(self.hash + at ^ np.uint64(salt)), self.first) + self.count.astype(np.uint64))) for salt in (0, 0xA0761D6478BD642F))

    def forms(self) -> list[str]:
        words = self.words
        size = words.end - words.start
        begin = np.cumsum(size + 1) - size - 1
        out = np.full(int(size.sum()) + len(size), 32, np.uint8)
        out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = words.data[words.inside]
        raw, last = out.tobytes(), self.first + self.count - 1
        return [raw[a:b].decode() for a, b in zip(begin[self.first].tolist(), (begin[last] + size[last]).tolist(), strict=True)]


def simhashes(words: Words, h: np.ndarray) -> np.ndarray:
    """64 bits of each row: the sign, bit by bit, of the sum over its words and pairs of neighbours."""
    out = np.zeros(len(words.first) - 1, np.uint64)
    full = np.flatnonzero(words.counts)
    if not len(full):
        return out
    first, count = words.first[full], words.counts[full]
    pair = mix(h * np.uint64(3) + np.concatenate([h[1:], h[:1]]))
    pair = np.where(words.left() > 1, pair, h)  # a last word counts twice
    parts = -(-count // _LANE)
    begin = np.cumsum(parts) - parts
    starts = np.repeat(first, parts) + _LANE * (np.arange(int(parts.sum())) - np.repeat(begin, parts))
    bits = np.empty((len(full), 64), bool)
    h8, pair8 = h.view(np.uint8).reshape(-1, 8), pair.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        both = _SPREAD.take(h8[:, k])
        both += _SPREAD.take(pair8[:, k])
        sums = np.add.reduceat(both, starts).view(np.uint8).reshape(-1, 8)
        if len(starts) > len(full):
            sums = np.add.reduceat(sums.astype(np.int64), begin, axis=0)
        bits[:, 8 * k : 8 * k + 8] = sums > count[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def block_keys(hashes: np.ndarray, blocks: int, together: int) -> np.ndarray:
    """A column of keys for each choice of `together` blocks."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    parts = [(hashes >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    keys = []
    for n, choice in enumerate(combinations(range(blocks), together)):
        key = np.full(len(hashes), n + 1, np.uint64)
        for c in choice:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[c])
        keys.append(key)
    return np.stack(keys, axis=1)


def band_keys(lines: Lines, bands: int) -> np.ndarray:
    """A column of keys for each band: which words come first under each of its orders."""
    out = np.empty((len(lines.first), bands), np.uint64)
    if not len(lines.first):
        return out
    factors = mix(np.arange(1, bands * _BAND_WORDS + 1, dtype=np.uint64) * np.uint64(77)) | np.uint64(1)
    sooner = (np.uint64(3) * (lines.words.end - lines.words.start >= 4)).astype(np.uint64)
    for b in range(bands):
        key = np.full(len(lines.first), b + 1, np.uint64)
        for factor in factors[b * _BAND_WORDS : (b + 1) * _BAND_WORDS]:
            order = lines.hash ^ factor >> np.uint64(7)
            order *= factor
            order >>= sooner
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(order, lines.first))
        out[:, b] = mix(key ^ np.uint64(0xB5AD4ECEDA1CE2A9))
    return out


def described_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", blocks: int = 5, together: int = 2, bands: int = 0, figures: bool = False) -> DataFrame:
    """(id, key, n, item, other, simhash, size, words, keys) of every line with a word: key is storage.text_key of the text, item and other are 128 bits of the normal form, keys the 8 bytes of each of its buckets (null where the task had the item before). A written table."""
    source = docs.select(F.col(id_column), text_key(text_column).alias("key"), F.col(text_column).cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, _, data, offsets in slices(pc.utf8_lower(batch.column("text")), _AT_ONCE_BYTES):
                lines = Lines(data, offsets, figures)
                item, other = lines.names()
                new = []
                for x in item.tolist():
                    new.append(x not in seen)
                    seen.add(x)
                sim = simhashes(lines.words, lines.hash)
                sim = sim[np.flatnonzero(lines.words.counts)]
                keys = np.ascontiguousarray(np.concatenate([block_keys(sim, blocks, together), band_keys(lines, bands)], axis=1))
                rows, new = pa.array(lines.row + i), np.array(new, bool)
                raw, size = keys.tobytes(), 8 * keys.shape[1]
                lists = pa.array([raw[k * size : (k + 1) * size] if x else None for k, x in enumerate(new.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines.number.astype(np.int64)), pa.array(item), pa.array(other), pa.array(signed(sim)), pa.array(lines.size.astype(np.int64)), pa.array(lines.count.astype(np.int64)), lists],
                    [id_column, "key", "n", "item", "other", "simhash", "size", "words", "keys"],
                )

    return written(source.mapInArrow(lean(describe), f"`{id_column}` {source.dtypes[0][1]}, key binary, n long, item long, other long, simhash long, size long, words long, keys binary"))


def _forms(docs: DataFrame, asked: DataFrame, text_column: str, figures: bool) -> DataFrame:
    """(item, form) of the asked lines (item, key, n): texts are read on where they are, and only lines that may be asked for leave them."""
    size = 1 << max(18, min(21, (asked.count() // 8).bit_length()))  # 8 bits a line or more, up to 17 million lines
    place = F.struct("key", "n").alias("place")
    texts = docs.select(text_key(text_column).alias("key"), F.col(text_column).cast("string").alias("text"))  # one key for a text, not one for a line
    lines = texts.select("key", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n").cast("long"))
    # copies of a text are combined before the shuffle
    maybe = maybe_among(lines.select(place, "line"), asked.select(place), "place", size).groupBy("place").agg(F.first("line").alias("line"))
    met = maybe.select("place.*", "line").join(asked, ["key", "n"]).select("item", "line")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(pc.utf8_lower(batch.column(1)), _AT_ONCE_BYTES):
                yield pa.record_batch({"item": batch.column(0).slice(i, j - i), "form": pa.array(Lines(data, offsets, figures).forms(), pa.string())})

    return written(met.mapInArrow(lean(take), "item long, form string"))


class _Cells:
    """Cells, each with the lines of two blocks of a bucket: for each of one block those of the other that are of another class and may be linked with it.

    A pair that shares several buckets is looked at in the smallest of them alone, and not again where it was held
    together at first. By the triangle inequality, over the line that both were held against, most pairs can't be links:
    a distance that is known against one that is as much or more.
    """

    def __init__(self, table: pa.Table, percent: int, most_bits: int):
        self.percent, self.most_bits = percent, most_bits
        bucket, x, y, block, item = (table.column(k).to_numpy() for k in ("bucket", "x", "y", "in_block", "item"))
        order = np.lexsort((item, block != x, y, x, bucket))
        self.table = table = table.take(pa.array(order)).combine_chunks()
        self.bucket, self.item, x, y, block = bucket[order], item[order], x[order], y[order], block[order]
        self.root, self.size, self.sketch = (table.column(k).to_numpy() for k in ("root", "size", "sketch"))
        self.near, self.distance = (table.column(k).fill_null(-1).to_numpy() for k in ("near", "distance"))
        self.at_most, self.at_least = (pc.is_in(table.column("unit"), pa.array(known)).to_numpy() for known in ([0, 2], [0, 1]))
        lists = table.column("buckets").combine_chunks()
        counts = pc.list_value_length(lists).to_numpy()
        self.buckets = np.full((len(counts), int(counts.max())), np.iinfo(np.int64).max)
        self.buckets[np.arange(self.buckets.shape[1]) < counts[:, None]] = lists.flatten().to_numpy()
        start = np.flatnonzero(np.append(True, (self.bucket[1:] != self.bucket[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        rows = np.diff(np.append(start, len(x)))
        self.cell = np.repeat(np.arange(len(start)), rows)
        # of each row, from where to where the rows are that it meets: the second block, or what comes later of the only one
        self.low = np.where(x != y, (start + np.add.reduceat((block == x).astype(np.int64), start))[self.cell], np.arange(len(x)) + 1)
        self.meets = np.where((x != y) & (block != x), 0, (start + rows)[self.cell] - self.low)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows, in order of the first."""
        ends, at = np.cumsum(self.meets), 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            meets = self.meets[at:stop]
            i = np.repeat(np.arange(at, stop), meets)
            j = np.arange(len(i)) + np.repeat(self.low[at:stop] - (ends[at:stop] - meets - before), meets)
            at = stop
            size, other = self.size[i], self.size[j]
            stay = (100 * np.minimum(size, other) >= self.percent * np.maximum(size, other)) & (self.root[i] != self.root[j])
            i, j = i[stay], j[stay]
            stay = np.bitwise_count((self.sketch[i] ^ self.sketch[j]).view(np.uint64)) <= self.most_bits
            i, j = i[stay], j[stay]
            more = self.distance[j] - self.distance[i]
            least = np.where(self.at_most[i] & self.at_least[j] & (more > 0), more, np.where(self.at_most[j] & self.at_least[i] & (more < 0), -more, 0))
            hub = (self.near[j] == self.near[i]) & (self.near[i] >= 0) & (self.distance[i] >= 0) & (self.distance[j] >= 0)
            met = (self.near[j] == self.item[i]) | (self.item[j] == self.near[i])
            stay = ~met & (~hub | (100 * least <= (100 - self.percent) * np.maximum(self.size[i], self.size[j])))
            i, j = i[stay], j[stay]
            smaller = np.zeros(len(i), bool)  # whether they share a smaller bucket
            for k in range(self.buckets.shape[1]):
                mine = self.buckets[i, k]
                some = np.flatnonzero(mine < self.bucket[i])
                smaller[some] |= (self.buckets[j[some]] == mine[some, None]).any(1)
            if not smaller.all():
                yield i[~smaller], j[~smaller]

    def undecided(self) -> Iterator[pa.RecordBatch]:
        """The rows that have a candidate."""
        some = np.zeros(len(self.item), bool)
        for i, j in self.candidates():
            some[i] = some[j] = True
        yield from self.table.select(_KNOWN).filter(pa.array(some)).to_batches()

    def links(self) -> Iterator[pa.RecordBatch]:
        """(a, b): of each cell enough of the links to join all classes that are linked in it. Cells take turns together, as many pairs at once cost less each."""
        found = list(self.candidates())
        if not found:
            return
        i, j = (np.concatenate(side) for side in zip(*found, strict=True))
        forms, root = self.table.column("form").to_pylist(), self.root.tolist()
        starts = np.flatnonzero(np.append(True, self.cell[i[1:]] != self.cell[i[:-1]]))
        waiting = [_Open(root, i[a:b], j[a:b]) for a, b in zip(starts, [*starts[1:], len(i)], strict=True)]
        links: list[tuple[int, int]] = []
        while waiting:
            held, later, count = [], [], 0
            for n, cell in enumerate(waiting):
                if count >= 2 * AT_ONCE:
                    later = waiting[n:]
                    break
                if pairs := cell.next_pairs():
                    held.append((cell, pairs))
                    count += len(pairs)
            both = [pair for _, pairs in held for pair in pairs]
            linked, at = alike([forms[a] for a, _ in both], [forms[b] for _, b in both], self.percent).tolist() if both else [], 0
            for cell, pairs in held:
                links += cell.learn(pairs, linked[at : at + len(pairs)])
                at += len(pairs)
            waiting = later + [cell for cell, _ in held]
        if links:
            a, b = self.item[np.array(links).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


class _Open:
    """A cell whose candidates (rows of root) are being compared, some at a time: those of classes that no link has joined yet."""

    def __init__(self, root: list[int], i: np.ndarray, j: np.ndarray):
        self.root, self.up = root, {}
        self.pairs = (pair for at in range(0, len(i), AT_ONCE) for pair in zip(i[at : at + AT_ONCE].tolist(), j[at : at + AT_ONCE].tolist(), strict=True))
        self.most = FIRST_PAIRS  # four times as many each time that none of them was a link

    def top(self, row: int) -> int:
        up, r = self.up, self.root[row]
        while (higher := up.get(r, r)) != r:
            up[r] = up.get(higher, higher)
            r = higher
        return r

    def next_pairs(self) -> list[tuple[int, int]]:
        return list(islice((pair for pair in self.pairs if self.top(pair[0]) != self.top(pair[1])), self.most))

    def learn(self, pairs: list[tuple[int, int]], linked: list[bool]) -> list[tuple[int, int]]:
        """The pairs whose links join two classes."""
        self.most, out = FIRST_PAIRS if any(linked) else min(4 * self.most, AT_ONCE), []
        for (i, j), link in zip(pairs, linked, strict=True):
            a, b = self.top(i), self.top(j)
            if link and a != b:
                self.up[a] = b
                out.append((i, j))
        return out


_KNOWN = [*CELL, "size", "sketch", "near", "distance", "unit", "buckets"]
_KNOWN_SQL = CELL_SQL + ", size long, sketch long, near long, distance long, unit long, buckets array<long>"


def line_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", blocks: int = 5, together: int = 2, percent: int = 80, lines: DataFrame | None = None, bands: int = 0, figures: bool = False, far: int = 20) -> DataFrame:
    """(item, root, id, n): of each different normal form (item: 64 bits of it) its group and its first line; forms that occur once and link with nothing are left out. lines: described_lines with the same parameters, where it is known. Without bands, only pairs within the SimHash distance are linked. A written table."""
    seen = lines if lines is not None else described_lines(docs, id_column, text_column, blocks, together, bands, figures)
    most_bits = far if bands else blocks - together

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            each = len(keys) // max(1, batch.num_rows)
            out = np.zeros(len(keys), ENTRY)
            out["bucket"] = keys
            for k, name in enumerate(("size", "sketch", "item", "place"), 1):
                out[name] = np.repeat(batch.column(k).to_numpy(), each)
            yield packed(out, parts)

    def allowed(_: np.ndarray, x: np.ndarray, x_bits: np.ndarray, __: np.ndarray, y: np.ndarray, y_bits: np.ndarray) -> np.ndarray:
        return (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (np.bitwise_count((x_bits ^ y_bits).view(np.uint64)) <= most_bits)

    parts = parts_for(seen.count() * (math.comb(blocks, together) + bands))
    dealt = seen.filter("keys IS NOT NULL").select("keys", "size", "simhash", "item", "words").mapInArrow(lean(deal), PACKED)
    entries = written(shared_buckets(dealt, allowed, 8))
    first = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column), "n")).alias("first")
    at = F.min(F.struct("key", "n")).alias("at")
    items = written(seen.groupBy("item").agg(first, at, F.count(F.lit(1)).alias("times"), (F.min("other") == F.max("other")).alias("one")))
    asked = written(items.join(entries.select("item").distinct(), "item", "left_semi").select("item", "at.key", "at.n"))
    forms = _forms(docs, asked, text_column, figures)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= 16_000 or size > 24_000_000:
                yield linked(pa.Table.from_batches(held))
                held, rows, size = [], 0, 0
        if held:
            yield linked(pa.Table.from_batches(held))

    def linked(pairs: pa.Table) -> pa.RecordBatch:
        distance, longer, unit = distances(pairs["x"].to_pylist(), pairs["y"].to_pylist(), percent)
        keep = 100 * distance <= (100 - percent) * longer
        return pa.record_batch([pairs["a"].combine_chunks(), pairs["b"].combine_chunks(), *map(pa.array, (keep, distance, unit))], ["a", "b", "linked", "distance", "unit"])

    def verify(candidates: DataFrame) -> DataFrame:
        pairs = candidates.join(forms.select(F.col("item").alias("a"), F.col("form").alias("x")), "a").join(forms.select(F.col("item").alias("b"), F.col("form").alias("y")), "b")
        return pairs.select("a", "b", "x", "y").mapInArrow(lean(near), "a long, b long, linked boolean, distance long, unit long")

    def settle(left: DataFrame) -> DataFrame:
        buckets = left.groupBy("item").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))  # at most one for each key
        known = left.select("bucket", "item", "size", "sketch", "near", "distance", "unit").join(buckets, "item")
        cells = dealt_to_cells(left.select("bucket", "item", "root", F.col("size").alias("n")), BLOCK, CHARACTERS)
        undecided = written(by_cells(cells.join(known, ["bucket", "item"]), lambda cells: _Cells(cells, percent, most_bits).undecided(), _KNOWN_SQL, 8 * TOGETHER, TOGETHER_BYTES))
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), undecided.count() // (8 * BLOCK))
        links = written(by_cells(undecided.join(forms, "item").select(*_KNOWN, "form"), lambda cells: _Cells(cells, percent, most_bits).links(), "a long, b long", TOGETHER, TOGETHER_BYTES, tasks).distinct())
        discard(undecided)
        return links

    groups = linked_groups(entries, verify, settle=settle)
    out = items.join(groups, "item", "left").filter("one AND (root IS NOT NULL OR times > 1)").withColumn("root", F.coalesce("root", "item"))
    out = written(out.select("item", "root", F.col(f"first.{id_column}").alias(id_column), F.col("first.n").alias("n")))
    discard(entries, items, asked, forms, groups, *[seen] * (lines is None))
    return out


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", blocks: int = 3, together: int = 2, percent: int = 80, bands: int = 10, figures: bool = False) -> DataFrame:
    """docs with its text less the repeated lines, n_lines (lines before) and n_removed.

    One line of each group stays: the first by id and line number (null ids last). Lines keep their order and bytes.
    """
    plain = docs.drop("n_lines", "n_removed")
    lines = described_lines(plain, id_column, text_column, blocks, together, bands, figures)
    groups = line_groups(plain, id_column, text_column, blocks, together, percent, lines=lines, bands=bands, figures=figures)
    kept = groups.groupBy("root").agg(F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column), "n")).alias("kept"))
    repeated = groups.select("item", "root").join(kept, "root").select("item", F.col(f"kept.{id_column}").alias("kept_id"), F.col("kept.n").alias("kept_n"))
    gone = lines.select(F.col(id_column).alias("id"), "key", "n", "item").join(repeated, "item").filter(~(F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("n") == F.col("kept_n"))))
    # of rows with equal ids and equal texts each loses the same lines but the first of these rows keeps all: they are one document
    gone = written(gone.groupBy("id", "key").agg(F.collect_set("n").alias("gone")))  # at most a document's lines
    discard(lines, groups)
    key, id_of, key_of, cut = free_names(plain, "key", "id_of", "key_of", "gone")
    right = gone.select(F.col("id").alias(id_of), F.col("key").alias(key_of), F.col("gone").alias(cut))
    met = plain.withColumn(key, text_key(text_column)).join(right, F.col(id_column).eqNullSafe(F.col(id_of)) & (F.col(key) == F.col(key_of)), "left")

    @F.arrow_udf("string")  # workers need no pandas, 22 MB each
    def left(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for text, n in zip(texts.to_pylist(), numbers.to_pylist(), strict=True):
            go = set(n or ())
            out.append(None if text is None else "\n".join([line for i, line in enumerate(text.split("\n")) if i not in go]))
        return pa.array(out, pa.string())

    source = F.col(text_column).cast("string")
    text = F.when(F.col(cut).isNull(), F.col(text_column)).otherwise(left(F.when(F.col(cut).isNotNull(), source), F.col(cut)))
    n_lines = F.coalesce(F.octet_length(source) - F.octet_length(F.replace(source, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    counted = met.withColumns({"n_lines": n_lines.cast("long"), "n_removed": F.when(F.col(cut).isNull(), 0).otherwise(F.size(cut)).cast("long"), text_column: text})
    return counted.select(*plain.columns, "n_lines", "n_removed")
