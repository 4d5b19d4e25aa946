"""Substring dedup: every word covered by a window of `window` words that starts anywhere else too goes.

A window's minimiser is the smallest hash among its runs of `seed_words` words; consecutive windows of one minimiser
form a super-k-mer. Minimisers that occur once in the corpus can't hold a repeated window, so only counted hashes of
minimisers are shuffled at first. The super-k-mers of the others travel, each as one packed string, to the bucket of
their minimiser; equal strings are combined on the way, so a passage in a third of all rows is one row with a count.
In a bucket the windows are sorted by 128 bits of hash of their words and their occurrences added up. A minimiser that
occurs over `hot` times may have as many different super-k-mers (a common passage with other words around it each
time), so its bucket is dealt out anew: each super-k-mer is divided by where in the window the minimiser first occurs,
in runs of some sqrt(window) places whose windows share a core of words. Equal parts are combined, those of one batch
before they are rows; parts whose core occurs once go, and only the windows of the others meet, one row each, by their
own hashes. Each different text is
shuffled once, whatever its number of copies.

Words are runs of other than ASCII white space, unchanged. Null texts have none. Repeated rows are copies of a text
and repeat each other. Other columns are never read. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repetition import covered
from .storage import distinct_texts, lean, text_key
from .words import Words, mix, signed, slices, window_hashes

_SEED = 11


def super_kmers(words: Words, h: np.ndarray, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of each super-k-mer of a slice."""
    n = len(words)
    runs = window - seed_words + 1
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    left = words.left()
    least = window_hashes(h, seed_words)
    least[left < seed_words] = np.uint64(0xFFFFFFFFFFFFFFFF)
    span = 1
    while span * 2 <= runs:
        least = np.minimum(least, np.concatenate([least[span:], np.full(span, 0xFFFFFFFFFFFFFFFF, np.uint64)])[:n])
        span *= 2
    if span < runs:
        shift = runs - span
        least = np.minimum(least, np.concatenate([least[shift:], np.full(shift, 0xFFFFFFFFFFFFFFFF, np.uint64)])[:n])
    valid = left >= window
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    start = np.flatnonzero(first)
    at = np.flatnonzero(valid)
    count = np.diff(np.append(np.searchsorted(at, start), len(at)))
    return start, count, least[start]


def _in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for a hash in a row."""
    return h ^ mix(row.astype(np.uint64) + np.uint64(1))


def _packed(words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words of a slice, one space behind each, and where each starts and ends there."""
    size = words.end - words.start
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = words.data[words.inside]
    return out.tobytes(), begin, begin + size


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def repeated_windows(docs: DataFrame, text_column: str = "text", window: int = 35, seed_words: int = 6, hot: int = 1000) -> DataFrame:
    """(key, text, copies, spans): each different text once; spans holds (first word, word after the last) of what repeated windows cover, null if nothing."""

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                h = words.hashes(_SEED)
                start, _, least = super_kmers(words, h, window, seed_words)
                row = words.row[start]
                at = np.unique(_in_row(least, row), return_index=True)[1]
                at = at[np.argsort(row[at], kind="stable")]
                # how often each one's run of words is in its text, 2 standing for more: windows of one super-k-mer can repeat each other
                own = _in_row(least[at], row[at])
                order = np.argsort(own)
                full = np.flatnonzero(words.left() >= seed_words)
                runs = _in_row(window_hashes(h, seed_words)[full], words.row[full])
                near = np.minimum(np.searchsorted(own[order], runs), max(len(own) - 1, 0))
                times = np.zeros(len(own), np.int32)
                if len(own):
                    times[order] = np.minimum(np.bincount(near[own[order][near] == runs], minlength=len(own)), 2)
                counts = np.bincount(row[at], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), _lists(signed(least[at]), counts, pa.int64()), _lists(times, counts, pa.int32())], ["key", "m", "n"])

    keyed = docs.select(text_key(text_column).alias("key"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    seen = keyed.mapInArrow(lean(minimisers), "key binary, m array<long>, n array<int>").select("key", F.inline(F.arrays_zip("m", "n")))
    often = seen.groupBy("m").agg(F.sum("n").alias("n")).filter("n > 1").select("m", (F.col("n") > hot).alias("hot"))
    wanted = seen.select("key", "m").join(often, "m").groupBy("key").agg(F.collect_set(F.struct("m", "hot")).alias("wanted"))  # at most a text's own
    texts = distinct_texts(docs, text_column)  # read twice, shuffled once

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            for i, j, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                start, count, least = super_kmers(words, words.hashes(_SEED), window, seed_words)
                row = words.row[start]
                mine = lists.slice(i, j - i)
                asked = mine.flatten()
                who = np.repeat(np.arange(j - i), pa.compute.list_value_length(mine).to_numpy(zero_copy_only=False))
                marks = _in_row(asked.field("m").to_numpy().view(np.uint64), who)
                order = np.argsort(marks)
                own = _in_row(least, row)
                near = np.minimum(np.searchsorted(marks[order], own), max(len(marks) - 1, 0))
                keep = marks[order][near] == own if len(marks) else np.zeros(len(own), bool)
                often_hot = asked.field("hot").to_numpy(zero_copy_only=False)[order][near[keep]] if len(marks) else np.empty(0, bool)
                start, count, least, row = start[keep], count[keep], least[keep], row[keep]
                raw, begin, end = _packed(words)
                packed = [raw[a:b] for a, b in zip(begin[start].tolist(), end[start + count + window - 2].tolist(), strict=True)]
                at = pa.array(row + i)
                yield pa.record_batch(
                    {
                        "key": batch.column("key").take(at),
                        "copies": batch.column("copies").take(at),
                        "first": pa.array(start - words.first[:-1][row], pa.int64()),
                        "m": pa.array(signed(least)),
                        "hot": pa.array(often_hot.astype(bool)),
                        "packed": pa.array(packed, pa.binary()),
                    }
                )

    pieces = texts.join(wanted, "key").select("key", "copies", "text", "wanted").mapInArrow(lean(cut), "key binary, copies long, first long, m long, hot boolean, packed binary")
    different = pieces.groupBy("m", "hot", "packed").agg(F.sum("copies").alias("copies"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            m = batch.column("m").to_numpy()
            whole = int(np.searchsorted(m, m[-1])) if len(m) else 0  # rows before the last bucket, which may go on
            if whole:
                yield _tally(pa.Table.from_batches([*held, batch.slice(0, whole)]), window)
                held = [batch.slice(whole)]
            elif len(m):
                if held and held[-1].column("m")[-1] != batch.column("m")[0]:
                    yield _tally(pa.Table.from_batches(held), window)
                    held = []
                held.append(batch)
        if held:
            yield _tally(pa.Table.from_batches(held), window)

    step = math.isqrt(window - seed_words) + 1

    def divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _divided(batch, window, seed_words, step)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column("windows")
            size = pa.compute.binary_length(windows).to_numpy() // 16
            pair = np.frombuffer(b"".join(windows.to_pylist()), np.int64).reshape(-1, 2)
            row = pa.array(np.repeat(np.arange(len(size)), size))
            at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
            yield pa.record_batch({"one": pa.array(pair[:, 0]), "two": pa.array(pair[:, 1]), "windows": windows.take(row), "at": pa.array(at), "copies": batch.column("copies").take(row)})

    cold = different.filter("NOT hot").select("m", "packed", "copies").repartition("m").sortWithinPartitions("m").mapInArrow(lean(counted), "piece binary, ranges array<long>")
    parts = different.filter("hot").select("m", "packed", "copies", F.unhex(F.md5("packed")).alias("piece")).mapInArrow(lean(divided), "core long, windows binary, copies long, held array<struct<piece:binary,firsts:array<long>>>")
    kinds = parts.groupBy("core", "windows").agg(F.sum("copies").alias("copies"))
    cores = kinds.groupBy("core").agg(F.sum("copies").alias("n")).filter("n > 1").select("core")
    each = kinds.join(cores, "core", "left_semi").select("windows", "copies").mapInArrow(lean(exploded), "one long, two long, windows binary, at long, copies long")
    twice = each.groupBy("one", "two").agg(F.sum("copies").alias("n")).filter("n > 1").select("one", "two")
    again = each.select("one", "two", "windows", "at").join(twice, ["one", "two"], "left_semi").groupBy("windows").agg(F.collect_set("at").alias("at"))  # at most `step`
    holders = parts.select("windows", "held").join(again, "windows").select("at", F.inline("held"))
    places = holders.select("piece", F.flatten(F.transform("firsts", lambda f: F.transform("at", lambda a: a + f))).alias("at")).groupBy("piece").agg(F.flatten(F.collect_list("at")).alias("at"))  # at most a piece's own
    found = cold.union(places.select("piece", F.flatten(F.transform("at", lambda a: F.array(a, a + window))).alias("ranges")))
    placed = pieces.select("key", "first", F.unhex(F.md5("packed")).alias("piece")).join(found, "piece")
    spans = placed.select("key", F.transform("ranges", lambda r: r + F.col("first")).alias("spans")).groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # at most a text's own
    return texts.join(spans, "key", "left").select("key", "text", "copies", "spans")


def _windows(table: pa.Table, window: int) -> tuple[np.ndarray, ...]:
    """(bucket, two hashes, row, place) of every window of the packed strings."""
    packed = table.column("packed").combine_chunks().cast(pa.string(), safe=False)
    packed = packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed
    m = table.column("m").to_numpy()
    keys: list = [[], [], [], [], []]
    for i, _, data, offsets in slices(packed, most_rows=1 << 30):
        words = Words(data, offsets)
        at = np.flatnonzero(words.left() >= window)
        row = words.row[at]
        for k, v in enumerate((m[i + row], window_hashes(words.hashes(_SEED), window)[at], window_hashes(words.hashes(_SEED + 1), window)[at], i + row, at - words.first[:-1][row])):
            keys[k].append(v)
    kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64)
    return tuple(np.concatenate(k) if k else np.empty(0, kind) for k, kind in zip(keys, kinds, strict=True))


def _kinds(batch: pa.RecordBatch, window: int, seed_words: int, step: int) -> Iterator[tuple[pa.Array, ...]]:
    """(row, core, first window, windows) of the parts of each packed string: consecutive windows that have their minimiser's first occurrence in the same `step` places. windows: 16 bytes of hash for each; core: a hash of the words that all windows with the minimiser there share."""
    m = batch.column("m").to_numpy().view(np.uint64)
    for i, _, data, offsets in slices(batch.column("packed").cast(pa.string(), safe=False), most_rows=1 << 30):
        words = Words(data, offsets)
        h, left = words.hashes(_SEED), words.left()
        seeds = np.flatnonzero((left >= seed_words) & (window_hashes(h, seed_words) == m[i + words.row]))
        at = np.flatnonzero(left >= window)
        seed = seeds[np.searchsorted(seeds, at)]
        core = seed - (seed - at) // step * step
        first = np.flatnonzero(np.append(True, (core[1:] != core[:-1]) | (seed[1:] != seed[:-1])))
        pair = np.stack([window_hashes(h, window)[at], window_hashes(words.hashes(_SEED + 1), window)[at]], axis=1)
        ends = (16 * np.append(first, len(at))).astype(np.int32)
        windows = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(pair.tobytes())])
        row = words.row[at[first]]
        yield pa.array(i + row), pa.array(signed(window_hashes(h, window - step + 1)[core[first]])), pa.array(at[first] - words.first[:-1][row]), windows


def _divided(batch: pa.RecordBatch, window: int, seed_words: int, step: int) -> Iterator[pa.RecordBatch]:
    """(core, windows, copies, held) of the different parts of a batch's packed strings. held: the pieces with that part and its first windows in each, so a part that all pieces of a batch hold, or one many times, is one row."""
    found = list(_kinds(batch, window, seed_words, step))
    if not sum(len(x[0]) for x in found):
        return
    piece, core, first, windows = (pa.concat_arrays(x) for x in zip(*found, strict=True))
    coded = windows.dictionary_encode()
    part, piece, core, first = (x.to_numpy() for x in (coded.indices, piece, core, first))
    order = np.lexsort((first, piece, part))
    part, piece, core, first = part[order], piece[order], core[order], first[order]
    parts = np.append(True, part[1:] != part[:-1])
    pieces = np.append(True, parts[1:] | (piece[1:] != piece[:-1]))
    at, own = np.flatnonzero(parts), np.flatnonzero(pieces)
    holders = pa.StructArray.from_arrays([batch.column("piece").take(pa.array(piece[own])), _lists(first, np.diff(np.append(own, len(first))), pa.int64())], ["piece", "firsts"])
    ends = np.append(np.searchsorted(own, at), len(own)).astype(np.int32)
    copies = np.add.reduceat(batch.column("copies").to_numpy()[piece], at)
    yield pa.record_batch({"core": pa.array(core[at]), "windows": coded.dictionary, "copies": pa.array(copies), "held": pa.ListArray.from_arrays(pa.array(ends), holders)})


def _tally(table: pa.Table, window: int) -> pa.RecordBatch:
    """Of whole buckets of different pieces: the pieces with repeated windows, and what these cover in them."""
    table = table.combine_chunks()
    packed, copies = table.column("packed"), table.column("copies").to_numpy()
    bucket, one, two, row, at = _windows(table, window)
    order = np.lexsort((two, one, bucket))
    new = np.ones(len(order), bool)
    for x in (bucket, one, two):
        y = x[order]
        new[1:] &= y[1:] == y[:-1]
    new[1:] = ~new[1:]
    new[:1] = True
    group = np.cumsum(new) - 1
    often = np.zeros(len(order), bool)
    often[order] = np.bincount(group, weights=copies[row[order]])[group] >= 2
    row, at = row[often], at[often]  # still in the order of rows and places
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    last = np.append(first[1:], True) if len(row) else first
    which, counts = np.unique(row[first], return_counts=True)
    ranges = np.stack([at[first], at[last] + window], axis=1).ravel()
    names = [hashlib.md5(packed[int(w)].as_py()).digest() for w in which]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), _lists(ranges, 2 * counts, pa.int64())], ["piece", "ranges"])


def without_repeats(docs: DataFrame, text_column: str = "text", window: int = 35, seed_words: int = 6, hot: int = 1000) -> DataFrame:
    """(key, copies, n_words, n_removed, kept): each different text once; kept: the words that stay, joined by one space."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for i, j, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                mine = spans.slice(i, j - i)
                size = pa.compute.fill_null(pa.compute.list_value_length(mine), 0).to_numpy(zero_copy_only=False)
                flat = mine.flatten().to_numpy() + np.repeat(words.first[:-1], size)
                gone = covered(len(words), flat[0::2], flat[1::2])
                raw, begin, end = _packed(words)
                kept = []
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    if a == b:
                        kept.append("")
                    elif not gone[a:b].any():
                        kept.append(raw[begin[a] : end[b - 1]].decode())
                    else:
                        edge = np.diff(np.concatenate([[True], gone[a:b], [True]]).astype(np.int8))
                        kept.append(b" ".join(raw[begin[a + x] : end[a + y - 1]] for x, y in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True)).decode())
                total = np.concatenate([[0], np.cumsum(gone)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(i, j - i), batch.column("copies").slice(i, j - i), pa.array(words.counts.astype(np.int64)), pa.array((total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)), pa.array(kept, pa.string())],
                    ["key", "copies", "n_words", "n_removed", "kept"],
                )

    return repeated_windows(docs, text_column, window, seed_words, hot).select("key", "copies", "text", "spans").mapInArrow(lean(remove), "key binary, copies long, n_words long, n_removed long, kept string")


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35, seed_words: int = 6, hot: int = 1000) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept."""
    removed = without_repeats(docs, text_column, window, seed_words, hot).drop("copies")
    return docs.select(F.col(id_column), text_key(text_column).alias("_key")).join(removed, F.col("_key") == F.col("key")).select(id_column, "n_words", "n_removed", "kept")
