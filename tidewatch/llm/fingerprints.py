"""Document fingerprints by randomised edit embedding.

A text's code points are walked with shared random bits: at step j the current symbol is put out, and the walk moves
on if bit (j, symbol) is set. Texts of small edit distance fall into step again after each edit, so the embedded
strings' Hamming distance follows the edit distance (Chakraborty, Goldenberg and Koucky). A fingerprint samples the
embedded string at shared random steps: `SAMPLES` for each doubling of the steps, so texts of any length share
positions, each as 4 bits that hash 4 consecutive symbols; "x" stands behind the end. likeness() weighs samples by the
steps they stand for and takes off what agrees by chance. near_classes() bands sampled places of them, and verifies.

Null and empty texts have the empty fingerprint, alike to each other (1) and to nothing else (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import ENTRY, PACKED, packed, parts_for, shared_buckets
from .cells import CELL, by_cell, dealt_to_cells, sides
from .components import linked_groups
from .ordering import in_descending_runs
from .storage import discard, free_names, joined_by_key, lean, written
from .words import mix

SAMPLES, BANDS, BLOCK = 32, 16, 1024  # samples of a scale, bands of a level, members of a block of a cell
_PERIOD, _RUN, _FIRST = 4093, 4, 6  # steps after which bits repeat; symbols in a sample; the first scale has 2 ** 6 steps
_RNG = np.random.default_rng(1847)
_MOVE = _RNG.integers(0, 2, (_PERIOD, 256), dtype=np.int64)
_MOVE[:, 0] = 0  # symbol 0 is the end, where walks stay
_MIXER = _RNG.integers(1, 1 << 30, _RUN, dtype=np.int64) | 1
_HEX = np.frombuffer(b"0123456789abcdefx", np.uint8)
END = 16


def sampled_steps(scale: int) -> np.ndarray:
    low = 0 if scale == 0 else 1 << (_FIRST + scale - 1)
    return np.sort(np.random.default_rng((1848, scale)).choice((1 << (_FIRST + scale)) - low, SAMPLES, replace=False) + low)


def weights(scales: int) -> np.ndarray:
    """Steps that each sample stands for."""
    return np.repeat([1 << (_FIRST + max(0, s - 1)) for s in range(scales)], SAMPLES) / SAMPLES


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' symbols (1 to 255 by code point, 0 after each text), and where each starts and ends."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size + 1) - 1
    flat = (1 + (points.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(255)).astype(np.uint8)
    flat[end] = 0
    return flat, end - size, end


def embed(texts: list[str]) -> np.ndarray:
    """A row of samples (0 to 15, END behind the end) for each text; all walks go on together."""
    flat, start, end = symbols(texts)
    out = np.full((len(texts), 0), END, np.uint8)
    who = np.flatnonzero(end > start)
    at, stop = start[who].copy(), end[who]
    scale, step, todo, due, partial = 0, 0, np.empty(0, np.int64), 0, []
    todo_at: list[int] = []
    while len(who):
        if step == (0 if scale == 0 else 1 << (_FIRST + scale - 1)):
            out = np.concatenate([out, np.full((len(texts), SAMPLES), END, np.uint8)], axis=1)
            todo_at, todo, due = sampled_steps(scale).tolist(), np.arange(SAMPLES) + scale * SAMPLES, 0
            scale += 1
        limit = min(1 << (_FIRST + scale - 1), step + 512)
        while step < limit:
            now = flat.take(at)
            if due < SAMPLES and todo_at[due] == step:
                partial.append([int(todo[due]), 0, now != 0, np.zeros(len(now), np.int64)])
                due += 1
            if partial:
                for p in partial:
                    p[3] += (now.astype(np.int64) + 1) * _MIXER[p[1]]
                    p[1] += 1
                while partial and partial[0][1] == _RUN:
                    column, _, valid, value = partial.pop(0)
                    out[who, column] = np.where(valid, (value * 2654435761 >> 20) & 15, END)
            at += _MOVE[step % _PERIOD].take(now)
            step += 1
        on = at < stop
        if not on.all() and not partial:
            who, at, stop = who[on], at[on], stop[on]
    for column, _, valid, value in partial:
        out[who, column] = np.where(valid, (value * 2654435761 >> 20) & 15, END)
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=END)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows of samples, 0 to 1."""
    width = max(a.shape[1], b.shape[1])
    if not width:
        return np.ones(len(a))
    a, b, w = widened(a, width), widened(b, width), weights(width // SAMPLES)
    valid = (a != END) | (b != END)
    all_, same = valid @ w, ((a == b) & valid) @ w
    raw = np.divide(same, all_, out=np.ones(len(a)), where=all_ > 0)
    return np.clip((raw - 1 / 16) * 16 / 15, 0, 1)


def as_strings(samples: np.ndarray) -> list[str]:
    text = _HEX[samples].tobytes().decode()
    n = samples.shape[1]
    return [text[i * n : (i + 1) * n].rstrip("x") for i in range(len(samples))]


def as_samples(strings: list[str]) -> np.ndarray:
    width = -(-max(map(len, strings), default=0) // SAMPLES) * SAMPLES
    raw = np.frombuffer("".join(s.ljust(width, "x") for s in strings).encode(), np.uint8).reshape(len(strings), width)
    table = np.zeros(256, np.uint8)
    table[_HEX] = np.arange(17)
    return table[raw]


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _packs(rows: Iterator[tuple], most_chars: int = 12_000_000) -> Iterator[list[tuple]]:
    pack, size = [], 0
    for row in rows:
        pack.append(row)
        size += len(row[1])
        if size > most_chars or len(pack) >= 4096:
            yield pack
            pack, size = [], 0
    if pack:
        yield pack


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, fingerprint) of every row of docs; no shuffle. Rows with equal ids stay apart; other columns are never read."""
    source = docs.select(F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t) for b in batches for i, t in zip(b.column(0), b.column(1).to_pylist(), strict=True))
        for pack in _packs(rows):
            texts = [t for _, t in pack]
            yield pa.record_batch({id_column: pa.array([i.as_py() for i, _ in pack]).cast(pack[0][0].type), "fingerprint": pa.array(as_strings(embed(texts)), pa.string())})

    return source.mapInArrow(lean(walk), f"`{id_column}` {source.dtypes[0][1]}, fingerprint string")


def edit_response(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last third (rounded down) replaced by the start of the next row's text in
    descending id order, the first row following the last. A single row follows itself.
    """
    runs = in_descending_runs(docs, id_column, text_column)
    schema = f"`{id_column}` {runs.dtypes[0][1]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def respond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, t, g) for b in batches for i, t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        kept = None
        for pack in _packs(rows):
            pack = ([kept] if kept else []) + pack
            kept = pack[-1]
            use = [k for k in range(len(pack) - 1) if not pack[k][2]]
            changed = [edited(pack[k][1], pack[k + 1][1]) for k in use]
            samples = embed([r[1] for r in pack] + changed)
            own, new = samples[: len(pack)], samples[len(pack) :]
            text, text_new = as_strings(own), as_strings(new)
            at = np.array(use, np.int64)
            yield pa.record_batch(
                {
                    id_column: pa.array([pack[k][0] for k in use], batches_type),
                    "n_chars": pa.array([len(pack[k][1]) for k in use], pa.int64()),
                    "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    "fingerprint": pa.array([text[k] for k in use], pa.string()),
                    "edited_fingerprint": pa.array(text_new, pa.string()),
                    "near_edited": pa.array(likeness(own[at], new) if use else [], pa.float64()),
                    "near_next": pa.array(likeness(own[at], own[at + 1]) if use else [], pa.float64()),
                }
            )

    from pyspark.sql.pandas.types import to_arrow_type

    batches_type = to_arrow_type(runs.schema[0].dataType)
    return runs.mapInArrow(lean(respond), schema)


@cache
def sampled_places(level: int, width: int) -> np.ndarray:
    """BANDS draws of `width` of the first `level` samples, each as likely as the steps it stands for; half of them where there are fewer than twice as many."""
    rng, weight = np.random.default_rng((1849, level)), weights(-(-level // SAMPLES))[:level]
    return np.stack([rng.choice(level, min(width, level // 2), replace=False, p=weight / weight.sum()) for _ in range(BANDS)])


def bands_of(samples: np.ndarray, width: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band of each row of samples; width at most 8.

    A row with `held` samples before the end has the bands of the two largest levels that are not above held, so two
    rows whose lengths allow a likeness of 0.8 have a level in common. Fewer than 4 samples have no band: rows of 5 and
    fewer are alike at 0.8 only if they are equal.
    """
    held = (samples != END).sum(1)
    ladder = np.array([4, 8, 12, 16, 24, *range(32, samples.shape[1] + 1, 16)])
    last = np.searchsorted(ladder, held, "right") - 1
    rows, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for k, level in enumerate(ladder.tolist()):
        at = np.flatnonzero((last == k) | (last == k + 1))
        places = sampled_places(level, width)
        names = (level * BANDS + np.arange(BANDS, dtype=np.uint64)) << np.uint64(32)
        value = (samples[at][:, places].astype(np.uint64) << (4 * np.arange(places.shape[1], dtype=np.uint64))).sum(2)
        rows.append(np.repeat(at, BANDS))
        keys.append(mix(value | names).ravel())
    return np.concatenate(rows), np.concatenate(keys)


def band_keys(fingerprint: str, band: int) -> list[int]:
    """The keys of one fingerprint, of bands of `band` samples."""
    return bands_of(as_samples([fingerprint]), band)[1].tolist()


def _may_be_alike(least: float) -> Callable[..., np.ndarray]:
    """Whether steps before the end (size) and the first 16 samples (sketch) of two items allow a likeness of `least`; exact for items of 16 samples and fewer."""
    raw = least * 15 / 16 + 1 / 16 - 1e-9

    def allowed(_: np.ndarray, x: np.ndarray, x_first: np.ndarray, __: np.ndarray, y: np.ndarray, y_first: np.ndarray) -> np.ndarray:
        low, high = np.minimum(x, y), np.maximum(x, y)
        other = (x_first ^ y_first).view(np.uint64)
        other = (other | other >> np.uint64(1) | other >> np.uint64(2) | other >> np.uint64(3)) & np.uint64(0x1111111111111111)
        common = np.minimum(low // 2, 16).astype(np.uint64)  # a sample of the first scale stands for 2 steps
        other &= np.where(common > 0, np.uint64(2**64 - 1) >> (np.uint64(4) * (np.uint64(16) - np.maximum(common, np.uint64(1)))), np.uint64(0))
        return low - np.where(high <= 32, 2 * np.bitwise_count(other).astype(np.int64), 0) >= raw * high

    return allowed


def _links_of_cell(cell: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """(a, b): enough of the links of a cell to join all classes that are linked there."""
    apart, first, second = sides(cell)
    item, root = cell.column("item").to_numpy(), cell.column("root").to_numpy()
    samples = as_samples(cell.column("fingerprint").to_pylist())
    up, found = {r: r for r in root.tolist()}, []

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    for i in first.tolist():
        j = second[(root[second] != root[i]) & (apart | (item[second] > item[i]))]
        for k in j[likeness(np.broadcast_to(samples[i], (len(j), samples.shape[1])), samples[j]) >= least].tolist():
            a, b = top(int(root[i])), top(int(root[k]))
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((min(item[i], item[k]), max(item[i], item[k])))
    if found:
        a, b = np.array(found).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.8, band: int = 8) -> DataFrame:
    """(id, fingerprint, class_id) of every row: see with_classes."""
    return with_classes(fingerprints(docs, id_column, text_column), id_column, least, band)


def with_classes(marked: DataFrame, id_column: str = "doc_id", least: float = 0.8, band: int = 8) -> DataFrame:
    """marked (id, fingerprint, ...) with class_id: the smallest id that links lead to, null only if all are.

    Rows of equal fingerprints are one item. Items that share a band (bands_of: `band` sampled places) are candidates;
    a link is a likeness of `least` or more. Two texts of likeness 0.8 share a band of 8 samples with a probability over
    0.9, which is the method's recall; it grows with the likeness. Buckets that still hold several groups after a first
    round are settled in cells of two blocks, from which only links leave. Empty texts share the empty fingerprint, a
    class of its own.
    """
    name = free_names(marked, "item")[0]
    # digits of hashes, which zstd halves and snappy leaves as they are; the shuffle of texts behind marked ends here
    rows = written(marked.withColumn(name, F.xxhash64("fingerprint")), "zstd")
    items = written(rows.groupBy(F.col(name).alias("item")).agg(F.first("fingerprint").alias("fingerprint"), F.min(id_column).alias("first_id"), F.count(F.lit(1)).alias("times")), "zstd")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = as_samples(batch.column(1).to_pylist())
            row, key = bands_of(samples, band)
            out = np.zeros(len(row), ENTRY)
            out["bucket"], out["item"] = key, batch.column(0).to_numpy()[row]
            out["size"] = np.minimum((samples != END) @ weights(samples.shape[1] // SAMPLES), np.iinfo(np.int32).max)[row]
            first = widened(samples, max(16, samples.shape[1]))[:, :16].astype(np.uint64) % np.uint64(END)
            out["sketch"] = (first << (4 * np.arange(16, dtype=np.uint64))).sum(1).view(np.int64)[row]
            yield packed(out, parts)

    parts = parts_for(items.count() * 2 * BANDS)
    entries = written(shared_buckets(items.select("item", "fingerprint").mapInArrow(lean(bands), PACKED), _may_be_alike(least)))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x, y = (as_samples(part.column(k).to_pylist()) for k in ("x", "y"))
                keep = pa.array(likeness(x, y) >= least)
                yield pa.record_batch({"a": part.column("a").filter(keep), "b": part.column("b").filter(keep)})

    def verify(pairs: DataFrame) -> DataFrame:
        x = items.select(F.col("item").alias("a"), F.col("fingerprint").alias("x"))
        y = items.select(F.col("item").alias("b"), F.col("fingerprint").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(alike), "a long, b long").selectExpr("a", "b", "true linked", "cast(null AS long) distance", "cast(null AS long) unit")

    def settle(left: DataFrame) -> DataFrame:
        tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), left.count() // (8 * BLOCK))
        cells = dealt_to_cells(left.select("bucket", "item", "root", F.lit(1).alias("n")), BLOCK, BLOCK)
        known = cells.join(items.select("item", "fingerprint"), "item").select(*CELL, "fingerprint")
        return written(by_cell(known, lambda cell: _links_of_cell(cell, least), "a long, b long", tasks).distinct())

    groups = linked_groups(entries, verify, settle=settle)
    rooted = items.join(groups, "item", "left").select("item", "first_id", "times", F.coalesce("root", "item").alias("root"))
    least_id = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = written(rooted.join(least_id, "root").select(F.col("item").alias(name), "class_id", "times"))
    discard(entries, items, groups)
    return joined_by_key(rows, classes, name, "times").drop(name)
