"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise part costs as
much as the linear one (sum-of-squares identity). x holds the text's words hashed into `buckets` (L2-normalised),
structure statistics (standardised, with step features) and the row's n_chars where docs has that column. The machine
is fitted by Adam on the driver on at most 2 * rows_per_class labelled rows; whole texts are read and every row is
scored where it lies, without a shuffle.

Null and empty texts get the score of a text without words. Missing or empty labels leave the score at 0.5 for all.
Rows with equal ids are scored on their own; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import class_sizes, labelled_sample, remainder
from .storage import free_names, lean
from .words import Words, slices

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "bar": b"|", "mark": b"#*$%&<>", "stop": b".,;:", "loud": b"!?", "break": b"\n", "other": range(128, 256)}
_MASKS = {name: np.isin(np.arange(256), list(codes)) for name, codes in _CLASSES.items()}
STATISTICS = ["log_words", "log_bytes", "word_length", "longest_word", "distinct_share", "repeat_next", "pair_distinct", "line_words", *_MASKS]
_STEPS = (-2.0, -1.0, 1.0, 2.0, 4.0)


def _sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(np.float64)


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Different values of h in each row."""
    if not len(h):
        return np.zeros(rows)
    order = np.lexsort((h, row))
    r, v = row[order], h[order]
    new = np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
    return np.bincount(r[new], minlength=rows).astype(np.float64)


def raw_features(data: np.ndarray, offsets: np.ndarray, meta: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, word buckets) for the rows of a slice."""
    words, rows = Words(data, offsets, lower=True), len(offsets) - 1
    h, row = words.hashes(), words.row
    n = np.maximum(words.counts, 1).astype(np.float64)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pair = h * np.uint64(3) + np.concatenate([h[1:], h[:1]])
    length = words.end - words.start
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    lines = np.maximum(_sum(_MASKS["break"][data], offsets) + 1, 1)
    columns = [np.log1p(words.counts), np.log1p(np.diff(offsets)), _sum(length, words.first) / n, np.log1p(longest), _distinct(row, h, rows) / n, _sum(same, words.first) / n, _distinct(row, pair, rows) / n, np.log1p(n / lines)]
    columns += [_sum(mask[data], offsets) / size for mask in _MASKS.values()]
    counts = np.bincount(row * buckets + (h >> np.uint64(40)).astype(np.int64) % buckets, minlength=rows * buckets).reshape(rows, buckets).astype(np.float32)
    counts /= np.maximum(np.sqrt((counts**2).sum(1, keepdims=True)), 1)
    return np.column_stack([*columns, np.log1p(np.maximum(np.nan_to_num(meta), 0))]).astype(np.float32), counts


@dataclass
class FactorisationMachine:
    """Weights and what the statistics were standardised by."""

    mean: np.ndarray
    spread: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    buckets: int

    def inputs(self, statistics: np.ndarray, words: np.ndarray) -> np.ndarray:
        z = np.clip((statistics - self.mean) / self.spread, -6, 6)
        return np.concatenate([z / 2, *[(z > s) if s > 0 else (z < s) for s in _STEPS], words], axis=1, dtype=np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.linear + 0.5 * (((x @ self.factors) ** 2).sum(1) - (x**2) @ (self.factors**2).sum(1))

    def score(self, statistics: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.inputs(statistics, words)).astype(np.float64), -30, 30)))


def fit(statistics: np.ndarray, words: np.ndarray, y: np.ndarray, weight: np.ndarray, rank: int = 8, epochs: int = 30, rate: float = 0.02, decay: float = 2e-4, seed: int = 7) -> FactorisationMachine:
    """By Adam on the weighted log loss; without rows of both classes the machine scores 0.5."""
    d = statistics.shape[1] * (1 + len(_STEPS)) + words.shape[1]
    mean, spread = (statistics.mean(0), statistics.std(0) + 1e-6) if len(y) else (np.zeros(statistics.shape[1]), np.ones(statistics.shape[1]))
    fm = FactorisationMachine(mean, spread, 0.0, np.zeros(d, np.float32), np.zeros((d, rank), np.float32), words.shape[1])
    if len(np.unique(y)) < 2:
        return fm
    rng = np.random.default_rng(seed)
    x = fm.inputs(statistics, words)
    theta = [np.array([np.log((weight @ y) / (weight @ (1 - y)))], np.float32), fm.linear, rng.normal(0, 0.02, fm.factors.shape).astype(np.float32)]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            rows = order[at : at + 256]
            xb, step = x[rows], step + 1
            q = xb @ theta[2]
            logit = theta[0][0] + xb @ theta[1] + 0.5 * ((q**2).sum(1) - (xb**2) @ (theta[2] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) * weight[rows] / weight[rows].mean() / len(rows)
            gradient = [np.array([g.sum()]), xb.T @ g + decay * theta[1], xb.T @ (g[:, None] * q) - theta[2] * ((xb**2).T @ g)[:, None] + 5 * decay * theta[2]]
            for i, value in enumerate(gradient):
                first[i] = 0.9 * first[i] + 0.1 * value
                second[i] = 0.99 * second[i] + 0.01 * value**2
                theta[i] = (theta[i] - rate * 0.93**epoch * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    fm.bias, fm.linear, fm.factors = float(theta[0][0]), theta[1], theta[2]
    return fm


def _with_meta(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    meta = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text"), meta.alias("meta"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", divisor: int = 4, held: int = 2, threshold: float = 0.7, rows_per_class: int = 3000, buckets: int = 1024, rank: int = 8, keep: bool = False) -> DataFrame:
    """Per row of docs: id (with keep: all columns but those of these names), held_out (crc32 of the id modulo divisor is held), score (1: good), predicted (score >= threshold). Held-out labels are never read."""
    train = remainder("_id", divisor) != held
    source = _with_meta(docs, id_column, text_column)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                s, w = raw_features(data, offsets, batch.column("meta").slice(i, j - i).to_numpy(zero_copy_only=False), buckets)
                yield pa.record_batch({"x": pa.array([r.tobytes() for r in np.concatenate([s, w], axis=1)], pa.binary()), "label": batch.column("label").slice(i, j - i)})

    sample = labelled_sample(source, labels, label, train, rows_per_class, id_column, extra=("meta",)).select("text", "meta", "label")
    got = sample.mapInArrow(lean(vectors), "x binary, label int").toPandas()
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]]) if len(got) else np.zeros((0, len(STATISTICS) + 1 + buckets), np.float32)
    by_bytes = np.argsort([v for v in got["x"]], kind="stable") if len(got) else np.empty(0, int)  # tasks end in any order; the fit must not see that
    x, y = x[by_bytes], got["label"].to_numpy(dtype=np.float32)[by_bytes]
    sizes = class_sizes(labels, label, train, id_column)
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum())).astype(np.float32) if len(y) else y
    k = len(STATISTICS) + 1
    machine = fit(x[:, :k], x[:, k:], y, weight, rank)

    if keep:
        plain = docs.drop("held_out", "score", "predicted")
        at_text, at_meta = free_names(plain, "_text", "_meta")
        rows = plain.withColumns({at_text: F.col(text_column).cast("string"), at_meta: F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")})
    else:
        at_text, at_meta = free_names(source.select(id_column), "_text", "_meta")
        rows = source.toDF(id_column, at_text, at_meta)
    names = [c for c in rows.columns if c not in (at_text, at_meta)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(at_text)):
                p = machine.score(*raw_features(data, offsets, batch.column(at_meta).slice(i, j - i).to_numpy(zero_copy_only=False), buckets))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), pa.array(p)], [*names, "score"])

    out = rows.mapInArrow(lean(scored), type(rows.schema)([f for f in rows.schema if f.name in names]).add("score", "double"))
    return out.select(*names[: None if keep else 1], (remainder(id_column, divisor) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
