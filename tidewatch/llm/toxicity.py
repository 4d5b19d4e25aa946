"""Toxicity: maximum-scoring segments of token log-odds.

Tokens are runs of letters (ASCII letters in lower case, and all bytes of other scripts). Their log-odds between toxic
and other labelled texts come with an informative Dirichlet prior: each token's prior is its share of both classes
together, at `prior` times the classes' size. Tokens whose log-odds are `z` standard deviations from 0 keep them, all others score a small
negative drift. One linear scan (Ruzzo and Tompa) then finds every maximal scoring segment of a text. lambda and K of
the extreme-value law of segment scores are fitted on the non-toxic training texts; a segment is significant if its
expected number by chance in a text of that length, E = K n exp(-lambda S), is at most `expected`. The text's score is
a logistic curve over -ln E of its best segment and the sum over significant ones, calibrated on the training texts.

The fit reads at most 2 * rows_per_class labelled rows and keeps at most `lexicon` tokens; scoring is on rows alone.
Null and empty texts have no token, no segment and the score of such a text. Without labels of both classes all
scores are 0. Rows with equal ids are scored on their own; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import class_sizes, labelled_sample, remainder
from .storage import lean
from .words import Words, signed, slices

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def maximal_segments(start: list[int], end: list[int], gain: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence, as (start, end, score).

    The sequence is given by its positive runs: run k covers start[k]..end[k] and adds gain[2k + 1]; what lies before
    it adds gain[2k], which is not positive. Each run is looked at once and merged at most once.
    """
    kept: list[list] = []  # start, end, sum before it, sum with it
    total = 0.0
    for k in range(len(start)):
        before = total + gain[2 * k]
        total = before + gain[2 * k + 1]
        new = [start[k], end[k], before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append([*new, j])
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:]
    return [(x[0], x[1], x[3] - x[2]) for x in kept]


@dataclass
class ToxicModel:
    tokens: np.ndarray  # hashes, sorted
    odds: np.ndarray
    drift: float
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    expected: float = 0.05

    def token_scores(self, h: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(h), -self.drift)
        at = np.minimum(np.searchsorted(self.tokens, h), len(self.tokens) - 1)
        return np.where(self.tokens[at] == h, self.odds[at], -self.drift)

    def segments(self, scores: np.ndarray, first: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """Of each row, whose tokens' scores lie between its bounds in first."""
        total = np.concatenate([[0.0], np.cumsum(scores)])
        up = scores > 0
        begin = up.copy()
        begin[1:] &= ~up[:-1]
        begin[first[:-1][first[:-1] < len(scores)]] |= up[first[:-1][first[:-1] < len(scores)]]
        begin = np.flatnonzero(begin)
        stop = up.copy()
        stop[:-1] &= ~up[1:]
        last = first[1:][first[1:] > 0] - 1
        stop[last] |= up[last]
        stop = np.flatnonzero(stop) + 1
        bound = np.searchsorted(begin, first)
        out = []
        for r in range(len(first) - 1):
            i, j = bound[r], bound[r + 1]
            if i == j:
                out.append([])
                continue
            b, e = begin[i:j], stop[i:j]
            cut = np.empty(2 * (j - i) + 1)
            cut[0], cut[1::2], cut[2::2] = total[first[r]], total[b], total[e]
            out.append(maximal_segments((b - first[r]).tolist(), (e - first[r]).tolist(), np.diff(cut).tolist()))
        return out

    def strength(self, n: int, score: float) -> float:
        """-ln E."""
        return self.rate * score - self.log_k - math.log(max(n, 1))

    def summary(self, n: int, segments: list) -> tuple[float, float, list]:
        """(strength of the best segment, summed strength of the significant ones, these with their E)."""
        found = [(s, e, score, self.strength(n, score)) for s, e, score in segments]
        least = -math.log(self.expected)
        strong = [x for x in found if x[3] >= least]
        return max((x[3] for x in found), default=-math.log(max(n, 1)) - self.log_k), sum(x[3] for x in strong), strong

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * np.clip(best, -10, 40) + self.curve[2] * np.log1p(np.maximum(total, 0))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = Words(data, offsets, lower=True, word_byte=_LETTER)
    return words, signed(words.hashes())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each class a token is."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for i, _, data, offsets in slices(batch.column("text")):
            words, h = _hashed(data, offsets)
            if not len(h):
                continue
            pairs = np.unique(np.stack([h, words.row]), axis=1)
            value, at = np.unique(pairs[0], return_inverse=True)
            bad = label[i + pairs[1]] == 1
            yield pa.record_batch({"h": pa.array(value), "bad": pa.array(np.bincount(at, weights=bad, minlength=len(value)).astype(np.int64)), "good": pa.array(np.bincount(at, weights=~bad, minlength=len(value)).astype(np.int64))})


def fit_toxicity(sample: DataFrame, sizes: tuple[int, int], prior: float = 0.03, z: float = 3.0, lexicon: int = 20_000, expected: float = 0.05) -> ToxicModel:
    """sample: (text, label); sizes: labelled training rows of class 0 and 1."""
    counts = sample.select("text", "label").mapInArrow(lean(_counts), "h long, bad long, good long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    all_bad, all_good = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not all_bad or not all_good:
        return ToxicModel(np.empty(0, np.int64), np.empty(0), 0.05)
    a, all_a = F.lit(prior) * (F.col("bad") + F.col("good")), prior * (all_bad + all_good)
    odds = F.log((F.col("bad") + a) / (F.lit(all_bad + all_a) - F.col("bad") - a)) - F.log((F.col("good") + a) / (F.lit(all_good + all_a) - F.col("good") - a))
    sure = counts.withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("bad") + a) + 1 / (F.col("good") + a)))
    kept = sure.filter(F.abs("z") >= z).orderBy(F.desc(F.abs("z")), "h").limit(lexicon).select("h", "odds", "good").toPandas().sort_values("h")
    tokens, weight = kept["h"].to_numpy(np.int64), kept["odds"].to_numpy(float)
    # what a non-toxic text's tokens add on average must be negative, or segments would never end
    by_chance = float((kept["good"].to_numpy(float) * np.maximum(weight, 0)).sum()) / max(all_good, 1)
    model = ToxicModel(tokens, weight, max(0.05, 2 * by_chance), expected=expected)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                words, h = _hashed(data, offsets)
                scores = model.token_scores(h)
                found = model.segments(scores, words.first)
                total = np.concatenate([[0.0], np.cumsum(np.maximum(scores, 0) > 0)])
                yield pa.record_batch(
                    {
                        "n": pa.array(words.counts.astype(np.int64)),
                        "hits": pa.array((total[words.first[1:]] - total[words.first[:-1]]).astype(np.int64)),
                        "segments": pa.array([[x[2] for x in f] for f in found], pa.list_(pa.float64())),
                        "label": batch.column("label").slice(i, j - i),
                    }
                )

    seen = sample.select("text", "label").mapInArrow(lean(scanned), "n long, hits long, segments array<double>, label int").toPandas()
    good = seen[(seen["label"] == 0) & (seen["n"] > 0)]
    share = max(1e-6, float(good["hits"].sum()) / max(1, float(good["n"].sum())))
    gain = weight[weight > 0]
    # lambda: the mean of exp(lambda * score) over a non-toxic text's tokens is 1
    low, high = 1e-6, 50.0
    part = kept["good"].to_numpy(float)[weight > 0]
    part = part / part.sum() if part.sum() else np.full(len(gain), 1 / max(1, len(gain)))
    for _ in range(80):
        mid = (low + high) / 2
        mean = (1 - share) * math.exp(-mid * model.drift) + share * float((part * np.exp(np.minimum(mid * gain, 500))).sum())
        low, high = (mid, high) if mean < 1 else (low, mid)
    model.rate = low if len(gain) else 1.0
    best = np.array([max(s, default=0.0) for s in good["segments"]])
    model.log_k = float((model.rate * best - np.log(good["n"].to_numpy())).mean() - 0.5772156649) if len(good) else 0.0
    both = np.array([model.summary(int(n), [(0, 0, x) for x in s])[:2] for n, s in zip(seen["n"], seen["segments"], strict=True)]).reshape(-1, 2)
    x = np.column_stack([np.ones(len(both)), np.clip(both[:, 0], -10, 40), np.log1p(both[:, 1])])
    y = seen["label"].to_numpy(float)
    w = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    w /= w.mean()
    beta = np.zeros(3)
    for _ in range(50):  # Newton's steps, with a little ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), x.T @ (w * (y - p)) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
    model.curve = tuple(float(b) for b in beta)
    return model


def toxic_passages(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "toxic", divisor: int = 5, held: int = 0, threshold: float = 0.5, rows_per_class: int = 5000, **fit: float) -> DataFrame:
    """Per row of docs: id, held_out, score, predicted, and passages: the significant segments as (start_token, end_token, score, expected by chance)."""
    train = remainder("_id", divisor) != held
    sample = labelled_sample(docs, labels, label, train, rows_per_class, id_column, text_column)
    model = fit_toxicity(sample, class_sizes(labels, label, train, id_column), **fit)
    source = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"start_token": pa.int64(), "end_token": pa.int64(), "score": pa.float64(), "expected": pa.float64()}))
        for batch in batches:
            for i, j, data, offsets in slices(batch.column("text")):
                words, h = _hashed(data, offsets)
                rows = [model.summary(int(n), s) for n, s in zip(words.counts, model.segments(model.token_scores(h), words.first), strict=True)]
                p = model.score(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
                spans = [[{"start_token": s, "end_token": e, "score": v, "expected": math.exp(-q)} for s, e, v, q in r[2]] for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(p), pa.array(spans, kind)], [id_column, "score", "passages"])

    out = source.mapInArrow(lean(scored), f"`{id_column}` {source.dtypes[0][1]}, score double, passages array<struct<start_token:long,end_token:long,score:double,expected:double>>")
    return out.select(id_column, (remainder(id_column, divisor) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
