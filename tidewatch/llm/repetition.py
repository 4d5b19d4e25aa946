"""Quality rules: repetition inside a text by its suffix array, with the base rules on words, symbols and lines.

The suffix array is over words. Each run of rows of an Arrow batch is one array in which equal words of different
texts are different symbols, so no repeat crosses texts and a batch costs a few numpy sorts. Adjacent suffixes'
longest common prefixes give each suffix's longest repeat; the spans of all repeats of min_repeat_words or more are
united, and a text is kept if the spans cover at most max_covered of its words' code points and the longest repeat is
at most max_longest words and at most max_longest_share of the words.

Null texts have no words and fail the base rules, as all texts under min_words do. Rows with equal ids are judged on
their own. Other columns are ignored. Work is on rows alone: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean
from .words import Words, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE_BYTE = np.ones(256, bool)
_LINE_BYTE[10] = False


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position of symbols, the length of the longest string that starts there and starts elsewhere too."""
    n = len(symbols)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(symbols, kind="stable")
    change = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    levels, step = [rank], 1
    alone = change & np.concatenate([change[1:], [True]])
    active = order[~alone]  # suffixes that share their first `step` symbols with others, in the order so far
    while len(active):
        after = active + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        head = rank[active]
        by = np.lexsort((second, head))
        active, head, second = active[by], head[by], second[by]
        group = np.concatenate([[True], head[1:] != head[:-1]])
        change = group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(active))
        within = np.maximum.accumulate(np.where(change, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[active] = head + within
        levels.append(rank)
        active = active[~(change & np.concatenate([change[1:], [True]]))]
        step *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    a, b, common = suffix[:-1].copy(), suffix[1:].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        fit = np.maximum(a, b) < n
        same = np.zeros(n - 1, bool)
        same[fit] = levels[level][a[fit]] == levels[level][b[fit]]
        for x in (a, b, common):
            x[same] += 1 << level
    out = np.zeros(n, np.int64)
    out[suffix[:-1]] = common
    out[suffix[1:]] = np.maximum(out[suffix[1:]], common)
    return out


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the spans at least."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, start, 1)
    np.add.at(delta, end, -1)
    return np.cumsum(delta[:-1]) > 0


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _measured(texts: pa.Array, min_repeat_words: int) -> Iterator[pa.RecordBatch]:
    for _, _, data, offsets in slices(texts):
        words = Words(data, offsets)
        n, rows = len(words), len(offsets) - 1
        symbols = words.hashes() ^ (words.row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        repeat = longest_repeats(symbols)
        at = np.arange(n)
        in8, inside = np.flatnonzero(repeat >= 8), np.flatnonzero(repeat >= min_repeat_words)
        eight, span = covered(n, in8, in8 + repeat[in8]), covered(n, inside, inside + repeat[inside])
        # word lengths in code points
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = lead[words.end] - lead[words.start]
        lines = Words(data, offsets, word_byte=_LINE_BYTE)
        used = np.concatenate([[0], np.cumsum(words.inside)])
        full = used[lines.end] > used[lines.start]
        pairs = np.stack([lines.row[full].astype(np.uint64), lines.hashes()[full]])
        first = np.unique(pairs, axis=1)[0].astype(np.int64) if full.any() else np.empty(0, np.int64)
        longest = np.zeros(rows, np.int64)
        if n:
            np.maximum.at(longest, words.row, repeat)
        edge = span & ~np.concatenate([[False], span[:-1]]) | (span & np.isin(at, words.first[:-1]))
        ends = span & (~np.concatenate([span[1:], [False]]) | np.isin(at + 1, words.first[1:]))
        base = np.repeat(words.first[:-1], words.counts)
        spans = np.stack([(at - base)[edge], (at - base)[ends] + 1], axis=1).ravel() if n else np.empty(0, np.int64)
        yield pa.record_batch(
            {
                "n_words": pa.array(words.counts.astype(np.int64)),
                "word_chars": pa.array(_sums(chars, words.first)),
                "n_symbols": pa.array(_sums(_SYMBOL[data], offsets)),
                "n_dup_lines": pa.array(np.bincount(lines.row[full], minlength=rows) - np.bincount(first, minlength=rows)),
                "n_repeat_words": pa.array(_sums(eight, words.first)),
                "covered_words": pa.array(_sums(span, words.first)),
                "covered_chars": pa.array(_sums(chars * span, words.first)),
                "longest_repeat": pa.array(longest),
                "repeat_spans": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(2 * _sums(edge, words.first))]).astype(np.int32), pa.array(spans)),
            }
        )


_MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, covered_chars long, longest_repeat long, repeat_spans array<long>"


def repetition(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_repeat_words: int = 4) -> DataFrame:
    """Per row of docs: its id and the measures; repeat_spans holds the first word and the word after the last of each united span in turn."""
    kept = docs.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in _measured(batch.column(1), min_repeat_words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, part.num_rows), *part.columns], [id_column, *part.schema.names])
                done += part.num_rows

    return kept.mapInArrow(lean(measure), f"`{id_column}` {kept.dtypes[0][1]}, {_MEASURES}")


def quality_rules(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_repeat_words: int = 4,
    max_covered: float = 0.4,
    max_longest: int = 60,
    max_longest_share: float = 0.3,
) -> DataFrame:
    """repetition() with base_failed, covered_fraction and the verdict kept. Short texts may repeat a little by chance: the share limit counts from 10 words of repeat on."""
    measured = repetition(docs, id_column, text_column, min_repeat_words)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    fraction = F.coalesce(F.try_divide(F.col("covered_chars").cast("double"), F.col("word_chars")), F.lit(0.0))
    fine = (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_longest) & ((F.col("longest_repeat") < 10) | (F.col("longest_repeat") <= max_longest_share * F.col("n_words")))
    return measured.withColumn("base_failed", failed).withColumn("covered_fraction", fraction).withColumn("kept", ~F.col("base_failed") & fine)
