"""MinHash near-dedup against brute force."""

import random

import numpy as np
import pytest

pytest.importorskip("tidewatch.llm")
from tidewatch.llm import minhash  # noqa: E402

SPACE = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))


def plain(rows, words=2, percent=80):
    sets = []
    for _, x in rows:
        w = [v for v in "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "").translate(SPACE).split(" ") if v]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(top(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def texts():
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    out = []
    for _ in range(25):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(1, 60))]
        for _ in range(draw.randrange(1, 6)):
            copy = list(base)
            for _ in range(draw.randrange(0, 1 + len(base) // 8)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            out.append(" ".join(copy))
    hot = [draw.choice(vocabulary) for _ in range(50)]
    for i in range(60):  # a chain of near copies that drift apart, so classes meet in the same buckets
        out.append(" ".join(hot[:50]))
        for _ in range(1 + i % 3):
            hot[draw.randrange(50)] = draw.choice(vocabulary)
    return [*out, "One  TWO three", "one two\nthree", "alone", "Alone ", "", " \t", None, None, "É a é", "x" * 3000, out[0], out[0]]


@pytest.mark.parametrize(("words", "percent", "block"), [(2, 80, 2048), (2, 80, 3), (3, 60, 5)])
def test_near_duplicates(spark, words, percent, block):
    rows = list(enumerate(texts())) + [(5, "of a repeated id"), (None, "alone"), (None, "an id of none"), (2, texts()[1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = frame.selectExpr("*", "1 AS key", "2 AS n", "3 AS id", "4 AS component_id")
    got = minhash.near_duplicates(clashing, words, percent, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, words, percent)


def test_many_copies_and_one_bucket(spark):
    draw = random.Random(9)
    base = [f"v{draw.randrange(500)}" for _ in range(80)]
    rows = []
    for i in range(400):
        copy = list(base)
        copy[i % 80] = f"new{i}"
        if i % 4 == 0:  # too far from the rest, near to one another
            copy[:16] = [f"other{k}" for k in range(16)]
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=32)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_empty_and_null_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(none).collect() == []
    nulls = spark.createDataFrame([(None, None), (None, "x y")], "doc_id long, text string")
    assert sorted(map(tuple, minhash.near_duplicates(nulls).collect()), key=str) == plain([(None, None), (None, "x y")])


def test_posterior_bounds():
    """The matches asked for are where the posterior's tail, integrated numerically, passes the miss probability."""
    t = (np.arange(200_000) + 0.5) / 200_000
    for n, m in zip(range(32, 129, 32), minhash.least_matches(80, 1e-6), strict=True):
        for matches, below in ((m - 1, True), (m, False)):
            log = matches * np.log(t) + (n - matches) * np.log1p(-t)
            density = np.exp(log - log.max())
            assert (density[t >= 0.8].sum() / density.sum() < 1e-6) == below


def test_signatures_estimate_similarity():
    draw = np.random.default_rng(1)
    common, a, b = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    row = np.repeat([0, 1], 800)
    _, places, bands = minhash.signatures(row, np.concatenate([common, a, common, b]))
    assert abs((places[0] == places[1]).mean() - 0.6) < 0.13 and bands.shape == (2, minhash.BANDS)
