"""Edit similarity in bits against the plain recurrence, and hashes of words against their bytes."""

import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tidewatch.llm")
from tidewatch.llm import edits, words  # noqa: E402


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def changed(rng, text, times, symbols):
    text = list(text)
    for _ in range(times):
        at = rng.randrange(len(text) + 1)
        text[at : at + rng.randint(0, 1)] = rng.choice(symbols) * rng.randint(0, 1)
    return text or list(symbols[:1])


def test_distances_by_hand(monkeypatch):
    rng = random.Random(3)
    x, y = [], []
    for size in [1, 2, 5, 30, 63, 64, 65, 127, 128, 129, 200, 300] * 6:
        a = [rng.choice("abcdé ☃") for _ in range(size)]
        x.append("".join(a))
        y.append("".join(changed(rng, a, rng.randint(0, size), "abcdé ☃")))
    want = [distance(a, b) for a, b in zip(x, y, strict=True)]
    for size in (edits._BYTES, 3000):
        monkeypatch.setattr(edits, "_BYTES", size)
        assert list(edits._characters(x, y)) == want
    for most in (0, 1, 7, 40, 400):
        assert [edits.bounded_distance(a, b, most) for a, b in zip(x, y, strict=True)] == [min(d, most + 1) for d in want]
    for percent, size in product((80, 95), (0, 1000)):
        monkeypatch.setattr(edits, "CHARACTERS", size)
        assert list(edits.alike(x, y, percent)) == [100 * d <= (100 - percent) * max(len(a), len(b)) for a, b, d in zip(x, y, want, strict=True)]


def test_long_texts():
    rng = random.Random(4)
    base = [rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(6000)]
    other = base[:]
    for at in range(0, 6000, 10):
        other[at] = "other"
    for n in (200, 1000, 6000):
        one, two = " ".join(base[:n]), " ".join(other[:n])
        assert list(edits.alike([one, one, one], [two, one, "z " * n + "z"], 80)) == [True, True, False]
    assert list(edits.alike([" ".join(base)], [" ".join(base[:4000])], 80)) == [False]


@pytest.mark.parametrize("size", [200, 300, 1500, 2500])
def test_one_measure_at_every_length(size):
    rng = random.Random(size)
    letters = "abcdefgh ijé☃" + "".join(chr(0x4E00 + k) for k in range(300 if size == 1500 else 0))
    x, y = [], []
    for share in (0.01, 0.1, 0.19, 0.2, 0.22, 0.6):
        a = [rng.choice(letters) for _ in range(size)]
        x.append("".join(a))
        y.append("".join(changed(rng, a, int(size * share * 1.4), letters)))
    words = [f"w{k}" for k in range(size // 5)]
    x.append(" ".join(words))
    y.append(" ".join(rng.sample(words, len(words))))  # the same words in another order
    want = [distance(a, b) for a, b in zip(x, y, strict=True)]
    assert list(edits.alike(x, y, 80)) == [5 * d <= max(len(a), len(b)) for a, b, d in zip(x, y, want, strict=True)]
    assert not edits.alike(x[-1:], y[-1:], 80)[0]


def test_common_ends_and_bounds(monkeypatch):
    rng = random.Random(12)
    x, y = [], []
    for size in [1, 2, 3, 9, 40, 130, 200] * 12:
        a = "".join(rng.choice("ab é") for _ in range(size))
        x.append(a)
        y.append("".join(changed(rng, a, rng.choice([0, 1, 2, size // 3, size]), "ab é")))
    x += ["aa", "aba", "abab", "a" * 300]
    y += ["aaa", "ababa", "ab", "a" * 200]
    want = [distance(a, b) for a, b in zip(x, y, strict=True)]
    for a, b, d in zip(x, y, want, strict=True):
        left, right = edits.without_common_ends(a, b)
        assert distance(left, right) == d and not (left and right and (left[0] == right[0] or left[-1] == right[-1]))
        assert edits.integer_distance(a, b, 1000) == d
        for most in (0, 3, 30):
            found = edits.integer_distance(a, b, most)
            assert found == d if d <= most else most < found <= d
    for batch, integers in ((128, 16_384), (0, 16_384), (0, 0)):
        monkeypatch.setattr(edits, "CHARACTERS", batch)
        monkeypatch.setattr(edits, "INTEGERS", integers)
        out, size, least = edits.distances(x, y, 80)
        for d, found, longer, more in zip(want, out.tolist(), size.tolist(), least.tolist(), strict=True):
            assert (5 * longer < 25 * found <= 25 * d) if more else found == d


def test_very_long_texts():
    rng = random.Random(8)
    a = [rng.choice("abcdefghijklmnop ") for _ in range(20_000)]
    b = a[:]
    for at in range(0, 20_000, 8):
        b[at] = "#"  # one letter of eight: 87.5 %
    c = [v for at, v in enumerate(a) if at % 4]  # 75 %
    a, b, c = "".join(a), "".join(b), "".join(c)
    assert edits.bounded_distance(a, b, 4000) == 2500 and edits.bounded_distance(b, a, 2499) == 2500 and edits.bounded_distance(a, c, 4000) == 4001
    assert edits.bounded_distance(a, c, 5000) == 5000 and edits.bounded_distance(a, a, 0) == 0 and edits.bounded_distance(a, a[:-1], 0) == 1


def test_hashes_are_of_bytes():
    rng = random.Random(5)
    each = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 63, 64, 65, 80, 300]))) for _ in range(400)]
    texts = [" ".join(each[:200]), " ".join(each[200:]), " ".join(each)]
    ((_, _, data, offsets),) = list(words.slices(pa.array(texts)))
    h = words.Words(data, offsets).hashes(7).tolist()
    assert h[:400] == h[400:]
    assert len(set(h)) == len(set(each))
    assert np.unique(words.Words(data, offsets).hashes(8)).size == len(set(each)) and set(h).isdisjoint(words.Words(data, offsets).hashes(8).tolist())


def test_line_groups_with_the_parameters_of_the_query(spark, monkeypatch):
    """Crowded buckets, settled in cells of a few lines each, against all pairs that share a key."""
    from tidewatch.llm import lines

    monkeypatch.setattr(lines, "BLOCK", 4)
    rng = random.Random(21)
    stock = [f"word{k}" for k in range(60)]
    texts = []
    for _ in range(4):
        base = [rng.choice(stock) for _ in range(rng.choice([9, 14, 30]))]
        for _ in range(45):
            line = base[:]
            for at in rng.sample(range(len(line)), rng.randint(0, len(line) // 3)):
                line[at] = rng.choice(stock)
            texts.append(" ".join(line[: len(line) - rng.choice([0, 0, 0, 2])]))
    texts += ["", "...", texts[0], texts[0] + "!", "17 18 19 20", "17 18 19 21"]
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = lines.described_lines(docs, blocks=3, together=2, bands=10, figures=True)
    forms = {r.item: r for r in kept.collect() if r.keys is not None}
    text_of = {r.item: " ".join(texts[r.doc_id].replace(".", " ").replace("!", " ").split()) for r in kept.collect()}
    order = sorted(text_of)
    keys = {item: np.frombuffer(forms[item].keys, np.uint64) for item in order}
    links = []
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if (keys[a] == keys[b]).any() and 5 * distance(text_of[a], text_of[b]) <= max(len(text_of[a]), len(text_of[b])):
                links.append((a, b, bin((forms[a].simhash ^ forms[b].simhash) & (1 << 64) - 1).count("1")))

    def groups(far):
        root = {item: item for item in order}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, bits in links:
            if bits <= far:
                root[top(a)] = top(b)
        return {item: top(item) for item in order}

    # the line that a crowded bucket is held against may link with lines beyond the SimHash distance
    least, most = groups(20), groups(64)
    found = {r.item: r.root for r in lines.line_groups(docs, blocks=3, together=2, bands=10, figures=True).collect()}
    found = {item: found.get(item, item) for item in order}
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            assert least[a] != least[b] or found[a] == found[b]
            assert found[a] != found[b] or most[a] == most[b]
    assert len(set(least.values())) < len(order) - 60 and len(set(most.values())) > 5


def test_forms_leave_their_texts_alone(spark):
    """Of texts that hold an asked line, the line alone is shuffled, whatever the number of asked lines."""
    from tidewatch.llm import lines
    from tidewatch.llm.storage import text_key

    draw = np.random.default_rng(5)
    long = [draw.bytes(40_000).hex() for _ in range(20)]
    texts = [f"{t}\nLine  Nr. {k}, É!\n" for k, t in enumerate(long)] + ["Again here\n\nAgain here", "Again here\n\nAgain here", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    docs.count()
    named = docs.select("doc_id", text_key("text").alias("key")).collect()
    asked = [(r.doc_id, bytes(r.key), 1) for r in named if r.doc_id < 20] + [(99, bytes(next(r.key for r in named if r.doc_id == 20)), 2)]
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def shuffled():
        bus.waitUntilEmpty(30_000)
        return store.executorList(False).apply(0).totalShuffleWrite()

    frame = spark.createDataFrame(asked, "item long, key binary, n long").cache()
    frame.count()
    before = shuffled()
    got = [tuple(r) for r in lines._forms(docs, frame, "text", True).select("item", "form").collect()]
    assert sorted(got) == [*((k, f"line nr {k} é") for k in range(20)), (99, "again here")]
    assert shuffled() - before < 200_000 < sum(map(len, long))


def test_many_longer_pairs_are_measured_together(monkeypatch):
    """Lines of 129 to 512 characters have the same distances in batches as one by one, and many of them never go one by one."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(140, 500))) for _ in range(100)]
    other = ["".join(c if rng.random() > 0.2 else rng.choice("xyz") for c in t) for t in base]
    want = [edits.integer_distance(a, b, 10**6) for a, b in zip(base, other, strict=True)]
    few = edits.distances(base[:10], other[:10], 80)[0].tolist()
    monkeypatch.setattr(edits, "integer_distance", None)
    monkeypatch.setattr(edits, "_POINTS", 7000)
    found, longer, unit = edits.distances(base, other, 80)
    assert found.tolist() == want and few == want[:10] and not unit.any()
    assert longer.tolist() == [max(len(a), len(b)) for a, b in zip(base, other, strict=True)]


def test_lines_beyond_512_characters_are_measured_together(monkeypatch):
    """Few of many pairs of 520 to 1,000 characters go one by one, and what is known of their distances is right."""
    rng = random.Random(6)
    x = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(520, 1000))) for _ in range(200)]
    y = ["".join(changed(rng, list(t), int(len(t) * rng.choice([0.02, 0.1, 0.25, 0.3, 0.7])), "abcdefgh ")) for t in x]
    want = np.array([edits.integer_distance(a, b, 10**6) for a, b in zip(x, y, strict=True)])
    alone, one = [], edits.integer_distance
    monkeypatch.setattr(edits, "integer_distance", lambda a, b, most: alone.append(len(b)) or one(a, b, most))
    for beyond in (1, 2):
        found, longer, unit = edits.distances(x, y, 80, beyond)
        most = 20 * longer // 100
        assert ((found <= most) == (want <= most)).all() and 40 < (want <= most).sum() < 160
        assert (found[unit == 0] == want[unit == 0]).all()
        assert (found[unit == 1] <= want[unit == 1]).all() and (found[unit == 1] > beyond * most[unit == 1]).all()
        assert (found[unit == 2] >= want[unit == 2]).all() and (found[unit == 2] <= most[unit == 2]).all()
    assert sum(size > 512 for size in alone) < 40


def test_cells_are_compared_together(monkeypatch):
    """Small cells share a comparison; each finds the links that join its classes, and bounds of either kind rule nothing out that may be a link."""
    from tidewatch.llm import lines

    rng = random.Random(9)
    rows = []
    for bucket in range(40):
        base = "".join(rng.choice("abcdefgh ") for _ in range(80))
        for k in range(6):  # the classes 3 to 5 are alike, the others are not
            form = "".join(changed(rng, list(base), 3, "abcdefgh ")) if k > 2 else "".join(rng.choice("abcdefgh ") for _ in range(80))
            rows.append({"bucket": bucket, "x": 0, "y": bucket % 2, "in_block": k % 2 if bucket % 2 else 0, "item": 10 * bucket + k, "root": 10 * bucket + k, "size": len(form), "sketch": 0, "near": 1000 + bucket, "distance": 30, "unit": k % 3, "buckets": [bucket], "form": form})
    calls, alike = [], lines.alike
    monkeypatch.setattr(lines, "alike", lambda a, b, percent: (calls.append(len(a)), alike(a, b, percent))[1])
    cells = lines._Cells(pa.Table.from_pylist(rows), 80, 20)
    links = {(a, b) for batch in cells.links() for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)}
    root = {r["item"]: r["root"] for r in rows}
    form, block = {r["item"]: r["form"] for r in rows}, {r["item"]: r["in_block"] for r in rows}
    want = [(a, b) for bucket in range(40) for a in range(10 * bucket, 10 * bucket + 6) for b in range(a + 1, 10 * bucket + 6) if (bucket % 2 == 0 or block[a] != block[b]) and 5 * distance(form[a], form[b]) <= max(len(form[a]), len(form[b]))]
    assert links <= set(want)

    def top(item):
        while root[item] != item:
            item = root[item]
        return item

    for a, b in links:
        root[top(a)] = top(b)
    assert len(links) == 80 and all(top(a) == top(b) for a, b in want)
    assert len(calls) <= 3 < 40
