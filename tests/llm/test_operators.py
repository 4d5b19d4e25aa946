"""The ten operators against brute force, round trips or held-out accuracy, with odd rows in every table."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewatch.llm")
from tidewatch.llm import bpe, components, fingerprints, jaccard, lines, mixing, quality_model, queries, repetition, style_tree, substrings, toxicity, words  # noqa: E402
from tidewatch.llm.ordering import in_descending_runs  # noqa: E402

ODD = [(900, None), (901, ""), (902, "x " * 60), (903, "é ñ " * 30 + "\x1c y"), (904, "one"), (904, "one"), (None, "no id"), (905, "Ab cD " * 4000)]


def docs(spark, rows, parts=4):
    """With an odd row each and columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.withColumns({"key": F.lit(1), "n": F.lit("x"), "score": F.lit(None).cast("double"), "root": F.lit("r"), "size": F.lit(2)})


def noise(n, alphabet="ab", most=40, seed=3):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, most)))) for i in range(n)]


def test_words_and_windows():
    texts = ["ab cd ab", "", None, "cd ab\tx é", "  ", "ab"]
    ((i, j, data, offsets),) = list(words.slices(pa.array(texts)))
    found = words.Words(data, offsets)
    assert [bytes(data[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)] == [w for t in texts for w in (t or "").split()]
    h = np.arange(100, dtype=np.uint64)
    h[50:85] = h[:35]
    w = words.window_hashes(h, 35)
    assert w[0] == w[50] and len(np.unique(w[:66])) == 65
    assert [(a, b) for a, b, _, _ in words.slices(pa.array(["a" * 10] * 5), 25)] == [(0, 2), (2, 4), (4, 5)]


def test_longest_repeats():
    rng = random.Random(5)
    for _ in range(100):
        x = np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 25))], np.uint64)
        n = len(x)
        common = lambda i, j: next((k for k in range(n) if max(i, j) + k >= n or x[i + k] != x[j + k]), 0)  # noqa: E731,B023
        assert list(repetition.longest_repeats(x)) == [max([0] + [common(i, j) for j in range(n) if j != i]) for i in range(n)]


def test_quality_rules(spark):
    rows = noise(60, "abcdefgh", 60) + ODD + [(7, "a b\n\na b\n c|#\na b"), (8, " ".join(f"w{i}" for i in range(40)))]
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in repetition.quality_rules(docs(spark, rows)).collect())
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        w = t.encode().split()
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + d for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for d in range(8)}
        full = [x for x in t.split("\n") if x.encode().split()]
        want[i, len(w), sum(len(x.decode()) for x in w), sum(t.count(s) for s in "#*$%&|<>"), len(full) - len(set(full)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)] += 1
    assert got == want
    kept = {r.doc_id: r.kept for r in repetition.quality_rules(docs(spark, rows)).collect()}
    assert kept[8] and not kept[902] and not kept[900]


def removed_by_hand(rows, k):
    split = [(t or "").encode().split() for _, t in rows]
    count = collections.Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = {a + d for a in range(len(w) - k + 1) if count[tuple(w[a : a + k])] > 1 for d in range(k)}
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return collections.Counter(out)


@pytest.mark.parametrize(("window", "seed_words"), [(8, 3), (5, 5), (35, 6)])
def test_substring_dedup(spark, window, seed_words):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = noise(80) + ODD + [(i, f"p{i} q{i} {shared} r{i}") for i in range(2000, 2040)] + [(3000, "alone " + " ".join(f"z{i}" for i in range(50)))]
    for hot in (3, 1000):
        got = substrings.substring_dedup(docs(spark, rows), window=window, seed_words=seed_words, hot=hot).collect()
        assert collections.Counter(map(tuple, got)) == removed_by_hand(rows, window)


def test_parts_are_one_row_for_all_pieces_that_hold_them():
    """Of 40 pieces around a common passage, the parts that all hold are one row each, and a piece that holds one many times is named once."""
    from tidewatch.llm.words import Words, signed, window_hashes

    common = [f"c{i}" for i in range(8)]
    pieces = [" ".join([f"a{n}", *common, f"z{n}"] if n else common * 5) for n in range(40)]
    raw = " ".join(common).encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    m = int(signed(window_hashes(words.hashes(substrings._SEED), 3))[3])
    batch = pa.record_batch({"m": pa.array([m] * 40), "packed": pa.array([p.encode() for p in pieces]), "copies": pa.array([2] * 40), "piece": pa.array([b"%d" % n for n in range(40)])})
    rows = [r for x in substrings._divided(batch, window=8, seed_words=3, step=1) for r in x.to_pylist()]
    parts = {}
    for n, piece in enumerate(pieces):
        split = piece.split()
        for i in range(len(split) - 7):
            parts.setdefault(" ".join(split[i : i + 8]), {}).setdefault(b"%d" % n, []).append(i)
    assert len(rows) == len(parts) == sum(len(split.split()) - 7 for split in pieces[1:]) - 38 + 7
    assert sorted((r["copies"], sorted((h["piece"], h["firsts"]) for h in r["held"])) for r in rows) == sorted((2 * sum(map(len, held.values())), sorted(held.items())) for held in parts.values())


def test_substring_dedup_around_a_common_passage(spark):
    """Of pieces around one minimiser only a few rows each are made, not one for every window, and no repeat is lost."""
    window, seed_words = 35, 6
    common = [f"s{i}" for i in range(60)]
    texts = [[*(f"a{k}_{i}" for i in range(k % 40)), *common, *(f"b{k}_{i}" for i in range(k % 37))] for k in range(60)]
    texts += [["x", "y", "x"] * 30, ["y", "x"] * 40 + common[:20] + ["x", "y"] * 20, *([f"c{k}", *common, "x", "y", "x", "x", f"d{k % 2}"] for k in range(10))]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    for hot in (2, 5, 1000):
        got = substrings.substring_dedup(docs(spark, rows), hot=hot).collect()
        assert collections.Counter(map(tuple, got)) == removed_by_hand(rows, window)
    pieces, least = [], []
    for _, _, data, offsets in words.slices(pa.array([t for _, t in rows])):
        of = words.Words(data, offsets)
        start, count, m = substrings.super_kmers(of, of.hashes(substrings._SEED), window, seed_words)
        flat = data.tobytes()
        pieces += [flat[of.start[a] : of.end[a + n + window - 2]] for a, n in zip(start, count, strict=True)]
        least += words.signed(m).tolist()
    batch = pa.record_batch({"m": pa.array(least, pa.int64()), "packed": pa.array(pieces, pa.binary())})
    core_of, n_windows, n_parts = {}, 0, 0
    for row, core, first, windows in substrings._kinds(batch, window, seed_words, 6):
        for r, c, f, w in zip(row.to_pylist(), core.to_pylist(), first.to_pylist(), windows.to_pylist(), strict=True):
            n_parts += 1
            for k in range(len(w) // 16):
                n_windows += 1
                assert core_of.setdefault(tuple(pieces[r].split()[f + k : f + k + window]), c) == c
    assert n_windows == sum(len(p.split()) - window + 1 for p in pieces)
    assert n_parts < n_windows / 2


def groups_by_hand(rows, k, percent):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, s in enumerate(sets):
        for y in range(x):
            if s and 100 * len(s & sets[y]) >= percent * len(s | sets[y]):
                up[max(top(x), top(y))] = min(top(x), top(y))
    least = collections.defaultdict(set)
    for x, (i, _) in enumerate(rows):
        least[top(x)].add(i)
    smallest = lambda ids: min((i for i in ids if i is not None), default=None)
    return collections.Counter((i, len(sets[x]), smallest(least[top(x)])) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent", "small"), [(4, 85, False), (2, 70, True)])
def test_jaccard_groups(spark, k, percent, small):
    rng = random.Random(2)
    base = [[rng.choice("abcdefghij") for _ in range(rng.randint(0, 40))] for _ in range(12)]
    rows = ODD[:]
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                w[rng.randrange(len(w))] = rng.choice("abcdefghijABC")
        rows.append((i, " ".join(w)))
    got = jaccard.jaccard_groups(docs(spark, rows), words=k, percent=percent, least=2, ordered=20 if small else 500_000).collect()
    assert collections.Counter(map(tuple, got)) == groups_by_hand(rows, k, percent)


def test_jaccard_bucket_of_two_groups(spark):
    """Two sets with one prefix are a group; a third that only one of them links with shares buckets with this group alone."""
    rows = []
    for t in range(20):
        names = [f"t{t}w{i}" for i in range(36)]
        ((_, _, data, offsets),) = list(words.slices(pa.array(names)))
        row, value = jaccard.shingle_sets(data, offsets, 1)
        ordered = [names[i] for i in row[np.argsort(value)]]
        prefix, tails = ordered[:4], (ordered[4:20], ordered[20:])
        rows += [(10 * t, " ".join(prefix + tails[0])), (10 * t + 1, " ".join(prefix + tails[1])), (10 * t + 2, " ".join(prefix[1:] + tails[1])), (10 * t + 3, " ".join(prefix[1:] + tails[1]))]
    got = jaccard.jaccard_groups(docs(spark, rows), words=1, percent=85, least=1 << 40).collect()
    assert collections.Counter(map(tuple, got)) == groups_by_hand(rows, 1, 85)


@pytest.mark.parametrize("size", [1, 1 << 10])
def test_maybe_among(spark, size):
    from tidewatch.llm.storage import maybe_among

    rows = spark.range(4000).selectExpr("id - 2000 AS item", "id AS hashed", "CAST(id AS string) AS text")
    keys = rows.filter("item % 20 = 0").select("item")
    got = maybe_among(rows, keys.union(spark.sql("SELECT CAST(null AS long)")), "item", size)
    assert got.columns == rows.columns and got.join(keys, "item", "left_semi").count() == 200
    assert size == 1 or got.count() < 400
    assert maybe_among(rows, keys.limit(0), "item", size).count() == 0 and maybe_among(rows.limit(0), keys, "item", size).count() == 0


def test_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (3, text + " x"), (3, text + " x"), (9, "other words here that are alone"), (8, None), (8, None)]
    df = docs(spark, rows)
    out = jaccard.one_of_each_group(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [3, 8, 8, 9]


def test_connected(spark):
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(1, 2), (3, 2), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for bound in (0, 1000):
        got = {r["item"]: r.root for r in components.connected(df, one_task=bound).collect()}
        assert got == {**{i: 1000 for i in range(1000, 1201)}, 1: 1, 2: 1, 3: 1}


def test_bpe_equals_the_library(spark):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    rng = random.Random(5)
    odd = ["á éx", "İstanbul ΣΑΣ ΣΑΣ. x", "<|endoftext|> hi<|startoftext|>x", "'s 'S it's !'s ''s don't 'll", "x" * 30000, "a b\u0085c\x1cd\x0be", "½ ² 10² ٣٤", "日本語 テスト 😀😀", " ́abc", "ª º ß ẞ ǅ", "a_b __ 1_2"]
    odd += ["".join(rng.choice("ab'sStd  \n1_.é́Σ<|😀") for _ in range(rng.randint(1, 2500))) for _ in range(30)]
    shared = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(600))
    rows = ODD + list(enumerate(odd + odd[:5])) + [(5000 + i, f"{i} {shared} end{i}") for i in range(12)]
    out = bpe.decode(bpe.encode(docs(spark, rows), path), path).collect()
    assert len(out) == len(rows)
    for r in out:
        found = whole.encode(r.text or "", add_special_tokens=False)
        assert list(r.ids) == found.ids
        assert r.decoded == whole.decode(found.ids, skip_special_tokens=False)


def test_encoder_forgets_its_words_when_a_task_ends():
    """Idle workers stay with their executor, so what they remember adds up."""
    with bpe.encoding(queries.tokenizer_path()) as code:
        ids = [x.tolist() for x in code.encode(["some words, some more"])]
        assert code.memory
    assert not bpe.encoder(queries.tokenizer_path()).memory
    with bpe.encoding(queries.tokenizer_path()) as code:
        assert [x.tolist() for x in code.encode(["some words, some more"])] == ids


def test_bpe_of_a_tokenizer_that_joins_white_space(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rng = random.Random(6)
    shared = "".join("".join(rng.choice("abcde") for _ in range(5)) + rng.choice([" ", "  ", "   ", "\n\n", " \n ", "\t"]) for _ in range(700))
    rows = ODD + [(5000 + i, f"{i} {shared} end{i}") for i in range(12)]
    for r in bpe.encode(docs(spark, rows), path).collect():
        assert list(r.ids) == whole.encode(r.text or "", add_special_tokens=False).ids


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(np.frombuffer(b"abcdefgh ", np.uint8), 20000))
    pieces = []
    for prefix in (b"", b"some other start of it "):
        data = np.frombuffer(prefix + text, np.uint8)
        spans = bpe.cores(data, np.array([0, len(data)]), 9, 128, 4096)[0]
        assert all(a <= b for a, b in spans) and spans[-1][1] == len(data)
        pieces.append({data.tobytes()[a:b] for a, b in spans})
    assert len(pieces[0] & pieces[1]) > 0.8 * len(pieces[0])


def test_edit_response(spark):
    rows = noise(300, "abc def", 80, 9) + ODD[:-1]
    df = docs(spark, rows)
    got = fingerprints.edit_response(df).collect()
    tie = {r.text: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]], r[1]))
    want = collections.Counter((i, len(t), hashlib.sha256(fingerprints.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    long = [r for r in got if r.n_chars > 60]
    assert np.mean([r.near_edited for r in long]) > 0.5 > np.mean([r.near_next for r in long])
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert fingerprints.edit_response(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_embedding_falls_into_step_again():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    near = text[:1000] + "Q" + text[1000:2500] + text[2503:]
    far = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
    s = fingerprints.embed([text, near, far, text, "", ""])
    alike = lambda i, j: fingerprints.likeness(s[[i]], s[[j]])[0]
    assert alike(0, 3) == alike(4, 5) == 1 and alike(0, 1) > 0.8 and alike(0, 2) < 0.2 and alike(0, 4) == 0
    assert (fingerprints.as_samples(fingerprints.as_strings(s)) == fingerprints.widened(s, fingerprints.as_samples(fingerprints.as_strings(s)).shape[1])).all()


def test_mixing(spark):
    rows = [(i, "w " * (1 + i % 50), ("a", "b", None, "c")[i % 7 % 4]) for i in range(600)] + [(None, None, "a"), (600, "", "b"), (1, "w w", "a"), (1, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).withColumn("target", F.lit("x"))
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mixed(df.repartition(3)).collect()))
    total = 0
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r.source == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size and all(r.taken in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 50
        total += mine[0].target
    assert total == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert mixing.mixed(df.filter("false")).collect() == []
    odd = df.withColumns({c: F.lit(7) for c in ("flow", "whole", "rest", "cut", "pattern", "range", "order", "limit")})
    assert sorted((r.doc_id or -1, r.taken, r["cut"], r["range"]) for r in mixing.mixed(odd).collect()) == sorted((r.doc_id or -1, r.taken, 7, 7) for r in got)
    assert sorted((str(r.doc_id), r.taken) for r in mixing.mixed(df, range_rows=1).collect()) == sorted((str(r.doc_id), r.taken) for r in got)


def test_targets_and_flow():
    assert mixing.shared_targets({"a": 100, "b": 10, "c": 50}, {"a": 3, "b": 1, "c": 2}) == {"a": 132.0, "b": 20.0, "c": 88.0}
    # the shared pattern's words go where single sources fall short, before anything is repeated
    flow = mixing.min_cost_flow({"x": 10, "xy": 10, "y": 1}, {"x": ["x"], "xy": ["x", "y"], "y": ["y"]}, {"x": 12, "y": 9}, 2)
    assert flow == {("x", "x"): 10, ("xy", "x"): 2, ("xy", "y"): 8, ("y", "y"): 1}


def test_overlapping_sources(spark):
    df = spark.createDataFrame([(1, "a b c", ["a", "b"]), (2, "d e", ["b"]), (3, None, None)], "doc_id long, text string, source array<string>")
    got = {r.doc_id: (r.source_size, r.taken) for r in mixing.mixed(df).collect()}
    assert got[3] == (0, 0) and all(0 < got[i][1] <= 6 for i in (1, 2))


def auc(pairs):
    bad, good = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])


def test_toxicity_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = toxicity.toxic_passages(d, labels).join(labels, "doc_id").filter("held_out").select("score", "toxic").collect()
    assert auc(out) > 0.8
    odd = toxicity.toxic_passages(docs(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    none = toxicity.toxic_passages(d.limit(3), labels.filter("toxic = 0")).collect()
    assert all(0 <= r.score < 0.5 for r in none)


def test_maximal_segments():
    rng = random.Random(6)
    model = toxicity.ToxicModel(np.empty(0, np.int64), np.empty(0), 0.1)
    for _ in range(200):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randint(0, 12))]
        got = model.segments(np.array(scores), np.array([0, len(scores)]))[0]

        def split(a, b):
            best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))  # noqa: B023
            return [] if best[0] <= 0 else split(a, best[2]) + [(best[2], best[3])] + split(best[3], b)

        assert [(a, b) for a, b, _ in got] == split(0, len(scores))


def test_quality_on_held_out_rows(spark):
    base = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = quality_model.quality_scores(d, labels).join(labels, "doc_id").filter("held_out").select("score", "quality").collect()
    assert auc(out) > 0.95
    odd = docs(spark, ODD)
    kept = quality_model.quality_scores(odd, labels, keep=True)
    assert kept.count() == len(ODD) and set(odd.columns) <= set(kept.columns)
    assert all(r.score == 0.5 for r in quality_model.quality_scores(odd, labels.filter("quality > 5")).collect())


def test_machine_identity():
    rng = np.random.default_rng(2)
    machine = quality_model.FactorisationMachine(np.zeros(2), np.ones(2), 0.3, rng.normal(size=6).astype(np.float32), rng.normal(size=(6, 3)).astype(np.float32), 0)
    x = rng.normal(size=(4, 6)).astype(np.float32)
    pairs = [0.3 + r @ machine.linear + sum(r[i] * r[j] * (machine.factors[i] @ machine.factors[j]) for i in range(6) for j in range(i)) for r in x]
    assert np.allclose(machine.logit(x), pairs, atol=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>m</a></ul></nav>
<div id="cookie-notice">We use cookies</div><main><article><h1>Head  line</h1><p>One <b>two</b>
three&nbsp;&lt;x&gt;<p>Next <a href="#">link</a> a < b<ul><li>i1<li>i2</ul><form>f<input></form><div class="share">s</div><footer>af</footer></article>
<section id=comments><p>c</p></section></main><aside>x</aside><footer>f</footer><script>var a="<p>";</script>"""


def test_main_text(spark):
    rows = [(1, "http://a/1", PAGE), (2, None, None), (3, "http://a/2", ""), (3, "x", "<p>hi&am"), (4, "http://a/4", "<div>" * 3000 + "deep")]
    got = collections.Counter((r.page_id, r.url, r.text, r.n_chars) for r in style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect())
    text = "Head line\nOne two three <x>\nNext link a < b\ni1\ni2"
    assert got == collections.Counter([(1, "http://a/1", text, len(text)), (2, None, "", 0), (3, "http://a/2", "", 0), (3, "x", "hi&am", 5), (4, "http://a/4", "deep", 4)])


@pytest.mark.parametrize("few", [True, False])
def test_style_tree_removes_what_pages_share(spark, few):
    rows = [(i, f"http://h/{i}", f"<body><div class=intro>Welcome to our site</div><div class=story><p>{'story %d ' % i * 9}</p></div><div class=end>The same line below</div>") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in style_tree.main_text(df, broadcast_rows=100 if few else 0).collect()}
    assert len(got) == 30 and all(got[i].text == ("story %d " % i * 9).strip() and got[i].n_removed == 2 for i in got)


def test_copies_of_a_page_keep_their_article(spark):
    page = "<body><article id='post-{0}'><p>{1}</p><p>{2}</p></article></body>"
    copy = page.format("a", "The whole story", "and its end")
    rows = [(i, f"http://h/{i}", page.format(i, f"story {i}", f"end {i}")) for i in range(20)] + [(100 + i, f"http://h/a?{i}", copy) for i in range(20)] + [(200 + i, f"http://g/{i}", copy) for i in range(20)]
    got = {r.page_id: r.text for r in style_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert all(got[i] == f"story {i}\nend {i}" for i in range(20)) and {got[k + i] for k in (100, 200) for i in range(20)} == {"The whole story\nand its end"}


@pytest.mark.parametrize("few", [True, False])
def test_shared_text_goes_where_shapes_differ(spark, few):
    story = lambda i: [f"story {i} part {k}" for k in range(i + 1)]
    rows = [(i, f"http://h/{i}", "<body><article><div class=intro>Same on all</div>" + "".join(f"<p>{x}</p>" for x in story(i)) + "<p>Call us today</p></article></body>") for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.text, r.n_removed) for r in style_tree.main_text(df, broadcast_rows=100 if few else 0).collect()}
    assert got == {i: ("\n".join(story(i)), 2) for i in range(12)}


def test_layout_words_and_teasers_leave_the_text():
    text = lambda page: "\n".join(b.text for b in style_tree.article_blocks(style_tree.parse(page)[0]))
    side = "<div class=sidebar>beside</div>"
    assert text(f"<div id=page class=right-sidebar><main><article><p>One</p></article></main>{side}</div>") == "One"
    assert text(f"<div class='layout legal-notice'><article><p>One</p></article>{side}</div>") == "One"
    assert text(f"<div class=right-sidebar><p>{'One ' * 20}</p>{side}</div>") == ("One " * 20).strip()
    assert text("<article><p>Long text</p></article><ol class=comment-list><article class=comment-body>They say more than that</article></ol>") == "Long text"
    assert text(f"<div><p>{'One ' * 20}</p></div><article>Teaser</article>").startswith("One One")
    assert text("<div class=sidebar><p>beside</p></div><div><p>One and two</p></div>") == "One and two"


def test_lines(spark):
    long = "The quick brown fox jumps over the lazy dog and runs far away {} over the hills and the seas until the night comes down."
    rows = [(1, long.format("today") + "\nunique one here\n!!!\n"), (2, long.format("Today,") + "\nother text"), (3, "!!!"), (3, None), (4, ""), (None, "unique one here"), (5, "alpha beta\nalpha beta\ngamma 12"), (6, "gamma 34")]
    df = docs(spark, rows)
    out = lines.without_repeated_lines(df)
    assert set(df.columns) <= set(out.columns)
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in out.collect() if r.text is not None)
    assert got == [("1", rows[0][1], 0), ("2", "other text", 1), ("3", "!!!", 0), ("4", "", 0), ("5", "alpha beta\ngamma 12", 1), ("6", "", 1), ("None", "", 1)]
    assert lines.without_repeated_lines(df.filter("false")).collect() == []


def test_line_groups_by_hand(spark):
    rng = random.Random(8)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(30)) for _ in range(20)]
    rows = []
    for i in range(120):
        w = rng.choice(base).split()
        if i % 3 == 0:
            w[rng.randrange(30)] += "x"
        rows.append((i, " ".join(w)))
    got = lines.line_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    root = {r.doc_id: r.root for r in got.collect()}
    data = pa.array(sorted({t for _, t in rows}))
    ((_, _, raw, offsets),) = list(words.slices(data))
    found = words.Words(raw, offsets)
    sim = dict(zip(data.to_pylist(), lines.simhashes(found, found.hashes(5)).tolist(), strict=True))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    up = {t: t for t in sim}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    texts = sorted(sim)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if (sim[a] ^ sim[b]).bit_count() <= 3 and distance(a, b) <= 0.2 * max(len(a), len(b)):
                up[top(a)] = top(b)
    size = collections.Counter(top(t) for _, t in rows)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t, i)
    grouped = {t for t in sim if size[top(t)] > 1}
    assert {by_text[t] for t in grouped} == root.keys()
    for a in grouped:
        for b in grouped:
            assert (root[by_text[a]] == root[by_text[b]]) == (top(a) == top(b))


def test_line_recall_against_edit_similarity(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    rows = []
    for i in range(300):
        w = [word() for _ in range((10, 20, 40)[i % 3])]
        rows.append((i, " ".join(w)))
        at = rng.randrange(len(w))
        w[at] = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in w[at])
        rows.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by_hand = {(r.a, r.b) for r in df.selectExpr("doc_id a", "text x").crossJoin(df.selectExpr("doc_id b", "text y")).filter("a < b AND 5 * levenshtein(x, y) <= greatest(length(x), length(y))").collect()}
    gone = {r.doc_id for r in lines.without_repeated_lines(df).collect() if r.n_removed}
    assert len(by_hand) >= 290 and gone <= {b for _, b in by_hand}
    for n in range(3):
        pairs = [b for a, b in by_hand if a % 3 == n]
        assert len(gone.intersection(pairs)) >= 0.93 * len(pairs)


def test_lines_with_other_figures_stay(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, "Total 1204\n12 34\nTOTAL: 1204"), (2, "Total 9871\n98 76"), (3, "98 76")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, df, "").collect()}
    assert kept == {1: "Total 1204\n12 34", 2: "Total 9871\n98 76"}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op10_line_dedup(spark, str(tmp_path)).collect()} == {1: 1, 2: 0, 3: 1}


def test_lines_of_the_same_words_in_another_order_stay(spark):
    """With the parameters of the query: permutations of 300 words stay, a line with one letter of each word changed goes, short or long."""
    rng = random.Random(11)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{k}" for k in range(300)]
    rows = [(i, " ".join(rng.sample(words, 300))) for i in range(20)]
    rows += [(100 + i, " ".join(words)) for i in range(2)]
    for n in (30, 60, 200):
        line = [f"wo{rng.randrange(10**8):08d}rd" for _ in range(n)]
        rows += [(1000 + n, " ".join(line)), (2000 + n, " ".join(line[: n - n // 10] + ["x" + w[1:] for w in line[n - n // 10 :]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in lines.without_repeated_lines(docs, figures=True).collect()}
    assert got == {i: int(i == 101 or 2000 <= i) for i, _ in rows}


def test_near_classes(spark):
    rng = random.Random(12)
    fresh = lambda: "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    base = [fresh() for _ in range(8)]
    rows = [(i, fresh()) for i in range(100, 140)] + [(1, None), (2, "")]
    for i in range(60):
        text = base[i % 8]
        at = rng.randrange(2900)
        rows.append((200 + i, text[:at] + "Z" + text[at + 2 :] if i >= 16 else text))
    got = {r.doc_id: r for r in fingerprints.near_classes(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and got[1].class_id == got[2].class_id == 1
    assert all(got[i].class_id == i for i in range(100, 140))
    found = sum(got[200 + i].class_id == 200 + i % 8 for i in range(60))
    assert found >= 57 and all(got[200 + i].class_id in (200 + i % 8, 200 + i) for i in range(60))


def test_fingerprint_query_has_classes(spark, tmp_path):
    """Against every pair of fingerprints, and the edit response by itself."""
    rng = random.Random(3)
    fresh = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(fresh)] + [(20 + i, t[: 40 * i] + "#" + t[40 * i :]) for i, t in enumerate(fresh)] + [(50, None), (51, ""), (52, fresh[0]), (52, fresh[1]), (None, fresh[2])]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_fingerprints(spark, str(tmp_path)).collect()
    plain = fingerprints.edit_response(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert collections.Counter(tuple(r)[:-1] for r in got) == collections.Counter(map(tuple, plain.collect())) and len(got) == len(rows)
    marks = fingerprints.as_samples([r.fingerprint for r in got])
    reach = {k: {k} for k in range(len(got))}
    for i in range(len(got)):
        like = fingerprints.likeness(np.repeat(marks[[i]], len(got), 0), marks)
        for j in np.flatnonzero(like >= 0.8):
            if reach[i] is not reach[int(j)]:
                both = reach[i] | reach[int(j)]
                reach.update(dict.fromkeys(both, both))
    assert [r.class_id for r in got] == [min((got[j].doc_id for j in reach[i] if got[j].doc_id is not None)) for i in range(len(got))]
    assert len({r.class_id for r in got}) < 20  # of 29 rows: classes do join texts


@pytest.mark.parametrize("size", [5, 8, 12, 20, 35, 60, 100, 140, 200, 270, 530, 1050])
def test_bands_of_near_texts(size):
    rng = random.Random(size)
    texts, changed = [], []
    for _ in range(1500 if size > 12 else 4000):
        t = [rng.choice("abcdefghijklmnop ") for _ in range(size)]
        texts.append("".join(t))
        for _ in range(rng.randint(1, max(1, size // 12))):
            t[rng.randrange(size)] = "Z"
        changed.append("".join(t))
    a, b = np.split(fingerprints.embed(texts + changed), 2)
    like = fingerprints.likeness(a, b)
    at = np.flatnonzero((like >= 0.8) & (like < (0.85 if size > 20 else 0.9)))
    a, b = fingerprints.as_strings(a), fingerprints.as_strings(b)
    met = [not set(fingerprints.band_keys(a[i], 8)).isdisjoint(fingerprints.band_keys(b[i], 8)) for i in at]
    assert len(at) >= 20 and np.mean(met) >= 0.9


@pytest.mark.parametrize("ids", [["b", "a", None, "ü", "aa"] * 7, [2**60 + k for k in range(30)] + [None, None], [None, None, None], [5], [3] * 9])
def test_descending_runs_of_any_ids(spark, ids):
    texts = [f"text {k} of {len(ids)}" for k in range(len(ids))]
    kind = "string" if any(isinstance(i, str) for i in ids) else "long"
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {kind}, text string").repartition(3)
    tie = {r[0]: r[1] for r in df.selectExpr("text", "xxhash64(text)").collect()}
    known = sorted((i for i in set(ids) if i is not None), key=lambda i: i.encode() if isinstance(i, str) else i, reverse=True)
    order = [t for i in [*known, None] for t in sorted((t for j, t in zip(ids, texts, strict=True) if j == i), key=lambda t: (tie[t], t))]
    want = dict(zip(order, order[1:] + order[:1], strict=True))
    got = {}
    for most in (1, 3, 1000):
        runs = in_descending_runs(df, rows_per_range=2, most_ranges=most).withColumn("p", F.spark_partition_id()).collect()
        got = {x.text: y.text for x, y in zip(runs[:-1], runs[1:], strict=True) if not x.ghost and x.p == y.p}
        assert got == want


def test_descending_runs_where_more_ranges_are_cut_than_asked(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    plain = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, n, *columns: plain(self, 9 * n, *columns))
    runs = in_descending_runs(df, rows_per_range=25).withColumn("p", F.spark_partition_id()).collect()
    got = {x.doc_id: y.doc_id for x, y in zip(runs[:-1], runs[1:], strict=True) if not x.ghost and x.p == y.p}
    assert got == {i: (i - 1) % 50 for i in range(50)}
