"""Repair and prefix trie of conversations against plain versions."""

import hashlib
import random
import zlib
from itertools import product

import numpy as np
import pytest

pytest.importorskip("tidewatch.llm")
from tidewatch.llm import repair, trie  # noqa: E402

SPACE = " \t\n\x0b\x0c\r"


# ---- trie ----


def plain_nodes(members):
    """members: {conv_id: [(key, words), ...]} to rows by prefix."""
    nodes = {}
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = lambda p: not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        ends = sorted(c for c in convs if len(members[c]) == len(path))
        out.append(
            (
                min(convs), len(path), min(nodes[path[:-1]]) if path else None, len(convs), sum(len(q) == len(path) + 1 and q[: len(path)] == path for q in nodes),
                sum(map(leaf, below)), sum((len(nodes[p]) - 1) * p[-1][1] for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def plain_trie(rows):
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]
    md5 = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
    by = {}
    for c, t, r, x in sorted(rows, key=lambda v: (v[1] is not None, v[1] or 0, v[2], md5(v[2], v[3]))):
        words = len([w for w in "".join(" " if ch in SPACE else ch for ch in x).split(" ") if w])
        by.setdefault(c, []).append((md5(r, x), words))
    members = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        members[c] = by.get(c - c % 20, [])[:h] + own[h:]
    return plain_nodes(members)


def got_trie(spark, rows):
    found = trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    return sorted((tuple(r) for r in found), key=str)


@pytest.mark.parametrize("shard", [1 << 16, 6])
def test_prefix_trie(spark, monkeypatch, shard):
    monkeypatch.setattr(trie, "SHARD", shard)
    draw = random.Random(shard)
    rows = []
    for c in [*range(60), 200, 205]:  # 200 with siblings, 205 among them
        if c == 40:
            continue  # siblings without a head
        same = draw.random() < 0.4
        for t in range(draw.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same words here " * (t + 1) if same else f"w{draw.randrange(3)} x y\n"))
    rows += [(7, None, None, "first of all"), (7, 0, "user", None), (7, 0, "user", None), (None, 0, "user", "no id"), (9, 3, "a", ""), (300, 0, "user", "hello")]
    assert got_trie(spark, rows) == plain_trie(rows)


def test_equal_conversations_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD", 40)
    monkeypatch.setattr(trie, "WIDTH", 2)
    rows = [(c * 20, t, "user", f"turn {t}") for c in range(300) for t in range(1 + (c % 50 == 0) + 2)]
    assert got_trie(spark, rows) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert got_trie(spark, []) == [] and got_trie(spark, [(None, 1, "user", "x")]) == []
    assert got_trie(spark, [(1, 0, "user", "a b")]) == plain_trie([(1, 0, "user", "a b")])  # without a head, the turn before h is lost


@pytest.mark.parametrize("seed", range(4))
def test_findclose_and_leaves(seed):
    draw, bits, depth = random.Random(seed), [1], 1
    for _ in range(3000 * (seed + 1)):
        up = depth == 1 or draw.random() < (0.5 if seed < 3 else 0.501)
        bits.append(int(up))
        depth += 1 if up else -1
    bits = np.array(bits + [0] * depth, np.int8)
    want, leaves, stack = {}, {}, []
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            want[stack.pop()] = i
    tree = trie.Parentheses(bits)
    close = tree.findclose()
    assert dict(zip(tree.opens.tolist(), close.tolist(), strict=True)) == want
    for i, j in want.items():
        leaves[i] = int((bits[i:j] & ~bits[i + 1 : j + 1] & 1).sum()) if j - i < 400 else None
    assert all(leaves[i] in (None, n) for i, n in zip(tree.opens.tolist(), tree.leaf_pairs(close).tolist(), strict=True))


# ---- repair ----


def plain_repair(letters, faults):
    """The least (cost, audit) over all edits, by exhaustion."""
    best = None
    n = len(letters)
    for edits in product(*(("D",) if f in "bd" else ("K", "R", "D") for f in faults)):
        for inserts in product((0, 1, 2), repeat=n + 1):
            cost, audit, q, ok = 0, "", 0, True

            def put(letter, q):
                if letter == "s":
                    return 1 if q == 0 else None
                return {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}[letter].get(q)

            for i in range(n + 1):
                for _ in range(inserts[i]):
                    q, cost, audit = (3 if q == 2 else 2), cost + 3, audit + "I"
                if i == n:
                    break
                e = edits[i]
                audit += e
                if e == "D":
                    cost += 4
                    continue
                cost += 3 * (faults[i] == "t") + 3 * (e == "R")
                q = put(letters[i], q) if e == "K" and letters[i] in "sua" else None if e == "K" else (3 if q == 2 else 2)
                if q is None:
                    ok = False
                    break
            if ok and q in (0, 3) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def test_lightest_derivations(monkeypatch):
    draw = random.Random(5)
    cases = [("".join(draw.choice("suao") for _ in range(n)), "".join(draw.choice("---tbd") for _ in range(n))) for n in (0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4) for _ in range(3)]
    whole = [repair.repaired_letters(*c) for c in cases]
    assert whole == [plain_repair(*c) for c in cases]
    # by blocks and by runs, long ones as well
    for size in (1, 2, 7):
        monkeypatch.setattr(repair, "ROWS", size)
        assert [repair.repaired_letters(*c) for c in cases] == whole
    long = [("".join(draw.choice("suuaaao") for _ in range(400)), "".join(draw.choice("-----tbd") for _ in range(400))) for _ in range(5)]
    for letters, faults in long:
        monkeypatch.setattr(repair, "ROWS", 512)
        want = repair.repaired_letters(letters, faults)
        monkeypatch.setattr(repair, "ROWS", 23)
        cost, audits = repair.put_together([repair.spans(letters[i : i + 60], faults[i : i + 60]) for i in range(0, 400, 60)])
        assert (cost, "".join(audits)) == want
        assert [sum(e != "I" for e in a) for a in audits] == [len(letters[i : i + 60]) for i in range(0, 400, 60)]


def plain_conversations(rows):
    md5 = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
    out = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else "".join(ch for ch in x if ch not in ".!?") if kind == 2 else x
        out[c] += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    result = {}
    for c, mine in out.items():
        mine.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], md5(v[1], v[2])))
        faults, seen = "", set()
        for _, r, x in mine:
            last = x.rstrip(SPACE)[-1:]
            faults += "b" if not last else "d" if (r, x) in seen else "t" if last not in ".!?" else "-"
            seen.add((r, x))
        turns = [t for t, *_ in mine if t is not None]
        letters = "".join(r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in mine)
        cost, audit = repair.repaired_letters(letters, faults)
        lines, at, q = [], 0, 0
        for e in audit:
            if e == "I":
                q = 3 if q == 2 else 2
                lines.append("user:" if q == 2 else "assistant:")
                continue
            _, r, x = mine[at]
            at += 1
            if e != "D":
                q = {"s": 1, "u": 2, "a": 3}[r[0]] if e == "K" else 3 if q == 2 else 2
                lines.append(f"{r if e == 'K' else 'user' if q == 2 else 'assistant'}:{x}")
        result[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), sum(letters[i : i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1)), cost, audit, "\n".join(lines))
    return result


@pytest.mark.parametrize("turns", [1024, 4])
def test_repairs(spark, monkeypatch, turns):
    monkeypatch.setattr(repair, "TURNS", turns)
    draw, rows = random.Random(turns), []
    for c in range(80):
        for t in range(draw.randrange(1, 12)):
            text = draw.choice(["Fine.", "Cut off", "", " \t", None, "Ends? \n", "quoted .", "x. ", "unit%d." % draw.randrange(3), "a\x1f"])
            rows.append((c, None if draw.random() < 0.05 else t * (1 + (c % 9 == 0)), draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    rows += [(500, 0, "user", "same."), (500, 0, "user", "same."), (500, 9, "user", "same."), (None, 0, "user", "hello."), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = plain_conversations(rows)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.repairs(frame).collect()}
    assert got == {c: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for c, v in want.items()}
    shown = repair.repaired_turns(frame, repair.plans(frame)).collect()
    shown.sort(key=lambda r: (r.run is not None, r.run or 0, r.place))
    for c, v in want.items():
        assert "\n".join(f"{r.role}:{r.text}" for r in shown if r.conv_id == c) == v[-1]


def test_one_long_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 1500}.") for t in range(5000)]
    want = plain_conversations(rows)[1]
    r = repair.repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:-1] and r.repaired_sha256 == hashlib.sha256(want[-1].encode()).hexdigest()


def test_dropped_empty_and_clashing(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "x", 1, "y")], "conv_id long, turn long, role string, text string, run int, key string")
    assert [tuple(r) for r in repair.repairs(frame).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repairs(frame.limit(0)).collect() == []
    assert len(trie.prefix_trie(frame.withColumn("conv_id", frame.conv_id * 20)).collect()) == 2
