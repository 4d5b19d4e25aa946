"""Prefix trie of conversations, encoded as balanced parentheses shard by shard.

A conversation travels as its path: 20 bytes a turn (md5 of role and text, words of the text), texts stay where they are.
Paths are dealt out by ranges of (path, conv_id), so a first turn, or a whole conversation, that a third of all share is
spread over tasks like any other. A task cuts its sorted paths into shards of SHARD turns. A shard's trie is a sequence
of parentheses; a tree of block minima of its excess answers findclose, which delimits each subtree; the rank of "()"
counts its leaves, and cumulative sums over preorder its savings and members.

Nodes on the first or last path of a shard (its spines) may go on in the shard before or after. Spines of neighbours
are folded into one another, within a task as it goes and then WIDTH tasks at a time, and nodes that are on neither
spine any more are done. All other nodes are exact in their shard, but for the conv_id of a parent on a spine.

Turns of a conversation go by turn (null first), then role, then md5; a null role or text is empty. Rows without conv_id
belong to no conversation and are left out. Repeated rows are turns like any other. An empty table has no nodes, not even
a root. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, joined_by_key, lean, written

#: Bytes of a turn in a path; turns of a shard; tasks whose spines are folded by one; positions of a block of excess.
RECORD, SHARD, WIDTH, BLOCK = 20, 1 << 16, 64, 128
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt_paths(conversations: DataFrame, siblings: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, path): each conversation's first h turns taken from the first of its `siblings` ids, h = crc32(conv_id) % heads."""
    c = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(n, F.lit("")).alias(n) for n in ("role", "text")))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    words = F.unhex(F.lpad(F.hex(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), 8, "0"))
    turns = c.select("conv_id", "turn", "role", F.concat(digest, words).alias("record"))
    own = turns.groupBy("conv_id").agg(F.expr("listagg(record) WITHIN GROUP (ORDER BY turn NULLS FIRST, role, record)").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % siblings
    first = own.filter(F.col("conv_id") % siblings == 0).select(F.col("conv_id").alias("base"), F.substring("own", 1, RECORD * heads).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int") * RECORD
    met = own.withColumns({"base": base, "h": h}).join(first, "base", "left")
    head = F.coalesce(F.expr("substring(head, 1, h)"), F.lit(b""))
    return met.select("conv_id", F.concat(head, F.expr("substring(own, h + 1)")).alias("path"))


class Parentheses:
    """A sequence of balanced parentheses (1 opens) with block minima of its excess in a tree."""

    def __init__(self, bits: np.ndarray):
        self.opens = np.flatnonzero(bits)
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        n = -(-len(bits) // BLOCK)
        padded = np.full((n, BLOCK), np.iinfo(np.int32).max, np.int32)
        padded.ravel()[: len(bits)] = self.excess
        self.blocks, self.leaves = padded, 1 << max(0, (n - 1).bit_length())
        self.least = np.full(2 * self.leaves, np.iinfo(np.int32).max, np.int32)
        self.least[self.leaves : self.leaves + n] = padded.min(1)
        level = self.leaves
        while level > 1:
            self.least[level // 2 : level] = self.least[level : 2 * level].reshape(-1, 2).min(1)
            level //= 2
        pairs = np.append(bits[:-1] & ~bits[1:] & 1, 0)
        self.pairs_before = np.append(0, np.cumsum(pairs))

    def _in_block(self, block: np.ndarray, start: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Where, from start on in its block, the excess is first lower than `below`; -1 if nowhere."""
        out = np.empty(len(block), np.int64)
        for i in range(0, len(block), 8192):
            part = slice(i, i + 8192)
            hit = (self.blocks[block[part]] < below[part, None]) & (np.arange(BLOCK) >= start[part, None])
            at = hit.argmax(1)
            out[part] = np.where(hit[np.arange(len(at)), at], block[part] * BLOCK + at, -1)
        return out

    def findclose(self) -> np.ndarray:
        """Of each opening parenthesis, where it closes."""
        below = self.excess[self.opens]
        block, start = self.opens // BLOCK, self.opens % BLOCK + 1
        out = self._in_block(block, start, below)
        far = np.flatnonzero(out < 0)
        if len(far):
            node, low = self.leaves + block[far] + 1, below[far]
            while True:  # up and to the right, over the largest ranges that begin there
                miss = self.least[node] >= low
                if not miss.any():
                    break
                node = np.where(miss, node + 1, node)
                up = miss & (node % 2 == 0)
                node = np.where(up, node // (node & -node), node)
            while (inner := node < self.leaves).any():
                left = np.where(inner, 2 * node, node)
                node = np.where(inner & (self.least[left] >= low), left + 1, left)
            out[far] = self._in_block(node - self.leaves, np.zeros(len(far), np.int64), low)
        return out

    def leaf_pairs(self, close: np.ndarray) -> np.ndarray:
        """How many "()" lie between each opening parenthesis and its close."""
        return self.pairs_before[close] - self.pairs_before[self.opens]


@dataclass
class Node:
    """A node on a spine."""

    depth: int
    id: bytes
    parent: bytes | None
    words: int
    conv_id: int
    n: int
    children: int
    leaves: int
    saved: int


Spines = tuple[list[Node], list[Node]]


def folded(a: Spines, b: Spines) -> tuple[Spines, list[Node]]:
    """The spines of two neighbours as one, and the nodes that are done.

    Nodes that both have are one: its savings grow by its words, since (n - 1) was counted twice; it stops being a leaf
    where only one side has no children; and so do all nodes above, which are shared too.
    """
    (a_first, a_last), (b_first, b_last) = a, b
    shared = 0
    while shared + 1 < min(len(a_last), len(b_first)) and a_last[shared + 1].id == b_first[shared + 1].id:
        shared += 1
    leaves = saved = 0
    last = list(b_last)
    for d in range(shared, -1, -1):
        x, y = a_last[d], b_first[d]
        children = x.children + y.children - (d < shared)
        leaves += (children == 0) - (x.children == 0) - (y.children == 0)
        saved += x.words
        if d < len(last) and last[d] is y:
            last[d] = x
        x.conv_id, x.n, x.children, x.leaves, x.saved = min(x.conv_id, y.conv_id), x.n + y.n, children, x.leaves + y.leaves + leaves, x.saved + y.saved + saved
    kept = {id(v) for v in a_first} | {id(v) for v in last}
    return (a_first, last), [v for v in (*a_last, *b_first[shared + 1 :]) if id(v) not in kept]


def _shared_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // RECORD
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * RECORD] == b[: mid * RECORD] else (low, mid - 1)
    return low


def _node_ids(path: bytes) -> list[bytes]:
    """Of the root and each turn, the md5 of the path so far."""
    sha = hashlib.md5()
    out = [sha.digest()]
    for at in range(0, len(path), RECORD):
        sha.update(path[at : at + RECORD])
        out.append(sha.digest())
    return out


def encoded(paths: list[bytes], convs: np.ndarray) -> tuple[dict[str, list], Spines, list[tuple[bytes, np.ndarray]]]:
    """(columns of the nodes inside, spines, ends of nodes on spines) of a shard: paths in order, equal ones by conv_id."""
    size = np.array([len(p) // RECORD for p in paths])
    common = np.array([0, *(_shared_turns(a, b) for a, b in zip(paths, paths[1:], strict=False))])
    new = size - common
    runs = np.zeros(2 * len(paths) + 1, np.int64)  # by turns parentheses that open and that close
    runs[0:-1:2] = new
    runs[0] += 1
    runs[1:-2:2] = size[:-1] - common[1:]
    runs[-2] = size[-1] + 1
    bits = np.repeat(np.arange(len(runs) - 1) % 2 == 0, runs[:-1]).astype(np.int8)
    words = np.concatenate([[0], *(np.frombuffer(p, ">u4").reshape(-1, RECORD // 4)[c:, -1] for p, c in zip(paths, common, strict=True))]).astype(np.int64)

    tree = Parentheses(bits)
    close = tree.findclose()
    nodes = np.arange(len(tree.opens))
    after = nodes + (close - tree.opens + 1) // 2
    ends_at = np.cumsum(new)  # preorder number of the node where each conversation ends
    low, high = np.searchsorted(ends_at, nodes), np.searchsorted(ends_at, after)
    n = high - low
    leaves = tree.leaf_pairs(close)
    gained = np.append(0, np.cumsum((n - 1) * words))
    saved = gained[after] - gained[nodes]
    smallest = np.minimum.reduceat(np.append(convs, np.iinfo(np.int64).max), np.stack([low, high], 1).ravel())[::2]
    own_ends = np.searchsorted(ends_at, nodes, "right") - low
    parent, stack, at = np.empty(len(nodes), np.int64), [0], 1
    parent[0] = -1
    for c, k in zip(common.tolist(), new.tolist(), strict=True):
        del stack[c + 1 :]
        if k:
            parent[at] = stack[c]
            parent[at + 1 : at + k] = np.arange(at, at + k - 1)
            stack.extend(range(at, at + k))
            at += k
    children = np.bincount(parent[1:], minlength=len(nodes))
    depth = tree.excess[tree.opens] - 1

    spine, ids = {}, {}
    for path, which in ((paths[0], range(size[0] + 1)), (paths[-1], stack)):
        for v, name in zip(which, _node_ids(path), strict=True):
            ids[v] = name
    for v in sorted(ids):
        spine[v] = Node(int(depth[v]), ids[v], ids.get(int(parent[v])), int(words[v]), int(smallest[v]), int(n[v]), int(children[v]), int(leaves[v]), int(saved[v]))
    ends = [(ids[v], convs[low[v] : low[v] + own_ends[v]]) for v in ids if own_ends[v]]

    on_spine = np.zeros(len(nodes) + 1, bool)
    on_spine[list(ids)] = True
    inside = np.flatnonzero(~on_spine[:-1])
    text = convs.astype(str) if len(inside) else convs
    above = parent[inside]
    columns = {
        "depth": depth[inside], "parent": [ids.get(v) for v in above.tolist()], "parent_conv": np.where(on_spine[above], -1, smallest[above]), "known": ~on_spine[above],
        "conv_id": smallest[inside], "n": n[inside], "children": children[inside], "leaves": leaves[inside], "saved": saved[inside],
        "ends": [hashlib.sha256(",".join(text[low[v] : low[v] + own_ends[v]]).encode()).hexdigest() if own_ends[v] else _NO_ENDS for v in inside.tolist()],
    }
    return columns, ([spine[v] for v in range(size[0] + 1)], [spine[v] for v in stack]), ends


#: Kinds of rows that tasks write: nodes inside, nodes done, nodes on the first and last spine of a task, ends of nodes on spines.
INSIDE, DONE, OPEN, ENDS = range(4)
_COLUMNS = {
    "kind": pa.int32(), "part": pa.int64(), "side": pa.int32(), "depth": pa.int64(), "id": pa.binary(), "parent": pa.binary(), "parent_conv": pa.int64(), "words": pa.int64(), "conv_id": pa.int64(),
    "n": pa.int64(), "children": pa.int64(), "leaves": pa.int64(), "saved": pa.int64(), "ends": pa.string(), "ids": pa.binary(),
}
_SQL = "kind int, part long, side int, depth long, id binary, parent binary, parent_conv long, words long, conv_id long, n long, children long, leaves long, saved long, ends string, ids binary"


def _rows(count: int, /, **columns) -> pa.RecordBatch:
    arrays = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], kind) if c in columns else pa.nulls(count, kind) for c, kind in _COLUMNS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_COLUMNS))


def _node_rows(kind: int, nodes: list[Node], part: int = 0, sides: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        values = {c: [getattr(v, c) for v in some] for c in ("depth", "id", "parent", "words", "conv_id", "n", "children", "leaves", "saved")}
        yield _rows(len(some), kind=[kind] * len(some), part=[part] * len(some), side=sides[at : at + 10_000] if sides else [0] * len(some), **values)


def _open_rows(spines: Spines, part: int) -> Iterator[pa.RecordBatch]:
    first, last = spines
    both = {id(v) for v in first} & {id(v) for v in last}
    nodes = [*first, *(v for v in last if id(v) not in both)]
    yield from _node_rows(OPEN, nodes, part, [3 if id(v) in both else 1 for v in first] + [2] * (len(nodes) - len(first)))


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    paths, convs, held = [], [], 0
    for batch in batches:
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            paths.append(path)
            convs.append(conv)
            held += len(path) // RECORD + 1
            if held >= SHARD:
                yield paths, np.array(convs, np.int64)
                paths, convs, held = [], [], 0
    if paths:
        yield paths, np.array(convs, np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (path, conv_id) of a range to rows of all kinds."""
    part, spines = TaskContext.get().partitionId(), None
    for paths, convs in _shards(batches):
        inside, mine, ends = encoded(paths, convs)
        known, m = inside.pop("known"), len(inside["conv_id"])
        if m:
            parent_conv = pa.array(inside.pop("parent_conv"), mask=~known)
            yield _rows(m, kind=[INSIDE] * m, parent_conv=parent_conv, **{c: pa.array(v.astype(np.int64)) if isinstance(v, np.ndarray) else v for c, v in inside.items()})
        for name, some in ends:
            yield _rows(1, kind=[ENDS], id=[name], conv_id=[int(some[0])], ids=[some.tobytes()])
        if spines is None:
            spines = mine
        else:
            spines, done = folded(spines, mine)
            yield from _node_rows(DONE, done)
    if spines:
        yield from _open_rows(spines, part)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open spines, sorted by (group, part, depth): those of each group folded into one."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for group, parts in groupby(rows, key=lambda r: r["group"]):
        spines = None
        for _, mine in groupby(parts, key=lambda r: r["part"]):
            first, last = [], []
            for r in mine:
                node = Node(*(r[c] for c in ("depth", "id", "parent", "words", "conv_id", "n", "children", "leaves", "saved")))
                if r["side"] & 1:
                    first.append(node)
                if r["side"] & 2:
                    last.append(node)
            if spines is None:
                spines = first, last
            else:
                spines, done = folded(spines, (first, last))
                yield from _node_rows(DONE, done)
        yield from _open_rows(spines, group)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, first, ids), sorted by id and first, to (id, ends)."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
    for name, some in groupby(rows, key=lambda r: r[0]):
        sha, comma = hashlib.sha256(), ""
        for _, ids in some:
            sha.update((comma + ",".join(np.frombuffer(ids, np.int64).astype(str))).encode())
            comma = ","
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sha.hexdigest()])], ["id", "ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = rebuilt_paths(conversations).select("path", "conv_id")
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(paths.repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(lean(_encode), _SQL))
    opened, done, held = rows.filter(F.col("kind") == OPEN), [rows.filter(F.col("kind") == DONE)], []
    while (opened.agg(F.max("part")).first()[0] or 0) > 0:  # a number of tasks, at most
        grouped = opened.withColumn("group", F.expr(f"part div {WIDTH}")).repartition("group").sortWithinPartitions("group", "part", "depth")
        held.append(written(grouped.mapInArrow(lean(_fold), _SQL)))
        opened = held[-1].filter(F.col("kind") == OPEN)
        done.append(held[-1].filter(F.col("kind") == DONE))
    spine = opened
    for d in done:
        spine = spine.union(d)
    digests = rows.filter(F.col("kind") == ENDS).select("id", F.col("conv_id").alias("first"), "ids").repartition("id").sortWithinPartitions("id", "first").mapInArrow(lean(_digests), "id binary, ends string")
    names = ["depth", "parent", "conv_id", "n", "children", "leaves", "saved", "ends"]
    nodes = written(spine.drop("ends").join(digests, "id", "left").withColumn("ends", F.coalesce("ends", F.lit(_NO_ENDS))).select("id", *names))
    discard(*held)
    inside = rows.filter(F.col("kind") == INSIDE)
    waiting = inside.filter("parent IS NOT NULL").select(*names).union(nodes.filter("parent IS NOT NULL").select(*names))
    above = written(nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv"), F.col("children").alias("times")))
    met = joined_by_key(waiting, above, "parent", "times")
    out = met.select("parent_conv", *names)
    out = out.union(inside.filter("parent IS NULL").select("parent_conv", *names)).union(nodes.filter("parent IS NULL").select(F.lit(None).cast("long"), *names))
    return out.select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
