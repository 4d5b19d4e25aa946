"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). From the patterns' sizes to the
sources' quotas runs a flow network: pattern p can send its size once at cost 1, a second time at cost 2 and so on up
to max_repeats, so that fresh words go before repeated ones (convex repetition costs). Each pattern's flow is then
taken by documents in the order of a seeded hash: all of them as often as the flow covers the whole pattern, the first
ones of the order once more.

Only patterns (not documents) reach the driver: their number is checked against max_patterns. The order is cut by a
histogram of the hash over ranges of some `range_rows` rows of the table, so no task sorts or holds a whole pattern;
only the one range in which the cut falls is summed up row by row. All that reads sizes and hashes alone, from a table
without texts.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, free_names, written


def word_count(text: str = "text") -> Column:
    """Runs of other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def shared_targets(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """share of all sizes dealt by weight; no source gets over most times its size, and what exceeds that is dealt anew among the others."""
    left, targets = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    free = {s for s in sizes if weights[s] > 0}
    while free:
        unit = left / sum(weights[s] for s in free)
        above = {s for s in free if weights[s] * unit > most * sizes[s]}
        if not above:
            return targets | {s: weights[s] * unit for s in free}
        for s in above:
            targets[s] = most * sizes[s]
        left -= sum(targets[s] for s in above)
        free -= above
    return targets


def min_cost_flow(capacity: dict, members: dict, quota: dict, max_repeats: int) -> dict:
    """{(pattern, source): words} of the cheapest flow among the largest ones, by successive shortest paths.

    capacity: words of each pattern; members: its sources; quota: words that each source takes. The k-th pass over a
    pattern costs k a word.
    """
    source, sink = ("s",), ("t",)
    arcs: list[list] = []  # from, to, left, cost
    at: dict = {}

    def arc(a, b, room: float, cost: int) -> None:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0.0, -cost)):
            at.setdefault(x, []).append(len(arcs))
            arcs.append([x, y, r, c])

    for p, size in capacity.items():
        for k in range(max_repeats):
            arc(source, ("p", p), float(size), k + 1)
        for m in members[p]:
            arc(("p", p), ("q", m), float("inf"), 0)
    for q, room in quota.items():
        arc(("q", q), sink, float(room), 0)
    level: dict = {}
    while True:
        far, via, heap, n = {source: 0}, {}, [(0, 0, source)], 0
        while heap:
            d, _, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for i in at.get(x, ()):
                _, y, room, cost = arcs[i]
                step = d + cost + level.get(x, 0) - level.get(y, 0)
                if room > 1e-9 and step < far.get(y, float("inf")):
                    far[y], via[y], n = step, i, n + 1
                    heapq.heappush(heap, (step, n, y))
        if sink not in far:
            break
        most = max(far.values())
        for x in at:
            level[x] = level.get(x, 0) + far.get(x, most)
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = arcs[via[x]][0]
        push = min(arcs[i][2] for i in path)
        for i in path:
            arcs[i][2] -= push
            arcs[i ^ 1][2] += push
    return {(x[1], y[1]): arcs[i + 1][2] for i, (x, y, _, _) in enumerate(arcs) if i % 2 == 0 and x[0] == "p" and arcs[i + 1][2] > 0}


def mixed(docs: DataFrame, weights: dict | None = None, id_column: str = "doc_id", text_column: str = "text", sources: str = "source", cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: int = 17, range_rows: int = 50_000, max_patterns: int = 100_000) -> DataFrame:
    """docs with size, source_size, target, taken and repeats (whole times that the mix takes the row).

    sources is a string column, or an array of strings where documents belong to several. weights by source; without
    them, sources by code point (null last) weigh `cycle` in turn. source_size and target are sums over the row's
    sources. Null texts have size 0 and are taken 0 times; a null or empty membership is a source of its own. Rows of
    equal id and text have equal hashes and are taken alike. Rows of docs that hold one of the new names lose that
    column; others keep theirs, whatever their names. An empty table gives no row.
    """
    new = ("size", "source_size", "target", "taken", "repeats")
    kept = docs.drop(*new)
    kind = dict(docs.dtypes)[sources]
    in_pattern, in_order, in_range = free_names(docs, "pattern", "order", "range")
    pattern = F.to_json(F.array_sort(F.array_distinct(F.col(sources)))) if kind.startswith("array") else F.to_json(F.array(F.col(sources)))
    pattern = F.coalesce(pattern, F.lit("[null]"))
    order = F.xxhash64(F.lit(seed), F.col(id_column), F.col(text_column))
    # without texts, so that what follows moves a few bytes a row
    slim = written(docs.select(pattern.alias("pattern"), order.alias("order"), word_count(text_column).alias("size")))
    bits = max(10, (slim.count() // range_rows).bit_length())
    of_range = lambda name: F.shiftrightunsigned(name, 64 - bits)  # noqa: E731  one range of the hash in 2 ** bits, from the top bits
    ranged = slim.withColumn("range", of_range("order"))
    sums = ranged.groupBy("pattern", "range").agg(F.sum("size").alias("words"))
    totals = sums.groupBy("pattern").agg(F.sum("words").alias("words")).limit(max_patterns + 1).collect()
    if len(totals) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns; join rare sources first")
    capacity = {r["pattern"]: int(r["words"]) for r in sorted(totals, key=lambda r: r["pattern"])}
    members = {p: json.loads(p) or [None] for p in capacity}
    names = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))
    sizes = dict.fromkeys(names, 0)
    for p, words in capacity.items():
        for s in members[p]:
            sizes[s] += words
    weigh = {s: float((weights or {}).get(s, 0)) if weights is not None else cycle[i % len(cycle)] for i, s in enumerate(names)}
    targets = shared_targets(sizes, weigh, share, max_repeats)
    flows = dict.fromkeys(capacity, 0.0)
    for (p, _), words in min_cost_flow(capacity, members, targets, max_repeats).items():
        flows[p] += words
    plan = []
    for p, words in capacity.items():
        whole = min(int(flows[p] / words + 1e-9), max_repeats) if words else 0
        plan.append((p, int(sum(sizes[s] for s in members[p])), float(sum(targets[s] for s in members[p])), whole, max(flows[p] - whole * words, 0.0)))
    quotas = docs.sparkSession.createDataFrame(plan, "pattern string, source_size long, target double, whole int, rest double")
    # words before each range: a running sum over the ranges of each pattern on its own
    ahead = Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0))).join(F.broadcast(quotas.select("pattern", "rest")), "pattern")
    full = ranges.filter(F.col("before") + F.col("words") <= F.col("rest")).groupBy("pattern").agg(F.max("range").alias("last_full"))
    cut = ranges.filter((F.col("before") < F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select("pattern", F.col("range").alias("cut"), (F.col("rest") - F.col("before")).alias("in_cut"))
    running = Window.partitionBy("pattern").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.join(F.broadcast(cut.withColumnRenamed("cut", "range")), ["pattern", "range"]).groupBy("pattern", "order", "in_cut").agg(F.sum("size").alias("size"))
    # the hash over which the quota runs out is taken if that ends nearer to it
    limit = inside.withColumn("sum", F.sum("size").over(running)).filter(F.col("sum") - F.col("size") / 2 < F.col("in_cut")).groupBy("pattern").agg(F.max("order").alias("limit"))
    chosen = written(quotas.join(full, "pattern", "left").join(cut.select("pattern", "cut"), "pattern", "left").join(limit, "pattern", "left"))
    discard(slim)
    chosen = F.broadcast(chosen.withColumnRenamed("pattern", "of_pattern").select(F.struct("*").alias(in_range)))  # at most max_patterns rows
    met = kept.withColumns({in_pattern: pattern, in_order: order, "size": word_count(text_column)}).join(chosen, F.col(in_pattern) == F.col(in_range)["of_pattern"])
    mine, at = F.col(in_range), of_range(in_order)
    once = F.coalesce(at <= mine["last_full"], F.lit(False)) | F.coalesce((at == mine["cut"]) & (F.col(in_order) <= mine["limit"]), F.lit(False))
    repeats = F.when(F.col("size") > 0, F.least(mine["whole"] + once.cast("int"), F.lit(max_repeats))).otherwise(0)
    met = met.withColumn("repeats", repeats)
    return met.select(*kept.columns, "size", mine["source_size"].alias("source_size"), mine["target"].alias("target"), (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
