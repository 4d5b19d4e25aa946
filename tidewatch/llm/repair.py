"""Conversation structure repair: the lightest derivation of a well-formed conversation, by Knuth's agenda.

A repair is a derivation over weighted items. prefix(i, q) says: the first i rows are repaired and the last role stands
at q (nothing yet, after system, after user, after assistant). From it and an edit of row i follows prefix(i + 1, q'), from it and an
Insert prefix(i, q'). A weight is (cost, audit): costs add, audits (the edits' initials) are joined. Both orders make
superior functions: a conclusion is never lighter than a premise, and a lighter premise never makes a heavier
conclusion (two audits of one item and one cost are never prefixes of each other, as what follows could only be
Inserts, which cost). So the agenda, popped by weight, finalises each item at its lightest derivation and stops at the goal.

A long conversation is cut: span(q, r) of a run of rows is its lightest derivation from q to r, found by the same agenda
from each q, and prefix(., q) with span(q, r) gives prefix(., r). Runs are rows of the same turn // TURNS, dealt out
each on its own, and within them blocks of ROWS rows. Only one letter a row (and four audits a run) meets where a
conversation's runs are put together. Texts are shuffled once, beside the finished audits.

Nulls: a null role or text is one space (a space is no role's initial and makes a text blank); null turns come first
and make no gap; a null id is a conversation of its own. Rows of equal turn go by role, then by the md5 of role and
text, so the order never hangs on partitions. An id all of whose rows were dropped has an empty audit and no rows.
Repeated rows are duplicates. Empty tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import lean, written

#: Turn numbers of a run, a power of two, and rows of a block within it.
TURNS, ROWS = 1024, 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Where the last role stands: nothing yet, after system, user, assistant; and what comes next there.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
_NEXT = {START: "u", AFTER_S: "u", AFTER_U: "a", AFTER_A: "u"}
_AFTER = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}
_ROLE = {"u": "user", "a": "assistant"}
_LEGAL = ("su", "ua", "au")
_SPACE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]
Item = tuple[int, int]


def lightest(axioms: dict[Item, Weight], conclusions: Callable[[Item], Iterable[tuple[Item, Weight]]], goals: set[Item], all_goals: bool = False) -> dict[Item, Weight]:
    """The finalised items with their lightest weights, until a goal (or all that can be derived) is among them.

    conclusions(item): what follows from it and one more premise, with that premise's weight.
    """
    agenda = [(*weight, item) for item, weight in axioms.items()]
    heapq.heapify(agenda)
    chart: dict[Item, Weight] = {}
    found: dict[Item, Weight] = dict(axioms)
    open_goals = set(goals)
    while agenda:
        cost, audit, item = heapq.heappop(agenda)
        if item in chart:
            continue
        chart[item] = cost, audit
        if item in open_goals:
            open_goals.discard(item)
            if not all_goals or not open_goals:
                break
        for other, (more, edit) in conclusions(item):
            if other not in chart:
                weight = cost + more, audit + edit
                if other not in found or weight < found[other]:
                    found[other] = weight
                    heapq.heappush(agenda, (*weight, other))
    return chart


def _edits(letters: str, faults: str) -> Callable[[Item], Iterator[tuple[Item, Weight]]]:
    """What follows from prefix(i, q). letters: s, u, a or o (other) for each row; faults: b(lank), d(uplicate), t(runcated) or - (none)."""

    def conclusions(item: Item) -> Iterator[tuple[Item, Weight]]:
        i, q = item
        role = _NEXT[q]
        yield (i, _AFTER[role]), (INSERT, "I")
        if i == len(letters):
            return
        yield (i + 1, q), (DELETE, "D")
        if faults[i] in "bd":
            return
        more = TRUNCATED * (faults[i] == "t")
        yield (i + 1, _AFTER[role]), (REROLE + more, "R")
        if letters[i] == role or letters[i] == "s" and q == START:
            yield (i + 1, _AFTER[letters[i]]), (KEEP + more, "K")

    return conclusions


Spans = dict[int, dict[int, Weight]]


def spans(letters: str, faults: str, entries: Iterable[int] = range(4)) -> Spans:
    """{q: {r: weight}}: the lightest derivations over all rows from q to each r that can be reached."""
    out: Spans = {q: {q: (0, "")} for q in entries}
    for at in range(0, max(1, len(letters)), ROWS):
        part = letters[at : at + ROWS], faults[at : at + ROWS]
        n, block = len(part[0]), {}
        for q, there in out.items():
            for mid in there:
                if mid not in block:
                    chart = lightest({(0, mid): (0, "")}, _edits(*part), {(n, r) for r in range(4)}, all_goals=True)
                    block[mid] = {r: chart[n, r] for r in range(4) if (n, r) in chart}
            out[q] = _extended(there, block)[0]
    return out


def _extended(prefixes: dict[int, Weight], block: Spans) -> tuple[dict[int, Weight], dict[int, tuple[int, str]]]:
    """prefix(., q) and span(q, r) give prefix(., r); and of each r the q and the audit of the span that made it."""
    out: dict[int, Weight] = {}
    made: dict[int, tuple[int, str]] = {}
    for q, (cost, audit) in prefixes.items():
        for r, (more, edits) in block[q].items():
            weight = cost + more, audit + edits
            if r not in out or weight < out[r]:
                out[r], made[r] = weight, (q, edits)
    return out, made


def repaired_letters(letters: str, faults: str) -> Weight:
    """(cost, audit) of a whole conversation's cheapest edits."""
    if len(letters) <= ROWS:
        n = len(letters)
        goals = {(n, START), (n, AFTER_A)}
        chart = lightest({(0, START): (0, "")}, _edits(letters, faults), goals)
        return next(chart[g] for g in goals if g in chart)
    ends = spans(letters, faults, [START])[START]
    return min(ends[r] for r in (START, AFTER_A) if r in ends)


def put_together(runs: list[Spans]) -> tuple[int, list[str]]:
    """The cost of a conversation's cheapest edits and the audit of each run, from the spans of its runs."""
    prefixes: dict[int, Weight] = {START: (0, "")}
    back = []
    for run in runs:
        prefixes, made = _extended(prefixes, run)
        back.append(made)
        same = len(commonprefix([a for _, a in prefixes.values()]))  # what all audits share decides nothing any more
        prefixes = {r: (c, a[same:]) for r, (c, a) in prefixes.items()}
    at = min((r for r in (START, AFTER_A) if r in prefixes), key=lambda r: prefixes[r])
    cost, audits = prefixes[at][0], []
    for made in reversed(back):
        at, audit = made[at]
        audits.append(audit)
    return cost, audits[::-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): rows after the damage that crc32(conv_id:turn) % 20 picks; a dropped row stays with present false."""
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    as_text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    c = c.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), (kind == 3).alias("twice"))
    return c.withColumn("time", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "time")


def _placed(rows: DataFrame) -> DataFrame:
    """rows with the run they are in and a key of role and text."""
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.withColumns({"run": F.shiftright("turn", TURNS.bit_length() - 1), "key": key})


def _runs(rows: DataFrame, id_type: str) -> DataFrame:
    """(conv_id, run, letters, faults, first_turn, last_turn, turns): a row for each run, with a letter for each row of it.

    That role and text came in an earlier run of the conversation is told by a mark that goes before the rows of its key.
    """
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    facts = _placed(rows).select("conv_id", "run", "turn", "role", "key", "present", F.substring("role", 1, 1).alias("initial"), last.alias("last"), F.lit(1).alias("kind"))
    facts = facts.withColumn("key", F.when(F.col("present"), F.col("key")))
    often = facts.filter("present AND last <> ''").groupBy("conv_id", "key").agg(F.sort_array(F.collect_set(F.coalesce("run", F.lit(-(1 << 62))))).alias("runs")).filter("size(runs) > 1")
    marks = often.select("conv_id", F.explode(F.expr("slice(runs, 2, size(runs) - 1)")).alias("run"), "key", F.lit(0).alias("kind"))
    both = facts.unionByName(marks, allowMissingColumns=True).repartition("conv_id", "run")
    seen = F.row_number().over(Window.partitionBy("conv_id", "run", "key").orderBy("kind"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    fault = F.when(F.col("last") == "", "b").when(F.col("seen") > 1, "d").when(~F.col("last").isin(".", "!", "?"), "t").otherwise("-")
    told = both.withColumn("seen", seen).filter("kind = 1").sortWithinPartitions("conv_id", "run", "turn", "role", "key")
    told = told.select("conv_id", "run", "turn", F.when(F.col("present"), letter).otherwise("").alias("letter"), F.when(F.col("present"), fault).otherwise("").alias("fault"))

    arrow_id = pa_id(rows, "conv_id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out = []
        for (conv, run), mine in groupby(rows, key=lambda r: r[:2]):
            letters, faults, first, turns, now = [], [], None, 0, None
            for _, _, turn, letter, fault in mine:
                if letter:
                    letters.append(letter)
                    faults.append(fault)
                    if turn is not None and turn != now:
                        first, now, turns = turn if first is None else first, turn, turns + 1
            out.append((conv, run, "".join(letters), "".join(faults), first, now, turns))
            if len(out) == 1000:
                yield _batch(out, _RUN, arrow_id)
                out = []
        if out:
            yield _batch(out, _RUN, arrow_id)

    return told.mapInArrow(lean(gather), f"conv_id {id_type}, {_RUN_SQL}")


_RUN = [("run", pa.int64()), ("letters", pa.string()), ("faults", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64())]
_RUN_SQL = "run long, letters string, faults string, first_turn long, last_turn long, turns long"
_SPAN_SQL = "spans array<struct<q: int, r: int, cost: long, audit: string>>"
_SPAN = pa.list_(pa.struct([("q", pa.int32()), ("r", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PLAN = [("run", pa.int64()), ("entry", pa.int32()), ("audit", pa.string()), ("whole", pa.struct([(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]))]
_PLAN_SQL = "run long, entry int, audit string, whole struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>"


def pa_id(frame: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(frame.schema[name].dataType)


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]], id_type: pa.DataType) -> pa.RecordBatch:
    columns = [("conv_id", id_type), *columns]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], [name for name, _ in columns])


def plans(conversations: DataFrame) -> DataFrame:
    """(conv_id, run, entry, audit, whole): the edits of each run of each conversation and, with its last run, what holds for all of it. A written table.

    entry: where the last role stands before the run. whole: gaps, blank, duplicate, truncated, illegal, cost, audit.
    """
    rows = damaged(conversations)
    id_type, arrow_id = rows.schema["conv_id"].dataType.simpleString(), pa_id(rows, "conv_id")
    runs = written(_runs(rows, id_type)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"q": q, "r": r, "cost": c, "audit": a} for q, to in spans(x, y).items() for r, (c, a) in to.items()] for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _SPAN)], [*batch.schema.names, "spans"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)), []
        for conv, mine in groupby(rows, key=lambda r: r[0]):
            held, turns, first, last, before = [], 0, None, None, ""
            counts = dict.fromkeys("bdt", 0)
            illegal = 0
            for _, run, letters, faults, low, high, n, *found in mine:
                for k in counts:
                    counts[k] += faults.count(k)
                turns, last = turns + n, last if high is None else high
                first = low if first is None else first
                line = before + letters
                illegal += sum(line[i : i + 2] not in _LEGAL for i in range(len(line) - 1))
                before = line[-1:]
                held.append((run, letters, faults, found[0] if found else None))
            if len(held) == 1 and held[0][3] is None:
                cost, audit = repaired_letters(*held[0][1:3])
                audits = [audit]
            else:
                cost, audits = put_together([_spans_of(h[3]) for h in held])
            gaps = 0 if first is None else last - first + 1 - turns
            q = START
            for i, ((run, *_), audit) in enumerate(zip(held, audits, strict=True)):
                done = {"gaps": gaps, "blank": counts["b"], "duplicate": counts["d"], "truncated": counts["t"], "illegal": illegal, "cost": cost, "audit": "".join(audits)} if i == len(held) - 1 else None
                out.append((conv, run, q, audit, done))
                if len(held) > 1:
                    for edit, letter in _letters_after(held[i][1], audit):
                        q = _stand(q, edit, letter)
                if len(out) >= 1000:
                    yield _batch(out, _PLAN, arrow_id)
                    out = []
        if out:
            yield _batch(out, _PLAN, arrow_id)

    names = ["conv_id", *(n for n, _ in _RUN)]
    alone = runs.filter("n = 1").select(*names).mapInArrow(lean(whole), f"conv_id {id_type}, {_PLAN_SQL}")
    many = runs.filter("n > 1").select(*names).repartition("conv_id", "run").mapInArrow(lean(spanned), f"conv_id {id_type}, {_RUN_SQL}, {_SPAN_SQL}")
    many = many.repartition("conv_id").sortWithinPartitions("conv_id", "run").mapInArrow(lean(whole), f"conv_id {id_type}, {_PLAN_SQL}")
    return written(alone.union(many))


def _spans_of(found: list[dict]) -> Spans:
    out: Spans = {q: {} for q in range(4)}
    for s in found:
        out[s["q"]][s["r"]] = s["cost"], s["audit"]
    return out


def _letters_after(letters: str, audit: str) -> Iterator[tuple[str, str]]:
    at = iter(letters)
    return ((edit, "" if edit == "I" else next(at)) for edit in audit)


def _stand(q: int, edit: str, letter: str) -> int:
    """Where the last role stands after an edit."""
    if edit == "D":
        return q
    return _AFTER[letter if edit == "K" else _NEXT[q]]


def _edited(conversations: DataFrame, plan: DataFrame, *together: str) -> DataFrame:
    """The present damaged rows, and before those of each run its audit; runs in order within `together`, which are in one task."""
    rows = _placed(damaged(conversations)).filter("present").select("conv_id", "run", F.lit(1).alias("kind"), "turn", "role", "key", "text")
    heads = plan.select("conv_id", "run", F.lit(0).alias("kind"), F.col("entry").cast("long").alias("turn"), F.col("audit").alias("role"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"))
    return rows.union(heads).repartition(*together).sortWithinPartitions("conv_id", "run", "kind", "turn", "role", "key").select("conv_id", "run", "kind", "turn", "role", "text")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, run, edit, role, text) of each edit in order; a run's first has edit ''."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for (conv, run), mine in groupby(rows, key=lambda r: r[:2]):
        q, audit = START, ""
        for _, _, kind, turn, role, text in mine:
            if not kind:
                q, audit, at = turn, role, 0
                yield conv, run, "", None, None
                continue
            while audit[at] == "I":
                letter = _NEXT[q]
                yield conv, run, "I", _ROLE[letter], ""
                q, at = _AFTER[letter], at + 1
            edit, at = audit[at], at + 1
            if edit == "D":
                yield conv, run, edit, role, text
                continue
            letter = role[:1] if edit == "K" else _NEXT[q]
            yield conv, run, edit, role if edit == "K" else _ROLE[letter], text
            q = _AFTER[letter]
        for _ in audit[at:]:
            yield conv, run, "I", _ROLE[_NEXT[q]], ""
            q = _AFTER[_NEXT[q]]


def repaired_turns(conversations: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, run, place, edit, role, text): the repaired rows; ordered by run (null first), then place. Each run is dealt out on its own."""
    arrow_id = pa_id(conversations, "conv_id")
    columns = [("run", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place, size = [], 0, 0
        for conv, run, edit, role, text in _steps(batches):
            place = place + 1 if edit else 0
            if edit not in ("", "D"):
                out.append((conv, run, place, edit, role, text))
                size += len(text)
                if len(out) == 1000 or size > 1 << 22:
                    yield _batch(out, columns, arrow_id)
                    out, size = [], 0
        if out:
            yield _batch(out, columns, arrow_id)

    schema = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, run long, place long, edit string, role string, text string"
    return _edited(conversations, plan, "conv_id", "run").mapInArrow(lean(write), schema)


def repaired_digests(conversations: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of role:text of the repaired rows, joined by newlines.

    A digest takes its bytes in order, so a conversation's texts pass through one task, as a stream of which a row is held at a time.
    """
    arrow_id = pa_id(conversations, "conv_id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, steps in groupby(_steps(batches), key=lambda s: s[0]):
            sha, first = hashlib.sha256(), True
            for _, _, edit, role, text in steps:
                if edit not in ("", "D"):
                    sha.update(f"{'' if first else '\n'}{role}:{text}".encode())
                    first = False
            out.append((conv, sha.hexdigest()))
            if len(out) == 1000:
                yield _batch(out, [("repaired_sha256", pa.string())], arrow_id)
                out = []
        if out:
            yield _batch(out, [("repaired_sha256", pa.string())], arrow_id)

    return _edited(conversations, plan, "conv_id").mapInArrow(lean(digest), f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def repairs(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost (long), audit, repaired_sha256."""
    plan = plans(conversations)
    whole = plan.filter("whole IS NOT NULL").select("conv_id", "whole.*")
    digests = repaired_digests(conversations, plan).withColumnRenamed("conv_id", "_id")
    return whole.join(digests, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
