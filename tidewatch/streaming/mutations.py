"""Operators that work alike on batch and streaming frames of mutation events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on: fields whose changes matter, and attributes of them.
FIELD_TAGS = ["form", "input", "select", "textarea"]
FIELD_ATTRIBUTES = ["type", "action", "autocomplete", "method", "src", "name", "id"]


def relevant(events: DataFrame) -> DataFrame:
    """Added subtrees with a form field, removed form fields, changed attributes of them."""
    field = F.lower("node_tag").isin(FIELD_TAGS)
    nodes = (F.col("kind") == "childList") & (field | (~F.col("removed") & F.col("contains_form_field")))
    return events.filter(nodes | ((F.col("kind") == "attributes") & F.lower("attribute_name").isin(FIELD_ATTRIBUTES)))


def debounced(events: DataFrame, gap: str = "80 milliseconds", late: str | None = None) -> DataFrame:
    """(page_id, first_ts, fire_ts, events): a row for each run of events with no gap over `gap`, fired `gap` after its last event. Streams need `late`, how late events may come."""
    if events.isStreaming:
        events = events.withWatermark("ts", late or gap)
    window = F.session_window("ts", gap)
    return events.groupBy("page_id", window.alias("w")).agg(F.count(F.lit(1)).alias("events")).select("page_id", F.col("w.start").alias("first_ts"), F.col("w.end").alias("fire_ts"), "events")


def latest_state(events: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The last value of each key by event time; on a stream run it in complete or update mode."""
    return events.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def ingest(bodies: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs each micro-batch of (key, body) through the observation gate into sink; failures of a batch stop the query, which then goes on from its checkpoint."""
    from tidewatch.operators.store import observations
    from tidewatch.sources.tables import payloads

    return bodies.writeStream.foreachBatch(lambda df, n: sink(observations(payloads(df), "key"), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Fixed values that results depend on: what makes a page collect evidence while it loads.
LOADING = ["document_start", "DOMContentLoaded", "load"]


def collection_cycles(loads: DataFrame, loading: str = "loading") -> DataFrame:
    """A row for each collection of a page load, with trigger: the first at once, and two more where the document was still loading. Each is scored and completes on its own."""
    triggers = F.when(F.coalesce(F.col(loading), F.lit(False)), F.array(*map(F.lit, LOADING))).otherwise(F.array(F.lit(LOADING[0])))
    return loads.select("*", F.posexplode(triggers).alias("cycle", "trigger"))


def in_completion_order(started: DataFrame, key: str, time: str, completed: str, value: str, late: str = "1 minute") -> DataFrame:
    """A stream of started work to (key, completed, value) as it completes, whatever the order it was started in.

    Work waits in the state of its key until the watermark of its start times passes its completion; a timer wakes the
    key then. State is the work under way and goes as it completes. key: long, value: long or text.
    """
    kinds = dict(started.dtypes)

    def run(name, frames, state):
        waiting = list(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for frame in frames:
                waiting += [f"{c.value // 1000:020d} {v}" for c, v in zip(frame[completed], frame[value], strict=True)]
        now = state.getCurrentWatermarkMs()
        waiting.sort()
        done = [w.split(" ", 1) for w in waiting if int(w[:20]) <= now * 1000]
        waiting = waiting[len(done) :]
        if waiting:
            state.update((waiting,))
            state.setTimeoutTimestamp(max(now + 1, -(-int(waiting[0][:20]) // 1000)))
        elif state.exists:
            state.remove()
        if done:
            values = pd.Series([v for _, v in done]).astype("int64" if kinds[value] == "bigint" else "object")
            yield pd.DataFrame({key: [name[0]] * len(done), completed: pd.to_datetime([int(c) for c, _ in done], unit="us"), value: values})

    import pandas as pd

    timed = started.withWatermark(time, late).select(key, time, completed, value)
    return timed.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {completed} timestamp, {value} {kinds[value]}", "waiting array<string>", "append", "EventTimeTimeout")


def switched(arrivals: DataFrame, key: str, time: str, change: str) -> DataFrame:
    """A stream of rows of which some switch their key on or off (change: true or false, null for the others) to the others, with ready: how the switch stood when they arrived.

    Within a micro-batch rows count by time; a key starts switched off. The state of a key is its switch.
    """
    import pandas as pd

    names = [c for c in arrivals.columns if c != change]

    def run(_, frames, state):
        ready = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        stands = []
        for turned in rows[change]:
            ready = ready if pd.isna(turned) else bool(turned)
            stands.append(ready)
        state.update((ready,))
        rows["ready"] = stands
        yield rows[rows[change].isna()][[*names, "ready"]]

    kinds = dict(arrivals.dtypes)
    return arrivals.groupBy(key).applyInPandasWithState(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", ready boolean", "ready boolean", "append", "NoTimeout")
