"""Event streams: relevance, debouncing, latest state. The batch form of each streaming operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import asof, decisions
from tidewatch.sources.tables import table
from tidewatch.streaming import mutations

from .registry import Registry

register = Registry()


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT user_id, min(ts) AS first_ts, max(ts) + INTERVAL 30 MINUTE AS fire_ts, count(*) AS events FROM s GROUP BY user_id, n""")
def debounce_sessions(spark, sf_dir):
    """One collection a quiet gap."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), "ts")
    return mutations.debounced(events, "30 minutes").withColumnRenamed("page_id", "user_id")


_KIND = {"kind": "CASE event_id % 3 WHEN 0 THEN 'attributes' ELSE 'childList' END", "node_tag": "CASE event_id % 5 WHEN 0 THEN 'FORM' WHEN 1 THEN 'div' WHEN 2 THEN 'input' ELSE 'p' END", "contains_form_field": "event_id % 7 = 0", "removed": "event_id % 4 = 0", "attribute_name": "CASE event_id % 6 WHEN 0 THEN 'Action' ELSE 'class' END"}


@register("SELECT event_id FROM (SELECT event_id, " + ", ".join(f"{v} AS {k}" for k, v in _KIND.items()) + " FROM events) WHERE (kind = 'attributes' AND lower(attribute_name) IN ('type', 'action', 'autocomplete', 'method', 'src', 'name', 'id')) OR (kind = 'childList' AND (lower(node_tag) IN ('form', 'input', 'select', 'textarea') OR (NOT removed AND contains_form_field)))")
def relevance_filter(spark, sf_dir):
    """Mutations that touch form fields."""
    events = table(spark, sf_dir, "events").selectExpr("event_id", *[f"{v} AS {k}" for k, v in _KIND.items()])
    return mutations.relevant(events).select("event_id")


@register("SELECT event_type, count(*) AS n, max(ts) AS last_ts FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1")
def message_routing(spark, sf_dir):
    """Routes by type."""
    return table(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click", "purchase")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"))


@register("""WITH c AS (SELECT user_id, ts, arg_max(event_type = 'signup', event_id) AS ready FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2),
 s AS (SELECT e.event_id, coalesce(c.ready, false) AS ready, value > 20 AS pw, event_type = 'view' AS otp, value < 5 AS xd FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts WHERE event_type IN ('view', 'click', 'purchase'))
 SELECT event_id, CASE WHEN ready THEN 'model' ELSE 'fallback' END AS runtime, round(CASE WHEN ready THEN (CASE WHEN pw THEN 0.4 ELSE 0 END + CASE WHEN otp THEN 0.3 ELSE 0 END + CASE WHEN xd THEN 0.3 ELSE 0 END)::DOUBLE
  ELSE least((CASE WHEN pw THEN 0.35 ELSE 0 END + CASE WHEN otp THEN 0.25 ELSE 0 END + CASE WHEN xd THEN 0.35 ELSE 0 END)::DOUBLE, 0.99) END, 6) AS score FROM s""")
def scorer_switch(spark, sf_dir):
    """Evidence is scored by the model if that is ready when it arrives, else by the rule. Sign-ups make a user's model ready, errors end that."""
    events = table(spark, sf_dir, "events")
    changes = events.filter(F.col("event_type").isin("signup", "error")).select("user_id", "ts", "event_id", (F.col("event_type") == "signup").alias("ready"))
    arrived = events.filter(F.col("event_type").isin("view", "click", "purchase"))
    met = asof.as_of(arrived, changes, "user_id", "ts", ["ready"], ["event_id"]).withColumn("ready", F.coalesce("ready", F.lit(False)))
    flags = F.col("value") > 20, F.col("event_type") == "view", F.col("value") < 5
    score = F.when(F.col("ready"), decisions.SCORERS["model"](*flags)).otherwise(decisions.SCORERS["fallback"](*flags))
    return met.select("event_id", F.when(F.col("ready"), "model").otherwise("fallback").alias("runtime"), F.round(score, 6).alias("score"))


@register("""WITH c AS (SELECT user_id, event_id, ts, value, unnest(range(CASE WHEN value < 25 THEN 3 ELSE 1 END)) AS cycle FROM events WHERE event_type IN ('view', 'purchase')),
 d AS (SELECT user_id, ts + to_minutes(CAST(floor(value * (cycle + 1) * 7) AS BIGINT) % 6000) AS done, event_id, cycle FROM c),
 l AS (SELECT user_id, done, max({'event_id': event_id, 'cycle': cycle}) AS decision FROM d GROUP BY 1, 2)
 SELECT e.event_id, l.decision.event_id AS decision_id, ['document_start', 'DOMContentLoaded', 'load'][l.decision.cycle + 1] AS trigger FROM events e ASOF LEFT JOIN l ON e.user_id = l.user_id AND e.ts >= l.done WHERE e.event_type = 'click'""")
def latest_completed(spark, sf_dir):
    """What a click is told is the decision completed last, not the one started last; pages that still load collect three times."""
    events = table(spark, sf_dir, "events")
    cycles = mutations.collection_cycles(events.filter(F.col("event_type").isin("view", "purchase")).withColumn("loading", F.col("value") < 25))
    took = F.expr("make_dt_interval(0, 0, CAST(floor(value * (cycle + 1) * 7) % 6000 AS INT), 0)")
    done = cycles.select("user_id", (F.col("ts") + took).alias("ts"), F.col("event_id").alias("decision_id"), "cycle", "trigger")
    asks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof.as_of(asks, done, "user_id", "ts", ["decision_id", "trigger"], ["decision_id", "cycle"]).select("event_id", "decision_id", "trigger")
