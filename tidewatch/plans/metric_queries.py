"""Metrics over labels with scores made from ids, and model training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import learning, metrics
from tidewatch.sources.tables import table

from .registry import Registry

register = Registry()

_SCORES = {"m1": "(doc_id * 37 % 101) / 100.0", "m2": "(doc_id * 53 % 97) / 96.0"}
_PREDICTED = "SELECT doc_id, quality AS label, m AS model, score::DOUBLE AS score, CASE WHEN score::DOUBLE >= 0.5 THEN 1 ELSE 0 END AS predicted FROM (" + " UNION ALL ".join(f"SELECT doc_id, quality, '{m}' AS m, ({s})::DOUBLE AS score FROM labels" for m, s in _SCORES.items()) + ")"
_MATRIX = f"SELECT model, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM ({_PREDICTED}) GROUP BY 1"


def _predictions(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(s).cast("double").alias("score")) for m, s in _SCORES.items()])
    df = labels.select("doc_id", F.col("quality").alias("label"), F.inline(each))
    return df.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register(_MATRIX)
def confusion_matrix(spark, sf_dir):
    """Models side by side."""
    return metrics.confusion(_predictions(spark, sf_dir), "model")


_RATES = "round(coalesce({} / nullif({}, 0), 0), 6) AS {}"
_RATE_SQL = ", ".join(_RATES.format(f"({a})::DOUBLE", b, n) for n, a, b in (("accuracy", "tp + tn", "tp + tn + fp + fn"), ("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("fpr", "fp", "fp + tn"), ("fnr", "fn", "fn + tp"), ("f1", "2 * tp", "2 * tp + fp + fn")))


def _rates(spark, sf_dir):
    return metrics.rates(metrics.confusion(_predictions(spark, sf_dir), "model"))


@register(f"SELECT model, {_RATE_SQL} FROM ({_MATRIX})")
def classification_metrics(spark, sf_dir):
    """A17, A18."""
    return _rates(spark, sf_dir).select("model", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "fpr", "fnr", "f1")])


@register(f"SELECT model, f1 FROM (SELECT model, {_RATE_SQL} FROM ({_MATRIX})) ORDER BY f1 DESC, model LIMIT 1")
def best_model(spark, sf_dir):
    """T1, M9."""
    return _rates(spark, sf_dir).select("model", F.round("f1", 6).alias("f1")).orderBy(F.desc("f1"), "model").limit(1)


@register("WITH p AS (SELECT quality AS label, (doc_id * 37 % 101) / 100.0 AS s FROM labels), r AS (SELECT label, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS mid FROM p) SELECT round((sum(CASE WHEN label = 1 THEN mid END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 6)::DOUBLE AS auc FROM r")
def roc_auc(spark, sf_dir):
    """A19."""
    one = _predictions(spark, sf_dir).filter("model = 'm1'")
    return metrics.roc_auc(one).select(F.round("auc", 6).alias("auc"))


@register(f"""WITH p AS (SELECT label, predicted FROM ({_PREDICTED}) WHERE model = 'm1'), c AS (SELECT unnest([0, 1]) AS k),
 e AS (SELECT k::VARCHAR AS class, coalesce(count(*) FILTER (label = k AND predicted = k)::DOUBLE / nullif(count(*) FILTER (predicted = k), 0), 0) AS precision, coalesce(count(*) FILTER (label = k AND predicted = k)::DOUBLE / nullif(count(*) FILTER (label = k), 0), 0) AS recall,
 coalesce(2.0::DOUBLE * count(*) FILTER (label = k AND predicted = k) / nullif(count(*) FILTER (label = k) + count(*) FILTER (predicted = k), 0), 0) AS f1, count(*) FILTER (label = k) AS support FROM p, c GROUP BY k)
 SELECT class, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1, support::BIGINT AS support FROM (SELECT * FROM e UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM e UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM e)""")
def classification_report(spark, sf_dir):
    """A20."""
    out = metrics.report(_predictions(spark, sf_dir).filter("model = 'm1'"))
    return out.select("class", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("SELECT doc_id, " + ", ".join(f"CASE WHEN lang = '{v}' THEN 1 ELSE 0 END::BIGINT AS lang_{v}" for v in ("de", "en", "es", "fr")) + " FROM documents")
def one_hot(spark, sf_dir):
    """M1: a column a level; the levels are read from the data."""
    return learning.one_hot(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang")


@register("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR)) AS n, count(*) OVER (PARTITION BY quality) AS m FROM labels)
 SELECT doc_id, quality::BIGINT AS quality, n > floor(m * 0.75) AS is_test FROM r""")
def stratified_split(spark, sf_dir):
    """M2: by hash order within each class; no class is one task."""
    return learning.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.75)


# Fixed values that results depend on: the label map of events, 1 for what counts as bad.
_TARGETS = {"click": 0, "error": 1, "purchase": 0, "signup": 0, "view": 0}


@register("SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 0 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 WHEN 'view' THEN 0 END::BIGINT AS target FROM events")
def binary_target(spark, sf_dir):
    """A fixed label map; labels that it lacks are an error that names them sorted."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return learning.binary_target(events, "event_type", [k for k, v in _TARGETS.items() if v], list(_TARGETS)).select("event_id", "target")


@register()
def generalization(spark, sf_dir):
    """M3 to M5 without the balanced baselines, M6, M8, A21: three models on embeddings, scored on every split. Fitted numbers depend on the library, so there is no SQL."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("label"))
    return learning.generalization(df, "embedding", "label", {"train": F.col("vec_id") % 4 < 2, "test": F.col("vec_id") % 4 == 2, "late": F.col("vec_id") % 4 == 3}, "train")
