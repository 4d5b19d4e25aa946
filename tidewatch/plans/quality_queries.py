"""Audits, splits and leakage over labels, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.operators import quality
from tidewatch.sources.tables import table

from .registry import Registry

register = Registry()

_ROWS = "SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN '' ELSE d.lang END AS lang, d.source, md5(d.text) AS digest, l.quality, l.toxic, d.text FROM documents d LEFT JOIN labels l USING (doc_id)"


def _rows(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("lang")).alias("lang"), "source", F.md5(F.col("text").cast("binary")).alias("digest"), "quality", "toxic", "text")


@register(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS nulls FROM ({_ROWS}) WHERE {c} IS NULL OR {c}::VARCHAR = '' HAVING count(*) > 0" for c in ("lang", "source", "quality", "toxic")))
def null_counts(spark, sf_dir):
    """A5, P8."""
    return quality.null_counts(_rows(spark, sf_dir), ["lang", "source", "quality", "toxic"])


@register("SELECT md5(text) AS digest, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """A4: texts that more than one document has."""
    return quality.duplicates(table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest")), "digest")


@register("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_distribution(spark, sf_dir):
    """A1, A3."""
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs, count(DISTINCT source) AS n_sources FROM documents")
def distinct_sources(spark, sf_dir):
    """A6, A7, U1."""
    docs = table(spark, sf_dir, "documents")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.coalesce(c, F.lit("")))), ",")
    return docs.agg(joined("source").alias("sources"), joined("lang").alias("langs"), F.count_distinct("source").alias("n_sources"))


@register("SELECT count(*) AS total, count(DISTINCT doc_id) AS keys, count(DISTINCT digest) AS texts, count(*) FILTER (quality = 0) AS label_0, count(*) FILTER (quality = 1) AS label_1, CASE WHEN count(DISTINCT doc_id) = count(*) AND count(DISTINCT digest) = count(*) AND count(*) FILTER (quality = 0) > 0 AND count(*) FILTER (quality = 1) > 0 THEN 'PASS' ELSE 'FAIL' END AS audit_status FROM (" + _ROWS + ")")
def audit_verdict(spark, sf_dir):
    """A8."""
    return quality.audit_verdict(_rows(spark, sf_dir), "doc_id", "digest", "quality", (0, 1))


_RULES = {"train": "doc_id % 10 < 5", "validation": "doc_id % 10 IN (5, 6)", "test": "doc_id % 10 > 6", "late": "doc_id >= 500", "hard": "source IN ('src0', 'src1')"}


@register(" UNION ALL ".join(f"SELECT '{n}' AS split, count(*) AS sample_count, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM ({_ROWS}) WHERE quality IS NOT NULL AND {r} HAVING count(*) > 0" for n, r in _RULES.items()))
def split_manifest(spark, sf_dir):
    """Overlapping splits."""
    rows = quality.with_splits(_rows(spark, sf_dir).filter("quality IS NOT NULL"), {n: F.expr(r) for n, r in _RULES.items()})
    return quality.split_manifest(rows, "quality", {"good": 1, "bad": 0})


_HOST = "lower(regexp_replace(regexp_extract(url, '//([^/?#]*)', 1), ':[0-9]*$', ''))"


def _hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@register(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT page_id, host FROM h WHERE page_id % 10 > 6 AND host NOT IN (SELECT host FROM h WHERE page_id % 10 <= 1)")
def unseen_domain_anti(spark, sf_dir):
    """Test pages of hosts that no training page has."""
    h = _hosts(spark, sf_dir)
    return quality.unseen(h.filter("page_id % 10 > 6"), h.filter("page_id % 10 <= 1"), "host").select("page_id", "host")


@register(f"WITH h AS (SELECT page_id, {_HOST} AS host FROM pages) SELECT DISTINCT host FROM h WHERE page_id % 10 > 6 AND host IN (SELECT host FROM h WHERE page_id % 10 <= 6)")
def leakage_semi(spark, sf_dir):
    """Hosts on both sides of the split."""
    h = _hosts(spark, sf_dir)
    return quality.leakage(h.filter("page_id % 10 <= 6"), h.filter("page_id % 10 > 6"), "host")
