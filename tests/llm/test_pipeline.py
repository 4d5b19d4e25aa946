"""The stages of the pipeline on the smallest tables, and their effect."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tidewatch.llm.storage import written  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == columns, name
        counts.append(docs.count())
        if name == "quality classifier":
            good = labels.filter("quality = 1")
            assert docs.join(good, "doc_id").count() > 0.9 * good.count()
            assert docs.join(labels.filter("quality = 0"), "doc_id").count() <= 2
        if name == "n-gram Jaccard join":
            assert docs.select("doc_id").distinct().count() == counts[-1]
    assert counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.count() == counts[4]
    assert out.filter("n_tokens <> size(ids)").count() == 0


CLASHES = ["score", "predicted", "held_out", "n_lines", "n_removed", "size", "source_size", "target", "taken", "repeats", "_time", "time", "_text", "_meta", "meta", "key", "ids", "own_score", "item", "root", "component_id"]


@pytest.mark.parametrize("empty", [True, False])
def test_stages_keep_columns_of_any_name(spark, sf, empty):
    """Whole and empty tables with nulls, repeated rows and columns named like results: columns come back with their values."""
    base = spark.read.parquet(f"{sf}/documents.parquet")
    odd = base.limit(4).withColumn("doc_id", F.lit(10**9) + F.monotonically_increasing_id() % 2)
    odd = odd.withColumn("text", F.when(F.col("doc_id") == 10**9, F.lit(None)).otherwise("")).withColumn("source", F.lit(None).cast("string"))
    docs = base.unionByName(base.limit(5)).unionByName(odd).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES}).filter(F.lit(not empty))
    docs = written(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        assert out.isEmpty() == empty and out.filter(" OR ".join(f"`{c}` IS DISTINCT FROM '{c}' || doc_id" for c in CLASHES)).isEmpty(), name
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id", "n_tokens").collect()
    assert len(coded) == docs.count() and all(r.n_tokens == 0 for r in coded if r.doc_id >= 10**9)


def test_run_decodes(spark, sf, monkeypatch):
    import hashlib

    docs = spark.createDataFrame([(1, "s", "One  two\n"), (2, "s", None), (3, "t", "one")], "doc_id long, source string, text string")
    keep = lambda spark, frame, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("kept", keep), corpus_pipeline.STAGES[-1]])
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: hashlib.sha256(x).hexdigest() for i, x in ((1, b"one</w> two</w>"), (2, b""), (3, b"one</w>"))}


def test_registered(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries().keys()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
