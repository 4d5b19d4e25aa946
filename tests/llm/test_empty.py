"""Every operator on empty tables."""

import pytest

pytest.importorskip("tidewatch.llm")
from tidewatch.llm import bpe, fingerprints, jaccard, lines, mixing, quality_model, queries, repetition, style_tree, substrings, toxicity  # noqa: E402


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = queries.tokenizer_path()
    results = [
        style_tree.main_text(spark.createDataFrame([], "page_id long, url string, html string")),
        mixing.mixed(docs),
        toxicity.toxic_passages(docs, labels),
        bpe.decode(bpe.encode(docs, path), path),
        substrings.substring_dedup(docs),
        jaccard.one_of_each_group(docs),
        repetition.quality_rules(docs),
        fingerprints.edit_response(docs),
        fingerprints.fingerprints(docs),
        fingerprints.near_classes(docs),
        quality_model.quality_scores(docs, labels),
        lines.without_repeated_lines(docs),
    ]
    assert all(r.collect() == [] for r in results)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.quality_scores(docs, labels).collect()} == {0.5}
    assert all(r.score < 0.01 for r in toxicity.toxic_passages(docs, labels).collect())
