"""documents to token ids in five stages, each an operator of tidewatch.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
applies them in turn, each written as Parquet in the shared folder and read again, so a lost executor costs no more
than the stage at hand. SQL can't express the classifier, the fuzzy lines or BPE, so ORACLE_SQL is None; the stages
are tested against brute force.

Every stage gives back all columns of its input, also those that have a name which its operator uses for a result
(score, size, taken and so on), and an empty table for an empty one. Null and empty texts are scored as any other by
the classifier, have no lines and no shingles, are taken 0 times by the mix, and have no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe
from tidewatch.llm.jaccard import one_of_each_group
from tidewatch.llm.lines import without_repeated_lines
from tidewatch.llm.mixing import mixed
from tidewatch.llm.quality_model import quality_scores
from tidewatch.llm.queries import tokenizer_path
from tidewatch.llm.storage import free_names, set_aside, small_batches, text_key, written


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    plain, own = set_aside(docs, "held_out", "score", "predicted")
    return quality_scores(plain, labels, keep=True).filter("predicted = 1").select(*plain.columns).withColumnsRenamed(own)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which they were all. n_chars follows the text."""
    small_batches(spark)
    plain, own = set_aside(docs, "n_lines", "n_removed")
    out = without_repeated_lines(plain, figures=True)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes).get("n_chars", "long")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(*plain.columns).withColumnsRenamed(own)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, 0.8)."""
    small_batches(spark)
    return one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time."""
    small_batches(spark)
    plain, own = set_aside(docs, "size", "source_size", "target", "taken", "repeats")
    (time,) = free_names(plain, "time")
    taken = mixed(plain).filter("repeats > 0").withColumn(time, F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return taken.select(*plain.columns).withColumnsRenamed(own)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str, decode: bool = False) -> DataFrame:
    """(doc_id, source, n_tokens, ids), and with decode decoded_sha256 of the text that the ids decode to. The vocabulary lowers letters and has no decoder, so that is not the text itself."""
    small_batches(spark)
    path = tokenizer_path()
    coded = bpe.encode_texts(docs, path).select("key", "ids")
    more = []
    if decode:
        coded = bpe.decode(coded, path).select("key", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
        more = ["decoded_sha256"]
    met = docs.select("doc_id", "source", text_key().alias("key")).join(coded, "key")
    return met.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", *more)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return encode_texts(spark, docs, sf_dir, decode=True)
