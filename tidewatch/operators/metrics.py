"""Classification metrics over predictions (label 0/1, predicted 0/1, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, *by: str, label: str = "label", predicted: str = "predicted") -> DataFrame:
    cell = lambda y, p: F.count_if((F.col(label) == y) & (F.col(predicted) == p))
    return df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def rates(matrix: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1, fpr and fnr of confusion() rows; 0 where a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = matrix.withColumns({"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "fpr": _ratio(fp, fp + tn), "fnr": _ratio(fn, fn + tp)})
    return out.withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", ranges: int = 1024, predicted: str = "predicted") -> DataFrame:
    """One row (auc) by mid-ranks; with a single class 1 if every prediction is right (scores of 0.5 and more, without a column of predictions), else 0.5.

    Scores lie in 0 to 1. Rows are first counted by score; ranks are summed up inside `ranges` ranges of scores, and
    across ranges over at most that many rows.
    """
    right = (F.col(predicted) if predicted in df.columns else (F.col(score) >= 0.5).cast("int")) == F.col(label)
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(~right).alias("wrong"), F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    counts = counts.withColumn("range", F.least(F.floor(F.col("s") * ranges), F.lit(ranges - 1)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.groupBy("range").agg(F.sum("neg").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("within", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(below), "range")
    won = F.sum(F.col("pos") * (F.col("below") + F.col("within") + F.col("neg") / 2))
    total = ranked.agg(won.alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum("wrong").alias("wrong"))
    return total.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).when(F.col("wrong") == 0, 1.0).otherwise(0.5).alias("auc"))


def report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """A row for each class (precision, recall, f1, support), then macro avg and weighted avg."""
    both = df.select(F.explode(F.array(F.struct(F.col(label).cast("string").alias("class"), F.lit(1).alias("s"), F.lit(0).alias("q")), F.struct(F.col(predicted).cast("string").alias("class"), F.lit(0).alias("s"), F.lit(1).alias("q")))).alias("x"), (F.col(label) == F.col(predicted)).cast("int").alias("hit"))
    each = both.groupBy(F.col("x.class").alias("class")).agg(F.sum(F.col("hit") * F.col("x.s")).alias("hits"), F.sum("x.s").alias("support"), F.sum("x.q").alias("given"))
    each = each.select("class", _ratio(F.col("hits"), F.col("given")).alias("precision"), _ratio(F.col("hits"), F.col("support")).alias("recall"), _ratio(2 * F.col("hits"), F.col("given") + F.col("support")).alias("f1"), "support")
    names = ["precision", "recall", "f1"]
    macro = each.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = each.agg(*[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")).select(F.lit("weighted avg").alias("class"), *names, "support")
    return each.unionByName(macro).unionByName(weighted)
