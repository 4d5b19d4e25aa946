"""Encoding, splitting, training and evaluation with pyspark.ml."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import confusion, rates


def one_hot(df: DataFrame, column: str, most_levels: int = 1000) -> DataFrame:
    """df with a 0/1 column for each value of column instead of it; nulls are 0 in all."""
    levels = sorted(r[0] for r in df.select(column).distinct().filter(F.col(column).isNotNull()).limit(most_levels + 1).collect())
    if len(levels) > most_levels:
        raise ValueError(f"{column} has over {most_levels} values")
    return df.select(*[c for c in df.columns if c != column], *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in levels])


def stratified_split(df: DataFrame, stratum: str, key: str, share: float) -> DataFrame:
    """df with is_test: rows behind `share` of their stratum (rounded down) in the order of a hash of key. Equal keys go by chance.

    Ranks are exact: rows are numbered inside 256 ranges of the hash and shifted by the rows of the ranges before, of
    which there are 256 a stratum.
    """
    name, range_, before, rows = ("split_hash", "split_range", "split_before", "split_rows")
    ranged = df.withColumn(name, F.md5(F.col(key).cast("string").cast("binary"))).withColumn(range_, F.substring(name, 1, 2))
    counts = ranged.groupBy(stratum, range_).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(stratum)
    counts = counts.select(F.col(stratum).alias("of"), F.col(range_).alias("at"), (F.sum("n").over(whole.orderBy(range_)) - F.col("n")).alias(before), F.sum("n").over(whole).alias(rows))
    met = ranged.join(counts, F.col(stratum).eqNullSafe(F.col("of")) & (F.col(range_) == F.col("at")))
    place = F.col(before) + F.row_number().over(Window.partitionBy(stratum, range_).orderBy(name))
    return met.withColumn("is_test", place > F.floor(F.col(rows) * share)).select(*df.columns, "is_test")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight n / (2 * rows of its class)."""
    total = df.count()
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(F.broadcast(sizes), label).withColumn("weight", total / (2 * F.col("_c"))).drop("_c")  # one row a class


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """df with the named columns as one vector `features`; nulls count 0."""
    filled = df.select("*", *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_f_{f}") for f in features])
    return VectorAssembler(inputCols=[f"_f_{f}" for f in features], outputCol="features").transform(filled).drop(*[f"_f_{f}" for f in features])


def binary_target(df: DataFrame, label: str, positive: list[str], known: list[str], out: str = "target") -> DataFrame:
    """df with out: 1 where the label is one of positive, 0 where it is another known one. An unknown label is an error that names all unknown ones, sorted."""
    unknown = sorted(str(r[0]) for r in df.select(label).distinct().filter(F.col(label).isNull() | ~F.col(label).isin(known)).limit(1000).collect())
    if unknown:
        raise ValueError(f"unknown labels: {', '.join(unknown)}")
    return df.withColumn(out, F.col(label).isin(positive).cast("int"))


def models(rows: int, label: str = "label", balanced: bool = False) -> dict:
    """Estimators with the parameters of the study; L2 strength 1 becomes 1 / rows here. balanced: the two baselines, which take the column weight of balanced_weights()."""
    if balanced:
        return {
            "Logistic_Regression": LogisticRegression(labelCol=label, weightCol="weight", maxIter=5000, regParam=1 / max(rows, 1), standardization=False),
            "Random_Forest": RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=200, maxDepth=30, seed=42),  # 30 is the library's most
        }
    return {
        "Logistic_Regression": LogisticRegression(labelCol=label, maxIter=1000, regParam=1 / max(rows, 1), standardization=False),
        "Random_Forest": RandomForestClassifier(labelCol=label, numTrees=50, maxDepth=5, seed=42),
        "Gradient_Boosting": GBTClassifier(labelCol=label, maxIter=50, maxDepth=3, seed=42),
    }


def predicted(model, df: DataFrame) -> DataFrame:
    """df with predicted and score, the probability of class 1."""
    out = model.transform(df).withColumn("score", vector_to_array("probability")[1]).withColumn("predicted", F.col("prediction").cast("int"))
    return out.drop("rawPrediction", "probability", "prediction")


def generalization(df: DataFrame, vector: str, label: str, splits: dict[str, Column], train: str) -> DataFrame:
    """(model, split, metrics): each model fitted once on `train` and scored on every split in one pass."""
    data = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("split", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(n)) for n, rule in splits.items()])))).drop(vector)
    fit_on = data.filter(F.col("split") == train)
    rows, out = fit_on.count(), None
    for name, estimator in models(rows, label).items():
        scored = predicted(estimator.fit(fit_on), data).select("split", F.col(label).alias("label"), "predicted", F.lit(name).alias("model"))
        out = scored if out is None else out.unionByName(scored)
    return rates(confusion(out, "model", "split"))


def grid(df: DataFrame, groups: dict[str, list[str]], label: str, is_test: str, balanced: bool = False, at_once: int = 4) -> DataFrame:
    """(group, model, n_features, metrics): each model fitted on each group's features of the rows that aren't is_test and scored on the others.

    The fits are few whatever the rows; each reads df anew, as written or cached by the caller. at_once: how many fits
    run side by side, since each is many short jobs that leave cores idle.
    """
    fits = []
    for group, names in groups.items():
        data = assembled(df, names).select("features", F.col(label).alias("label"), F.col(is_test).alias("is_test"))
        train, test = data.filter(~F.col("is_test")), data.filter("is_test")
        if balanced:
            train = balanced_weights(train, "label")
        if not fits:
            rows = train.count()  # the same for every group
        fits += [(group, names, train, test, name, estimator) for name, estimator in models(rows, "label", balanced).items()]
    with ThreadPool(at_once) as pool:
        fitted = pool.map(inheritable_thread_target(df.sparkSession)(lambda fit: fit[5].fit(fit[2])), fits, chunksize=1)
    out = None
    for (group, names, _, test, name, _), model in zip(fits, fitted, strict=True):
        scored = predicted(model, test).select("label", "predicted", F.lit(group).alias("group"), F.lit(name).alias("model"), F.lit(len(names)).alias("n_features"))
        out = scored if out is None else out.unionByName(scored)
    return rates(confusion(out, "group", "model", "n_features"))


def save_model(model: Model, path: str) -> None:
    """Writes a fitted model below path, in place of one that is there."""
    PipelineModel(stages=[model]).write().overwrite().save(path)


def load_model(path: str) -> Model:
    """The fitted model that save_model wrote."""
    return PipelineModel.load(path).stages[0]
