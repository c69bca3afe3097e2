"""Supervised models on pyspark.ml, scored out of fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def with_indicators(df: DataFrame, features: list[str], sentinel: float = -1.0e6) -> tuple[DataFrame, list[str]]:
    """Trees here take no nulls: a null becomes a sentinel and gets a column that says so, if the feature is ever null."""
    nulls = df.agg(*(F.count_if(F.col(f).isNull()).alias(f) for f in features)).first()
    marks = {f"missing_{f}": F.col(f).isNull().cast("double") for f in features if nulls[f]}
    return df.withColumns(marks | {f: F.coalesce(F.col(f).cast("double"), F.lit(sentinel)) for f in features}), [*features, *marks]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight`: rows / (2 x rows of the class)."""
    n = df.groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    total = df.agg(F.count("*").alias("__t"))
    return df.join(F.broadcast(n), df[label] == n["__l"]).crossJoin(F.broadcast(total)).withColumn("weight", F.col("__t") / (2 * F.col("__n"))).drop("__l", "__n", "__t")


def classifier(kind: str, features: list[str], label: str, seed: int = 0, trees: int | None = None) -> Fit:
    """fit(train) -> score(df); `score` is the probability of label 1. kind: boosted (200 trees), forest (300) or logistic."""
    assemble = VectorAssembler(inputCols=features, outputCol="__raw")
    scale = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)
    common = {"featuresCol": "__x", "labelCol": label, "weightCol": "weight"}
    made = {
        "boosted": lambda: GBTClassifier(maxDepth=4, maxIter=trees or 200, stepSize=0.08, seed=seed, **common),
        "forest": lambda: RandomForestClassifier(numTrees=trees or 300, minInstancesPerNode=5, seed=seed, **common),
        "logistic": lambda: LogisticRegression(regParam=0.01, **common),
    }
    if kind not in made:
        raise ValueError(f"unknown model {kind}")

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        model = Pipeline(stages=[assemble, scale, made[kind]()]).fit(balanced(train, label))
        return lambda df: model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("__raw", "__x", "probability", "rawPrediction", "prediction")

    return fit


def out_of_fold(df: DataFrame, fit: Fit, label: str, fold: str = "fold") -> DataFrame:
    """Each row scored by a model that never saw its fold; a fold without both classes on either side is left out, -1 only trains."""
    classes = df.groupBy(fold).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).collect()
    p, q = sum(r.p for r in classes), sum(r.q for r in classes)
    out = None
    for r in sorted(classes, key=lambda r: r[fold]):
        if r[fold] < 0 or not r.p or p == r.p or q == r.q:
            continue
        scored = fit(df.where(F.col(fold) != r[fold]))(df.where(F.col(fold) == r[fold]))
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else df.withColumn("score", F.lit(None).cast("double")).where(F.lit(False))


def bagged(df: DataFrame, target: DataFrame, fit: Fit, label: str, id_: str, bags: int, ratio: int) -> DataFrame:
    """Mean score of models fitted on the positives and, each, other draws of `ratio` unlabelled rows to a positive."""
    pos = df.where(F.col(label) == 1)
    share = min(1.0, ratio * pos.count() / max(1, df.where(F.col(label) == 0).count()))
    scores = None
    for b in range(bags):
        draw = F.pmod(F.xxhash64(id_, F.lit(b)), F.lit(1_000_000)) < int(share * 1_000_000)
        s = fit(pos.unionByName(df.where((F.col(label) == 0) & draw)))(target).select(id_, "score")
        scores = s if scores is None else scores.unionByName(s)
    return scores.groupBy(id_).agg(F.avg("score").alias("score"), F.stddev_samp("score").alias("spread"))
