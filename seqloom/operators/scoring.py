"""Scores to predictions: softmax, nearest-centroid model, top-n, gate, ensemble.

A prediction table has clip_id, run, y, pred and prob (one probability per
class index). Any scorer that yields a logits array fits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import layout as L
from seqloom.functions.text import let


def softmax(logits: Column) -> Column:
    """Shift by the maximum, exponentiate, divide by the sum."""

    def scale(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda t: F.transform(e, lambda x: x / t))

    return let(logits, lambda z: let(F.array_max(z), lambda m: let(F.transform(z, lambda x: F.exp(x - m)), scale)))


def mean_vector(vec: Column) -> Column:
    """Element-wise mean of an array column, as one partial aggregate."""
    return vector_to_array(Summarizer.mean(array_to_vector(vec)))


@dataclass
class CentroidModel:
    """Mean vector per class index; logits are -scale * sum(|difference| ** power)."""

    centroids: np.ndarray
    scale: float
    power: int = 2

    def logits(self, vec: str) -> Column:
        c, scale, power = self.centroids, self.scale, self.power

        @F.arrow_udf("array<double>")
        def score(v: pa.Array) -> pa.Array:
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), c.shape[1])
            z = np.stack([(np.abs(x - k) ** power).sum(axis=1) for k in c], axis=1) * -scale
            return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * len(c)), pa.array(z.reshape(-1)))

        # else Spark pushes a filter on pred or prob below and scores every row a second time
        return score.asNondeterministic()(F.col(vec))

    def transform(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """Adds prob and pred (first class with the largest logit)."""
        s = df.withColumn("logits", self.logits(vec))
        prob = softmax(F.col("logits"))
        pred = (F.array_position("logits", F.array_max("logits")) - 1).cast("int")
        return s.withColumn("prob", prob).withColumn("pred", pred).drop("logits")


def fit_centroids(train: DataFrame, dims: int, n_classes: int, scale: float, y: str = "y", vec: str = "vec", power: int = 2) -> CentroidModel:
    """One aggregation; the model is n_classes x dims numbers, whatever the data size."""
    means = train.groupBy(y).agg(mean_vector(F.slice(vec, 1, dims)).alias("c"))
    c = np.full((n_classes, dims), 1e6)  # a class without training rows is never nearest
    rows = means.take(n_classes + 1)
    if len(rows) > n_classes:
        raise ValueError(f"more than {n_classes} classes in the training rows")
    for row in rows:
        c[row[y]] = row["c"]
    return CentroidModel(c, scale, power)


def fit_logistic(train: DataFrame, y: str = "y", vec: str = "vec", **params):
    """Multinomial logistic regression on the same vectors (pyspark.ml)."""
    from pyspark.ml.classification import LogisticRegression

    data = train.select(F.col(y).cast("double").alias("label"), array_to_vector(F.col(vec)).alias("features"))
    return LogisticRegression(**params).fit(data)


def logistic_transform(model, df: DataFrame, vec: str = "vec") -> DataFrame:

    s = model.transform(df.withColumn("features", array_to_vector(F.col(vec))))
    return s.withColumn("prob", vector_to_array("probability")).withColumn("pred", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def truth_rank(prob: str = "prob", y: str = "y") -> Column:
    """1-based rank of the true class; equal probabilities rank by class index."""
    return F.expr(f"size(filter({prob}, (p, i) -> p > {prob}[{y}] or (p = {prob}[{y}] and i < {y}))) + 1")


def top_n(preds: DataFrame, n: int = 3) -> DataFrame:
    """The n most probable classes of each row, one output row each."""
    best = F.expr(f"slice(array_sort(transform(prob, (p, i) -> named_struct('np', -p, 'cls', i))), 1, {n})")
    return (
        preds.withColumn("true_rank", truth_rank())
        .select("*", F.posexplode_outer(best).alias("pos", "s"))
        .withColumn("rank", F.col("pos") + 1)
        .withColumn("cls", F.col("s.cls"))
        .withColumn("p", -F.col("s.np"))
        .drop("pos", "s")
    )


def with_margin(preds: DataFrame) -> DataFrame:
    """Adds conf (best probability) and margin to the runner-up (conf if alone)."""
    second = F.expr("array_max(filter(prob, (p, i) -> i <> pred))")
    return preds.withColumn("conf", F.expr("prob[pred]")).withColumn("margin", F.col("conf") - F.coalesce(second, F.lit(0.0)))


def gate(preds: DataFrame, rules: L.GateRules = L.GateRules(), name: str = "name") -> DataFrame:
    """Keeps confident, clear predictions of a real sign."""
    return with_margin(preds).filter((F.col(name) != L.NOSIGN) & (F.col("conf") >= rules.conf) & (F.col("margin") >= rules.margin))


def ensemble(preds: DataFrame, runs: list[str]) -> DataFrame:
    """Sums the runs' probabilities per clip and takes the best class.

    Every clip must have exactly one row per run with the same label; anything
    else stops the job.
    """
    g = preds.filter(F.col("run").isin(runs)).groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("run", "prob"))).alias("m"),
        F.min("y").alias("y"),
        F.max("y").alias("_y2"),
    )
    n_runs = F.size(F.array_distinct("m.run"))
    same = (F.size("m") == len(runs)) & (n_runs == len(runs)) & (F.col("y") == F.col("_y2"))
    total = F.expr("aggregate(slice(m, 2, size(m)), m[0].prob, (acc, x) -> zip_with(acc, x.prob, (a, b) -> a + b))")
    prob = F.when(same, total).otherwise(F.raise_error(F.lit("runs disagree on test rows or labels")))
    return g.select("clip_id", F.lit("+".join(runs)).alias("run"), "y", prob.alias("prob")).withColumn(
        "pred", F.expr("cast(array_position(prob, array_max(prob)) - 1 as int)")
    )
