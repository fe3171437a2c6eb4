"""Reports over prediction tables. Rows are reduced to a confusion table first;
everything after that is at most classes squared per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.operators.scoring import truth_rank


def confusion(preds: DataFrame, k: int = 5) -> DataFrame:
    hit = truth_rank() <= F.least(F.lit(k), F.size("prob"))
    return preds.groupBy("run", "y", "pred").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_top"))


def class_counts(conf: DataFrame) -> DataFrame:
    """Support, predictions, hits and top-k hits per class of y or pred."""
    zero = F.lit(0).cast("bigint")
    ok = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), zero.alias("predicted"), ok.alias("tp"), F.col("n_top").alias("top")),
        F.struct(F.col("pred").alias("cls"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("tp"), zero.alias("top")),
    )
    names = ("support", "predicted", "tp", "top")
    return conf.select("run", F.inline(sides)).groupBy("run", "cls").agg(*[F.sum(c).alias(c) for c in names])


def per_class_report(preds: DataFrame) -> DataFrame:
    """Precision, recall, f1 and support of every class seen in y or pred."""
    c = class_counts(confusion(preds))
    zero = F.lit(0.0)
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(zero)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(zero)
    return c.select("run", "cls", p.alias("precision"), r.alias("recall"), _f1().alias("f1"), "support")


def _f1():
    return 2 * F.col("tp") / (F.col("support") + F.col("predicted"))


def eval_metrics(preds: DataFrame, k: int = 5) -> DataFrame:
    """Accuracy, top-k and macro-F1 per run, from one confusion table.

    macro_f1 averages over classes in y or pred, macro_f1_true over y alone.
    """
    c = class_counts(confusion(preds, k))
    return c.groupBy("run").agg(
        F.sum("support").alias("n"),
        (F.sum("tp") / F.sum("support")).alias("acc"),
        (F.sum("top") / F.sum("support")).alias("top5"),
        F.avg(_f1()).alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, _f1())).alias("macro_f1_true"),
    )


def top_confusions(preds: DataFrame, k: int = 20) -> DataFrame:
    conf = confusion(preds)
    row = F.sum("n").over(W.partitionBy("run", "y"))
    c = conf.withColumn("rate", F.col("n") / row).filter("y <> pred")
    return c.select("run", F.col("y").alias("actual"), F.col("pred").alias("predicted"), "n", "rate").orderBy(F.desc("n"), "run", "actual", "predicted").limit(k)


def confidence_curve(preds: DataFrame, steps: int = 20) -> DataFrame:
    """Coverage and accuracy among rows with confidence >= i/steps.

    One pass counts rows per confidence band; the cumulative sums run over at
    most ``steps`` bands per run. Thresholds nobody reaches are left out.
    """
    conf = F.array_max("prob")
    band = sum([(conf >= F.lit(i / steps)).cast("int") for i in range(1, steps)], F.lit(0))
    bands = preds.groupBy("run", band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("y") == F.col("pred")).alias("ok"))
    packed = bands.groupBy("run").agg(F.collect_list(F.struct("band", "n", "ok")).alias("b"), F.sum("n").alias("total"))
    rows = packed.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    n = F.expr("aggregate(filter(b, x -> x.band >= i), 0L, (a, x) -> a + x.n)")
    ok = F.expr("aggregate(filter(b, x -> x.band >= i), 0L, (a, x) -> a + x.ok)")
    return (
        rows.withColumn("n", n)
        .withColumn("ok", ok)
        .filter("n > 0")
        .select("run", F.round(F.col("i") / steps, 2).alias("threshold"), (F.col("n") / F.col("total")).alias("coverage"), (F.col("ok") / F.col("n")).alias("accuracy"), "n")
    )


def run_compare(metrics: DataFrame) -> DataFrame:
    """Runs side by side; an unknown split mode shows as '?'."""
    return metrics.select(
        "run",
        F.coalesce("split_mode", F.lit("?")).alias("split_mode"),
        F.round("acc", 4).alias("acc"),
        F.round("macro_f1", 4).alias("macro_f1"),
        F.round("top5", 4).alias("top5"),
    )


def best_run(metrics: DataFrame, split_mode: str = "provided") -> DataFrame:
    return metrics.filter(F.col("split_mode") == split_mode).orderBy(F.desc("macro_f1"), F.desc("run")).limit(1)


def acc_by_origin(preds: DataFrame) -> DataFrame:
    return preds.groupBy("run", "orig_split").agg(F.count("*").alias("n"), F.avg((F.col("y") == F.col("pred")).cast("double")).alias("acc"))


def read_metrics(spark, path: str) -> DataFrame:
    """Metrics JSON files laid out as <run>/test_metrics.json."""
    m = spark.read.option("multiLine", "true").schema("split_mode string, acc double, macro_f1 double, top5 double").json(path)
    return m.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
