"""Leak-proof train/val/test splits as a ``fold`` column.

Fold membership comes from a hash of the key, so rows get their fold by a
projection and the result never depends on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions.rand import hash_hex
from seqloom.operators.ranking import HASH_PREFIX, hash_cuts

KEY_BY_MODE = {"random": "stem", "group": "group_id", "signer": "signer_id", "provided": "group_id"}


def make_splits(
    manifest: DataFrame,
    mode: str = "group",
    val_frac: float = 0.15,
    test_frac: float = 0.15,
    seed: int = 42,
    row_id: str = "npz",
) -> DataFrame:
    if mode == "random":
        return _split_random(manifest, row_id, val_frac, test_frac, seed)
    if mode == "provided":
        return _split_provided(manifest, val_frac, seed)
    if mode in ("group", "signer"):
        return _split_by_key(manifest, KEY_BY_MODE[mode], val_frac, test_frac, seed)
    raise ValueError(f"unknown split mode {mode!r}")


def _fold(h: Column, cuts: Column) -> Column:
    return F.when(h <= cuts.getField("c0"), "test").when(h <= cuts.getField("c1"), "val").otherwise("train")


def _split_random(m: DataFrame, row_id: str, val_frac: float, test_frac: float, seed: int) -> DataFrame:
    tag = f"split{seed}"
    cuts = hash_cuts(m.select(row_id), row_id, tag, [(test_frac, 0), (val_frac, 0)])
    return m.withColumn("fold", _fold(hash_hex(F.col(row_id), tag), cuts))


def _split_by_key(m: DataFrame, key: str, val_frac: float, test_frac: float, seed: int) -> DataFrame:
    if key not in m.columns or m.filter(F.length(key) > 0).isEmpty():
        raise ValueError(f"manifest has no usable column {key!r}")
    tag = f"split{seed}"
    cuts = hash_cuts(m.select(key).distinct(), key, tag, [(test_frac, 1), (val_frac, 1)])
    return m.withColumn("fold", _fold(hash_hex(F.col(key), tag), cuts))


def _split_provided(m: DataFrame, val_frac: float, seed: int) -> DataFrame:
    if "split" not in m.columns:
        raise ValueError("manifest has no column 'split'")
    is_test = F.lower(F.trim(F.coalesce("split", F.lit("")))) == "test"
    if m.filter(is_test).isEmpty():
        raise ValueError("column 'split' has no test row")
    key = "group_id" if "group_id" in m.columns else "stem"
    tag = f"split{seed}"
    cuts = hash_cuts(m.filter(~is_test).select(key).distinct(), key, tag, [(val_frac, 1)])
    in_val = hash_hex(F.col(key), tag) <= cuts.getField("c0")
    return m.withColumn("fold", F.when(is_test, "test").when(in_val, "val").otherwise("train"))


def leaking_keys(folded: DataFrame, key: str) -> DataFrame:
    """Keys that appear in more than one fold; flags pre-aggregate per map task."""
    flags = [F.max((F.col("fold") == f).cast("int")).alias(f"in_{f}") for f in ("train", "val", "test")]
    return folded.groupBy(F.col(key).cast("string").alias("key")).agg(*flags).filter("in_train + in_val + in_test > 1")


def assert_no_leakage(folded: DataFrame, key: str) -> None:
    bad = [r["key"] for r in leaking_keys(folded, key).limit(5).collect()]
    if bad:
        raise AssertionError(f"data leak: key {key!r} in two folds, e.g. {bad}")


def split_report(folded: DataFrame) -> DataFrame:
    """Clips, labels, groups and named signers per fold; the distinct counts run
    on rows already merged per (fold, label, group, signer)."""
    base = folded.groupBy("fold", "label", "group_id", "signer_id").agg(F.count("*").alias("n"))
    return base.groupBy("fold").agg(
        F.sum("n").alias("clips"),
        F.count_distinct("label").alias("labels"),
        F.count_distinct("group_id").alias("groups"),
        F.count_distinct(F.when(F.col("signer_id") != "", F.col("signer_id"))).alias("signers"),
    )


def stratified_fraction(manifest: DataFrame, fraction: float, seed: int = 42, row_id: str = "npz") -> DataFrame:
    """The first ceil(fraction * n) clips of every label in hash order.

    A label is cut into hash-prefix buckets, so even a label with most of the
    rows is ranked in many tasks.
    """
    h = hash_hex(F.col(row_id), f"frac{seed}")
    m = manifest.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    per = m.groupBy("label", "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy("label").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    off = per.select(
        "label",
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy("label")).alias("_total"),
    )
    rank = F.row_number().over(W.partitionBy("label", "_b").orderBy("_h"))
    return (
        m.join(off, ["label", "_b"])
        .withColumn("_rank", rank + F.col("_before"))
        .filter(F.col("_rank") <= F.ceil(F.lit(fraction) * F.col("_total")))
        .drop("_h", "_b", "_before", "_total", "_rank")
    )
