"""Global ranks, order statistics and percentiles without a one-task sort.

A monotone bucket splits the order into pieces; a small count per bucket gives
each piece its offset, so no task ever sees the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions.rand import hash_hex

HASH_PREFIX = 3  # 16^3 = 4096 buckets
VALUE_BUCKETS = 256


def _offsets(counts: DataFrame, bucket: str) -> DataFrame:
    """Rows before each bucket; ``counts`` has one row per bucket."""
    w = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(bucket, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), "_n")


def value_buckets(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds ``_b``: buckets of about equally many rows, in the order of the values.

    The bounds are approximate quantiles of the rows themselves, so neither an
    outlier nor clustered values put most rows into one bucket.
    """
    parts = [i / VALUE_BUCKETS for i in range(1, VALUE_BUCKETS)]
    bounds = F.array_distinct(F.percentile_approx(value, parts, 10_000)).alias("_bounds")
    if group:
        placed = df.join(df.groupBy(*group).agg(bounds), group)
    else:
        placed = df.withColumn("_bounds", df.agg(bounds).scalar())
    return placed.withColumn("_b", F.size(F.filter("_bounds", lambda x: x <= F.col(value)))).drop("_bounds")


def global_ordinal(df: DataFrame, order: str) -> DataFrame:
    """Adds ``ordinal`` = 1-based position by the unique integer column ``order``.

    Buckets of about equally many rows are ranked on their own; the offset table
    has a row per bucket.
    """
    b = value_buckets(df, [], order)
    off = _offsets(b.groupBy("_b").agg(F.count("*").alias("_n")), "_b").drop("_n")
    w = W.partitionBy("_b").orderBy(order)
    return b.join(off, "_b").withColumn("ordinal", F.row_number().over(w) + F.col("_before")).drop("_b", "_before")


def string_buckets(df: DataFrame, key: str, buckets: int = VALUE_BUCKETS) -> DataFrame:
    """Adds ``_b``: ranges of the (unique) strings in code-point order, of about equally many rows.

    The bounds are rows of smallest hash, one fewer than buckets, so they follow the keys themselves.
    """
    some = df.select(F.col(key).alias("k")).where(F.col(key).isNotNull()).orderBy(F.xxhash64("k"), "k").limit(buckets - 1)
    bounds = some.agg(F.array_sort(F.collect_list("k")).alias("bounds")).scalar()
    placed = df.withColumn("_bounds", bounds)
    return placed.withColumn("_b", F.coalesce(F.size(F.filter("_bounds", lambda x: x <= F.col(key))), F.lit(0))).drop("_bounds")


def string_ordinal(df: DataFrame, key: str, output: str, within: list[str] | None = None) -> DataFrame:
    """Adds the 0-based position of each row by the unique string ``key``, within equal values of ``within``.

    Ranges are ranked on their own; a range's offset comes from the counts of the ranges before it.
    """
    by = within or []
    b = string_buckets(df, key)
    counts = b.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over((W.partitionBy(*by) if by else W.partitionBy()).orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*by, "_b", F.coalesce(before, F.lit(0)).alias("_before"))  # at most a row for each range and group
    rank = F.row_number().over(W.partitionBy(*by, "_b").orderBy(key))
    return b.join(offsets, [*by, "_b"]).withColumn(output, (rank - 1 + F.col("_before")).cast("bigint")).drop("_b", "_before")


def hash_cuts(keys: DataFrame, key: str, tag: str, fracs: list[tuple[float, int]]) -> Column:
    """Hash thresholds that put exact shares of the (unique) keys below them.

    ``fracs`` lists (share, minimum count); cut i covers the first
    sum(max(minimum, floor(n*share))) keys in hash order. Returned as one
    scalar-subquery struct c0, c1, ...: a row is below cut i iff hash <= c_i, so
    assigning rows is a projection, with no join back.
    """
    h = keys.select(hash_hex(F.col(key), tag).alias("_h")).withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    buckets = _offsets(h.groupBy("_b").agg(F.count("*").alias("_n")), "_b")
    total = buckets.agg(F.collect_list(F.struct("_b", "_before", "_n")).alias("bs"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    ks, run = [], F.lit(0).cast("bigint")
    for share, least in fracs:
        run = run + F.greatest(F.lit(least).cast("bigint"), F.floor(F.col("n") * F.lit(share)))
        ks.append(run)
    total = total.withColumn("ks", F.array(*ks))
    targets = (
        total.select("n", F.posexplode("ks").alias("cut", "k"), "bs")
        .select("n", "cut", "k", F.expr("get(filter(bs, b -> b._before < k and k <= b._before + b._n), 0)").alias("b"))
        .select("cut", "k", "n", F.col("b._b").alias("_b"), (F.col("k") - F.col("b._before")).alias("_want"))
    )
    w = W.partitionBy("cut", "_b").orderBy("_h")
    found = (
        h.join(F.broadcast(targets.filter("_b is not null")), "_b")  # one row per cut
        .withColumn("_rn", F.row_number().over(w))
        .filter("_rn = _want")
        .select("cut", "_h")
    )
    edge = targets.select("cut", F.when(F.col("k") <= 0, "").when(F.col("k") > F.col("n"), "g").alias("_h")).filter("_h is not null")
    every = found.unionByName(edge)
    packed = every.agg(F.struct(*[F.max(F.when(F.col("cut") == i, F.col("_h"))).alias(f"c{i}") for i in range(len(fracs))]).alias("cuts"))
    return packed.scalar()


def exact_percentiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per group, exact, for groups of any size.

    Equal values are merged first; each group is then split into value buckets
    and only the buckets that hold a wanted rank are sorted.
    """
    dist = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    total = dist.groupBy(*group).agg(F.sum("_c").alias("_n"))
    placed = _join(value_buckets(dist, group, value), total, group)
    w = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    per_bucket = placed.groupBy(*group, "_b", "_n").agg(F.sum("_c").alias("_bc")).withColumn("_before", F.coalesce(F.sum("_bc").over(w), F.lit(0)))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    ranks = (
        per_bucket.withColumn("_w", F.explode(wanted))
        .withColumn("_pos", F.col("_w.p") * (F.col("_n") - 1))
        .withColumn("_r", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))))
        .filter("_before <= _r and _r < _before + _bc")
        .select(*group, "_b", "_before", F.col("_w.name").alias("_name"), "_pos", "_r")
        .distinct()
    )
    v = W.partitionBy(*group, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    needed = placed.join(ranks.select(*group, "_b").distinct(), group + ["_b"], "left_semi")
    cum = needed.withColumn("_in", F.coalesce(F.sum("_c").over(v), F.lit(0)))
    hit = ranks.join(cum.select(*group, "_b", value, "_c", "_in"), group + ["_b"]).filter(
        "_before + _in <= _r and _r < _before + _in + _c"
    )
    frac = F.col("_pos") - F.floor("_pos")
    weight = F.when(F.floor("_pos") == F.ceil("_pos"), 1.0).when(F.col("_r") == F.floor("_pos"), 1 - frac).otherwise(frac)
    return hit.groupBy(*group).agg(
        *[F.sum(F.when(F.col("_name") == name, F.col(value) * weight)).alias(name) for name in probs]
    )


def _join(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    return a.join(b, group) if group else a.withColumn("_n", b.scalar())
