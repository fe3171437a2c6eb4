"""Nearest training clip of every test clip under the same label.

Distance is the mean absolute difference of two feature vectors. Both sides of a
label are cut into blocks of bounded size, and a pair of blocks is one vectorised
step, dealt out by label and block, so no task grows with a label; only each test vector's minimum leaves a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.ranking import exact_percentiles
from seqloom.session import shared_dir

BLOCK = 128  # vectors a side of a pair of blocks


def _blocks(clips: DataFrame, fold: str) -> DataFrame:
    """(label, blocks, block, vecs): each label's distinct vectors of a fold in blocks of about BLOCK, and how many."""
    v = clips.filter(F.col("fold") == fold).select("label", "vec").distinct()
    size = v.groupBy("label").agg(F.count("*").alias("n"))
    v = v.join(size, "label").withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as bigint)"))
    v = v.withColumn("block", F.expr("pmod(xxhash64(vec), blocks)"))
    return v.groupBy("label", "blocks", "block").agg(F.collect_list("vec").alias("vecs"))


def nearest_in_label(clips: DataFrame, dims: int) -> DataFrame:
    """clip_id, label, dmin for every test clip whose label has training clips.

    clips: clip_id, label, fold, vec (``dims`` doubles). Identical vectors are
    merged on both sides first, so masses of copies cost one comparison. Every
    test vector is compared with every training vector of its label.
    """
    tests, train = _blocks(clips, "test").select("label", F.col("vecs").alias("t")), _blocks(clips, "train")
    # a pair of blocks is what is dealt out, so one label's pairs spread over tasks
    asking = tests.join(train.select("label", "blocks").distinct(), "label").select("label", "t", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    pairs = asking.join(train.select("label", "block", "vecs"), ["label", "block"]).select("label", "t", "vecs")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t, v = (batch.column(c)[i].values for c in (1, 2))
                x, y = (b.flatten().to_numpy().reshape(-1, dims) for b in (t, v))
                d = np.array([np.abs(y - one).sum(axis=1).min() for one in x]) / dims
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(x))), t, pa.array(d)], ["label", "tvec", "d"])

    label = clips.schema["label"].dataType.simpleString()
    best = pairs.mapInArrow(least, f"label {label}, tvec array<double>, d double").groupBy("label", "tvec").agg(F.min("d").alias("dmin"))
    return clips.filter("fold = 'test'").select("clip_id", "label", F.col("vec").alias("tvec")).join(best, ["label", "tvec"]).select("clip_id", "label", "dmin")


def near_dup_profile(near: DataFrame, cohort: str, thresholds=(0.02, 0.05, 0.1)) -> DataFrame:
    """Distribution of dmin per cohort and the share below each threshold.

    ``near`` (one number per test clip) is checkpointed: the search behind it is
    costly and the report reads it several times.
    """
    shared_dir(near.sparkSession)
    near = near.select(cohort, "dmin").checkpoint()
    shares = [F.avg((F.col("dmin") < t).cast("double")).alias("below_" + str(t).replace(".", "_")) for t in thresholds]
    base = near.groupBy(cohort).agg(
        F.count("*").alias("n"), F.avg("dmin").alias("mean"), F.stddev_samp("dmin").alias("std"), F.min("dmin").alias("min"), F.max("dmin").alias("max"), *shares
    )
    return base.join(exact_percentiles(near, [cohort], "dmin", {"p10": 0.1, "p25": 0.25, "p50": 0.5}), cohort)
