"""Reproducible pseudo-random columns derived from hashes.

Values depend only on the row's key and a tag, never on partitioning or task
order, so a recomputed partition yields the same draw.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEHMER_M = 2147483647


def hash_hex(key: Column, tag: str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(":" + tag)).cast("binary"))


def uniform(key: Column, tag: str) -> Column:
    """Uniform double in [0, 1) from 32 bits of md5(key:tag)."""
    return F.conv(F.substring(hash_hex(key, tag), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def seed31(key: Column, tag: str) -> Column:
    """Positive 31-bit seed for the Lehmer draws below."""
    return F.conv(F.substring(hash_hex(key, tag), 1, 7), 16, 10).cast("bigint") + F.lit(1)


def lehmer_draws(seed: np.ndarray, j: np.ndarray, mult: int) -> np.ndarray:
    """Uniforms in (0, 1) for draw ``j`` of ``seed``: two Lehmer rounds."""
    first = (seed + j * 7919) % LEHMER_M * 48271 % LEHMER_M
    return (first * mult % LEHMER_M + 1) / 2147483649.0


def gauss_draws(seed: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Standard normals for draw ``j`` of ``seed`` (Box-Muller)."""
    return np.sqrt(-2.0 * np.log(lehmer_draws(seed, j, 16807))) * np.cos(2 * np.pi * lehmer_draws(seed, j, 69621))
