"""Building blocks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAVY_KEYS = 1000


def attach_by_key(df: DataFrame, per_key: DataFrame, key: str, weight: str, row_id: str,
                  heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """Left join ``df`` with one row per ``key``, whatever the distribution of keys.

    The ``heavy_keys`` keys of largest ``weight`` (their row count in ``df``) are broadcast: that
    side has at most ``heavy_keys`` rows by construction. A key outside it cannot hold more than
    1/heavy_keys of all rows, so the shuffle join of the rest is balanced. Rows already
    served, and rows without key, travel under a key of their own instead of piling up in one
    partition. ``df`` is read once.
    """
    values = [c for c in per_key.columns if c not in (key, weight)]
    heavy = per_key.orderBy(F.desc(weight), key).limit(heavy_keys) \
        .select(F.col(key), F.lit(True).alias("_heavy"), *[F.col(c).alias(f"_h_{c}") for c in values])
    first = df.join(F.broadcast(heavy), key, "left")
    served = F.col("_heavy").isNotNull() | F.col(key).isNull()
    first = first.withColumn("_k", F.when(
        served, F.concat(F.lit("\0"), F.col(row_id).cast("string"))).otherwise(F.col(key).cast("string")))
    rest = per_key.select(F.col(key).cast("string").alias("_k"),
                          *[F.col(c).alias(f"_r_{c}") for c in values])
    joined = first.join(rest, "_k", "left")
    return joined.select(*[joined[c] for c in df.columns],
                         *[F.coalesce(f"_h_{c}", f"_r_{c}").alias(c) for c in values])


def blocked_row_number(df: DataFrame, keys: Sequence[str], order: str, block: Column,
                       name: str = "row_no") -> DataFrame:
    """1-based number of each row within ``keys`` by ``order``, without one task per key.

    ``block`` must grow with ``order`` (rows of an earlier block come first). Rows are numbered
    within (keys, block); each block's offset is the number of rows in the blocks before it, taken
    from counts, which are few.
    """
    keys = list(keys)
    data = df.withColumn("_block", block)
    counts = data.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    return (data.join(offsets, [*keys, "_block"])
            .withColumn(name, F.row_number().over(within) + F.col("_off"))
            .drop("_block", "_off"))


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                row_id: str, name: str = "rank", salts: int = 32) -> DataFrame:
    """First ``n`` rows per key; ranked per (key, salt) first, so a hot key is split.

    Both rankings are row limits, so Spark drops rows beyond ``n`` per group before each shuffle;
    the second sees at most ``n * salts`` rows per key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (salted.withColumn(name, F.row_number().over(first)).where(F.col(name) <= n)
            .drop("_salt").withColumn(name, F.row_number().over(second)).where(F.col(name) <= n))
