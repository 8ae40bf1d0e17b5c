"""Gapless numbers within a key, without ever gathering a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: list[str], name: str, buckets: int) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... within each value of ``key``.

    Rows of a key are dealt into buckets by a hash of ``order``; a bucket's first number is the sum of the counts of
    the buckets before it.  Rows that agree on all of ``order`` and ``key`` are numbered in any order.
    """
    d = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    n = d.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    first = n.select(F.col(key), "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"))
    inner = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    return d.withColumn("_r", inner).join(first, [key, "_b"]).withColumn(name, (F.col("_first") + F.col("_r")).cast("long")).drop("_b", "_r", "_first")


def buckets_for(rows: int) -> int:
    """64 at least, and so many that a key with all rows leaves a million in a bucket at most."""
    return max(64, -(-rows // 1_000_000))
