"""Windows, runs, top-k, sets and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence(rows: DataFrame, by: list[str], order: str = "row_no") -> DataFrame:
    """``occurrence``: 1 for the first row with these values, in order."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*by).orderBy(order)))


def rank_k(df: DataFrame, by: list[str], value: str, key: str, k: int, asc: bool = False) -> DataFrame:
    """Competition ``rank`` of each row and ``kth``, the group's k-th value (null if it has fewer)."""
    o = F.col(value).asc() if asc else F.col(value).desc()
    d = df.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(o))).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(o, key)))
    kth = d.where(F.col("_n") == k).select(*by, F.col(value).alias("kth"))
    return d.drop("_n").join(kth, by, "left")


def upper_median_gap(series: DataFrame, by: list[str]) -> DataFrame:
    """The gap in days at place floor(n/2) of the sorted gaps, and in months of 30.44 days."""
    d = series.select(*by, "period_end").distinct()
    gap = F.date_diff("period_end", F.lag("period_end").over(Window.partitionBy(*by).orderBy("period_end")))
    d = d.withColumn("gap", gap).where("gap is not null")
    w = Window.partitionBy(*by)
    d = d.withColumn("_i", F.row_number().over(w.orderBy("gap"))).withColumn("_n", F.count("*").over(w))
    return d.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(*by, "gap", F.round(F.col("gap") / 30.44).cast("int").alias("months"))


def runs(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """Maximal runs of consecutive integers: first, last, length."""
    d = df.select(*by, n).distinct().withColumn("_g", F.col(n) - F.row_number().over(Window.partitionBy(*by).orderBy(n)))
    return d.groupBy(*by, "_g").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("length")).drop("_g")


def step_ratios(series: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """The most frequent ratio of neighbours (the smaller on a tie) and how often it occurs."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("period_end"))
    d = series.withColumn("_b", before).where("_b <> 0").withColumn("ratio", F.round(F.col("value") / F.col("_b"), digits))
    n = d.groupBy(*by, "ratio").agg(F.count("*").alias("times"))
    return top_k(n, by, [F.col("times").desc(), F.col("ratio")], 1)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def first_seen(df: DataFrame, key: Column, order: list[str], by: list[str] = []) -> DataFrame:
    """The first row, in order, of every key; a null key is one key.

    Keys are compared by a digest, and a key's first row is kept before the shuffle, so a hot key costs no more.
    """
    first = F.min(F.struct(*order, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))).alias("_first")
    return df.groupBy(*by, F.sha2(key, 256).alias("_key")).agg(first).select("_first._row.*")


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys as added, removed or common."""
    o, n = old.select(*key).distinct().withColumn("_o", F.lit(1)), new.select(*key).distinct().withColumn("_n", F.lit(1))
    what = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("common")
    return o.join(n, key, "full").select(*key, what.alias("change"))


def union_best(frames: list[DataFrame], key: list[str], score: str) -> DataFrame:
    """Best score of every key over all streams."""
    d = frames[0]
    for f in frames[1:]:
        d = d.unionByName(f)
    return d.groupBy(*key).agg(F.max(score).alias(score))


def jaccard(a: DataFrame, b: DataFrame, by_a: str, by_b: str, item: str) -> DataFrame:
    """Pairs that share an item: common, and common over all. Items are grouped before the join; no pair without one is made."""
    x, y = a.select(by_a, item).distinct(), b.select(by_b, item).distinct()
    na, nb = x.groupBy(by_a).agg(F.count("*").alias("_na")), y.groupBy(by_b).agg(F.count("*").alias("_nb"))
    both = x.join(y, item).groupBy(by_a, by_b).agg(F.count("*").alias("common"))
    j = both.join(na, by_a).join(nb, by_b)
    return j.withColumn("jaccard", F.col("common") / (F.col("_na") + F.col("_nb") - F.col("common"))).drop("_na", "_nb")


def lookup_exact(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, order: str) -> DataFrame:
    """The first value, in order, whose key is the same, case aside. A blank key finds nothing."""
    t = table.withColumn("_k", F.lower(table_key)).groupBy("_k").agg(F.min_by(value, order).alias("found"))
    d = df.withColumn("_k", F.nullif(F.lower(key), F.lit("")))
    return d.join(t, "_k", "left").drop("_k")


def asof(df: DataFrame, table: DataFrame, by: list[str], at: str, table_at: str, value: str, direction: int = -1) -> DataFrame:
    """``found``: the value at the last table row at or before ``at`` (direction -1), or the first at or after (1).

    Both sides are laid on one line and filled along it; rows are never paired by range.
    """
    cols = [c for c in df.columns if c not in by]
    left = df.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(table.dtypes)[value]).alias("_v"), F.struct(*cols).alias("_row"))
    right = table.select(*by, F.col(table_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    right = right.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType))
    both = left.unionByName(right)
    if direction < 0:
        w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_v", ignorenulls=True).over(w)
    else:
        w = Window.partitionBy(*by).orderBy(F.col("_at").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
        found = F.last("_v", ignorenulls=True).over(w)
    return both.withColumn("found", found).where("_side = 1").select(*by, "_row.*", "found")


def xlookup(df: DataFrame, table: DataFrame, by: list[str], at: str, table_at: str, value: str, mode: int, missing: Column) -> DataFrame:
    """Exact (0), else next smaller (-1) or next larger (1); ``missing`` where there is none."""
    if mode == 0:
        t = table.groupBy(*by, F.col(table_at).alias("_at")).agg(F.min(value).alias("found"))
        out = df.join(t.withColumnRenamed("_at", at), [*by, at], "left")
    else:
        out = asof(df, table, by, at, table_at, value, mode)
    return out.withColumn("found", F.coalesce("found", missing))


def sum_until(series: DataFrame, ends: DataFrame, by: list[str], end: str) -> DataFrame:
    """Sum of the values up to each end."""
    return series.join(ends, by).groupBy(*by, end).agg(F.sum(F.when(F.col("period_end") <= F.col(end), F.col("value")).otherwise(0.0)).alias("total"))
