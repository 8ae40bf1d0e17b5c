"""Aggregations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetroll.functions.dates import fy_year


def annual(series: DataFrame, method: Column, by: list[str], fy_end: int = 12, periods: int = 12) -> DataFrame:
    """A series by financial year: first, last, average or sum; years with fewer periods are partial."""
    d = series.withColumn("fy", fy_year(F.col("period_end"), fy_end)).withColumn("_m", method)
    g = d.groupBy(*by, "fy").agg(
        F.first("_m").alias("method"),
        F.sum("value").alias("_s"),
        F.avg("value").alias("_a"),
        F.min_by("value", "period_end").alias("_f"),
        F.max_by("value", "period_end").alias("_l"),
        F.count("*").alias("n"),
    )
    v = F.when(F.col("method") == "first", F.col("_f")).when(F.col("method") == "last", F.col("_l")).when(F.col("method") == "average", F.col("_a")).otherwise(F.col("_s"))
    return g.withColumn("value", v).withColumn("partial", F.col("n") < periods).drop("_s", "_a", "_f", "_l", "n")


def flows_by_fy(flows: DataFrame, dates: DataFrame, fy_end: int) -> DataFrame:
    """Two versions' flows after their dates by financial year, side by side. ``flows`` has ``feed`` last or this, ``dates`` a row for each."""
    # two keys: a shuffle by them would leave all flows to two tasks
    d = flows.join(F.broadcast(dates), "feed").where("period_end > valuation_date").withColumn("fy", fy_year(F.col("period_end"), fy_end))
    return d.groupBy("core_id", "fy").agg(F.sum(F.when(F.col("feed") == "last", F.col("cf"))).alias("last"), F.sum(F.when(F.col("feed") == "this", F.col("cf"))).alias("this"))


def after_date(series: DataFrame, date: Column, by: list[str]) -> DataFrame:
    """Rows summed by period, then after the date: total, last value, first and last end, count."""
    p = series.where(F.col("period_end") > date).groupBy(*by, "period_end").agg(F.sum("value").alias("value"))
    return p.groupBy(*by).agg(
        F.sum("value").alias("total"), F.max_by("value", "period_end").alias("last_value"), F.min("period_end").alias("first_end"), F.max("period_end").alias("last_end"), F.count("*").alias("periods")
    )


def side_by_side(metrics: DataFrame, by: list[str], sources: list[str], share: float = 0.001) -> DataFrame:
    """Metrics of several sources in columns, flagged where their spread passes ``share`` of the largest."""
    p = metrics.groupBy(*by).pivot("source", sources).agg(F.sum("metric"))
    hi, lo = F.greatest(*sources), F.least(*sources)
    return p.withColumn("disagree", hi - lo > share * F.greatest(F.abs(hi), F.abs(lo)))


def criterion(text: str, col: Column) -> Column:
    """A spreadsheet criterion such as '>=5', '<>x' or 'a*' as a condition; case aside, with * ? and ~."""
    op, rest = re.match(r"(>=|<=|<>|>|<|=)?(.*)", text, re.S).groups()
    try:
        n: float | None = float(rest)
    except ValueError:
        n = None
    if n is not None:
        x = col.cast("double")
        return {">=": x >= n, "<=": x <= n, "<>": (x != n) | x.isNull(), ">": x > n, "<": x < n}.get(op, x == n)
    if op in (">", "<", ">=", "<="):
        s = F.lower(col)
        return {">": s > rest.lower(), "<": s < rest.lower(), ">=": s >= rest.lower(), "<=": s <= rest.lower()}[op]
    pattern = "".join(re.escape(m[1]) if m[1] else {"*": ".*", "?": "."}.get(m[0], re.escape(m[0])) for m in re.finditer(r"~(.)|.", rest.lower(), re.S))
    same = F.lower(col).rlike(f"(?s)^{pattern}$")
    return ~same | col.isNull() if op == "<>" else same


def ifs(df: DataFrame, target: str, criteria: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """sum, average, count, max and min of the target where all criteria hold. Nothing found: 0, but a null average."""
    ok = F.lit(True)
    for c, text in criteria:
        ok = ok & criterion(text, F.col(c))
    v = F.when(ok, F.col(target))
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(
        F.coalesce(F.sum(v), zero).alias("sumifs"), F.avg(v).alias("averageifs"), F.count_if(ok).alias("countifs"), F.coalesce(F.max(v), zero).alias("maxifs"), F.coalesce(F.min(v), zero).alias("minifs")
    )


def stats(df: DataFrame, by: list[str], value: str, err: str | None = None, pos: str | None = None) -> DataFrame:
    """Median, deviations, variance, product, squares and counts. An error in a group is its result, the first by place."""
    x = F.col(value)
    aggs = {
        "median": F.median(x),
        "stdev": F.when(F.count(x) > 1, F.stddev_samp(x)),
        "stdevp": F.stddev_pop(x),
        "var": F.when(F.count(x) > 1, F.var_samp(x)),
        "product": F.product(x),
        "sumsq": F.sum(x * x),
    }
    bad = F.min_by(F.col(err), F.when(F.col(err).isNotNull(), F.col(pos))) if err else F.lit(None).cast("string")
    clean = {k: F.when(bad.isNull(), v) for k, v in aggs.items()} if err else aggs
    counta = F.count_if(x.isNotNull() | (F.col(err).isNotNull() if err else F.lit(False)))
    return df.groupBy(*by).agg(*[v.alias(k) for k, v in clean.items()], F.count(x).alias("count"), counta.alias("counta"), bad.alias("err"))


def sumproduct(series: DataFrame, by: list[str], a: int, b: int) -> DataFrame:
    """Sum over periods of row a times row b; what isn't a number counts 0."""
    x = series.where(F.col("row_no") == a).groupBy(*by, "period_end").agg(F.sum("value").alias("_a"))
    y = series.where(F.col("row_no") == b).groupBy(*by, "period_end").agg(F.sum("value").alias("_b"))
    return x.join(y, [*by, "period_end"], "full").groupBy(*by).agg(F.sum(F.coalesce("_a", F.lit(0.0)) * F.coalesce("_b", F.lit(0.0))).alias("sumproduct"))


def display_sign(series: DataFrame, by: list[str]) -> DataFrame:
    """-1 where every non-zero value of the group is negative and there is one; ``shown`` is the value so signed."""
    w = Window.partitionBy(*by)
    all_neg = (F.count_if(F.col("value") < 0).over(w) > 0) & (F.count_if(F.col("value") > 0).over(w) == 0)
    return series.withColumn("sign", F.when(all_neg, -1).otherwise(1)).withColumn("shown", F.col("value") * F.col("sign"))
