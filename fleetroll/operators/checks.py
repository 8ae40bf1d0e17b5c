"""Checks that say when a value should not be trusted, and decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def close(a: Column, b: Column, tol: float = 1e-9) -> Column:
    return F.abs(a - b) <= tol * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def stale(prior: DataFrame, current: DataFrame, by: list[str], after: Column) -> DataFrame:
    """Groups whose values equal last year's in all of two shared periods or more after the date."""
    j = prior.select(*by, "period_end", F.col("value").alias("_p")).join(current.select(*by, "period_end", F.col("value").alias("_c")), [*by, "period_end"]).where(F.col("period_end") > after)
    g = j.groupBy(*by).agg(F.count("*").alias("periods"), F.count_if(close(F.col("_p"), F.col("_c"))).alias("equal"))
    return g.where("periods >= 2").withColumn("stale", F.col("periods") == F.col("equal"))


def stale_forecast(prior: DataFrame, current: DataFrame, reads: DataFrame, changes: DataFrame, by: list[str], after: Column) -> DataFrame:
    """Forecasts that are last year's, and whether they should be: (by, periods, equal, changed_rows, finding).

    ``reads(by, row)`` are the client rows a forecast is worked out from, ``changes(row)`` those whose values differ between
    the two years' models.  Equal in all of two shared periods or more after the date: 'block' if rows it reads have
    changed, as they didn't get through, else 'check'; null for a forecast that has moved.
    """
    g = stale(prior, current, by, after)
    n = reads.join(changes.select("row").distinct(), "row", "left_semi").groupBy(*by).agg(F.count_distinct("row").alias("_n"))
    d = g.join(n, by, "left").withColumn("changed_rows", F.coalesce("_n", F.lit(0)))
    return d.select(*by, "periods", "equal", "changed_rows", F.when(F.col("stale"), F.when(F.col("changed_rows") > 0, "block").otherwise("check")).alias("finding"))


def sign_flip(pv: DataFrame, before: str, after: str, total: str, share: float = 0.01) -> DataFrame:
    """PVs that change sign while both are more than ``share`` of the value."""
    big = lambda c: F.abs(c) > share * F.abs(total)
    return pv.withColumn("flips", (F.signum(before) * F.signum(after) < 0) & big(F.col(before)) & big(F.col(after)))


def uncut(factored: DataFrame, new_date: Column) -> DataFrame:
    """Cash flows up to the new date that still count: periods and their value per core."""
    return factored.where((F.col("period_end") <= new_date) & (F.col("cf") * F.col("factor") != 0)).groupBy("core_id").agg(F.count("*").alias("periods"), F.sum(F.col("cf") * F.col("factor")).alias("value"))


def mid_period(flows: DataFrame, dates: DataFrame, slack: int = 3) -> DataFrame:
    """Dates strictly inside a period, more than ``slack`` days off either end: start, end and fraction elapsed."""
    w = Window.partitionBy("core_id").orderBy("period_end")
    p = flows.withColumn("start", F.lag("period_end").over(w)).where("start is not null").join(dates, "core_id")
    p = p.where((F.date_diff("new_date", "start") > slack) & (F.date_diff("period_end", "new_date") > slack))
    return p.select("core_id", "start", "period_end", (F.date_diff("new_date", "start") / F.date_diff("period_end", "start")).alias("elapsed"))


def inputs_moved(last: DataFrame, this: DataFrame, on: list[str]) -> DataFrame:
    """Input cells that differ between the versions."""
    j = last.select(*on, F.col("value").alias("last")).join(this.select(*on, F.col("value").alias("this")), on)
    return j.where(~close(F.col("last"), F.col("this")))


def current_decisions(log: DataFrame, files: DataFrame) -> DataFrame:
    """The decision that holds for each key: a person's before an agent's, then the latest; it lapses with other files."""
    d = log.join(files, "key").where(F.col("files_key") == F.col("current_files_key"))
    w = Window.partitionBy("key").orderBy(F.col("is_person").desc(), F.col("at").desc(), F.col("id").desc())
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1 and value is not null").select("key", "value", "is_person", "at")


def fingerprint(figures: Column, files_key: Column) -> Column:
    """The first 12 hex digits of a hash of the figures, to six significant digits, and the files."""
    def six(v: Column) -> Column:
        e = F.floor(F.log10(F.abs(v)))
        return F.when(v == 0, F.lit("0")).otherwise(F.concat_ws("e", F.round(v / F.pow(F.lit(10.0), e - 5)).cast("long").cast("string"), e.cast("string")))

    return F.substring(F.sha1(F.concat_ws("|", F.transform(figures, six), files_key)), 1, 12)


def apply_acks(findings: DataFrame, acks: DataFrame) -> DataFrame:
    """``status`` of each finding: acknowledged for the same fingerprint, lapsed for another, else open."""
    a = acks.groupBy("id").agg(F.collect_set("ack_key").alias("_a"))
    j = findings.join(a, "id", "left")
    return j.withColumn("status", F.when(F.array_contains("_a", F.col("key")), "acknowledged").when(F.col("_a").isNotNull(), "lapsed").otherwise("open")).drop("_a")


def validate(computed: DataFrame, saved: DataFrame, on: list[str], tol: float = 1e-7) -> DataFrame:
    """Computed against saved cells: matched, mismatched and missing on either side."""
    j = computed.select(*on, F.col("value").alias("_c")).join(saved.select(*on, F.col("value").alias("_s")), on, "full")
    same = F.coalesce(close(F.col("_c"), F.col("_s"), tol), F.lit(False))
    both = F.col("_c").isNotNull() & F.col("_s").isNotNull()
    return j.groupBy("workbook_id").agg(F.count_if(same).alias("matched"), F.count_if(both & ~same).alias("mismatched"), F.count_if(F.col("_c").isNull()).alias("not_computed"), F.count_if(F.col("_s").isNull()).alias("not_saved"))
