"""Usage, calls, calibration and stage durations from append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost`` in price units a million tokens; null for a model without a price. The price list is one row a model."""
    return calls.join(prices, "model", "left").withColumn("cost", F.col("tokens") * F.col("price") / 1e6)


def usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Totals in all, by model, purpose and day, in one pass; ``unpriced`` counts calls without a price."""
    d = priced(calls, prices).withColumn("day", F.to_date("ts"))
    return d.groupingSets([[], ["model"], ["purpose"], ["day"]], "model", "purpose", "day").agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced")
    )


def sessions(calls: DataFrame, prices: DataFrame) -> DataFrame:
    return priced(calls, prices).groupBy("session_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("model").alias("models"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))


def breakdown(calls: DataFrame) -> DataFrame:
    """Calls, tokens and failures rolled up by purpose and model."""
    return calls.rollup("purpose", "model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum(1 - F.col("ok")).alias("failed"))


def calibration(evidence: DataFrame) -> DataFrame:
    """For each kind of agreement: decisions, right ones and their share to three places."""
    g = evidence.groupBy("agreed").agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("correct"))
    return g.withColumn("share", F.round(F.col("correct") / F.col("n"), 3))


def stage_durations(runlog: DataFrame) -> DataFrame:
    """Each start paired with the next event of its engagement and stage, if that is an end: seconds."""
    w = Window.partitionBy("engagement_id", "stage").orderBy("id")
    d = runlog.where(F.col("event").isin("start", "end", "failed"))
    d = d.withColumn("_next", F.lead("event").over(w)).withColumn("_at", F.lead("at").over(w))
    d = d.where((F.col("event") == "start") & (F.col("_next") == "end"))
    return d.select("engagement_id", "stage", "id", "at", (F.unix_micros(F.col("_at").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))).alias("micros"))


def typical(runlog: DataFrame, last: int = 10) -> DataFrame:
    """An engagement's last duration of a stage, else the upper median of the stage's last ten."""
    d = stage_durations(runlog)
    own = d.groupBy("engagement_id", "stage").agg(F.max_by("micros", "id").alias("own"))
    recent = d.withColumn("_r", F.row_number().over(Window.partitionBy("stage").orderBy(F.col("id").desc()))).where(F.col("_r") <= last)
    w = Window.partitionBy("stage")
    recent = recent.withColumn("_i", F.row_number().over(w.orderBy("micros", "id"))).withColumn("_n", F.count("*").over(w)).where(F.col("_i") == F.floor(F.col("_n") / 2) + 1)
    usual = recent.select("stage", F.col("micros").alias("usual"))
    every = runlog.select("engagement_id", "stage").distinct()
    out = every.join(own, ["engagement_id", "stage"], "left").join(usual, "stage", "left")
    return out.select("engagement_id", "stage", F.coalesce("own", "usual").alias("micros"))
