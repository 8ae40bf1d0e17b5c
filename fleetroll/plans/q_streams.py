"""Streaming jobs run to the end over the event table, held against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetroll.sources.adapters import VIEWS, cte, view
from fleetroll.sources.tables import shared_dir
from fleetroll.streaming import jobs

from .registry import query


def stream(spark, sf: str, name: str) -> DataFrame:
    """A view of the event log as a stream: its rows are put into a folder of the shared place, from which the stream reads."""
    raw = spark.read.parquet(f"{sf}/events.parquet")
    folder = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    raw.write.parquet(folder)
    return spark.sql(VIEWS[name][1], events=spark.readStream.schema(raw.schema).parquet(folder))


def drained(spark, df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns what reached the sink: a table in the shared folder."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out/*")


@query("r2_usage_by_day", f"{cte('calls')} SELECT ts::DATE AS day, model, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens FROM calls GROUP BY 1, 2")
def r2(spark, sf):
    return drained(spark, jobs.usage_by_day(stream(spark, sf, "calls").withColumn("ts", F.col("ts").cast("timestamp"))), "update")


@query("r7_calibration", f"{cte('calls')} SELECT concat(model, '+', purpose) AS agreed, count(*)::BIGINT AS n, sum(ok)::BIGINT AS correct FROM calls GROUP BY 1")
def r7(spark, sf):
    s = stream(spark, sf, "calls").select(F.concat_ws("+", "model", "purpose").alias("agreed"), F.col("ok").alias("correct"))
    return drained(spark, jobs.calibration(s), "complete")


@query("r8_cost", f"{cte('calls', 'prices')} SELECT id, model, round(tokens * price / 1e6, 8) AS cost FROM calls LEFT JOIN prices USING (model)")
def r8(spark, sf):
    return drained(spark, jobs.cost(stream(spark, sf, "calls"), view(spark, sf, "prices")).select("id", "model", F.round("cost", 8).alias("cost")))
