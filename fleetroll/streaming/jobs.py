"""Structured Streaming jobs over the append-only logs.

Every job takes a streaming (or batch) DataFrame and returns one; the caller chooses sink, trigger and checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def budget(calls: DataFrame, limits: DataFrame, buffer: float = 0.1, delay: str = "2 minutes") -> DataFrame:
    """Tokens and calls in 60-second windows every 5 seconds, and whether they pass the model's limit less a buffer.

    The limits are one row a model.
    """
    w = calls.withWatermark("ts", delay).groupBy(F.window("ts", "60 seconds", "5 seconds").alias("w"), "model")
    g = w.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
    over = (F.col("tokens") > F.col("token_limit") * (1 - buffer)) | (F.col("calls") > F.col("call_limit") * (1 - buffer))
    return g.join(limits, "model", "left").select("model", F.col("w.start").alias("start"), "tokens", "calls", F.coalesce(over, F.lit(False)).alias("over"))


def usage_by_day(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    w = calls.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "model")
    return w.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select(F.col("w.start").cast("date").alias("day"), "model", "calls", "tokens")


def sessions(calls: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = calls.withWatermark("ts", gap).groupBy(F.session_window("ts", gap).alias("w"), "session_id")
    return w.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "calls", "tokens")


def stage_durations(runlog: DataFrame, stuck_after_ms: int = 3_600_000, delay: str = "10 minutes") -> DataFrame:
    """(engagement_id, stage, started, micros, status): each start with its end; a start without one in time is stuck.

    The state of a stage is the time of its last start.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            (start,) = state.get
            state.remove()
            rows.append((*key, pd.Timestamp(start, unit="us"), None, "stuck"))
        else:
            start = state.get[0] if state.exists else None
            events = pd.concat(list(frames))
            for at, event in events.sort_values(["at", "id"])[["at", "event"]].itertuples(index=False):
                us = at.value // 1000
                if event == "start":
                    start = us
                elif start is not None and event in ("end", "failed"):
                    if event == "end":
                        rows.append((*key, pd.Timestamp(start, unit="us"), us - start, "done"))
                    start = None
            if start is None:
                if state.exists:
                    state.remove()
            else:
                state.update((start,))
                state.setTimeoutTimestamp(max(start // 1000 + stuck_after_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["engagement_id", "stage", "started", "micros", "status"]).astype({"micros": "Int64"})

    keyed = runlog.withWatermark("at", delay).groupBy("engagement_id", "stage")
    return keyed.applyInPandasWithState(run, "engagement_id long, stage string, started timestamp, micros long, status string", "start long", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_files(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    return files.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(["sha256"])


def ingest_files(path: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the first upload of every content hash, however much later a file comes again.

    The hashes seen are a table under ``path``, by batch and bucket; a batch is held against the buckets it touches, in the
    batches before it, and its new files are written to a folder of its own number.  A batch that is run again sees the
    same ones before it and overwrites its folder, so each file is taken once.  Of equal files in one batch the earliest
    upload counts, then the smaller id; files without a hash are one.  ``known_files`` reads the table.
    """

    def run(batch: DataFrame, number: int) -> None:
        order = F.struct("uploaded_at", "id")
        rest = [c for c in batch.columns if c != "sha256"]
        first = batch.groupBy("sha256").agg(F.min_by(F.struct(*rest), order).alias("d")).select("sha256", "d.*")
        first = first.withColumn("bucket", F.pmod(F.xxhash64("sha256"), F.lit(buckets)).cast("int")).persist()
        known = known_files(batch.sparkSession, path, number)
        if known is not None:
            touched = [r[0] for r in first.select("bucket").distinct().collect()]
            seen = known.where(F.col("bucket").isin(touched)).select(F.col("bucket").alias("_b"), F.col("sha256").alias("_h"))
            new = first.join(seen, (F.col("bucket") == F.col("_b")) & F.col("sha256").eqNullSafe(F.col("_h")), "left_anti")
        else:
            new = first
        new.select(*first.columns).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
        first.unpersist()

    return run


def known_files(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The files taken, with their batch and bucket, of the batches before a number; null where there are none."""
    from pyspark.errors import AnalysisException

    try:
        d = spark.read.parquet(path)
    except AnalysisException:
        return None
    d = d if before is None else d.where(F.col("batch") < before)
    return d if {"batch", "bucket"} <= set(d.columns) else None


def calibration(evidence: DataFrame) -> DataFrame:
    """For complete mode."""
    return evidence.groupBy("agreed").agg(F.count("*").alias("n"), F.sum("correct").cast("long").alias("correct"))


def cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """The stream with its cost; the price list is one row a model."""
    return calls.join(prices, "model", "left").withColumn("cost", F.col("tokens") * F.col("price") / 1e6)


_VERSION = "number long, turn int, bucket int, version string"


def upsert_decisions(path: str, buckets: int = 64, compact_every: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the decision that holds for each key: a person's before an agent's, then the latest.

    Keys are dealt into buckets.  A batch is joined with the current rows of the buckets it touches, and these are
    written to a version of their own and then named as current by rows in ``path/versions``; a reader takes the newest
    row of every bucket, so it sees a whole version of it or the one before.  A batch that is run again names its own
    version again.  Every ``compact_every`` batches ``compact_decisions`` folds the versions.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        b = batch.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in b.select("bucket").distinct().collect()]
        now = _current(spark, path, number, touched)
        both = b if now is None else b.unionByName(now)
        order = F.struct("is_person", "at", "id")
        held = both.groupBy("bucket", "key").agg(F.max_by(F.struct(*[c for c in both.columns if c not in ("key", "bucket")]), order).alias("d")).select("bucket", "key", "d.*")
        if touched:
            _publish(spark, path, held, number, 0, touched)
        b.unpersist()
        if number % compact_every == compact_every - 1:
            compact_decisions(spark, path)

    return run


def _publish(spark, path: str, held: DataFrame, number: int, turn: int, touched: list[int]) -> None:
    version = f"{number}-{turn}-{uuid.uuid4().hex}"
    held.write.partitionBy("bucket").parquet(f"{path}/data/version={version}")
    spark.createDataFrame([(number, turn, k, version) for k in touched], _VERSION).coalesce(1).write.parquet(f"{path}/versions/of={version}")


def _newest(spark, path: str, before: int | None) -> list:
    """The newest version of every bucket, of the batches before a number: a row a bucket."""
    from pyspark.errors import AnalysisException

    try:
        v = spark.read.schema(_VERSION).parquet(f"{path}/versions")
        v = v if before is None else v.where(F.col("number") < before)
        return v.groupBy("bucket").agg(F.max(F.struct("number", "turn", "version")).alias("v")).collect()
    except AnalysisException:
        return []


def _current(spark, path: str, before: int | None, buckets: list[int] | None) -> DataFrame | None:
    """The current rows of the buckets, in one read of their folders."""
    at = [f"{path}/data/version={r['v']['version']}/bucket={r['bucket']}" for r in _newest(spark, path, before) if buckets is None or r["bucket"] in buckets]
    return spark.read.option("basePath", f"{path}/data").parquet(*at).drop("version") if at else None


def current_decisions(spark, path: str) -> DataFrame | None:
    d = _current(spark, path, None, None)
    return None if d is None else d.drop("bucket")


def compact_decisions(spark, path: str) -> None:
    """Folds the versions of all buckets into one, and removes what the fold before this one had left behind.

    What this fold supersedes stays until the next, so that a reader that has begun, and a batch that is run again, still
    find the versions they name.  A fold that fails half-way has named nothing, or leaves folders for a later one.
    """
    newest = _newest(spark, path, None)
    if not newest:
        return
    last = max((r["v"]["number"], r["v"]["turn"]) for r in newest)
    old = {f.getPath().getName() for f in _folder(spark, f"{path}/versions")}
    _publish(spark, path, _current(spark, path, None, None), last[0], last[1] + 1, [r["bucket"] for r in newest])
    fs, at = _file_system(spark, path)
    stale = set()
    for f in _folder(spark, f"{path}/retired"):
        stale |= {r[0] for r in spark.read.schema("name string").parquet(str(f.getPath())).collect()}
        fs.delete(f.getPath(), True)
    for name in stale:
        for d in (f"{path}/versions/{name}", f"{path}/data/{name.replace('of=', 'version=', 1)}"):
            fs.delete(at(d), True)
    left = sorted(n for n in old - stale if n.startswith("of="))
    if left:
        spark.createDataFrame([(n,) for n in left], "name string").coalesce(1).write.parquet(f"{path}/retired/{last[0]}-{last[1] + 1}-{uuid.uuid4().hex}")


def _file_system(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _folder(spark, path: str) -> list:
    fs, at = _file_system(spark, path)
    return list(fs.listStatus(at(path))) if fs.exists(at(path)) else []
