"""Intermediates and files: written tables, loads, logs, content-hash dedup, patches, redaction, workpapers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where none is set, a new one, in local mode only."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="fleetroll-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_tables(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Model tables under one path, each read with its own schema."""
    return {name: spark.read.schema(s).parquet(f"{path}/{name}") for name, s in schemas.items()}


def read_log(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False) -> DataFrame:
    """Line JSON; lines that aren't JSON are skipped."""
    r = spark.readStream if streaming else spark.read
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return r.schema(full).json(path, mode="PERMISSIVE").where("_corrupt_record is null").drop("_corrupt_record")


def dedup_files(files: DataFrame) -> DataFrame:
    """The first upload of every content hash."""
    w = Window.partitionBy("sha256").orderBy("uploaded_at", "id")
    return files.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def patch_cells(cells: DataFrame, patch: DataFrame, on: list[str], value: str) -> DataFrame:
    """``cells`` with some values replaced; the patch's key is unique."""
    p = patch.select(*on, F.col(value).alias("_p"), F.lit(True).alias("patched"))
    return cells.join(p, on, "left").withColumn(value, F.when(F.col("patched"), F.col("_p")).otherwise(F.col(value))).withColumn("patched", F.coalesce("patched", F.lit(False))).drop("_p")


def redact(df: DataFrame, vocab: DataFrame, column: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Texts outside the vocabulary become <redacted>; dates and hex hashes pass. And the counts per group."""
    v = vocab.select(F.col("word").alias(column)).distinct().withColumn("_in", F.lit(True))
    fine = F.col("_in") | F.col(column).rlike(r"^\d{4}-\d{2}-\d{2}$|^[0-9a-f]{12,64}$") | F.col(column).isNull()
    d = df.join(v, column, "left").withColumn("_ok", F.coalesce(fine, F.lit(False)))
    return d.withColumn(column, F.when(F.col("_ok"), F.col(column)).otherwise("<redacted>")).drop("_in", "_ok"), d.groupBy(by).agg(F.count_if(~F.col("_ok")).alias("redacted"))


def write_workpaper(bridge: DataFrame, path: str) -> None:
    """Steps by low, mid and high, a folder for each engagement."""
    bridge.groupBy("engagement_id", "step").pivot("end", ["low", "mid", "high"]).agg(F.first("value")).write.partitionBy("engagement_id").mode("overwrite").parquet(path)
