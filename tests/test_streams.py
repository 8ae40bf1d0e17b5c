"""Streams give the batch result on the same events; late and repeated ones too."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from fleetroll.plans.q_streams import drained
from fleetroll.sources.tables import shared_dir
from fleetroll.streaming import jobs

T0 = datetime(2024, 1, 1)


def source(spark, rows, schema, name):
    path = f"{shared_dir(spark)}/in-{name}-{id(rows)}"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_budget_flags_a_minute_over_the_limit(spark):
    rows = [[(T0 + timedelta(seconds=s), "m", 40) for s in (1, 2, 3)] + [(T0 + timedelta(hours=1), "m", 1)], [(T0 + timedelta(hours=2), "m", 1)]]
    s = source(spark, rows, "ts timestamp, model string, tokens long", "budget")
    limits = spark.createDataFrame([("m", 130, 100)], "model string, token_limit long, call_limit long")
    got = [r.asDict() for r in drained(spark, jobs.budget(s, limits)).collect()]
    full = [r for r in got if r["tokens"] == 120]
    assert full and all(r["over"] for r in full) and not any(r["over"] for r in got if r["tokens"] < 100)


def test_stage_durations_pairs_and_times_out(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [[(1, at(0), 7, "match", "start"), (2, at(5), 7, "match", "end"), (3, at(6), 8, "match", "start")], [(4, at(300), 9, "value", "note")], [(5, at(600), 9, "value", "note")]]
    s = source(spark, rows, "id long, at timestamp, engagement_id long, stage string, event string", "stages")
    got = {(r["engagement_id"], r["status"]): r["micros"] for r in drained(spark, jobs.stage_durations(s)).collect()}
    assert got[7, "done"] == 300_000_000 and (8, "stuck") in got


def test_dedup_keeps_one_of_a_hash(spark):
    s = source(spark, [[("a", T0), ("b", T0)], [("a", T0 + timedelta(minutes=5))]], "sha256 string, uploaded_at timestamp", "files")
    assert sorted(r["sha256"] for r in drained(spark, jobs.dedup_files(s)).collect()) == ["a", "b"]


def test_upsert_keeps_the_latest_decision(spark):
    path = f"{shared_dir(spark)}/decisions-{pd.Timestamp.now().value}"
    put = jobs.upsert_decisions(path)
    frame = lambda rows: spark.createDataFrame(rows, "id long, key string, value string, at timestamp, is_person boolean")
    put(frame([(1, "x", "a", T0, False), (2, "y", "b", T0, False), (9, "z", "person", T0, True)]), 0)
    second = frame([(3, "x", "c", T0 + timedelta(days=1), False), (4, "y", "old", T0 - timedelta(days=1), False), (5, "z", "agent", T0 + timedelta(days=2), False)])
    put(second, 1)
    put(second, 1)  # a batch run again
    put(frame([(6, "w", "new", T0, True)]), 2)
    assert {r["key"]: r["value"] for r in jobs.current_decisions(spark, path).collect()} == {"w": "new", "x": "c", "y": "b", "z": "person"}


def test_ingest_takes_a_file_once_however_late_it_comes_again(spark):
    path = f"{shared_dir(spark)}/files-{pd.Timestamp.now().value}"
    put = jobs.ingest_files(path, buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "id long, sha256 string, uploaded_at timestamp")
    put(frame([(1, "a", T0), (2, "b", T0), (3, "a", T0 - timedelta(minutes=1))]), 0)
    again = frame([(4, "a", T0 + timedelta(days=9)), (5, "c", T0 + timedelta(days=9)), (6, None, T0)])
    put(again, 1)
    put(again, 1)  # a batch run again
    put(frame([]), 2)
    put(frame([(7, "b", T0 + timedelta(days=99)), (8, "c", T0 + timedelta(days=99)), (9, None, T0 + timedelta(days=99))]), 3)
    assert sorted((r["sha256"] or "", r["id"]) for r in jobs.known_files(spark, path).collect()) == [("", 6), ("a", 3), ("b", 2), ("c", 5)]


def test_folding_decisions_keeps_the_table_and_one_older_snapshot(spark):
    path = f"{shared_dir(spark)}/decisions-{pd.Timestamp.now().value}"
    put = jobs.upsert_decisions(path, buckets=4, compact_every=1000)
    batch = lambda n: spark.createDataFrame([(10 * n + i, f"k{(n + i) % 7}", f"v{n}.{i}", T0 + timedelta(hours=n), False) for i in range(3)], "id long, key string, value string, at timestamp, is_person boolean")
    want = {}
    for n in range(9):
        put(batch(n), n)
        want |= {f"k{(n + i) % 7}": f"v{n}.{i}" for i in range(3)}
        if n in (2, 5):
            reader = jobs.current_decisions(spark, path)
            before = dict(want)
            jobs.compact_decisions(spark, path)
            assert {r["key"]: r["value"] for r in reader.collect()} == before  # a reader from before the fold
            put(batch(n), n)  # a batch run again after it
        assert {r["key"]: r["value"] for r in jobs.current_decisions(spark, path).collect()} == want
    for _ in range(3):
        jobs.compact_decisions(spark, path)
    assert {r["key"]: r["value"] for r in jobs.current_decisions(spark, path).collect()} == want
    assert len(jobs._folder(spark, f"{path}/data")) <= 3


def test_fit_factors_reads_parameters_back(spark, sf):
    from fleetroll.plans import registry
    from fleetroll.sources.adapters import view

    got = registry.queries()["v5_fit_factors"](spark, sf).join(view(spark, sf, "discountings").select("core_id", F.col("rate").alias("want"), "valuation_date"), "core_id")
    off = got.where((F.abs(F.col("rate") - F.col("want")) > 1e-6) & (F.col("date") == F.col("valuation_date"))).count()
    assert got.count() > 0 and off == 0


def test_irr_of_known_flows(spark):
    from datetime import date

    from fleetroll.operators import fin

    rows = [(1, date(2020, 1, 1), -100.0), (1, date(2021, 1, 1), 110.0), (2, date(2020, 1, 1), 5.0), (2, date(2021, 1, 1), 5.0)]
    got = {r["core_id"]: r["irr"] for r in fin.irr(spark.createDataFrame(rows, "core_id long, period_end date, cf double")).collect()}
    assert abs(got[1] - 0.1) < 1e-9 and got[2] is None


def test_criteria():
    from fleetroll.operators.agg import criterion
    from pyspark.sql import functions as F

    assert "rlike" in str(criterion("a*~*", F.lit("ab*"))).lower()
