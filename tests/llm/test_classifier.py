import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("fleetroll.llm")

from fleetroll.llm import classifier  # noqa: E402

from .cases import documents, frame  # noqa: E402


def by_steps(trees, row):
    """One row through one tree after another, node by node."""
    margin = trees.base
    for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + (2 if row[f[at]] > t[at] else 1)
        margin += leaf[at - len(f)]
    return 1 / (1 + np.exp(-margin))


def test_trees():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    x[:, 5] = 1  # a column that says nothing
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = classifier.fit(x[:2000], y[:2000])
    s = trees.scores(x[2000:])
    assert np.mean((s >= 0.5) == y[2000:]) > 0.95
    assert np.allclose(s[:50], [by_steps(trees, r) for r in x[2000:2050]])
    assert not (trees.feature[np.isfinite(trees.threshold)] == 5).any()
    assert np.allclose(classifier.fit(x[:0], y[:0]).scores(x[:3]), 0.5)
    assert np.allclose(classifier.fit(x[:8], np.ones(8)).scores(x[:3]), 0.9)


def test_statistics():
    name = {n: i for i, n in enumerate(classifier.STATISTICS)}
    got = classifier.statistics(pa.array(["AB ab ab!\nAB ab ab!\n#x", None, "", "é" * 300]))
    assert not got[1].any() and not got[2].any()
    r = got[0]
    assert r[name["log_words"]] == pytest.approx(np.log(8)) and r[name["upper_words"]] == pytest.approx(2 / 7)
    assert r[name["distinct_words"]] == pytest.approx(4 / 7) and r[name["bangs_a_word"]] == pytest.approx(2 / 7)
    assert r[name["repeated_lines"]] == pytest.approx(1 / 3) and r[name["distinct_pairs"]] == pytest.approx(4 / 6)
    assert got[3][name["wide_share"]] == 1 and got[3][name["long_words"]] == 1
    whole = pa.array([t for _, t in documents()])
    assert np.allclose(classifier.statistics(whole)[3:9], classifier.statistics(whole.slice(3, 6)), atol=1e-6)


def test_held_out_accuracy(spark, sf):
    """Learned on the other folds, at least 19 of 20 held-out labels are met, and good and bad ones alike."""
    labels = spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    rows = classifier.classify(docs, labels).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows) and len(rows) > 50
    good, bad = ([r["predicted"] == r["quality"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean(good) > 0.97 and np.mean(bad) > 0.8


def test_labels_of_the_held_out_fold_do_not_count(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "CC"]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0)) for i, _ in rows], "doc_id long, quality int")
    a, b = ({r["doc_id"]: r["score"] for r in classifier.classify(docs, label(f)).collect()} for f in (False, True))
    assert a == b


def test_odd_rows(spark):
    """Null ids and texts, empty and long texts, repeats, clashing columns, no labels, no rows."""
    rows = documents()
    docs = frame(spark, rows).withColumn("score", docs_score())
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None), (None, 1), (5, 0), (9, 1), (999, 1)], "doc_id long, quality int")
    got = classifier.classify(docs, labels)
    assert got.columns == ["doc_id", "text", "_id", "n_words", "kept_text", "size", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert all(not r["held_out"] for r in out if r["doc_id"] is None)
    assert {r["score"] for r in classifier.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert classifier.classify(docs.limit(0), labels).collect() == []


def docs_score():
    from pyspark.sql import functions as F

    return F.lit("own")
