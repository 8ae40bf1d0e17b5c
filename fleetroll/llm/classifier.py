"""Quality classifier: histogram gradient-boosted trees over document statistics, as flat arrays walked by numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, plain, sliced

# ---------------------------------------------------------------- statistics of a text

_KINDS = ["lower", "upper", "digit", "blank", "newline", "wide", "symbol", "stop", "comma", "bang", "other"]
_KIND = np.full(256, _KINDS.index("other"), np.uint8)
for _name, _bytes in {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": b" \t\x0b\x0c\r",
    "newline": b"\n",
    "wide": range(128, 256),
    "symbol": b"#*$%&|<>",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
}.items():
    _KIND[list(_bytes)] = _KINDS.index(_name)
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)

#: The columns of ``statistics``: shares of bytes by kind, then what words, lines and repetition give.
STATISTICS = [
    *(f"{k}_share" for k in _KINDS),
    "log_words",
    "mean_word",
    "word_spread",
    "short_words",
    "long_words",
    "upper_words",
    "symbols_a_word",
    "stops_a_word",
    "bangs_a_word",
    "distinct_words",
    "same_as_before",
    "distinct_pairs",
    "words_a_line",
    "repeated_lines",
]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different values of ``h`` each of the n documents has, told apart by the bits that the document's number leaves."""
    if not len(h):
        return np.zeros(n)
    low = np.uint64(64 - max(n - 1, 1).bit_length())
    key = np.sort((doc.astype(np.uint64) << low) | (mix64(h) >> (np.uint64(64) - low)))
    return np.bincount((key[np.append(True, key[1:] != key[:-1])] >> low).astype(np.int64), minlength=n)


def statistics(col: pa.Array) -> np.ndarray:
    """One row of STATISTICS for every text, all bytes of it read; null and empty texts have zeros."""
    w = Words(col, lower=False)
    n = w.n
    kinds = np.zeros((n, len(_KINDS)))
    newline = _KINDS.index("newline")
    repeated = np.zeros(n)
    for i in range(n):
        raw = w.data[w.offsets[i] : w.offsets[i + 1]]
        kinds[i] = np.bincount(_KIND[raw], minlength=len(_KINDS))
        if kinds[i, newline]:
            lines = [x for x in raw.tobytes().split(b"\n") if x]
            repeated[i] = 1 - len(set(lines)) / max(len(lines), 1)
    size = w.ends - w.starts
    words = np.bincount(w.doc, minlength=n)
    one = np.maximum(words, 1)
    by = lambda x: np.bincount(w.doc, weights=x, minlength=n)
    up = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_UPPER[w.data], out=up[1:])
    uppers = up[w.ends] - up[w.starts]
    mean = by(size) / one
    spread = np.sqrt(np.maximum(by(size.astype(float) ** 2) / one - mean**2, 0))
    h = w.hash
    next_to = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if len(h) > 1 else np.zeros(0, np.int64)
    same = np.bincount(w.doc[next_to], weights=h[next_to] == h[next_to + 1], minlength=n) if len(next_to) else np.zeros(n)
    pairs = _distinct(w.doc[next_to], h[next_to] * np.uint64(0x9E3779B97F4A7C15) + h[next_to + 1], n)
    share = kinds / np.maximum(kinds.sum(1, keepdims=True), 1)
    kind = lambda k: kinds[:, _KINDS.index(k)]
    return np.column_stack(
        [
            share,
            np.log1p(words),
            mean,
            spread,
            by(size <= 2) / one,
            by(size > 16) / one,
            by((uppers == size) & (size > 1)) / one,
            kind("symbol") / one,
            kind("stop") / one,
            kind("bang") / one,
            _distinct(w.doc, h, n) / one,
            same / one,
            pairs / np.maximum(words - 1, 1),
            words / (kind("newline") + 1),
            repeated,
        ]
    ).astype(np.float32)


# ---------------------------------------------------------------- trees


@dataclass
class Trees:
    """Complete binary trees of one depth, level by level in flat arrays: node i has the children 2i + 1 and 2i + 2.

    A node that doesn't split has the threshold infinity, so every row goes left.
    """

    depth: int
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row: all trees step down together, a level at a time."""
        t = np.arange(len(self.feature))
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(t)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.threshold[t, at])
        margin = self.base + self.leaf[t, at - ((1 << self.depth) - 1)].sum(1) if len(t) else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.1, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosts logistic loss: statistics are cut into at most ``bins`` bins at quantiles, splits come from histograms.

    A side of a split has at least ``least`` rows.  Without rows, or with one label only, no tree splits and all
    scores are the share of label 1 with one row of each label added.
    """
    p = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(p / (1 - p)))
    n, k = x.shape
    if n == 0 or y.min() == y.max():
        return Trees(depth, base, np.zeros((0, (1 << depth) - 1), np.int64), np.zeros((0, (1 << depth) - 1), np.float32), np.zeros((0, 1 << depth)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)])
    columns = np.arange(k) * bins
    margin = np.full(n, base)
    feature, threshold, leaves = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, q * (1 - q)
        node = np.zeros(n, np.int64)
        f, t = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf, np.float32)
        for level in range(depth):
            wide = 1 << level
            cell = ((node[:, None] * k * bins) + columns + binned).ravel()
            g, h, c = (np.bincount(cell, np.repeat(v, k), wide * k * bins).reshape(wide, k, bins).cumsum(2) for v in (grad, hess, np.ones(n)))
            all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(c < least) | (all_c - c < least)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            split = gain.reshape(wide, -1)[np.arange(wide), best] > 1e-9
            own, cut = best // bins, best % bins
            for i in np.flatnonzero(split):
                f[wide - 1 + i], t[wide - 1 + i] = own[i], edges[own[i]][cut[i]]
            right = split[node] & (binned[np.arange(n), own[node]] > cut[node])
            node = 2 * node + right
        value = rate * np.bincount(node, grad, 1 << depth) / (np.bincount(node, hess, 1 << depth) + ridge)
        margin += value[node]
        feature.append(f)
        threshold.append(t)
        leaves.append(value)
    return Trees(depth, base, np.array(feature), np.array(threshold), np.array(leaves))


# ---------------------------------------------------------------- on Spark


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo ``folds``, is 0. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        x = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("y"), b.column("h"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["y", "h", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> Trees:
    """Trees from at most ``max_rows`` labelled documents outside the held-out fold, chosen by a hash of their ids.

    ``labels(doc_id, quality)``; a document with several labels has their mean, rounded up; null labels don't count.
    Only these documents' texts are read for it, and the driver gets one row of statistics each: 2.5 MB at 20,000.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    own = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
    rows = own.mapInArrow(_measured, "y double, h long, x array<float>").orderBy("h", "y").limit(max_rows).toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)) if rows.num_rows else np.zeros((0, len(STATISTICS)), np.float32)
    return fit(x, rows["y"].to_numpy(), **options)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with ``score``, the probability of label 1 from the whole text; null and empty texts have one too."""
    own = plain(docs, "score")
    schema = own.select(*[F.col(f"`{c}`") for c in own.columns], F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            s = trees.scores(statistics(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "score"])

    return own.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3, max_rows: int = 20_000) -> DataFrame:
    """``docs`` with held_out, score and predicted (1 where the score is ``least`` or more), which replace columns of these names.

    Neither labels nor lang, source or doc_id are inputs of a score.  Rows repeated in the input are repeated in the
    output; an empty table gives no rows; without labels every score is 0.5.
    """
    given = plain(docs, "held_out", "score", "predicted")
    scored = score(given, train(docs, labels, max_rows))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= least).cast("int")}).select(*[F.col(f"`{c}`") for c in given.columns], "held_out", "score", "predicted")
