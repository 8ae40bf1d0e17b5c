"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, hot_keys, packed, unpacked, written
from .numbering import buckets_for, numbered

#: Group sizes below EXACT, and the LARGEST sizes that occur, are classes of their own; between them 1024 classes to a doubling.
EXACT, LARGEST, FINE = 16_384, 65_536, 1024


def size_class(size: str, top: int) -> str:
    """SQL: a size's class.  Sizes from ``top`` on are exact; classes of the three kinds are numbered apart and in order."""
    between = f"{EXACT} + cast(floor(log2({size} / {EXACT}.0D) * {FINE}) AS bigint)"
    return f"CASE WHEN {size} < {EXACT} THEN {size} WHEN {size} >= {top} THEN {1 << 17} + {size} ELSE {between} END"


def top_sizes(totals: DataFrame, most: int) -> int:
    """The size from which on no more than ``most`` different sizes occur, or EXACT where there are no more above that."""
    large = totals.where(F.col("total") >= EXACT).select("total").distinct().orderBy(F.col("total").desc()).limit(most + 1)
    r = large.agg(F.count("*"), F.min("total")).first()
    return EXACT if r[0] <= most else r[1] + 1


def schedule(classes: list[tuple[int, int, int]], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places classes (class, groups, bytes), largest groups first, each group on the least-loaded shard.

    Returns runs (class, first rank, shard).  Equal groups are dealt in whole rounds while the heap's order allows it,
    so the work grows with the number of classes and not with that of groups; the loads are those of one heap pop a
    group, where the groups of a class are of one size.
    """
    heap = [(0.0, s) for s in range(shards)]
    out: list[tuple[int, int, int]] = []
    for cls, n, total in sorted(classes, key=lambda c: (-c[2] / c[1], -c[0])):
        size = total / n
        given = [0] * shards
        if n > 4 * shards:  # water-filling: raise all shards to the highest level that n groups can reach
            load = np.array([x for x, _ in sorted(heap, key=lambda h: h[1])])
            lo, hi = load.min(), load.max() + size * n
            for _ in range(100):
                level = (lo + hi) / 2
                if np.maximum(0, np.floor((level - load) / size)).sum() <= n - shards:
                    lo = level
                else:
                    hi = level
            fill = np.maximum(0, np.floor((lo - load) / size)).astype(np.int64)
            if fill.sum() <= n:
                given = fill.tolist()
                heap = [(float(load[s] + size * fill[s]), s) for s in range(shards)]
                heapq.heapify(heap)
                n -= int(fill.sum())
        for _ in range(n):
            load1, s = heapq.heappop(heap)
            given[s] += 1
            heapq.heappush(heap, (load1 + size, s))
        rank = 0
        for s in range(shards):
            if given[s]:
                out.append((cls, rank, s))
                rank += given[s]
    runs = np.array(sorted(out), np.int64).reshape(-1, 3)
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _placed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, rank, shard = shared.value
        known, number = np.unique(cls, return_inverse=True)
        key = number << 44 | rank
        for b in batches:
            own = np.searchsorted(known, b.column("cls").to_numpy())
            at = np.searchsorted(key, own << 44 | b.column("rank").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column("gh"), b.column("size"), pa.array(shard[at].astype(np.int32))], names=["gh", "size", "shard"])

    return run


def lpt_shards(docs: DataFrame, shards: int = 40, overhead: int = 16, largest: int = LARGEST) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot (gapless from 0 within a shard).

    A document's size is its UTF-8 bytes plus ``overhead``; documents of equal text are a group and share a shard.
    Groups are placed by longest processing time first.  What reaches the driver is a histogram of group sizes: those
    below 16 KB, the ``largest`` different sizes above it, and between the two, if there are more, classes of a
    thousandth of a doubling, whose groups count with their mean.  A null text is a text of no bytes, and in the group
    of the empty text.  Null ids and repeated rows are rows like others.  Columns with the name of a result give way.
    """
    given, docs = docs, packed(docs)
    d = docs.withColumn("_t", F.coalesce("text", F.lit("")).cast("binary"))
    d = d.withColumns({"size": (F.octet_length("_t") + overhead).cast("long"), "gh": F.xxhash64("_t"), "text_crc32": F.crc32("_t")}).drop("_t")
    groups = d.groupBy("gh", "size").agg(F.count("*").alias("copies")).withColumn("total", F.col("copies") * F.col("size"))
    groups = written(groups, "groups")
    groups = groups.withColumn("cls", F.expr(size_class("total", top_sizes(groups, largest))))
    hist = [(r[0], r[1], r[2]) for r in groups.groupBy("cls").agg(F.count("*"), F.sum("total")).collect()]
    shared = d.sparkSession.sparkContext.broadcast(schedule(hist, shards))
    ranked = numbered(groups.select("gh", "size", "cls"), "cls", ["gh", "size"], "rank", buckets_for(sum(h[1] for h in hist)))
    placed = ranked.select("gh", "size", "cls", "rank").mapInArrow(_placed(shared), "gh long, size long, shard int")
    # by a row's place, as copies of a text may share an id or have none
    d = d.withColumn("_row", F.monotonically_increasing_id())
    out = dealt(d, placed, ["gh", "size"], hot_keys(groups, ["gh", "size"], "copies"), ["_row"]).drop("gh", "_row")
    out = numbered(out, "shard", ["doc_id", "size", "text_crc32"], "slot", buckets_for(docs.count()))
    return unpacked(out, given, "size", "text_crc32", "shard", "slot")
