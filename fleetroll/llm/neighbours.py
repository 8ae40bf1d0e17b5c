"""Nearest neighbours by multi-index hashing over learned binary codes.

Vectors get 128-bit codes: a centred, principal rotation, then one that is learned by turns to lose least in taking
signs.  A code is cut into eight substrings of 16 bits, each an index of its own.  By the pigeonhole principle every code
within the radius of a query's has some substring within that substring's share of it, so probing each index within its
share retrieves all of them; they are reranked by inner products of the original vectors in double precision.  Queries
that find fewer than k rows probe again within a larger radius.

The rows are dealt into blocks, and so are the queries; a task holds one block of each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SUBSTRINGS, WIDTH = 8, 16
BITS = SUBSTRINGS * WIDTH
_POPCOUNT = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint16))


@dataclass
class Codes:
    """A fitted coder: centre, rotation to BITS directions, the norm that inner products are lifted to, and the radius."""

    centre: np.ndarray
    turn: np.ndarray
    norm: float
    radius: int = BITS

    def of(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows of 16-bit substrings.

        A last coordinate lifts all rows to one norm, and queries don't have it: the angle then orders as the inner
        product does.
        """
        lift = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - np.einsum("ij,ij->i", x, x)))
        y = (np.column_stack([x, lift]) - self.centre) @ self.turn
        return np.packbits(y > 0, axis=1, bitorder="little").view("<u2")


def shares(radius: int) -> list[int]:
    """Radii of the substrings: together with one for each they make the radius and one."""
    total = radius + 1
    return [total // SUBSTRINGS + (i < total % SUBSTRINGS) - 1 for i in range(SUBSTRINGS)]


def fit(sample: np.ndarray, norm: float, k: int, recall: float = 0.97, rounds: int = 30, probes: int = 300) -> Codes:
    """Learns the rotation on a sample, and on it the least radius at which ``recall`` of the k nearest are retrieved."""
    x = np.column_stack([sample, np.sqrt(np.maximum(0, norm**2 - np.einsum("ij,ij->i", sample, sample)))])
    centre = x.mean(0)
    x = x - centre
    dim = x.shape[1]
    _, vec = np.linalg.eigh(x.T @ x)
    rng = np.random.default_rng(0)
    lift = rng.standard_normal((dim, BITS)) if dim < BITS else vec[:, ::-1][:, :BITS]
    if dim < BITS:  # fewer directions than bits: a random frame
        lift = vec @ np.linalg.svd(lift, full_matrices=False)[2].reshape(dim, BITS)
    v = x @ lift
    r = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
    for _ in range(rounds):  # signs, then the rotation nearest to them
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    codes = Codes(centre, lift @ r, norm)
    q = sample[rng.permutation(len(sample))[:probes]]
    score = q @ sample.T
    near = np.argsort(-score, axis=1)[:, 1 : k + 1]
    d = np.bitwise_count(codes.of(q, True)[:, None, :] ^ codes.of(sample, False)[near]).sum(2)
    codes.radius = int(np.quantile(d, recall)) if d.size else BITS
    return codes


@lru_cache(maxsize=SUBSTRINGS * WIDTH)
def _errors(share: int) -> np.ndarray:
    """All 16-bit errors of at most ``share`` bits."""
    return np.flatnonzero(_POPCOUNT <= share).astype(np.uint16)


class MultiIndex:
    """The substring indexes of a block of codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes).view("<u8")
        self.index = []
        for s in range(SUBSTRINGS):
            order = np.argsort(codes[:, s], kind="stable")
            key, start = np.unique(codes[order, s], return_index=True)
            self.index.append((key, np.append(start, len(order)), order))

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all codes within the radius of the query's substrings."""
        hit = np.zeros(len(self.codes), bool)
        for s, share in enumerate(shares(radius)):
            if share < 0:
                continue
            key, start, order = self.index[s]
            err = _errors(share)
            if len(err) < len(key):  # probe each allowed substring
                want = err ^ q[s]
                at = np.searchsorted(key, want)
                at = at[(at < len(key)) & (key[np.minimum(at, len(key) - 1)] == want)]
            else:  # fewer buckets than probes: which buckets are allowed
                at = np.flatnonzero(_POPCOUNT[key ^ q[s]] <= share)
            n = start[at + 1] - start[at]
            hit[order[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        some = np.flatnonzero(hit)
        return some[np.bitwise_count(self.codes[some] ^ q.view("<u8")).sum(axis=1) <= radius]


def _searched(coder: Codes, k: int, radius: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: [] for c in ("query_id", "query_hash", "vec_id", "hash", "score")}, dtype=float)
        if not len(rows) or not len(queries):
            return none
        x, ids, hashes = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["vec_id"].to_numpy(), rows["hash"].to_numpy()
        order = np.lexsort((hashes, ids))
        x, ids, hashes = x[order], ids[order], hashes[order]
        y = np.stack(queries["v"].to_numpy()).astype(np.float64)
        index = MultiIndex(coder.of(x, False))
        out = []
        for qid, own, v, code in zip(queries["vec_id"], queries["hash"], y, coder.of(y, True)):
            some = index.within(code, radius)
            some = some[(ids[some] != qid) | (hashes[some] != own)]
            score = (x[some] * v).sum(axis=1)
            best = np.argsort(-score, kind="stable")[:k]
            out.append(pd.DataFrame({"query_id": qid, "query_hash": own, "vec_id": ids[some[best]], "hash": hashes[some[best]], "score": score[best]}))
        return pd.concat(out) if out else none

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, sample_rows: int = 20_000, block_rows: int = 8192, query_rows: int = 4096, least_tasks: int = 32) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is a multiple of ``every`` its k nearest others.

    Nearness is the inner product in double precision; ties go to the smaller vec_id.  Vectors that are null, zero, or
    hold a null or a non-finite component take no part, nor do rows without an id.  A shorter vector counts as nil beyond
    its length.  Rows with one id and one vector are one row; those with one id and several vectors are a row each, and a
    query each if the id is one, with ranks of its own.  The coder is fitted on ``sample_rows`` rows at most; all rows are
    indexed.  What is returned was retrieved by the index: queries that have fewer than k rows within
    the radius (all other rows, if the table has fewer) ask again within one that goes half the way to all bits, until
    it allows them all.
    """
    ok = vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0")
    v = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    v_type = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ok = ok.where(F.coalesce(fine, F.lit(False))).select("vec_id", v.alias("v"))
    head = ok.agg(F.max(F.size("v")).alias("size"), F.count("*").alias("n")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not head["n"]:
        return vectors.sparkSession.createDataFrame([], schema)
    padded = F.concat("v", F.array_repeat(F.lit(0.0).cast(v_type), F.lit(head["size"]) - F.size("v")))
    ok = written(ok.withColumn("v", padded).withColumn("hash", F.xxhash64("v")).dropDuplicates(["vec_id", "hash", "v"]), "vectors")
    stat = ok.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm2"), F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q")).first()
    rows = ok.orderBy(F.xxhash64("vec_id"), "hash").limit(sample_rows).collect()
    coder = fit(np.array([r["v"] for r in rows], np.float64), float(np.sqrt(stat["norm2"])), k)
    blocks = max(1, -(-stat["n"] // block_rows))
    mine = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    w = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id", "hash")
    enough = min(k, stat["n"] - 1)
    asked, n_asked, radius, done = ok.where(F.col("vec_id") % every == 0), stat["q"], coder.radius, []
    while n_asked and enough:
        # few blocks are searched by more tasks, each with fewer of the queries
        parts = max(-(-n_asked // query_rows), min(-(-n_asked // 64), -(-least_tasks // blocks)))
        part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")
        data = ok.withColumn("block", mine).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        here = asked.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        found = data.groupBy("block", "part").cogroup(here.groupBy("block", "part")).applyInPandas(_searched(coder, k, radius), "query_id long, query_hash long, vec_id long, hash long, score double")
        best = written(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "query_hash", "rank", "vec_id", "score"), "nearest")
        full = best.where(F.col("rank") == enough).select("query_id", "query_hash")
        done.append(best.join(full, ["query_id", "query_hash"], "left_semi"))
        if radius >= BITS:
            break
        asked = written(asked.join(full, (F.col("vec_id") == F.col("query_id")) & (F.col("hash") == F.col("query_hash")), "left_anti"), "asked")
        n_asked, radius = asked.count(), radius + (BITS - radius + 1) // 2
    out = done[0] if done else vectors.sparkSession.createDataFrame([], schema)
    for d in done[1:]:
        out = out.union(d)
    return out.select("query_id", "rank", "vec_id", "score")
