"""Byte-level BPE on padded matrices, and back.

Pieces are bucketed by length and padded to the bucket's width.  In every round each row of a matrix merges its
leftmost pair of least rank; pairs are looked up in a hash table; rows with nothing left to merge leave the matrix.
Pieces beyond the widest bucket, where a round a merge would cost the square of their length, take the same merges from
a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunked
from .common import sliced

_NONE = np.int32(2**31 - 1)
#: Bytes of the widest bucket.
WIDEST = 512


class PairTable:
    """Open addressing from a pair of ids to the id of its merge, for arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, (2 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.vals = np.full(size, _NONE, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        val = np.array(list(pairs.values()), np.int32)
        slot = self._slot(key)
        self.probes = 0
        while len(key):  # in each round the first comer takes a free slot, the others move on
            self.probes += 1
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            win = np.flatnonzero(free)[first]
            self.keys[slot[win]], self.vals[slot[win]] = key[win], val[win]
            rest = np.ones(len(key), bool)
            rest[win] = False
            key, val, slot = key[rest], val[rest], slot[rest] + 1 & size - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.vals[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            s = slot[open_] + 1 & len(self.keys) - 1
            slot[open_] = s
            same = self.keys[s] == key[open_]
            out[open_[same]] = self.vals[s[same]]
            open_ = open_[~same & (self.keys[s] != -1)]
        return out


class Bpe:
    """Encoder and decoder of a rank file: a token and its rank on each line."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {}
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = PairTable(pairs)
        self.merge_of = {a << 32 | b: i for (a, b), i in pairs.items()}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        todo: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > WIDEST:
                out[i] = self._merge_long(p)
            elif p:
                width = 4
                while width < len(p):
                    width = width * 3 // 2 if width < 32 else width * 2
                todo.setdefault(width, []).append(i)
        for width, own in todo.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(own), step):
                some = own[k : k + step]
                for i, ids in zip(some, self._merge([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _merge(self, rows: list[bytes], width: int) -> list[bytes]:
        n = np.array([len(r) for r in rows])
        raw = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
        ids = self.byte_id[raw]
        col = np.arange(width)
        rank = np.full((len(rows), width), _NONE, np.int32)
        inside = col[None, :-1] + 1 < n[:, None]
        rank[:, :-1][inside] = self.pairs.find(ids[:, :-1][inside], ids[:, 1:][inside])
        out: list[bytes] = [b""] * len(rows)
        at = np.arange(len(rows))
        while len(at):
            pos = rank.argmin(1)
            row = np.arange(len(at))
            best = rank[row, pos]
            done = best == _NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[at[r]] = ids[r, : n[r]].astype("<u4").tobytes()
                keep = ~done
                ids, rank, n, at, pos, best = ids[keep], rank[keep], n[keep], at[keep], pos[keep], best[keep]
                most = int(n.max()) if len(n) else 0
                if most and most < ids.shape[1]:  # compaction of columns that no row uses any more
                    ids, rank, col = ids[:, :most], rank[:, :most], col[:most]
                row = np.arange(len(at))
            if not len(at):
                break
            ids[row, pos] = best
            shift = np.minimum(col[None, :] + (col[None, :] > pos[:, None]), len(col) - 1)
            ids = np.take_along_axis(ids, shift, 1)
            rank = np.take_along_axis(rank, shift, 1)
            n = n - 1
            rank[row, n - 1] = _NONE
            right = pos + 1 < n
            rank[row, pos] = _NONE
            r, p = row[right], pos[right]
            rank[r, p] = self.pairs.find(ids[r, p], ids[r, p + 1])
            left = pos > 0
            r, p = row[left], pos[left]
            rank[r, p - 1] = self.pairs.find(ids[r, p - 1], ids[r, p])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """The merges of one long piece: pairs wait in a heap by rank and place, tokens are a linked list."""
        ids: list[int] = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, find = len(ids), self.merge_of.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := find(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            rank, i = x >> 32, x & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or find(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := find(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := find(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, r << 32 | h)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str) -> tuple[Bpe, Chunked]:
    bpe = Bpe(path)
    return bpe, Chunked(pattern, bpe.encode_pieces)


def _encoded(path: str, pattern: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, chunked = _loaded(path, pattern)
        for b in sliced(batches):
            ids = chunked.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(ids, pa.binary())], names=[*kept, "ids"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``ids``: token ids as little-endian unsigned 32-bit bytes.

    Every match of ``pattern`` in the text is encoded by itself, and nothing is a special token.  Null and empty texts
    have no ids.  No shuffle; repeated rows and null keys are rows like others.  A column named ``ids`` is replaced.
    """
    kept = [c for c in (keep or docs.columns) if c.lower() != "ids"]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(_encoded(path, pattern, kept), f"{schema}, ids binary")


def _decoded(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for b in batches:
            out = [None if x is None else bpe.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, "decoded"])

    return run


def decode(ids: DataFrame, path: str) -> DataFrame:
    """``ids`` with ``decoded``: the bytes of the tokens, one after the other. Null ids stay null.

    A column named ``decoded`` is replaced.
    """
    ids = ids.select(*[F.col(f"`{c}`") for c in ids.columns if c.lower() != "decoded"])
    schema = ", ".join(f"`{c}` {t}" for c, t in ids.dtypes)
    return ids.mapInArrow(_decoded(path, ids.columns), f"{schema}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunked = _loaded(path, pattern)
        for b in sliced(batches):
            ids = chunked.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
