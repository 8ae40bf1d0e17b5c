"""Shared helpers of the corpus operators: tables, written intermediates, and vectorised words.

A *word* is a run of characters outside ``[\\x20\\x09-\\x0D]``.  In UTF-8 those
six bytes never occur inside another character, so words are found on the raw
bytes of an Arrow string column, a whole batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetroll.sources.tables import shared_dir, written  # noqa: F401  (for the operators)

WS = r"\x20\x09-\x0D"
_MULT = np.uint64(0x9E3779B97F4A7C15)
_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(df: DataFrame) -> DataFrame:
    """Adds ``_id`` and ``_th``: rows that agree on both have the same doc_id and text, so they share results.

    Null ids and null texts get values of their own, which keeps every later join a plain equi-join.
    """
    return df.withColumn("_id", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("null"))).withColumn(
        "_th", F.when(F.col("text").isNull(), F.lit(-1)).otherwise(F.xxhash64("text"))
    )


def sliced(batches: Iterator[pa.RecordBatch], most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text, so that what a task holds doesn't grow with its batches."""
    for b in batches:
        n = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(n) // most, prepend=0))
        for lo, hi in zip([0, *cut], [*cut, b.num_rows]):
            if hi > lo:
                yield b.slice(int(lo), int(hi - lo))


# ---------------------------------------------------------------- vectorised words


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser with good avalanche on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_R = np.uint64(0xD1342543DE82EF95)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_pow_cache: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    k = int(base)
    have = _pow_cache.get(k)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        p = np.empty(size, np.uint64)
        p[0] = 1
        done, step = 1, int(base)
        while done < size:  # doubling: p[done:2done] = p[:done] * base**done
            more = min(done, size - done)
            p[done : done + more] = p[:more] * np.uint64(step)
            step = step * step & _M64
            done += more
        _pow_cache[k] = have = p
    return have


_IS_WS = np.zeros(256, bool)
_IS_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of a batch of texts: doc number, byte span and a 64-bit hash of each."""

    def __init__(self, col: pa.Array, lower: bool):
        self.n = len(col)
        data, offsets = utf8_of(col)
        if lower:
            data = _LOWER[data]
        self.data, self.offsets = data, offsets
        ws = np.ones(len(data) + 2, bool)
        ws[1:-1] = _IS_WS[data]
        start = ws[:-1] & ~ws[1:]
        end = ~ws[:-1] & ws[1:]
        inner = offsets[1:-1]  # where one text meets the next a word ends and another starts
        inner = inner[(inner > 0) & (inner < len(data))]
        both = inner[~ws[inner] & ~ws[inner + 1]]
        start[both] = True
        end[both] = True
        self.starts = np.flatnonzero(start[:-1]) if len(data) else np.zeros(0, np.int64)
        self.ends = np.flatnonzero(end)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))  # words of doc i: first[i]:first[i+1]
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hash(self.data, self.starts, self.ends, _TABLE)
        return self._hash


def utf8_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: none) and the bounds of each text, without a copy where Arrow allows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, dat = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    d = np.frombuffer(dat, np.uint8)[o[0] : o[-1]] if dat is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
    """A polynomial hash of values[start:end] for every span, by prefix sums modulo 2**64; ``names`` maps values first.

    Works in slices: powers start anew every 64 thousand spans, so the tables stay small.
    """
    out = np.empty(len(starts), np.uint64)
    step = 1 << 16
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        lo, hi = int(s.min()), int(e.max())
        n = hi - lo
        prefix = np.zeros(n + 1, np.uint64)
        part = values[lo:hi] if names is None else names[values[lo:hi]]
        np.cumsum(part * _powers(_R, n + 1)[:n], out=prefix[1:])
        h = (prefix[e - lo] - prefix[s - lo]) * _powers(_RINV, n + 1)[s - lo]
        out[a : a + step] = mix64(h ^ mix64((e - s).astype(np.uint64) * _MULT))
    return out


def shingle_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of n consecutive word hashes starting at every place, in order."""
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = mix64(out * _R + words[i : len(words) - n + 1 + i])
    return out


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Bytes up to which a written side is broadcast; above, both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def beside(big: DataFrame, small: DataFrame, on: list[str], how: str, lists: str | None = None) -> DataFrame:
    """Joins texts with a written table about them. Its size is measured: within BROADCAST_BYTES the texts stay where they are."""
    rows, items = small.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)) if lists else F.lit(0), F.lit(0))).first()
    hint = "broadcast" if 80 * rows + 48 * items <= BROADCAST_BYTES else "shuffle_hash"
    return big.join(small.hint(hint), on, how)


#: A key with more than one in HOT_SHARE of the rows is hot; there are at most so many. Its rows are dealt over SALTS tasks.
HOT_SHARE, SALTS = 200, 64


def hot_keys(counts: DataFrame, on: list[str], n: str = "n", share: int = HOT_SHARE, least: int = 0) -> list[int]:
    """Hashes of the hot keys of a table of counts by key, of more than ``least`` rows: at most ``share`` of them, whatever the table's size."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where((F.col(n) * share > total) & (F.col(n) > least)).select(F.xxhash64(*on)).collect()] if total > share else []


def dealt(big: DataFrame, small: DataFrame, on: list[str], hot: list[int], spread: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which the rows of ``big`` with a hot key are dealt over SALTS tasks by a hash of ``spread``.

    ``small`` has few rows a key; those of the hot keys are repeated for every salt.
    """
    if not hot:
        return big.join(small, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    b = big.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return b.join(s, [*on, "_salt"], how).drop("_salt")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in the one column ``own``, where no name of theirs can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("own"))


def unpacked(df: DataFrame, docs: DataFrame, *results: str) -> DataFrame:
    """The columns of ``docs``, in order, and the results; a column with the name of a result gives way to it."""
    mine = {c.lower() for c in results}
    kept = [F.col(c) if c in ("doc_id", "text") else F.col("own").getField(c).alias(c) for c in docs.columns if c.lower() not in mine]
    return df.select(*kept, *results)


def plain(df: DataFrame, *results: str) -> DataFrame:
    """``df`` without columns that have the name of a result, whose place the operator's takes."""
    mine = {c.lower() for c in results}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in mine])
