"""Line dedup with a once-seen and a twice-seen Bloom filter; only suspected repeats are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, dealt, hot_keys, packed, row_keys, sliced, unpacked, written

_STRIP = b" \t\n\x0b\x0c\r"
_SEG = 16  # bits of a place within a segment of the filter


def line_keys(text: str, min_chars: int) -> dict[bytes, list[int]]:
    """Keys of at least min_chars code points, each with the numbers of its lines."""
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(_STRIP).lower()
        if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
            found.setdefault(key, []).append(i)
    return found


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two places in a filter of 2**bits bits for each 128-bit hash."""
    mask = np.uint64((1 << bits) - 1)
    return [h[:, 0] & mask, h[:, 1] & mask]


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)


def _filled(bits: int, min_chars: int):
    """Each task's two filters, as the sorted places of every segment: once from all keys, twice from repeated ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in sliced(batches):
            keys = [k for t in b.column("text").to_pylist() if t for k in line_keys(t, min_chars)]
            if keys:
                parts.append(_hashes(keys))
        if not parts:
            return
        h = np.concatenate(parts)
        h, n = np.unique(h.view("u8,u8").ravel(), return_counts=True)
        h = h.view(np.uint64).reshape(-1, 2)
        seg, kind, places = [], [], []
        for twice, own in ((False, h), (True, h[n > 1])):
            p = np.unique(np.concatenate(_places(own, bits))) if len(own) else np.zeros(0, np.uint64)
            s = (p >> np.uint64(_SEG)).astype(np.int64)
            at = np.flatnonzero(np.diff(s, prepend=-1))
            for lo, hi in zip(at, [*at[1:], len(s)]):
                seg.append(int(s[lo]))
                kind.append(twice)
                places.append((p[lo:hi] & np.uint64((1 << _SEG) - 1)).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int32()), pa.array(kind), pa.array(places, pa.binary())], names=["seg", "twice", "places"])

    return run


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A bit is seen twice if a task says so or if two tasks have it."""
    once = np.zeros(1 << _SEG, bool)
    twice = np.zeros(1 << _SEG, bool)
    for t, p in zip(rows["twice"], rows["places"]):
        p = np.frombuffer(p, np.uint16)
        if not t:
            twice[p] |= once[p]
            once[p] = True
        else:
            twice[p] = True
    return pd.DataFrame({"seg": [key[0]], "bits": [np.packbits(twice).tobytes()]}, dtype=object)


def twice_filter(docs: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The twice-seen filter of the whole table: 2**bits bits, whatever the table's size."""
    parts = docs.select("text").mapInArrow(_filled(bits, min_chars), "seg int, twice boolean, places binary")
    rows = parts.groupBy("seg").applyInPandas(_merged, "seg int, bits binary").toLocalIterator()
    out = np.zeros(1 << (bits - 3), np.uint8)
    n = 1 << (_SEG - 3)
    for r in rows:
        out[r["seg"] * n : (r["seg"] + 1) * n] = np.frombuffer(r["bits"], np.uint8)
    return out


def _suspected(shared, bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = shared.value
        for b in sliced(batches):
            at, keys, lines = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                for k, own in line_keys(t, min_chars).items() if t else ():
                    at.append(i)
                    keys.append(k)
                    lines.append(own)
            if not keys:
                continue
            h = _hashes(keys)
            hit = np.ones(len(h), bool)
            for p in _places(h, bits):
                hit &= (filt[(p >> np.uint64(3)).astype(np.int64)] >> (7 - (p & np.uint64(7))).astype(np.uint8)) & 1 > 0
            some = np.flatnonzero(hit)
            take = pa.array(np.array(at)[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[some, 0].view(np.int64)), pa.array(h[some, 1].view(np.int64)), *(b.column(c).take(take) for c in ("doc_id", "_id", "_th")), pa.array([lines[i] for i in some], pa.list_(pa.int32()))],
                names=["k1", "k2", "doc_id", "_id", "_th", "lines"],
            )

    return run


def filter_bits(documents: int, most: int) -> int:
    """256 bits a document, between 2**20 and 2**most; beyond that more lines are suspected, and none is lost."""
    return max(20, min(most, (256 * max(documents, 1) - 1).bit_length()))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_bits: int = 30) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text, which take the place of columns of these names.

    A line's key is the line without the white space at its ends, A-Z in lower case.  Keys of at least min_chars code
    points that at least min_docs documents hold lose all their lines but those of the largest doc_id that holds it.
    Null and empty texts are one empty line.  Rows with the same doc_id are one document; all rows without an id are
    one document too, which keeps a line only if no other does.  The filters hold at most 2**max_bits bits (128 MB),
    which is what is broadcast, and let through every repeated line: the exact count follows on what they let through.
    """
    given, docs = docs, packed(docs)
    spark = docs.sparkSession
    bits = filter_bits(docs.count(), max_bits)
    shared = spark.sparkContext.broadcast(twice_filter(docs, bits, min_chars))
    id_type = dict(docs.dtypes)["doc_id"]
    keyed = row_keys(docs)
    schema = f"k1 long, k2 long, doc_id {id_type}, _id string, _th long, lines array<int>"
    suspects = written(keyed.select("doc_id", "text", "_id", "_th").mapInArrow(_suspected(shared, bits, min_chars), schema), "suspects")
    holders = suspects.groupBy("k1", "k2", "_id").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("rows"))
    found = holders.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"), F.sum("rows").alias("rows")).where(F.col("n") >= min_docs)
    found = written(found.select("k1", "k2", "keep", "rows"), "found")
    hot = hot_keys(found, ["k1", "k2"], "rows")
    gone = dealt(suspects, found.drop("rows"), ["k1", "k2"], hot, ["_id", "_th"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
    gone = gone.groupBy("_id", "_th").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("_gone"))
    out = beside(keyed, written(gone, "gone"), ["_id", "_th"], "left", "_gone")
    # the lines are bound once; what stays is a set difference of places
    kept = "IF(_gone IS NULL, l, transform(array_except(sequence(0, size(l) - 1), _gone), i -> l[i]))"
    out = out.withColumn("_l", F.expr(f"transform(array(split(coalesce(text, ''), '\\\\n')), l -> struct(cast(size(l) AS bigint) AS n, {kept} AS kept))[0]"))
    out = out.withColumns({"n_lines": F.col("_l.n"), "n_dropped": F.col("_l.n") - F.size("_l.kept"), "kept_text": F.array_join("_l.kept", "\n")})
    return unpacked(out, given, "n_lines", "n_dropped", "kept_text")


SQL = """
    WITH l AS (SELECT doc_id, i, line, lower_key FROM (
           SELECT doc_id, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i, unnest(string_split(t, chr(10))) AS line FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
           LATERAL (SELECT translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key)),
    k AS (SELECT lower_key, max(doc_id) AS keep FROM l WHERE length(lower_key) >= 20 GROUP BY lower_key HAVING count(DISTINCT doc_id) >= 3),
    j AS (SELECT l.*, keep IS NOT NULL AND keep <> doc_id AS gone FROM l LEFT JOIN k USING (lower_key))
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""
