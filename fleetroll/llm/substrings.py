"""Substring dedup: compressed FM-indexes of shards, backward search, matching statistics.

Equal windows choose the same anchor, the least word-gram in them, so anchors say which passages could be shared.  The
passages of one anchor go to one shard.  A shard's FM-index is a wavelet matrix over its Burrows-Wheeler transform;
passages are streamed through it from right to left, all at once.  The matching statistics are cut at the window's
length: past it, an interval is widened to all suffixes that share the window's words.  Each window then knows the
smallest doc_id that has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Words, as_signed, beside, dealt, hot_keys, packed, row_keys, shingle_hash, sliced, span_hash, unpacked, written

GRAM = 8
_CHUNK = 1 << 22
_POS = np.uint64((1 << 24) - 1)


# ---------------------------------------------------------------- FM-index


class Bits:
    """Packed bits with rank: eight bytes a word, one count a word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = n - int(np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        w = i >> 6
        low = self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[w] + np.bitwise_count(low)


class FMIndex:
    """Index of sequences of symbols (non-negative integers), each closed by a mark of its own.

    ``depth`` is the length at which matches are cut; ``value`` has one number a sequence, of which ``least`` gives
    the smallest over the sequences that share a match of that length.
    """

    def __init__(self, sequences: list[np.ndarray], value: np.ndarray, depth: int):
        k = len(sequences)
        size = np.array([len(s) + 1 for s in sequences])
        ends = np.cumsum(size) - 1
        text = np.empty(int(size.sum()), np.int64)
        body = np.ones(len(text), bool)
        body[ends] = False
        text[body] = np.concatenate(sequences) + k
        text[ends] = np.arange(k)
        self.depth, self.marks = depth, k
        sa, at_power, power = self._suffixes(text, depth)
        # suffixes in order, with the same first `depth` symbols as the one before
        off = depth - power
        far = np.append(at_power, np.full(off + 1, -1, np.int64))
        same = (at_power[sa[1:]] == at_power[sa[:-1]]) & (far[sa[1:] + off] == far[sa[:-1] + off])
        start = np.flatnonzero(np.append(True, ~same))
        self.opens = Bits(np.append(True, ~same))  # one bit a suffix; the rest is one number a class
        self.start = np.append(start, len(text)).astype(np.int32)
        self.least = np.minimum.reduceat(np.repeat(value, size)[sa], start).astype(np.int32)
        bwt = text[sa - 1]
        top = int(text.max()) + 1
        self.before = np.searchsorted(np.sort(text), np.arange(top + 1))
        self.levels: list[tuple[int, Bits]] = []
        x = bwt
        for shift in range(max(1, (top - 1).bit_length()) - 1, -1, -1):
            bit = (x >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit)))
            x = np.concatenate([x[~bit], x[bit]])
        self.base = np.zeros(top, np.int64)
        self.base = self._down(np.arange(top), np.zeros(top, np.int64))
        self.size = len(text)

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Suffix array by doubling; and the ranks at the largest power of two within depth."""
        n = len(text)
        _, rank = np.unique(text, return_inverse=True)
        rank = rank.astype(np.int64)
        step, kept, power = 1, rank, 1
        while True:
            if step <= depth:
                kept, power = rank, step
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + nxt
            sa = np.argsort(key, kind="stable")
            fresh = np.append(False, key[sa[1:]] != key[sa[:-1]])
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(fresh)
            step *= 2
            if rank[sa[-1]] == n - 1 and step > depth:
                return sa, kept, power

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits in self.levels:
            ones = bits.rank(i)
            i = np.where(c >> shift & 1, bits.zeros + ones, i - ones)
        return i

    def class_of(self, i: np.ndarray) -> np.ndarray:
        """The number of the class (suffixes with the same first ``depth`` symbols) of the i-th suffix."""
        return self.opens.rank(i + 1) - 1

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of c followed by what lo:hi match."""
        at = self.before[c] - self.base[c]
        return at + self._down(c, lo), at + self._down(c, hi)

    def windows(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each place of each sequence where a window of ``depth`` starts: the least value over all that have it.

        The sequences are of the index, so an extension to the left never fails.
        """
        size = np.array([len(s) for s in sequences])
        flat = np.concatenate(sequences) + self.marks
        at = np.cumsum(size) - 1
        out = [np.zeros(max(0, n - self.depth + 1), np.int64) for n in size]
        order = np.argsort(-size, kind="stable")  # lanes that are done are the last ones
        lo, hi = np.zeros(len(size), np.int64), np.full(len(size), self.size, np.int64)
        lanes = order
        for t in range(int(size.max(initial=0))):
            lanes = lanes[size[lanes] > t]
            a, b = self.extend(flat[at[lanes] - t], lo[lanes], hi[lanes])
            if t >= self.depth:  # one symbol too long: all suffixes with the window's words
                a, b = self.start[self.class_of(a)].astype(np.int64), self.start[self.class_of(b - 1) + 1].astype(np.int64)
            lo[lanes], hi[lanes] = a, b
            if t >= self.depth - 1:
                for lane, v in zip(lanes.tolist(), self.least[self.class_of(a)].tolist()):
                    out[lane][size[lane] - 1 - t] = v
        return out


# ---------------------------------------------------------------- anchors


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text that choose the same anchor: first word, windows, the anchor's hash, the passage's."""
    h = words.hash
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    gram = shingle_hash(h, GRAM)
    span = window - GRAM + 1
    best = np.empty(n, np.int64)
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        part = gram[a : b + span - 1]
        key = (part & ~_POS) | np.arange(len(part), dtype=np.uint64)
        pad = -len(key) % span
        box = np.append(key, np.full(pad, ~np.uint64(0))).reshape(-1, span)
        left = np.minimum.accumulate(box, axis=1).ravel()
        right = np.minimum.accumulate(box[:, ::-1], axis=1)[:, ::-1].ravel()
        m = np.minimum(right[: b - a], left[span - 1 : span - 1 + b - a])
        best[a:b] = (m & _POS).astype(np.int64) + a
    ok = words.doc[:n] == words.doc[window - 1 :]
    i = np.flatnonzero(ok)
    if not len(i):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    new = np.append(True, (best[i[1:]] != best[i[:-1]]) | (i[1:] != i[:-1] + 1) | (words.doc[i[1:]] != words.doc[i[:-1]]))
    first = i[new]
    count = np.diff(np.append(np.flatnonzero(new), len(i)))
    return first, count, gram[best[first]], span_hash(h, first, first + count + window - 1)


def _anchored(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            w = Words(b.column("text"), lower=False)
            first, count, h, sh = anchors(w, window)
            d = w.doc[first] if len(first) else first
            take = pa.array(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(h)), pa.array(as_signed(sh)), *(b.column(c).take(take) for c in ("doc_id", "_id", "_th")), pa.array((first - w.first[d]).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["h", "sh", "doc_id", "_id", "_th", "start", "n"],
            )

    return run


def _passages(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            w = Words(b.column("text"), lower=False)
            hash_ = as_signed(w.hash)
            at, h, sh, hot, out = [], [], [], [], []
            for i, need in enumerate(b.column("need").to_pylist()):
                for x in need:
                    lo = w.first[i] + x["start"]
                    at.append(i)
                    h.append(x["h"])
                    sh.append(x["sh"])
                    hot.append(x["hot"])
                    out.append(hash_[lo : lo + x["n"] + window - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h, pa.int64()), pa.array(sh, pa.int64()), b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(hot, pa.bool_()), pa.array(out, pa.list_(pa.int64()))],
                names=["h", "sh", "doc_id", "hot", "words"],
            )

    return run


def _searched(window: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seqs = [np.asarray(x) for x in rows["words"]]
        size = np.array([len(s) for s in seqs])
        _, symbol = np.unique(np.concatenate(seqs), return_inverse=True)
        seqs = np.split(symbol.astype(np.int64), np.cumsum(size)[:-1])
        rank = rows["doc_id"].rank(method="dense").to_numpy().astype(np.int64)
        least = FMIndex(seqs, rank, window).windows(seqs)
        hits = [np.flatnonzero(m < r).astype(np.int32) for m, r in zip(least, rank)]
        some = [len(x) > 0 for x in hits]
        return pd.DataFrame({"h": rows["h"][some].to_numpy(), "sh": rows["sh"][some].to_numpy(), "hits": pd.Series([x for x in hits if len(x)], dtype=object)})

    return run


def _windows(window: int):
    """The windows of hot anchors one by one, by a hash of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, off, wh = [], [], []
            for i, ws in enumerate(b.column("words").to_numpy(zero_copy_only=False)):
                x = np.ascontiguousarray(ws).view(np.uint64)
                n = len(x) - window + 1
                s = np.arange(n)
                wh.append(as_signed(span_hash(x, s, s + window)))
                at.append(np.full(n, i))
                off.append(s.astype(np.int32))
            if at:
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(wh)), *(b.column(c).take(take) for c in ("h", "sh", "doc_id")), pa.array(np.concatenate(off))], names=["wh", "h", "sh", "doc_id", "off"])

    return run


def _cleaned(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n_words, n_removed, kept = [], [], []
            for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = (t or "").encode().split()
                n_words.append(len(words))
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        edge[s["a"]] += 1
                        edge[s["b"]] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, hot: int = 2000, shard_passages: int = 4000) -> DataFrame:
    """``docs`` with n_words, n_removed and kept_text (kept words joined by one space), which take the place of columns of these names.

    A word goes if it lies in a window of ``window`` words that also starts in a document with a smaller doc_id.
    Windows are judged on the input.  Null and empty texts have no words.  Rows with the same doc_id are one document
    and take nothing from each other; a row without an id neither takes nor loses words.  Repeated passages are
    counted once before they reach a shard.  Passages of an anchor that more than ``hot`` different passages share
    are judged window by window, by the same hashes; nothing is left out.
    """
    given, docs = docs, packed(docs)
    keyed = row_keys(docs)
    id_type = dict(docs.dtypes)["doc_id"]
    found = keyed.where("doc_id is not null").select("doc_id", "text", "_id", "_th").mapInArrow(_anchored(window), f"h long, sh long, doc_id {id_type}, _id string, _th long, start int, n int")
    found = written(found, "anchors")
    shared = found.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows")).where("lo < hi")
    shared = written(shared.select("h", "rows"), "shared")
    hot_anchors = hot_keys(shared, ["h"], "rows")
    runs = written(dealt(found, shared.select("h"), ["h"], hot_anchors, ["_id", "_th", "start"], "left_semi"), "runs")
    first = runs.groupBy("h", "sh").agg(F.min(F.struct("doc_id", "_id", "_th", "start", "n")).alias("at"), F.count("*").alias("rows"))
    first = written(first, "first")
    many = first.groupBy("h").agg(F.count("*").alias("variants")).where("variants > 1").withColumn("hot", F.col("variants") > hot)
    variants = dealt(first.drop("rows"), many, ["h"], hot_keys(many, ["h"], "variants"), ["sh"])
    need = variants.groupBy(F.col("at._id").alias("_id"), F.col("at._th").alias("_th")).agg(F.collect_list(F.struct("h", "sh", "at.start", "at.n", "hot")).alias("need"))
    need = written(need, "need")
    passages = written(beside(keyed.select("doc_id", "text", "_id", "_th"), need, ["_id", "_th"], "inner", "need").mapInArrow(_passages(window), f"h long, sh long, doc_id {id_type}, hot boolean, words array<long>").dropDuplicates(["h", "sh"]), "passages")
    shards = max(256, -(-passages.count() // shard_passages))
    by_index = passages.where("not hot").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInPandas(_searched(window), "h long, sh long, hits array<int>")
    single = written(passages.where("hot").mapInArrow(_windows(window), f"wh long, h long, sh long, doc_id {id_type}, off int"), "windows")
    low = written(single.groupBy("wh").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")), "low")
    by_window = dealt(single, low.select("wh", "low"), ["wh"], hot_keys(low, ["wh"], "rows"), ["h", "sh", "off"]).where("low < doc_id").groupBy("h", "sh").agg(F.collect_list("off").alias("hits"))
    hits = by_index.union(by_window)
    judged = first.select("h", "sh", F.col("at.doc_id").alias("low")).join(hits, ["h", "sh"], "left")
    spans = dealt(runs, judged, ["h", "sh"], hot_keys(first, ["h", "sh"], "rows"), ["_id", "_th", "start"]).where("low < doc_id or hits is not null")
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + window).alias("b")))
    each = F.transform("hits", lambda x: F.struct((F.col("start") + x).alias("a"), (F.col("start") + x + window).alias("b")))
    spans = spans.select("_id", "_th", F.when(F.col("low") < F.col("doc_id"), whole).otherwise(each).alias("s"))
    spans = written(spans.groupBy("_id", "_th").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("spans")), "spans")
    names = ["doc_id", "text", "own"]
    out = keyed.join(spans.hint("shuffle_hash"), ["_id", "_th"], "left").drop("_id", "_th").select(*names, "spans")
    out = out.mapInArrow(_cleaned(window, names), StructType([*docs.schema.fields, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]))
    return unpacked(out, given, "n_words", "n_removed", "kept_text")
