"""Best-fit packing by exact complements.

Pieces are of at most ``capacity`` tokens, so a table of counts by length has at most that many rows, whatever the
corpus.  The plan is made on that table: for each length, from the longest on, the rest of the sequence is filled
exactly by one, two or three other lengths as far as counts allow; what is left goes best-fit.  Pieces then find
their place by their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import USUAL
from .common import sliced, written
from .numbering import buckets_for, numbered


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """A tokenizer file's merges as ranks of byte strings, where the two say the same; else None.

    They do for a byte-level BPE whose every merge makes a new token, with ids in the order of the merges.
    """
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain_bpe = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not (plain_bpe and byte_level):
        return None
    # the byte alphabet of such files: printable bytes are themselves, the others follow from 256 on
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(i): i for i in own} | {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(own)))}
    vocab = model["vocab"]
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    letters = {vocab.get(c) for c in byte}
    if None in made or None in letters or made != sorted(set(made)) or max(letters) > made[0]:
        return None
    inside = letters.union(made)
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if i in inside}


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    """Encoder of a tokenizer file: by its ranks where it has them, which is faster; texts with special tokens by the file itself."""
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tok = Tokenizer.from_file(path)
    special = [a["content"] for a in spec.get("added_tokens", [])]

    def whole(t: str) -> bytes:
        return np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()

    ranks = _ranks(spec) if pattern == USUAL else None
    if ranks is None:
        return lambda texts: [whole(t) for t in texts]
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def run(texts: list[str]) -> list[bytes]:
        return [whole(t) if any(s in t for s in special) else array("I", encode(t)).tobytes() for t in texts]

    return run


def _cut(path: str, pattern: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path, pattern)
        tail = end.to_bytes(4, "little")
        for b in sliced(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in b.column("text").to_pylist()])):
                ids += tail
                n = len(ids) // 4
                lo, hi, k = 0, n % capacity or min(capacity, n), 0
                while lo < n:
                    at.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                    lo, hi, k = hi, hi + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def cut(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Pieces of every document: its ids and the id ``end``; longer ones are cut, the first piece taking the remainder."""
    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, pattern, capacity, end), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


class Sums:
    """Index from a length to the single lengths, pairs and triples that make it, of the lengths there are."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths = np.sort(lengths)[::-1]
        self.has = np.zeros(capacity + 1, bool)
        self.has[lengths] = True
        i, j = np.triu_indices(len(self.lengths))
        large, total = self.lengths[i], self.lengths[i] + self.lengths[j]
        fits = total <= capacity
        large, total = large[fits], total[fits]
        at = np.lexsort((-large, total))
        self.large, bounds = large[at], np.searchsorted(total[at], np.arange(capacity + 2))
        self.first = bounds
        #: the least of the larger members of a sum's pairs; a triple needs it within its own largest
        self.least = np.full(capacity + 1, capacity + 1)
        some = np.flatnonzero(bounds[1:] > bounds[:-1])
        self.least[some] = self.large[bounds[some + 1] - 1]

    def single(self, s: int) -> bool:
        return s >= 0 and bool(self.has[s])

    def pairs(self, s: int) -> np.ndarray:
        """Larger members of the pairs, in falling order."""
        return self.large[self.first[s] : self.first[s + 1]] if s >= 0 else self.large[:0]

    def triples(self, s: int) -> np.ndarray:
        """Largest members of the triples, in falling order."""
        a = self.lengths[self.lengths < s]
        return a[self.least[s - a] <= a]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns ((length, times), ...) with how many sequences have each. Every piece is used, and none twice.

    The sums of singles, pairs and triples are indexed once; what the index names is taken as far as counts allow.
    """
    c = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        c[n] = k
    sums = Sums(np.flatnonzero(c), capacity)
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def take(*lengths: int) -> None:
        need = Counter(lengths)
        m = min(int(c[n]) // k for n, k in need.items())
        if m:
            for n, k in need.items():
                c[n] -= k * m
            out.append((tuple(sorted(need.items(), reverse=True)), m))

    def fill(n: int, rest: int, top: int, *have: int) -> None:
        """Sequences of n, what they have, and two that fill the rest, the larger first."""
        for x in sums.pairs(rest):
            if not c[n] or (have and not c[have[0]]):
                break
            if x <= top and c[x] and c[rest - x]:
                take(n, *have, int(x), int(rest - x))

    take(capacity)
    for n in sums.lengths.tolist():
        gap = capacity - n
        if c[n] and sums.single(gap):
            take(n, gap)
        if c[n]:
            fill(n, gap, n)
        for a in sums.triples(gap).tolist() if c[n] else ():
            if not c[n]:
                break
            if a <= n and c[a]:
                fill(n, gap - a, a, a)
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # gap: patterns with that much room

    def add(pattern, m, gap):
        (open_.setdefault(gap, []) if gap else out).append((pattern, m))

    for n in range(capacity, 0, -1):
        k = int(c[n])
        while k:
            gap = next((g for g in sorted(open_) if g >= n), None)
            if gap is None:
                q = min(capacity // n, k)  # new sequences, each with as many of this length as it holds
                m = k // q
                add(((n, q),), m, capacity - n * q)
                k -= m * q
                continue
            pattern, m = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            q = min(gap // n, k)
            used = min(m, k // q)
            if used < m:
                add(pattern, m - used, gap)
            add((*pattern, (n, q)), used, gap - n * q)
            k -= used * q
    return out + [x for xs in open_.values() for x in xs]


def places(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> tuple[np.ndarray, ...]:
    """Runs by (length, first rank): pieces a sequence takes, number of the first sequence, offset of the first place."""
    rank: Counter = Counter()
    rows, sequence = [], 0
    for pattern, m in patterns:
        offset = 0
        for n, q in pattern:
            rows.append((n, rank[n], q, sequence, offset))
            rank[n] += m * q
            offset += n * q
        sequence += m
    t = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return t[:, 0] << 44 | t[:, 1], t[:, 1], t[:, 2], t[:, 3], t[:, 4]


def _placed(shared, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, per, sequence, offset = shared.value
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, n << 44 | r, side="right") - 1
            k = r - first[at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(sequence[at] + k // per[at]), pa.array(offset[at] + k % per[at] * n)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces(doc_id, piece, start, length, ...)`` with sequence_id and offset (gapless from 0 in a sequence).

    The driver sees the counts of at most ``capacity`` lengths.  Rows that agree in all columns are interchangeable.
    """
    pieces = written(pieces, "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    ranked = numbered(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank", buckets_for(sum(counts.values())))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return ranked.select(*pieces.columns, "rank").mapInArrow(_placed(shared, pieces.columns), f"{schema}, sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the single id ``end``.  Null ids and repeated rows are packed like all others.  A text
    that holds a special token's string is encoded as the tokenizer file says, that is, with the token.
    """
    return pack(cut(docs, tokenizer, pattern, capacity, end), capacity)
