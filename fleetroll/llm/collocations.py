"""Phrase collocations: weighted acyclic automata of word sequences, united by prefix range and asked for parts.

A phrase can only be frequent if every phrase inside it is.  Words are counted first, then pairs of frequent words, then
runs of three and four words all of whose pairs are frequent; what a task needs to know of the level before is a filter
of bounded size, which lets some infrequent phrases through and no frequent one out.

Each task counts its own phrases, sorts them and builds transducers: acyclic automata whose arcs bear words and whose
last arcs bear counts, cut by ranges of the prefix.  A range's transducers of all tasks are united, which adds up the
counts, and the phrases with enough are kept.  The parts of these phrases are then looked up by walking them through
the united transducers of the parts' own ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, as_signed, mix64, sliced, utf8_of, written

_LONGEST = 4
#: Into how many ranges at most the phrases of one first word are cut, and words of the corpus for each range.
_SUB, _RANGE_WORDS = 256, 1 << 20
#: Phrases that a task counts before it hands them on.
_HELD = 1_000_000
#: Bytes of text that a task takes at a time.
_SLICE = 4 << 20

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 10  # ends of pieces
_R = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- words and phrases of a batch


class Pieces(Words):
    """Words of a batch, A-Z lower-cased, with ``linked``: whether a word follows the one before in the same piece."""

    def __init__(self, col: pa.Array):
        data, offsets = utf8_of(col)
        plain = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(_PLAIN[data]))
        super().__init__(plain, lower=False)
        ends = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(self.data == 10, out=ends[1:], dtype=np.int32)
        self.linked = np.zeros(len(self.starts), bool)
        if len(self.starts):
            self.linked[1:] = (self.doc[1:] == self.doc[:-1]) & (ends[self.starts[1:]] == ends[self.ends[:-1]])

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words at these places, as strings."""
        size = self.ends[at] - self.starts[at]
        offsets = np.append(0, np.cumsum(size))
        place = np.arange(offsets[-1]) + np.repeat(self.starts[at] - offsets[:-1], size)
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[place])).cast(pa.string())


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each row of labels, in order."""
    key = mix64(columns[0] + _R)
    for c in columns[1:]:
        key = mix64(key * _R + c)
    return key


def tallied(columns: list[np.ndarray], n: np.ndarray | None = None, exact: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of labels with their counts added up, in lexical order.

    Rows meet by their hash; ``exact`` also adds up rows that a clash of hashes has kept apart.
    """
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    key = chained(columns)
    order = np.argsort(key)
    sorted_ = [c[order] for c in columns]
    new = np.ones(len(key), bool)
    differs = np.zeros(len(key) - 1, bool)
    for c in sorted_:
        differs |= c[1:] != c[:-1]
    new[1:] = differs
    first = np.flatnonzero(new)
    counts = np.add.reduceat(np.ones(len(key), np.int64) if n is None else n[order], first)
    columns = [c[first] for c in sorted_]
    order = np.lexsort(columns[::-1])
    columns, counts = [c[order] for c in columns], counts[order]
    if exact:
        again = np.ones(len(counts), bool)
        again[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        if not again.all():
            first = np.flatnonzero(again)
            columns, counts = [c[first] for c in columns], np.add.reduceat(counts, first)
    return columns, counts


def ranges(columns: list[np.ndarray], parts: int) -> np.ndarray:
    """Prefix range of each phrase: by its language and first word, and a part of that word's by the two words after it."""
    first = chained(columns[:2])
    if len(columns) == 2:
        return (first % np.uint64(parts)).astype(np.int32)
    own = min(parts, _SUB)
    return (first % np.uint64(parts // own) * np.uint64(own) + chained(columns[2:4]) % np.uint64(own)).astype(np.int32)


def ranges_for(words: int) -> int:
    """A power of two, so that a range has half a million to a million words of the corpus; 8 at least."""
    return 1 << max(3, (words // _RANGE_WORDS).bit_length())


# ---------------------------------------------------------------- transducers


class Transducer:
    """An acyclic automaton over sorted phrases of one length, its arcs level by level in arrays.

    ``labels[d]`` are the arcs out of the states at depth d, sorted within a state; ``first[d]`` says where a state's arcs
    begin.  An arc at depth d leads to the state of the same number at depth d + 1, all last arcs to one final state, and
    they bear the ``weights``.
    """

    def __init__(self, labels: list[np.ndarray], first: list[np.ndarray], weights: np.ndarray):
        self.labels, self.first, self.weights = labels, first, weights

    @classmethod
    def build(cls, columns: list[np.ndarray], weights: np.ndarray) -> "Transducer":
        """From phrases in lexical order: each opens new states from the first word on in which it leaves the one before."""
        n = len(weights)
        new = np.zeros(n, bool)
        new[:1] = True
        labels, first, state = [], [], np.zeros(n, np.int64)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            labels.append(c[at])
            first.append(np.searchsorted(state[at], np.arange(state[-1] + 2 if n else 1)))
            state = np.cumsum(new) - 1
        return cls(labels, first, weights)

    def columns(self) -> list[np.ndarray]:
        """The phrases it accepts, in order."""
        out, size = [], np.ones(len(self.labels[-1]), np.int64)
        for labels, first in zip(self.labels[::-1], [*self.first[::-1]]):
            out.append(np.repeat(labels, size))
            size = np.add.reduceat(size, first[:-1]) if len(size) else size
        return out[::-1]

    def walk(self, columns: list[np.ndarray]) -> np.ndarray:
        """The weight of each phrase, 0 where it isn't accepted: all of them step from state to state together."""
        state, alive = np.zeros(len(columns[0]), np.int64), np.ones(len(columns[0]), bool)
        for labels, first, c in zip(self.labels, self.first, columns):
            if not len(labels):
                return np.zeros(len(alive), np.int64)
            lo, hi = first[state], first[state + 1]
            top = hi.copy()
            for _ in range(int((hi - lo).max(initial=1)).bit_length()):
                mid = (lo + hi) // 2
                less = (lo < hi) & (labels[np.minimum(mid, len(labels) - 1)] < c)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.maximum(mid, lo))
            alive &= (lo < top) & (labels[np.minimum(lo, len(labels) - 1)] == c)
            state = np.where(alive, lo, 0)
        return np.where(alive, self.weights[state], 0)

    @classmethod
    def union(cls, many: list["Transducer"]) -> "Transducer":
        """Accepts what any of them does, with the sum of the weights."""
        columns = [np.concatenate(c) for c in zip(*(t.columns() for t in many))]
        return cls.build(*tallied(columns, np.concatenate([t.weights for t in many]), exact=True))

    def to_bytes(self) -> bytes:
        own = [x for labels, first in zip(self.labels, self.first) for x in (labels, np.diff(first))] + [self.weights]
        narrow = [x if x.dtype == np.uint64 else x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in own]
        head = np.array([len(self.labels), *(v for x in narrow for v in (len(x), x.dtype.itemsize))], np.int64)
        return b"".join(x.tobytes() for x in (head, *narrow))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Transducer":
        depth = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 4 * depth + 2, 8)
        at, own = 8 * (4 * depth + 3), []
        for n, width in head.reshape(-1, 2):
            own.append(np.frombuffer(raw, f"u{width}", n, at))
            at += int(n * width)
        return cls(own[0:-1:2], [np.append(0, np.cumsum(x, dtype=np.int64)) for x in own[1:-1:2]], own[-1].astype(np.int64))


# ---------------------------------------------------------------- counting on Spark


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, _SLICE):
        p = Pieces(b.column("text"))
        if not len(p.starts):
            continue
        label = b.column("label").to_numpy().view(np.uint64)[p.doc]
        key = chained([label, p.hash])
        _, at, n = np.unique(key, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [b.column("lang").take(pa.array(p.doc[at])), pa.array(as_signed(label[at])), pa.array(as_signed(p.hash[at])), pa.array(as_signed(key[at])), p.texts(at), pa.array(n)],
            names=["lang", "label", "h", "key", "word", "n"],
        )


def key_filter(spark, keys: DataFrame, count: int, most: int = 30) -> np.ndarray:
    """A filter of 16 bits a key, between 2**16 and 2**most bits (128 MB): beyond that it lets more through, and none is lost."""
    bits = max(16, min(most, (16 * max(count, 1) - 1).bit_length()))
    mask = (1 << bits) - 1
    place = keys.select(F.explode(F.array(F.expr(f"key & {mask}"), F.expr(f"shiftrightunsigned(key, 32) & {mask}"))).alias("p"))
    rows = place.groupBy(F.shiftright("p", 15).alias("b")).agg(F.expr("bitmap_construct_agg(p & 32767)").alias("bits")).toLocalIterator()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        own = np.frombuffer(r["bits"], np.uint8)[: len(out)]
        out[r["b"] * 4096 : r["b"] * 4096 + len(own)] = own
    return out


def _let_through(filt: np.ndarray, key: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(filt) * 8 - 1)
    hit = np.ones(len(key), bool)
    for p in (key & mask, (key >> np.uint64(32)) & mask):
        hit &= (filt[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return hit


def _shards(shared, sizes: tuple[int, ...], parts: int):
    """Transducers of a task's phrases by range: pairs of words that the filter knows, or longer phrases all of whose pairs it knows."""

    def handed_on(size: int, held: list) -> Iterator[pa.RecordBatch]:
        whole, n = [np.concatenate(c) for c in zip(*(x for x, _ in held))], np.concatenate([n for _, n in held])
        held.clear()
        columns, n = tallied(whole, n)
        part = ranges(columns, parts)
        order = np.argsort(part, kind="stable")
        part, columns, n = part[order], [c[order] for c in columns], n[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = [Transducer.build([c[lo:hi] for c in columns], n[lo:hi]).to_bytes() for lo, hi in zip(cuts, [*cuts[1:], len(part)])]
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(np.full(len(cuts), size, np.int32)), pa.array(blobs, pa.binary())], names=["part", "size", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = shared.value
        held: dict[int, list] = {s: [] for s in sizes}
        for b in sliced(batches, _SLICE):
            p = Pieces(b.column("text"))
            if len(p.starts) < 2:
                continue
            label, h = b.column("label").to_numpy().view(np.uint64)[p.doc], p.hash
            if sizes == (2,):
                known = _let_through(filt, chained([label, h]))
                fits = {2: p.linked & known & np.append(False, known[:-1])}
            else:
                pair = np.zeros(len(h), bool)
                at = np.flatnonzero(p.linked)
                pair[at] = _let_through(filt, chained([label[at], h[at - 1], h[at]]))
                fits, run_ = {}, pair
                for s in sizes:
                    run_ = run_ & np.append(np.zeros(s - 2, bool), pair)[: len(pair)]
                    fits[s] = run_
            for s, fit in fits.items():
                at = np.flatnonzero(fit)
                if len(at):
                    held[s].append(tallied([label[at], *(h[at - s + 1 + i] for i in range(s))]))
                if sum(len(n) for _, n in held[s]) > _HELD:
                    yield from handed_on(s, held[s])
        for s, own in held.items():
            if own:
                yield from handed_on(s, own)

    return run


_PHRASE = "part int, size int, key long, label long, h1 long, h2 long, h3 long, h4 long, f long"


def _rows(part: int, size: int, columns: list[np.ndarray], f: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"part": np.int32(part), "size": np.int32(size), "key": as_signed(chained(columns)), "label": as_signed(columns[0])})
    for i in range(1, _LONGEST + 1):
        out[f"h{i}"] = as_signed(columns[i]) if i <= size else np.int64(0)
    return out.assign(f=f)


def _united(least: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = Transducer.union([Transducer.from_bytes(x) for x in rows["blob"]])
        some = whole.weights >= least
        return _rows(key[0], key[1], [np.ascontiguousarray(c[some]) for c in whole.columns()], whole.weights[some])

    return run


def _columns(rows: pd.DataFrame, size: int) -> list[np.ndarray]:
    return [rows[c].to_numpy().view(np.uint64) for c in ("label", *(f"h{i}" for i in range(1, size + 1)))]


# ---------------------------------------------------------------- parts

#: Over so many tasks the questions about one range are dealt.
_DEALT = 8


def _asked(parts: int):
    """For each phrase and cut, a question for the count of either side: where it is answered, what is asked, and by whom."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for size, rows in b.groupby("size"):
                label, *h = _columns(rows, size)
                salt = (chained([label, *h]) % np.uint64(_DEALT)).astype(np.int32)
                for cut in range(1, size):
                    for side, own in ((0, h[:cut]), (1, h[cut:])):
                        out = _rows(0, len(own), [label, *own], np.zeros(len(label), np.int64))
                        yield out.assign(part=ranges([label, *own], parts), salt=salt, cut=np.int32(cut), side=np.int32(side), by=rows["key"].to_numpy(), by1=rows["h1"].to_numpy())

    return run


def _answered(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    own = {int(s): Transducer.from_bytes(x) for s, x in zip(known["size"], known["blob"])}
    out = []
    for size, rows in asked.groupby("size"):
        f = own[int(size)].walk(_columns(rows, size))
        out.append(rows[["by", "by1", "cut", "side"]].assign(f=f))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("by", "by1", "cut", "side", "f")})


def _packed_range(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    size = int(key[1])
    columns, n = tallied(_columns(rows, size), rows["f"].to_numpy())
    return pd.DataFrame({"part": [key[0]], "size": [key[1]], "blob": [Transducer.build(columns, n).to_bytes()]})


def _inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The phrases of two words and more that lie inside each longer one."""
    for b in batches:
        for size, rows in b.groupby("size"):
            label, *h = _columns(rows, size)
            for n in range(2, size):
                for i in range(size - n + 1):
                    yield pd.DataFrame({"key": as_signed(chained([label, *h[i : i + n]])), "h1": as_signed(h[i]), "longer": rows["f"].to_numpy()})


# ---------------------------------------------------------------- collocations


def phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """Word counts (lang, label, h, key, word, f), frequent phrases of 1 to 4 words, and the number of ranges."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").withColumn("label", F.xxhash64("lang"))
    counted = docs.mapInArrow(_counted_words, "lang string, label long, h long, key long, word string, n long")
    words = written(counted.groupBy("lang", "label", "h", "key", "word").agg(F.sum("n").alias("f")), "words")
    frequent = words.where(F.col("f") >= least)
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = ranges_for(total)

    def level(sizes: tuple[int, ...], keys: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(key_filter(spark, keys, keys.count()))
        shards = docs.select("label", "text").mapInArrow(_shards(shared, sizes, parts), "part int, size int, blob binary")
        return written(shards.groupBy("part", "size").applyInPandas(_united(least), _PHRASE), "phrases")

    pairs = level((2,), frequent.select("key"))
    longer = level((3, _LONGEST), pairs.select("key"))
    return words, pairs.union(longer), parts


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80) -> DataFrame:
    """The ``top`` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs(lang, text)``: texts are split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words at spaces and tabs,
    A-Z lower-cased; a null lang is ``und``, null and empty texts have no words, repeated rows all count, other columns
    aren't read, and an empty table gives no rows.  a, l and r are occurrences of the phrase and of the two sides of its
    lowest-scoring cut (the first such), n those of all words of the language, score floor(2000000 a / (l + r)).
    A phrase needs ``least`` occurrences, and goes where a longer one that contains it has ``covered`` per cent of them.
    Ties in score and a are in the order of the phrase's bytes.  Words are told apart by 64-bit hashes.
    """
    words, found, parts = phrases(docs, least)
    single = words.where(F.col("f") >= least)
    key = ["part", "salt"]
    ones = single.select("label", F.col("h").alias("h1"), "key", "f").mapInPandas(_placed(parts), _PHRASE)
    known = ones.union(found).groupBy("part", "size").applyInPandas(_packed_range, "part int, size int, blob binary")
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_DEALT - 1))))
    asked = found.mapInPandas(_asked(parts), _PHRASE + ", salt int, cut int, side int, by long, by1 long")
    answers = asked.groupBy(*key).cogroup(known.groupBy(*key)).applyInPandas(_answered, "by long, by1 long, cut int, side int, f long")
    sides = [F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias(f"f{c}{s}") for c in range(1, _LONGEST) for s in (0, 1)]
    sides = answers.groupBy(F.col("by").alias("key"), F.col("by1").alias("h1")).agg(*sides)
    cover = found.where("size > 2").mapInPandas(_inside, "key long, h1 long, longer long").groupBy("key", "h1").agg(F.max("longer").alias("longer"))
    wide = "decimal(20, 0)"
    cut = ", ".join(f"IF(f{c}0 IS NULL, NULL, struct(2000000BD * cast(f AS {wide}) div (cast(f{c}0 AS {wide}) + f{c}1) AS score, {c} AS cut, f{c}0 AS l, f{c}1 AS r))" for c in range(1, _LONGEST))
    d = found.join(sides, ["key", "h1"]).join(cover, ["key", "h1"], "left")
    d = d.where(f"longer IS NULL OR cast(longer AS {wide}) * 100 < cast(f AS {wide}) * {covered}")
    d = written(d.withColumn("c", F.expr(f"array_min(array({cut}))")).select("label", "key", *[f"h{i}" for i in range(1, _LONGEST + 1)], "size", F.col("f").alias("a"), "c.l", "c.r", "c.score"), "scored")

    # what can be among the first, by score and count alone; spellings are looked up for these
    best = [F.desc("score"), F.desc("a")]
    some = d.select("label", "score", "a", F.pmod("key", F.lit(64)).alias("s")).withColumn("i", F.row_number().over(Window.partitionBy("label", "s").orderBy(*best))).where(F.col("i") <= top)
    some = some.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy(*best))).where(F.col("i") <= top)
    floor = some.groupBy("label").agg(F.min(F.struct("score", "a")).alias("floor"))
    d = d.join(floor, "label").where(F.struct("score", "a") >= F.col("floor")).drop("floor")
    spelt = d.select("label", "key", F.posexplode(F.slice(F.array(*[f"h{i}" for i in range(1, _LONGEST + 1)]), 1, F.col("size"))).alias("i", "h")).join(single.select("lang", "label", "h", "word"), ["label", "h"])
    spelt = spelt.groupBy("label", "key").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    n = words.groupBy("label").agg(F.sum("f").alias("n"))
    d = d.join(spelt, ["label", "key"]).join(n, "label").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(*best, "phrase")).cast("long")).where(F.col("rank") <= top)
    return d.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _placed(parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            columns = _columns(b, 1)
            yield _rows(0, 1, columns, b["f"].to_numpy()).assign(part=ranges(columns, parts))

    return run


SQL = """
    WITH c AS (SELECT doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM (SELECT row_number() OVER () AS doc, lang, text FROM documents)),
    p AS (SELECT doc, lang, unnest(range(len(s))) AS piece, unnest(s) AS t FROM (SELECT doc, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS s FROM c)),
    w AS (SELECT doc, piece, lang, unnest(range(len(s))) AS i, unnest(s) AS w FROM (SELECT doc, piece, lang, list_filter(regexp_split_to_array(t, '[\\x20\\x09]+'), lambda x: x <> '') AS s FROM p)),
    g AS (SELECT lang, w, lead(w, 1) OVER o AS x, lead(w, 2) OVER o AS y, lead(w, 3) OVER o AS z FROM w WINDOW o AS (PARTITION BY doc, piece ORDER BY i)),
    f AS (SELECT lang, [w] AS k, count(*) AS f FROM g GROUP BY ALL
          UNION ALL SELECT lang, [w, x], count(*) FROM g WHERE x IS NOT NULL GROUP BY lang, w, x HAVING count(*) >= 30
          UNION ALL SELECT lang, [w, x, y], count(*) FROM g WHERE y IS NOT NULL GROUP BY lang, w, x, y HAVING count(*) >= 30
          UNION ALL SELECT lang, [w, x, y, z], count(*) FROM g WHERE z IS NOT NULL GROUP BY lang, w, x, y, z HAVING count(*) >= 30),
    a AS (SELECT lang, k, f AS a, unnest(range(1, len(k))) AS cut FROM f WHERE len(k) > 1),
    s AS (SELECT a.lang, a.k, a.a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * a.a) // (l.f::HUGEINT + r.f))::BIGINT AS score FROM a
          JOIN f l ON l.lang = a.lang AND l.k = a.k[1:cut] JOIN f r ON r.lang = a.lang AND r.k = a.k[cut + 1:]),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k ORDER BY score, cut) = 1),
    inner_ AS (SELECT lang, k[i:i + m - 1] AS k, max(f) AS longer FROM f, (VALUES (3, 2, 1), (3, 2, 2), (4, 2, 1), (4, 2, 2), (4, 2, 3), (4, 3, 1), (4, 3, 2)) v(n, m, i) WHERE len(k) = n GROUP BY ALL),
    n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang)
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.k, ' ')) AS rank, array_to_string(b.k, ' ') AS phrase, a, l, r, n, score
    FROM b LEFT JOIN inner_ ON inner_.lang = b.lang AND inner_.k = b.k JOIN n ON n.lang = b.lang
    WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a QUALIFY rank <= 2000"""
