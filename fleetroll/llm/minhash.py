"""Near-duplicate classes: MinHash, b-bit signatures and a multi-index Hamming join.

Every text becomes the set of its distinct word shingles.  Texts with the same set are one class from the start.
A class has a signature of ``hashes`` MinHash symbols of 16 bits.  Two signatures of sets with Jaccard similarity t
differ in about ``hashes * (1 - t)`` symbols; the join allows ``sigmas`` standard deviations more, and finds *every*
pair within that distance: symbols are cut into so many chunks that, by the pigeonhole principle, some chunk of such a
pair has one error at most, and the allowed errors are enumerated by leaving out each symbol of a chunk in turn.

Buckets are never expanded into all their pairs.  A few rounds compare each member with one hub of its bucket, and
members already in the hub's component aren't compared at all; what then still lies in different components of one
bucket is compared in full, so no link is lost.  Every link is confirmed on the full sets.  A class has as many keys as a
signature has symbols, so a group of near copies with a third of all classes makes keys with a two-hundredth of all rows:
in the joins of those with one row a key, and of pairs with their hub's set, keys with a two-thousandth are dealt over salts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_signed, beside, dealt, hot_keys, mix64, packed, row_keys, shingle_hash, sliced, unpacked, written
from .components import components

_A = (mix64(np.arange(1, 513, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
#: Places of the parity sketch of a set: how many of its items fall on each place, modulo 2.
PARITY = 1024
#: A key with more than one in so many rows, and so many rows, is hot: dealing it out repeats the other side's row.
_HOT = {"share": 2000, "least": 1000}
_B = mix64(np.arange(1001, 1513, dtype=np.uint64)).astype(np.uint32)


def allowed_distance(hashes: int, percent: int, sigmas: float) -> int:
    t = percent / 100
    return min(hashes - 1, math.ceil(hashes * (1 - t) + sigmas * math.sqrt(hashes * t * (1 - t))))


def chunks_of(hashes: int, distance: int) -> list[np.ndarray]:
    """So many chunks that floor(distance / chunks) is at most one error."""
    return np.array_split(np.arange(hashes), min(hashes // 2, distance // 2 + 1))


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than n words, the whole sequence is the one shingle."""
    h, out = words.hash, []
    for a, b in zip(words.first[:-1], words.first[1:]):
        w = h[a:b]
        out.append(np.unique(shingle_hash(w, min(n, len(w)))) if len(w) else w[:0])
    return out


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """A row of 16-bit symbols for each non-empty set."""
    size = np.array([len(s) for s in sets])
    out = np.empty((len(sets), hashes), np.uint16)
    i = 0
    while i < len(sets):  # slices that stay in the processor's cache
        j, total = i + 1, size[i]
        while j < len(sets) and total + size[j] <= 100_000:
            total += size[j]
            j += 1
        x = np.concatenate(sets[i:j])
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum(size[i : j - 1])))
        for k in range(hashes):
            v = np.minimum.reduceat(x * _A[k] + _B[k], at)
            out[i:j, k] = (mix64(v.astype(np.uint64) + np.uint64(k)) >> np.uint64(48)).astype(np.uint16)
        i = j
    return out


def _signed(shingle: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(Words(b.column("text"), lower=True), shingle)
            some = [i for i, s in enumerate(sets) if len(s)]
            n = np.array([len(s) for s in sets], np.int64)
            cls = np.zeros(len(sets), np.uint64)
            sig = [None] * len(sets)
            if some:
                full = [sets[i] for i in some]
                m = signatures(full, hashes)
                for i, s, row in zip(some, full, m):
                    cls[i] = mix64(np.add.reduce(mix64(s), keepdims=True) ^ mix64(np.bitwise_xor.reduce(s, keepdims=True) + np.uint64(len(s))))[0]
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_id"), b.column("_th"), pa.array(n), pa.array(as_signed(cls)), pa.array(sig, pa.binary())],
                names=["doc_id", "_id", "_th", "n_shingles", "cls", "sig"],
            )

    return run


def _keyed(chunks: list[np.ndarray], hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, hashes).astype(np.uint64)
            cls = b.column("cls").to_numpy()
            for c, own in enumerate(chunks):
                term = mix64(sig[:, own] + (own.astype(np.uint64) << np.uint64(20)) + np.uint64(1 << 40))
                whole = np.add.reduce(term, axis=1)
                for p in range(len(own)):  # leaving out symbol p
                    key = mix64((whole - term[:, p]) ^ np.uint64(c * 64 + p + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(as_signed(key)), pa.array(np.full(len(cls), c, np.int8)), pa.array(np.full(len(cls), p, np.int8)), pa.array(cls)], names=["key", "chunk", "gap", "cls"])

    return run


def _first_chunk(chunks: list[np.ndarray], distance: int) -> str:
    """SQL: the two signatures are within the distance, and ``chunk``, ``gap`` is the first key they share.

    With it every pair of a join by key comes once, however many keys it shares.
    """
    off = "transform(zip_with(sig, xsig, (p, q) -> p <> q), d -> IF(d, 1, 0))"
    total = "aggregate({}, 0, (s, d) -> s + d)"
    bounds = ", ".join(f"struct({int(c[0]) + 1} AS a, {len(c)} AS l)" for c in chunks)
    wrong = total.format("slice(o, c.a, c.l)")
    own = f"transform(filter(array({bounds}), (c, i) -> i = chunk), c -> slice(o, c.a, c.l))[0]"
    gap = f"IF(aggregate({own}, 0, (s, d) -> s + d) = 0, gap = 0, {own}[gap] = 1)"
    body = f"{total.format('o')} <= {distance} AND forall(filter(array({bounds}), (c, i) -> i < chunk), c -> {wrong} > 1) AND {gap}"
    return f"exists(array({off}), o -> {body})"


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members that may still link to another component, with set size ``n``, the ``shared`` part of it, and signature.

    Only buckets with several components count.  A shingle that no other set among them has can't be in any
    intersection, and sets that are left with too few others go; so does what then only they had, in a second turn.
    """
    for turn in range(2):
        mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        members = written(members.join(mixed, "key", "left_semi"), "open")
        own = members.select("cls").distinct().join(sets, "cls")
        items = own.select("cls", F.explode("items").alias("item"))
        twice = items.groupBy("item").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("item")
        counts = items.join(twice, "item", "left_semi").groupBy("cls").agg(F.count("*").alias("shared"))
        able = own.select("cls", F.size("items").alias("n"), "sig", "odd").join(counts, "cls").where(F.col("shared") * 100 >= F.col("n") * percent)
        able = written(able, "able")
        members = members.join(able if turn else able.select("cls"), "cls", "inner" if turn else "left_semi")
    return members


def _sets(shingle: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(Words(b.column("text"), lower=True), shingle)
            sig = [np.frombuffer(x, np.uint16).view(np.int16) for x in b.column("sig").to_pylist()]
            odd = [np.packbits(np.bincount((s & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("cls"), pa.array([as_signed(s) for s in sets], pa.list_(pa.int64())), pa.array(sig, pa.list_(pa.int16())), pa.array(odd, pa.list_(pa.int64()))],
                names=["cls", "items", "sig", "odd"],
            )

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, hashes: int = 64, sigmas: float = 4.0, hub_rounds: int = 2) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, _id, _th, n_shingles, component_id, kept.

    Documents are linked where 100 * |A and B| >= percent * |A or B| on the full shingle sets (A-Z lower-cased);
    component_id is the smallest doc_id that links reach.  A text without words has an empty set and links to nothing:
    its component is its own doc_id.  Null texts are such texts.  A null doc_id takes part like any other, never names
    a component that has another id, and is kept only where its component has no id at all.  Rows repeated with the
    same doc_id are one document.  Other columns of ``docs`` are not read.
    """
    distance = allowed_distance(hashes, percent, sigmas)
    chunks = chunks_of(hashes, distance)
    text = row_keys(docs.select("doc_id", "text"))
    id_type = dict(docs.dtypes)["doc_id"]
    rows = written(
        text.mapInArrow(_signed(shingle, hashes), f"doc_id {id_type}, _id string, _th long, n_shingles long, cls long, sig binary"),
        "signed",
    )
    classes = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.min(F.struct("_id", "_th")).alias("at"), F.first("sig").alias("sig"))
    keys = classes.select("cls", "sig").mapInArrow(_keyed(chunks, hashes), "key long, chunk byte, gap byte, cls long")
    shared = written(keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"), "shared")
    hot = hot_keys(shared, ["key"], **_HOT)
    members = written(dealt(keys, shared.select("key"), ["key"], hot, ["cls"], "left_semi"), "members")
    active = members.select("cls").distinct().join(classes, "cls").select("cls", F.col("at._id").alias("_id"), F.col("at._th").alias("_th"), "sig")
    active = written(active, "active")
    sets = beside(text.select("_id", "_th", "text"), active, ["_id", "_th"], "inner").select("cls", "sig", "text").mapInArrow(_sets(shingle, hashes), "cls long, items array<long>, sig array<short>, odd array<long>")
    sets = written(sets.dropDuplicates(["cls"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        often = [hot_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), [c], **_HOT) for c in ("a", "b")]
        a = sets.select(F.col("cls").alias("a"), F.col("items").alias("ia"), F.col("sig").alias("sa"))
        b = sets.select(F.col("cls").alias("b"), F.col("items").alias("ib"), F.col("sig").alias("sb"))
        near = dealt(dealt(pairs, a, ["a"], often[0], ["b"]), b, ["b"], often[1], ["a"])
        near = near.where(F.least(F.size("ia"), F.size("ib")) * 100 >= F.greatest(F.size("ia"), F.size("ib")) * percent)
        near = near.where(f"size(filter(zip_with(sa, sb, (x, y) -> x <> y), z -> z)) <= {distance}")
        near = near.withColumn("both", F.size(F.array_intersect("ia", "ib")))
        return near.where(F.col("both") * 100 >= (F.size("ia") + F.size("ib") - F.col("both")) * percent).select("a", "b")

    links, comp = None, None
    state = members.withColumn("comp", F.col("cls"))
    for step in range(hub_rounds + 1):
        if step < hub_rounds:
            # the hub of a bucket: another order of its members in each round
            rank = F.struct(F.xxhash64("cls", F.lit(step)).alias("r"), F.col("cls").alias("b"), F.col("comp").alias("bcomp"))
            hub = state.groupBy("key").agg(F.min(rank).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "hub.b", "hub.bcomp")
            pairs = dealt(state, hub, ["key"], hot, ["cls"]).where("comp <> bcomp").select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b")).distinct()
        else:
            # what is left: members outside their bucket's largest component, with all members of other components
            state = _linkable(state, sets, percent)
            per = state.groupBy("key", "comp").agg(F.count("*").alias("n"))
            largest = per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("top.comp").alias("main"))
            left = hot_keys(per.groupBy("key").agg(F.sum("n").alias("n")), ["key"], **_HOT)
            rest = dealt(state, largest, ["key"], left, ["cls"])
            few = rest.where("comp <> main").select("key", F.col("cls").alias("x"), F.col("comp").alias("xc"), F.col("n").alias("xn"), F.col("shared").alias("xs"), F.col("sig").alias("xsig"), F.col("odd").alias("xodd"))
            # places where the sketches differ are a lower bound of how many items only one of the two sets has
            apart = "aggregate(zip_with(odd, xodd, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)"
            near = f"xc <> comp and (comp = main or x < cls) and least(shared, xs) * {100 + percent} >= (n + xn) * {percent} and {apart} * {100 + percent} <= (n + xn) * {100 - percent} and {_first_chunk(chunks, distance)}"
            # both sides may have many rows of a key here, which adaptive execution splits; salts would repeat one side
            pairs = few.join(rest.select("key", "chunk", "gap", "cls", "comp", "main", "n", "shared", "sig", "odd"), "key").where(near).select(F.least("cls", "x").alias("a"), F.greatest("cls", "x").alias("b")).distinct()
        new = written(confirmed(pairs), "links")
        if links is not None and new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        comp = written(components(links).withColumnRenamed("v", "cls"), "comp")
        if step < hub_rounds:
            state = members.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    classed = classes.select("cls", "low").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = classed.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = classed.select("cls", "comp").join(least, "comp").select("cls", "component_id")
    out = rows.drop("sig").withColumn("cls", F.when(F.col("n_shingles") > 0, F.col("cls"))).join(named, "cls", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "_id", "_th", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one document of each component: the one whose doc_id names it.  All columns stay.

    A document without words is a component of its own and stays.
    """
    given, docs = docs, packed(docs)
    marks = near_duplicates(docs, **params).where("not kept").select("_id", "_th").distinct()
    return unpacked(beside(row_keys(docs), written(marks, "dropped"), ["_id", "_th"], "left_anti"), given)
