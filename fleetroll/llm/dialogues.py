"""Conversation repair: the cheapest edits that give a legal order of roles, found from both ends of an edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# ---------------------------------------------------------------- the lattice

#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. What each role's initial leads to.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_DONE = (0, 3)
_NAMES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults of a row; the first two must be deleted.
BLANK, DUPLICATE, CUT = 1, 2, 3


def _edges(i: int, q: int, rows: list[tuple[str, int]]) -> Iterator[tuple[int, int, int, str]]:
    """Ways on from ``i`` rows read in state ``q``: (rows read, state, cost, letter)."""
    for r in "ua":
        if (to := _STEP.get((q, r))) is not None:
            yield i, to, INSERT, "I"
    if i == len(rows):
        return
    initial, fault = rows[i]
    yield i + 1, q, DELETE, "D"
    if fault in (BLANK, DUPLICATE):
        return
    extra = TRUNCATED if fault == CUT else 0
    if (to := _STEP.get((q, initial))) is not None:
        yield i + 1, to, KEEP + extra, "K"
    for r in "ua":
        if (to := _STEP.get((q, r))) is not None:
            yield i + 1, to, REROLE + extra, "R"


def cheapest(rows: list[tuple[str, int]], start: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and audit of the cheapest way through ``rows`` (role initial, fault) from state ``start`` to one of ``ends``.

    Dijkstra from both sides: heaps by cost, and at equal cost by rows read, so that edges without cost are followed
    before a node settles and its least audit is final.  Both run on until their tops cost more together than the best
    way found, so every way of that cost has an edge from a node of the first to a node of the second; among those
    crossings the least audit in ASCII order is taken.  Two audits of equal cost that lead to the same node are never
    one the prefix of the other, as letters fix the state; the lesser part thus gives the lesser whole.
    """
    n = len(rows)
    back: dict[tuple[int, int], list[tuple[int, int, int, str]]] = {}
    for i in range(n + 1):
        for q in range(4):
            for j, to, c, letter in _edges(i, q, rows):
                back.setdefault((j, to), []).append((i, q, c, letter))
    best = {0: {(0, start): (0, "")}, 1: {(n, q): (0, "") for q in ends}}
    heaps = {0: [(0, 0, start)], 1: [(0, -n, q) for q in ends]}
    settled: dict[int, set] = {0: set(), 1: set()}
    found: tuple[int, str] | None = None

    def cross(here: tuple[int, str], c: int, letter: str, there: tuple[int, str]) -> None:
        nonlocal found
        way = (here[0] + c + there[0], here[1] + letter + there[1])
        if found is None or way < found:
            found = way

    while heaps[0] and heaps[1] and (found is None or heaps[0][0][0] + heaps[1][0][0] <= found[0]):
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        c, i, q = heappop(heaps[side])
        at = (abs(i), q)
        if at in settled[side] or c > best[side][at][0]:
            continue
        settled[side].add(at)
        mine = best[side][at]
        if at in settled[1 - side]:
            cross(*((mine, 0, "", best[1][at]) if side == 0 else (best[0][at], 0, "", mine)))
        for j, to, step, letter in _edges(*at, rows) if side == 0 else back.get(at, ()):
            if (j, to) in settled[1 - side]:
                cross(*((mine, step, letter, best[1][j, to]) if side == 0 else (best[0][j, to], step, letter, mine)))
            way = (c + step, mine[1] + letter if side == 0 else letter + mine[1])
            if (j, to) not in settled[side] and ((j, to) not in best[side] or way < best[side][j, to]):
                best[side][j, to] = way
                heappush(heaps[side], (way[0], j if side == 0 else -j, to))
    return found


def replayed(rows: list[tuple[str, str]], audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """The rows (role, text) after the audit's edits, and the state they end in; inserted texts are empty."""
    out, i = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[i]
        i += letter != "I"
        if letter == "D":
            continue
        if letter != "K":
            role = _NAMES["a" if state == 2 else "u"]
        state = _STEP[state, role[:1]]
        out.append((role, text))
    return out, state


def _structs(rows: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"role": r, "text": t} for r, t in rows]


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


# ---------------------------------------------------------------- on Spark

_WS = r"\\x20\\x09-\\x0D"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` damaged by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops the row, 1 empties its text, 2 takes the ends of sentences out of it, 3 repeats it, 4 makes it the user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    d = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_c")).drop("_c")


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with equal ones as one row of ``n`` copies, and the ``fault`` of the first copy; later copies are duplicates or blank."""
    d = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    d = written(d.withColumns({"_k": F.coalesce(F.col("conv_id").cast("string"), F.lit("~null")), "_t": F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))}), "turns")
    first = d.groupBy("_k", "role", "text").agg(F.min("_t").alias("_first"))  # minima meet before the shuffle
    d = d.join(first, ["_k", "role", "text"])
    last = F.expr(f"right(regexp_replace(text, '[{_WS}]+\\\\z', ''), 1)")
    fault = F.when(F.expr(f"NOT text RLIKE '[^{_WS}]'"), BLANK).when(F.col("_t") != F.col("_first"), DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    return d.withColumn("fault", fault).drop("_first")


def _pieces(most: int):
    """Runs of at most ``most`` rows of one conversation, in the order of the partition, as (key, rows, open).

    A run is closed if the conversation surely has no other: it is neither cut off nor at an end of the partition.
    """

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list, bool]]:
        key, rows, first, cut = None, [], True, False
        for b in batches:
            for k, role, text, fault, n in zip(b["_k"], b["role"], b["text"], b["fault"], b["n"]):
                if k != key and rows:
                    yield key, rows, first or cut
                    rows, first, cut = [], False, False
                key = k
                for c in range(n):
                    if len(rows) == most:
                        yield key, rows, True
                        rows, cut = [], True
                    rows.append((role, text, fault if c == 0 or fault == BLANK else DUPLICATE))
        if rows:
            yield key, rows, True

    return runs


_ROW = "struct<role: string, text: string>"
_FOUND = f"_k string, part int, seg long, open boolean, bad long, first string, last string, cost long, audit string, state int, ways array<struct<a: int, b: int, cost: long, audit: string>>, rows array<{_ROW}>"


def _searched(most: int):
    """Closed runs are solved; open ones get the cheapest way between each two states, and keep their rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seg, out, held = TaskContext.get().partitionId(), 0, [], 0
        for key, rows, is_open in _pieces(most)(batches):
            short = [(r[:1], f) for r, _, f in rows]
            own = [(r, t) for r, t, _ in rows]
            initials = [r for r, _ in short]
            seg += 1
            head = (key, part, seg, is_open, illegal(initials), initials[0], initials[-1])
            if is_open:
                ways = [dict(a=a, b=b, cost=w[0], audit=w[1]) for a in range(4) for b in range(4) if (w := cheapest(short, a, (b,))) is not None]
                out.append((*head, None, None, None, ways, _structs(own)))
            else:
                cost, audit = cheapest(short, 0, _DONE)
                out.append((*head, cost, audit, 0, None, _structs(replayed(own, audit, 0)[0])))
            held += sum(len(t) for _, t in own)
            if held > 1 << 22:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return run


_COLUMNS = ["_k", "part", "seg", "open", "bad", "first", "last", "cost", "audit", "state", "ways", "rows"]


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """The cheapest way through the runs of one conversation: each run's part of it, and the state it starts in.

    A state keeps its cost and, as links, the audits that led there; of two ways at equal cost the lesser audit stays.
    """
    pieces = pieces.sort_values(["part", "seg"])
    at: dict[int, tuple[int, str, tuple | None]] = {0: (0, "", None)}
    for ways in pieces["ways"]:
        new: dict[int, tuple[int, str, tuple | None]] = {}
        for w in ways:
            if (have := at.get(w["a"])) is None:
                continue
            way = (have[0] + w["cost"], have[1] + w["audit"])
            if w["b"] not in new or way < new[w["b"]][:2]:
                new[w["b"]] = (*way, (have[2], w["a"], w["cost"], w["audit"]))
        at = new
    link = min((at[q] for q in _DONE if q in at), key=lambda x: x[:2])[2]
    path = []
    while link:
        path.append(link[1:])
        link = link[0]
    between = [0, *(int(illegal([a, b])) for a, b in zip(pieces["last"], pieces["first"].iloc[1:]))]
    state, cost, audit = zip(*path[::-1])
    return pd.DataFrame({"_k": pieces["_k"], "part": pieces["part"], "seg": pieces["seg"], "state": state, "cost": cost, "audit": audit, "bad": pieces["bad"] + between})


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        b["rows"] = [_structs(replayed([(r["role"], r["text"]) for r in rows], a, int(s))[0]) for rows, a, s in zip(b["rows"], b["audit"], b["state"])]
        yield b


def repair(rows: DataFrame, most: int = 128) -> DataFrame:
    """Repaired conversations, in runs of at most ``most`` turns: (_k, part, seg, cost, audit, bad, rows).

    ``rows`` comes from ``with_faults``.  Turns are put in order by a range sort, which may cut a conversation of any
    size over many tasks; a run that may be a part of one is solved between every two states of the lattice, and the
    parts are then composed from those costs alone.  ``_k`` is the conversation's id as text, ``part`` and ``seg``
    order its runs, ``rows`` are the roles and texts after repair, ``bad`` counts illegal neighbours before it.
    Turns that are equal in number come in the order of role and text.
    """
    order = ["_k", "_t", "role", "text"]
    line = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("_k", "role", "text", "fault", "n")
    found = written(line.mapInPandas(_searched(most), _FOUND), "runs")
    done = found.where("NOT open").select("_k", "part", "seg", "cost", "audit", "bad", "rows")
    some = found.where("open")
    paths = some.select("_k", "part", "seg", "bad", "first", "last", "ways").groupBy("_k").applyInPandas(_joined, "_k string, part int, seg long, state int, cost long, audit string, bad long")
    schema = f"_k string, part int, seg long, state int, cost long, audit string, bad long, rows array<{_ROW}>"
    again = paths.join(some.select("_k", "part", "seg", "rows"), ["_k", "part", "seg"]).select("_k", "part", "seg", "state", "cost", "audit", "bad", "rows")
    return done.unionByName(again.mapInPandas(_rebuilt, schema).drop("state"))


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """sha256 of ``role:text`` lines joined by newlines, over a partition sorted by conversation; holds one batch."""
    key, own, some, out = None, None, False, []
    for b in batches:
        for k, rows in zip(b["_k"], b["rows"]):
            if k != key:
                if own:
                    out.append((key, own.hexdigest()))
                key, own, some = k, hashlib.sha256(), False
            for r in rows:
                own.update((("\n" if some else "") + f"{r['role']}:{r['text']}").encode())
                some = True
        yield pd.DataFrame(out, columns=["_k", "repaired_sha256"])
        out = []
    if own:
        yield pd.DataFrame([(key, own.hexdigest())], columns=["_k", "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """One digest a conversation; its runs come to one task in order, as a digest needs, and only pass through it."""
    line = repaired.select("_k", "part", "seg", "rows").repartition("_k").sortWithinPartitions("_k", "part", "seg")
    return line.select("_k", "rows").mapInPandas(_digested, "_k string, repaired_sha256 string")


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("~null"))


def report(conversations: DataFrame, rows: DataFrame, most: int = 128) -> DataFrame:
    """One row for every conv_id of ``conversations``: faults of ``rows``, what the repair costs, its audit and digest.

    ``rows(conv_id, turn, role, text)`` are the turns to repair, ``conversations`` the ids to report on.  A null conv_id
    is one conversation.  Rows without a turn come first; where no row has one, there are no gaps.  Conversations
    without rows have zeros, no audit and the digest of an empty text; an empty table gives no rows.  Null roles and
    texts are one space; an empty role has no legal initial.  Repeated rows are each a row.
    """
    empty = hashlib.sha256(b"").hexdigest()
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = written(with_faults(rows), "faults")
    turns = rows.groupBy("_k", "turn").agg(F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("fault") == BLANK, 0).when(F.col("fault") == DUPLICATE, F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"), F.sum((F.col("fault") == CUT).cast("long")).alias("truncated"))
    counts = turns.groupBy("_k").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    fixed = written(repair(rows, most), "repaired")
    costs = fixed.groupBy("_k").agg(F.sum("cost").alias("cost"), F.sum("bad").alias("illegal"), F.expr("array_join(array_sort(collect_list(struct(part, seg, audit))).audit, '')").alias("audit"))
    ids = conversations.select("conv_id").distinct().withColumn("_k", _key(F.col("conv_id")))
    d = ids.join(counts, "_k", "left").join(costs, "_k", "left").join(digests(fixed), "_k", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
