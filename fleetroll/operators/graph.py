"""Dependency graphs as edge lists: filters, reach, paths, degrees, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetroll.sources.tables import written

#: Strength of a kind of edge.
RANK = {"direct": 3, "offset": 2, "active": 1, "inactive": 0}


def edges(raw: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The strongest kind of every pair, without loops; with ``items(node)``, between line items only."""
    if items is not None:
        for end in ("src", "dst"):
            raw = raw.join(items.select(F.col("node").alias(end)), end, "left_semi")
    r = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in RANK.items()], F.lit(-1))
    return raw.where("src <> dst").groupBy("src", "dst").agg(F.max_by("kind", r).alias("kind"))


def reach(e: DataFrame, starts: DataFrame, direction: str = "down", depth: int = 12) -> DataFrame:
    """(start, node, depth): nodes within ``depth`` steps with the depth of the first visit; inactive edges aren't followed.

    'down' goes from a reader to what it reads.  Every hop's frontier is written, and nodes seen before are left out.
    """
    e = e.where("kind <> 'inactive'").select("src", "dst")
    if direction == "up":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, depth + 1):
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node")).distinct()
        front = written(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def paths(e: DataFrame, starts: DataFrame, goals: DataFrame, depth: int = 12) -> DataFrame:
    """(start, goal, path): a shortest path by the smallest nodes on ties, where there is one."""
    e = e.where("kind <> 'inactive'").select("src", "dst")
    front = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct()
    seen = front
    for _ in range(depth):
        step = front.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        front = written(step.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "paths")
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen.join(goals.select("node").distinct(), "node").select("start", F.col("node").alias("goal"), "path")


#: Kinds of rows that a value is made from, in the end.
INPUT_KINDS = ("inputs", "figure", "index", "share")


def leaves(e: DataFrame, starts: DataFrame, depth: int = 12, kinds: DataFrame | None = None) -> DataFrame:
    """(start, node): what the starts read in the end, that is, reached nodes that read nothing; of INPUT_KINDS if ``kinds(node, kind)`` are given."""
    return _ends(reach(e, starts, "down", depth), e, kinds)


def _ends(reached: DataFrame, e: DataFrame, kinds: DataFrame | None) -> DataFrame:
    live = e.where("kind <> 'inactive'")
    out = reached.where("depth > 0").join(live.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    if kinds is not None:
        out = out.join(kinds.where(F.col("kind").isin(*INPUT_KINDS)).select("node").distinct(), "node", "left_semi")
    return out.select("start", "node")


def to_value(e: DataFrame, starts: DataFrame, targets: DataFrame, depth: int = 12) -> DataFrame:
    """(start, path): a shortest path from each start up through its readers to a target, by the smallest nodes on ties.

    Searched from both sides, half the depth each: starts go up to their readers and targets down to what they read, and
    they meet on a node; each side is a table of (its end, node, path), so the far larger middle of the graph is never
    walked from one side.  A start that is a target is its own path; a start that reaches none has no row.
    """
    live = e.where("kind <> 'inactive'").select(F.col("dst").alias("from"), F.col("src").alias("to")).distinct()

    def grown(ends: DataFrame, at: str, to: str, add) -> DataFrame:
        front = ends.select(F.col("node").alias("end"), "node", F.array("node").alias("path")).distinct()
        seen = front
        for _ in range((depth + 1) // 2):
            step = front.join(live.select(F.col(at).alias("node"), F.col(to).alias("next")), "node").select("end", F.col("next").alias("node"), add().alias("path"))
            step = step.groupBy("end", "node").agg(F.min("path").alias("path"))
            front = written(step.join(seen.select("end", "node"), ["end", "node"], "left_anti"), "half")
            if front.isEmpty():
                break
            seen = seen.union(front)
        return seen

    up = grown(starts, "from", "to", lambda: F.concat("path", F.array("next")))
    down = grown(targets, "to", "from", lambda: F.concat(F.array("next"), "path"))
    # of a node's ways to a target the nearest is enough
    down = down.groupBy("node").agg(F.min(F.struct(F.size("path").alias("n"), F.col("path").alias("rest"))).alias("b"))
    met = up.join(down, "node").select(F.col("end").alias("start"), F.concat("path", F.slice("b.rest", 2, F.size("b.rest"))).alias("path"))
    return met.where(F.size("path") <= depth + 1).groupBy("start").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("b")).select("start", "b.path")


def lineage(e: DataFrame, starts: DataFrame, kinds: DataFrame, targets: DataFrame, depth: int = 12) -> DataFrame:
    """(start, upstream, inputs, reaches_value, via): how many rows a row is worked out from, its inputs at the ends, and
    whether its figures reach the value rows, and by which rows.  Edges and starts are written, as every hop reads them, and
    what is reached is found once."""
    e, starts = written(e, "edges"), written(starts.select("node").distinct(), "starts")
    reached = reach(e, starts, "down", depth)
    up = reached.where("depth > 0").groupBy("start").agg(F.count("*").alias("upstream"))
    own = _ends(reached, e, kinds).groupBy("start").agg(F.array_sort(F.collect_list("node")).alias("inputs"))
    d = starts.select(F.col("node").alias("start")).join(up, "start", "left").join(own, "start", "left").join(to_value(e, starts, targets, depth), "start", "left")
    return d.select("start", F.coalesce("upstream", F.lit(0)).alias("upstream"), F.coalesce("inputs", F.array()).alias("inputs"), F.col("path").isNotNull().alias("reaches_value"), F.col("path").alias("via"))


def degree(e: DataFrame) -> DataFrame:
    """Readers and reads of each node, over live edges."""
    live = e.where("kind <> 'inactive'")
    i = live.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("read_by"))
    o = live.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("reads"))
    return i.join(o, "node", "full").select("node", F.coalesce("read_by", F.lit(0)).alias("read_by"), F.coalesce("reads", F.lit(0)).alias("reads"))


def summary(e: DataFrame, rows: DataFrame, k: int = 15) -> DataFrame:
    """The dependencies of a workbook in one table: (workbook_id, what, name, n, sheets).

    'kind': edges by kind; 'flow': live edges from sheet to sheet, of different sheets; 'most read' and 'most reading': the
    k rows with most live edges, and with how many sheets.  ``e(workbook_id, src, dst, kind)``, ``rows(workbook_id, row_no,
    sheet)``.
    """
    from pyspark.sql import Window

    at = lambda c: rows.select("workbook_id", F.col("row_no").alias(c), F.col("sheet").alias(f"{c}_sheet"))
    d = e.join(at("src"), ["workbook_id", "src"]).join(at("dst"), ["workbook_id", "dst"])
    live = d.where("kind <> 'inactive'")
    none = F.lit(None).cast("long")
    out = d.groupBy("workbook_id", F.lit("kind").alias("what"), F.col("kind").alias("name")).agg(F.count("*").alias("n")).withColumn("sheets", none)
    flow = live.where("src_sheet <> dst_sheet").groupBy("workbook_id", F.lit("flow").alias("what"), F.concat_ws(">", "src_sheet", "dst_sheet").alias("name")).agg(F.count("*").alias("n")).withColumn("sheets", none)
    out = out.union(flow)
    for what, own, other in (("most read", "dst", "src_sheet"), ("most reading", "src", "dst_sheet")):
        g = live.groupBy("workbook_id", F.col(own).alias("row")).agg(F.count("*").alias("n"), F.count_distinct(other).alias("sheets"))
        w = Window.partitionBy("workbook_id").orderBy(F.col("n").desc(), "row")
        top = g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        out = out.union(top.select("workbook_id", F.lit(what), F.col("row").cast("string"), "n", "sheets"))
    return out


def families(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(member, family): components of similar pairs, named by their smallest member. Labels fall until none changes."""
    both = written(pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).union(pairs.select(b, a)).distinct(), "pairs")
    label = both.select(F.col("x").alias("member")).distinct().withColumn("family", F.col("member"))
    while True:
        near = both.join(label, F.col("y") == F.col("member")).groupBy("x").agg(F.min("family").alias("low"))
        new = label.join(near, F.col("member") == F.col("x")).select("member", F.least("family", "low").alias("new"), "family")
        jump = new.select("member", "new", "family").join(new.select(F.col("member").alias("m2"), F.col("new").alias("n2")), F.col("new") == F.col("m2"))
        nxt = written(jump.select("member", F.least("new", "n2").alias("low"), "family"), "families")
        label = nxt.select("member", F.col("low").alias("family"))
        if nxt.where("low <> family").isEmpty():
            return label
