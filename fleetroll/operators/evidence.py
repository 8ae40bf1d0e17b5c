"""Evidence that a row of this year's model is last year's row, and the decision on it.

Rows are ``(workbook_id, sheet, row_no, label)`` with ``row_no`` numbering all rows of a workbook, edges
``(workbook_id, src, dst)`` (src reads dst), series ``(workbook_id, sheet, row_no, period_end, value)``.  Every kind of
evidence is a table ``(workbook_id, row_no, cur_row, score)``; all joins are within one workbook.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetroll.functions.figures import let
from fleetroll.sources.tables import written

from .match import norm, sheets, tokens

KEY = ["workbook_id", "row_no"]
PAIR = ["workbook_id", "row_no", "cur_row"]
#: Weights of the kinds of evidence.
WEIGHTS = {"label": 0.3, "history": 0.35, "words": 0.2, "neighbours": 0.15, "banner": 0.25, "trace": 0.5, "block": 0.3, "lineage": 0.2}
#: The score from which a kind of evidence is strong by itself.
STRONG = {"label": 0.8, "history": 0.5, "banner": 0.7, "neighbours": 0.6, "trace": 0.7}
#: Kinds of row that are what they are by their values.
FIXED_KINDS = ["dates", "flags", "factors", "share", "index"]


def _best(d: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy(F.col("score").desc(), "cur_row")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(*PAIR, "score")


def _labels(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("workbook_id", F.col("row_no").alias(name), norm(F.col("label")).alias("item")).where("item <> ''")


def _both(edges: DataFrame) -> DataFrame:
    """Edges seen from either end: ``side`` 0 for what a row reads, 1 for what reads it."""
    return edges.select("workbook_id", F.lit(0).alias("side"), F.col("src").alias("row_no"), F.col("dst").alias("other")).union(edges.select("workbook_id", F.lit(1), "dst", "src")).distinct()


def _around(edges: DataFrame, rows: DataFrame, steps: int) -> DataFrame:
    """(workbook_id, side, row_no, item): labels of the rows within one or two steps, on each side, without the row itself."""
    one = _both(edges)
    near = one
    if steps == 2:
        two = one.join(one.select("workbook_id", "side", F.col("row_no").alias("other"), F.col("other").alias("far")), ["workbook_id", "side", "other"])
        near = one.union(two.where("far <> row_no").select("workbook_id", "side", "row_no", "far")).distinct()
    return near.join(_labels(rows, "other"), ["workbook_id", "other"]).select("workbook_id", "side", "row_no", "item").distinct()


def _alike(mine: DataFrame, theirs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The mean over the sides that last year's row has of the Jaccard similarity of the items; pairs share one, or are given."""
    side = ["workbook_id", "side", "row_no"]
    na = mine.groupBy(*side).agg(F.count("*").alias("na"))
    nb = theirs.groupBy("workbook_id", "side", F.col("row_no").alias("cur_row")).agg(F.count("*").alias("nb"))
    shared = mine.join(theirs.withColumnRenamed("row_no", "cur_row"), ["workbook_id", "side", "item"])
    if pairs is not None:
        shared = shared.join(pairs.select(*PAIR).distinct(), PAIR)
    both = shared.groupBy(*side, "cur_row").agg(F.count("*").alias("both"))
    j = both.join(na, side).join(nb, ["workbook_id", "side", "cur_row"]).withColumn("j", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
    sides = na.groupBy(*KEY).agg(F.count("*").alias("sides"))
    return j.groupBy(*PAIR).agg(F.sum("j").alias("j")).join(sides, KEY).select(*PAIR, (F.col("j") / F.col("sides")).alias("score"))


def by_neighbours(edges: DataFrame, edges_now: DataFrame, rows: DataFrame, rows_now: DataFrame, least: float = 0.34, k: int = 3) -> DataFrame:
    """Rows by the labels of what they read and of what reads them: the mean Jaccard similarity of the sides that last year's row has."""
    return _best(_alike(_around(edges, rows, 1), _around(edges_now, rows_now, 1)).where(F.col("score") >= least), k)


def by_lineage(edges: DataFrame, edges_now: DataFrame, rows: DataFrame, rows_now: DataFrame, pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """The same for labels within two steps, for given candidates."""
    return _alike(_around(edges, rows, 2), _around(edges_now, rows_now, 2), pairs).where(F.col("score") >= least)


def by_banner(edges: DataFrame, edges_now: DataFrame, rows: DataFrame, rows_now: DataFrame, banner_rows: int = 10) -> DataFrame:
    """Rows that a summary row reads, where the summary row of that label reads just one row this year: .7 each, 1 at most."""
    top = lambda d, name: _labels(d.where(F.col("row_no") <= banner_rows), name)
    mine = edges.join(top(rows, "src"), ["workbook_id", "src"]).select("workbook_id", F.col("dst").alias("row_no"), "src", "item")
    below = edges_now.where(F.col("dst") > banner_rows).groupBy("workbook_id", "src").agg(F.min("dst").alias("cur_row"), F.count_distinct("dst").alias("n")).where("n = 1")
    now = below.join(top(rows_now, "src"), ["workbook_id", "src"]).select("workbook_id", "item", F.col("src").alias("cur_src"), "cur_row")
    j = mine.join(now, ["workbook_id", "item"]).select(*PAIR, "src", "cur_src").distinct()
    return j.groupBy(*PAIR).agg(F.least(F.lit(1.0), 0.7 * F.count("*")).alias("score"))


def by_block(blocks: DataFrame, blocks_now: DataFrame, least: float = 0.5, k: int = 3) -> DataFrame:
    """Rows of blocks ``(workbook_id, block, heading, row_no, label)`` whose headings share half of their words.

    The row with the same label, if there is one; if there is none and the blocks are of one size, the row in the same
    place, for .5 of the likeness (.6 where last year's row has no label).
    """
    def placed(d: DataFrame) -> tuple[DataFrame, DataFrame]:
        at = d.withColumn("place", F.row_number().over(Window.partitionBy("workbook_id", "block").orderBy("row_no"))).withColumn("label", norm(F.col("label")))
        heads = d.groupBy("workbook_id", "block").agg(tokens(F.first("heading")).alias("words"), F.count("*").alias("size"))
        return at.select("workbook_id", "block", "row_no", "label", "place"), heads

    (mine, heads), (now, heads_now) = placed(blocks), placed(blocks_now)
    now, heads_now = now.withColumnsRenamed({"block": "cur_block", "row_no": "cur_row"}), heads_now.withColumnsRenamed({"block": "cur_block", "words": "cur_words", "size": "cur_size"})
    shared = heads.withColumn("w", F.explode("words")).join(heads_now.withColumn("w", F.explode("cur_words")), ["workbook_id", "w"])
    pairs = shared.select("workbook_id", "block", "cur_block", "words", "cur_words", "size", "cur_size").distinct()
    both = F.size(F.array_intersect("words", "cur_words"))
    pairs = pairs.withColumn("j", both / (F.size("words") + F.size("cur_words") - both)).where(F.col("j") >= least).drop("words", "cur_words")
    rows = mine.join(pairs, ["workbook_id", "block"])
    same = rows.where("label <> ''").join(now.drop("place"), ["workbook_id", "cur_block", "label"]).groupBy(*KEY, "cur_block", "j").agg(F.count("*").alias("n"), F.min("cur_row").alias("cur_row"))
    found = same.where("n = 1").select(*PAIR, F.round("j", 2).alias("score"))
    rest = rows.where("size = cur_size").join(same, [*KEY, "cur_block"], "left_anti").join(now.drop("label"), ["workbook_id", "cur_block", "place"])
    there = rest.select(*PAIR, F.round(F.when(F.col("label") == "", 0.6).otherwise(0.5) * F.col("j"), 2).alias("score"))
    d = found.union(there).groupBy(*PAIR).agg(F.max("score").alias("score"))
    return _best(d, k)


def pair_scores(rows: DataFrame, rows_now: DataFrame, series: DataFrame, series_now: DataFrame, agree: DataFrame | None = None) -> DataFrame:
    """How surely a row is another by what they are: the same label 1, last year's numbers .8, most of the label's words .6.

    ``agree`` is ``numbers_agree`` of the same tables, where that is written already.
    """
    agree = numbers_agree(rows, rows_now, series, series_now) if agree is None else agree
    words = lambda d: F.sort_array(F.transform(tokens(F.col("label")), lambda x: F.xxhash64(x)))
    a = rows.select("workbook_id", "row_no", norm(F.col("label")).alias("item"), words(rows).alias("t"))
    b = rows_now.select("workbook_id", F.col("row_no").alias("cur_row"), norm(F.col("label")).alias("item"), words(rows_now).alias("u"))
    same = a.where("item <> ''").join(b.drop("u"), ["workbook_id", "item"]).select(*PAIR, F.lit(1.0).alias("q"))
    # labels that share half of their words share one of the first half of each, and one; they are compared at the first they share
    half = lambda c: F.explode(F.slice(c, 1, (F.size(c) / 2).cast("int") + 1))
    w = a.drop("item").withColumn("w", half(F.col("t"))).join(b.drop("item").withColumn("w", half(F.col("u"))), ["workbook_id", "w"])
    near = let(F.array_intersect("t", "u"), lambda i: (F.array_min(i) == F.col("w")) & (F.size(i) / (F.size("t") + F.size("u") - F.size(i)) >= 0.5))
    q = same.union(w.where(near).select(*PAIR, F.lit(0.6))).union(agree.select(*PAIR, F.lit(0.8)))
    return _listed(q).select(*KEY, F.inline("found")).select(*PAIR, "q")


def _listed(scores: DataFrame) -> DataFrame:
    """(workbook_id, row_no, found array<struct<cur_row, q>>): a row's candidates in one list, each with its highest q."""
    up = F.sort_array(F.collect_list(F.struct("cur_row", (-F.col("q")).alias("q"))))
    one = let(up, lambda x: F.filter(x, lambda p, i: (i == 0) | (F.get(x, i - 1)["cur_row"] != p["cur_row"])))
    return scores.groupBy(*KEY).agg(F.transform(one, lambda p: F.struct(p["cur_row"].alias("cur_row"), (-p["q"]).alias("q"))).alias("found"))


def numbers_agree(rows: DataFrame, rows_now: DataFrame, series: DataFrame, series_now: DataFrame, tol: float = 0.15, share: float = 0.5, cover: float = 0.8) -> DataFrame:
    """Pairs that carry last year's numbers: near in half of the periods and three (``match.near``), and holding in ``match.check``.

    A row travels with all its points.  Values fall into logarithmic buckets as wide as the tolerance; near in h of n periods,
    two rows are so in one of the first n - h + 1, so these buckets are enough, and at the smallest they share they are compared.
    """
    width = math.log1p(tol)
    bucket = lambda v: F.floor(F.log(v) / width).cast("int")
    at = F.sort_array(F.collect_list(F.when(F.col("period_end").isNotNull(), F.struct("period_end", "value"))))
    once = let(at, lambda x: F.filter(x, lambda p, i: (i == 0) | (F.get(x, i - 1)["period_end"] != p["period_end"])))
    line = lambda d: d.groupBy("workbook_id", "sheet", "row_no").agg(once.alias("at"), F.count_if(F.col("value") != 0).alias("n"))
    figures = F.filter(F.col("at")["value"], lambda v: v != 0)
    least = F.greatest(F.lit(3), F.ceil(F.col("n") * share)).cast("int")
    band = lambda v: F.sequence(bucket(F.abs(v) * (1 - tol) * (1 - 1e-9)), bucket(F.abs(v) * (1 + tol) * (1 + 1e-9)))
    p = line(series).select(*KEY, F.map_from_entries("at").alias("p"), least.alias("least"), figures.alias("v"))
    first = F.slice("v", 1, F.greatest(F.lit(0), F.size("v") - F.col("least") + 1))
    p = p.withColumn("bs", F.array_distinct(F.flatten(F.transform(first, band)))).drop("v").withColumn("b", F.explode("bs"))
    dates = series_now.where("period_end is not null").groupBy("workbook_id", "sheet").agg(F.sort_array(F.collect_set("period_end")).alias("dates"))
    c = line(series_now).join(dates, ["workbook_id", "sheet"]).select("workbook_id", F.col("row_no").alias("cur_row"), F.map_from_entries("at").alias("c"), "dates", F.array_distinct(F.transform(figures, lambda v: bucket(F.abs(v)))).alias("cs"))
    met = p.join(c.withColumn("b", F.explode("cs")), ["workbook_id", "b"]).where(F.array_min(F.array_intersect("bs", "cs")) == F.col("b"))
    off = lambda v, w: F.abs(w - v)
    hit = lambda v, w: (v != 0) & (w != 0) & (off(v, w) <= tol * F.abs(v))
    close = lambda v, w: off(v, w) / F.greatest(F.abs(v), F.abs(w), F.lit(1e-12)) <= tol
    # shared periods, near ones and close ones, each counted in 20 bits of a number
    count = lambda k, v, w: F.when(off(v, w).isNotNull(), F.lit(1).cast("bigint") + F.when(hit(v, w), 1 << 20).otherwise(0) + F.when(close(v, w), 1 << 40).otherwise(0))
    counts = F.aggregate(F.map_values(F.map_zip_with("p", "c", count)), F.lit(0).cast("bigint"), lambda t, n: t + F.coalesce(n, F.lit(0).cast("bigint")))
    could = F.size(F.array_intersect(F.map_keys("p"), F.col("dates")))
    part = lambda t, i: F.shiftright(t, i).bitwiseAND(F.lit((1 << 20) - 1))
    # the upper median of the gaps is within the tolerance where more than half of them are
    holds = lambda t: (part(t, 0) >= 3) & (part(t, 20) >= F.col("least")) & (part(t, 40) > F.floor(part(t, 0) / 2)) & (part(t, 0) >= cover * could)
    return met.where(let(counts, holds)).select(*PAIR)


def _steps(states: DataFrame, reads: DataFrame, reads_now: DataFrame, lists: DataFrame) -> DataFrame:
    """Where a walk goes on from each pair of rows ``(workbook_id, down, x, y)``: ``steps array<struct<nx, c, p>>``, as ``by_trace`` says."""
    state = ["workbook_id", "down", "x", "y"]
    # of numbers of which just one is left, xor with the others leaves that one
    odd = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda t, v: t.bitwiseXOR(v.cast("bigint")))
    of = [F.size("nxs").alias("sibs"), odd(F.col("nxs")).alias("odd_x"), F.size("cs").alias("cands"), odd(F.col("cs")).alias("odd_c")]
    s = states.join(reads, state[:3]).join(reads_now, ["workbook_id", "down", "y"]).select(*state, *of, "cs", F.explode("nxs").alias("nx"))
    s = s.join(lists.withColumnRenamed("row_no", "nx"), ["workbook_id", "nx"], "left")
    there = let(F.array_intersect(F.col("found")["cur_row"], F.col("cs")), lambda i: F.filter("found", lambda x: F.array_contains(i, x["cur_row"])))
    best = F.sort_array(F.transform(there, lambda x: F.struct((-x["q"]).alias("q"), x["cur_row"].alias("c"))))
    alone = let(best, lambda b: F.when((F.size(b) > 0) & (F.get(b, F.lit(0))["q"] <= -0.6) & ((F.size(b) == 1) | (F.get(b, F.lit(1))["q"] > F.get(b, F.lit(0))["q"])), F.struct("nx", F.get(b, F.lit(0))["c"].alias("c"), (-F.get(b, F.lit(0))["q"]).alias("p"))))
    g = s.withColumn("step", alone).groupBy(*state, "sibs", "odd_x", "cands", "odd_c").agg(F.collect_list("step").alias("steps"))
    # the one left: each of the others has a partner of .8 of its own, and one row of this year's has none
    firm = g.withColumn("firm", F.filter("steps", lambda x: x["p"] >= 0.8))
    one = (F.col("sibs") == F.col("cands")) & (F.size("firm") == F.col("sibs") - 1) & (F.size(F.array_distinct(F.col("firm")["c"])) == F.size("firm"))
    left = [F.col(o).bitwiseXOR(odd(F.col("firm")[c])).cast(g.schema["steps"].dataType.elementType[c].dataType).alias(c) for o, c in (("odd_x", "nx"), ("odd_c", "c"))]
    rest = firm.withColumn("rest", F.struct(*left, F.lit(0.6).alias("p")))
    more = one & ~F.exists("steps", lambda x: x["nx"] == F.col("rest")["nx"])
    return rest.select(*state, F.when(more, F.concat("steps", F.array("rest"))).otherwise(F.col("steps")).alias("steps"))


def by_trace(edges: DataFrame, edges_now: DataFrame, anchors: DataFrame, scores: DataFrame, agree: DataFrame, depth: int = 6, most: int = 6, k: int = 3) -> DataFrame:
    """Rows reached from anchors step by step through this year's model, down from what reads them and up from what they read.

    ``anchors(workbook_id, row_no, cur_row)`` are rows that both models share; the nearest ``most`` of a row are walked
    from each way.  A step takes this year's row that pairs best, alone, by ``scores(..., q)`` of .6 and more; else,
    if each of the other rows next to the path has a partner of .8 of its own and as many rows are there this year, the
    one left, for .6.  A way's quality is the product of its steps.  Score: the best way, .2 for the other direction, .1
    for every further way, .2 if the numbers agree, 1 at most.  Each hop's frontier is written; the steps from a pair of
    rows are found once, whichever anchors lead there.
    """
    state = ["workbook_id", "down", "x", "y"]

    def next_to(d: DataFrame, at: str, to: str) -> DataFrame:
        both = d.select("workbook_id", F.lit(True).alias("down"), F.col("src").alias(at), F.col("dst").alias("_to")).union(d.select("workbook_id", F.lit(False), "dst", "src"))
        return written(both.groupBy("workbook_id", "down", at).agg(F.collect_set("_to").alias(to)), "reads")

    # every hop reads these
    reads, reads_now, lists = next_to(edges, "x", "nxs"), next_to(edges_now, "y", "cs"), written(_listed(scores), "lists")
    front = anchors.select("workbook_id", F.explode(F.array(F.lit(True), F.lit(False))).alias("down"), F.col("row_no").alias("anchor"), F.col("row_no").alias("x"), F.col("cur_row").alias("y"), F.lit(1.0).alias("q"))
    steps = ways = None
    for hop in range(1, depth + 1):
        states = front.select(*state).distinct()
        if steps is not None:
            states = states.join(steps.select(*state), state, "left_anti")
        found = written(_steps(states, reads, reads_now, lists), "steps")
        steps = found if steps is None else steps.union(found)
        new = front.join(steps, state).select("workbook_id", "down", "anchor", "q", F.inline("steps")).where("nx <> anchor")
        # a row is walked to from an anchor by its shortest way, the best on a tie
        new = new.groupBy("workbook_id", "down", "anchor", F.col("nx").alias("x")).agg(F.max(F.struct((F.col("q") * F.col("p")).alias("q"), F.col("c").alias("y"))).alias("b")).select("workbook_id", "down", "anchor", "x", "b.y", "b.q")
        if ways is not None:
            new = new.join(ways.select("workbook_id", "down", "anchor", "x"), ["workbook_id", "down", "anchor", "x"], "left_anti")
        front = written(new, "trace")
        if front.isEmpty():
            break
        step_ways = front.withColumn("hop", F.lit(hop))
        ways = step_ways if ways is None else ways.union(step_ways)
    if ways is None:
        return anchors.select(*PAIR, F.lit(1.0).alias("score")).limit(0)
    w = Window.partitionBy("workbook_id", "x", "down").orderBy("hop", "anchor")
    out = ways.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select("workbook_id", F.col("x").alias("row_no"), F.col("y").alias("cur_row"), "down", "q")
    g = out.groupBy(*PAIR).agg(F.max("q").alias("q"), F.count_distinct("down").alias("ways"), F.count("*").alias("all"))
    g = g.join(by_row(agree), KEY, "left")
    score = F.col("q") + 0.2 * (F.col("ways") - 1) + 0.1 * (F.col("all") - F.col("ways")) + F.when(F.array_contains("found", F.col("cur_row")), 0.2).otherwise(0.0)
    return _best(g.withColumn("score", F.round(F.least(F.lit(1.0), score), 3)), k)


def by_row(pairs: DataFrame) -> DataFrame:
    """(workbook_id, row_no, found): a row's pairs in one list, a fraction of the pairs in a shuffle."""
    return pairs.groupBy(*KEY).agg(F.collect_set("cur_row").alias("found"))


def home_rows(rows: DataFrame, rows_now: DataFrame) -> DataFrame:
    """Candidates on the sheet that last year's sheet became: (workbook_id, row_no, cur_row, home)."""
    m = sheets(rows, rows_now).select("workbook_id", "sheet", "cur_sheet")
    return rows.select("workbook_id", "sheet", "row_no").join(m, ["workbook_id", "sheet"], "left")


def contradicted(pairs: DataFrame, series: DataFrame, series_now: DataFrame) -> DataFrame:
    """Pairs that share periods and agree in none of them: the label may be the same, the numbers aren't."""
    return _shared(pairs, series, series_now).groupBy(*PAIR).agg(F.max(F.col("same").cast("int")).alias("m")).where("m = 0").select(*PAIR)


def decide(
    evidence: DataFrame, rows: DataFrame, rows_now: DataFrame, odd: DataFrame, picks: DataFrame, accept: float = 0.3, confident: float = 0.5, series: DataFrame | None = None, series_now: DataFrame | None = None
) -> DataFrame:
    """The row of this year's model for every row of last year's with evidence, and how sure it is.

    ``evidence(workbook_id, row_no, cur_row, strategy, score)``; of each strategy the best counts, with its weight.  A
    candidate on the sheet that last year's sheet became gains .1, on another loses .1 (unless a trace led there); one in
    ``odd`` (another kind of row, a suspected copy) loses .2 and is never strong.  Candidates that have the same label and
    last year's numbers come first, then those with a strong kind of evidence, then by weight.  Found: strong, or
    ``accept`` and more; a trace of .7 to another row takes confidence, unless label and history agree.  ``picks``
    (workbook_id, row_no, cur_row) override.

    With the two years' series: a first candidate without last year's numbers that contradicts them gives way to the
    first one that has them (a history of .5, not odd); and one with such a history is confident where the next three
    candidates are the same series in every period, as it doesn't matter then which is meant.
    """
    best = evidence.groupBy(*PAIR, "strategy").agg(F.max("score").alias("score"))
    weight, strong_at = (F.coalesce(*[F.when(F.col("strategy") == s, F.lit(v)) for s, v in t.items()]) for t in (WEIGHTS, STRONG))
    of = lambda s: F.max(F.when(F.col("strategy") == s, F.col("score")))
    t = best.groupBy(*PAIR).agg(F.sum(weight * F.col("score")).alias("total"), F.coalesce(F.max(F.col("score") >= strong_at), F.lit(False)).alias("strong"), of("label").alias("label"), of("history").alias("history"), of("trace").alias("trace"), F.max_by("strategy", F.struct(F.round(weight * F.col("score"), 9), "strategy")).alias("how"))
    home = home_rows(rows, rows_now).select(*KEY, "cur_sheet")
    t = t.join(home, KEY, "left").join(rows_now.select("workbook_id", F.col("row_no").alias("cur_row"), F.col("sheet").alias("at_sheet")), ["workbook_id", "cur_row"], "left")
    t = t.join(odd.select(*PAIR).distinct().withColumn("_odd", F.lit(True)), PAIR, "left").withColumn("odd", F.coalesce("_odd", F.lit(False)))
    place = F.when(F.col("cur_sheet").isNull(), 0.0).when(F.col("at_sheet") == F.col("cur_sheet"), 0.1).when(F.col("trace").isNotNull(), 0.0).otherwise(-0.1)
    t = t.withColumn("total", F.round(F.col("total") + place - F.when(F.col("odd"), 0.2).otherwise(0.0), 9)).withColumn("strong", F.col("strong") & ~F.col("odd"))
    t = t.withColumn("sure", (F.coalesce("label", F.lit(0.0)) >= 1) & F.col("history").isNotNull() & ~F.col("odd"))
    if series is None:
        t = t.withColumns({"_contra": F.lit(False), "_sig": F.lit(None).cast("long")})
    else:
        t = t.join(contradicted(t.select(*PAIR), series, series_now).withColumn("_c", F.lit(True)), PAIR, "left").withColumn("_contra", F.coalesce("_c", F.lit(False)))
        sig = series_now.groupBy("workbook_id", F.col("row_no").alias("cur_row")).agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("period_end", F.round("value", 6).alias("v"))))).alias("_sig"))
        t = t.join(sig, ["workbook_id", "cur_row"], "left")
    own = Window.partitionBy(*KEY)
    t = t.withColumn("_r", F.row_number().over(own.orderBy(F.col("sure").desc(), F.col("strong").desc(), F.col("total").desc(), "cur_row")))
    led = F.max_by(F.when(F.col("trace").isNotNull(), F.col("cur_row")), F.struct("trace", "cur_row")).over(own), F.max("trace").over(own)
    has_history = (F.coalesce("history", F.lit(0.0)) >= 0.5) & ~F.col("odd")
    t = t.withColumns({"_led": led[0], "_lead": led[1], "_hist": F.min(F.when(has_history, F.col("_r"))).over(own), "_gives": F.max((F.col("_r") == 1) & F.col("history").isNull() & F.col("_contra")).over(own)})
    t = t.withColumn("_next", F.collect_list(F.when(F.col("_r").between(2, 4), F.coalesce("_sig", F.lit(0)))).over(own))
    t = t.where(F.col("_r") == F.when(F.col("_gives") & F.col("_hist").isNotNull(), F.col("_hist")).otherwise(1))
    away = (F.coalesce("_lead", F.lit(0.0)) >= 0.7) & (F.col("_led") != F.col("cur_row")) & F.col("trace").isNull() & ~(F.col("label").isNotNull() & F.col("history").isNotNull())
    alike = has_history & (F.size("_next") > 0) & F.coalesce(F.forall("_next", lambda x: x == F.col("_sig")), F.lit(False))
    sure = F.when(alike, F.greatest("total", F.lit(confident))).otherwise(F.col("total"))
    t = t.withColumn("found", F.col("strong") | (F.col("total") >= accept))
    t = t.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(away, F.least(sure, F.lit(confident - 0.01))).otherwise(sure))))
    p = picks.select(*KEY, F.col("cur_row").alias("_pick"), F.lit(True).alias("_picked"))
    t = t.join(p, KEY, "left").withColumn("_picked", F.coalesce("_picked", F.lit(False)))
    status = F.when(F.col("_picked"), "picked").when(~F.col("found"), "open").when(F.col("confidence") >= confident, "confident").otherwise("accepted")
    return t.select(*KEY, F.when(F.col("_picked"), F.col("_pick")).otherwise(F.col("cur_row")).alias("cur_row"), F.when(F.col("_picked"), 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("_picked"), "pick").otherwise(F.col("how")).alias("how"), status.alias("status"))


def other_shape(pairs: DataFrame, cells: DataFrame, cells_now: DataFrame, share: float = 0.6) -> DataFrame:
    """Pairs whose shares of formulas differ by ``share``: ``cells(workbook_id, row_no, n_formula, n_const)``."""
    f = lambda d, name: d.where("n_formula + n_const > 0").select("workbook_id", F.col("row_no").alias(name), (F.col("n_formula") / (F.col("n_formula") + F.col("n_const"))).alias(f"{name}_f"))
    j = pairs.select(*PAIR).distinct().join(f(cells, "row_no"), KEY).join(f(cells_now, "cur_row"), ["workbook_id", "cur_row"])
    return j.where(F.abs(F.col("row_no_f") - F.col("cur_row_f")) >= share).select(*PAIR)


def kind_clash(pairs: DataFrame, kinds: DataFrame, kinds_now: DataFrame) -> DataFrame:
    """Pairs of another kind by their values: ``kinds(workbook_id, row_no, kind)``."""
    j = pairs.select(*PAIR).distinct().join(kinds.select(*KEY, "kind"), KEY).join(kinds_now.select("workbook_id", F.col("row_no").alias("cur_row"), F.col("kind").alias("cur_kind")), ["workbook_id", "cur_row"])
    return j.where((F.col("kind") != F.col("cur_kind")) & (F.col("kind").isin(FIXED_KINDS) | F.col("cur_kind").isin(FIXED_KINDS))).select(*PAIR)


def _shared(pairs: DataFrame, series: DataFrame, series_now: DataFrame) -> DataFrame:
    """Periods in which both rows of a pair have a value and last year's isn't nil; ``same`` where they agree."""
    j = pairs.select(*PAIR).distinct().join(series.select(*KEY, "period_end", "value").where("value <> 0"), KEY)
    j = j.join(series_now.select("workbook_id", F.col("row_no").alias("cur_row"), "period_end", F.col("value").alias("now")), ["workbook_id", "cur_row", "period_end"])
    return j.withColumn("same", F.abs(F.col("now") - F.col("value")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("value")))


def pasted_copies(pairs: DataFrame, series: DataFrame, series_now: DataFrame, shapes: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of another shape (``shapes``) that agree in all shared periods, ``least`` or more: last year's figures pasted in."""
    g = _shared(pairs.join(shapes, PAIR, "left_semi"), series, series_now).groupBy(*PAIR).agg(F.count("*").alias("n"), F.every("same").alias("all"))
    return g.where((F.col("n") >= least) & F.col("all")).select(*PAIR)


def suspect_copies(pairs: DataFrame, matches: DataFrame, series: DataFrame, series_now: DataFrame, since: Column, least: int = 3) -> DataFrame:
    """Pairs that agree in all periods after ``since``, while another row of last year's sheet was revised.

    ``matches(workbook_id, row_no, cur_row)`` says where the other rows are now.
    """
    g = _shared(pairs, series, series_now).where(F.col("period_end") > since).groupBy(*PAIR).agg(F.count("*").alias("n"), F.every("same").alias("all"))
    still = g.where((F.col("n") >= least) & F.col("all")).select(*PAIR)
    at = series.select("workbook_id", "sheet", "row_no").distinct()
    m = _shared(matches, series, series_now).where(F.col("period_end") > since).groupBy(*PAIR).agg(F.count("*").alias("n"), F.every("same").alias("all"))
    revised = m.where((F.col("n") >= least) & ~F.col("all")).join(at, KEY).select("workbook_id", "sheet", F.col("row_no").alias("other")).groupBy("workbook_id", "sheet").agg(F.collect_set("other").alias("revised"))
    j = still.join(at, KEY).join(revised, ["workbook_id", "sheet"])
    return j.where(F.size(F.array_remove("revised", F.col("row_no"))) > 0).select(*PAIR)


def resolve_copies(cands: DataFrame, headings: DataFrame, headings_now: DataFrame, reaches: DataFrame, lengths: DataFrame, home: DataFrame) -> DataFrame:
    """Which of several copies of a row is meant: (workbook_id, row_no, cur_row, how), or cur_row null where it stays open.

    In order: the one copy whose heading is last year's, or the one whose heading shares .75 of its words and .5 more
    than the next; the one that reaches the value (``reaches``: pairs whose rows reach the same value row); the one with
    last year's period length (``lengths(..., prior_months, months)``); the one on the home sheet (``home``).  Never the first.
    """
    n = cands.groupBy(*KEY).agg(F.count_distinct("cur_row").alias("n")).where("n > 1").select(*KEY)
    c = cands.select(*PAIR).distinct().join(n, KEY)
    # a heading's words are found once a row, not once a pair
    head = lambda d, name, h: d.select("workbook_id", F.col("row_no").alias(name), F.lower("heading").alias(h), tokens(F.lower("heading")).alias(f"{h}_words"))
    h = c.join(written(head(headings, "row_no", "h"), "headings"), KEY).join(written(head(headings_now, "cur_row", "g"), "headings"), ["workbook_id", "cur_row"])
    both = F.size(F.array_intersect("h_words", "g_words"))
    fit = both / F.greatest(F.lit(1), F.size("h_words") + F.size("g_words") - both)
    h = h.select(*PAIR, (F.col("h") == F.col("g")).alias("exact"), fit.alias("fit"))
    w = Window.partitionBy(*KEY).orderBy(F.col("fit").desc(), "cur_row")
    ranked = h.withColumns({"_next": F.coalesce(F.lead("fit").over(w), F.lit(0.0)), "_r": F.row_number().over(w)})
    only = lambda d, name, rank: d.groupBy(*KEY).agg(F.count_distinct("cur_row").alias("_n"), F.min("cur_row").alias("cur_row")).where("_n = 1").select(*PAIR, F.lit(name).alias("how"), F.lit(rank).alias("rank"))
    near = ranked.where("_r = 1 and fit >= 0.75 and fit - _next >= 0.5").select(*PAIR, F.lit("heading words").alias("how"), F.lit(2).alias("rank"))
    found = only(h.where("exact"), "heading", 1).union(near).union(only(c.join(reaches.select(*PAIR), PAIR, "left_semi"), "value", 3))
    found = found.union(only(c.join(lengths.where("prior_months = months").select(*PAIR), PAIR, "left_semi"), "period length", 4)).union(only(c.join(home.select(*PAIR), PAIR, "left_semi"), "home sheet", 5))
    first = found.groupBy(*KEY).agg(F.min(F.struct("rank", "cur_row", "how")).alias("b")).select(*KEY, "b.cur_row", "b.how")
    return n.join(first, KEY, "left").select(*KEY, "cur_row", F.coalesce("how", F.lit("open")).alias("how"))


def new_lines(lines: DataFrame, read: DataFrame, edges_now: DataFrame, matches: DataFrame, nil_before: DataFrame, k: int = 12) -> DataFrame:
    """This year's cash-flow rows that the value doesn't read and last year's model had not: the k largest of a workbook.

    ``lines(workbook_id, row_no, total)`` are F6's rows; those in ``read`` go, those that feed a read row, and those that
    are the confident match of a row of last year's, unless that was nil after the date (``nil_before``).
    """
    feeds = edges_now.join(read.select("workbook_id", F.col("row_no").alias("src")), ["workbook_id", "src"]).select("workbook_id", F.col("dst").alias("row_no"))
    known = matches.where("confidence >= 0.5").join(nil_before.select(*KEY), KEY, "left_anti").select("workbook_id", F.col("cur_row").alias("row_no"))
    d = lines
    for gone in (read.select("workbook_id", "row_no"), feeds, known):
        d = d.join(gone.distinct(), KEY, "left_anti")
    w = Window.partitionBy("workbook_id").orderBy(F.abs("total").desc(), "row_no")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
