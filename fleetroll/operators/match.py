"""Matching last year's rows with this year's, and versions and workbooks with each other."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetroll.functions.figures import let
from fleetroll.sources.tables import written

STOP = ["the", "and", "of", "for", "to", "in"]


def norm(label: Column) -> Column:
    """Lower case, runs of space as one."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"\s+", " "))


def tokens(label: Column) -> Column:
    """Distinct words of two letters and digits at least that start with a letter, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(label, F.lit(""))), F.lit(r"([a-z][a-z0-9]+)"), 1)
    # sorted, equal ones stand together: no comparison of all with all
    return let(F.array_sort(F.filter(words, lambda x: ~x.isin(*STOP))), lambda w: F.filter(w, lambda x, i: (i == 0) | (F.get(w, i - 1) != x)))


def by_label(prior: DataFrame, current: DataFrame, in_place: float = 0.8) -> DataFrame:
    """Rows with the same sheet, label and occurrence; else the row of that label nearest in place; else the same row.

    The last only on sheets of which ``in_place`` of last year's labelled rows still have their label at their place.
    ``how`` says which; rows without any are left out.
    """
    def numbered(d: DataFrame) -> DataFrame:
        d = d.withColumn("label", norm(F.col("label")))
        return d.withColumn("occ", F.row_number().over(Window.partitionBy("workbook_id", "sheet", "label").orderBy("row_no")))

    p, c = numbered(prior), numbered(current)
    key, row = ["workbook_id", "sheet", "label"], ["workbook_id", "sheet", "row_no"]
    labelled = p.where("label <> ''")
    same = labelled.join(c.select(*key, "occ", F.col("row_no").alias("cur_row")), [*key, "occ"]).select(*row, "cur_row", F.lit("label").alias("how"))
    rest = labelled.join(same.select(*row), row, "left_anti")
    near = rest.join(c.select(*key, F.col("row_no").alias("cur_row")), key)
    w = Window.partitionBy(*row).orderBy(F.abs(F.col("row_no") - F.col("cur_row")), "cur_row")
    near = near.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*row, "cur_row", F.lit("nearest").alias("how"))
    found = same.union(near)
    there = labelled.join(c.select(*row, F.col("label").alias("_now")), row, "left")
    still = there.groupBy("workbook_id", "sheet").agg(F.avg((F.coalesce("_now", F.lit("")) == F.col("label")).cast("int")).alias("_share")).where(F.col("_share") >= in_place)
    left = p.join(found.select(*row), row, "left_anti").join(still.select("workbook_id", "sheet"), ["workbook_id", "sheet"], "left_semi")
    return found.union(left.join(c.select(*row), row, "left_semi").select(*row, F.col("row_no").alias("cur_row"), F.lit("same row").alias("how")))


def sheets(prior: DataFrame, current: DataFrame, own: float = 0.35, other: float = 0.5, tie: float = 0.05) -> DataFrame:
    """(workbook_id, sheet, cur_sheet): the same name if labels agree enough, else the best other sheet unless two tie."""
    a = prior.select("workbook_id", "sheet", norm(F.col("label")).alias("label")).distinct()
    b = current.select("workbook_id", F.col("sheet").alias("cur_sheet"), norm(F.col("label")).alias("label")).distinct()
    na, nb = a.groupBy("workbook_id", "sheet").agg(F.count("*").alias("na")), b.groupBy("workbook_id", "cur_sheet").agg(F.count("*").alias("nb"))
    both = a.join(b, ["workbook_id", "label"]).groupBy("workbook_id", "sheet", "cur_sheet").agg(F.count("*").alias("n"))
    j = both.join(na, ["workbook_id", "sheet"]).join(nb, ["workbook_id", "cur_sheet"]).withColumn("score", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    known = na.select("workbook_id", F.col("sheet").alias("cur_sheet"))
    named = j.where((F.col("sheet") == F.col("cur_sheet")) & (F.col("score") >= own)).select("workbook_id", "sheet", "cur_sheet", "score")
    rest = j.join(named.select("workbook_id", "sheet"), ["workbook_id", "sheet"], "left_anti").join(known, ["workbook_id", "cur_sheet"], "left_anti").where(F.col("score") >= other)
    w = Window.partitionBy("workbook_id", "sheet").orderBy(F.col("score").desc(), "cur_sheet")
    rest = rest.withColumn("_n", F.lead("score").over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1").where(F.col("_n").isNull() | (F.col("score") - F.col("_n") > tie))
    return named.union(rest.select("workbook_id", "sheet", "cur_sheet", "score"))


def significant(v: Column, digits: int = 9) -> Column:
    """The value to so many significant digits, as an integer and a power of ten: equal keys for equal figures."""
    e = F.floor(F.log10(F.abs(v))).cast("int")
    return F.concat_ws("e", F.round(v / F.pow(F.lit(10.0), e - (digits - 1))).cast("long").cast("string"), e.cast("string"))


def by_history(prior: DataFrame, current: DataFrame, most: int = 40, common_rows: int = 50) -> DataFrame:
    """Candidates that share period and value to nine digits, the ``most`` with most such periods: equal and differing periods, score.

    Kept with two equal periods, or with at most 20 differing ones for the one.  The score is half a point an equal
    period, 1 at most, for .6 where the later years are off by 25 % and more (upper median), and less where the
    candidate is blank in periods for which its sheet has dates.  Values that more than ``common_rows`` prior rows of a
    period have are dealt out, so many rows a task; none is left out.
    """
    def keyed(d: DataFrame, names: list[str]) -> DataFrame:
        return d.where("value <> 0").select("workbook_id", *[F.col(c).alias(n) for c, n in zip(("sheet", "row_no"), names)], "period_end", "value", significant(F.col("value")).alias("k"))

    p, c = keyed(prior, ["sheet", "row_no"]), keyed(current, ["cur_sheet", "cur_row"])
    key = ["workbook_id", "period_end", "k"]
    usual = p.groupBy(*key).agg(F.ceil(F.count("*") / common_rows).alias("_n")).where("_n > 1")
    shares = F.coalesce("_n", F.lit(1))
    a = p.drop("value").join(usual, key, "left").withColumn("_s", F.pmod(F.xxhash64("sheet", "row_no"), shares))
    b = c.drop("value").join(usual, key, "left").withColumn("_s", F.explode(F.sequence(F.lit(0), shares - 1)))
    mine, pair = ["workbook_id", "sheet", "row_no"], ["workbook_id", "sheet", "row_no", "cur_sheet", "cur_row"]
    made = a.drop("_n").join(b.drop("_n"), [*key, "_s"]).groupBy(*pair).agg(F.count("*").alias("exact"))
    w = Window.partitionBy(*mine).orderBy(F.col("exact").desc(), "cur_sheet", "cur_row")
    made = made.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(*pair)
    now = current.select("workbook_id", F.col("sheet").alias("cur_sheet"), F.col("row_no").alias("cur_row"), "period_end", F.col("value").alias("now"))
    both = made.join(p.drop("k"), mine).join(now, ["workbook_id", "cur_sheet", "cur_row", "period_end"])
    same = F.abs(F.col("now") - F.col("value")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("value"))
    gaps = F.sort_array(F.collect_list(F.when(~same, F.abs(F.col("now") / F.col("value") - 1))))
    n = both.groupBy(*pair).agg(F.count_if(same).alias("equal"), F.count_if(~same).alias("differing"), gaps.alias("_g"))
    n = n.where("equal >= 2 or (equal > 0 and differing <= 20 * equal)")
    dates = now.select("workbook_id", "cur_sheet", "period_end").distinct()
    could = p.join(dates, ["workbook_id", "period_end"]).groupBy(*mine, "cur_sheet").agg(F.count("*").alias("_could"))
    n = n.join(could, [*mine, "cur_sheet"])
    close = (F.size("_g") == 0) | (F.get("_g", F.floor(F.size("_g") / 2).cast("int")) < 0.25)
    score = F.least(F.lit(1.0), 0.5 * F.col("equal")) * F.when(close, 1.0).otherwise(0.6) * F.least(F.lit(1.0), (F.col("equal") + F.col("differing")) / F.col("_could") / 0.8)
    return n.select(*pair, "equal", "differing", score.alias("score"))


def upper_median(sorted_values: Column) -> Column:
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def by_words(prior: DataFrame, current: DataFrame, series: DataFrame, series_now: DataFrame, least: float = 0.4, anywhere: float = 0.5, gap: float = 0.1, k: int = 3) -> DataFrame:
    """Rows by the Jaccard similarity of their labels' words, equal labels aside, whose values stay close: the best k.

    On the sheet that last year's sheet became ``least`` is enough; where none did, rows of all sheets count, from
    ``anywhere`` on.  The upper median of the relative gaps, over shared periods, is below ``gap``.
    """
    row, pair = ["workbook_id", "sheet", "row_no"], ["workbook_id", "sheet", "row_no", "cur_sheet", "cur_row"]
    a = prior.select(*row, norm(F.col("label")).alias("label"), tokens(F.col("label")).alias("t")).join(sheets(prior, current).select("workbook_id", "sheet", F.col("cur_sheet").alias("to")), ["workbook_id", "sheet"], "left")
    b = current.select("workbook_id", F.col("sheet").alias("cur_sheet"), F.col("row_no").alias("cur_row"), norm(F.col("label")).alias("cur_label"), tokens(F.col("label")).alias("ct"))
    j = a.withColumn("w", F.explode("t")).join(b.withColumn("w", F.explode("ct")), ["workbook_id", "w"]).where("label <> cur_label and (to is null or to = cur_sheet)")
    j = j.groupBy(*pair, "to").agg(F.count("*").alias("n"), F.first(F.size("t")).alias("na"), F.first(F.size("ct")).alias("nb"))
    j = j.withColumn("score", F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).where(F.col("score") >= F.when(F.col("to").isNull(), anywhere).otherwise(least))
    v = j.select(*pair, "score").join(series.where("value <> 0"), row)
    v = v.join(series_now.select("workbook_id", F.col("sheet").alias("cur_sheet"), F.col("row_no").alias("cur_row"), "period_end", F.col("value").alias("now")), ["workbook_id", "cur_sheet", "cur_row", "period_end"])
    g = v.groupBy(*pair, "score").agg(F.sort_array(F.collect_list(F.abs(F.col("now") / F.col("value") - 1))).alias("_g")).where(upper_median(F.col("_g")) < gap)
    w = Window.partitionBy(*row).orderBy(F.col("score").desc(), "cur_sheet", "cur_row")
    return g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(*pair, "score")


def near(prior: DataFrame, current: DataFrame, tol: float = 0.15, share: float = 0.5, k: int = 8) -> DataFrame:
    """Rows whose values lie within ``tol`` of last year's in at least 3 periods and ``share`` of them.

    Values fall into logarithmic buckets as wide as the tolerance; a value meets the two or three that its band lies in.
    """
    import math

    width = math.log1p(tol)
    bucket = lambda v: F.floor(F.log(F.abs(v)) / width).cast("long")
    ends = [bucket(F.abs("value") * (1 - tol)), bucket(F.abs("value") * (1 + tol))]
    p = prior.where("value <> 0").withColumn("b", F.explode(F.sequence(*ends)))
    c = current.where("value <> 0").select("workbook_id", "period_end", F.col("sheet").alias("cur_sheet"), F.col("row_no").alias("cur_row"), F.col("value").alias("cv"), bucket(F.col("value")).alias("b"))
    hit = p.join(c, ["workbook_id", "period_end", "b"]).where(F.abs(F.col("cv") - F.col("value")) <= tol * F.abs(F.col("value")))
    n = prior.where("value <> 0").groupBy("workbook_id", "sheet", "row_no").agg(F.count("*").alias("periods"))
    h = hit.groupBy("workbook_id", "sheet", "row_no", "cur_sheet", "cur_row").agg(F.count("*").alias("hits")).join(n, ["workbook_id", "sheet", "row_no"])
    h = h.where(F.col("hits") >= F.greatest(F.lit(3), F.ceil(F.col("periods") * share)))
    w = Window.partitionBy("workbook_id", "sheet", "row_no").orderBy(F.col("hits").desc(), "cur_sheet", "cur_row")
    return h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r", "periods")


def check(pairs: DataFrame, prior: DataFrame, current: DataFrame, tol: float = 0.15, cover: float = 0.8, odd: DataFrame | None = None) -> DataFrame:
    """Shared periods of each pair, the upper median of the relative gaps, equal periods, and whether the match holds.

    It holds with three shared periods and more, a gap within ``tol``, values in ``cover`` of last year's periods for
    which the candidate's sheet has dates, and rows of one shape: ``odd`` are pairs of another (``evidence.other_shape``).
    """
    row, pair = ["workbook_id", "sheet", "row_no"], ["workbook_id", "sheet", "row_no", "cur_sheet", "cur_row"]
    now = current.select("workbook_id", F.col("sheet").alias("cur_sheet"), F.col("row_no").alias("cur_row"), "period_end", F.col("value").alias("cv"))
    own = pairs.select(*pair).distinct().join(prior, row)
    dates = now.select("workbook_id", "cur_sheet", "period_end").distinct().withColumn("dated", F.lit(1))
    j = own.join(dates, ["workbook_id", "cur_sheet", "period_end"], "left").join(now, ["workbook_id", "cur_sheet", "cur_row", "period_end"], "left")
    gap = F.abs(F.col("cv") - F.col("value")) / F.greatest(F.abs("value"), F.abs("cv"), F.lit(1e-12))
    j = j.withColumn("gap", F.when(F.col("cv").isNotNull(), gap))
    g = j.groupBy(*pair).agg(F.count("gap").alias("periods"), F.sort_array(F.collect_list("gap")).alias("_g"), F.count_if(F.col("gap") <= 1e-9).alias("equal"), F.count("dated").alias("could")).where("periods > 0")
    g = g.withColumn("gap", upper_median(F.col("_g"))).drop("_g")
    other = F.lit(False)
    if odd is not None:
        g = g.join(odd.select(*[c for c in pair if c in odd.columns]).distinct().withColumn("_odd", F.lit(True)), [c for c in pair if c in odd.columns], "left")
        other = F.coalesce("_odd", F.lit(False))
    g = g.withColumn("holds", (F.col("periods") >= 3) & (F.col("gap") <= tol) & (F.col("periods") >= cover * F.col("could")) & ~other)
    return g.drop("_odd")


def measure(matches: DataFrame, truth: DataFrame, key: list[str]) -> DataFrame:
    """Right, open and wrong rows against the truth (a null target: there should be none)."""
    j = truth.join(matches.withColumnRenamed("cur_row", "found"), key, "left")
    v = F.when(F.col("found").isNull() & F.col("cur_row").isNotNull(), "open").when(F.col("found").eqNullSafe(F.col("cur_row")), "right").otherwise("wrong")
    return j.groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


#: What sheets, line items and formula shapes weigh in a similarity.
WEIGHTS = {"s": 0.2, "i": 0.45, "f": 0.35}
#: Longs of a workbook's bit map of line items; rows of a key that one task takes from one side.
_LONGS, _SHARE = 16, 2_000


def _alike_in(a: str, b: str, similar: int, contains: int) -> Column:
    """Whether two workbooks may reach ``similar`` or ``contains``, from their sizes ``n`` and bit maps ``bits``: never false where they do.

    What they have in common is at most the bits in common and those that fell together on one side.  Of that follow
    the most that line items can agree, and as formula shapes agree no more than line items and sheets wholly at most,
    the most that the workbooks can.
    """
    common = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseAND(F.col(f"{b}.b{i}"))).cast("long") for i in range(_LONGS)), F.lit(0)) + F.least(f"{a}.spare", f"{b}.spare")
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    j = max(0.0, ((similar - 0.5) / 100 - WEIGHTS["s"]) / (1 - WEIGHTS["s"]))
    return (common >= j * (na + nb - common) - 1e-6) | (common >= (contains - 0.5) / 100 * F.least(na, nb) - 1e-6)


def _content(items: DataFrame) -> DataFrame:
    """(workbook_id, key, n, shapes): line items by sheet and label, how many, and how many of each shape."""
    h = lambda *cols: F.xxhash64(*[F.coalesce(c, F.lit("")) for c in cols])
    f = items.groupBy("workbook_id", h("sheet", "label").alias("key"), h("shape").alias("shape")).agg(F.count("*").alias("n"))
    return f.groupBy("workbook_id", "key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("shape", "n"))).alias("shapes"))


def likeness(items: DataFrame, similar: int = 30, contains: int = 80) -> DataFrame:
    """Pairs of workbooks by .2 of their sheets, .45 of their line items and .35 of their formula shapes, in per cent.

    ``items(workbook_id, sheet, label, shape)`` are line items.  Similarity is what two multisets have in common over all
    they have; containment is of line items, both ways.  Pairs of ``similar`` per cent (over 20, which sheets alone give) or
    ``contains`` per cent one way: none is missed.
    """
    both, books = alike_contents(items, similar, contains)
    for side in ("a", "b"):
        both = both.join(books.select(F.col("rep").alias(side), F.col("workbook_id").alias(f"_{side}")), side)
    both = both.where("a <> b or _a < _b")
    # of a pair the smaller id comes first, whichever content had the smaller one
    turned, other = F.col("_a") > F.col("_b"), {"_a": "_b", "a_in_b": "b_in_a", "sheets_a": "sheets_b", "items_a": "items_b"}
    side = {c: F.when(turned, F.col(d)).otherwise(F.col(c)) for k, v in other.items() for c, d in ((k, v), (v, k))}
    same = ["similarity", "sheets", "line_items", "formulas"]
    return both.select(side["_a"].alias("a"), side["_b"].alias("b"), *same, *[side[c].alias(c) for c in ("a_in_b", "b_in_a", "sheets_a", "sheets_b", "items_a", "items_b")])


def alike_contents(items: DataFrame, similar: int = 30, contains: int = 80) -> tuple[DataFrame, DataFrame]:
    """``likeness`` of one workbook of each content, its smallest id; and (workbook_id, rep, sheets), which content a workbook has.

    Workbooks of the same content (by 128 bits) are compared as one, and that of several is a pair with itself; the others
    meet at each line item they share, where the sizes and bit maps of both say at once whether they may be alike; what the
    rest share is counted there.
    """
    lines = written(_content(items), "lines")
    sheet_sets = items.groupBy("workbook_id").agg(F.array_sort(F.collect_set(F.xxhash64("sheet"))).alias("sheets"))
    digest = [F.sum(F.xxhash64("key", "n", "shapes").cast("decimal(38,0)")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), "shapes", "n", "key")).alias("d2")]
    books = lines.groupBy("workbook_id").agg(*digest).join(sheet_sets, "workbook_id")
    books = written(books.withColumn("rep", F.min("workbook_id").over(Window.partitionBy("d1", "d2", "sheets"))).select("workbook_id", "rep", "sheets"), "books")
    one = lines.join(books.where("workbook_id = rep").select("workbook_id"), "workbook_id", "left_semi")
    at = F.pmod(F.xxhash64("key", "e"), F.lit(64 * _LONGS)).cast("int")
    bit = one.withColumn("e", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).select("workbook_id", (at / 64).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at % 64).alias("bit"))
    maps = bit.groupBy("workbook_id").agg(F.count("*").alias("n"), *[F.coalesce(F.bit_or(F.when(F.col("w") == i, F.col("bit"))), F.lit(0).cast("bigint")).alias(f"b{i}") for i in range(_LONGS)])
    maps = maps.withColumn("spare", F.col("n") - sum((F.bit_count(f"b{i}").cast("long") for i in range(_LONGS)), F.lit(0)))
    book = F.struct("n", "spare", *[f"b{i}" for i in range(_LONGS)])
    keyed = one.withColumnRenamed("n", "k").join(maps.select("workbook_id", book.alias("book")), "workbook_id")
    # a key of many workbooks is dealt out: one side by row, the other to all
    usual = one.groupBy("key").agg(F.ceil(F.count("*") / _SHARE).alias("_n")).where("_n > 1")
    shares = F.coalesce("_n", F.lit(1))
    keyed = keyed.join(usual, "key", "left")
    x = keyed.withColumn("_s", F.pmod(F.xxhash64("workbook_id"), shares)).select("key", "_s", F.col("workbook_id").alias("a"), F.col("k").alias("ka"), F.col("shapes").alias("fa"), F.col("book").alias("x"))
    y = keyed.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1))).select("key", "_s", F.col("workbook_id").alias("b"), F.col("k").alias("kb"), F.col("shapes").alias("fb"), F.col("book").alias("y"))
    met = x.join(y, (x["key"] == y["key"]) & (x["_s"] == y["_s"]) & (F.col("a") < F.col("b")) & _alike_in("x", "y", similar, contains))
    shape = F.aggregate("fa", F.lit(0).cast("bigint"), lambda t, p: t + F.aggregate(F.filter("fb", lambda q: q["shape"] == p["shape"]), F.lit(0).cast("bigint"), lambda u, q: u + F.least(p["n"], q["n"])))
    both = met.select("a", "b", F.least("ka", "kb").alias("i"), shape.alias("f")).groupBy("a", "b").agg(F.sum("i").alias("i"), F.sum("f").alias("f"))
    own = books.where("workbook_id = rep").join(maps.select("workbook_id", "n"), "workbook_id").select("workbook_id", "sheets", "n")
    # a content that several workbooks have is a pair with itself
    many = books.groupBy("rep").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("rep").alias("workbook_id"))
    both = both.union(own.join(many, "workbook_id").select("workbook_id", "workbook_id", "n", "n"))
    for side in ("a", "b"):
        both = both.join(own.select(F.col("workbook_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sheets").alias(f"set_{side}")), side)
    both = both.withColumns({"s": F.size(F.array_intersect("set_a", "set_b")), "s_a": F.size("set_a").cast("bigint"), "s_b": F.size("set_b").cast("bigint")}).drop("set_a", "set_b")
    sizes = {"s": ("s_a", "s_b"), "i": ("n_a", "n_b"), "f": ("n_a", "n_b")}
    j = {k: F.col(k) / (F.col(p) + F.col(q) - F.col(k)) for k, (p, q) in sizes.items()}
    pct = lambda v: F.round(100 * v).cast("int")
    both = both.select(
        "a", "b", pct(sum(w * j[k] for k, w in WEIGHTS.items())).alias("similarity"), pct(j["s"]).alias("sheets"), pct(j["i"]).alias("line_items"), pct(j["f"]).alias("formulas"),
        pct(F.col("i") / F.col("n_a")).alias("a_in_b"), pct(F.col("i") / F.col("n_b")).alias("b_in_a"), F.col("s_a").alias("sheets_a"), F.col("s_b").alias("sheets_b"), F.col("n_a").alias("items_a"), F.col("n_b").alias("items_b"),
    )
    return both.where((F.col("similarity") >= similar) | (F.greatest("a_in_b", "b_in_a") >= contains)), books


def hosts(pairs: DataFrame, items: DataFrame, contains: int = 80) -> DataFrame:
    """The workbook that another one holds: ``contains`` per cent of its line items, on fewer sheets; and the sheets it has besides.

    Of several the one held most completely, then the one with more line items, then the smaller id.
    """
    one = pairs.select(F.col("b").alias("workbook_id"), F.col("a").alias("host"), F.col("a_in_b").alias("held"), F.col("sheets_a").alias("sh"), F.col("sheets_b").alias("so"), F.col("items_a").alias("n"))
    two = pairs.select("a", "b", "b_in_a", "sheets_b", "sheets_a", "items_b")
    d = one.union(two).where(F.col("held") >= contains).where("sh < so")
    best = d.groupBy("workbook_id").agg(F.max(F.struct("held", "n", (-F.col("host")).alias("h"))).alias("x")).select("workbook_id", (-F.col("x.h")).alias("host"), F.col("x.held").alias("held"))
    own = items.select("workbook_id", "sheet").distinct()
    extra = best.join(own, "workbook_id").join(own.withColumnRenamed("workbook_id", "host"), ["host", "sheet"], "left_anti")
    e = extra.groupBy("workbook_id").agg(F.array_join(F.array_sort(F.collect_set("sheet")), ",").alias("extra"))
    return best.join(e, "workbook_id", "left").withColumn("extra", F.coalesce("extra", F.lit("")))


def diff_cells(old: DataFrame, new: DataFrame, on: list[str], tol: float = 1e-9) -> DataFrame:
    """Cells of two versions by key: added, removed, changed or same (relative tolerance)."""
    j = old.select(*on, F.col("value").alias("old")).join(new.select(*on, F.col("value").alias("new")), on, "full")
    same = F.abs(F.col("old") - F.col("new")) <= tol * F.greatest(F.lit(1.0), F.abs("old"), F.abs("new"))
    what = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(same, "same").otherwise("changed")
    return j.withColumn("change", what)


def align_labels(old: list, new: list) -> list[tuple[int | None, int | None, str]]:
    """Places of two label sequences as matched, renamed (replaced runs of one length), removed or added."""
    out: list[tuple[int | None, int | None, str]] = []
    for tag, i, i2, j, j2 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if tag == "equal" or (tag == "replace" and i2 - i == j2 - j):
            out += [(i + k, j + k, "matched" if tag == "equal" else "renamed") for k in range(i2 - i)]
        else:
            out += [(k, None, "removed") for k in range(i, i2)] + [(None, k, "added") for k in range(j, j2)]
    return out


def align_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(workbook_id, sheet, row_no, cur_row, what) of the sheets both versions have: matched, renamed, removed or added rows.

    ``old`` and ``new`` are ``(workbook_id, sheet, row_no, label)``.  The alignment of two sequences can't be said in joins:
    a sheet's labels, which are short, meet in one row as two arrays.
    """
    seq = lambda d, n: d.groupBy("workbook_id", "sheet").agg(F.array_sort(F.collect_list(F.struct("row_no", F.coalesce("label", F.lit("")).alias("label")))).alias(n))
    j = seq(old, "a").join(seq(new, "b"), ["workbook_id", "sheet"])
    j = j.select("workbook_id", "sheet", *[F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("a", "b") for f in ("row_no", "label")])

    @F.pandas_udf("array<struct<row_no:bigint,cur_row:bigint,what:string>>")
    def aligned(r: pd.Series, l: pd.Series, r2: pd.Series, l2: pd.Series) -> pd.Series:
        one = lambda rows, k: None if k is None else int(rows[k])
        return pd.Series([[{"row_no": one(a, i), "cur_row": one(b, k), "what": what} for i, k, what in align_labels(list(x), list(y))] for a, x, b, y in zip(r, l, r2, l2)])

    d = j.select("workbook_id", "sheet", F.explode(aligned("a_row_no", "a_label", "b_row_no", "b_label")).alias("m"))
    return d.select("workbook_id", "sheet", "m.*")


def diff_models(old_rows: DataFrame, new_rows: DataFrame, old: DataFrame, new: DataFrame, tol: float = 1e-9) -> DataFrame:
    """What changed between two versions: (workbook_id, sheet, row_no, cur_row, period_end, what, old, new).

    Rows are aligned by their sheets' label sequences; cells ``(workbook_id, sheet, row_no, period_end, value, formula)`` of
    matched rows meet by period, so a timeline that has moved compares like with like, and periods of one version alone
    aren't compared.  Cells: 'formula to typed', 'typed to formula', 'blanked', 'output changed' (a formula), 'input changed';
    rows: 'row renamed', 'row removed', 'row added'.
    """
    m = written(align_rows(old_rows, new_rows), "aligned")
    pairs = m.where("what in ('matched', 'renamed')").drop("what")
    key = ["workbook_id", "sheet", "period_end"]
    a = pairs.join(old.select(*key, "row_no", F.col("value").alias("old"), F.col("formula").alias("f0")), ["workbook_id", "sheet", "row_no"])
    j = a.join(new.select(*key, F.col("row_no").alias("cur_row"), F.col("value").alias("new"), F.col("formula").alias("f1")), [*key, "cur_row"])
    same = F.abs(F.col("old") - F.col("new")) <= tol * F.greatest(F.lit(1.0), F.abs("old"), F.abs("new"))
    typed = lambda f: F.col(f).isNull()
    what = (
        F.when(typed("f1") & ~typed("f0"), "formula to typed").when(~typed("f1") & typed("f0"), "typed to formula").when(F.col("new").isNull() & F.col("old").isNotNull(), "blanked")
        .when(F.coalesce(same, F.col("old").isNull() & F.col("new").isNull()), F.lit(None)).when(~typed("f1"), "output changed").otherwise("input changed")
    )
    cells = j.withColumn("what", what).where("what is not null").select("workbook_id", "sheet", "row_no", "cur_row", "period_end", "what", "old", "new")
    none = F.lit(None).cast("double")
    rows = m.where("what <> 'matched'").select("workbook_id", "sheet", "row_no", "cur_row", F.lit(None).cast("date"), F.concat(F.lit("row "), "what"), none, none)
    return cells.union(rows)


def term_changes(edges: DataFrame, edges_now: DataFrame, matches: DataFrame, sums: DataFrame, depth: int = 3) -> DataFrame:
    """Terms of matched sums that have no partner: new this year, gone since last year.

    ``sums(workbook_id, row_no, cur_row)`` are the sums, ``matches`` the pairs that say which term is which.  Sums of
    which fewer than half of last year's terms have a partner are another make-up and left out.  A term regrouped under
    another of the sum's is neither: a new term with a gone one below it, and a gone one that is below the sum still,
    within ``depth`` steps.
    """
    key = ["workbook_id", "row_no", "cur_row"]
    a = sums.select(*key).join(edges.select("workbook_id", F.col("src").alias("row_no"), F.col("dst").alias("term")).distinct(), ["workbook_id", "row_no"])
    b = sums.select(*key).join(edges_now.select("workbook_id", F.col("src").alias("cur_row"), F.col("dst").alias("now")).distinct(), ["workbook_id", "cur_row"])
    m = matches.select("workbook_id", F.col("row_no").alias("term"), F.col("cur_row").alias("now"))
    paired = a.join(m, ["workbook_id", "term"]).join(b, [*key, "now"])
    size = a.groupBy(*key).agg(F.count("*").alias("n")).join(paired.groupBy(*key).agg(F.count_distinct("term").alias("p")), key, "left").where("2 * coalesce(p, 0) >= n").select(*key)
    gone = a.join(size, key).join(paired.select(*key, "term"), [*key, "term"], "left_anti")
    new = b.join(size, key).join(paired.select(*key, "now"), [*key, "now"], "left_anti")
    moved = gone.join(m, ["workbook_id", "term"]).select(*key, "term", F.col("now").alias("moved"))
    below = lambda d, start: _below(d, edges_now, start, depth)
    regrouped = below(new.select(*key, F.col("now").alias("top")), "top").join(moved.select(*key, F.col("moved").alias("node")), [*key, "node"]).select(*key, F.col("top").alias("now")).distinct()
    still = below(sums.select(*key, F.col("cur_row").alias("top")), "top").join(moved.withColumnRenamed("moved", "node"), [*key, "node"]).select(*key, "term").distinct()
    out = gone.join(still, [*key, "term"], "left_anti").select(*key, "term", F.lit("gone").alias("change"))
    return out.union(new.join(regrouped, [*key, "now"], "left_anti").select(*key, F.col("now").alias("term"), F.lit("new").alias("change")))


def _below(d: DataFrame, edges: DataFrame, start: str, depth: int) -> DataFrame:
    """``d`` with ``node``: everything within ``depth`` steps below ``start``."""
    e = edges.select("workbook_id", F.col("src").alias("node"), F.col("dst").alias("_n")).distinct()
    front, out = d.withColumn("node", F.col(start)), None
    for _ in range(depth):
        front = front.join(e, ["workbook_id", "node"]).drop("node").withColumnRenamed("_n", "node").distinct()
        out = front if out is None else out.union(front)
    return out.distinct()


def file_keys(files: DataFrame) -> DataFrame:
    """Family of a file name (without versions and dates), its version, and the date in it: yyyymmdd, Mon-yy as the month's end, FYyy as 30 June."""
    from fleetroll.functions.text import MONTHS

    n = F.lower("filename")
    month = rf"({MONTHS})[a-z]*[ _-]?(\d{{2}})(?!\d)"
    stem = F.regexp_replace(F.regexp_replace(n, r"\.[a-z0-9]+$", ""), rf"(\d{{8}}|fy\d{{2}}|(?<![a-z])v\d+|(?<![a-z]){month})", " ")
    full = F.try_to_date(F.regexp_extract(n, r"(\d{8})", 1), "yyyyMMdd")
    at = F.instr(F.lit(MONTHS), F.nullif(F.regexp_extract(n, rf"(?<![a-z]){month}", 1), F.lit("")))
    named = F.last_day(F.make_date(2000 + F.nullif(F.regexp_extract(n, rf"(?<![a-z]){month}", 2), F.lit("")).cast("int"), ((at + 3) / 4).cast("int"), F.lit(1)))
    fy = F.nullif(F.regexp_extract(n, r"fy(\d{2})", 1), F.lit(""))
    version = F.nullif(F.regexp_extract(n, r"(?<![a-z])v(\d+)", 1), F.lit("")).cast("int")
    return files.withColumns({"family": F.trim(F.regexp_replace(stem, r"[^a-z]+", " ")), "version": version, "file_date": F.coalesce(full, named, F.make_date(2000 + fy.cast("int"), F.lit(6), F.lit(30)))})


def same_period(files: DataFrame, days: int = 120) -> DataFrame:
    """Pairs of files of one family (and client, ``by``) dated within ``days``: neighbours in buckets of that many days meet."""
    d = files.where("file_date is not null").withColumn("_b", F.floor(F.date_diff("file_date", F.lit("1970-01-01").cast("date")) / days))
    a = d.select("client", "family", F.col("id").alias("a"), F.col("file_date").alias("date_a"), F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
    b = d.select("client", "family", F.col("id").alias("b"), F.col("file_date").alias("date_b"), "_b")
    return a.join(b, ["client", "family", "_b"]).where(F.col("a") < F.col("b")).where(F.abs(F.date_diff("date_a", "date_b")) <= days).select("client", "family", "a", "b")


def balances(reads: DataFrame, prior: DataFrame, current: DataFrame, months: int, check_at: float = 0.1, block_at: float = 0.5) -> DataFrame:
    """Figures read at one period: this year's at the shifted date against last year's forecast for that date."""
    key = ["workbook_id", "sheet", "row_no"]
    at = F.last_day(F.add_months("period_end", months))
    r = reads.withColumn("to_end", at)
    side = lambda d, name: d.select(*key, F.col("period_end").alias("to_end"), F.col("value").alias(name))
    j = r.join(side(prior, "forecast"), [*key, "to_end"], "left").join(side(current, "actual"), [*key, "to_end"], "left")
    off = F.abs(F.col("actual") - F.col("forecast")) / F.abs("forecast")
    return j.withColumn("status", F.when(F.col("actual").isNull(), "missing").when(F.col("forecast").isNull(), "no forecast").when(off >= block_at, "block").when(off >= check_at, "check").otherwise("ok"))
