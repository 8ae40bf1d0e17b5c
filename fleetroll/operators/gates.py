"""Gates: the checks that hold a value back, and the joins that they and the figures held at last year's need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import close

E = "engagement_id"
#: Labels of rows that aren't the equity value.
NOT_EQUITY = r"(?i)check|difference|rounding|debt|enterprise|premium|share price|per share"


def pair_ends(cells: DataFrame, reads: DataFrame) -> DataFrame:
    """The cells of a conclusion's low and high: (engagement_id, how, low, high, rows).

    ``cells(engagement_id, part, cell, sheet, row_no, scale, sign, value, label, is_formula, label_match, located, score)``
    are what the figures could be (J17); ``reads(engagement_id, src, dst)`` says which of these cells read which.  Low and
    high are formulas on one row, of one scale and sign, the low not above the high, under a label that may be the equity
    value; score: theirs, 2, and 1 if both labels match.  A pair whose cells read another pair's gives way to it, if that
    leaves any.  The best on two rows is ambiguous; with no pair, the best located low and high of one scale and sign in
    order; else the one figure.
    """
    ok = cells.where(F.col("is_formula") & ~F.coalesce("label", F.lit("")).rlike(NOT_EQUITY))
    side = lambda p, n: ok.where(F.col("part") == p).select(E, "sheet", "row_no", "scale", "sign", F.col("cell").alias(n), F.col("value").alias(f"{n}_value"), F.col("score").alias(f"{n}_score"), F.col("label_match").alias(f"{n}_match"))
    on = [E, "sheet", "row_no", "scale", "sign"]
    p = side("low", "low").join(side("high", "high"), on).where("low_value * sign <= high_value * sign + 1e-9")
    p = p.withColumn("score", F.round(F.col("low_score") + F.col("high_score") + 2 + F.when(F.col("low_match") & F.col("high_match"), 1).otherwise(0), 9))
    r = lambda a, b: reads.select(E, F.col("src").alias(a), F.col("dst").alias(b)).distinct()
    other = p.select(E, F.col("low").alias("low2"), F.col("high").alias("high2"))
    down = p.join(r("low", "low2"), [E, "low"]).join(other, [E, "low2"]).join(r("high", "high2"), [E, "high", "high2"]).where("low <> low2 or high <> high2").select(E, "low", "high").distinct().withColumn("_down", F.lit(1))
    p = p.join(down, [E, "low", "high"], "left").withColumn("_down", F.coalesce("_down", F.lit(0)))
    w = Window.partitionBy(E)
    p = p.withColumn("_any", F.min("_down").over(w)).where("_down = 0 or _any = 1").withColumn("_top", F.max("score").over(w)).where("score = _top")
    best = p.groupBy(E).agg(F.count_distinct("sheet", "row_no").alias("rows"), F.min(F.struct("sheet", "row_no", "low", "high")).alias("x"))
    best = best.select(E, F.when(F.col("rows") > 1, "ambiguous").otherwise("one row").alias("how"), *[F.when(F.col("rows") == 1, F.col(f"x.{c}")).alias(c) for c in ("low", "high")], F.col("rows").cast("int").alias("rows"))
    top = lambda part: ok.where(F.col("part") == part).where("located").withColumn("_r", F.row_number().over(Window.partitionBy(E).orderBy(F.col("score").desc(), "cell"))).where("_r = 1")
    lo, hi = (top(x).select(E, F.col("cell").alias(x), "scale", "sign", F.col("value").alias(f"{x}_value")) for x in ("low", "high"))
    apart = lo.join(hi, [E, "scale", "sign"]).where("low_value * sign <= high_value * sign + 1e-9").select(E, F.lit("two rows").alias("how"), "low", "high", F.lit(2).alias("rows"))
    ends = cells.where("part in ('low', 'high')").select(E).distinct()
    one = top("value").join(ends, E, "left_anti").select(E, F.lit("one figure").alias("how"), F.col("cell").alias("low"), F.col("cell").alias("high"), F.lit(1).alias("rows"))
    out = best
    for d in (apart, one):
        out = out.union(d.join(out.select(E), E, "left_anti"))
    return out


def suggest_held(held: DataFrame, prior: DataFrame, current: DataFrame, matches: DataFrame, dates: DataFrame, scales: list[float] = [1.0, 1e3, 1e-3]) -> DataFrame:
    """This year's figure for inputs held at last year's: (workbook_id, input_id, status, row_no, value).

    ``held(workbook_id, input_id, label, value)``; ``prior`` and ``current`` are ``(workbook_id, row_no, label, period_end,
    value)``, ``matches(workbook_id, row_no, cur_row)``, ``dates(workbook_id, prior_date, this_date)``.  Last year's figure
    is looked for in last year's model at its date, at a scale, within the larger of 5e-4 of it and .05; rows whose words
    agree first, then the smaller row.  Its row's figure this year at this date, at the scale and sign, is the suggestion:
    checked if one row alone agrees, else figure only.  Or: nil, not found, no row, no date.
    """
    from .match import tokens

    key = ["workbook_id", "input_id"]
    h = held.join(dates, "workbook_id", "left")
    s = h.where("value <> 0").withColumn("scale", F.explode(F.array(*[F.lit(x) for x in scales])))
    tol = F.greatest(5e-4 * F.abs("value"), F.lit(0.05))
    # the band of a scaled figure and the cells meet in buckets of a hundredth of a logarithm
    bucket = lambda v: F.floor(F.log(v) * 100).cast("long")
    lo, hi = (F.abs("value") - tol) / F.col("scale"), (F.abs("value") + tol) / F.col("scale")
    s = s.select(*key, F.col("value").alias("v"), tokens(F.col("label")).alias("want"), "scale", F.col("prior_date").alias("period_end"), lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(bucket(F.greatest(lo, 1e-3 * hi)), bucket(hi))).alias("b"))
    p = prior.where("value <> 0").select("workbook_id", "row_no", tokens(F.col("label")).alias("words"), "period_end", F.col("value").alias("x"), bucket(F.abs("value")).alias("b"))
    hit = s.join(p, ["workbook_id", "period_end", "b"]).where("abs(x) between lo and hi").withColumn("agrees", F.size(F.array_intersect("want", "words")) > 0)
    hit = hit.withColumn("rank", F.array_position(F.array(*[F.lit(x) for x in scales]), F.col("scale")))
    each = hit.groupBy(*key, "row_no", "v", "x", "agrees").agg(F.min_by("scale", "rank").alias("scale"))
    agree = each.groupBy(*key).agg(F.count_if("agrees").alias("agreeing"))
    w = Window.partitionBy(*key).orderBy(F.col("agrees").desc(), "row_no")
    best = each.withColumn("_r", F.row_number().over(w)).where("_r = 1").join(agree, key)
    best = best.join(matches, ["workbook_id", "row_no"], "left").join(dates.select("workbook_id", F.col("this_date").alias("period_end")), "workbook_id")
    best = best.join(current.select("workbook_id", F.col("row_no").alias("cur_row"), "period_end", F.col("value").alias("y")), ["workbook_id", "cur_row", "period_end"], "left")
    value = F.abs("y") * F.col("scale") * F.signum("v") * F.when(F.signum("y") == F.signum("x"), 1).otherwise(-1)
    status = F.when(F.col("cur_row").isNull(), "no row").when(F.col("y").isNull(), "no date").when(F.col("agrees") & (F.col("agreeing") == 1), "checked").otherwise("figure only")
    found = best.select(*key, status.alias("status"), "row_no", F.when(status.isin("checked", "figure only"), value).alias("value"))
    j = held.select(*key, F.col("value").alias("_v")).join(found, key, "left")
    return j.select(*key, F.when(F.col("_v") == 0, "nil").otherwise(F.coalesce("status", F.lit("not found"))).alias("status"), "row_no", "value")


def exact_zero_roll(values: DataFrame, changes: DataFrame, tol: float = 1e-4) -> DataFrame:
    """Values that roll to themselves although rows changed: ``values(workbook_id, ratio)``, ``changes(workbook_id, changed_rows)``."""
    j = values.join(changes, "workbook_id", "left").withColumn("changed_rows", F.coalesce("changed_rows", F.lit(0)))
    return j.withColumn("suspect", (F.abs(F.col("ratio") - 1) < tol) & (F.col("changed_rows") > 0))


def horizon(flows: DataFrame, reads: DataFrame, prior: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """What the forecast's end does to a discounting: (core_id, what, n, total).

    ``flows(core_id, feed, period_end, cf, tv, factor, after)`` of the feeds last and this; ``reads(core_id, row_no)`` are
    the rows read, ``prior`` and ``current(row_no, period_end, value)`` their models.  'terminal nil': a terminal value
    last year and none this year; 'short': more nil periods at the end (n) than last year; 'beyond': rows with figures
    past the last period discounted this year that had none past last year's.
    """
    live = lambda f, v: F.sum(F.when((F.col("feed") == f) & (F.col("factor") != 0), F.col(v)).otherwise(0.0))
    tv = flows.groupBy("core_id").agg(live("last", "tv").alias("a"), live("this", "tv").alias("b"))
    nil = tv.where((F.abs("a") > 1e-9) & (F.abs("b") <= 1e-6 * F.greatest(F.lit(1.0), F.abs("a")))).select("core_id", F.lit("terminal nil").alias("what"), F.lit(0).cast("long").alias("n"), F.col("a").alias("total"))
    f = flows.where("period_end > after")
    last_live = F.max(F.when((F.col("cf") != 0) | (F.col("tv") != 0), F.col("period_end")))
    t = f.groupBy("core_id", "feed").agg(last_live.alias("end"))
    tail = f.join(t, ["core_id", "feed"]).groupBy("core_id", "feed").agg(F.count_if(F.col("period_end") > F.col("end")).alias("tail"))
    tail = tail.groupBy("core_id").agg(F.sum(F.when(F.col("feed") == "last", F.col("tail")).otherwise(0)).alias("a"), F.sum(F.when(F.col("feed") == "this", F.col("tail")).otherwise(0)).alias("b"))
    short = tail.where("b > a").select("core_id", F.lit("short").alias("what"), F.col("b").alias("n"), F.lit(0.0).alias("total"))
    ends = flows.where("factor <> 0").groupBy("core_id").agg(*[F.max(F.when(F.col("feed") == x, F.col("period_end"))).alias(f"{x}_end") for x in ("last", "this")]).where("last_end is not null and this_end is not null")
    r = reads.join(ends, "core_id").join(matches, "row_no")
    now = r.select("core_id", "row_no", "cur_row", "this_end").join(current.select(F.col("row_no").alias("cur_row"), "period_end", "value"), "cur_row").where((F.col("period_end") > F.col("this_end")) & (F.abs("value") > 1e-9)).groupBy("core_id", "row_no").agg(F.sum("value").alias("total"))
    then = r.select("core_id", "row_no", "last_end").join(prior.select("row_no", "period_end", "value"), "row_no").where((F.col("period_end") > F.col("last_end")) & (F.abs("value") > 1e-9)).select("core_id", "row_no").distinct()
    beyond = now.join(then, ["core_id", "row_no"], "left_anti").groupBy("core_id").agg(F.count("*").alias("n"), F.sum("total").alias("total")).select("core_id", F.lit("beyond").alias("what"), "n", "total")
    return nil.union(short).union(beyond)


def stand_ins(feed: DataFrame, kept: DataFrame) -> DataFrame:
    """Last year's values that stand in under a value, rows kept on purpose aside: (workbook_id, rows, periods, total).

    ``feed(workbook_id, row_no, period_end, how, rolled)`` is J23's, ``kept(workbook_id, row_no)``.
    """
    d = feed.where("how = 'stand-in'").join(kept, ["workbook_id", "row_no"], "left_anti")
    return d.groupBy("workbook_id").agg(F.count_distinct("row_no").alias("rows"), F.count("*").alias("periods"), F.sum("rolled").alias("total"), F.max(F.abs("rolled")).alias("_m")).where("_m > 1e-9").drop("_m")


def pasted_rows(prior: DataFrame, current: DataFrame, matches: DataFrame, shapes: DataFrame, share: float = 0.8, distinct: int = 3, formulas: float = 0.2) -> DataFrame:
    """Rows of formulas last year that are typed this year with last year's figures: (workbook_id, row_no, cur_row, how, n, total).

    ``prior``/``current(workbook_id, row_no, col, period_end, value)``; ``shapes(workbook_id, row_no, cur_row, was_formula,
    now_formula, now_const)``.  'by period': equal at the same date; else 'by column': equal in the same column whose date
    has moved.  ``share`` of three and more pairs not both nil, with ``distinct`` different values equal.
    """
    key = ["workbook_id", "row_no", "cur_row"]
    s = shapes.where((F.col("was_formula") > 0) & (F.col("now_const") > 0) & (F.col("now_formula") <= formulas * (F.col("now_formula") + F.col("now_const")))).select(*key)
    m = matches.join(s, key)
    a = m.join(prior.select("workbook_id", "row_no", "col", F.col("period_end").alias("d0"), F.col("value").alias("v0")), ["workbook_id", "row_no"])
    b = current.select("workbook_id", F.col("row_no").alias("cur_row"), F.col("col").alias("c1"), F.col("period_end").alias("d1"), F.col("value").alias("v1"))
    by_date = a.join(b, ["workbook_id", "cur_row"]).where("d0 = d1").withColumn("how", F.lit("by period"))
    by_col = a.join(b, ["workbook_id", "cur_row"]).where("col = c1 and d0 <> d1").withColumn("how", F.lit("by column"))
    d = by_date.union(by_col).where("v0 <> 0 or v1 <> 0")
    same = close(F.col("v1"), F.col("v0"))
    g = d.groupBy(*key, "how").agg(F.count("*").alias("pairs"), F.count_if(same).alias("n"), F.count_distinct(F.when(same, F.round("v1", 6))).alias("values"), F.sum(F.when(same, F.col("v1"))).alias("total"))
    g = g.where((F.col("pairs") >= 3) & (F.col("values") >= distinct) & (F.col("n") >= share * F.col("pairs")))
    w = Window.partitionBy(*key).orderBy(F.col("how").desc())
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*key, "how", "n", "total")


def gates(values: DataFrame, ties: DataFrame, plans: DataFrame, check_at: float = 1e-6, block_at: float = 1e-3) -> DataFrame:
    """Findings on a value: (workbook_id, gate, severity).

    'rebuild': the rebuilt value lies off the saved one by ``check_at`` or ``block_at`` of it; 'tie': a figure of
    ``ties(workbook_id, ties, loose)`` doesn't tie (block) or only to half a per cent (check); 'roll': the months of the
    roll were assumed, not read (``plans(workbook_id, assumed)``).
    """
    off = F.abs(F.col("rebuilt") - F.col("saved")) / F.greatest(F.abs("saved"), F.lit(1e-12))
    one = values.select("workbook_id", F.lit("rebuild").alias("gate"), F.when(off > block_at, "block").when(off > check_at, "check").alias("severity"))
    two = ties.groupBy("workbook_id").agg(F.when(~F.every("ties"), "block").when(F.some("loose"), "check").alias("severity")).select("workbook_id", F.lit("tie"), "severity")
    three = plans.select("workbook_id", F.lit("roll"), F.when(F.col("assumed"), "block"))
    return one.union(two).union(three).where("severity is not null")


def reliability(rows: DataFrame, matches: DataFrame, feed: DataFrame, zero_roll: DataFrame, found_min: float = 0.9) -> DataFrame:
    """Whether a workbook's value can be trusted, and why not: (workbook_id, reliable, missing, blank, weak, timing_open, found_share, zero_ok).

    ``rows(workbook_id, row_no, is_origin, is_timing)`` are the rows the value reads, ``matches(workbook_id, row_no,
    cur_row, confidence, kept)``, ``feed(workbook_id, row_no, period_end, how)`` the cells read, ``zero_roll(workbook_id,
    ok)``.  A row of cash flows is missing without a match or with more than half of its cells without a figure; a row is
    blank with more than a fifth of them blank, weak with a confidence below .5, and an open timing row likewise.  Rows
    kept on purpose are none of these.  With cash-flow rows none may be missing, without them ``found_min`` of the cells
    must be found.
    """
    key = ["workbook_id", "row_no"]
    f = feed.groupBy(*key).agg(F.count("*").alias("reads"), F.count_if(F.col("how").isin("no match", "missing", "stand-in")).alias("unmatched"), F.count_if(F.col("how") == "blank").alias("blanks"))
    d = rows.join(matches.select(*key, "cur_row", "confidence", "kept"), key, "left").join(f, key, "left")
    kept, some = F.coalesce("kept", F.lit(False)), F.greatest(F.lit(1), F.coalesce("reads", F.lit(0)))
    miss = F.col("is_origin") & ~kept & (F.col("cur_row").isNull() | (F.coalesce("unmatched", F.lit(0)) > 0.5 * some))
    blank = ~miss & ~kept & (F.coalesce("blanks", F.lit(0)) > 0.2 * some)
    unsure = ~kept & (F.coalesce("confidence", F.lit(0.0)) < 0.5)
    d = d.withColumns({"_miss": miss, "_blank": blank, "_weak": unsure & ~miss & ~blank & ~F.col("is_timing"), "_open": unsure & F.col("is_timing")})
    g = d.groupBy("workbook_id").agg(F.count_if("is_origin").alias("origins"), *[F.count_if(f"_{a}").alias(b) for a, b in (("miss", "missing"), ("blank", "blank"), ("weak", "weak"), ("open", "timing_open"))], F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"), F.coalesce(F.sum("unmatched"), F.lit(0)).alias("_u"))
    g = g.withColumn("found_share", F.when(F.col("reads") > 0, 1 - F.col("_u") / F.col("reads")).otherwise(0.0)).join(zero_roll.select("workbook_id", F.col("ok").alias("zero_ok")), "workbook_id", "left").withColumn("zero_ok", F.coalesce("zero_ok", F.lit(False)))
    basis = F.when(F.col("origins") > 0, F.col("missing") == 0).otherwise(F.col("found_share") >= found_min)
    fine = basis & (F.col("reads") > 0) & (F.col("blank") == 0) & (F.col("weak") == 0) & (F.col("timing_open") == 0) & F.col("zero_ok")
    return g.select("workbook_id", fine.alias("reliable"), "missing", "blank", "weak", "timing_open", "found_share", "zero_ok")


#: A declared distribution's label.
DECLARED, DECLARED_HOW = r"(?i)distribution|dividend", r"(?i)declared|payable|unpaid"


def declared(rows: DataFrame, series: DataFrame, dates: DataFrame, deductions: DataFrame) -> DataFrame:
    """Distributions that this year's model has as declared at its date, where nothing deducts one: (workbook_id, row_no, value).

    ``deductions(workbook_id, label)`` are the balances and typed inputs of the value; ``dates(workbook_id, date, basis)``,
    a value on the cum basis includes them rightly.
    """
    has = deductions.where(F.col("label").rlike(DECLARED)).select("workbook_id").distinct()
    r = rows.where(F.col("label").rlike(DECLARED) & F.col("label").rlike(DECLARED_HOW)).select("workbook_id", "row_no")
    d = dates.where("basis <> 'cum'").join(has, "workbook_id", "left_anti")
    return r.join(d, "workbook_id").join(series.select("workbook_id", "row_no", F.col("period_end").alias("date"), "value"), ["workbook_id", "row_no", "date"]).where("abs(value) > 1e-9").select("workbook_id", "row_no", "value")


def equity_ends(values: DataFrame, tol: float = 1e-12, apart: float = 1e-3) -> DataFrame:
    """Ends that don't move with the model: ``values(workbook_id, end, typed, has_discounting, last, this)`` of low, mid and high.

    'typed': the end is a typed cell; 'still': it is what it was, with no discounting under it; 'mid apart': the mid was
    the midpoint last year and now lies off it by ``apart``.
    """
    still = F.abs(F.col("last") - F.col("this")) <= tol * F.greatest(F.lit(1.0), F.abs("last"))
    own = values.where("end <> 'mid'").withColumn("finding", F.when(F.col("typed"), "typed").when(still & ~F.col("has_discounting"), "still"))
    of = lambda e, c: F.max(F.when(F.col("end") == e, F.col(c)))
    m = values.groupBy("workbook_id").agg(*[of(e, c).alias(f"{e}_{c}") for e in ("low", "mid", "high") for c in ("last", "this")])
    was = F.abs(F.col("mid_last") - (F.col("low_last") + F.col("high_last")) / 2) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("mid_last"))
    now = F.abs(F.col("mid_this") - (F.col("low_this") + F.col("high_this")) / 2) > apart * F.abs("mid_this")
    return own.where("finding is not null").select("workbook_id", "end", "finding").union(m.where(was & now).select("workbook_id", F.lit("mid"), F.lit("mid apart")))


def differing_inputs(own: DataFrame, theirs: DataFrame, by: list[str], k: int = 8) -> DataFrame:
    """Typed cells that another table has with another figure: per ``by`` how many, and the first ``k`` by place.

    Both are ``(*by, sheet, row_no, col, value)``: an overlay's own inputs against this year's model, or what the held cells
    read on last year's feed against this year's.
    """
    on = [*by, "sheet", "row_no", "col"]
    j = own.select(*on, F.col("value").alias("a")).join(theirs.select(*on, F.col("value").alias("b")), on).where(~close(F.col("a"), F.col("b")))
    cell = F.concat_ws("!", "sheet", F.concat(F.lit("R"), F.col("row_no").cast("string"), F.lit("C"), F.col("col").cast("string")))
    g = j.groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("sheet", "row_no", "col", cell.alias("cell")))).alias("_c"))
    return g.select(*by, "n", F.array_join(F.slice(F.transform("_c", lambda x: x["cell"]), 1, k), ", ").alias("cells"))


def saved_state(reads: DataFrame, cells: DataFrame, calc: DataFrame) -> DataFrame:
    """Findings on the cells a value reads: (workbook_id, model, what, severity, n).

    ``reads(workbook_id, model, row_no, col)``, ``cells(workbook_id, model, row_no, col, formula, value, err, beyond)``,
    ``calc(workbook_id, model, completed)``.  A formula without a saved result, and an error, block in this year's model and
    are to check in last year's; a figure right of the timeline that stands in blocks; a calculation that didn't finish is
    to check.
    """
    j = reads.distinct().join(cells, ["workbook_id", "model", "row_no", "col"])
    what = F.when(F.col("err").isNotNull(), "error").when(F.col("formula").isNotNull() & F.col("value").isNull(), "no saved result").when(F.col("beyond"), "beyond the timeline")
    g = j.withColumn("what", what).where("what is not null").groupBy("workbook_id", "model", "what").agg(F.count("*").alias("n"))
    g = g.withColumn("severity", F.when((F.col("what") == "beyond the timeline") | (F.col("model") == "current"), "block").otherwise("check"))
    c = calc.where("not completed").select("workbook_id", "model", F.lit("calculation not completed"), F.lit("check"), F.lit(1).cast("long"))
    return g.select("workbook_id", "model", "what", "severity", "n").union(c)


def balance_gates(balances: DataFrame, check_at: float = 0.1, block_at: float = 0.5) -> DataFrame:
    """Gates on balances read at the valuation date: (workbook_id, gate, severity, n).

    ``balances(workbook_id, row_no, state, by, by_label, actual, forecast)``; state is moved, kept, after or unmoved.  A
    moved balance off last year's forecast by more than ``block_at`` blocks; one moved by the app, or off by ``check_at``,
    is to check, others are for information; kept ones are to check if only their label says so; those read after the date
    are to check; unmoved ones block.
    """
    off = F.coalesce(F.when(F.col("forecast") != 0, F.abs(F.col("actual") - F.col("forecast")) / F.abs("forecast")), F.lit(0.0))
    d = balances.withColumn("off", off)
    far = d.where("state = 'moved'").where(F.col("off") > block_at).withColumns({"gate": F.lit("balance off"), "sev": F.lit(3)})
    rank = F.when(F.col("state") == "moved", F.when((F.col("by") == "app") | (F.col("off") > check_at), 2).otherwise(1)).when(F.col("state") == "kept", F.when(F.col("by_label"), 2).otherwise(1)).when(F.col("state") == "after", 2).otherwise(3)
    rest = d.withColumns({"gate": F.concat(F.lit("balance "), F.col("state")), "sev": rank})
    g = far.union(rest).groupBy("workbook_id", "gate").agg(F.max("sev").alias("sev"), F.count("*").alias("n"))
    return g.select("workbook_id", "gate", F.element_at(F.array(*[F.lit(x) for x in ("info", "check", "block")]), F.col("sev")).alias("severity"), "n")


def roll_up(tree: DataFrame, pv: DataFrame, depth: int = 6) -> DataFrame:
    """A value from its discountings and items: (root, value, parts).

    ``tree(parent, child, coefficient)`` is a linear tree whose leaves have ``pv(node, value)``; coefficients multiply on
    the way down.  A node reached twice counts by each way.
    """
    t = tree.select(F.col("parent").alias("node"), "child", F.col("coefficient").alias("c"))
    roots = tree.select(F.col("parent").alias("root")).distinct().join(tree.select(F.col("child").alias("root")), "root", "left_anti")
    front, out = roots.select("root", F.col("root").alias("node"), F.lit(1.0).alias("k")), None
    for _ in range(depth):
        front = front.join(t, "node").groupBy("root", F.col("child").alias("node")).agg(F.sum(F.col("k") * F.col("c")).alias("k"))
        out = front if out is None else out.union(front)
    return out.groupBy("root", "node").agg(F.sum("k").alias("k")).join(pv, "node").groupBy("root").agg(F.sum(F.col("k") * F.col("value")).alias("value"), F.count("*").alias("parts"))


def franking(reads: DataFrame, streams: DataFrame, values: DataFrame, scales: list[float] = [1.0, 1e-3, 1e-6, 1e3]) -> DataFrame:
    """The utilisation of franking credits, and whether the value without it falls by their present value.

    ``reads(core_id, walk, cell, label, value)`` are the cells that the first and the last live period read; the fraction
    both read is the utilisation (a 1 beside a fraction is a switch; of several the one labelled so, else none).
    ``streams(core_id, cf, factor)`` is the stream of credits, ``values(core_id, base, nil)`` the value with it and at nil.
    """
    c = reads.where("value > 0 and value <= 1").groupBy("core_id", "cell").agg(F.count_distinct("walk").alias("walks"), F.max("value").alias("v"), F.max(F.col("label").rlike("(?i)frank|imputation|gamma")).alias("named")).where("walks = 2")
    w = Window.partitionBy("core_id")
    c = c.withColumn("_f", F.max(F.col("v") < 1).over(w)).where("v < 1 or not _f").withColumn("_n", F.max("named").over(w)).where("named or not _n").withColumn("_k", F.count("*").over(w)).where("_k = 1")
    pv = streams.groupBy("core_id").agg(F.sum(F.col("cf") * F.col("factor")).alias("pv"))
    drop = F.col("base") - F.col("nil")
    ok = F.exists(F.array(*[F.lit(s) for s in scales]), lambda s: F.abs(drop - F.col("pv") * s) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(F.col("pv") * s)))
    j = pv.join(values, "core_id").join(c.select("core_id", "cell", F.col("v").alias("utilisation")), "core_id", "left")
    return j.select("core_id", "cell", "utilisation", "pv", drop.alias("drop"), ok.alias("ok"))


def input_effects(flows: DataFrame, factors: DataFrame, sensitivity: DataFrame, bump: float = 0.01, k: int = 40) -> DataFrame:
    """The effect on a value of one per cent more of each input, the largest of an engagement first.

    ``flows(core_id, input, grp, cf)`` with factors ``(core_id, period_end, factor)`` are linear: an input's effect is
    its part of the value; ``sensitivity(core_id, input, grp, effect)`` brings those of rates, computed anew.
    """
    linear = flows.join(factors, ["core_id", "period_end"]).groupBy("core_id", "grp", "input").agg((F.sum(F.col("cf") * F.col("factor")) * bump).alias("effect"))
    d = linear.unionByName(sensitivity)
    w = Window.partitionBy("core_id").orderBy("grp", F.abs("effect").desc(), "input")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
