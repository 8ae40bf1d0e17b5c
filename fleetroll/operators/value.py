"""Value: splits, bridges, waterfalls, forecast steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetroll.functions.text import ties


def split(factored: DataFrame, terminal: Column) -> DataFrame:
    """PV per core in a forecast and a terminal part, with the terminal share."""
    pv = F.col("cf") * F.col("factor")
    g = factored.groupBy("core_id").agg(F.sum(F.when(~terminal, pv).otherwise(0.0)).alias("forecast"), F.sum(F.when(terminal, pv).otherwise(0.0)).alias("terminal"))
    return g.withColumn("terminal_share", F.when(F.col("forecast") + F.col("terminal") != 0, F.col("terminal") / (F.col("forecast") + F.col("terminal"))))


#: Labels of streams of franking credits.
FRANKING = r"(?i)frank|imputation|gamma"


def split_value(streams: DataFrame) -> DataFrame:
    """The parts of a value: forecast, terminal, franking and other PV per engagement, and their shares of the whole.

    ``streams(engagement_id, core_id, label, period_end, cf, tv, factor)`` hold all discountings of a value.  Of those not
    labelled as franking the main one is that of the largest PV; its terminal value, and all of another one of a single
    live period with a terminal value, are terminal; the rest of the main one is the forecast, all else is other.
    """
    key = ["engagement_id", "core_id"]
    live = F.col("factor") != 0
    g = streams.groupBy(*key).agg(F.max(F.coalesce(F.col("label").rlike(FRANKING), F.lit(False))).alias("frank"), F.sum(F.col("cf") * F.col("factor")).alias("pv"), F.sum(F.col("tv") * F.col("factor")).alias("tv"), F.count_if(live & ((F.col("cf") != 0) | (F.col("tv") != 0))).alias("periods"))
    w = Window.partitionBy("engagement_id").orderBy("frank", F.abs("pv").desc(), "core_id")
    g = g.withColumn("main", (F.row_number().over(w) == 1) & ~F.col("frank"))
    part = {
        "forecast": F.when(F.col("main"), F.col("pv") - F.col("tv")),
        "terminal": F.when(F.col("main"), F.col("tv")).when(~F.col("frank") & (F.col("periods") == 1) & (F.col("tv") != 0), F.col("pv")),
        "franking": F.when(F.col("frank"), F.col("pv")),
        "other": F.when(~F.col("main") & ~F.col("frank") & ~((F.col("periods") == 1) & (F.col("tv") != 0)), F.col("pv")),
    }
    v = g.groupBy("engagement_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(n) for n, c in part.items()])
    total = sum((F.col(n) for n in list(part)[1:]), F.col("forecast"))
    return v.withColumn("total", total).withColumns({f"{n}_share": F.when(total != 0, F.col(n) / total) for n in part})


def reconcile(parts: DataFrame, scales: list[float] = [1.0, 1e-3, 1e-6, 1e3]) -> DataFrame:
    """The scale at which most of a group's computed parts tie to the reported ones; the first on a tie.

    ``parts(core_id, part, computed, printed)``: a part ties within half a unit of the last digit that the report prints.
    """
    s = parts.sparkSession.createDataFrame(list(enumerate(scales)), "scale_no int, scale double")
    g = parts.crossJoin(F.broadcast(s)).groupBy("core_id", "scale_no", "scale").agg(F.count_if(ties(F.col("computed") * F.col("scale"), F.col("printed"))).alias("ties"))
    w = Window.partitionBy("core_id").orderBy(F.col("ties").desc(), "scale_no")
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "scale_no")


def bridge(points: DataFrame, steps: list[str], by: list[str]) -> DataFrame:
    """Steps between consecutive points of value, in order: the first point, then each difference. They sum to the last."""
    order = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col("point")).cast("int")
    w = Window.partitionBy(*by).orderBy("step_no")
    p = points.withColumn("step_no", order).where("step_no > 0")
    return p.withColumn("change", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0)))


#: The steps of a roll-forward bridge, in order; the first, fourth and last are totals.
STEPS = ["report", "rounding", "prior_feed", "rebuilt", "time", "cash", "forecast", "held", "rate", "this_year"]
TOTALS = ["report", "rebuilt", "this_year"]
ROLL = ["time", "cash", "forecast"]


def bridges(ends: DataFrame, mids: DataFrame) -> DataFrame:
    """The bridge of an engagement from last year's report to this year, low, mid and high: (engagement_id, end, step_no, step, value).

    ``ends(engagement_id, end, report, saved, rebuilt, at_time, at_cash, before, at_rate, this_year, held)`` of low and high
    are values as far as they are known: the saved one, rebuilt, moved in time, without the cash of the year, on this
    year's forecast, with this year's held inputs, and at this year's rate.  Steps are differences; where the value is
    held the bridge stops at rebuilt.  An end whose time and cash aren't known has its roll-forward as one step, and then
    so has the other.  Mid is the average, step by step; its report is ``mids(engagement_id, mid)``.
    """
    d = lambda a, b: F.col(a) - F.col(b)
    go = ~F.col("held") & F.col("this_year").isNotNull() & F.col("rebuilt").isNotNull()
    split = F.col("at_time").isNotNull() & F.col("at_cash").isNotNull()
    step = lambda n, v, when=F.lit(True): F.when(when & v.isNotNull(), F.struct(F.lit(n).alias("step"), v.alias("value")))
    w = Window.partitionBy("engagement_id")
    e = ends.withColumn("_split", F.min(split).over(w))
    steps = F.array_compact(
        F.array(
            step("report", F.col("report")), step("rounding", d("saved", "report")), step("prior_feed", d("rebuilt", "saved")), step("rebuilt", F.col("rebuilt")),
            step("time", d("at_time", "rebuilt"), go & F.col("_split")), step("cash", d("at_cash", "at_time"), go & F.col("_split")), step("forecast", d("before", "at_cash"), go & F.col("_split")), step("roll", d("before", "rebuilt"), go & ~F.col("_split")),
            step("held", d("at_rate", "before"), go & (F.col("at_rate") != F.col("before"))), step("rate", d("this_year", "at_rate"), go), step("this_year", F.col("this_year"), go),
        )
    )
    s = e.select("engagement_id", "end", F.explode(steps).alias("s")).select("engagement_id", "end", "s.*")
    mid = s.groupBy("engagement_id", "step").agg(F.count("*").alias("n"), F.avg("value").alias("value")).where("n = 2")
    mid = mid.join(mids, "engagement_id", "left").select("engagement_id", F.lit("mid").alias("end"), "step", F.when(F.col("step") == "report", F.coalesce("mid", "value")).otherwise(F.col("value")).alias("value"))
    order = F.array(*[F.lit(x) for x in [*STEPS[:4], "roll", *STEPS[4:]]])
    return s.union(mid).select("engagement_id", "end", F.array_position(order, F.col("step")).cast("int").alias("step_no"), "step", "value")


def waterfall(steps: DataFrame, by: list[str]) -> DataFrame:
    """Bars of a bridge: running value after each step, base, up and down; a total starts the run anew."""
    w = Window.partitionBy(*by).orderBy("step_no")
    d = steps.withColumn("_g", F.count_if(F.col("is_total")).over(w))
    run = F.sum("amount").over(Window.partitionBy(*by, "_g").orderBy("step_no"))
    d = d.withColumn("after", run).withColumn("_before", F.col("after") - F.when(F.col("is_total"), F.col("after")).otherwise(F.col("amount")))
    return d.select(*steps.columns, "after", F.least("_before", "after").alias("base"), F.greatest(F.col("after") - F.col("_before"), F.lit(0.0)).alias("up"), F.greatest(F.col("_before") - F.col("after"), F.lit(0.0)).alias("down"))


def split_step(rolled: DataFrame, this: DataFrame, factor: DataFrame, values: DataFrame | None = None, check_at: float = 0.005, block_at: float = 0.02) -> DataFrame:
    """The forecast step by period: revised, added, dropped and terminal cash flows at this year's factors.

    Feeds are ``(core_id, period_end, cf, tv)``, tv being the part of cf that is terminal value (none without the column).
    With ``values(core_id, step, balances, reference)`` also ``outside``: what of the step neither the cash flows nor the
    balances explain, and ``finding``: block or check by its share of the reference, or 'opposite' where the cash flows
    move the other way.
    """
    key = ["core_id", "period_end"]
    side = lambda d, n: d.select(*key, F.col("cf").alias(n), (F.col("tv") if "tv" in d.columns else F.lit(0.0)).alias(f"{n}tv"))
    j = side(rolled, "r").join(side(this, "t"), key, "full").join(factor.select(*key, "factor"), key)
    part = lambda cond, v: F.sum(F.when(cond, v * F.col("factor")).otherwise(0.0))
    has_r, has_t, z = F.col("r").isNotNull(), F.col("t").isNotNull(), F.lit(0.0)
    r, t, rtv, ttv = F.col("r") - F.col("rtv"), F.col("t") - F.col("ttv"), F.coalesce("rtv", z), F.coalesce("ttv", z)
    g = j.groupBy("core_id").agg(part(has_r & has_t, t - r).alias("revised"), part(~has_r, t).alias("added"), part(~has_t, -r).alias("dropped"), part(F.lit(True), ttv - rtv).alias("terminal"))
    if values is None:
        return g
    cash = F.col("revised") + F.col("added") + F.col("dropped") + F.col("terminal")
    v = g.join(values, "core_id").withColumn("outside", F.col("step") - cash - F.col("balances"))
    share, moves = F.abs("outside") / F.abs("reference"), F.abs(cash) / F.abs("reference") > 0.001
    return v.withColumn("finding", F.when(share > block_at, "block").when(share > check_at, "check").when(moves & (F.col("step") * cash < 0), "opposite").otherwise("ok"))


#: A discounting that moves on by a rate this far from its own, a year, is a point to check, or holds the value back.
TIME_CHECK, TIME_HOLD = 0.005, 0.015


def time_check(a: DataFrame, b: DataFrame, rates: DataFrame, years: float) -> DataFrame:
    """Whether a roll moves each discounting on by its own rate: (core_id, pa, pb, matched, implied, off, finding).

    ``a`` and ``b`` are two runs' cash flows and factors, ``years`` apart; ``rates(core_id, rate)``.  Cash flows meet by amount, to
    nine significant digits, an amount that comes again in order; what one run alone has isn't matched.  Their present
    values imply a rate; 'check' if it is over half a per cent from the discounting's own, 'hold' over one and a half.
    """

    def numbered(d: DataFrame, pv: str) -> DataFrame:
        d = d.where("cf <> 0 and factor <> 0").withColumn("amount", F.format_string("%.8e", "cf"))
        return d.withColumn("n", F.row_number().over(Window.partitionBy("core_id", "amount").orderBy("period_end"))).select("core_id", "amount", "n", (F.col("cf") * F.col("factor")).alias(pv))

    j = numbered(a, "pa").join(numbered(b, "pb"), ["core_id", "amount", "n"])
    g = j.groupBy("core_id").agg(F.sum("pa").alias("pa"), F.sum("pb").alias("pb"), F.count("*").alias("matched"))
    g = g.withColumn("implied", F.when(F.col("pa") / F.col("pb") > 0, F.pow(F.col("pb") / F.col("pa"), F.lit(1 / years)) - 1)).join(rates.select("core_id", "rate"), "core_id", "left")
    off = F.col("implied") - F.col("rate")
    finding = F.when(off.isNull(), F.lit(None)).when(F.abs(off) > TIME_HOLD, "hold").when(F.abs(off) > TIME_CHECK, "check").otherwise("ok")
    return g.withColumns({"off": off, "finding": finding}).drop("rate")


def methods(flows: DataFrame, discountings: DataFrame) -> DataFrame:
    """PV under each timing and day count and with cash flows on the date kept, and its difference to the default."""
    from . import fin

    spark = flows.sparkSession
    m = spark.createDataFrame([("default", None, None, 0), ("mid-period", "mid", None, 0), ("mid-year", "mid-year", None, 0), ("other day count", None, "actual/365", 0), ("on-date kept", None, None, 1)], "method string, t string, d string, early int")
    p = discountings.crossJoin(F.broadcast(m))
    p = p.withColumn("timing", F.coalesce("t", "timing")).withColumn("day_count", F.coalesce("d", "day_count")).withColumn("valuation_date", F.date_sub("valuation_date", F.col("early")))
    pv = fin.dcf(flows, p.drop("t", "d", "early"), extra=("method",)).select("core_id", "method", "pv")
    base = pv.where("method = 'default'").select("core_id", F.col("pv").alias("_b"))
    return pv.join(base, "core_id").select("core_id", "method", "pv", (F.col("pv") - F.col("_b")).alias("effect"))


#: Methods of a valuation, the first the default: how the same cash flows may be valued otherwise.
METHODS = ["overlay", "on date kept", "own flags", "recompute", "mid-period", "mid-year", "other day count", "mid rate"]


def inventory(flows: DataFrame, ends: DataFrame, flags: DataFrame) -> DataFrame:
    """Every method's value at both ends, and what it makes to the default's: (core_id, method, low, mid, high, to_low, to_mid, to_high).

    ``ends`` are discountings with ``end``, 'low' or 'high'; ``flags(core_id, period_end, flag)`` are the overlay's own forecast flags
    of last year, where it has any.  'on date kept' adds the cash flow that ends on the valuation date, undiscounted; 'own
    flags' takes the flags after that date in place of the cut-off; 'recompute' discounts as the overlay does, the three
    after it by another timing or the other day count; 'mid rate' has the mid alone, of both ends at the midpoint of their
    rates.  All are worked out side by side in one pass over the flows; a method that a core doesn't allow has no row.
    """
    from . import fin

    middle = ends.groupBy("core_id").agg((F.avg("rate")).alias("_mid"))
    j = fin._started(flows.join(flags, ["core_id", "period_end"], "left"), ends.join(middle, "core_id"), ("end",))
    own, r = fin._years(F.col("timing"), F.col("day_count")), fin._rate(F.col("rate"))
    other = F.when(F.col("day_count") == "actual/365", "actual/actual").otherwise("actual/365")
    at = lambda t, rate=r: F.col("cf") / F.pow(1 + rate, t)
    live = ~F.col("_off")
    worked = {
        "overlay": F.when(live, at(own)), "on date kept": F.when(live, at(own)).when(F.col("period_end") == F.col("valuation_date"), F.col("cf")),
        "own flags": F.when(F.col("period_end") > F.col("valuation_date"), at(own) * F.col("flag")), "recompute": F.when(live, at(own)),
        "mid-period": F.when(live, at(fin._years(F.lit("mid"), F.col("day_count")))), "mid-year": F.when(live, at(fin._years(F.lit("mid-year"), F.col("day_count")))),
        "other day count": F.when(live, at(fin._years(F.col("timing"), other))), "mid rate": F.when(live, at(own, fin._rate(F.col("_mid")))),
    }
    g = j.groupBy("core_id", "end").agg(*[F.sum(v).alias(f"m{i}") for i, v in enumerate(worked.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("method"), F.col(f"m{i}").alias("v")) for i, m in enumerate(worked)]))
    g = g.select("core_id", "end", rows.alias("x")).where("x.v is not null").groupBy("core_id", "x.i", "x.method").agg(*[F.max(F.when(F.col("end") == e, F.col("x.v"))).alias(e) for e in ("low", "high")])
    g = g.withColumn("mid", (F.col("low") + F.col("high")) / 2)
    g = g.withColumns({e: F.when(F.col("method") != "mid rate", F.col(e)) for e in ("low", "high")})
    w = Window.partitionBy("core_id")
    to = [(F.col(e) - F.max(F.when(F.col("i") == 0, F.col(e))).over(w)).alias(f"to_{e}") for e in ("low", "mid", "high")]
    return g.select("core_id", "method", "low", "mid", "high", *to)


def method_step(values: DataFrame, methods: DataFrame, preferred: DataFrame) -> DataFrame:
    """The preferred method as a step of the bridge before this year's value: (core_id, end, step, this_year).

    ``values(core_id, end, this_year)``; ``preferred(core_id, method)``.  The default, a method that isn't there, and an end
    that a method leaves where it is make no step.
    """
    e = F.explode(F.array(*[F.struct(F.lit(x).alias("end"), F.col(f"to_{x}").alias("move")) for x in ("low", "mid", "high")]))
    m = methods.where(F.col("method") != METHODS[0]).join(preferred, ["core_id", "method"], "left_semi").select("core_id", e.alias("x")).select("core_id", "x.*")
    d = values.join(m, ["core_id", "end"], "left").withColumn("step", F.coalesce("move", F.lit(0.0)))
    return d.select("core_id", "end", "step", (F.col("this_year") + F.col("step")).alias("this_year"))


def scenario(flows: DataFrame, discountings: DataFrame, overrides: DataFrame, bridge: DataFrame | None = None, dropped: DataFrame | None = None) -> DataFrame:
    """Model and scenario value of each discounting: (core_id, model, scenario, model_total, scenario_total, changed).

    ``overrides(core_id, new_rate, new_timing, new_date, new_day_count, new_cutoff)``, all but the first optional: what isn't
    given stays.  ``new_cutoff`` is a date as text, or '' for none.  ``bridge(core_id, item, amount)`` are what is added to the
    present value, but for the ``dropped(core_id, item)`` in the scenario.  ``changed`` names what differs.
    """
    from . import fin

    for c, kind in (("new_rate", "double"), ("new_timing", "string"), ("new_date", "date"), ("new_day_count", "string"), ("new_cutoff", "string")):
        if c not in overrides.columns:
            overrides = overrides.withColumn(c, F.lit(None).cast(kind))
    j = discountings.join(overrides, "core_id", "left")
    cut = F.when(F.col("new_cutoff").isNull(), F.col("terminal_date")).when(F.col("new_cutoff") != "", F.to_date("new_cutoff"))
    s = j.select("core_id", F.coalesce("new_rate", "rate").alias("rate"), F.coalesce("new_date", "valuation_date").alias("valuation_date"), F.coalesce("new_timing", "timing").alias("timing"), F.coalesce("new_day_count", "day_count").alias("day_count"), cut.alias("terminal_date"))
    named = {"rate": ("new_rate", "rate"), "date": ("new_date", "valuation_date"), "timing": ("new_timing", "timing"), "day count": ("new_day_count", "day_count")}
    changed = [F.when(F.col(n) != F.col(o), name) for name, (n, o) in named.items()] + [F.when(~cut.eqNullSafe(F.col("terminal_date")), "cut-off")]
    a, b = fin.dcf(flows, discountings).select("core_id", F.col("pv").alias("model")), fin.dcf(flows, s).select("core_id", F.col("pv").alias("scenario"))
    out = a.join(b, "core_id").join(j.select("core_id", F.array_compact(F.array(*changed)).alias("_c")), "core_id")
    if bridge is None:
        return out.select("core_id", "model", "scenario", F.col("model").alias("model_total"), F.col("scenario").alias("scenario_total"), F.array_join("_c", ",").alias("changed"))
    gone = dropped.select("core_id", "item").distinct().withColumn("_gone", F.lit(True)) if dropped is not None else bridge.select("core_id", "item").limit(0).withColumn("_gone", F.lit(True))
    k = bridge.join(gone, ["core_id", "item"], "left").groupBy("core_id").agg(
        F.sum("amount").alias("_all"), F.coalesce(F.sum(F.when(F.col("_gone").isNull(), F.col("amount"))), F.lit(0.0)).alias("_kept"), F.array_sort(F.collect_list(F.when(F.col("_gone"), F.concat(F.lit("without "), F.col("item"))))).alias("_w")
    )
    out = out.join(k, "core_id", "left")
    nil = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("core_id", "model", "scenario", (F.col("model") + nil("_all")).alias("model_total"), (F.col("scenario") + nil("_kept")).alias("scenario_total"), F.array_join(F.concat("_c", F.coalesce("_w", F.array().cast("array<string>"))), ",").alias("changed"))


def fit_factors(factors: DataFrame, candidates: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Rate, date, timing and day count that give back every factor: ``factors(core_id, period_end, start, factor)``.

    For every candidate date and convention the rate follows from the first live factor in closed form; what doesn't
    give the others back within ``tol`` goes; then the latest date and the first convention.
    """
    from fleetroll.functions.dates import yearfrac

    from .fin import DAY_COUNTS, TIMINGS

    spark = factors.sparkSession
    c = spark.createDataFrame([(i * 2 + k, t, d) for i, t in enumerate(TIMINGS) for k, d in enumerate(DAY_COUNTS)], "combo int, timing string, day_count string")
    f = factors.where("factor > 0").join(candidates.select("core_id", "date").distinct(), "core_id").where("period_end > date").crossJoin(F.broadcast(c))
    start = F.greatest("start", "date")
    mid = F.date_add(start, F.floor(F.date_diff("period_end", start) / 2).cast("int"))
    to = F.when(F.col("timing") == "mid", mid).otherwise(F.col("period_end"))
    t = F.when(F.col("day_count") == "actual/365", yearfrac(F.col("date"), to, 3)).otherwise(yearfrac(F.col("date"), to, 1)) - F.when(F.col("timing") == "mid-year", 0.5).otherwise(0.0)
    f = f.withColumn("t", t)
    first = f.where("t > 0").groupBy("core_id", "date", "combo").agg(F.min_by(F.struct("factor", "t"), "period_end").alias("x"))
    rate = first.select("core_id", "date", "combo", (F.pow(F.col("x.factor"), -1 / F.col("x.t")) - 1).alias("rate"))
    off = F.max(F.abs(F.pow(1 + F.col("rate"), -F.col("t")) - F.col("factor")))
    g = f.join(rate, ["core_id", "date", "combo"]).groupBy("core_id", "date", "combo", "timing", "day_count", "rate").agg(off.alias("off"), F.count("*").alias("periods"))
    w = Window.partitionBy("core_id").orderBy(F.col("date").desc(), "combo")
    return g.where((F.col("off") < tol) & (F.col("periods") > 1)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "combo", "off")


def fit_terminal(cells: DataFrame, values: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Which read cells make a terminal value: (core_id, form, x_cell, r_cell, g_cell, m_cell), one form for each value.

    'flat' x / (r - g), 'grown' x (1 + g) / (r - g), with 0 <= g < r < 0.3, or else 'multiple' m x, with 0 < m < 100: the
    multiple whose label speaks of one, then the smallest.  ``cells(core_id, cell, value, label)`` are what a terminal
    value reads, ``values(core_id, tv)``.  Every form is a factor on x, so a value's logarithm is a factor's and x's
    together: factors and cells meet in buckets of the logarithm, never as triples.
    """
    c = cells.join(values, "core_id").where("value <> 0 or value = 0 and tv <> 0").withColumn("_w", 2 * tol * F.greatest(F.lit(1.0), 1 / F.abs("tv")))
    bucket = lambda v: F.floor(F.log(v) / F.col("_w"))
    x = c.where("value <> 0 and sign(value) = sign(tv)").select("core_id", F.col("cell").alias("x_cell"), F.col("value").alias("x"), F.explode(F.sequence(bucket(F.abs("value")) - 1, bucket(F.abs("value")) + 1)).alias("b"))
    rate = c.where("value >= 0 and value < 0.3")
    r = rate.select("core_id", "tv", "_w", F.col("cell").alias("r_cell"), F.col("value").alias("r"))
    g = rate.select("core_id", F.col("cell").alias("g_cell"), F.col("value").alias("g"))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    form = F.explode(F.array(F.struct(F.lit("flat").alias("form"), (1 / (F.col("r") - F.col("g"))).alias("k")), F.struct(F.lit("grown").alias("form"), ((1 + F.col("g")) / (F.col("r") - F.col("g"))).alias("k"))))
    gordon = r.join(g, "core_id").where("g < r and g_cell <> r_cell").select("core_id", "tv", "_w", form.alias("f"), "r_cell", "g_cell").select("core_id", "tv", "_w", "f.form", "f.k", "r_cell", "g_cell", text.alias("m_cell"), none.alias("m"), F.lit(0).alias("unnamed"))
    unnamed = (~F.coalesce(F.col("label"), F.lit("")).rlike(r"(?i)multiple|exit|ev\s*/|\bx\b|times")).cast("int")
    multiple = c.where("value > 0 and value < 100").select("core_id", "tv", "_w", F.lit("multiple").alias("form"), F.col("value").alias("k"), text.alias("r_cell"), text.alias("g_cell"), F.col("cell").alias("m_cell"), F.col("value").alias("m"), unnamed.alias("unnamed"))
    f = gordon.union(multiple).withColumn("b", bucket(F.abs("tv") / F.col("k")))
    j = f.join(x, ["core_id", "b"]).where(F.abs(F.col("k") * F.col("x") - F.col("tv")) <= tol * F.greatest(F.lit(1.0), F.abs("tv")))
    j = j.where("(r_cell is null or x_cell <> r_cell) and (g_cell is null or x_cell <> g_cell) and (m_cell is null or x_cell <> m_cell)")
    order = F.struct((F.col("form") == "multiple").alias("later"), "form", "unnamed", "m", "m_cell", "x_cell", "r_cell", "g_cell")
    return j.groupBy("core_id").agg(F.min(order).alias("o")).select("core_id", "o.form", "o.x_cell", "o.r_cell", "o.g_cell", "o.m_cell")


def zero_roll(values: DataFrame) -> DataFrame:
    """This model at the last date over the last value: ok, confirm or off."""
    r = F.col("at_last") / F.col("last")
    return values.withColumn("ratio", r).withColumn("verdict", F.when(~r.between(0.75, 1.33) | r.isNull(), "off").when(~r.between(0.87, 1.15), "confirm").otherwise("ok"))


def forecast_end(flows: DataFrame) -> DataFrame:
    """Last period with a cash flow of each feed, last and this, and the months between them."""
    g = flows.where("cf <> 0").groupBy("core_id").agg(F.max(F.when(F.col("feed") == "last", F.col("period_end"))).alias("last_end"), F.max(F.when(F.col("feed") == "this", F.col("period_end"))).alias("this_end"))
    return g.withColumn("months", F.round(F.months_between("this_end", "last_end")).cast("int"))


def moved_ends(ends: DataFrame, cells: DataFrame, pattern: str = r"(?i)\bend|terminal|horizon|expir") -> DataFrame:
    """Typed dates that go along where a forecast ends on another date than last year's: (core_id, cell, was, now).

    ``ends`` is ``forecast_end``'s result, ``cells(core_id, cell, date, label, formula, rolled)`` the overlay's dates: one moves if it
    is typed, not among the ``rolled`` ones (valuation dates), the end of last year's forecast, and labelled as an end.
    """
    e = ends.where("last_end is not null and this_end is not null and last_end <> this_end").select("core_id", "last_end", "this_end")
    own = cells.where(F.col("formula").isNull() & ~F.coalesce("rolled", F.lit(False)) & F.col("label").rlike(pattern))
    return own.join(e, [own["core_id"] == e["core_id"], own["date"] == e["last_end"]]).select(own["core_id"], "cell", F.col("last_end").alias("was"), F.col("this_end").alias("now"))


def roll_months(prior: DataFrame, current: DataFrame) -> DataFrame:
    """The months by which most sheets' first periods moved, of 1 to 24 (the fewer on a tie), per workbook."""
    a = prior.groupBy("workbook_id", "sheet").agg(F.min("period_end").alias("a"))
    b = current.groupBy("workbook_id", "sheet").agg(F.min("period_end").alias("b"))
    m = a.join(b, ["workbook_id", "sheet"]).withColumn("months", ((F.year("b") - F.year("a")) * 12 + F.month("b") - F.month("a")).cast("int")).where("months between 1 and 24")
    n = m.groupBy("workbook_id", "months").agg(F.count("*").alias("sheets"))
    w = Window.partitionBy("workbook_id").orderBy(F.col("sheets").desc(), "months")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def roll_plan(dates: DataFrame, prior: DataFrame, current: DataFrame, most: int = 24, sheets: int = 5) -> DataFrame:
    """How far each engagement rolls, how that is known, and its horizon: (workbook_id, months, how, new_date, base, horizon).

    ``dates(workbook_id, overlay_date, prior_date, current_date, this_date)``.  In order: to the date set for this year
    (set); from the overlay's to this year's model's, if later (model), and no roll if it isn't (check); between the two
    models' (models); the move of most sheets' first periods, forward and of ``most`` months, the fewer on a tie, where
    ``sheets`` are seen (timelines); 12 (assumed).
    """
    a = prior.groupBy("workbook_id", "sheet").agg(F.min("period_end").alias("a"))
    b = current.groupBy("workbook_id", "sheet").agg(F.min("period_end").alias("b"))
    apart = lambda x, y: ((F.year(y) - F.year(x)) * 12 + F.month(y) - F.month(x)).cast("int")
    m = a.join(b, ["workbook_id", "sheet"]).withColumn("months", apart("a", "b"))
    n = m.groupBy("workbook_id", "months").agg(F.count("*").alias("n")).withColumn("seen", F.sum("n").over(Window.partitionBy("workbook_id")))
    moved = n.where((F.col("months") > 0) & (F.col("months") <= most) & (F.col("seen") >= sheets)).groupBy("workbook_id").agg(F.min_by("months", F.struct(-F.col("n"), "months")).alias("moved"))
    d = dates.join(moved, "workbook_id", "left")
    base = F.coalesce("overlay_date", "prior_date")
    how = (
        F.when(F.col("this_date") > base, "set").when(F.col("current_date") > F.col("overlay_date"), "model").when(F.col("overlay_date").isNotNull() & F.col("current_date").isNotNull(), "check")
        .when(F.col("overlay_date").isNull() & (F.col("current_date") > F.col("prior_date")), "models").when(F.col("moved").isNotNull(), "timelines").otherwise("assumed")
    )
    d = d.withColumn("how", how)
    h = F.col("how")
    to = F.when(h == "set", F.col("this_date")).when(h.isin("model", "models"), F.col("current_date")).when(h == "check", F.col("overlay_date"))
    months = F.when(h.isin("set", "model", "models"), apart(base, to)).when(h == "check", 0).when(h == "timelines", F.col("moved")).otherwise(12)
    end = F.when(base == F.last_day(base), F.last_day(F.add_months(base, months))).otherwise(F.add_months(base, months))
    d = d.join(horizons(prior, current).select("workbook_id", "horizon"), "workbook_id", "left")
    return d.select("workbook_id", months.alias("months"), "how", F.coalesce(to, end).alias("new_date"), base.alias("base"), "horizon")


def horizons(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(workbook_id, horizon, fixed, rolling): whether this year's periods end where last year's did.

    Every sheet that both years have with two periods and more votes: fixed if its last period is the same, else
    rolling; the workbook is fixed if more sheets are.  Without such sheets it has no row.
    """
    span = lambda d, n: d.groupBy("workbook_id", "sheet").agg(F.max("period_end").alias(n), F.count_distinct("period_end").alias(f"_{n}")).where(F.col(f"_{n}") >= 2)
    j = span(prior, "a").join(span(current, "b"), ["workbook_id", "sheet"])
    g = j.groupBy("workbook_id").agg(F.count_if(F.col("a") == F.col("b")).alias("fixed"), F.count_if(F.col("a") != F.col("b")).alias("rolling"))
    return g.select("workbook_id", F.when(F.col("fixed") > F.col("rolling"), "fixed").otherwise("rolling").alias("horizon"), "fixed", "rolling")


def period_shifts(prior: DataFrame, plan: DataFrame) -> DataFrame:
    """(workbook_id, sheet, months, shift): how far each sheet's periods move, the whole ones that end between the dates.

    ``plan(workbook_id, base, months, horizon)``: the date rolled from, how far, and whether the horizon is fixed, in which
    case nothing moves.  Periods headed by firsts of a month end the day before the next starts.  Without a base date as
    many whole periods move as fit.  A sheet with one period stays.
    """
    d = prior.select("workbook_id", "sheet", "period_end").distinct()
    d = d.withColumn("_gap", F.date_diff("period_end", F.lag("period_end").over(Window.partitionBy("workbook_id", "sheet").orderBy("period_end"))))
    g = d.groupBy("workbook_id", "sheet").agg(F.sort_array(F.collect_list("_gap")).alias("_g"), F.every(F.dayofmonth("period_end") == 1).alias("_starts"))
    length = F.greatest(F.lit(1), F.round(F.get("_g", F.floor(F.size("_g") / 2).cast("int")) / 30.44).cast("int"))
    g = g.select("workbook_id", "sheet", "_starts", length.alias("len")).join(plan, "workbook_id")
    x = d.join(g, ["workbook_id", "sheet"])
    end = F.when(F.col("_starts"), F.date_sub(F.add_months("period_end", F.col("len")), 1)).otherwise(F.col("period_end"))
    to = F.when(F.col("base") == F.last_day("base"), F.last_day(F.add_months("base", F.col("months")))).otherwise(F.add_months("base", F.col("months")))
    n = x.groupBy("workbook_id", "sheet").agg(F.count_if((end > F.col("base")) & (end <= to)).alias("n"), *[F.first(c).alias(c) for c in ("len", "base", "months", "horizon")])
    whole = F.when(F.col("base").isNotNull(), F.col("n")).otherwise(F.floor(F.greatest(F.col("months"), F.lit(0)) / F.col("len")))
    still = (F.col("months") == 0) | (F.col("horizon") == "fixed") | F.col("len").isNull()
    return n.select("workbook_id", "sheet", "months", F.when(F.coalesce(still, F.lit(False)), 0).otherwise(F.col("len") * whole).cast("int").alias("shift"))


def conclusion(facts: DataFrame) -> DataFrame:
    """low, mid and high of an engagement: ex unless cum is spoken of three times as often; ends put in order."""
    f = facts.withColumn("basis", F.when(F.col("cum_mentions") >= 3 * F.greatest("ex_mentions", F.lit(1)), "cum").otherwise("ex"))
    low, high = F.least("low", "high"), F.greatest("low", "high")
    return f.select("engagement_id", "basis", low.alias("low"), ((low + high) / 2).alias("mid"), high.alias("high"))
