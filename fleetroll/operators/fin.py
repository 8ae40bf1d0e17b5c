"""Discounting: factors, present values, conventions, rates of return."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetroll.functions.dates import yearfrac

TIMINGS = ["end", "mid", "mid-year"]
DAY_COUNTS = ["actual/actual", "actual/365"]


def _fraction(to: Column, day_count: Column) -> Column:
    return F.when(day_count == "actual/365", yearfrac(F.col("valuation_date"), to, 3)).otherwise(yearfrac(F.col("valuation_date"), to, 1))


def _years(timing: Column, day_count: Column) -> Column:
    """Years to which a period is discounted; ``_start`` is the period's start, not before the valuation date."""
    middle = F.date_add("_start", F.floor(F.date_diff("period_end", "_start") / 2).cast("int"))
    return F.when(timing == "mid", _fraction(middle, day_count)).when(timing == "mid-year", _fraction(F.col("period_end"), day_count) - 0.5).otherwise(_fraction(F.col("period_end"), day_count))


def _started(flows: DataFrame, discountings: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Flows with their discounting's parameters, the start of each period, and ``_off``: before the date or after the end."""
    j = flows.join(discountings, "core_id")
    w = Window.partitionBy("core_id", *extra).orderBy("period_end")
    start = F.coalesce(F.date_add(F.lag("period_end").over(w), 1), F.date_sub("period_end", 90))
    off = (F.col("period_end") <= F.col("valuation_date")) | (F.col("period_end") > F.coalesce("terminal_date", F.lit("9999-12-31").cast("date")))
    return j.withColumn("_start", F.greatest(start, "valuation_date")).withColumn("_off", off)


def _rate(r: Column) -> Column:
    return F.when(r >= 1, r / 100).otherwise(r)


def factors(flows: DataFrame, discountings: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``flows(core_id, period_end, ...)`` with their discounting's parameters and ``factor``.

    0 on or before the valuation date and after the terminal date.  'mid' discounts to the middle of the period, which
    starts a day after the previous end (the first: 90 days before its end) and not before the valuation date;
    'mid-year' takes half a year off.  ``extra`` names parameters that set apart discountings of one core.
    """
    j = _started(flows, discountings, extra)
    t = _years(F.col("timing"), F.col("day_count"))
    return j.withColumn("factor", F.when(F.col("_off"), F.lit(0.0)).otherwise(1 / F.pow(1 + _rate(F.col("rate")), t))).drop("_start", "_off")


def dcf(flows: DataFrame, discountings: DataFrame, adjustments: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per discounting: pv, periods discounted, periods left out before the date, first and last discounted, undiscounted sum."""
    f = factors(flows.where("period_end is not null"), discountings, extra)
    live = F.col("factor") != 0
    out = f.groupBy("core_id", *extra).agg(
        F.sum(F.col("cf") * F.col("factor")).alias("pv"),
        F.count_if(live).alias("periods"),
        F.count_if(F.col("period_end") <= F.col("valuation_date")).alias("before"),
        F.min(F.when(live, F.col("period_end"))).alias("first_period"),
        F.max(F.when(live, F.col("period_end"))).alias("last_period"),
        F.sum(F.when(live, F.col("cf"))).alias("undiscounted"),
    )
    if adjustments is not None:
        a = adjustments.groupBy("core_id").agg(F.sum("amount").alias("adjustment"))
        out = out.join(a, "core_id", "left").withColumn("value", F.col("pv") + F.coalesce("adjustment", F.lit(0.0)))
    return out


def fit_convention(flows: DataFrame, discountings: DataFrame, target: DataFrame, tol: float = 1e-6) -> DataFrame:
    """The first timing and day count that give ``target(core_id, pv)``; the first tried if none does. Six for each core.

    The six factors of a cash flow are worked out side by side, so flows aren't multiplied and one aggregation gives all
    six values.
    """
    combos = [(t, d) for t in TIMINGS for d in DAY_COUNTS]
    j = _started(flows.where("period_end is not null"), discountings.drop("timing", "day_count"))
    j = j.where("not _off").withColumn("_middle", F.date_add("_start", F.floor(F.date_diff("period_end", "_start") / 2).cast("int")))
    j = j.select("core_id", "cf", (1 + _rate(F.col("rate"))).alias("_g"), *[_fraction(F.col(c), F.lit(d)).alias(f"{c}{k}") for c in ("period_end", "_middle") for k, d in enumerate(DAY_COUNTS)])
    years = {"end": lambda k: F.col(f"period_end{k}"), "mid": lambda k: F.col(f"_middle{k}"), "mid-year": lambda k: F.col(f"period_end{k}") - 0.5}
    pv = lambda t, d: F.sum(F.col("cf") / F.pow(F.col("_g"), years[t](DAY_COUNTS.index(d))))
    g = discountings.select("core_id").join(j.groupBy("core_id").agg(*[pv(t, d).alias(f"pv{i}") for i, (t, d) in enumerate(combos)]), "core_id", "left").na.fill(0.0).join(target.withColumnRenamed("pv", "target"), "core_id")
    exact = lambda v: F.abs(v - F.col("target")) <= tol * F.greatest(F.lit(1.0), F.abs("target"))
    tried = F.array(*[F.struct(F.lit(t).alias("timing"), F.lit(d).alias("day_count"), F.col(f"pv{i}").alias("pv"), exact(F.col(f"pv{i}")).alias("exact")) for i, (t, d) in enumerate(combos)])
    g = g.withColumn("_t", tried).withColumn("_b", F.coalesce(F.get(F.filter("_t", lambda x: x["exact"]), F.lit(0)), F.get("_t", F.lit(0))))
    return g.select("core_id", "_b.*", "target")


def sensitivity(flows: DataFrame, discountings: DataFrame, shifts: list[float] = [-0.01, 0.0, 0.01]) -> DataFrame:
    """PV at shifted rates, the cash flows fixed: the years of a flow are worked out once, and its value at every rate."""
    j = _started(flows.where("period_end is not null"), discountings).withColumn("_years", _years(F.col("timing"), F.col("day_count")))
    pv = lambda x: F.sum(F.when(~F.col("_off"), F.col("cf") / F.pow(1 + _rate(F.col("rate") + x), F.col("_years"))).otherwise(0.0))
    g = j.groupBy("core_id").agg(*[pv(x).alias(f"pv{i}") for i, x in enumerate(shifts)])
    return g.select("core_id", F.explode(F.array(*[F.struct(F.lit(x).alias("shift"), F.col(f"pv{i}").alias("pv")) for i, x in enumerate(shifts)])).alias("s")).select("core_id", "s.*")


def npv(flows: DataFrame, rates: DataFrame) -> DataFrame:
    """The i-th value over (1 + rate)^i, in period order."""
    w = Window.partitionBy("core_id").orderBy("period_end")
    n = flows.withColumn("_i", F.row_number().over(w)).join(rates.select("core_id", "rate"), "core_id")
    return n.groupBy("core_id").agg(F.sum(F.col("cf") / F.pow(1 + F.col("rate"), F.col("_i"))).alias("npv"))


def xnpv(flows: DataFrame, rates: DataFrame) -> DataFrame:
    """Actual/365 from the first date."""
    first = F.min("period_end").over(Window.partitionBy("core_id"))
    n = flows.withColumn("_t", F.date_diff("period_end", first) / 365.0).join(rates.select("core_id", "rate"), "core_id")
    return n.groupBy("core_id").agg(F.sum(F.col("cf") / F.pow(1 + F.col("rate"), F.col("_t"))).alias("xnpv"))


def rate_of(cf: np.ndarray, t: np.ndarray, guess: float = 0.1) -> float:
    """The rate at which the flows are worth nothing: Newton, then bisection of ln(1 + rate) from a total loss to 1,000 %. NaN without both signs."""
    if not ((cf > 0).any() and (cf < 0).any()):
        return float("nan")
    value = lambda r: float(np.sum(cf * (1 + r) ** -t))
    r = guess
    for _ in range(50):
        v = value(r)
        slope = float(np.sum(-t * cf * (1 + r) ** (-t - 1)))
        if slope == 0 or not np.isfinite(slope):
            break
        step = v / slope
        r -= step
        if r <= -1:
            break
        if abs(step) < 1e-12:
            return r
    def sign(x: float) -> float:
        e = -x * t  # over its largest power, which takes no sign and lets nothing overflow
        return float(np.sign(np.sum(cf * np.exp(e - e.max()))))

    lo, hi = -700.0, float(np.log(11.0))
    a, b = sign(lo), sign(hi)
    if not a * b <= 0:
        return float("nan")
    for _ in range(200):
        mid = (lo + hi) / 2
        v = sign(mid)
        lo, hi, a = (mid, hi, v) if a * v > 0 else (lo, mid, a)
    return float(np.expm1((lo + hi) / 2))


def irr(flows: DataFrame, dated: bool = False) -> DataFrame:
    """irr per core: by period number, or by days/365 from the first date if ``dated``. Null without both signs.

    A core's flows meet in one row, as an array in period order; a batch of cores goes through Python at once.
    """
    g = flows.groupBy("core_id").agg(F.array_sort(F.collect_list(F.struct("period_end", "cf"))).alias("f"))
    days = F.transform("f", lambda x: F.date_diff(x["period_end"], F.get("f", F.lit(0))["period_end"]) / F.lit(365.0))
    t = days if dated else F.transform("f", lambda x, i: i.cast("double"))

    @F.pandas_udf("double")
    def solved(cf: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([rate_of(np.asarray(c), np.asarray(x)) for c, x in zip(cf, t)])

    out = g.select("core_id", solved(F.transform("f", lambda x: x["cf"]), t).alias("irr"))
    return out.withColumn("irr", F.nanvl("irr", F.lit(None)))


def cut_off(flows: DataFrame, dates: DataFrame, keep_on_date: bool = False) -> DataFrame:
    """Cash flows of periods that end before the new date (or on it, unless kept) at nil."""
    j = flows.join(dates.select("core_id", "new_date"), "core_id")
    past = F.col("period_end") < F.col("new_date") if keep_on_date else F.col("period_end") <= F.col("new_date")
    return j.withColumn("cf", F.when(past, F.lit(0.0)).otherwise(F.col("cf")))


def cumulative_pv(factored: DataFrame) -> DataFrame:
    """Running present value by period; null before the first discounted period."""
    w = Window.partitionBy("core_id").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0)
    live = F.max(F.when(F.col("factor") != 0, 1).otherwise(0)).over(w)
    return factored.withColumn("cumulative", F.when(live == 1, F.sum(F.col("cf") * F.col("factor")).over(w)))


def tail_zeros(flows: DataFrame, dates: DataFrame) -> DataFrame:
    """Periods after the date with no cash flow behind the last one that has some; 0 if none has."""
    j = flows.join(dates.select("core_id", "new_date"), "core_id").where("period_end > new_date")
    last = j.groupBy("core_id").agg(F.max(F.when(F.coalesce("cf", F.lit(0.0)) != 0, F.col("period_end"))).alias("last"))
    return j.join(last, "core_id").groupBy("core_id").agg(F.count_if(F.col("period_end") > F.col("last")).alias("tail"))
