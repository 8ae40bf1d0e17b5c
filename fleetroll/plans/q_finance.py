"""Queries on discounting and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.functions import dates, xl
from fleetroll.operators import fin
from fleetroll.sources.adapters import cte, view

from .registry import query


def _leap(y):
    return f"day(last_day(make_date(({y})::INT, 2, 1))) = 29"


def sql_actual(a: str, b: str) -> str:
    """Actual/actual for a <= b, as text."""
    y1, y2 = f"year({a})", f"year({b})"
    on = f"CASE WHEN month({a}) = 2 AND day({a}) = 29 THEN make_date(({y1} + 1)::INT, 3, 1) ELSE ({a} + INTERVAL 12 MONTH)::DATE END"
    holds = lambda y: f"({_leap(y)} AND last_day(make_date(({y})::INT, 2, 1)) BETWEEN {a} AND {b})"
    mean = f"((make_date(({y2} + 1)::INT, 1, 1) - make_date(({y1})::INT, 1, 1))::DOUBLE / ({y2} - {y1} + 1))"
    year = f"CASE WHEN {y1} = {y2} THEN CASE WHEN {_leap(y1)} THEN 366 ELSE 365 END WHEN {holds(y1)} OR {holds(y2)} THEN 366 ELSE 365 END"
    return f"(({b} - {a}) / (CASE WHEN {b} <= {on} THEN ({year})::DOUBLE ELSE {mean} END))"


def sql_factors(flows: str, params: str, extra: str = "") -> str:
    """SELECT of the factors, from a flows and a discountings relation."""
    part = f"core_id{', ' + extra if extra else ''}"
    frac = lambda d: f"(CASE WHEN day_count = 'actual/365' THEN ({d} - valuation_date) / 365.0::DOUBLE ELSE {sql_actual('valuation_date', d)} END)"
    return f"""SELECT *, CASE WHEN period_end <= valuation_date OR period_end > coalesce(terminal_date, DATE '9999-12-31') THEN 0.0::DOUBLE
        ELSE 1 / pow(1 + rate, CASE timing WHEN 'mid' THEN {frac('middle')} WHEN 'mid-year' THEN {frac('period_end')} - 0.5 ELSE {frac('period_end')} END) END AS factor
      FROM (SELECT *, (s + ((period_end - s) // 2)::INT)::DATE AS middle FROM (
        SELECT *, greatest(coalesce(lag(period_end) OVER (PARTITION BY {part} ORDER BY period_end) + 1, period_end - 90), valuation_date)::DATE AS s
        FROM {flows} JOIN {params} USING (core_id)))"""


_PV = f"{cte('flows', 'discountings')}, f AS ({sql_factors('flows', 'discountings')})"


@query("v1_yearfrac", f"""{cte('flows', 'discountings')}, d AS (SELECT core_id, period_end, least(period_end, valuation_date) AS a, greatest(period_end, valuation_date) AS b FROM flows JOIN discountings USING (core_id)),
    e AS (SELECT *, CASE WHEN month(a) = 2 AND a = last_day(a) THEN 30 ELSE day(a) END AS a1, CASE WHEN month(a) = 2 AND a = last_day(a) AND month(b) = 2 AND b = last_day(b) THEN 30 ELSE day(b) END AS b1 FROM d)
    SELECT core_id, period_end, round({sql_actual('a', 'b')}, 9) AS act_act, round((b - a) / 360.0::DOUBLE, 9) AS act_360, round((b - a) / 365.0::DOUBLE, 9) AS act_365,
    round(((year(b) - year(a)) * 360 + (month(b) - month(a)) * 30 + CASE WHEN b1 = 31 AND a1 >= 30 THEN 30 ELSE b1 END - least(a1, 30)) / 360.0::DOUBLE, 9) AS us_30,
    round(((year(b) - year(a)) * 360 + (month(b) - month(a)) * 30 + least(day(b), 30) - least(day(a), 30)) / 360.0::DOUBLE, 9) AS eu_30 FROM e""")
def v1_yearfrac(spark, sf):
    d = view(spark, sf, "flows").join(view(spark, sf, "discountings"), "core_id")
    a, b = F.col("valuation_date"), F.col("period_end")
    return d.select("core_id", "period_end", *[F.round(dates.yearfrac(a, b, k), 9).alias(n) for n, k in (("act_act", 1), ("act_360", 2), ("act_365", 3), ("us_30", 0), ("eu_30", 4))])


@query("v2_factors", f"{_PV} SELECT core_id, period_end, round(factor, 9) AS factor FROM f")
def v2_factors(spark, sf):
    return fin.factors(view(spark, sf, "flows"), view(spark, sf, "discountings")).select("core_id", "period_end", F.round("factor", 9).alias("factor"))


@query("v3_pv_by_deal", f"""{_PV} SELECT core_id, round(sum(cf * factor), 4) AS pv, count(*) FILTER (factor <> 0)::BIGINT AS periods, count(*) FILTER (period_end <= valuation_date)::BIGINT AS before,
    min(period_end) FILTER (factor <> 0) AS first_period, max(period_end) FILTER (factor <> 0) AS last_period, round(sum(cf) FILTER (factor <> 0), 4) AS undiscounted FROM f GROUP BY core_id""")
def v3_pv_by_deal(spark, sf):
    out = fin.dcf(view(spark, sf, "flows"), view(spark, sf, "discountings"))
    return out.withColumns({"pv": F.round("pv", 4), "undiscounted": F.round("undiscounted", 4)})


_COMBOS = "combos AS (SELECT * FROM (VALUES (0, 'end', 'actual/actual'), (1, 'end', 'actual/365'), (2, 'mid', 'actual/actual'), (3, 'mid', 'actual/365'), (4, 'mid-year', 'actual/actual'), (5, 'mid-year', 'actual/365')) c(combo, timing, day_count))"


@query("v4_fit_convention", f"""{_PV}, target AS (SELECT core_id, sum(cf * factor) AS target FROM f GROUP BY 1), {_COMBOS},
    p AS (SELECT core_id, rate, valuation_date, terminal_date, c.combo, c.timing, c.day_count FROM discountings, combos c), g AS ({sql_factors('flows', 'p', 'combo')}),
    v AS (SELECT core_id, combo, timing, day_count, sum(cf * factor) AS pv FROM g GROUP BY 1, 2, 3, 4),
    x AS (SELECT v.*, abs(pv - target) <= 1e-6 * greatest(1.0, abs(target)) AS exact FROM v JOIN target USING (core_id))
    SELECT core_id, timing, day_count, round(pv, 4) AS pv, exact FROM x QUALIFY row_number() OVER (PARTITION BY core_id ORDER BY exact DESC, combo) = 1""")
def v4_fit_convention(spark, sf):
    flows, d = view(spark, sf, "flows"), view(spark, sf, "discountings")
    target = fin.dcf(flows, d).select("core_id", "pv")
    return fin.fit_convention(flows, d, target).select("core_id", "timing", "day_count", F.round("pv", 4).alias("pv"), "exact")


@query("v6_sensitivity", f"""{cte('flows', 'discountings')}, p AS (SELECT d.* EXCLUDE (rate), rate + shift AS rate, shift FROM discountings d, (VALUES (-0.01::DOUBLE), (0.0::DOUBLE), (0.01::DOUBLE)) s(shift)),
    g AS ({sql_factors('flows', 'p', 'shift')}) SELECT core_id, shift, round(sum(cf * factor), 4) AS pv FROM g GROUP BY 1, 2""")
def v6_sensitivity(spark, sf):
    return fin.sensitivity(view(spark, sf, "flows"), view(spark, sf, "discountings")).withColumn("pv", F.round("pv", 4))


@query("v7_npv_xnpv", f"""{cte('flows', 'discountings')}, n AS (SELECT core_id, cf, rate, row_number() OVER w AS i, (period_end - min(period_end) OVER (PARTITION BY core_id)) / 365.0::DOUBLE AS t
    FROM flows JOIN discountings USING (core_id) WINDOW w AS (PARTITION BY core_id ORDER BY period_end))
    SELECT core_id, round(sum(cf / pow(1 + rate, i)), 4) AS npv, round(sum(cf / pow(1 + rate, t)), 4) AS xnpv FROM n GROUP BY 1""")
def v7_npv_xnpv(spark, sf):
    flows, d = view(spark, sf, "flows"), view(spark, sf, "discountings")
    return fin.npv(flows, d).join(fin.xnpv(flows, d), "core_id").select("core_id", F.round("npv", 4).alias("npv"), F.round("xnpv", 4).alias("xnpv"))


#: The root by halving ln(1 + r) between -20 and 20, a hundred times, on each core's flows as lists.
_V8 = f"""{cte('flows').replace('WITH ', 'WITH RECURSIVE ', 1)}, l AS (SELECT core_id, list(cf ORDER BY period_end) AS cf, list((period_end - d0) / 365.0::DOUBLE ORDER BY period_end) AS yr FROM (SELECT *, min(period_end) OVER (PARTITION BY core_id) AS d0 FROM flows) GROUP BY 1 HAVING min(cf) < 0 AND max(cf) > 0),
    k AS (SELECT core_id, 'irr' AS what, cf, list_transform(range(len(cf)), lambda i: i::DOUBLE) AS t FROM l UNION ALL SELECT core_id, 'xirr', cf, yr FROM l),
    h AS (SELECT core_id, what, cf, t, -20.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0 AS n FROM k UNION ALL
      SELECT core_id, what, cf, t, CASE WHEN v > 0 THEN mid ELSE lo END, CASE WHEN v > 0 THEN hi ELSE mid END, n + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(1, len(cf) + 1), lambda i: cf[i] * exp(-(lo + hi) / 2 * t[i]))) AS v FROM h WHERE n < 100)),
    r AS (SELECT core_id, max(exp(lo) - 1) FILTER (what = 'irr') AS irr, max(exp(lo) - 1) FILTER (what = 'xirr') AS xirr FROM h WHERE n = 100 GROUP BY 1)"""


@query("v8_irr", f"{_V8} SELECT core_id, CASE WHEN irr < 10 THEN round(irr, 6) END AS irr, CASE WHEN xirr < 10 THEN round(xirr, 6) END AS xirr FROM (SELECT DISTINCT core_id FROM flows) LEFT JOIN r USING (core_id)")
def v8_irr(spark, sf):
    """Rates by period and by date, up to 1,000 %, where the operator's bracket ends."""
    flows = view(spark, sf, "flows")
    out = fin.irr(flows).join(fin.irr(flows, dated=True).withColumnRenamed("irr", "xirr"), "core_id")
    return out.select("core_id", *[F.when(F.col(c) < 10, F.round(c, 6)).alias(c) for c in ("irr", "xirr")])


@query("v9_annuities", f"""{cte('discountings')} SELECT core_id, round(-(r * (pv * g + 1000)) / ((1 + r) * (g - 1)), 6) AS pmt, round(-(0 + 50 * (g - 1) / r) / g, 6) AS pv, round(-(100 * g + 50 * (1 + r) * (g - 1) / r), 6) AS fv
    FROM (SELECT core_id, rate AS r, pow(1 + rate, 10 + core_id % 20) AS g, 5000.0::DOUBLE AS pv FROM discountings)""")
def v9_annuities(spark, sf):
    r, n = F.col("rate"), F.lit(10) + F.col("core_id") % 20
    d = view(spark, sf, "discountings")
    return d.select("core_id", F.round(xl.pmt(r, n, F.lit(5000.0), 1000.0, 1), 6).alias("pmt"), F.round(xl.annuity_pv(r, n, F.lit(50.0)), 6).alias("pv"), F.round(xl.annuity_fv(r, n, F.lit(50.0), 100.0, 1), 6).alias("fv"))


@query("v19_cut_off", f"{cte('flows', 'discountings')} SELECT core_id, period_end, CASE WHEN period_end <= valuation_date THEN 0.0 ELSE cf END AS cf FROM flows JOIN discountings USING (core_id)")
def v19_cut_off(spark, sf):
    d = view(spark, sf, "discountings").withColumnRenamed("valuation_date", "new_date")
    return fin.cut_off(view(spark, sf, "flows"), d).select("core_id", "period_end", "cf")


@query("w9_cumulative_pv", f"""{_PV} SELECT core_id, period_end, CASE WHEN max(CASE WHEN factor <> 0 THEN 1 ELSE 0 END) OVER w = 1 THEN round(sum(cf * factor) OVER w, 4) END AS cumulative
    FROM f WINDOW w AS (PARTITION BY core_id ORDER BY period_end ROWS UNBOUNDED PRECEDING)""")
def w9_cumulative_pv(spark, sf):
    f = fin.factors(view(spark, sf, "flows"), view(spark, sf, "discountings"))
    return fin.cumulative_pv(f).select("core_id", "period_end", F.round("cumulative", 4).alias("cumulative"))


@query("w4_tail_zeros", f"""{cte('flows', 'discountings')}, z AS (SELECT core_id, period_end, CASE WHEN period_end > DATE '2000-12-31' AND core_id % 2 = 0 THEN 0.0 ELSE cf END AS cf, valuation_date FROM flows JOIN discountings USING (core_id)),
    a AS (SELECT * FROM z WHERE period_end > valuation_date), l AS (SELECT core_id, max(period_end) FILTER (cf <> 0) AS last FROM a GROUP BY 1)
    SELECT core_id, count(*) FILTER (period_end > last)::BIGINT AS tail FROM a JOIN l USING (core_id) GROUP BY 1""")
def w4_tail_zeros(spark, sf):
    flows = view(spark, sf, "flows").withColumn("cf", F.when((F.col("period_end") > "2000-12-31") & (F.col("core_id") % 2 == 0), 0.0).otherwise(F.col("cf")))
    return fin.tail_zeros(flows, view(spark, sf, "discountings").withColumnRenamed("valuation_date", "new_date"))


@query("x18_dates", """SELECT o_orderkey, (d + INTERVAL 5 MONTH)::DATE AS edate, last_day((d + INTERVAL 5 MONTH)::DATE) AS eomonth,
    CASE WHEN d = last_day(d) THEN last_day((d + INTERVAL 5 MONTH)::DATE) ELSE (d + INTERVAL 5 MONTH)::DATE END AS shifted,
    (datediff('month', d, DATE '2003-02-28') - CASE WHEN 28 < day(d) THEN 1 ELSE 0 END)::INT AS months, dayofweek(d)::INT + 1 AS weekday,
    (year(d) + CASE WHEN month(d) <= 6 THEN 0 ELSE 1 END)::INT AS fy, DATE '1899-12-30' + (o_orderkey % 60000)::INT AS serial
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def x18_dates(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    d = F.col("d")
    return o.select(
        "o_orderkey",
        dates.edate(d, 5).alias("edate"),
        dates.eomonth(d, 5).alias("eomonth"),
        dates.shift_keep_month_end(d, 5).alias("shifted"),
        dates.datedif(d, F.lit("2003-02-28").cast("date"), "M").alias("months"),
        dates.weekday(d).alias("weekday"),
        dates.fy_year(d, 6).alias("fy"),
        dates.from_serial(F.col("o_orderkey") % 60000).alias("serial"),
    )


@query("x19_scalars", """SELECT p_partkey, p_partkey - 7 - 12.5::DOUBLE * floor((p_partkey - 7) / 12.5::DOUBLE) AS mod, round(p_retailprice / 25.0, 0) * 25.0 AS mround,
    CASE WHEN (p_size - 25) / 4.0 >= 0 THEN floor((p_size - 25) / 4.0) ELSE ceil((p_size - 25) / 4.0) END::BIGINT AS quotient,
    nullif(instr(lower(p_name), 'ring'), 0)::INT AS search, concat_ws('-', nullif(p_brand, ''), nullif(p_type, 'ECONOMY')) AS textjoin,
    CASE p_size % 5 WHEN 1 THEN p_brand WHEN 2 THEN p_type WHEN 3 THEN p_name END AS chosen FROM part""")
def x19_scalars(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select(
        "p_partkey",
        xl.mod(F.col("p_partkey") - 7, F.lit(12.5)).alias("mod"),
        xl.mround(F.col("p_retailprice"), F.lit(25.0)).alias("mround"),
        xl.quotient(F.col("p_size") - 25, F.lit(4.0)).cast("long").alias("quotient"),
        xl.search(F.lit("RING"), F.col("p_name")).alias("search"),
        xl.textjoin("-", F.col("p_brand"), F.when(F.col("p_type") != "ECONOMY", F.col("p_type")).otherwise("")).alias("textjoin"),
        xl.choose(F.col("p_size") % 5, F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("chosen"),
    )
