"""More queries on values, matches, checks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.operators import checks, fin, match, value
from fleetroll.sources.adapters import cte, view
from fleetroll.streaming import jobs

from .q_finance import _PV, sql_factors
from .q_streams import drained, stream
from .registry import query

KEY = ["workbook_id", "sheet", "row_no"]
K = "workbook_id, sheet, row_no"


@query("v20_methods", f"""{cte('flows', 'discountings')}, m AS (SELECT * FROM (VALUES ('default', NULL, NULL, 0), ('mid-period', 'mid', NULL, 0), ('mid-year', 'mid-year', NULL, 0), ('other day count', NULL, 'actual/365', 0), ('on-date kept', NULL, NULL, 1)) v(method, t, dc, early)),
    p AS (SELECT core_id, rate, (valuation_date - early)::DATE AS valuation_date, coalesce(t, timing) AS timing, coalesce(dc, day_count) AS day_count, terminal_date, method FROM discountings, m), g AS ({sql_factors('flows', 'p', 'method')}),
    v AS (SELECT core_id, method, sum(cf * factor) AS pv FROM g GROUP BY 1, 2) SELECT core_id, method, round(pv, 4) AS pv, round(pv - max(pv) FILTER (method = 'default') OVER (PARTITION BY core_id), 3) AS effect FROM v""")
def v20(spark, sf):
    return value.methods(view(spark, sf, "flows"), view(spark, sf, "discountings")).select("core_id", "method", F.round("pv", 4).alias("pv"), F.round("effect", 3).alias("effect"))


_V20 = f"""{cte('flows', 'discountings')}, en AS (SELECT core_id, e AS "end", rate + x AS rate, valuation_date, timing, day_count, terminal_date FROM discountings, (VALUES ('low', 0.01), ('high', -0.005)) v(e, x)),
    fl AS (SELECT core_id, period_end, CASE WHEN month(period_end) = 12 AND core_id % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS flag FROM flows WHERE core_id % 3 < 2), md AS (SELECT core_id, avg(rate) AS mid FROM en GROUP BY 1),
    m AS (SELECT * FROM (VALUES (0, 'overlay'), (1, 'on date kept'), (2, 'own flags'), (3, 'recompute'), (4, 'mid-period'), (5, 'mid-year'), (6, 'other day count'), (7, 'mid rate')) v(i, method)),
    p AS (SELECT core_id, "end", i, method, CASE WHEN i = 7 THEN mid ELSE rate END AS rate, valuation_date, CASE i WHEN 4 THEN 'mid' WHEN 5 THEN 'mid-year' ELSE timing END AS timing, CASE WHEN i = 6 THEN CASE day_count WHEN 'actual/365' THEN 'actual/actual' ELSE 'actual/365' END ELSE day_count END AS day_count, CASE WHEN i <> 2 THEN terminal_date END AS terminal_date FROM en JOIN md USING (core_id), m),
    g AS ({sql_factors('flows', 'p', 'method, "end"')}),
    v AS (SELECT g.core_id, g.method, g."end", sum(CASE WHEN g.method = 'own flags' THEN CASE WHEN g.period_end > d.valuation_date THEN cf * factor * flag END WHEN g.method = 'on date kept' AND g.period_end = d.valuation_date THEN cf WHEN factor <> 0 THEN cf * factor END) AS v
      FROM g JOIN discountings d ON d.core_id = g.core_id LEFT JOIN fl ON fl.core_id = g.core_id AND fl.period_end = g.period_end GROUP BY 1, 2, 3),
    x AS (SELECT core_id, method, max(v) FILTER ("end" = 'low') AS lo, max(v) FILTER ("end" = 'high') AS hi FROM v WHERE v IS NOT NULL GROUP BY 1, 2), y AS (SELECT core_id, method, CASE WHEN method <> 'mid rate' THEN lo END AS low, (lo + hi) / 2 AS mid, CASE WHEN method <> 'mid rate' THEN hi END AS high FROM x),
    inv AS (SELECT y.*, y.low - b.low AS to_low, y.mid - b.mid AS to_mid, y.high - b.high AS to_high FROM y LEFT JOIN (FROM y WHERE method = 'overlay') b USING (core_id))"""


def _inventory(spark, sf):
    d, f, k = view(spark, sf, "discountings"), view(spark, sf, "flows"), F.col("core_id")
    e = F.explode(F.array(F.struct(F.lit("low").alias("end"), F.lit(0.01).alias("x")), F.struct(F.lit("high").alias("end"), F.lit(-0.005).alias("x"))))
    ends = d.withColumn("e", e).select("core_id", "e.end", (F.col("rate") + F.col("e.x")).alias("rate"), "valuation_date", "timing", "day_count", "terminal_date")
    flags = f.where(k % 3 < 2).select("core_id", "period_end", F.when((F.month("period_end") == 12) & (k % 2 == 0), 0.0).otherwise(1.0).alias("flag"))
    return value.inventory(f, ends, flags)


@query("v20_inventory", f"{_V20} SELECT core_id, method, round(low, 3) AS low, round(mid, 3) AS mid, round(high, 3) AS high, round(to_low, 3) + 0.0 AS to_low, round(to_mid, 3) + 0.0 AS to_mid, round(to_high, 3) + 0.0 AS to_high FROM inv")
def v20_inventory(spark, sf):
    out = _inventory(spark, sf)
    return out.select("core_id", "method", *[F.round(c, 3).alias(c) for c in ("low", "mid", "high")], *[(F.round(c, 3) + 0.0).alias(c) for c in ("to_low", "to_mid", "to_high")])


@query("v20_method_step", f"""{_V20}, w AS (SELECT core_id, ['mid rate', 'overlay', 'own flags', 'mid-year', 'none such'][(core_id % 5 + 1)::INT] AS method FROM discountings), s AS (SELECT core_id, e AS "end", 1000.0 + core_id AS ty FROM discountings, (VALUES ('low'), ('mid'), ('high')) v(e)),
    k AS (SELECT core_id, unnest(['low', 'mid', 'high']) AS "end", unnest([to_low, to_mid, to_high]) AS mv FROM inv SEMI JOIN w USING (core_id, method) WHERE method <> 'overlay')
    SELECT core_id, "end", round(coalesce(mv, 0), 3) + 0.0 AS step, round(ty + coalesce(mv, 0), 3) AS this_year FROM s LEFT JOIN k USING (core_id, "end")""")
def v20_step(spark, sf):
    k = F.col("core_id")
    d = view(spark, sf, "discountings")
    want = d.select("core_id", F.get(F.array(*map(F.lit, ("mid rate", "overlay", "own flags", "mid-year", "none such"))), (k % 5).cast("int")).alias("method"))
    values = d.select("core_id", F.explode(F.array(*map(F.lit, ("low", "mid", "high")))).alias("end"), (1000.0 + k).alias("this_year"))
    return value.method_step(values, _inventory(spark, sf), want).select("core_id", "end", (F.round("step", 3) + 0.0).alias("step"), F.round("this_year", 3).alias("this_year"))


_OV = "o AS (SELECT core_id, CASE WHEN core_id % 3 = 0 THEN 0.09::DOUBLE END AS nr, CASE WHEN core_id % 4 = 0 THEN 'end' END AS nt, CASE WHEN core_id % 5 = 0 THEN DATE '1998-06-30' END AS nd FROM discountings WHERE core_id % 2 = 0)"


@query("v25_scenario", f"""{_PV}, {_OV}, p AS (SELECT core_id, coalesce(nr, rate) AS rate, coalesce(nd, valuation_date) AS valuation_date, coalesce(nt, timing) AS timing, day_count, terminal_date FROM discountings LEFT JOIN o USING (core_id)), g AS ({sql_factors('flows', 'p')})
    SELECT a.core_id, round(model, 4) AS model, round(scenario, 4) AS scenario, concat_ws(',', CASE WHEN nr <> rate THEN 'rate' END, CASE WHEN nd <> valuation_date THEN 'date' END, CASE WHEN nt <> timing THEN 'timing' END) AS changed
    FROM (SELECT core_id, sum(cf * factor) AS model FROM f GROUP BY 1) a JOIN (SELECT core_id, sum(cf * factor) AS scenario FROM g GROUP BY 1) b USING (core_id) JOIN discountings d USING (core_id) LEFT JOIN o USING (core_id)""")
def v25(spark, sf):
    d = view(spark, sf, "discountings")
    c = F.col("core_id")
    o = d.where(c % 2 == 0).select("core_id", F.when(c % 3 == 0, 0.09).alias("new_rate"), F.when(c % 4 == 0, "end").alias("new_timing"), F.when(c % 5 == 0, F.lit("1998-06-30").cast("date")).alias("new_date"))
    return value.scenario(view(spark, sf, "flows"), d, o).select("core_id", F.round("model", 4).alias("model"), F.round("scenario", 4).alias("scenario"), "changed")


@query("v25_full_scenario", f"""{_PV}, o AS (SELECT core_id, CASE core_id % 3 WHEN 0 THEN 'actual/365' WHEN 1 THEN 'actual/actual' END AS nd, CASE core_id % 5 WHEN 0 THEN '' WHEN 1 THEN '1999-12-31' WHEN 2 THEN '2000-06-30' END AS nc FROM discountings),
    p AS (SELECT core_id, rate, valuation_date, timing, coalesce(nd, day_count) AS day_count, CASE WHEN nc IS NULL THEN terminal_date WHEN nc <> '' THEN nc::DATE END AS terminal_date FROM discountings JOIN o USING (core_id)), g AS ({sql_factors('flows', 'p')}),
    b AS (SELECT core_id, 1000.0 + core_id % 10 - 250 AS al, CASE WHEN core_id % 4 = 1 THEN 0 ELSE 1000.0 + core_id % 10 END + CASE WHEN core_id % 6 = 1 THEN 0 ELSE -250 END AS kept, concat_ws(',', CASE WHEN core_id % 4 = 1 THEN 'without cash' END, CASE WHEN core_id % 6 = 1 THEN 'without net debt' END) AS w FROM discountings)
    SELECT x.core_id, round(model, 4) AS model, round(scenario, 4) AS scenario, round(model + al, 4) AS model_total, round(scenario + kept, 4) AS scenario_total,
      concat_ws(',', CASE WHEN p.day_count <> d.day_count THEN 'day count' END, CASE WHEN p.terminal_date IS DISTINCT FROM d.terminal_date THEN 'cut-off' END, nullif(w, '')) AS changed
    FROM (SELECT core_id, sum(cf * factor) AS model FROM f GROUP BY 1) x JOIN (SELECT core_id, sum(cf * factor) AS scenario FROM g GROUP BY 1) y USING (core_id) JOIN p USING (core_id) JOIN discountings d USING (core_id) JOIN b USING (core_id)""")
def v25_full(spark, sf):
    """Another day count, another cut-off or none, and bridge items left out."""
    d, c = view(spark, sf, "discountings"), F.col("core_id")
    o = d.select("core_id", F.when(c % 3 == 0, "actual/365").when(c % 3 == 1, "actual/actual").alias("new_day_count"), F.when(c % 5 == 0, "").when(c % 5 == 1, "1999-12-31").when(c % 5 == 2, "2000-06-30").alias("new_cutoff"))
    b = d.select("core_id", F.explode(F.array(F.struct(F.lit("cash").alias("item"), (1000.0 + c % 10).alias("amount")), F.struct(F.lit("net debt").alias("item"), F.lit(-250.0).alias("amount")))).alias("x")).select("core_id", "x.*")
    gone = d.where(c % 4 == 1).select("core_id", F.lit("cash").alias("item")).union(d.where(c % 6 == 1).select("core_id", F.lit("net debt")))
    out = value.scenario(view(spark, sf, "flows"), d, o, b, gone)
    return out.select("core_id", *[F.round(x, 4).alias(x) for x in ("model", "scenario", "model_total", "scenario_total")], "changed")


@query("v5_fit_factors")
def v5(spark, sf):
    """The factors of V2 read back; its test holds the result against the parameters they were made with."""
    from pyspark.sql import Window

    d = view(spark, sf, "discountings").withColumn("terminal_date", F.lit(None).cast("date"))
    start = F.coalesce(F.date_add(F.lag("period_end").over(Window.partitionBy("core_id").orderBy("period_end")), 1), F.date_sub("period_end", 90))
    f = fin.factors(view(spark, sf, "flows"), d).withColumn("start", start)
    c = d.select("core_id", F.explode(F.array(F.col("valuation_date"), F.add_months("valuation_date", 6), F.add_months("valuation_date", -6))).alias("date"))
    return value.fit_factors(f.select("core_id", "period_end", "start", "factor"), c).select("core_id", "date", "timing", "day_count", F.round("rate", 6).alias("rate"))


_V10 = f"""{cte('discountings')}, d AS (SELECT core_id, rate AS r, 0.011 + core_id % 4 * 0.005 AS g, 100.0 + core_id AS x FROM discountings), c AS (SELECT core_id, unnest(['x', 'r', 'g', 'other', 'share', 'nil', 'm', 'n']) AS cell, unnest([x, r, g, 7.5, 0.5, 0.0, 8.25 + core_id % 5, x / 4]) AS value, unnest(['Cash flow', 'Rate', 'Growth', 'Other', 'Share', '', 'Exit multiple', 'Capacity']) AS label FROM d),
    t AS (SELECT core_id, CASE core_id % 5 WHEN 0 THEN x * (1 + g) / (r - g) WHEN 1 THEN x / (r - g) WHEN 2 THEN x * (8.25 + core_id % 5) WHEN 3 THEN x * 7.5 ELSE x / r * 1.001 END AS tv FROM d)"""


@query("v10_fit_terminal", f"""{_V10}, j AS (SELECT t.core_id, tv, a.cell AS x_cell, a.value AS x, b.cell AS r_cell, b.value AS r, e.cell AS g_cell, e.value AS g FROM t JOIN c a USING (core_id) JOIN c b USING (core_id) JOIN c e USING (core_id) WHERE a.value <> 0 AND b.value >= 0 AND b.value < 0.3 AND e.value >= 0 AND e.value < 0.3 AND e.value < b.value AND e.cell <> b.cell AND a.cell <> b.cell AND a.cell <> e.cell),
    k AS (SELECT *, CASE WHEN abs(x / (r - g) - tv) <= 1e-6 * greatest(1, abs(tv)) THEN 'flat' WHEN abs(x * (1 + g) / (r - g) - tv) <= 1e-6 * greatest(1, abs(tv)) THEN 'grown' END AS form FROM j),
    m AS (SELECT t.core_id, a.cell AS x_cell, b.cell AS m_cell, b.value AS m, NOT regexp_matches(b.label, '(?i)multiple|exit|ev *\\/|\\bx\\b|times') AS u FROM t JOIN c a USING (core_id) JOIN c b USING (core_id) WHERE a.cell <> b.cell AND b.value > 0 AND b.value < 100 AND abs(a.value * b.value - tv) <= 1e-6 * greatest(1, abs(tv))),
    o AS (SELECT core_id, 0 AS l, form, false AS u, NULL AS m, NULL AS m_cell, x_cell, r_cell, g_cell FROM k WHERE form IS NOT NULL UNION ALL SELECT core_id, 1, 'multiple', u, m, m_cell, x_cell, NULL, NULL FROM m)
    SELECT core_id, form, x_cell, r_cell, g_cell, m_cell FROM o QUALIFY row_number() OVER (PARTITION BY core_id ORDER BY l, form, u, m, m_cell, x_cell, r_cell, g_cell) = 1""")
def v10(spark, sf):
    """Growing and flat perpetuities, multiples with a name and without, and values that nothing makes."""
    k = F.col("core_id")
    d = view(spark, sf, "discountings").select("core_id", F.col("rate").alias("r"), (0.011 + k % 4 * 0.005).alias("g"), (100.0 + k).alias("x"), (8.25 + k % 5).alias("m"))
    names = [("x", F.col("x"), "Cash flow"), ("r", F.col("r"), "Rate"), ("g", F.col("g"), "Growth"), ("other", F.lit(7.5), "Other"), ("share", F.lit(0.5), "Share"), ("nil", F.lit(0.0), ""), ("m", F.col("m"), "Exit multiple"), ("n", F.col("x") / 4, "Capacity")]
    cells = d.select("core_id", F.explode(F.array(*[F.struct(F.lit(n).alias("cell"), v.alias("value"), F.lit(l).alias("label")) for n, v, l in names])).alias("c")).select("core_id", "c.*")
    gap = F.col("r") - F.col("g")
    tv = F.when(k % 5 == 0, F.col("x") * (1 + F.col("g")) / gap).when(k % 5 == 1, F.col("x") / gap).when(k % 5 == 2, F.col("x") * F.col("m")).when(k % 5 == 3, F.col("x") * 7.5).otherwise(F.col("x") / F.col("r") * 1.001)
    return value.fit_terminal(cells, d.select("core_id", tv.alias("tv")))


@query("v17_time_check", f"""{_PV}, k AS (SELECT * REPLACE ((valuation_date + INTERVAL 12 MONTH)::DATE AS valuation_date, CASE core_id % 4 WHEN 1 THEN rate + 0.002 WHEN 2 THEN rate + 0.004 ELSE rate END AS rate) FROM discountings), g AS ({sql_factors('flows', 'k')}),
    a AS (SELECT core_id, printf('%.8e', cf) AS amount, row_number() OVER (PARTITION BY core_id, printf('%.8e', cf) ORDER BY period_end) AS n, cf * factor AS pa FROM f WHERE cf <> 0 AND factor <> 0),
    b AS (SELECT core_id, printf('%.8e', cf * 1.0000000000001) AS amount, row_number() OVER (PARTITION BY core_id, printf('%.8e', cf * 1.0000000000001) ORDER BY period_end) AS n, cf * 1.0000000000001 * factor AS pb FROM g WHERE cf <> 0 AND factor <> 0),
    s AS (SELECT core_id, sum(pa) AS pa, sum(pb) AS pb, count(*)::BIGINT AS matched FROM a JOIN b USING (core_id, amount, n) GROUP BY 1), i AS (SELECT *, CASE WHEN pa / pb > 0 THEN pb / pa - 1 END AS implied FROM s)
    SELECT core_id, round(pa, 4) AS pa, round(pb, 4) AS pb, matched, round(implied, 9) AS implied, round(implied - rate, 9) AS "off", CASE WHEN abs(implied - rate) > 0.015 THEN 'hold' WHEN abs(implied - rate) > 0.005 THEN 'check' WHEN implied IS NOT NULL THEN 'ok' END AS finding FROM i JOIN discountings USING (core_id)""")
def v17(spark, sf):
    """The second run's amounts differ from the ninth digit on, and some of its discountings move by another rate."""
    flows, d = view(spark, sf, "flows"), view(spark, sf, "discountings")
    later = d.withColumns({"valuation_date": F.add_months("valuation_date", 12), "rate": F.col("rate") + F.when(F.col("core_id") % 4 == 1, 0.002).when(F.col("core_id") % 4 == 2, 0.004).otherwise(0.0)})
    out = value.time_check(fin.factors(flows, d), fin.factors(flows.withColumn("cf", F.col("cf") * 1.0000000000001), later), d, 1.0)
    return out.select("core_id", F.round("pa", 4).alias("pa"), F.round("pb", 4).alias("pb"), "matched", F.round("implied", 9).alias("implied"), F.round("off", 9).alias("off"), "finding")


@query("v18_zero_roll", """SELECT c_custkey, round(1 + c_acctbal / 20000, 9) AS ratio, CASE WHEN NOT 1 + c_acctbal / 20000 BETWEEN 0.75 AND 1.33 THEN 'off' WHEN NOT 1 + c_acctbal / 20000 BETWEEN 0.87 AND 1.15 THEN 'confirm' ELSE 'ok' END AS verdict FROM customer""")
def v18(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", (1 + F.col("c_acctbal") / 20000).alias("at_last"), F.lit(1.0).alias("last"))
    return value.zero_roll(c).select("c_custkey", F.round("ratio", 9).alias("ratio"), "verdict")


@query("v22_roll_months", f"""{cte('series')}, a AS (SELECT workbook_id, sheet, min(period_end) AS a FROM series GROUP BY 1, 2), b AS (SELECT workbook_id, sheet, min(last_day((period_end + to_months((CASE WHEN sheet = 'R' THEN 6 ELSE 12 END)::INT))::DATE)) AS b FROM series GROUP BY 1, 2),
    m AS (SELECT workbook_id, ((year(b) - year(a)) * 12 + month(b) - month(a))::INT AS months FROM a JOIN b USING (workbook_id, sheet)), n AS (SELECT workbook_id, months, count(*)::BIGINT AS sheets FROM m WHERE months BETWEEN 1 AND 24 GROUP BY 1, 2)
    SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY sheets DESC, months) = 1""")
def v22(spark, sf):
    s = view(spark, sf, "series")
    later = s.withColumn("period_end", F.last_day(F.add_months("period_end", F.when(F.col("sheet") == "R", 6).otherwise(12))))
    return value.roll_months(s, later)


@query("v23_conclusion", """SELECT o_orderkey AS engagement_id, CASE WHEN o_orderkey % 7 >= 3 * greatest(o_orderkey % 3, 1) THEN 'cum' ELSE 'ex' END AS basis, least(o_totalprice, 250000) AS low, (o_totalprice + 250000) / 2 AS mid, greatest(o_totalprice, 250000) AS high FROM orders""")
def v23(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return value.conclusion(o.select(F.col("o_orderkey").alias("engagement_id"), F.col("o_totalprice").alias("low"), F.lit(250000.0).alias("high"), (F.col("o_orderkey") % 7).alias("cum_mentions"), (F.col("o_orderkey") % 3).alias("ex_mentions")))


@query("v28_forecast_end", f"""{cte('flows')}, g AS (SELECT core_id, max(period_end) FILTER (core_id % 2 = 0 OR period_end < DATE '2000-01-01') AS last_end, max(period_end) AS this_end FROM flows WHERE cf <> 0 GROUP BY 1) SELECT core_id, last_end, this_end, datediff('month', last_end, this_end)::INT AS months FROM g""")
def v28(spark, sf):
    f = view(spark, sf, "flows")
    return value.forecast_end(f.where("core_id % 2 = 0 or period_end < '2000-01-01'").withColumn("feed", F.lit("last")).union(f.withColumn("feed", F.lit("this"))))


@query("v28_moved_ends", f"""{cte('flows')}, g AS (SELECT core_id, max(period_end) FILTER (core_id % 2 = 0 OR period_end < DATE '2000-01-01') AS was, max(period_end) AS now FROM flows WHERE cf <> 0 GROUP BY 1),
    c AS (SELECT core_id, 'F' || core_id AS cell, CASE WHEN core_id % 7 = 3 THEN (was + 1)::DATE ELSE was END AS d, ['Forecast end', 'Horizon', 'Last cash flow', 'Concession expiry'][(core_id % 4 + 1)::INT] AS label, core_id % 9 = 5 AS f, core_id % 11 = 1 AS rolled FROM g)
    SELECT core_id, cell, was, now FROM c JOIN g USING (core_id) WHERE d = was AND was <> now AND NOT f AND NOT rolled AND label <> 'Last cash flow'""")
def v28_ends(spark, sf):
    """Dates typed on the overlay's sheets, some formulas, some labelled as something else, some a day off."""
    f = view(spark, sf, "flows")
    e = value.forecast_end(f.where("core_id % 2 = 0 or period_end < '2000-01-01'").withColumn("feed", F.lit("last")).union(f.withColumn("feed", F.lit("this"))))
    k = F.col("core_id")
    label = F.get(F.array(*map(F.lit, ("Forecast end", "Horizon", "Last cash flow", "Concession expiry"))), (k % 4).cast("int"))
    c = e.select("core_id", F.concat(F.lit("F"), k.cast("string")).alias("cell"), F.date_add("last_end", F.when(k % 7 == 3, 1).otherwise(0)).alias("date"), label.alias("label"), F.when(k % 9 == 5, "A1").alias("formula"), (k % 11 == 1).alias("rolled"))
    return value.moved_ends(e, c)


@query("j24_balances", f"""{cte('series', 'series_now').replace(' AS (SELECT', ' AS MATERIALIZED (SELECT')}, r AS (SELECT {K}, period_end, last_day((period_end + INTERVAL 12 MONTH)::DATE) AS to_end FROM series)
    SELECT r.*, p.value AS forecast, c.value AS actual, CASE WHEN c.value IS NULL THEN 'missing' WHEN p.value IS NULL THEN 'no forecast' WHEN abs(c.value - p.value) / abs(p.value) >= 0.5 THEN 'block' WHEN abs(c.value - p.value) / abs(p.value) >= 0.03 THEN 'check' ELSE 'ok' END AS status
    FROM r LEFT JOIN series p ON p.workbook_id = r.workbook_id AND p.sheet = r.sheet AND p.row_no = r.row_no AND p.period_end = to_end LEFT JOIN series_now c ON c.workbook_id = r.workbook_id AND c.sheet = r.sheet AND c.row_no = r.row_no AND c.period_end = to_end""")
def j24(spark, sf):
    p = view(spark, sf, "series")
    r = p.select(*KEY, "period_end")
    return match.balances(r, p, view(spark, sf, "series_now"), 12, check_at=0.03)


_NAMES = "CASE o_orderkey % 4 WHEN 0 THEN 'Model_v' || o_orderkey % 9 || '_' || strftime(o_orderdate, '%Y%m%d') || ' Client.xlsx' WHEN 1 THEN 'Toll road ' || strftime(o_orderdate, '%b-%y') || ' v' || o_orderkey % 5 || '.xlsm' WHEN 2 THEN 'Report FY' || strftime(o_orderdate, '%y') || '.pdf' ELSE 'Final model.xlsx' END"


def _files(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    n = (
        F.when(k % 4 == 0, F.concat(F.lit("Model_v"), (k % 9).cast("string"), F.lit("_"), F.date_format(d, "yyyyMMdd"), F.lit(" Client.xlsx")))
        .when(k % 4 == 1, F.concat(F.lit("Toll road "), F.date_format(d, "MMM-yy"), F.lit(" v"), (k % 5).cast("string"), F.lit(".xlsm")))
        .when(k % 4 == 2, F.concat(F.lit("Report FY"), F.date_format(d, "yy"), F.lit(".pdf")))
        .otherwise("Final model.xlsx")
    )
    return match.file_keys(spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("id"), F.col("o_custkey").alias("client"), n.alias("filename")))


_J29 = f"""f AS (SELECT o_orderkey AS id, o_custkey AS client, {_NAMES} AS n, o_orderdate::DATE AS d FROM orders), k AS (SELECT id, client, CASE id % 4 WHEN 0 THEN 'model client' WHEN 1 THEN 'toll road' WHEN 2 THEN 'report' ELSE 'final model' END AS family, CASE id % 4 WHEN 0 THEN (id % 9)::INT WHEN 1 THEN (id % 5)::INT END AS version,
    CASE id % 4 WHEN 0 THEN d WHEN 1 THEN last_day(make_date(2000 + year(d) % 100, month(d), 1)) WHEN 2 THEN make_date(2000 + year(d) % 100, 6, 30) END AS file_date FROM f)"""


@query("j29_file_keys", f"WITH {_J29} SELECT id, family, version, file_date FROM k")
def j29(spark, sf):
    return _files(spark, sf).select("id", "family", "version", "file_date")


@query("j29_same_period", f"WITH {_J29} SELECT a.client, a.family, a.id AS a, b.id AS b FROM k a JOIN k b USING (client, family) WHERE a.id < b.id AND abs(a.file_date - b.file_date) <= 120")
def j29_same(spark, sf):
    return match.same_period(_files(spark, sf))


@query("c1_acknowledgements", """WITH f AS (SELECT o_orderkey AS id, o_totalprice AS v, o_orderpriority AS p FROM orders), a AS (SELECT id, v * CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1.0000000001 ELSE 1.01 END AS w, CASE WHEN id % 5 = 0 THEN 'other' ELSE p END AS q FROM f WHERE id % 3 > 0),
    s AS (SELECT f.id, v, p, w, q, floor(log10(abs(v))) AS e, floor(log10(abs(w))) AS g FROM f LEFT JOIN a USING (id)) SELECT id, CASE WHEN w IS NULL THEN 'open' WHEN p = q AND e = g AND round(v / pow(10, e - 5)) = round(w / pow(10, g - 5)) THEN 'acknowledged' ELSE 'lapsed' END AS status FROM s""")
def c1(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("p"))
    key = lambda v, p: checks.fingerprint(F.array(v, F.lit(0.0), F.lit(12.5)), p)
    w = F.col("v") * F.when(F.col("id") % 4 == 0, 1.0).when(F.col("id") % 4 == 1, 1.0000000001).otherwise(1.01)
    a = o.where("id % 3 > 0").select("id", key(w, F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("p"))).alias("ack_key"))
    return checks.apply_acks(o.select("id", key(F.col("v"), F.col("p")).alias("key")), a).select("id", "status")


_TS = "SELECT id, ts::TIMESTAMP AS ts, model, session_id, tokens FROM calls"


@query("r1_budget", f"""{cte('calls')}, c AS ({_TS}), w AS (SELECT model, tokens, to_timestamp(floor(epoch(ts) / 5) * 5 - 5 * i)::TIMESTAMP AS start FROM c, range(12) r(i)), m AS (SELECT max(ts) AS m FROM c),
    g AS (SELECT model, start, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS calls FROM w GROUP BY 1, 2), l AS (SELECT * FROM (VALUES ('view', 20000, 3), ('click', 10000, 2)) v(model, tl, cl))
    SELECT model, start, tokens, calls, coalesce(tokens > tl * 0.9 OR calls > cl * 0.9, false) AS over FROM g LEFT JOIN l USING (model), m WHERE start + INTERVAL 60 SECOND <= date_trunc('millisecond', m) - INTERVAL 2 MINUTE""")
def r1(spark, sf):
    """A minute's tokens every five seconds: the windows that the watermark has closed."""
    limits = spark.createDataFrame([("view", 20000, 3), ("click", 10000, 2)], "model string, token_limit long, call_limit long")
    return drained(spark, jobs.budget(stream(spark, sf, "calls").withColumn("ts", F.col("ts").cast("timestamp")), limits))


@query("r3_sessions", f"""{cte('calls')}, c AS ({_TS}), n AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, id) > INTERVAL 30 MINUTE, true) AS nw FROM c), s AS (SELECT *, sum(nw::INT) OVER (PARTITION BY session_id ORDER BY ts, id) AS k FROM n)
    SELECT session_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens FROM s GROUP BY session_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM c) - INTERVAL 30 MINUTE""")
def r3(spark, sf):
    return drained(spark, jobs.sessions(stream(spark, sf, "calls").withColumn("ts", F.col("ts").cast("timestamp"))))


@query("r4_stage_durations", f"""{cte('runlog')}, e AS (SELECT id, "at"::TIMESTAMP AS t, engagement_id, stage, event FROM runlog), r AS (SELECT * FROM e WHERE event IN ('start', 'end', 'failed')), l AS (SELECT *, lag(event) OVER w AS be, lag(t) OVER w AS bt, lead(event) OVER w AS ne FROM r WINDOW w AS (PARTITION BY engagement_id, stage ORDER BY t, id))
    SELECT engagement_id, stage, bt AS started, epoch_us(t) - epoch_us(bt) AS micros, 'done' AS status FROM l WHERE event = 'end' AND be = 'start'
    UNION ALL SELECT engagement_id, stage, t, NULL, 'stuck' FROM l WHERE event = 'start' AND ne IS NULL AND epoch_ms(t) + 3600000 < (SELECT max(epoch_ms(t)) FROM e) - 600000""")
def r4(spark, sf):
    return drained(spark, jobs.stage_durations(stream(spark, sf, "runlog").withColumn("at", F.col("at").cast("timestamp"))))


@query("r5_dedup_files", f"{cte('calls')} SELECT DISTINCT md5(concat(session_id, '-', model)) AS sha256 FROM calls")
def r5(spark, sf):
    return drained(spark, jobs.dedup_files(_uploads(spark, sf))).select("sha256")


def _uploads(spark, sf):
    return stream(spark, sf, "calls").select("id", F.md5(F.concat(F.col("session_id").cast("string"), F.lit("-"), "model")).alias("sha256"), F.col("ts").cast("timestamp").alias("uploaded_at"))


@query("r5_ingest_files", f"{cte('calls')} SELECT md5(concat(session_id, '-', model)) AS sha256, arg_min(id, struct_pack(t := ts::TIMESTAMP, i := id)) AS id FROM calls GROUP BY 1")
def r5_ingest(spark, sf):
    """The stream in two runs, the second with all of the first again: every file is taken once."""
    import uuid

    from fleetroll.sources.tables import shared_dir

    at = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    for run in (1, 2):
        put = jobs.ingest_files(f"{at}/table")
        q = _uploads(spark, sf).writeStream.option("checkpointLocation", f"{at}/state-{run}").trigger(availableNow=True).foreachBatch(lambda b, n, put=put, run=run: put(b, 1000 * run + n)).start()
        q.awaitTermination()
    return jobs.known_files(spark, f"{at}/table").select("sha256", "id")


@query("r6_upsert_decisions", f"""{cte('calls')} SELECT concat('k', session_id) AS key, arg_max(model, struct_pack(p := id % 5 = 0, t := ts::TIMESTAMP, i := id)) AS value FROM calls GROUP BY 1""")
def r6(spark, sf):
    import uuid

    from fleetroll.sources.tables import shared_dir

    at = f"{shared_dir(spark)}/decisions-{uuid.uuid4().hex}"
    s = stream(spark, sf, "calls").select("id", F.concat(F.lit("k"), F.col("session_id").cast("string")).alias("key"), F.col("model").alias("value"), F.col("ts").cast("timestamp").alias("at"), (F.col("id") % 5 == 0).alias("is_person"))
    q = s.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(jobs.upsert_decisions(f"{at}/table")).start()
    q.awaitTermination()
    return jobs.current_decisions(spark, f"{at}/table").select("key", "value")


@query("s1_load_tables", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def s1(spark, sf):
    from pyspark.sql.types import StructField, StructType

    from fleetroll.sources.tables import load_tables

    kinds = {f.name: f.dataType for t in ("nation", "region") for f in spark.read.parquet(f"{sf}/{t}.parquet").schema}
    t = load_tables(spark, sf, {f"{n}.parquet": StructType([StructField(c, kinds[c]) for c in cols]) for n, cols in (("nation", ["n_name", "n_regionkey"]), ("region", ["r_regionkey", "r_name"]))})
    return t["nation.parquet"].join(t["region.parquet"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("s2_read_log", "SELECT event_id AS id, user_id AS session_id, event_type AS model FROM events WHERE event_id % 10 <> 3")
def s2(spark, sf):
    import uuid

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from fleetroll.sources.tables import read_log, shared_dir

    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("model"))
    e.select(F.when(F.col("id") % 10 == 3, F.lit('{"id": 3, cut')).otherwise(F.to_json(F.struct("id", "session_id", "model")))).write.text(path)
    return read_log(spark, path, StructType([StructField("id", LongType()), StructField("session_id", LongType()), StructField("model", StringType())]))


@query("f4_selectors", """WITH r AS (SELECT p_partkey // 50 AS workbook_id, p_partkey % 50 + 1 AS row_no, CASE p_size % 4 WHEN 0 THEN 'Scenario switch' WHEN 1 THEN 'Case selected' WHEN 2 THEN 'Scenario cost' ELSE 'Revenue' END AS label, CASE WHEN p_size % 4 = 2 THEN '$m' ELSE '' END AS units FROM part),
    c AS (SELECT p_partkey // 50 AS workbook_id, p_partkey % 50 + 1 AS row_no, k AS col, CASE WHEN k < p_size % 5 THEN CASE WHEN k = 0 THEN p_retailprice ELSE (p_size % 30) END END AS value, CASE WHEN p_size % 5 = 0 AND k = 1 THEN 'Base' END AS text, CASE WHEN p_size % 9 = 1 THEN 'f' END AS formula FROM part, (VALUES (0), (1), (2)) v(k)),
    t AS (SELECT * FROM c SEMI JOIN (SELECT * FROM r WHERE regexp_matches(label, '(?i)scenario|case|switch|select') AND NOT regexp_matches(units, '[$€£]|%')) x USING (workbook_id, row_no) WHERE formula IS NULL AND row_no % 6 <> 0),
    g AS (SELECT workbook_id, row_no, count(value) AS n, arg_min(value, col) FILTER (value = floor(value) AND value BETWEEN 0 AND 20) AS v, count(text) AS k, min(text) AS t FROM t GROUP BY 1, 2)
    SELECT workbook_id, row_no, label, coalesce(v::INT::VARCHAR, CASE WHEN k = 1 AND length(g.t) <= 20 THEN g.t END) AS setting FROM g JOIN r USING (workbook_id, row_no) WHERE n <= 2 AND coalesce(v::INT::VARCHAR, CASE WHEN k = 1 AND length(g.t) <= 20 THEN g.t END) IS NOT NULL""")
def f4(spark, sf):
    from fleetroll.operators import cells

    p = spark.read.parquet(f"{sf}/part.parquet").withColumns({"workbook_id": F.floor(F.col("p_partkey") / 50), "row_no": F.col("p_partkey") % 50 + 1})
    z = F.col("p_size")
    rows = p.select("workbook_id", "row_no", F.when(z % 4 == 0, "Scenario switch").when(z % 4 == 1, "Case selected").when(z % 4 == 2, "Scenario cost").otherwise("Revenue").alias("label"), F.when(z % 4 == 2, "$m").otherwise("").alias("units"))
    k = p.withColumn("col", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    c = k.select("workbook_id", "row_no", "col", F.when(F.col("col") < z % 5, F.when(F.col("col") == 0, F.col("p_retailprice")).otherwise((z % 30).cast("double"))).alias("value"), F.when((z % 5 == 0) & (F.col("col") == 1), "Base").alias("text"), F.when(z % 9 == 1, "f").alias("formula"))
    return cells.selectors(rows, c, p.where("row_no % 6 <> 0").select("workbook_id", F.col("row_no").alias("dst")))


@query("j21_chain", f"""{cte('model_points')}, o AS (SELECT p_partkey AS overlay_row, (p_partkey * 7) % 2000 AS client_row FROM part WHERE p_size % 2 = 0), m AS (SELECT DISTINCT (p_partkey * 7) % 2000 AS client_row, (p_partkey * 7) % 2000 AS cur_row FROM part WHERE p_size % 3 > 0),
    s AS (SELECT workbook_id * 50 + row_no - 1 AS cur_row, period_end, value FROM model_points), v AS (SELECT overlay_row, client_row, cur_row, period_end, value FROM o JOIN m USING (client_row) JOIN s USING (cur_row) QUALIFY row_number() OVER (PARTITION BY overlay_row, client_row, cur_row ORDER BY period_end) <= 3)
    SELECT overlay_row, client_row, cur_row, round(sum(value), 4) AS total, count(*)::INT AS n FROM v GROUP BY 1, 2, 3""")
def j21(spark, sf):
    from fleetroll.operators import cells

    p = spark.read.parquet(f"{sf}/part.parquet")
    client = ((F.col("p_partkey") * 7) % 2000).alias("client_row")
    s = view(spark, sf, "model_points").select((F.col("workbook_id") * 50 + F.col("row_no") - 1).alias("row"), "period_end", "value")
    out = cells.chain(p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("overlay_row"), client), p.where("p_size % 3 > 0").select(client, ((F.col("p_partkey") * 7) % 2000).alias("cur_row")).distinct(), s)
    v = F.transform(F.split("first_values", "\\|"), lambda x: x.cast("double"))
    return out.select("overlay_row", "client_row", "cur_row", F.round(F.aggregate(v, F.lit(0.0), lambda a, b: a + b), 4).alias("total"), F.size(v).alias("n"))


@query("v27_source_rate", """WITH r AS (SELECT c_custkey AS core_id, 0.05 + c_custkey % 7 * 0.01 AS rate FROM customer), x AS (SELECT o_custkey AS core_id, concat('c', o_orderkey % 5) AS cell, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'last' END AS walk, 0.05 + o_custkey % 7 * 0.01 + CASE WHEN o_orderkey % 5 = 3 THEN 0.001 ELSE 0 END AS value, o_orderkey % 5 < 2 AS f, o_orderkey % 4 AS depth FROM orders),
    g AS (SELECT core_id, cell, max(f::INT) AS f, min(depth) AS depth FROM x JOIN r USING (core_id) WHERE abs(value - rate) <= 1e-9 GROUP BY 1, 2 HAVING count(DISTINCT walk) = 2) SELECT core_id, cell FROM g QUALIFY row_number() OVER (PARTITION BY core_id ORDER BY f, depth, cell) = 1""")
def v27(spark, sf):
    from fleetroll.operators import cells

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = spark.read.parquet(f"{sf}/orders.parquet").select(c.alias("core_id"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("cell"), F.when(k % 2 == 0, "first").otherwise("last").alias("walk"), (0.05 + c % 7 * 0.01 + F.when(k % 5 == 3, 0.001).otherwise(0.0)).alias("value"), (k % 5 < 2).alias("is_formula"), (k % 4).alias("depth"))
    r = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("core_id"), (0.05 + F.col("c_custkey") % 7 * 0.01).alias("rate"))
    return cells.source_rate(x, r)
