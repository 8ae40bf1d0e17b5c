"""Queries on the parts of a value, its bridge and its roll.  Inputs are SELECTs that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetroll.operators import value
from fleetroll.sources.adapters import cte, view

from .q_gates import DUCK, table
from .registry import query

_V11 = "SELECT o_custkey AS engagement_id, o_orderkey % 4 AS core_id, CASE WHEN o_orderkey % 4 = 2 AND o_custkey % 3 = 0 THEN 'Franking credits' ELSE 'Cash flows' END AS label, last_day(CAST(o_orderdate AS DATE)) AS period_end, o_totalprice AS cf, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 4 = 3 AND o_custkey % 2 = 0 THEN o_totalprice * 0.8 ELSE 0.0 END AS tv, CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 3 > 0 THEN 0.0 ELSE 1.0 / (1 + o_orderkey % 7) END AS factor FROM {orders}"


@query("v11_split_value", f"""WITH s AS ({DUCK(_V11)}), g AS (SELECT engagement_id AS e, core_id, bool_or(regexp_matches(label, '(?i)frank|imputation|gamma')) AS fr, sum(cf * factor) AS pv, sum(tv * factor) AS tv, count(*) FILTER (factor <> 0 AND (cf <> 0 OR tv <> 0)) AS n FROM s GROUP BY 1, 2),
    m AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY fr, abs(pv) DESC, core_id) = 1 AND NOT fr AS main, NOT fr AND n = 1 AND tv <> 0 AS alone FROM g),
    v AS (SELECT e, sum(CASE WHEN main THEN pv - tv ELSE 0 END) AS f, sum(CASE WHEN main THEN tv WHEN alone THEN pv ELSE 0 END) AS t, sum(CASE WHEN fr THEN pv ELSE 0 END) AS k, sum(CASE WHEN NOT main AND NOT fr AND NOT alone THEN pv ELSE 0 END) AS o FROM m GROUP BY 1)
    SELECT e AS engagement_id, round(f, 6) AS forecast, round(t, 6) AS terminal, round(k, 6) AS franking, round(o, 6) AS other, round(f + t + k + o, 6) AS total, round(f / (f + t + k + o), 9) AS forecast_share, round(t / (f + t + k + o), 9) AS terminal_share, round(k / (f + t + k + o), 9) AS franking_share, round(o / (f + t + k + o), 9) AS other_share FROM v""")
def v11_value(spark, sf):
    out = value.split_value(table(spark, sf, _V11))
    return out.select("engagement_id", *[F.round(c, 9 if c.endswith("share") else 6).alias(c) for c in out.columns[1:]])


_V14 = """SELECT c_custkey AS engagement_id, e AS `end`, round(c_acctbal, -1) AS report, c_acctbal AS saved, CASE WHEN c_custkey % 11 = 7 THEN NULL ELSE c_acctbal + 0.5 END AS rebuilt, CASE WHEN c_custkey % 5 = 1 AND e = 'low' THEN NULL ELSE c_acctbal + k + 20 END AS at_time, CASE WHEN c_custkey % 5 = 1 AND e = 'low' THEN NULL ELSE c_acctbal + k + 12 END AS at_cash,
    c_acctbal + k * 2 AS before, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal + k * 2 ELSE c_acctbal + k * 3 END AS at_rate, CASE WHEN c_custkey % 13 = 2 THEN NULL ELSE c_acctbal + k * 4 END AS this_year, c_custkey % 6 = 3 AS held FROM {customer} CROSS JOIN (SELECT * FROM (VALUES ('low', 10.0), ('high', 30.0)) v(e, k)) x"""


@query("v14_bridges", f"""WITH d AS ({DUCK(_V14).replace('`', '"')}), s AS (SELECT *, bool_and(at_time IS NOT NULL AND at_cash IS NOT NULL) OVER (PARTITION BY engagement_id) AS sp, NOT held AND this_year IS NOT NULL AND rebuilt IS NOT NULL AS go FROM d),
    l AS (SELECT engagement_id, "end", 1 AS step_no, 'report' AS step, report AS value FROM s UNION ALL SELECT engagement_id, "end", 2, 'rounding', saved - report FROM s UNION ALL SELECT engagement_id, "end", 3, 'prior_feed', rebuilt - saved FROM s UNION ALL SELECT engagement_id, "end", 4, 'rebuilt', rebuilt FROM s
      UNION ALL SELECT engagement_id, "end", 5, 'roll', before - rebuilt FROM s WHERE go AND NOT sp UNION ALL SELECT engagement_id, "end", 6, 'time', at_time - rebuilt FROM s WHERE go AND sp UNION ALL SELECT engagement_id, "end", 7, 'cash', at_cash - at_time FROM s WHERE go AND sp UNION ALL SELECT engagement_id, "end", 8, 'forecast', before - at_cash FROM s WHERE go AND sp
      UNION ALL SELECT engagement_id, "end", 9, 'held', at_rate - before FROM s WHERE go AND at_rate <> before UNION ALL SELECT engagement_id, "end", 10, 'rate', this_year - at_rate FROM s WHERE go UNION ALL SELECT engagement_id, "end", 11, 'this_year', this_year FROM s WHERE go),
    x AS (SELECT * FROM l WHERE value IS NOT NULL), m AS (SELECT engagement_id, 'mid' AS "end", step_no, step, avg(value) AS value FROM x GROUP BY 1, 3, 4 HAVING count(*) = 2)
    SELECT engagement_id, "end", step_no, step, round(value, 6) + 0.0 AS value FROM x UNION ALL SELECT engagement_id, "end", step_no, step, round(CASE WHEN step = 'report' AND engagement_id % 2 = 0 THEN engagement_id * 1.0 ELSE value END, 6) + 0.0 FROM m""")
def v14_ends(spark, sf):
    m = table(spark, sf, "SELECT c_custkey AS engagement_id, CAST(c_custkey AS DOUBLE) AS mid FROM {customer} WHERE c_custkey % 2 = 0")
    return value.bridges(table(spark, sf, _V14), m).withColumn("value", F.round("value", 6) + 0.0)


_V16 = "SELECT o_custkey AS core_id, last_day(CAST(o_orderdate AS DATE)) AS period_end, sum(o_totalprice) AS cf, sum(CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice ELSE 0.0 END) AS tv FROM {orders} GROUP BY 1, 2"


@query("v16_findings", f"""WITH f AS ({DUCK(_V16)}), r AS (SELECT * FROM f WHERE (core_id + month(period_end)) % 7 <> 0), t AS (SELECT core_id, period_end, cf * 1.1 AS cf, tv * 1.2 AS tv FROM f WHERE (core_id + month(period_end)) % 5 <> 0),
    j AS (SELECT coalesce(r.core_id, t.core_id) AS core_id, r.cf - r.tv AS rc, t.cf - t.tv AS tc, coalesce(r.tv, 0) AS rt, coalesce(t.tv, 0) AS tt, r.cf AS r, t.cf AS t FROM r FULL JOIN t ON r.core_id = t.core_id AND r.period_end = t.period_end),
    g AS (SELECT core_id, sum(CASE WHEN r IS NOT NULL AND t IS NOT NULL THEN (tc - rc) * 0.9 ELSE 0 END) AS revised, sum(CASE WHEN r IS NULL THEN tc * 0.9 ELSE 0 END) AS added, sum(CASE WHEN t IS NULL THEN -rc * 0.9 ELSE 0 END) AS dropped, sum((tt - rt) * 0.9) AS terminal FROM j GROUP BY 1),
    k AS (SELECT *, revised + added + dropped + terminal AS cash, 5.0 AS bal, 1e6 AS ref, CASE core_id % 4 WHEN 0 THEN revised + added + dropped + terminal + 5 WHEN 1 THEN revised + added + dropped + terminal + 12005 WHEN 2 THEN revised + added + dropped + terminal + 90005 ELSE -(revised + added + dropped + terminal) * 0.0001 END AS step FROM g)
    SELECT core_id, round(revised, 4) AS revised, round(added, 4) AS added, round(dropped, 4) AS dropped, round(terminal, 4) AS terminal, round(step - cash - bal, 4) + 0.0 AS outside, CASE WHEN abs(step - cash - bal) / ref > 0.02 THEN 'block' WHEN abs(step - cash - bal) / ref > 0.005 THEN 'check' WHEN abs(cash) / ref > 0.001 AND step * cash < 0 THEN 'opposite' ELSE 'ok' END AS finding FROM k""")
def v16_findings(spark, sf):
    f = table(spark, sf, _V16)
    n = F.col("core_id") + F.month("period_end")
    r, t = f.where(n % 7 != 0), f.where(n % 5 != 0).withColumns({"cf": F.col("cf") * 1.1, "tv": F.col("tv") * 1.2})
    x = f.select("core_id", "period_end").withColumn("factor", F.lit(0.9))
    c = value.split_step(r, t, x).withColumn("cash", F.col("revised") + F.col("added") + F.col("dropped") + F.col("terminal"))
    k = F.col("core_id") % 4
    step = F.when(k == 0, F.col("cash") + 5).when(k == 1, F.col("cash") + 12005).when(k == 2, F.col("cash") + 90005).otherwise(-F.col("cash") * 0.0001)
    out = value.split_step(r, t, x, c.select("core_id", step.alias("step"), F.lit(5.0).alias("balances"), F.lit(1e6).alias("reference")))
    return out.select("core_id", *[F.round(c, 4).alias(c) for c in ("revised", "added", "dropped", "terminal")], (F.round("outside", 4) + 0.0).alias("outside"), "finding")


_V22 = "SELECT DISTINCT l_suppkey AS workbook_id, CASE WHEN l_suppkey % 3 > 0 THEN make_date(2023, 6, 30) END AS overlay_date, CASE WHEN l_suppkey % 4 > 0 THEN make_date(2023, 3, 31) END AS prior_date, CASE WHEN l_suppkey % 5 = 1 THEN make_date(2023, 1, 31) WHEN l_suppkey % 5 > 2 THEN make_date(2024, 6, 30) END AS current_date, CASE WHEN l_suppkey % 7 = 0 THEN make_date(2024, 12, 31) END AS this_date FROM {lineitem}".replace("AS current_date", "AS model_date")


@query("v22_roll_plan", f"""{cte('series')}, d AS ({DUCK(_V22)}), a AS (SELECT workbook_id, sheet, min(period_end) AS a, last_day((min(period_end) + to_months((CASE WHEN sheet = 'R' THEN 6 WHEN workbook_id % 10 = 4 THEN 36 ELSE 12 END)::INT))::DATE) AS b FROM series GROUP BY 1, 2),
    m AS (SELECT workbook_id, (year(b) - year(a)) * 12 + month(b) - month(a) AS mo, count(*) AS n FROM a GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY workbook_id) AS seen FROM m), mv AS (SELECT workbook_id, mo FROM s WHERE mo > 0 AND mo <= 24 AND seen >= 3 QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY n DESC, mo) = 1),
    h AS (SELECT d.*, mo, coalesce(overlay_date, prior_date) AS base, CASE WHEN this_date > coalesce(overlay_date, prior_date) THEN 'set' WHEN model_date > overlay_date THEN 'model' WHEN overlay_date IS NOT NULL AND model_date IS NOT NULL THEN 'check' WHEN overlay_date IS NULL AND model_date > prior_date THEN 'models' WHEN mo IS NOT NULL THEN 'timelines' ELSE 'assumed' END AS how FROM d LEFT JOIN mv USING (workbook_id)),
    k AS (SELECT *, CASE how WHEN 'set' THEN this_date WHEN 'model' THEN model_date WHEN 'models' THEN model_date WHEN 'check' THEN overlay_date END AS t FROM h),
    e AS (SELECT workbook_id, sheet, max(period_end) AS z0, last_day((max(period_end) + to_months((CASE WHEN sheet = 'R' THEN 6 WHEN workbook_id % 10 = 4 THEN 36 ELSE 12 END)::INT))::DATE) AS z1 FROM series GROUP BY 1, 2 HAVING count(DISTINCT period_end) > 1),
    hz AS (SELECT workbook_id, CASE WHEN count(*) FILTER (workbook_id % 6 = 5 AND sheet <> 'R') > count(*) FILTER (NOT (workbook_id % 6 = 5 AND sheet <> 'R')) THEN 'fixed' ELSE 'rolling' END AS horizon FROM e GROUP BY 1),
    z AS (SELECT *, (CASE WHEN how IN ('set', 'model', 'models') THEN (year(t) - year(base)) * 12 + month(t) - month(base) WHEN how = 'check' THEN 0 WHEN how = 'timelines' THEN mo ELSE 12 END)::INT AS months FROM k)
    SELECT workbook_id, months, how, coalesce(t, last_day((base + to_months(months))::DATE)) AS new_date, horizon FROM z LEFT JOIN hz USING (workbook_id)""")
def v22_plan(spark, sf):
    return _plan(spark, sf).drop("base")


def _plan(spark, sf):
    s = view(spark, sf, "series")
    by = F.when(F.col("sheet") == "R", 6).when(F.col("workbook_id") % 10 == 4, 36).otherwise(12)
    moved = F.last_day(F.add_months("period_end", by))
    # some end where they did: periods that would go beyond the sheet's last are gathered on it
    last = F.max("period_end").over(Window.partitionBy("workbook_id", "sheet"))
    now = s.withColumn("period_end", F.when((F.col("workbook_id") % 6 == 5) & (F.col("sheet") != "R") & (moved > last), last).otherwise(moved))
    return value.roll_plan(table(spark, sf, _V22).withColumnRenamed("model_date", "current_date"), s, now, sheets=3)


@query("v22_period_shifts", f"""{cte('series')}, p AS (SELECT DISTINCT workbook_id, CASE WHEN workbook_id % 5 > 0 THEN make_date(1995, 3, 31) END AS base, (workbook_id % 7) * 3 AS months, CASE WHEN workbook_id % 4 = 1 THEN 'fixed' ELSE 'rolling' END AS horizon FROM series),
    d AS (SELECT DISTINCT workbook_id, CASE sheet WHEN 'A' THEN 'years' WHEN 'N' THEN 'quarters' ELSE 'starts' END AS sheet, CASE sheet WHEN 'A' THEN make_date(year(period_end), 12, 31) WHEN 'N' THEN last_day(make_date(year(period_end), quarter(period_end) * 3, 1)) ELSE make_date(year(period_end), 7, 1) END AS period_end FROM series),
    g AS (SELECT *, period_end - lag(period_end) OVER (PARTITION BY workbook_id, sheet ORDER BY period_end) AS gap FROM d), l AS (SELECT workbook_id, sheet, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gs FROM g GROUP BY 1, 2),
    k AS (SELECT workbook_id, sheet, CASE WHEN len(gs) > 0 THEN greatest(1, round(gs[len(gs) // 2 + 1] / 30.44)::INT) END AS len FROM l),
    x AS (SELECT d.workbook_id, d.sheet, len, base, months, horizon, CASE WHEN d.sheet = 'starts' THEN ((period_end + to_months(len))::DATE - 1)::DATE ELSE period_end END AS e, last_day((base + to_months(months::INT))::DATE) AS t FROM d JOIN k USING (workbook_id, sheet) JOIN p USING (workbook_id))
    SELECT workbook_id, sheet, any_value(months)::INT AS months, CASE WHEN any_value(months) = 0 OR any_value(horizon) = 'fixed' OR any_value(len) IS NULL THEN 0 WHEN any_value(base) IS NULL THEN any_value(len) * (any_value(months) // any_value(len)) ELSE any_value(len) * count(*) FILTER (e > base AND e <= t) END::INT AS shift FROM x GROUP BY 1, 2""")
def v22_shifts(spark, sf):
    s = view(spark, sf, "series")
    w, d, q = F.col("workbook_id"), F.col("period_end"), F.col("sheet")
    plan = s.select("workbook_id").distinct().select("workbook_id", F.when(w % 5 > 0, F.lit("1995-03-31").cast("date")).alias("base"), (w % 7 * 3).cast("int").alias("months"), F.when(w % 4 == 1, "fixed").otherwise("rolling").alias("horizon"))
    kind = F.when(q == "A", "years").when(q == "N", "quarters").otherwise("starts")
    end = F.when(q == "A", F.make_date(F.year(d), F.lit(12), F.lit(31))).when(q == "N", F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1)))).otherwise(F.make_date(F.year(d), F.lit(7), F.lit(1)))
    return value.period_shifts(s.select("workbook_id", kind.alias("sheet"), end.alias("period_end")), plan)
