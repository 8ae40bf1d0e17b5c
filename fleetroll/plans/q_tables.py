"""Queries on windows, sets, lookups and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.operators import agg, windows
from fleetroll.sources.adapters import cte, view

from .registry import query

KEY = ["workbook_id", "sheet", "row_no"]
K = "workbook_id, sheet, row_no"


@query("w1_occurrence", f"{cte('rows_prior')} SELECT workbook_id, sheet, row_no, label, row_number() OVER (PARTITION BY workbook_id, label ORDER BY row_no)::INT AS occurrence FROM rows_prior")
def w1(spark, sf):
    return windows.occurrence(view(spark, sf, "rows_prior"), ["workbook_id", "label"]).select("workbook_id", "sheet", "row_no", "label", "occurrence")


@query("w2_rank_k", f"""{cte('rows_prior')} SELECT workbook_id, row_no, figure, rank() OVER (PARTITION BY workbook_id ORDER BY figure DESC)::INT AS rank,
    nth_value(figure, 3) OVER (PARTITION BY workbook_id ORDER BY figure DESC, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kth FROM rows_prior""")
def w2(spark, sf):
    return windows.rank_k(view(spark, sf, "rows_prior").select("workbook_id", "row_no", "figure"), ["workbook_id"], "figure", "row_no", 3)


@query("w3_upper_median_gap", f"""{cte('series')}, g AS (SELECT {K}, period_end - lag(period_end) OVER (PARTITION BY {K} ORDER BY period_end) AS gap FROM series),
    h AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY gap) AS i, count(*) OVER (PARTITION BY {K}) AS n FROM g WHERE gap IS NOT NULL)
    SELECT {K}, gap::INT AS gap, round(gap / 30.44)::INT AS months FROM h WHERE i = n // 2 + 1""")
def w3(spark, sf):
    return windows.upper_median_gap(view(spark, sf, "series"), KEY)


@query("w5_runs", """SELECT o_custkey, min(n)::INT AS first, max(n)::INT AS last, count(*)::BIGINT AS length FROM (SELECT o_custkey, n, n - row_number() OVER (PARTITION BY o_custkey ORDER BY n) AS g
    FROM (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS n FROM orders)) GROUP BY o_custkey, g""")
def w5(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("n"))
    return windows.runs(o, ["o_custkey"], "n")


@query("w6_step_ratios", f"""{cte('series')}, r AS (SELECT workbook_id, sheet, row_no, round(value / b, 1) AS ratio FROM (SELECT *, lag(value) OVER (PARTITION BY {K} ORDER BY period_end) AS b FROM series) WHERE b <> 0)
    SELECT {K}, ratio, times FROM (SELECT {K}, ratio, count(*)::BIGINT AS times FROM r GROUP BY {K}, ratio) QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY times DESC, ratio) = 1""")
def w6(spark, sf):
    return windows.step_ratios(view(spark, sf, "series"), KEY, 1)


@query("w7_top_k", f"{cte('rows_prior')} SELECT workbook_id, row_no, label, figure FROM rows_prior QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY figure DESC, row_no) <= 3")
def w7(spark, sf):
    d = view(spark, sf, "rows_prior").select("workbook_id", "row_no", "label", "figure")
    return windows.top_k(d, ["workbook_id"], [F.col("figure").desc(), F.col("row_no")], 3)


@query("w8_first_seen", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY source, doc_id) AS k FROM documents) WHERE k = 1")
def w8(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    return windows.first_seen(d, F.lower("text"), ["source", "doc_id"]).select("doc_id", "source")


@query("o1_changes", f"""{cte('series', 'series_now')}, o AS (SELECT DISTINCT workbook_id, sheet, 1 AS o FROM series), n AS (SELECT DISTINCT workbook_id, sheet, 1 AS n FROM series_now)
    SELECT workbook_id, sheet, CASE WHEN o IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'common' END AS change FROM o FULL JOIN n USING (workbook_id, sheet)""")
def o1(spark, sf):
    return windows.changes(view(spark, sf, "series"), view(spark, sf, "series_now"), ["workbook_id", "sheet"])


@query("o2_union_best", f"{cte('rows_prior', 'rows_now')} SELECT workbook_id, label, max(figure) AS figure FROM (SELECT workbook_id, label, figure FROM rows_prior UNION ALL SELECT workbook_id, label, figure FROM rows_now) GROUP BY 1, 2")
def o2(spark, sf):
    return windows.union_best([view(spark, sf, n).select("workbook_id", "label", "figure") for n in ("rows_prior", "rows_now")], ["workbook_id", "label"], "figure")


@query("o3_jaccard", f"""{cte('rows_prior', 'rows_now')}, a AS (SELECT DISTINCT sheet AS sa, label FROM rows_prior), b AS (SELECT DISTINCT sheet AS sb, label FROM rows_now),
    c AS (SELECT sa, sb, count(*) AS common FROM a JOIN b USING (label) GROUP BY 1, 2)
    SELECT sa, sb, common::BIGINT AS common, round(common / ((SELECT count(*) FROM a x WHERE x.sa = c.sa) + (SELECT count(*) FROM b y WHERE y.sb = c.sb) - common), 9) AS jaccard FROM c""")
def o3(spark, sf):
    a, b = view(spark, sf, "rows_prior").withColumnRenamed("sheet", "sa"), view(spark, sf, "rows_now").withColumnRenamed("sheet", "sb")
    return windows.jaccard(a, b, "sa", "sb", "label").withColumn("jaccard", F.round("jaccard", 9))


@query("l1_lookup_exact", f"{cte('rows_prior', 'rows_now')} SELECT n.workbook_id, n.row_no, (SELECT arg_min(figure, row_no) FROM rows_prior p WHERE lower(p.label) = lower(n.label)) AS found FROM rows_now n")
def l1(spark, sf):
    d = view(spark, sf, "rows_now").select("workbook_id", "row_no", "label")
    return windows.lookup_exact(d, view(spark, sf, "rows_prior").select(F.col("label").alias("k"), "figure", F.col("row_no").alias("o")), "label", "k", "figure", "o").select("workbook_id", "row_no", "found")


@query("l2_asof", f"""{cte('flows', 'discountings')}, a AS (SELECT core_id, DATE '1996-01-15' + ((core_id % 50) * 30)::INT AS at FROM discountings)
    SELECT a.core_id, a.at, f.cf AS found FROM a ASOF LEFT JOIN flows f ON a.core_id = f.core_id AND a.at >= f.period_end""")
def l2(spark, sf):
    a = view(spark, sf, "discountings").select("core_id", F.date_add(F.lit("1996-01-15").cast("date"), ((F.col("core_id") % 50) * 30).cast("int")).alias("at"))
    return windows.asof(a, view(spark, sf, "flows"), ["core_id"], "at", "period_end", "cf")


@query("l3_xlookup", f"""{cte('flows', 'discountings')}, a AS (SELECT core_id, DATE '1998-01-15' + ((core_id % 50) * 30)::INT AS at FROM discountings)
    SELECT a.core_id, a.at, coalesce(f.cf, -1.0) AS found FROM a ASOF LEFT JOIN flows f ON a.core_id = f.core_id AND a.at <= f.period_end""")
def l3(spark, sf):
    a = view(spark, sf, "discountings").select("core_id", F.date_add(F.lit("1998-01-15").cast("date"), ((F.col("core_id") % 50) * 30).cast("int")).alias("at"))
    return windows.xlookup(a, view(spark, sf, "flows"), ["core_id"], "at", "period_end", "cf", 1, F.lit(-1.0))


@query("l4_sum_until", f"{cte('flows', 'discountings')} SELECT core_id, valuation_date, round(sum(CASE WHEN period_end <= valuation_date THEN cf ELSE 0 END), 4) AS total FROM flows JOIN discountings USING (core_id) GROUP BY 1, 2")
def l4(spark, sf):
    d = view(spark, sf, "discountings").select("core_id", "valuation_date")
    return windows.sum_until(view(spark, sf, "flows").withColumnRenamed("cf", "value"), d, ["core_id"], "valuation_date").withColumn("total", F.round("total", 4))


@query("l5_choose", "SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN p_name WHEN 2 THEN p_type WHEN 3 THEN p_brand END AS chosen FROM part")
def l5(spark, sf):
    from fleetroll.functions import xl

    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", xl.choose(F.col("p_size") % 4, F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("chosen"))


@query("a1_annual", f"""{cte('series')}, d AS (SELECT {K}, CASE sheet WHEN 'A' THEN 'first' WHEN 'N' THEN CASE row_no WHEN 1 THEN 'last' ELSE 'average' END ELSE 'sum' END AS method, year(period_end) + CASE WHEN month(period_end) <= 6 THEN 0 ELSE 1 END AS fy, period_end, value FROM series)
    SELECT {K}, fy::INT AS fy, method, round(CASE method WHEN 'first' THEN arg_min(value, period_end) WHEN 'last' THEN arg_max(value, period_end) WHEN 'average' THEN round(avg(value), 1) ELSE sum(value) END, 4) AS value, count(*) < 12 AS partial FROM d GROUP BY {K}, fy, method""")
def a1(spark, sf):
    m = F.when(F.col("sheet") == "A", "first").when((F.col("sheet") == "N") & (F.col("row_no") == 1), "last").when(F.col("sheet") == "N", "average").otherwise("sum")
    return agg.annual(view(spark, sf, "series"), m, KEY, 6).withColumn("value", F.when(F.col("method") == "average", F.round("value", 1)).otherwise(F.round("value", 4)))


@query("a2_flows_by_fy", f"""{cte('flows')}, f AS (SELECT core_id, period_end, cf, 'last' AS feed, DATE '1997-06-30' AS v FROM flows UNION ALL SELECT core_id, (period_end + INTERVAL 12 MONTH)::DATE, cf * 1.02, 'this', DATE '1998-06-30' FROM flows)
    SELECT core_id, (year(period_end) + CASE WHEN month(period_end) <= 6 THEN 0 ELSE 1 END)::INT AS fy, round(sum(cf) FILTER (feed = 'last'), 3) AS last, round(sum(cf) FILTER (feed = 'this'), 3) AS this FROM f WHERE period_end > v GROUP BY 1, 2""")
def a2(spark, sf):
    f = view(spark, sf, "flows")
    both = f.withColumn("feed", F.lit("last")).union(f.select("core_id", F.add_months("period_end", 12), F.col("cf") * 1.02, F.lit("this")))
    d = spark.createDataFrame([("last", "1997-06-30"), ("this", "1998-06-30")], "feed string, v string").select("feed", F.col("v").cast("date").alias("valuation_date"))
    return agg.flows_by_fy(both, d, 6).withColumns({c: F.round(c, 3) for c in ("last", "this")})


@query("a3_after_date", f"""{cte('series')}, p AS (SELECT workbook_id, sheet, period_end, sum(value) AS value FROM series WHERE period_end > DATE '1998-12-31' GROUP BY ALL)
    SELECT workbook_id, sheet, round(sum(value), 4) AS total, round(arg_max(value, period_end), 4) AS last_value, min(period_end) AS first_end, max(period_end) AS last_end, count(*)::BIGINT AS periods FROM p GROUP BY 1, 2""")
def a3(spark, sf):
    return agg.after_date(view(spark, sf, "series"), F.lit("1998-12-31").cast("date"), ["workbook_id", "sheet"]).withColumns({c: F.round(c, 4) for c in ("total", "last_value")})


@query("a4_side_by_side", f"""{cte('series', 'series_now')}, m AS (SELECT workbook_id, round(sum(value), 4) AS prior FROM series GROUP BY 1), n AS (SELECT workbook_id, round(sum(value), 4) AS current FROM series_now GROUP BY 1)
    SELECT workbook_id, prior, current, greatest(prior, current) - least(prior, current) > 0.001 * greatest(abs(prior), abs(current)) AS disagree FROM m FULL JOIN n USING (workbook_id)""")
def a4(spark, sf):
    m = [view(spark, sf, v).groupBy("workbook_id").agg(F.round(F.sum("value"), 4).alias("metric")).withColumn("source", F.lit(n)) for v, n in (("series", "prior"), ("series_now", "current"))]
    return agg.side_by_side(m[0].union(m[1]), ["workbook_id"], ["prior", "current"])


@query("a10_ifs", """SELECT p_brand, coalesce(sum(p_retailprice) FILTER (ok), 0) AS sumifs, round(avg(p_retailprice) FILTER (ok), 6) AS averageifs, count(*) FILTER (ok)::BIGINT AS countifs, coalesce(max(p_retailprice) FILTER (ok), 0) AS maxifs, coalesce(min(p_retailprice) FILTER (ok), 0) AS minifs
    FROM (SELECT *, p_size >= 30 AND p_name LIKE '%ring%' AND p_type <> 'ECONOMY' AS ok FROM part) GROUP BY 1""")
def a10(spark, sf):
    out = agg.ifs(spark.read.parquet(f"{sf}/part.parquet"), "p_retailprice", [("p_size", ">=30"), ("p_name", "*RING*"), ("p_type", "<>economy")], ["p_brand"])
    return out.withColumns({"sumifs": F.round("sumifs", 6), "averageifs": F.round("averageifs", 6)})


@query("a11_stats", """SELECT b AS grp, round(CASE WHEN err IS NULL THEN m END, 6) AS median, round(CASE WHEN err IS NULL THEN s END, 6) AS stdev, round(CASE WHEN err IS NULL THEN v END, 4) AS var, n::BIGINT AS count, a::BIGINT AS counta, err FROM (
    SELECT l_suppkey AS b, median(x) AS m, stddev_samp(x) AS s, var_samp(x) AS v, count(x) AS n, count(*) FILTER (x IS NOT NULL OR e IS NOT NULL) AS a, arg_min(e, CASE WHEN e IS NOT NULL THEN o END) AS err FROM (
    SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS o, CASE WHEN l_quantity <> 13 THEN l_quantity END AS x, CASE WHEN l_suppkey % 9 = 2 AND l_quantity = 13 THEN concat('#N/A', l_linenumber % 2) END AS e FROM lineitem) GROUP BY 1)""")
def a11(spark, sf):
    d = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.col("l_suppkey").alias("grp"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"),
        F.when(F.col("l_quantity") != 13, F.col("l_quantity")).alias("x"),
        F.when((F.col("l_suppkey") % 9 == 2) & (F.col("l_quantity") == 13), F.concat(F.lit("#N/A"), (F.col("l_linenumber") % 2).cast("string"))).alias("e"),
    )
    return agg.stats(d, ["grp"], "x", "e", "o").select("grp", F.round("median", 6).alias("median"), F.round("stdev", 6).alias("stdev"), F.round("var", 4).alias("var"), "count", "counta", "err")


@query("a12_sumproduct", f"""{cte('series')} SELECT workbook_id, sheet, round(sum(coalesce(a, 0) * coalesce(b, 0)) / 1e6, 3) AS sumproduct FROM
    (SELECT workbook_id, sheet, period_end, sum(value) FILTER (row_no = 1) AS a, sum(value) FILTER (row_no = 2) AS b FROM series GROUP BY ALL) GROUP BY 1, 2""")
def a12(spark, sf):
    return agg.sumproduct(view(spark, sf, "series"), ["workbook_id", "sheet"], 1, 2).withColumn("sumproduct", F.round(F.col("sumproduct") / 1e6, 3))


@query("a15_display_sign", f"""{cte('series')}, s AS (SELECT {K}, period_end, CASE WHEN workbook_id % 4 = 1 THEN -value ELSE value END AS value FROM series)
    SELECT {K}, period_end, CASE WHEN bool_and(value < 0) OVER (PARTITION BY {K}) THEN -1 ELSE 1 END::INT AS sign, abs(value) AS shown FROM s""")
def a15(spark, sf):
    s = view(spark, sf, "series").withColumn("value", F.when(F.col("workbook_id") % 4 == 1, -F.col("value")).otherwise(F.col("value")))
    return agg.display_sign(s, KEY).select(*KEY, "period_end", "sign", "shown")
