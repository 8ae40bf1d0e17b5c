"""Queries on cells, links and switches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.operators import cells, graph
from fleetroll.sources import tables
from fleetroll.sources.adapters import counted_broadcasts, cte, view

from .registry import query

_C = """c AS (SELECT l_suppkey AS workbook_id, l_returnflag AS sheet, l_orderkey AS row_no, l_linenumber AS col, min(CASE WHEN l_linenumber = 1 THEN 'Item ' || l_partkey % 50 END) AS text,
    min(CASE WHEN l_linenumber > 1 AND l_partkey % 11 <> 0 THEN l_quantity END) AS value, min(CASE WHEN l_linenumber > 2 THEN 'R[-' || l_linenumber % 3 || ']C*2' END) AS formula, min(CASE WHEN l_linenumber > 2 AND l_partkey % 11 = 0 AND l_partkey % 2 = 0 THEN CASE l_partkey % 3 WHEN 0 THEN '#N/A' WHEN 1 THEN '#REF!' ELSE '#NUM!' END END) AS err FROM lineitem GROUP BY 1, 2, 3, 4)"""


def _cells(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    return l.groupBy(F.col("l_suppkey").alias("workbook_id"), F.col("l_returnflag").alias("sheet"), F.col("l_orderkey").alias("row_no"), n.alias("col")).agg(
        F.min(F.when(n == 1, F.concat(F.lit("Item "), (p % 50).cast("string")))).alias("text"),
        F.min(F.when((n > 1) & (p % 11 != 0), F.col("l_quantity"))).alias("value"),
        F.min(F.when(n > 2, F.concat(F.lit("R[-"), (n % 3).cast("string"), F.lit("]C*2")))).alias("formula"),
        F.min(F.when((n > 2) & (p % 11 == 0) & (p % 2 == 0), F.when(p % 3 == 0, "#N/A").when(p % 3 == 1, "#REF!").otherwise("#NUM!"))).alias("err"),
    )


@query("t3_line_items", f"""WITH {_C}, g AS (SELECT workbook_id, sheet, row_no, coalesce(string_agg(text, ' ' ORDER BY col), '') AS label, count(formula)::BIGINT AS n_formula, count(*) FILTER (formula IS NULL AND value IS NOT NULL)::BIGINT AS n_const, count(value) AS n FROM c GROUP BY 1, 2, 3)
    SELECT workbook_id, sheet, row_no, n_formula, n_const, label, last_value(CASE WHEN n = 0 AND label <> '' THEN label END IGNORE NULLS) OVER (PARTITION BY workbook_id, sheet ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM g""")
def t3(spark, sf):
    return cells.line_items(_cells(spark, sf)).drop("samples")


@query("t4_pattern_counts", f"""WITH {_C}, g AS (SELECT workbook_id, sheet, row_no, formula, count(*)::BIGINT AS n, min(col) AS first, max(col) AS last FROM c WHERE formula IS NOT NULL GROUP BY 1, 2, 3, 4)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet, row_no ORDER BY n DESC, first, formula)::INT AS place FROM g) WHERE place <= 3""")
def t4(spark, sf):
    return cells.pattern_counts(_cells(spark, sf))


@query("t14_model_shape", f"""WITH {_C} SELECT workbook_id, count(*)::BIGINT AS cells, count(formula)::BIGINT AS formulas, count(*) FILTER (formula IS NOT NULL AND value IS NULL AND err IS NULL)::BIGINT AS unsaved,
    count(*) FILTER (err = '#N/A')::BIGINT AS na_errors, count(*) FILTER (err = '#REF!')::BIGINT AS ref_errors, count(*) FILTER (err NOT IN ('#N/A', '#REF!'))::BIGINT AS other_errors FROM c GROUP BY 1""")
def t14(spark, sf):
    return cells.model_shape(_cells(spark, sf))


_T14 = "SELECT workbook_id, sheet, CASE WHEN workbook_id % 5 = 0 THEN make_date(year(period_end), 12, 31) WHEN sheet = 'N' THEN last_day(make_date(year(period_end), quarter(period_end) * 3, 1)) ELSE period_end END AS period_end FROM series WHERE NOT (sheet = 'R' AND workbook_id % 4 = 1)"


@query("t14_saved_state", f"""{cte('series')}, {_C}, sh AS (SELECT DISTINCT workbook_id, sheet, CASE WHEN sheet = 'A' AND workbook_id % 3 = 0 THEN 'hidden' WHEN sheet = 'R' AND workbook_id % 6 = 0 THEN 'veryHidden' ELSE 'visible' END AS state FROM series),
    s AS (SELECT workbook_id, count(*)::BIGINT AS sheets, count(*) FILTER (state <> 'visible')::BIGINT AS hidden_sheets FROM sh GROUP BY 1), e AS (SELECT workbook_id, string_agg(err || '=' || n, ',' ORDER BY err) AS errors FROM (SELECT workbook_id, err, count(*) AS n FROM c WHERE err IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    d AS (SELECT DISTINCT * FROM ({_T14})), g AS (SELECT workbook_id, sheet, median(gap) AS gap FROM (SELECT *, period_end - lag(period_end) OVER (PARTITION BY workbook_id, sheet ORDER BY period_end) AS gap FROM d) WHERE gap IS NOT NULL GROUP BY 1, 2),
    p AS (SELECT g.workbook_id, CASE WHEN gap BETWEEN 26 AND 33 THEN 'monthly' WHEN gap BETWEEN 85 AND 95 THEN 'quarterly' WHEN gap BETWEEN 178 AND 187 THEN 'semi-annual' WHEN gap BETWEEN 360 AND 370 THEN 'annual' ELSE 'irregular' END AS f, n, a, b FROM g JOIN (SELECT workbook_id, sheet, count(*) AS n, min(period_end) AS a, max(period_end) AS b FROM d GROUP BY 1, 2) USING (workbook_id, sheet)),
    t AS (SELECT workbook_id, f, count(*) AS k, max(n) AS n, min(a) AS a, max(b) AS b FROM p GROUP BY 1, 2), u AS (SELECT workbook_id, string_agg(f || ' ' || k || ' ' || n || ' ' || a || ' ' || b, ',' ORDER BY f) AS timelines, sum(k) AS w FROM t GROUP BY 1)
    SELECT s.workbook_id, sheets, hidden_sheets, errors, CASE WHEN workbook_id % 4 = 2 THEN 'manual' ELSE 'auto' END AS calc_mode, NOT (workbook_id % 10 = 3) AS calc_completed, workbook_id % 8 = 1 AS iterate, timelines, (sheets - coalesce(w, 0))::BIGINT AS without_timeline FROM s LEFT JOIN e USING (workbook_id) LEFT JOIN u USING (workbook_id)""")
def t14_saved(spark, sf):
    s = view(spark, sf, "series")
    w, sheet = F.col("workbook_id"), F.col("sheet")
    sheets = s.select("workbook_id", "sheet").distinct().withColumn("state", F.when((sheet == "A") & (w % 3 == 0), "hidden").when((sheet == "R") & (w % 6 == 0), "veryHidden").otherwise("visible"))
    pair = lambda k, v: F.struct(F.lit(f"calc.{k}").alias("key"), v.alias("value"))
    meta = s.select("workbook_id").distinct().select("workbook_id", F.explode(F.array(pair("calcMode", F.when(w % 4 == 2, "manual")), pair("calcCompleted", F.when(w % 10 == 3, "0")), pair("iterate", F.when(w % 8 == 1, "1").otherwise("0")))).alias("x")).select("workbook_id", "x.*")
    out = cells.saved_state(sheets, _cells(spark, sf), meta, spark.sql(_T14.replace("FROM series", "FROM {series}"), series=s))
    show = lambda c, f: F.array_join(F.transform(c, f), ",")
    text = lambda *c: F.concat_ws(" ", *[x.cast("string") for x in c])
    return out.withColumns({"errors": show("errors", lambda x: F.concat_ws("=", x["err"], x["n"].cast("string"))), "timelines": show("timelines", lambda x: text(x["periodicity"], x["sheets"], x["periods"], x["first"], x["last"]))})


@query("j31_heading", f"""WITH {_C}, t AS (SELECT workbook_id, sheet, col, row_no, CASE WHEN row_no % 4 = 0 THEN 'Case ' || (1990 + row_no % 20) || ' total' END AS text, value FROM c)
    SELECT workbook_id, sheet, row_no, col, heading FROM (SELECT *, CASE WHEN h IS NOT NULL THEN trim(regexp_replace(regexp_replace(lower(h), '\\b(19|20)\\d\\d\\b', '', 'g'), ' +', ' ', 'g')) END AS heading FROM
    (SELECT *, last_value(text IGNORE NULLS) OVER (PARTITION BY workbook_id, sheet, col ORDER BY row_no RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING) AS h FROM t)) WHERE value IS NOT NULL""")
def j31(spark, sf):
    t = F.when(F.col("row_no") % 4 == 0, F.concat(F.lit("Case "), (1990 + F.col("row_no") % 20).cast("string"), F.lit(" total")))
    return cells.heading(_cells(spark, sf).withColumn("text", t))


_HC = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, 'S' AS sheet, p_partkey % 50 + 1 AS row_no, c {shift} AS col, CASE WHEN p_partkey % 12 = 0 THEN concat('Case ', CAST((c + p_size {move}) % 4 AS STRING), ' ', CAST(1990 + p_size AS STRING)) END AS text, CASE WHEN p_partkey % 12 > 0 THEN p_retailprice * c END AS value FROM {{part}} CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4)) v(c)) k"
_HP, _HN = _HC.format(shift="", move=""), _HC.format(shift="+ CASE WHEN CAST(floor(p_partkey / 50) AS BIGINT) % 2 = 1 THEN 1 ELSE 0 END", move="+ CASE WHEN CAST(floor(p_partkey / 50) AS BIGINT) % 3 = 2 THEN p_partkey % 2 * c ELSE 0 END")
_HH = lambda q: f"SELECT workbook_id, sheet, row_no, col, trim(regexp_replace(regexp_replace(lower(h), '\\b(19|20)\\d\\d\\b', '', 'g'), ' +', ' ', 'g')) AS heading FROM (SELECT *, last_value(text IGNORE NULLS) OVER (PARTITION BY workbook_id, sheet, col ORDER BY row_no RANGE BETWEEN 15 PRECEDING AND 1 PRECEDING) AS h FROM ({q.format(part='part').replace('AS STRING', 'AS VARCHAR')}) z) WHERE value IS NOT NULL AND h IS NOT NULL"


@query("j31_column", f"""WITH p AS ({_HH(_HP)}), c AS ({_HH(_HN)}), g AS (SELECT p.workbook_id, p.sheet, p.row_no, p.col, count(c.col) AS n, max(CASE WHEN c.col = p.col THEN c.col END) AS same, min(c.col) AS one FROM p LEFT JOIN c ON c.workbook_id = p.workbook_id AND c.sheet = p.sheet AND c.row_no = p.row_no AND c.heading = p.heading GROUP BY 1, 2, 3, 4)
    SELECT workbook_id, sheet, row_no, col, row_no AS cur_row, CASE WHEN same IS NOT NULL THEN same WHEN n = 1 THEN one END AS cur_col, CASE WHEN same IS NOT NULL THEN 'same' WHEN n = 1 THEN 'heading' WHEN n > 1 THEN 'several' ELSE 'none' END AS how FROM g""")
def j31_column(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    p, c = spark.sql(_HP, part=part), spark.sql(_HN, part=part)
    m = p.select("workbook_id", "sheet", "row_no", F.col("row_no").alias("cur_row")).distinct()
    return cells.heading_column(p, c, m)


@query("f5_holding", """WITH f AS (SELECT o_custkey AS e, o_orderkey AS fact_id, round(o_totalprice, -4) AS v FROM orders), c AS (SELECT o_custkey AS e, o_orderkey AS cell_id, round(o_totalprice, -4) / CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 1 END AS value, o_orderkey % 2 = 0 AS formula FROM orders WHERE o_orderpriority <> '5-LOW')
    SELECT e AS engagement_id, fact_id, cell_id FROM c JOIN f USING (e) WHERE round(value, 12) IN (round(v, 12), round(v / 100, 12)) QUALIFY row_number() OVER (PARTITION BY e, fact_id ORDER BY formula, cell_id) = 1""")
def f5(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, v = F.col("o_orderkey"), F.round("o_totalprice", -4)
    f = o.select(F.col("o_custkey").alias("engagement_id"), k.alias("fact_id"), v.alias("value"))
    c = o.select(F.col("o_custkey").alias("engagement_id"), k.alias("cell_id"), F.col("o_orderpriority").alias("label"), (v / F.when(k % 3 == 0, 100).otherwise(1)).alias("value"), F.when(k % 2 == 0, "f").alias("formula"))
    return cells.holding(c, f, r"(?i)urgent|high|medium|not specified")


@query("f8_header_text", "SELECT workbook_id, text, sheets FROM (SELECT p_size % 10 AS workbook_id, p_name AS text, count(DISTINCT p_brand)::BIGINT AS sheets FROM part WHERE p_partkey % 9 <= 4 GROUP BY 1, 2) WHERE sheets >= 2 QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY sheets DESC, text) <= 6")
def f8(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select((F.col("p_size") % 10).alias("workbook_id"), F.col("p_brand").alias("sheet"), (F.col("p_partkey") % 9).alias("row_no"), F.col("p_name").alias("text"))
    return cells.header_text(p)


@query("f9_amount_rows", f"""{cte('series')}, s AS (SELECT workbook_id, sheet, row_no, period_end, CASE workbook_id % 4 WHEN 0 THEN CASE WHEN period_end > DATE '1998-06-30' THEN 1.0 ELSE 0.0 END WHEN 1 THEN (period_end - DATE '1899-12-30')::DOUBLE ELSE value END AS value FROM series)
    SELECT DISTINCT workbook_id, sheet, row_no, CASE WHEN workbook_id % 4 IN (0, 1) OR (workbook_id % 4 = 2 AND row_no = 1) THEN 'timing' ELSE 'amount' END AS kind FROM s""")
def f9(spark, sf):
    w = F.col("workbook_id") % 4
    s = view(spark, sf, "series")
    v = F.when(w == 0, F.when(F.col("period_end") > "1998-06-30", 1.0).otherwise(0.0)).when(w == 1, F.date_diff("period_end", F.lit("1899-12-30").cast("date")).cast("double")).otherwise(F.col("value"))
    labels = s.select("workbook_id", "sheet", "row_no").distinct().withColumn("label", F.when((w == 2) & (F.col("row_no") == 1), "Operating flag").otherwise("Revenue"))
    return cells.amount_rows(s.withColumn("value", v), labels)


#: Lines that one task makes cells of; and those of small tables, up to eight tasks.
LINES, FEW = 200_000, 1_000
_J20 = f"""{_C}, d AS (SELECT workbook_id, workbook_id // 4 AS name, sheet, row_no % 50 AS row_no, col, max(value) AS value FROM c WHERE value IS NOT NULL GROUP BY ALL)"""


def _j20(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    c = l.select(F.col("l_suppkey").alias("workbook_id"), F.col("l_returnflag").alias("sheet"), F.col("l_orderkey").alias("row_no"), n.alias("col"), F.when((n > 1) & (p % 11 != 0), F.col("l_quantity")).alias("value"))
    # shuffled once, for both steps; a sheet's cells stay together, and a task's memory is that of so many lines
    lines = l.count()
    tasks = max(1, min(8, lines // FEW), -(-lines // LINES))
    c = c.where("value is not null").repartition(tasks, "workbook_id", "sheet").groupBy("workbook_id", "sheet", "row_no", "col").agg(F.min("value").alias("value"))
    return c.groupBy("workbook_id", F.floor(F.col("workbook_id") / 4).alias("name"), "sheet", (F.col("row_no") % 50).alias("row_no"), "col").agg(F.max("value").alias("value"))


@query("j20_link_agreement", f"""WITH {_J20}, l AS (SELECT workbook_id AS link, CASE WHEN workbook_id % 5 = 2 THEN -workbook_id ELSE name END AS name, sheet, row_no, col, CASE WHEN col = 3 THEN value + 1 ELSE value END AS v FROM d),
    e AS (SELECT link, d.workbook_id, count(*)::BIGINT AS compared, count(*) FILTER (abs(v - value) <= 1e-6 * greatest(1.0, abs(v)))::BIGINT AS equal FROM l JOIN d USING (sheet, row_no, col) WHERE l.name = d.name OR l.name < 0 GROUP BY 1, 2)
    SELECT link, workbook_id, compared, equal FROM e QUALIFY row_number() OVER (PARTITION BY link ORDER BY equal DESC, workbook_id) = 1""")
def j20(spark, sf):
    """Every fifth link's file has another name now; its workbook is found by what it holds."""
    counted_broadcasts(spark)
    # read several times
    c = tables.written(_j20(spark, sf), "cells")
    link = F.col("workbook_id")
    cached = c.select(link.alias("link"), F.when(link % 5 == 2, -link).otherwise(F.col("name")).alias("name"), "sheet", "row_no", "col", F.when(F.col("col") == 3, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return cells.link_agreement(cached, c)


@query("j20_choose_link", f"""WITH {_J20}, b AS (SELECT workbook_id // 4 AS e, workbook_id AS link, CASE WHEN workbook_id % 4 = 3 AND workbook_id // 4 % 3 = 0 THEN 'model' ELSE 'book ' || workbook_id END AS name, list_distinct(list(CASE WHEN workbook_id % 4 = 2 AND sheet = 'A' THEN 'Z' WHEN workbook_id % 4 = 2 AND sheet = 'N' THEN 'Y' ELSE sheet END)) AS sheets FROM d GROUP BY 1, 2),
    k AS (SELECT workbook_id // 4 AS e, workbook_id AS link, sheet, row_no, col, value + CASE WHEN workbook_id // 4 % 3 = 2 THEN 1000 ELSE 0 END AS v FROM d), m AS (SELECT workbook_id // 4 AS e, sheet, row_no, col, value FROM d WHERE workbook_id % 4 = 1),
    q AS (SELECT e, link, count(*) FILTER (abs(v - value) <= 1e-6 * greatest(1.0, abs(v), abs(value)))::BIGINT AS equal FROM k JOIN m USING (e, sheet, row_no, col) GROUP BY 1, 2), ms AS (SELECT e, list_distinct(list(sheet)) AS ss FROM m GROUP BY 1),
    f AS (SELECT b.e, b.link, name = 'model' AS named, coalesce(equal, 0) AS equal, len(list_intersect(sheets, ss)) / len(sheets) AS sh, CASE b.link % 4 WHEN 0 THEN 5 WHEN 1 THEN 5 + b.e % 2 ELSE 2 END AS rd FROM b JOIN ms USING (e) LEFT JOIN q ON q.e = b.e AND q.link = b.link),
    g AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY named DESC, equal DESC, sh DESC, link) = 1 AS fst, bool_or(named OR equal > 0) OVER (PARTITION BY e) AS anyone, count(*) FILTER (sh >= 0.8) OVER (PARTITION BY e) AS likes, max(rd) FILTER (sh >= 0.8) OVER (PARTITION BY e) AS tp FROM f),
    h AS (SELECT *, count(*) FILTER (sh >= 0.8 AND rd = tp) OVER (PARTITION BY e) AS tops FROM g), r AS (SELECT *, CASE WHEN fst AND named THEN 'name' WHEN fst AND equal > 0 THEN 'values' WHEN NOT anyone AND sh >= 0.8 AND (likes = 1 OR (rd = tp AND tops = 1)) THEN 'sheets' END AS how FROM h)
    SELECT e::BIGINT AS engagement_id, link, how, equal, round(sh, 6) AS sheet_share FROM r WHERE how IS NOT NULL""")
def j20_choice(spark, sf):
    """Four links an engagement: chosen by name, by values, or by sheets and reads, by engagement."""
    c = _j20(spark, sf).withColumn("engagement_id", F.floor(F.col("workbook_id") / 4))
    w, e = F.col("workbook_id"), F.col("engagement_id")
    own = F.when((w % 4 == 2) & (F.col("sheet") == "A"), "Z").when((w % 4 == 2) & (F.col("sheet") == "N"), "Y").otherwise(F.col("sheet"))
    books = c.groupBy("engagement_id", w.alias("link")).agg(F.collect_set(own).alias("sheets")).withColumn("name", F.when((F.col("link") % 4 == 3) & (e % 3 == 0), "model").otherwise(F.concat(F.lit("book "), F.col("link").cast("string"))))
    cached = c.select("engagement_id", w.alias("link"), "sheet", "row_no", "col", (F.col("value") + F.when(e % 3 == 2, 1000).otherwise(0)).alias("value"))
    client = c.where(w % 4 == 1).select("engagement_id", F.lit("model").alias("name"), "sheet", "row_no", "col", "value")
    reads = books.select("engagement_id", "link", F.when(F.col("link") % 4 == 0, 5).when(F.col("link") % 4 == 1, 5 + e % 2).otherwise(2).alias("cells"))
    return cells.choose_link(books, cached, client, reads)


@query("a16_link_reads", f"WITH {_C} SELECT workbook_id AS link, count(*)::BIGINT AS cells, count(*) FILTER (value <> 0)::BIGINT AS nonzero FROM c GROUP BY 1")
def a16(spark, sf):
    return cells.link_reads(_cells(spark, sf).withColumnRenamed("workbook_id", "link"))


@query("j26_selectors", "SELECT key, before, after, CASE WHEN after IS NULL THEN 'gone' WHEN before IS NULL THEN 'new' WHEN before = after THEN 'same' ELSE 'differs' END AS change FROM (SELECT p_partkey AS key, p_size AS before FROM part WHERE p_partkey % 7 <> 0) FULL JOIN (SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS after FROM part WHERE p_partkey % 5 <> 0) USING (key)")
def j26(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("setting"))
    return cells.compare_selectors(p.where("key % 7 <> 0"), p.where("key % 5 <> 0").withColumn("setting", F.when(F.col("key") % 3 == 0, F.col("setting") + 1).otherwise(F.col("setting"))))


@query("j18_date_facts", """WITH f AS (SELECT o_custkey AS engagement_id, o_orderkey AS fact_id, o_orderdate::DATE + (o_orderkey % 3)::INT AS d FROM orders), c AS (SELECT o_custkey AS engagement_id, o_orderdate::DATE + (o_orderkey % 2)::INT AS d, o_orderkey % 3 = 0 AS valu FROM orders)
    SELECT engagement_id, fact_id, count(*)::BIGINT AS cells, count(*) FILTER (valu)::BIGINT AS located FROM f JOIN c USING (engagement_id, d) GROUP BY 1, 2""")
def j18(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("d", F.to_date("o_orderdate"))
    k = F.col("o_orderkey")
    f = o.select(F.col("o_custkey").alias("engagement_id"), k.alias("fact_id"), F.date_add("d", (k % 3).cast("int")).alias("fact_date"))
    c = o.select(F.col("o_custkey").alias("engagement_id"), F.date_add("d", (k % 2).cast("int")).alias("cell_date"), F.when(k % 3 == 0, "Valuation date").otherwise("Date").alias("label"))
    return cells.date_facts(f, c)


@query("g6_key_outputs", f"""{cte('model_edges', 'model_points', 'model_points_now')}, ch AS (SELECT o.workbook_id, o.row_no AS node, count(*)::BIGINT AS changed, arg_min(o.value, o.period_end) AS old, arg_min(n.value, o.period_end) AS new FROM model_points o JOIN model_points_now n USING (workbook_id, row_no, period_end) WHERE abs(o.value - n.value) > 1e-9 * greatest(1, abs(o.value), abs(n.value)) GROUP BY ALL),
    r AS (SELECT DISTINCT workbook_id, dst AS node, 1 AS rd FROM model_edges), u AS (SELECT workbook_id, src AS node, count(DISTINCT dst) AS up FROM model_edges GROUP BY ALL)
    SELECT workbook_id, node, (row_number() OVER w)::INT AS place, changed, coalesce(up, 0)::BIGINT AS upstream, coalesce(rd, 0)::INT AS is_read, round(CASE WHEN old <> 0 THEN (new / old - 1) * 100 END, 6) AS pct FROM ch LEFT JOIN r USING (workbook_id, node) LEFT JOIN u USING (workbook_id, node)
    WINDOW w AS (PARTITION BY workbook_id ORDER BY coalesce(rd, 0), coalesce(up, 0) DESC, changed DESC, node) QUALIFY row_number() OVER w <= 40""")
def g6(spark, sf):
    from fleetroll.operators.checks import close

    old, new = view(spark, sf, "model_points"), view(spark, sf, "model_points_now").withColumnRenamed("value", "new")
    d = old.join(new, ["workbook_id", "row_no", "period_end"]).where(~close(F.col("value"), F.col("new")))
    ch = d.groupBy("workbook_id", F.col("row_no").alias("node")).agg(F.count("*").alias("changed"), F.min_by("value", "period_end").alias("old"), F.min_by("new", "period_end").alias("new"))
    return cells.key_outputs(ch, view(spark, sf, "model_edges")).withColumn("pct", F.round("pct", 6))


@query("g7_parts", """WITH e AS (SELECT 1000000 + c_nationkey AS src, c_custkey AS dst, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE 1.0 END AS sign FROM customer UNION ALL SELECT 2000000 + n_regionkey, 1000000 + n_nationkey, 1.0 FROM nation)
    SELECT 2000000 + n_regionkey AS root, c_custkey AS node, 2 AS level, round(CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE 1.0 END * c_acctbal, 4) AS part FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def g7(spark, sf):
    c, n = spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/nation.parquet")
    e = c.select((1000000 + F.col("c_nationkey")).cast("long").alias("src"), F.col("c_custkey").alias("dst"), F.when(F.col("c_custkey") % 3 == 0, -1.0).otherwise(1.0).alias("sign"))
    e = e.union(n.select((2000000 + F.col("n_regionkey")).cast("long"), (1000000 + F.col("n_nationkey")).cast("long"), F.lit(1.0)))
    roots = n.select((2000000 + F.col("n_regionkey")).cast("long").alias("node")).distinct()
    return cells.parts(e, c.select(F.col("c_custkey").alias("node"), F.col("c_acctbal").alias("value")), roots, 2).withColumn("part", F.round("part", 4))


@query("v24_share_check", "WITH r AS (SELECT c_custkey AS e, c_custkey % 100 / 100 AS reported, c_custkey % 100 / 100 + c_acctbal / 5e9 AS applied FROM customer) SELECT e AS engagement_id, CASE WHEN e % 5 = 0 THEN 'missing' WHEN abs(reported - applied) <= 1e-6 THEN 'ok' ELSE 'differs' END AS status FROM r")
def v24(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("engagement_id"), (F.col("c_custkey") % 100 / 100).alias("reported"), F.col("c_acctbal").alias("a"))
    a = c.where("engagement_id % 5 <> 0").select("engagement_id", (F.col("reported") + F.col("a") / 5e9).alias("applied"))
    return cells.share_check(c.drop("a"), a).select("engagement_id", "status")


@query("a9_overview", """WITH n AS (SELECT o_custkey AS e, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_totalprice > 450000)::BIGINT AS blocks, count(*) FILTER (o_orderpriority = '5-LOW')::BIGINT AS checks FROM orders GROUP BY 1),
    s AS (SELECT o_custkey AS e, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 400000) AS r, bool_and(o_orderstatus = 'F') AS d FROM orders WHERE o_custkey % 6 <> 0 GROUP BY 1)
    SELECT c_custkey AS engagement_id, CASE WHEN s.e IS NULL THEN 'empty' WHEN coalesce(blocks, 0) > 0 THEN 'needs you' WHEN r > 0 THEN 'running' WHEN d THEN 'finished' ELSE 'waiting' END AS state, coalesce(blocks, 0)::BIGINT AS blocks, coalesce(checks, 0)::BIGINT AS checks FROM customer LEFT JOIN n ON n.e = c_custkey LEFT JOIN s ON s.e = c_custkey""")
def a9(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    e = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("engagement_id"))
    sev = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 450000), "block").when(F.col("o_orderpriority") == "5-LOW", "check").otherwise("note")
    st = F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000), "running").when(F.col("o_orderstatus") == "F", "done").otherwise("open")
    k = F.col("o_custkey").alias("engagement_id")
    return cells.overview(e, o.select(k, sev.alias("severity")), o.where("o_custkey % 6 <> 0").select(k, st.alias("state")))


@query("x20_json_fields", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def x20(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("s5_workpaper", f"{cte('flows')} SELECT core_id AS engagement_id, year(period_end)::INT AS step, min(cf) AS low, max(cf) AS high FROM flows GROUP BY 1, 2")
def s5(spark, sf):
    import uuid

    f = view(spark, sf, "flows").select((F.col("core_id") % 8).alias("engagement_id"), "core_id", F.year("period_end").alias("step"), "cf")
    b = f.groupBy("engagement_id", "core_id", "step").agg(F.min("cf").alias("low"), F.max("cf").alias("high"))
    long = b.select("engagement_id", F.struct("core_id", "step").alias("step"), F.explode(F.array(F.struct(F.lit("low").alias("end"), F.col("low").alias("value")), F.struct(F.lit("high").alias("end"), F.col("high").alias("value")))).alias("x")).select("engagement_id", "step", "x.*")
    path = f"{tables.shared_dir(spark)}/workpaper-{uuid.uuid4().hex}"
    tables.write_workpaper(long, path)
    return spark.read.parquet(path).select(F.col("step.core_id").alias("engagement_id"), F.col("step.step").alias("step"), "low", "high")
