"""Queries on shaping, search and rolling."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.operators import shape, value
from fleetroll.sources.adapters import cte, view

from .q_finance import _PV
from .registry import query

KEY = ["workbook_id", "sheet", "row_no"]
K = "workbook_id, sheet, row_no"
TERMS = {"the": r"\bthe\b", "digits": r"\d{3}", "licence": r"(?i)licen[cs]e", "question": r"\?"}


@query("t1_timeline", f"""{cte('series')}, c AS (SELECT workbook_id, sheet, row_no, (year(period_end) * 12 + month(period_end))::INT AS col FROM series), n AS (SELECT {K}, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 4),
    b AS (SELECT workbook_id, sheet, row_no FROM n QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY n DESC, row_no) = 1),
    g AS (SELECT {K}, min(col) AS tl_first, max(col) AS tl_last, count(*)::BIGINT AS periods FROM (SELECT c.*, col - row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY col) AS g FROM c JOIN b USING (workbook_id, sheet, row_no)) GROUP BY {K}, g)
    SELECT workbook_id, sheet, row_no AS header_row, tl_first, tl_last, periods FROM g WHERE periods >= 4 QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY periods DESC, tl_first) = 1""")
def t1(spark, sf):
    return shape.timeline(view(spark, sf, "series").select(*KEY, (F.year("period_end") * 12 + F.month("period_end")).alias("col")))


_TX = """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, 'S' AS sheet, p_partkey % 50 + 1 AS row_no, c AS col, CASE c WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN p_type END WHEN 2 THEN concat(p_name, ' ', p_type) WHEN 3 THEN CASE WHEN p_size % 5 = 0 THEN '$m' ELSE '%' END WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'A$' END ELSE p_name END AS text
    FROM {part} CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (11)) v(c)) k WHERE CASE c WHEN 1 THEN p_size % 3 = 0 WHEN 4 THEN p_size % 2 = 0 ELSE true END"""


@query("t1_text_columns", f"""WITH t AS ({_TX.format(part='part')}), l AS (SELECT * FROM t WHERE col < CASE WHEN workbook_id % 3 = 0 THEN 3 ELSE 1 + 8 END), c AS (SELECT workbook_id, sheet, col, count(*) AS n, avg(length(text)) AS ln, count(DISTINCT text) / count(*) AS d FROM l GROUP BY ALL),
    b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY round(n * least(ln, 20.0), 9) DESC, col) = 1), u AS (SELECT c.* FROM c JOIN b USING (workbook_id, sheet) WHERE c.col > b.col AND c.n >= 0.2 * b.n AND c.ln <= 12 AND c.d <= 0.6 QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY c.n DESC, c.col) = 1)
    SELECT workbook_id, sheet, b.col AS label_col, u.col AS units_col FROM b LEFT JOIN u USING (workbook_id, sheet)""")
def t1_text(spark, sf):
    t = spark.sql(_TX, part=spark.read.parquet(f"{sf}/part.parquet"))
    tl = t.select("workbook_id", "sheet").distinct().where("workbook_id % 3 = 0").withColumn("tl_first", F.lit(3))
    return shape.text_columns(t, tl)


@query("t2_periodicity", f"""{cte('series')}, g AS (SELECT {K}, median(gap) AS gap FROM (SELECT {K}, period_end - lag(period_end) OVER (PARTITION BY {K} ORDER BY period_end) AS gap FROM (SELECT {K}, CASE WHEN workbook_id % 2 = 0 THEN period_end ELSE last_day(make_date(year(period_end), (month(period_end) + 2) // 3 * 3, 1)) END AS period_end FROM series GROUP BY ALL)) WHERE gap IS NOT NULL GROUP BY ALL)
    SELECT {K}, gap, CASE WHEN gap BETWEEN 26 AND 33 THEN 'monthly' WHEN gap BETWEEN 85 AND 95 THEN 'quarterly' WHEN gap BETWEEN 178 AND 187 THEN 'semi-annual' WHEN gap BETWEEN 360 AND 370 THEN 'annual' ELSE 'irregular' END AS periodicity FROM g""")
def t2(spark, sf):
    d = F.col("period_end")
    return shape.periodicity(view(spark, sf, "series").withColumn("period_end", F.when(F.col("workbook_id") % 2 == 0, d).otherwise(F.last_day(F.make_date(F.year(d), F.quarter(d) * 3, F.lit(1))))), KEY)


@query("t5_series", """SELECT l_suppkey AS workbook_id, l_returnflag AS sheet, l_orderkey AS row_no, DATE '2020-01-31' + l_linenumber * 31 AS period_end, l_extendedprice AS value FROM lineitem WHERE l_linenumber < 6""")
def t5(spark, sf):
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("workbook_id"), F.col("l_returnflag").alias("sheet"), F.col("l_orderkey").alias("row_no"), F.col("l_linenumber").alias("col"), F.col("l_extendedprice").alias("value"))
    heads = cells.where("col < 6").select("workbook_id", "sheet", "col").distinct().withColumn("period_end", F.date_add(F.lit("2020-01-31").cast("date"), F.col("col") * 31))
    return shape.series(cells, heads)


_S = f"{cte('series')}, s AS (SELECT {K}, period_end, CASE workbook_id % 6 WHEN 0 THEN CASE WHEN period_end > DATE '1998-06-30' THEN 1.0 ELSE 0.0 END WHEN 1 THEN 0.3 WHEN 2 THEN 1.0 / (1 + (year(period_end) - 1994) * 0.1) WHEN 3 THEN value / 1e7 ELSE value END::DOUBLE AS value FROM series)"


def _shaped(spark, sf):
    w = F.col("workbook_id") % 6
    v = F.when(w == 0, F.when(F.col("period_end") > "1998-06-30", 1.0).otherwise(0.0)).when(w == 1, 0.3).when(w == 2, 1.0 / (1 + (F.year("period_end") - 1994) * 0.1)).when(w == 3, F.col("value") / 1e7).otherwise(F.col("value"))
    return view(spark, sf, "series").withColumn("value", v)


_T7 = """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey % 50 + 1 AS row_no, make_date(2020 + k, 12, 31) AS period_end,
    CASE WHEN p_size % 16 = 0 THEN NULL WHEN p_size % 16 = 1 AND k > 0 THEN NULL WHEN p_size % 16 = 2 THEN CASE WHEN k > 2 THEN 1.0 ELSE 0.0 END WHEN p_size % 16 = 3 THEN 0.35 WHEN p_size % 16 = 4 THEN 1.0 - 0.05 * k WHEN p_size % 16 = 5 THEN 1.0 + 0.025 * k WHEN p_size % 16 = 6 THEN p_retailprice / 1e5 * (k - 2) WHEN p_size % 16 IN (7, 8) THEN NULL ELSE p_retailprice * (k + 1) END AS value,
    CASE WHEN p_size % 16 = 7 THEN 'note' END AS text, CASE WHEN p_size % 16 = 8 THEN make_date(2020 + k, 6, 30) END AS date, CASE WHEN p_size % 16 = 9 THEN 'SUM(R[-4]C:R[-1]C)' WHEN p_size % 16 = 10 THEN '=R[-1]C + R[-2]C - R[-3]C' WHEN p_size % 16 = 11 AND k < 3 THEN NULL WHEN p_size % 16 = 12 THEN NULL ELSE 'RC[-1]*2' END AS formula
    FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(k)) x"""


@query("t7_row_kinds", """SELECT p_partkey // 50 AS workbook_id, p_partkey % 50 + 1 AS row_no, CASE p_size % 16 WHEN 0 THEN 'empty' WHEN 1 THEN 'figure' WHEN 2 THEN 'flags' WHEN 3 THEN 'share' WHEN 4 THEN 'factors' WHEN 5 THEN 'index' WHEN 6 THEN 'ratio' WHEN 7 THEN 'text' WHEN 8 THEN 'dates' WHEN 9 THEN 'subtotal' WHEN 10 THEN 'subtotal' WHEN 12 THEN 'inputs' ELSE 'series' END AS kind FROM part""")
def t7(spark, sf):
    return shape.row_kinds(spark.sql(_T7, part=spark.read.parquet(f"{sf}/part.parquet")), ["workbook_id", "row_no"])


@query("t7_series_kinds", f"""{_S}, a AS (SELECT {K}, count(*) AS n, bool_and(value IN (0, 1)) AS o, max(value) AS hi, min(value) AS lo, count(DISTINCT round(value, 12)) AS d, arg_min(value, period_end) AS f, arg_max(value, period_end) AS l, max(abs(value)) AS m,
      bool_and(b IS NULL OR value <= b + 1e-12) AS falling FROM (SELECT *, lag(value) OVER (PARTITION BY {K} ORDER BY period_end) AS b FROM s) GROUP BY ALL)
    SELECT {K}, CASE WHEN n = 1 THEN 'figure' WHEN n >= 4 AND o AND hi = 1 THEN 'flags' WHEN n >= 4 AND d = 1 AND lo > 0 AND hi < 1 THEN 'share' WHEN n >= 4 AND lo > 0 AND hi <= 1 AND f > 0.5 AND falling AND l < f THEN 'factors' WHEN n >= 4 AND m < 1 THEN 'ratio' ELSE 'series' END AS kind FROM a""")
def t7_series(spark, sf):
    return shape.row_kinds(_shaped(spark, sf), KEY)


@query("t9_blocks", f"""{cte('rows_prior')}, d AS (SELECT *, coalesce(row_no - lag(row_no) OVER w > 200 OR section <> lag(section) OVER w, true) AS nw FROM rows_prior WINDOW w AS (PARTITION BY workbook_id ORDER BY row_no)), e AS (SELECT *, sum(nw::INT) OVER (PARTITION BY workbook_id ORDER BY row_no) AS block FROM d)
    SELECT workbook_id, block::BIGINT AS block, min(row_no) AS first, max(row_no) AS last, count(*)::BIGINT AS n, string_agg(label, '|' ORDER BY row_no) AS labels FROM e GROUP BY 1, 2""")
def t9(spark, sf):
    return shape.blocks(view(spark, sf, "rows_prior"), ["workbook_id"], 200)


_T9 = """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey % 50 + 1 AS row_no, concat('Part ', CAST(floor(p_partkey % 50 / 12) AS INT)) AS section, p_name AS label, CASE WHEN p_size % 9 = 0 THEN 'empty' WHEN p_size % 9 = 1 THEN 'text' WHEN p_size % 9 < 6 THEN 'series' ELSE 'inputs' END AS kind,
    CASE WHEN p_size % 3 > 0 THEN concat('R[]C*', CAST(p_size % 3 AS STRING)) END AS shape FROM {part}"""


@query("t9_signed_blocks", f"""WITH r AS ({_T9.format(part='part').replace('AS STRING', 'AS VARCHAR')}), k AS (SELECT * FROM r WHERE kind NOT IN ('empty', 'text')),
    d AS (SELECT *, coalesce(row_no - lag(row_no) OVER w > 2 OR section <> lag(section) OVER w, true) AS nw FROM k WINDOW w AS (PARTITION BY workbook_id ORDER BY row_no)), e AS (SELECT *, sum(nw::INT) OVER (PARTITION BY workbook_id ORDER BY row_no) AS block FROM d)
    SELECT workbook_id, block::BIGINT AS block, any_value(section) AS section, min(row_no) AS first, max(row_no) AS last, count(*)::BIGINT AS n, string_agg(kind || '|' || trim(regexp_replace(lower(label), '[^a-z]+', ' ', 'g')), ';' ORDER BY row_no) AS by_label, string_agg(kind || '|' || coalesce(shape, ''), ';' ORDER BY row_no) AS by_shape FROM e GROUP BY 1, 2""")
def t9_signed(spark, sf):
    b = shape.signed_blocks(spark.sql(_T9, part=spark.read.parquet(f"{sf}/part.parquet")), ["workbook_id"])
    return b.withColumns({"by_label": F.array_join("by_label", ";"), "by_shape": F.array_join("by_shape", ";")})


@query("t12_period_ends", """WITH s AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS start FROM orders), n AS (SELECT *, lead(start) OVER (PARTITION BY o_custkey ORDER BY start) AS nx FROM s),
    m AS (SELECT *, max(datediff('month', start, nx)) OVER (PARTITION BY o_custkey) AS mo FROM n) SELECT o_custkey, start, (coalesce(nx, (start + to_months(mo::INT))::DATE) - 1)::DATE AS period_end FROM m""")
def t12(spark, sf):
    s = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", F.trunc(F.to_date("o_orderdate"), "month").alias("start")).distinct()
    return shape.period_ends(s, ["o_custkey"])


#: A sheet of a customer's orders: a header of dates, a row of ends by label in some, months' firsts or lasts.
_T12 = "SELECT o_custkey AS sheet, CAST(o_orderkey AS INT) AS col, CASE WHEN o_custkey % 3 = 0 THEN last_day(CAST(o_orderdate AS DATE)) ELSE CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) END AS head, CAST(o_orderdate AS DATE) AS d, o_custkey % 4 = 1 AND (o_custkey % 8 = 1 OR o_orderkey % 2 = 0) AS ended FROM {orders}"


@query("t12_sheet_ends", f"""WITH h AS ({_T12.format(orders='orders')}), g AS (SELECT sheet, count(*) AS n, count(*) FILTER (ended) AS m, bool_and(day(head) = 1) AS st FROM h GROUP BY 1),
    u AS (SELECT DISTINCT sheet, head FROM h), n AS (SELECT *, lead(head) OVER (PARTITION BY sheet ORDER BY head) AS nx FROM u), l AS (SELECT sheet, list_sort(list(nx - head) FILTER (nx IS NOT NULL)) AS gs FROM n GROUP BY 1),
    k AS (SELECT sheet, greatest(1, round(coalesce(gs[len(gs) // 2 + 1], 91) / 30.44)::INT) AS mo FROM l)
    SELECT h.sheet, col, CASE WHEN m >= 0.8 * g.n THEN CASE WHEN ended THEN last_day(d) END WHEN st THEN (coalesce(nx, (h.head + to_months(mo))::DATE) - 1)::DATE ELSE h.head END AS period_end, CASE WHEN m >= 0.8 * g.n THEN 'row' WHEN st THEN 'starts' ELSE 'header' END AS how
    FROM h JOIN g USING (sheet) JOIN n ON n.sheet = h.sheet AND n.head = h.head JOIN k ON k.sheet = h.sheet WHERE NOT (m >= 0.8 * g.n AND NOT ended)""")
def t12_sheet(spark, sf):
    h = spark.sql(_T12, orders=spark.read.parquet(f"{sf}/orders.parquet"))
    header = h.select("sheet", "col", F.col("head").alias("date"))
    named = h.where("ended").select("sheet", F.lit(7).alias("row_no"), F.lit("Period end date").alias("label"), "col", F.last_day("d").alias("date"))
    other = h.select("sheet", F.lit(3).alias("row_no"), F.lit("Signed on").alias("label"), "col", F.col("d").alias("date"))
    return shape.sheet_ends(header, named.union(other), ["sheet"])


@query("t13_timing_rule", f"""{_S}, g AS (SELECT {K}, count(*) AS n, bool_and(value = CASE WHEN period_end > DATE '1998-06-30' THEN 1 ELSE 0 END) AS a, bool_and(value = CASE WHEN period_end > DATE '1998-06-30' THEN 0 ELSE 1 END) AS b, min(value) = max(value) AS c FROM s GROUP BY ALL)
    SELECT {K}, CASE WHEN n < 2 THEN NULL WHEN a THEN 'after' WHEN b THEN 'up to' WHEN c THEN 'constant' END AS rule FROM g""")
def t13(spark, sf):
    return shape.timing_rules(_shaped(spark, sf), F.lit("1998-06-30").cast("date"), KEY, ["workbook_id", "sheet"]).select(*KEY, "rule")


#: Rows of parts by what their values are; periods are years' ends, or years' starts in every third workbook.
_T13 = """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, 'S' AS sheet, p_partkey % 50 + 1 AS row_no, k, p_partkey % 13 AS c, p_size AS z, CASE WHEN CAST(floor(p_partkey / 50) AS BIGINT) % 3 = 0 THEN make_date(2020 + k, 1, 1) ELSE make_date(2019 + k, 12, 31) END AS period_end
    FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(k)) x"""


@query("t13_timing_rules", f"""WITH r AS (SELECT DISTINCT workbook_id, sheet, row_no, c, z, workbook_id % 3 = 0 AS st FROM ({_T13.format(part="part")}) q)
    SELECT workbook_id, sheet, row_no, CASE c WHEN 0 THEN 'date' WHEN 1 THEN CASE WHEN st THEN 'end' ELSE 'date' END WHEN 2 THEN CASE WHEN st THEN 'date' ELSE 'start' END WHEN 3 THEN 'year' WHEN 4 THEN 'after' WHEN 5 THEN 'up to' WHEN 6 THEN 'constant' WHEN 7 THEN 'own dates' WHEN 8 THEN 'own dates' WHEN 9 THEN 'own years' END AS rule,
      CASE WHEN c = 3 THEN z % 3 - 1 END::INT AS "offset", CASE c WHEN 7 THEN 3 WHEN 8 THEN 6 WHEN 9 THEN 12 END::INT AS months FROM r""")
def t13_rules(spark, sf):
    """Every rule, and rows near one: a date of one period off, years with a gap, dates of uneven months."""
    p = spark.sql(_T13, part=spark.read.parquet(f"{sf}/part.parquet"))
    c, k, t = F.col("c"), F.col("k"), F.col("period_end")
    starts = F.dayofmonth(t) == 1
    end, start = F.when(starts, F.date_sub(F.add_months(t, 12), 1)).otherwise(t), F.when(starts, t).otherwise(F.date_add(F.add_months(t, -12), 1))
    own = lambda first, months: shape.serial(F.last_day(F.add_months(F.lit(first).cast("date"), months)))
    flag = F.when(end > "2022-06-30", 1.0).otherwise(0.0)
    values = [
        shape.serial(t), shape.serial(end), shape.serial(start), F.year(end) + F.col("z") % 3 - 1, flag, 1 - flag, F.col("z") + 2, own("2030-01-31", 3 * k), own("2030-02-28", 6 * k - F.when(k == 5, 2).otherwise(0)),
        2001 + k, shape.serial(t) + F.when(k == 3, 1).otherwise(0), 2001 + k + F.when(k > 2, 1).otherwise(0), own("2030-01-31", k * (k + 1)),
    ]
    v = F.coalesce(*[F.when(c == i, x.cast("double")) for i, x in enumerate(values)])
    return shape.timing_rules(p.withColumn("value", v), F.lit("2022-06-30").cast("date"), KEY, ["workbook_id", "sheet"])


@query("t16_phases", f"""{cte('series')}, p AS (SELECT workbook_id, sheet, period_end, CASE WHEN period_end <= DATE '1996-12-31' THEN 'Actual' WHEN year(period_end) % 2 = 0 THEN 'Budget' ELSE 'Forecast' END AS phase FROM series WHERE row_no = 1),
    q AS (SELECT *, sum(CASE WHEN phase = lg THEN 0 ELSE 1 END) OVER (PARTITION BY workbook_id, sheet ORDER BY period_end) AS g FROM (SELECT *, lag(phase) OVER (PARTITION BY workbook_id, sheet ORDER BY period_end) AS lg FROM p)),
    s AS (SELECT workbook_id, sheet, g, phase, min(period_end) AS first_end, max(period_end) AS last_end, count(*)::BIGINT AS periods FROM q GROUP BY ALL)
    SELECT workbook_id, sheet, phase, first_end, last_end, periods FROM s QUALIFY count(*) OVER (PARTITION BY workbook_id, sheet) > 1""")
def t16(spark, sf):
    d = view(spark, sf, "series").where("row_no = 1").withColumn("value", F.lit(1.0))
    label = F.when(F.col("period_end") <= "1996-12-31", "Actual").when(F.year("period_end") % 2 == 0, "Budget").otherwise("Forecast")
    return shape.phases(d.withColumn("label", label), ["workbook_id", "sheet"])


@query("f1_find", f"{cte('rows_prior')} SELECT workbook_id, sheet, row_no, label FROM rows_prior WHERE lower(label) LIKE '%red w%' OR regexp_replace(lower(label), '[ _./&()''-]', '', 'g') LIKE '%redw%' QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY sheet, row_no) <= 50")
def f1(spark, sf):
    return shape.find(view(spark, sf, "rows_prior"), "Red w").select("workbook_id", "sheet", "row_no", "label")


@query("f2_ranked", f"""{cte('rows_prior')}, q AS (SELECT DISTINCT query, unnest(string_split(query, ' ')) AS w FROM (VALUES ('small ring'), ('red widget of'), ('blue')) v(query)), r AS (SELECT DISTINCT sheet, row_no, unnest(string_split(lower(label), ' ')) AS w FROM rows_prior)
    SELECT query, sheet, row_no, count(*)::BIGINT AS hits FROM q JOIN r USING (w) WHERE length(w) >= 3 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, sheet, row_no) <= 10""")
def f2(spark, sf):
    q = spark.createDataFrame([("small ring",), ("red widget of",), ("blue",)], "query string")
    return shape.ranked(view(spark, sf, "rows_prior").select("sheet", "row_no", "label"), q)


_TAGS = " UNION ALL ".join(f"SELECT source, '{t}' AS term, doc_id FROM documents WHERE regexp_matches(text, '{p}')" for t, p in TERMS.items())


@query("f3_tag_terms", f"SELECT source, term, min(doc_id) AS first_place, count(*)::BIGINT AS times FROM ({_TAGS}) GROUP BY 1, 2")
def f3(spark, sf):
    return shape.tag_terms(spark.read.parquet(f"{sf}/documents.parquet"), TERMS, "source", "doc_id")


_T = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '([a-z][a-z0-9]+)', 1), lambda x: x NOT IN ('the', 'and', 'of', 'for', 'to', 'in')))"
_FACTS = """SELECT o_custkey AS engagement_id, o_orderkey AS fact_id, concat('The ', o_orderpriority, ' value of order status ', o_orderstatus) AS label,
    CASE o_orderkey % 5 WHEN 0 THEN '%' WHEN 1 THEN '$bn' WHEN 2 THEN 'AUD m' WHEN 3 THEN '$''000' ELSE '' END AS unit, CASE WHEN o_orderkey % 2 = 0 THEN 'conclusion' ELSE 'assumption' END AS category,
    round(o_totalprice / CASE o_orderkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 1000000 WHEN 2 THEN 1000 WHEN 3 THEN 1000 ELSE 1 END, 1) AS v FROM {orders}"""
_CELLS = """SELECT o_custkey AS engagement_id, o_orderkey AS cell_id, concat(o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN ' value' ELSE '' END) AS label,
    CASE WHEN o_orderkey % 4 = 1 THEN -o_totalprice ELSE o_totalprice END AS value, o_orderkey % 3 = 0 AS is_formula, o_orderkey % 7 = 0 AS is_anchor FROM {orders}"""


@query("j17_facts_to_cells", f"""WITH f AS ({_FACTS.format(orders="orders")}), c AS ({_CELLS.format(orders="orders")}), p AS (SELECT engagement_id, fact_id, {_T('label')} AS want, unit, category = 'conclusion' AS result, part, v + d AS x FROM f, (VALUES ('value', 0.0), ('low', -1.5), ('high', 1.5)) k(part, d) WHERE part = 'value' OR fact_id % 4 = 0),
    s AS (SELECT * EXCLUDE (sc, unit), unnest(sc) AS scale FROM (SELECT *, CASE WHEN unit = '%' THEN [0.01, 1.0] WHEN unit = '$bn' THEN [1.0, 1e3, 1e6, 1e9] WHEN unit = 'AUD m' THEN [1.0, 1e3, 1e6] WHEN unit = '$''000' THEN [1.0, 1e3] ELSE [1.0] END AS sc FROM p WHERE x >= 0)),
    h AS (SELECT s.engagement_id, fact_id, cell_id, part, scale::DOUBLE AS scale, sign::INT AS sign, len(list_intersect(want, {_T('label')})) / greatest(1, len(want)) AS overlap, is_formula = result AS kind, is_anchor FROM s, (VALUES (1), (-1)) g(sign), c WHERE c.engagement_id = s.engagement_id AND value <> 0 AND abs(value - sign * x * scale) <= 0.05 * scale + 1e-9 * abs(value) AND value BETWEEN least(sign * (x - 0.05) * scale, sign * (x + 0.05) * scale) AND greatest(sign * (x - 0.05) * scale, sign * (x + 0.05) * scale)),
    q AS (SELECT *, round(3 * overlap + CASE WHEN is_anchor THEN 1.5 ELSE 0 END + CASE WHEN kind THEN 0.5 ELSE 0 END + CASE WHEN sign = 1 THEN 0.5 ELSE 0 END + CASE WHEN part = 'value' THEN 0.3 ELSE 0 END, 2)::DOUBLE AS score, overlap > 0 OR is_anchor AS located, count(*) OVER (PARTITION BY engagement_id, fact_id)::BIGINT AS n FROM h)
    SELECT engagement_id, fact_id, (row_number() OVER w)::INT AS place, cell_id, part, scale, sign, score, located, n FROM q WINDOW w AS (PARTITION BY engagement_id, fact_id ORDER BY score DESC, cell_id, part, scale, sign DESC) QUALIFY row_number() OVER w <= 5""")
def j17(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    f = spark.sql(_FACTS, orders=o)
    part = lambda d, ok: F.when(ok & (F.col("v") + d >= 0), F.concat(F.lit("about $"), F.format_number(F.col("v") + d, 1)))
    some = F.col("fact_id") % 4 == 0
    f = f.withColumns({"value_text": part(0.0, F.lit(True)), "low_text": part(-1.5, some), "high_text": part(1.5, some)})
    return shape.facts_to_cells(f, spark.sql(_CELLS, orders=o))


@query("j23_rolled", f"""{cte('series', 'series_now')}, m AS (SELECT DISTINCT {K}, sheet AS cur_sheet, row_no AS cur_row FROM series WHERE workbook_id % 11 <> 4), l AS (SELECT {K}, max(period_end) AS last FROM series_now GROUP BY ALL),
    d AS (SELECT p.*, m.cur_row, last_day((p.period_end + INTERVAL 12 MONTH)::DATE) AS to_end FROM series p LEFT JOIN m USING (workbook_id, sheet, row_no)),
    e AS (SELECT d.*, c.value AS v, x.value AS same, last FROM d LEFT JOIN series_now c ON c.workbook_id = d.workbook_id AND c.sheet = d.sheet AND c.row_no = d.cur_row AND c.period_end = d.to_end LEFT JOIN series_now x ON x.workbook_id = d.workbook_id AND x.sheet = d.sheet AND x.row_no = d.cur_row AND x.period_end = d.period_end LEFT JOIN l ON l.workbook_id = d.workbook_id AND l.sheet = d.sheet AND l.row_no = d.cur_row)
    SELECT {K}, period_end, to_end, how, CASE how WHEN 'rolled' THEN v WHEN 'beyond' THEN 0.0 WHEN 'stand-in' THEN same END AS rolled FROM (SELECT *, CASE WHEN cur_row IS NULL THEN 'no match' WHEN v IS NOT NULL THEN 'rolled' WHEN to_end > last THEN 'beyond' WHEN same IS NOT NULL THEN 'stand-in' ELSE 'missing' END AS how FROM e)""")
def j23(spark, sf):
    p = view(spark, sf, "series")
    m = p.where("workbook_id % 11 <> 4").select(*KEY, F.col("sheet").alias("cur_sheet"), F.col("row_no").alias("cur_row")).distinct()
    return shape.rolled(p, view(spark, sf, "series_now"), m, 12)


@query("v13_reconcile", f"""{_PV}, c AS (SELECT core_id, CASE WHEN period_end <= DATE '2000-12-31' THEN 'f' ELSE 't' END AS part, sum(cf * factor) AS computed FROM f GROUP BY 1, 2),
    p AS (SELECT core_id, part, computed, CASE core_id % 5 WHEN 0 THEN printf('%,.2f', computed) WHEN 1 THEN printf('%.1f', computed / 1000) WHEN 2 THEN printf('%,.0f', computed / 1000) WHEN 3 THEN printf('%.1f', computed / 1000 + CASE part WHEN 'f' THEN 0.2 ELSE 0 END) ELSE printf('%.1f', computed / 7) END AS printed FROM c),
    q AS (SELECT *, replace(printed, ',', '')::DOUBLE AS x, length(regexp_extract(printed, '\\.(\\d+)', 1)) AS d FROM p),
    t AS (SELECT core_id, i, scale, count(*) FILTER (abs(computed * scale - x) <= 0.5 * power(10.0, -d) + 1e-9)::BIGINT AS ties FROM q, (VALUES (0, 1.0::DOUBLE), (1, 1e-3), (2, 1e-6), (3, 1e3)) s(i, scale) GROUP BY 1, 2, 3)
    SELECT core_id, scale, ties FROM t QUALIFY row_number() OVER (PARTITION BY core_id ORDER BY ties DESC, i) = 1""")
def v13(spark, sf):
    """Printed in units and thousands, to hundredths, tenths and whole numbers; one part off by two tenths; and none that ties."""
    from fleetroll.operators import fin

    f = fin.factors(view(spark, sf, "flows"), view(spark, sf, "discountings"))
    c = f.groupBy("core_id", F.when(F.col("period_end") <= "2000-12-31", "f").otherwise("t").alias("part")).agg(F.sum(F.col("cf") * F.col("factor")).alias("computed"))
    k, x = F.col("core_id") % 5, F.col("computed")
    off = F.when(F.col("part") == "f", 0.2).otherwise(0.0)
    printed = F.when(k == 0, F.format_string("%,.2f", x)).when(k == 1, F.format_string("%.1f", x / 1000)).when(k == 2, F.format_string("%,.0f", x / 1000)).when(k == 3, F.format_string("%.1f", x / 1000 + off)).otherwise(F.format_string("%.1f", x / 7))
    return value.reconcile(c.withColumn("printed", printed))
