"""Queries on a workbook's structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.operators import evidence, structure
from fleetroll.sources.adapters import cte, view
from fleetroll.sources.tables import written

from .registry import query

W = "CAST(floor(p_partkey / 50) AS BIGINT)"

# six columns of one row of part; headers in row 1; some rows have formulas, some lack a column
_TC = f"""SELECT {W} AS workbook_id, 'T' AS sheet, p_partkey % 50 + 1 AS row_no, c AS col,
    CASE WHEN c = 2 AND p_partkey % 50 > 0 THEN p_retailprice WHEN c = 4 AND p_partkey % 50 > 0 AND p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS num, CASE WHEN c = 3 AND p_partkey % 50 > 0 THEN make_date(2000 + p_size, 6, 30) END AS date,
    CASE WHEN p_partkey % 50 = 0 THEN concat('head ', CAST(c AS STRING)) WHEN c = 1 THEN p_name WHEN c = 4 AND p_size % 3 = 0 THEN 'n/a' END AS text, CASE WHEN p_size = 41 AND c = 2 THEN 'RC[1]' END AS formula
    FROM {{part}} CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4)) v(c)) k WHERE NOT (c = 4 AND p_size = 17)"""
_DUCK = lambda s: s.replace("AS STRING", "AS VARCHAR").format(part="part")


@query("t6_table_profile", f"""WITH c AS ({_DUCK(_TC)}), r AS (SELECT workbook_id, sheet, row_no, string_agg(col, ',' ORDER BY col) AS cols, bool_and(text IS NOT NULL) AS texts FROM c GROUP BY 1, 2, 3 HAVING count(formula) = 0),
    i AS (SELECT *, row_no - row_number() OVER (PARTITION BY workbook_id, sheet, cols ORDER BY row_no) AS run FROM r), n AS (SELECT *, count(*) OVER t AS n, row_number() OVER (PARTITION BY workbook_id, sheet, cols, run ORDER BY row_no) AS pos, lead(texts) OVER (PARTITION BY workbook_id, sheet, cols, run ORDER BY row_no) AS nx, min(row_no) OVER t AS first FROM i WINDOW t AS (PARTITION BY workbook_id, sheet, cols, run)),
    h AS (SELECT *, pos = 1 AND texts AND NOT coalesce(nx, true) AS head FROM n WHERE n >= 5), b AS (SELECT *, bool_or(head) OVER (PARTITION BY workbook_id, sheet, cols, run) AS header FROM h), v AS (SELECT c.*, first, header FROM c JOIN b USING (workbook_id, sheet, row_no) WHERE NOT head),
    s AS (SELECT workbook_id, sheet, first, col, text, min(row_no) AS pos FROM v WHERE text IS NOT NULL GROUP BY ALL), e AS (SELECT workbook_id, sheet, first, col, count(*) AS d, list(text ORDER BY pos, text)[1:5] AS eg FROM s GROUP BY ALL),
    g AS (SELECT workbook_id, sheet, first, col, header, count(*)::BIGINT AS rows, CASE WHEN count(date) = count(*) THEN 'date' WHEN count(num) = count(*) THEN 'number' ELSE 'text' END AS kind, min(date) AS d0, max(date) AS d1, min(num) AS n0, max(num) AS n1 FROM v GROUP BY ALL)
    SELECT workbook_id, sheet, first AS first_row, col, header, rows, kind, CASE kind WHEN 'date' THEN d0::VARCHAR WHEN 'number' THEN n0::VARCHAR END AS low, CASE kind WHEN 'date' THEN d1::VARCHAR WHEN 'number' THEN n1::VARCHAR END AS high,
      CASE WHEN kind = 'text' THEN coalesce(d, 0) END::BIGINT AS "distinct", CASE WHEN kind = 'text' THEN array_to_string(eg, ', ') END AS examples FROM g LEFT JOIN e USING (workbook_id, sheet, first, col)""")
def t6(spark, sf):
    return structure.table_profile(spark.sql(_TC, part=spark.read.parquet(f"{sf}/part.parquet")), 5)


@query("t10_block_copies")
def t10(spark, sf):
    """Ordered covers aren't SQL; a test holds them against all pairs."""
    r = view(spark, sf, "model_rows").withColumn("block", F.floor((F.col("row_no") - 1) / 5))
    word = F.concat_ws("|", (F.col("row_no") % 2).cast("string"), F.substring_index("label", " ", 1))
    shape = F.concat_ws("|", (F.length("label") % 2).cast("string"), (F.length("section") % 2).cast("string"))
    b = r.groupBy("workbook_id", "block").agg(F.array_sort(F.collect_list(F.struct("row_no", word.alias("l"), shape.alias("s")))).alias("x"))
    return structure.block_copies(b.select("workbook_id", "block", F.transform("x", lambda x: x["l"]).alias("by_label"), F.transform("x", lambda x: x["s"]).alias("by_shape")))


@query("t11_fy_end", f"""{cte('model_points')}, w AS (SELECT DISTINCT workbook_id, CASE WHEN workbook_id % 9 = 0 THEN 3 END AS profile, CASE WHEN workbook_id % 2 = 0 THEN 9 END AS hint FROM model_points),
    p AS (SELECT {W} AS workbook_id, p_partkey % 50 + 1 AS row_no, p_name, p_size FROM part), nm AS (SELECT workbook_id, arg_min(p_size, p_name) AS v FROM (SELECT workbook_id, concat('FY_End_Month_', row_no) AS p_name, p_size FROM p WHERE row_no % 10 = 4 AND workbook_id % 4 = 1) WHERE p_size BETWEEN 1 AND 12 GROUP BY 1),
    lb AS (SELECT workbook_id, arg_min(p_size, row_no) AS v FROM p WHERE row_no % 20 = 7 AND workbook_id % 3 = 1 AND p_size BETWEEN 1 AND 12 GROUP BY 1),
    d AS (SELECT DISTINCT workbook_id, sheet, (period_end - to_months((CASE WHEN sheet = 'S0' THEN 6 WHEN workbook_id % 5 = 0 THEN row_no % 2 ELSE 0 END)::INT))::DATE AS pe FROM model_points WHERE workbook_id % 7 <> 3), g AS (SELECT *, pe - lag(pe) OVER (PARTITION BY workbook_id, sheet ORDER BY pe) AS gap FROM d),
    a AS (SELECT workbook_id, sheet FROM g GROUP BY 1, 2 HAVING count(*) >= 3 AND bool_and(gap BETWEEN 330 AND 400)), o AS (SELECT workbook_id, sheet, month(pe) AS m, count(*) AS n FROM g SEMI JOIN a USING (workbook_id, sheet) GROUP BY ALL), b AS (SELECT workbook_id, m FROM o QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet ORDER BY n DESC, m) = 1),
    t AS (SELECT workbook_id, m, count(*) AS n FROM b GROUP BY ALL), tl AS (FROM t QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY n DESC, m) = 1)
    SELECT workbook_id, coalesce(profile, nm.v, lb.v, tl.m, hint, 12)::INT AS month, CASE WHEN profile IS NOT NULL THEN 'profile' WHEN nm.v IS NOT NULL THEN 'named' WHEN lb.v IS NOT NULL THEN 'labelled' WHEN tl.m IS NOT NULL THEN 'timeline' WHEN hint IS NOT NULL THEN 'hint' ELSE 'default' END AS how
    FROM w LEFT JOIN nm USING (workbook_id) LEFT JOIN lb USING (workbook_id) LEFT JOIN tl USING (workbook_id)""")
def t11(spark, sf):
    s = view(spark, sf, "model_points")
    k = F.col("workbook_id")
    w = s.select("workbook_id").distinct().select("workbook_id", F.when(k % 9 == 0, 3).alias("profile"), F.when(k % 2 == 0, 9).alias("hint"))
    p = spark.sql(f"SELECT {W} AS workbook_id, p_partkey % 50 + 1 AS row_no, p_size FROM {{part}}", part=spark.read.parquet(f"{sf}/part.parquet"))
    names = p.where("row_no % 10 = 4 and workbook_id % 4 = 1").select("workbook_id", F.concat(F.lit("FY_End_Month_"), F.col("row_no").cast("string")).alias("name"), F.col("p_size").alias("value"))
    rows = p.select("workbook_id", "row_no", F.when((F.col("row_no") % 20 == 7) & (k % 3 == 1), "Financial year end month").otherwise("Other").alias("label"), F.col("p_size").alias("value"))
    back = F.when(F.col("sheet") == "S0", 6).when(k % 5 == 0, (F.col("row_no") % 2).cast("int")).otherwise(0)
    d = s.where("workbook_id % 7 <> 3").select("workbook_id", "sheet", F.add_months("period_end", -back).alias("period_end"))
    return structure.fy_end(w, names, rows, d)


_RT = f"""SELECT {W} AS workbook_id, 'S' AS sheet, p_partkey % 50 + 1 AS row_no, c AS col, CASE WHEN c = 1 AND p_size % 3 = 0 THEN concat('SUM(RC[1]:RC[', CAST(p_size % 7 AS STRING), '])') WHEN c = 6 AND p_size % 2 = 0 THEN 'SUM( RC[-4]:RC[-1] )' ELSE 'RC[-1]*2' END AS formula
    FROM {{part}} CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6)) v(c)) k"""


@query("t15_row_totals", f"""WITH c AS ({_DUCK(_RT)}), e AS (SELECT *, regexp_extract(replace(formula, ' ', ''), '^=?SUM\\(RC\\[(-?[0-9]+)\\]:RC\\[(-?[0-9]+)\\]\\)$', ['a', 'b']) AS m FROM c WHERE col IN (1, 6))
    SELECT workbook_id, sheet, row_no, col FROM e WHERE m.a <> '' AND abs(m.b::INT - m.a::INT) + 1 >= 2.5""")
def t15(spark, sf):
    return structure.row_totals(spark.sql(_RT, part=spark.read.parquet(f"{sf}/part.parquet")))


_TABS = "SELECT CAST(floor(p_partkey / 10) AS BIGINT) AS workbook_id, p_partkey % 10 AS pos, CASE WHEN p_partkey % 10 = 2 THEN 'Valuation >>' WHEN p_partkey % 10 = 7 THEN '<< Client' WHEN p_partkey % 10 = 5 AND p_size % 4 = 0 THEN 'Values>' ELSE concat('Sheet ', CAST(p_partkey % 10 AS STRING)) END AS sheet, CASE WHEN p_partkey % 10 IN (2, 7) THEN p_size % 4 ELSE p_size END AS cells FROM {part}"


@query("t17_divider_groups", f"""WITH s AS ({_DUCK(_TABS)}), p AS (SELECT workbook_id, sheet FROM s WHERE (workbook_id + pos) % 6 <> 0), d AS (SELECT *, regexp_matches(sheet, '^\\s*<|>\\s*$') AND cells <= 2 AS divider FROM s),
    h AS (SELECT *, last_value(CASE WHEN divider THEN regexp_matches(trim(sheet, '<> '), '(?i)^(valuation|dcf)($|[^A-Za-z0-9_])') END IGNORE NULLS) OVER (PARTITION BY workbook_id ORDER BY pos) AS u FROM d), o AS (SELECT h.*, coalesce(u, false) AS own, p.sheet IS NOT NULL AS known FROM h LEFT JOIN p USING (workbook_id, sheet)),
    g AS (SELECT workbook_id FROM o GROUP BY 1 HAVING count(*) FILTER (own) > 0 AND count(*) FILTER (NOT own AND NOT divider AND cells > 0) > 0 AND count(*) FILTER (NOT own AND NOT divider AND cells > 0 AND known) >= 0.8 * count(*) FILTER (NOT own AND NOT divider AND cells > 0))
    SELECT workbook_id, sheet FROM o SEMI JOIN g USING (workbook_id) WHERE own""")
def t17(spark, sf):
    s = spark.sql(_TABS, part=spark.read.parquet(f"{sf}/part.parquet"))
    return structure.divider_groups(s, s.where("(workbook_id + pos) % 6 <> 0").select("workbook_id", "sheet"), "valuation|dcf")


@query("t18_sheet_profile", f"""{cte('model_rows', 'model_edges', 'model_points')}, r AS (SELECT workbook_id, sheet, count(*)::BIGINT AS rows, sum(row_no % 7)::BIGINT AS formulas FROM model_rows GROUP BY 1, 2),
    e AS (SELECT DISTINCT x.workbook_id, a.sheet AS s, b.sheet AS d FROM model_edges x JOIN model_rows a ON a.workbook_id = x.workbook_id AND a.row_no = src JOIN model_rows b ON b.workbook_id = x.workbook_id AND b.row_no = dst WHERE a.sheet <> b.sheet AND src % 5 <> 0),
    i AS (SELECT workbook_id, s AS sheet, string_agg(d, ',' ORDER BY d) AS reads FROM e GROUP BY 1, 2), o AS (SELECT workbook_id, d AS sheet, string_agg(s, ',' ORDER BY s) AS read_by FROM e GROUP BY 1, 2),
    l AS (SELECT workbook_id, sheet, count(*)::BIGINT AS n FROM model_rows WHERE row_no % 11 = 2 GROUP BY 1, 2), f AS (SELECT workbook_id, sheet, count(DISTINCT row_no % 5)::BIGINT AS n FROM model_rows WHERE row_no % 8 = 3 GROUP BY 1, 2), d AS (SELECT workbook_id, sheet, min(period_end) AS first_period FROM model_points WHERE sheet <> 'S1' GROUP BY 1, 2)
    SELECT r.*, coalesce(reads, '') AS reads, coalesce(read_by, '') AS read_by, coalesce(l.n, 0) AS link_rows, coalesce(f.n, 0) AS facts, first_period FROM r LEFT JOIN i USING (workbook_id, sheet) LEFT JOIN o USING (workbook_id, sheet) LEFT JOIN l USING (workbook_id, sheet) LEFT JOIN f USING (workbook_id, sheet) LEFT JOIN d USING (workbook_id, sheet)""")
def t18(spark, sf):
    r, e, s = (view(spark, sf, f"model_{n}") for n in ("rows", "edges", "points"))
    at = r.select("workbook_id", "row_no", "sheet")
    e = e.join(at.withColumnsRenamed({"row_no": "src", "sheet": "src_sheet"}), ["workbook_id", "src"]).join(at.withColumnsRenamed({"row_no": "dst", "sheet": "dst_sheet"}), ["workbook_id", "dst"])
    e = e.withColumn("kind", F.when(F.col("src") % 5 == 0, "inactive").otherwise("direct"))
    return structure.sheet_profile(r.withColumn("n_formula", F.col("row_no") % 7), e, r.where("row_no % 11 = 2"), r.where("row_no % 8 = 3").withColumn("fact_id", F.col("row_no") % 5), s.where("sheet <> 'S1'"))


_VD = f"""SELECT {W} AS workbook_id, CAST(floor(p_partkey % 50 / 5) AS BIGINT) AS row_no, p_partkey % 5 AS col, CASE CAST(floor(p_partkey % 50 / 5) AS BIGINT) WHEN 0 THEN 'Valuation date' WHEN 1 THEN 'valuation date (this year)' WHEN 2 THEN 'Days to the valuation date' WHEN 3 THEN 'Valuation date at 30/6' WHEN 4 THEN NULL ELSE 'Start date' END AS label,
    make_date(CASE WHEN p_size % 9 = 0 THEN 2065 ELSE 2018 + p_size % 7 END, 1 + p_size % 2 * 5, 30) AS date FROM {{part}} WHERE p_size % 5 <> 0 AND NOT (p_partkey % 50 < 5 AND CAST(floor(p_partkey / 50) AS BIGINT) % 3 > 0)"""


@query("f7_valuation_date", f"""WITH c AS ({_DUCK(_VD)}), r AS (SELECT *, CASE WHEN label IS NULL THEN 0 WHEN regexp_matches(lower(label), '[0-9]{{4}}|[0-9]{{1,2}}[/-][0-9]{{1,2}}') THEN 3 WHEN regexp_matches(lower(label), '^\\s*valuation date\\s*:?\\s*$') THEN 0 WHEN starts_with(lower(label), 'valuation date') THEN 1 WHEN contains(lower(label), 'valuation date') THEN 2 END AS rank FROM c),
    d AS (SELECT workbook_id, row_no, rank, date, min(col) AS col FROM r WHERE rank IS NOT NULL GROUP BY ALL), k AS (FROM d QUALIFY row_number() OVER (PARTITION BY workbook_id, row_no ORDER BY col) <= 4), v AS (SELECT workbook_id, date, min(rank)::INT AS rank, count(*)::BIGINT AS votes FROM k GROUP BY 1, 2)
    FROM v QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY year(date) BETWEEN 1990 AND 2031 DESC, rank, votes DESC, date DESC) = 1""")
def f7(spark, sf):
    return structure.valuation_date(spark.sql(_VD, part=spark.read.parquet(f"{sf}/part.parquet")), F.lit(2031))


_FL = "SELECT workbook_id, sheet, row_no, concat(CASE row_no % 6 WHEN 0 THEN 'Equity distributions' WHEN 1 THEN 'Dividend yield' WHEN 2 THEN 'Shareholder loan interest' WHEN 3 THEN 'Capital raising' WHEN 4 THEN 'Distribution share' ELSE 'Opex' END, ' ', label) AS label FROM {rows}"
_FS = "SELECT workbook_id, sheet, row_no, period_end, CASE WHEN row_no % 6 = 4 THEN value / 1e5 ELSE value END AS value FROM {points}"
_F6 = f"fr AS ({_FL.format(rows='model_rows_now')}), fs AS ({_FS.format(points='model_points_now')}), fl AS (SELECT workbook_id, row_no, label, sum(value) AS total, count(*)::BIGINT AS periods FROM fs JOIN fr USING (workbook_id, row_no) WHERE regexp_matches(label, '{structure.FLOW_WORDS}') AND NOT regexp_matches(label, '{structure.NOT_A_FLOW}') AND period_end > make_date(2021 + (workbook_id % 3)::INT, 6, 30) AND value <> 0 GROUP BY ALL HAVING NOT bool_and(value > 0 AND value <= 1))"


def _flow_lines(spark, sf):
    r, s = spark.sql(_FL, rows=view(spark, sf, "model_rows_now")), spark.sql(_FS, points=view(spark, sf, "model_points_now"))
    d = r.select("workbook_id").distinct().withColumn("date", F.make_date((2021 + F.col("workbook_id") % 3).cast("int"), F.lit(6), F.lit(30)))
    return structure.flow_lines(r, s, d)


@query("f6_flow_lines", f"{cte('model_rows_now', 'model_points_now')}, {_F6} SELECT workbook_id, row_no, label, round(total, 4) AS total, periods FROM fl")
def f6(spark, sf):
    return _flow_lines(spark, sf).withColumn("total", F.round("total", 4))


@query("j16_new_lines", f"""{cte('model_rows', 'model_rows_now', 'model_points_now', 'model_edges_now')}, {_F6}, rd AS (SELECT workbook_id, row_no FROM model_rows_now WHERE row_no % 9 = 2), fd AS (SELECT e.workbook_id, dst AS row_no FROM model_edges_now e JOIN rd ON rd.workbook_id = e.workbook_id AND rd.row_no = src),
    kn AS (SELECT workbook_id, row_no + 3 AS row_no FROM model_rows WHERE row_no % 4 = 1 AND row_no % 8 <> 5)
    SELECT workbook_id, row_no, label, round(total, 4) AS total, periods, (row_number() OVER (PARTITION BY workbook_id ORDER BY abs(total) DESC, row_no))::INT AS place FROM fl ANTI JOIN rd USING (workbook_id, row_no) ANTI JOIN fd USING (workbook_id, row_no) ANTI JOIN kn USING (workbook_id, row_no) QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY abs(total) DESC, row_no) <= 12""")
def j16(spark, sf):
    rows, rn, en = (view(spark, sf, f"model_{n}") for n in ("rows", "rows_now", "edges_now"))
    m = rows.where("row_no % 4 = 1").select("workbook_id", "row_no", (F.col("row_no") + 3).alias("cur_row"), F.lit(0.8).alias("confidence"))
    nil = rows.where("row_no % 8 = 5")
    return evidence.new_lines(_flow_lines(spark, sf), rn.where("row_no % 9 = 2"), en, m, nil).withColumn("total", F.round("total", 4))


@query("j12_copies", f"""{cte('model_rows', 'model_rows_now')}, a AS (SELECT workbook_id, row_no, label, lower(concat(section, CASE WHEN row_no % 3 = 0 THEN ' base case' ELSE ' downside case' END)) AS h FROM model_rows), b AS (SELECT workbook_id, row_no AS cur_row, sheet, label, lower(concat(section, CASE WHEN row_no % 4 = 0 THEN ' base case' ELSE ' downside case' END)) AS g FROM model_rows_now),
    c AS (SELECT a.workbook_id, row_no, cur_row, h, g, sheet FROM a JOIN b ON b.workbook_id = a.workbook_id AND split_part(a.label, ' ', 1) = split_part(b.label, ' ', 1)), n AS (SELECT workbook_id, row_no FROM c GROUP BY 1, 2 HAVING count(DISTINCT cur_row) > 1),
    t AS (SELECT *, list_distinct(regexp_extract_all(h, '[a-z][a-z0-9]+')) AS x, list_distinct(regexp_extract_all(g, '[a-z][a-z0-9]+')) AS y FROM c SEMI JOIN n USING (workbook_id, row_no)), f AS (SELECT *, len(list_intersect(x, y)) / greatest(1, len(x) + len(y) - len(list_intersect(x, y))) AS fit FROM t),
    o AS (SELECT workbook_id, row_no, min(cur_row) AS cur_row, 'heading' AS how, 1 AS rank FROM f WHERE h = g GROUP BY 1, 2 HAVING count(DISTINCT cur_row) = 1
      UNION ALL SELECT workbook_id, row_no, cur_row, 'heading words', 2 FROM (SELECT *, coalesce(lead(fit) OVER w, 0) AS nx, row_number() OVER w AS r FROM f WINDOW w AS (PARTITION BY workbook_id, row_no ORDER BY fit DESC, cur_row)) WHERE r = 1 AND fit >= 0.75 AND fit - nx >= 0.5
      UNION ALL SELECT workbook_id, row_no, min(cur_row), 'value', 3 FROM f WHERE cur_row % 7 = row_no % 7 GROUP BY 1, 2 HAVING count(DISTINCT cur_row) = 1
      UNION ALL SELECT workbook_id, row_no, min(cur_row), 'period length', 4 FROM f WHERE cur_row % 3 = row_no % 3 GROUP BY 1, 2 HAVING count(DISTINCT cur_row) = 1
      UNION ALL SELECT workbook_id, row_no, min(cur_row), 'home sheet', 5 FROM f WHERE sheet = 'S1' GROUP BY 1, 2 HAVING count(DISTINCT cur_row) = 1)
    SELECT workbook_id, row_no, cur_row, coalesce(how, 'open') AS how FROM n LEFT JOIN (FROM o QUALIFY row_number() OVER (PARTITION BY workbook_id, row_no ORDER BY rank) = 1) USING (workbook_id, row_no)""")
def j12(spark, sf):
    a, b = view(spark, sf, "model_rows"), view(spark, sf, "model_rows_now")
    head = lambda d, k: d.select("workbook_id", "row_no", F.concat("section", F.when(F.col("row_no") % k == 0, " base case").otherwise(" downside case")).alias("heading"))
    first = F.substring_index("label", " ", 1).alias("w")
    c = a.select("workbook_id", "row_no", first).join(b.select("workbook_id", F.col("row_no").alias("cur_row"), "sheet", first), ["workbook_id", "w"])
    c = written(c, "copies")  # read five times
    reach = c.where("cur_row % 7 = row_no % 7")
    lengths = c.select("workbook_id", "row_no", "cur_row", (F.col("row_no") % 3).alias("prior_months"), (F.col("cur_row") % 3).alias("months"))
    return evidence.resolve_copies(c, head(a, 3), head(b, 4), reach, lengths, c.where("sheet = 'S1'"))
