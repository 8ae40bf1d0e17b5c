"""Queries on gates and held figures.  Inputs are SELECTs that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.operators import gates
from fleetroll.sources.adapters import cte, view

from .registry import query

DUCK = lambda s: s.replace("AS STRING", "AS VARCHAR").format(**{t: t for t in ("part", "orders", "customer", "lineitem", "documents", "events")})


def table(spark, sf: str, sql: str):
    """The rows of a SELECT over the given tables it names in braces."""
    names = [t for t in ("part", "orders", "customer", "lineitem", "documents", "events") if f"{{{t}}}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf}/{t}.parquet") for t in names})


_J19C = """SELECT o_custkey AS engagement_id, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'value' END AS part, concat('c', CAST(o_orderkey AS STRING)) AS cell, concat('S', CAST(o_orderkey % 2 AS STRING)) AS sheet, o_orderkey % 4 AS row_no,
    CASE WHEN o_orderkey % 11 = 0 THEN 1000.0 ELSE 1.0 END AS scale, CASE WHEN o_custkey % 9 = 4 THEN -1 ELSE 1 END AS sign, o_totalprice AS value, CASE WHEN o_orderkey % 7 = 0 THEN 'Net debt' ELSE 'Equity value' END AS label, o_orderkey % 6 <> 1 AS is_formula, o_orderkey % 5 < 3 AS label_match, o_orderkey % 5 <> 4 AS located, CAST(o_orderkey % 3 AS DOUBLE) AS score
    FROM {orders} WHERE NOT (o_custkey % 8 = 5 AND o_orderkey % 3 < 2)"""
_J19R = "SELECT engagement_id, src, dst FROM (SELECT o_custkey AS engagement_id, concat('c', CAST(o_orderkey AS STRING)) AS src, concat('c', CAST(lag(o_orderkey, 2) OVER (PARTITION BY o_custkey, o_orderkey % 3 ORDER BY o_orderkey) AS STRING)) AS dst FROM {orders}) q WHERE dst IS NOT NULL AND dst <> 'c'"


@query("j19_pair_ends", f"""WITH c AS ({DUCK(_J19C)}), rd AS (SELECT DISTINCT * FROM ({DUCK(_J19R)})), ok AS (SELECT * FROM c WHERE is_formula AND NOT regexp_matches(label, '{gates.NOT_EQUITY}')),
    p AS (SELECT l.engagement_id AS e, l.sheet, l.row_no, l.cell AS low, h.cell AS high, round(l.score + h.score + 2 + CASE WHEN l.label_match AND h.label_match THEN 1 ELSE 0 END, 9) AS score FROM ok l JOIN ok h ON h.engagement_id = l.engagement_id AND h.sheet = l.sheet AND h.row_no = l.row_no AND h.scale = l.scale AND h.sign = l.sign WHERE l.part = 'low' AND h.part = 'high' AND l.value * l.sign <= h.value * h.sign + 1e-9),
    dn AS (SELECT DISTINCT p.e, p.low, p.high FROM p JOIN p q ON q.e = p.e AND (q.low <> p.low OR q.high <> p.high) JOIN rd a ON a.engagement_id = p.e AND a.src = p.low AND a.dst = q.low JOIN rd b ON b.engagement_id = p.e AND b.src = p.high AND b.dst = q.high),
    k AS (SELECT p.*, dn.e IS NOT NULL AS down FROM p LEFT JOIN dn ON dn.e = p.e AND dn.low = p.low AND dn.high = p.high), m AS (SELECT * FROM k QUALIFY NOT down OR bool_and(down) OVER (PARTITION BY e)), t AS (SELECT * FROM m QUALIFY score = max(score) OVER (PARTITION BY e)),
    one AS (SELECT e, count(DISTINCT (sheet, row_no)) AS n, min(struct_pack(sheet, row_no, low, high)) AS x FROM t GROUP BY 1), r1 AS (SELECT e, CASE WHEN n > 1 THEN 'ambiguous' ELSE 'one row' END AS how, CASE WHEN n = 1 THEN x.low END AS low, CASE WHEN n = 1 THEN x.high END AS high, n::INT AS rows FROM one),
    tp AS (SELECT engagement_id AS e, part, cell, scale, sign, value FROM ok WHERE located QUALIFY row_number() OVER (PARTITION BY engagement_id, part ORDER BY score DESC, cell) = 1),
    r2 AS (SELECT l.e, 'two rows' AS how, l.cell AS low, h.cell AS high, 2 AS rows FROM tp l JOIN tp h ON h.e = l.e AND h.scale = l.scale AND h.sign = l.sign WHERE l.part = 'low' AND h.part = 'high' AND l.value * l.sign <= h.value * h.sign + 1e-9 AND l.e NOT IN (SELECT e FROM r1)),
    r3 AS (SELECT e, 'one figure' AS how, cell AS low, cell AS high, 1 AS rows FROM tp WHERE part = 'value' AND e NOT IN (SELECT engagement_id FROM c WHERE part IN ('low', 'high')) AND e NOT IN (SELECT e FROM r1) AND e NOT IN (SELECT e FROM r2))
    SELECT e AS engagement_id, how, low, high, rows FROM (FROM r1 UNION ALL FROM r2 UNION ALL FROM r3)""")
def j19(spark, sf):
    return gates.pair_ends(table(spark, sf, _J19C), table(spark, sf, _J19R))


_J25H = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey AS input_id, concat(CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'held figure' END, ' balance') AS label, CASE WHEN p_size % 10 = 0 THEN 0.0 ELSE p_retailprice * CASE p_size % 4 WHEN 0 THEN 1000 WHEN 1 THEN 0.001 WHEN 2 THEN -1.0001 ELSE 1.2345 END END AS value FROM {part} WHERE p_partkey % 3 = 0 AND p_size <> 20"
_J25D = "SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, make_date(2020, 12, 31) AS prior_date, make_date(2020 + CAST(floor(p_partkey / 50) AS INT) % 9, 12, 31) AS this_date FROM {part}"
_TOK = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '([a-z][a-z0-9]+)', 1), lambda x: x NOT IN ('the', 'and', 'of', 'for', 'to', 'in')))"


@query("j25_suggest_held", f"""{cte('model_points', 'model_points_now', 'model_rows')}, h AS ({DUCK(_J25H)}), d AS ({DUCK(_J25D)}), m AS (SELECT workbook_id, row_no, row_no + CASE WHEN row_no > 10 AND workbook_id % 3 > 0 THEN 3 ELSE 0 END AS cur_row FROM model_rows WHERE row_no % 12 <> 5),
    s AS (SELECT h.*, prior_date, this_date, k.scale, k.r FROM h JOIN d USING (workbook_id), (VALUES (1.0::DOUBLE, 1), (1e3, 2), (1e-3, 3)) k(scale, r) WHERE value <> 0),
    x AS (SELECT s.workbook_id, s.input_id, s.value AS v, p.row_no, p.value AS x, this_date, len(list_intersect({_TOK('s.label')}, {_TOK('l.label')})) > 0 AS agrees, arg_min(scale, r) AS scale FROM s JOIN model_points p ON p.workbook_id = s.workbook_id AND p.period_end = prior_date JOIN model_rows l ON l.workbook_id = p.workbook_id AND l.row_no = p.row_no
      WHERE p.value <> 0 AND abs(p.value) BETWEEN (abs(s.value) - greatest(5e-4 * abs(s.value), 0.05)) / scale AND (abs(s.value) + greatest(5e-4 * abs(s.value), 0.05)) / scale GROUP BY ALL),
    y AS (SELECT *, count(*) FILTER (agrees) OVER (PARTITION BY workbook_id, input_id) AS na FROM x QUALIFY row_number() OVER (PARTITION BY workbook_id, input_id ORDER BY agrees DESC, row_no) = 1),
    z AS (SELECT y.*, m.cur_row, c.value AS y FROM y LEFT JOIN m ON m.workbook_id = y.workbook_id AND m.row_no = y.row_no LEFT JOIN model_points_now c ON c.workbook_id = y.workbook_id AND c.row_no = m.cur_row AND c.period_end = this_date),
    w AS (SELECT *, CASE WHEN cur_row IS NULL THEN 'no row' WHEN y IS NULL THEN 'no date' WHEN agrees AND na = 1 THEN 'checked' ELSE 'figure only' END AS status FROM z)
    SELECT h.workbook_id, h.input_id, CASE WHEN h.value = 0 THEN 'nil' ELSE coalesce(status, 'not found') END AS status, row_no, round(CASE WHEN status IN ('checked', 'figure only') THEN abs(y) * scale * sign(v) * CASE WHEN sign(y) = sign(x) THEN 1 ELSE -1 END END, 6) AS value FROM h LEFT JOIN w USING (workbook_id, input_id)""")
def j25(spark, sf):
    r, p, c = (view(spark, sf, f"model_{n}") for n in ("rows", "points", "points_now"))
    m = r.where("row_no % 12 <> 5").select("workbook_id", "row_no", (F.col("row_no") + F.when((F.col("row_no") > 10) & (F.col("workbook_id") % 3 > 0), 3).otherwise(0)).alias("cur_row"))
    out = gates.suggest_held(table(spark, sf, _J25H), p.join(r.select("workbook_id", "row_no", "label"), ["workbook_id", "row_no"]), c, m, table(spark, sf, _J25D))
    return out.withColumn("value", F.round("value", 6))


@query("c3_exact_zero_roll", """SELECT c_custkey AS workbook_id, round(ratio, 9) AS ratio, coalesce(n, 0)::BIGINT AS changed_rows, abs(ratio - 1) < 1e-4 AND coalesce(n, 0) > 0 AS suspect FROM (SELECT c_custkey, 1 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal / 1e7 END AS ratio FROM customer)
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey""")
def c3(spark, sf):
    v = table(spark, sf, "SELECT c_custkey AS workbook_id, 1 + CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_acctbal / 1e7 END AS ratio FROM {customer}")
    ch = table(spark, sf, "SELECT o_custkey AS workbook_id, count(*) AS changed_rows FROM {orders} WHERE o_orderstatus = 'O' AND o_totalprice > 400000 GROUP BY 1")
    return gates.exact_zero_roll(v, ch).withColumn("ratio", F.round("ratio", 9))


_C7F = """SELECT core_id, feed, period_end, CASE WHEN late > 0 AND feed = 'this' AND core_id % 4 = 1 THEN 0.0 ELSE amount END AS cf, CASE WHEN late = 1 AND NOT (feed = 'this' AND core_id % 3 = 0) THEN amount * 5 ELSE 0.0 END AS tv, CASE WHEN n <= 1 THEN 0.0 ELSE 1.0 / n END AS factor, DATE '1996-06-30' AS after
    FROM (SELECT core_id, period_end, amount, feed, row_number() OVER (PARTITION BY core_id, feed ORDER BY period_end) AS n, CASE WHEN row_number() OVER (PARTITION BY core_id, feed ORDER BY period_end DESC) <= 2 THEN row_number() OVER (PARTITION BY core_id, feed ORDER BY period_end DESC) ELSE 0 END AS late
    FROM (SELECT o_custkey AS core_id, last_day(CAST(o_orderdate AS DATE)) AS period_end, sum(o_totalprice) AS amount FROM {orders} GROUP BY 1, 2) a CROSS JOIN (SELECT * FROM (VALUES ('last'), ('this')) v(feed)) f) b"""
_C7R = "SELECT o_custkey AS core_id, o_orderkey AS row_no FROM {orders} WHERE o_orderkey % 3 = 0"
_C7P = "SELECT o_orderkey AS row_no, last_day(CAST(o_orderdate AS DATE)) AS period_end, o_totalprice AS value FROM {orders}"
_C7N = "SELECT o_orderkey + 1000000000 AS row_no, CASE WHEN o_orderkey % 2 = 0 THEN make_date(2035, 6, 30) ELSE last_day(CAST(o_orderdate AS DATE)) END AS period_end, o_totalprice AS value FROM {orders}"


@query("c7_horizon", f"""WITH f AS ({DUCK(_C7F)}), r AS ({DUCK(_C7R)}), p AS ({DUCK(_C7P)}), q AS ({DUCK(_C7N)}), tv AS (SELECT core_id, coalesce(sum(tv) FILTER (feed = 'last' AND factor <> 0), 0) AS a, coalesce(sum(tv) FILTER (feed = 'this' AND factor <> 0), 0) AS b FROM f GROUP BY 1),
    e AS (SELECT core_id, feed, max(period_end) FILTER (cf <> 0 OR tv <> 0) AS z FROM f WHERE period_end > after GROUP BY 1, 2), t AS (SELECT core_id, count(*) FILTER (feed = 'last' AND period_end > z) AS a, count(*) FILTER (feed = 'this' AND period_end > z) AS b FROM f JOIN e USING (core_id, feed) WHERE period_end > after GROUP BY 1),
    l AS (SELECT core_id, max(period_end) FILTER (feed = 'last') AS le, max(period_end) FILTER (feed = 'this') AS te FROM f WHERE factor <> 0 GROUP BY 1 HAVING le IS NOT NULL AND te IS NOT NULL),
    b AS (SELECT core_id, count(DISTINCT r.row_no) AS n, sum(q.value) AS total FROM r JOIN l USING (core_id) JOIN q ON q.row_no = r.row_no + 1000000000 WHERE q.period_end > te AND abs(q.value) > 1e-9 AND NOT EXISTS (FROM p WHERE p.row_no = r.row_no AND p.period_end > le AND abs(p.value) > 1e-9) GROUP BY 1)
    SELECT core_id, 'terminal nil' AS what, 0::BIGINT AS n, round(a, 2) AS total FROM tv WHERE abs(a) > 1e-9 AND abs(b) <= 1e-6 * greatest(1, abs(a)) UNION ALL SELECT core_id, 'short', b::BIGINT, 0.0 FROM t WHERE b > a UNION ALL SELECT core_id, 'beyond', n::BIGINT, round(total, 2) FROM b""")
def c7(spark, sf):
    r = table(spark, sf, _C7R)
    m = r.select("row_no", (F.col("row_no") + 1_000_000_000).alias("cur_row"))
    return gates.horizon(table(spark, sf, _C7F), r, table(spark, sf, _C7P), table(spark, sf, _C7N), m).withColumn("total", F.round("total", 2))


_FEED = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey % 50 + 1 AS row_no, make_date(2020 + k, 12, 31) AS period_end, CASE (p_size + k) % 11 WHEN 0 THEN 'stand-in' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'missing' ELSE 'blank' END WHEN 2 THEN CASE WHEN p_size % 5 = 0 THEN 'no match' ELSE 'rolled' END ELSE 'rolled' END AS how, CASE WHEN p_size % 6 = 0 THEN 0.0 ELSE p_retailprice END AS rolled FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) v(k)) x"


@query("c8_stand_ins", f"WITH f AS ({DUCK(_FEED)}) SELECT workbook_id, count(DISTINCT row_no)::BIGINT AS rows, count(*)::BIGINT AS periods, round(sum(rolled), 4) AS total FROM f WHERE how = 'stand-in' AND row_no % 4 <> 1 GROUP BY 1 HAVING max(abs(rolled)) > 1e-9")
def c8(spark, sf):
    f = table(spark, sf, _FEED)
    return gates.stand_ins(f, f.where("row_no % 4 = 1").select("workbook_id", "row_no").distinct()).withColumn("total", F.round("total", 4))


_C9P = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey % 50 + 1 AS row_no, k AS col, make_date(2020 + k, 12, 31) AS period_end, round(p_retailprice * (1 + 0.1 * k), 4) AS value FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(k)) x"
_C9C = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey % 50 + 1 AS row_no, k AS col, make_date(2020 + k + CASE WHEN p_size % 3 = 1 THEN 1 ELSE 0 END, 12, 31) AS period_end, round(CASE WHEN p_size % 3 = 2 THEN p_retailprice * 2 WHEN p_size % 4 = 0 AND k > 3 THEN 7 ELSE p_retailprice * (1 + 0.1 * k) END, 4) AS value FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(k)) x"
_C9S = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey % 50 + 1 AS row_no, p_partkey % 50 + 1 AS cur_row, p_size % 5 AS was_formula, CASE WHEN p_size % 7 = 0 THEN 3 ELSE 1 END AS now_formula, 6 AS now_const FROM {part}"


@query("c9_pasted", f"""WITH p AS ({DUCK(_C9P)}), c AS ({DUCK(_C9C)}), s AS (SELECT * FROM ({DUCK(_C9S)}) WHERE was_formula > 0 AND now_formula <= 0.2 * (now_formula + now_const)),
    d AS (SELECT s.workbook_id, s.row_no, s.cur_row, CASE WHEN p.period_end = c.period_end THEN 'by period' ELSE 'by column' END AS how, c.value, abs(c.value - p.value) <= 1e-9 * greatest(1, abs(c.value), abs(p.value)) AS same FROM s JOIN p ON p.workbook_id = s.workbook_id AND p.row_no = s.row_no JOIN c ON c.workbook_id = s.workbook_id AND c.row_no = s.cur_row AND (c.period_end = p.period_end OR c.col = p.col) WHERE (p.value <> 0 OR c.value <> 0)),
    g AS (SELECT workbook_id, row_no, cur_row, how, count(*) FILTER (same)::BIGINT AS n, sum(value) FILTER (same) AS total FROM d GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3 AND count(DISTINCT round(value, 6)) FILTER (same) >= 3 AND count(*) FILTER (same) >= 0.8 * count(*))
    SELECT workbook_id, row_no, cur_row, how, n, round(total, 4) AS total FROM g QUALIFY row_number() OVER (PARTITION BY workbook_id, row_no, cur_row ORDER BY how DESC) = 1""")
def c9(spark, sf):
    s = table(spark, sf, _C9S)
    out = gates.pasted_rows(table(spark, sf, _C9P), table(spark, sf, _C9C), s.select("workbook_id", "row_no", "cur_row"), s)
    return out.withColumn("total", F.round("total", 4))


_C10V = "SELECT o_custkey AS workbook_id, sum(o_totalprice) AS saved, sum(o_totalprice) * (1 + CASE o_custkey % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 1e-5 ELSE 0 END) AS rebuilt FROM {orders} GROUP BY 1"
_C10T = "SELECT o_custkey AS workbook_id, o_orderkey % 10 > 0 AS ties, o_orderkey % 9 = 1 AS loose FROM {orders}"
_C10P = "SELECT c_custkey AS workbook_id, c_custkey % 6 = 2 AS assumed FROM {customer}"


@query("c10_gates", f"""WITH v AS ({DUCK(_C10V)}), t AS ({DUCK(_C10T)}), p AS ({DUCK(_C10P)}) SELECT * FROM (SELECT workbook_id, 'rebuild' AS gate, CASE WHEN abs(rebuilt - saved) / abs(saved) > 1e-3 THEN 'block' WHEN abs(rebuilt - saved) / abs(saved) > 1e-6 THEN 'check' END AS severity FROM v
    UNION ALL SELECT workbook_id, 'tie', CASE WHEN NOT bool_and(ties) THEN 'block' WHEN bool_or(loose) THEN 'check' END FROM t GROUP BY 1 UNION ALL SELECT workbook_id, 'roll', CASE WHEN assumed THEN 'block' END FROM p) WHERE severity IS NOT NULL""")
def c10(spark, sf):
    return gates.gates(*[table(spark, sf, q) for q in (_C10V, _C10T, _C10P)])


_C11R = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey % 50 + 1 AS row_no, p_size % 3 = 0 AND CAST(floor(p_partkey / 50) AS BIGINT) % 5 <> 2 AS is_origin, p_size % 10 = 7 AND CAST(floor(p_partkey / 50) AS BIGINT) % 2 = 0 AS is_timing FROM {part} WHERE p_partkey % 50 < 3 + CAST(floor(p_partkey / 50) AS BIGINT) % 6"
_C11M = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, p_partkey % 50 + 1 AS row_no, p_partkey % 50 + 2 AS cur_row, CASE WHEN p_size % 12 = 5 THEN 0.4 ELSE 0.8 END AS confidence, p_size % 8 = 1 AS kept FROM {part} WHERE p_size % 25 <> 6"


@query("c11_reliability", f"""WITH r AS ({DUCK(_C11R)}), m AS ({DUCK(_C11M)}), f AS (SELECT workbook_id, row_no, count(*) AS reads, count(*) FILTER (how IN ('no match', 'missing', 'stand-in')) AS u, count(*) FILTER (how = 'blank') AS b FROM ({DUCK(_FEED)}) GROUP BY 1, 2),
    d AS (SELECT r.*, cur_row, confidence, coalesce(kept, false) AS kept, coalesce(reads, 0) AS reads, coalesce(u, 0) AS u, coalesce(b, 0) AS b FROM r LEFT JOIN m USING (workbook_id, row_no) LEFT JOIN f USING (workbook_id, row_no)),
    e AS (SELECT *, is_origin AND NOT kept AND (cur_row IS NULL OR u > 0.5 * greatest(1, reads)) AS mi FROM d), g AS (SELECT *, NOT mi AND NOT kept AND b > 0.2 * greatest(1, reads) AS bl FROM e), h AS (SELECT *, NOT kept AND coalesce(confidence, 0) < 0.5 AS us FROM g),
    k AS (SELECT workbook_id, count(*) FILTER (is_origin) AS o, count(*) FILTER (mi)::BIGINT AS missing, count(*) FILTER (bl)::BIGINT AS blank, count(*) FILTER (us AND NOT mi AND NOT bl AND NOT is_timing)::BIGINT AS weak, count(*) FILTER (us AND is_timing)::BIGINT AS timing_open, sum(reads) AS reads, CASE WHEN sum(reads) > 0 THEN 1 - sum(u) / sum(reads) ELSE 0 END AS found_share FROM h GROUP BY 1)
    SELECT workbook_id, CASE WHEN o > 0 THEN missing = 0 ELSE found_share >= 0.9 END AND reads > 0 AND blank = 0 AND weak = 0 AND timing_open = 0 AND workbook_id % 7 <> 3 AS reliable, missing, blank, weak, timing_open, round(found_share, 9) AS found_share, workbook_id % 7 <> 3 AS zero_ok FROM k""")
def c11(spark, sf):
    r = table(spark, sf, _C11R)
    z = r.select("workbook_id").distinct().where("workbook_id % 14 <> 3").withColumn("ok", F.col("workbook_id") % 7 != 3)
    return gates.reliability(r, table(spark, sf, _C11M), table(spark, sf, _FEED), z).withColumn("found_share", F.round("found_share", 9))


_C13R = "SELECT workbook_id, row_no, concat(CASE row_no % 5 WHEN 0 THEN 'Declared distribution' WHEN 1 THEN 'Dividend payable' WHEN 2 THEN 'Dividend paid' ELSE 'Declared' END, ' ', label) AS label FROM {r}"


@query("c13_declared", f"""{cte('model_rows_now', 'model_points_now')}, r AS ({_C13R.format(r='model_rows_now')}) SELECT r.workbook_id, r.row_no, value FROM r JOIN model_points_now s ON s.workbook_id = r.workbook_id AND s.row_no = r.row_no
    WHERE regexp_matches(r.label, '{gates.DECLARED}') AND regexp_matches(r.label, '{gates.DECLARED_HOW}') AND period_end = make_date(2020 + (r.workbook_id % 7)::INT, 12, 31) AND r.workbook_id % 3 <> 1 AND r.workbook_id % 5 <> 2 AND abs(value) > 1e-9""")
def c13(spark, sf):
    r = spark.sql(_C13R, r=view(spark, sf, "model_rows_now"))
    w = r.select("workbook_id").distinct()
    d = w.select("workbook_id", F.make_date((2020 + F.col("workbook_id") % 7).cast("int"), F.lit(12), F.lit(31)).alias("date"), F.when(F.col("workbook_id") % 3 == 1, "cum").otherwise("ex").alias("basis"))
    return gates.declared(r, view(spark, sf, "model_points_now"), d, w.select("workbook_id", F.when(F.col("workbook_id") % 5 == 2, "Declared distribution").otherwise("Net debt").alias("label")))


_C16V = "SELECT c_custkey AS workbook_id, e AS `end`, c_custkey % 6 = 0 AND e = 'low' AS typed, c_custkey % 4 > 0 AS has_discounting, c_acctbal + k AS last, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + k ELSE c_acctbal * 1.05 + k + CASE WHEN e = 'mid' AND c_custkey % 7 = 1 THEN 99 ELSE 0 END END AS this FROM {customer} CROSS JOIN (SELECT * FROM (VALUES ('low', 0.0), ('mid', 500.0), ('high', 1000.0)) v(e, k)) x"


@query("c16_equity_ends", f"""WITH v AS ({DUCK(_C16V).replace('`', '"')}), m AS (SELECT workbook_id, max(last) FILTER ("end" = 'low') AS l0, max(last) FILTER ("end" = 'mid') AS m0, max(last) FILTER ("end" = 'high') AS h0, max(this) FILTER ("end" = 'low') AS l1, max(this) FILTER ("end" = 'mid') AS m1, max(this) FILTER ("end" = 'high') AS h1 FROM v GROUP BY 1)
    SELECT workbook_id, "end", CASE WHEN typed THEN 'typed' ELSE 'still' END AS finding FROM v WHERE "end" <> 'mid' AND (typed OR (abs(last - this) <= 1e-12 * greatest(1, abs(last)) AND NOT has_discounting))
    UNION ALL SELECT workbook_id, 'mid', 'mid apart' FROM m WHERE abs(m0 - (l0 + h0) / 2) <= 1e-9 * greatest(1, abs(m0)) AND abs(m1 - (l1 + h1) / 2) > 1e-3 * abs(m1)""")
def c16(spark, sf):
    return gates.equity_ends(table(spark, sf, _C16V))


_C17 = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, concat('S', CAST(p_size % 3 AS STRING)) AS sheet, p_partkey % 50 + 1 AS row_no, p_size % 4 AS col, p_retailprice * {f} AS value FROM {{part}} WHERE p_size % 9 <> {w}"
_C17A, _C17B = _C17.format(f="1", w=3), _C17.format(f="CASE WHEN p_size % 5 = 2 THEN 1.01 ELSE 1 END", w=4)


@query("c17_differing_inputs", f"""WITH a AS ({DUCK(_C17A)}), b AS ({DUCK(_C17B)}), j AS (SELECT workbook_id, sheet, row_no, col FROM a JOIN b USING (workbook_id, sheet, row_no, col) WHERE abs(a.value - b.value) > 1e-9 * greatest(1, abs(a.value), abs(b.value)))
    SELECT workbook_id, count(*)::BIGINT AS n, array_to_string(list(sheet || '!R' || row_no || 'C' || col ORDER BY sheet, row_no, col)[1:8], ', ') AS cells FROM j GROUP BY 1""")
def c17(spark, sf):
    return gates.differing_inputs(table(spark, sf, _C17A), table(spark, sf, _C17B), ["workbook_id"])


_C18C = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'prior' END AS model, p_partkey % 50 + 1 AS row_no, p_size % 4 AS col, CASE WHEN p_size % 3 > 0 THEN 'RC[-1]' END AS formula, CASE WHEN p_size % 8 > 0 THEN p_retailprice END AS value, CASE WHEN p_size % 13 = 4 THEN '#REF!' END AS err, p_size % 17 = 5 AS beyond FROM {part}"
_C18R = "SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'prior' END AS model, p_partkey % 50 + 1 AS row_no, p_size % 4 AS col FROM {part} WHERE p_size % 5 <> 1"
_C18K = "SELECT DISTINCT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'prior' END AS model, (CAST(floor(p_partkey / 50) AS BIGINT) + p_partkey % 2) % 4 > 0 AS completed FROM {part}"


@query("c18_saved_state", f"""WITH c AS ({DUCK(_C18C)}), r AS (SELECT DISTINCT * FROM ({DUCK(_C18R)})), w AS (SELECT workbook_id, model, CASE WHEN err IS NOT NULL THEN 'error' WHEN formula IS NOT NULL AND value IS NULL THEN 'no saved result' WHEN beyond THEN 'beyond the timeline' END AS what FROM r JOIN c USING (workbook_id, model, row_no, col))
    SELECT workbook_id, model, what, CASE WHEN what = 'beyond the timeline' OR model = 'current' THEN 'block' ELSE 'check' END AS severity, count(*)::BIGINT AS n FROM w WHERE what IS NOT NULL GROUP BY ALL UNION ALL SELECT workbook_id, model, 'calculation not completed', 'check', 1 FROM ({DUCK(_C18K)}) WHERE NOT completed""")
def c18(spark, sf):
    return gates.saved_state(*[table(spark, sf, q) for q in (_C18R, _C18C, _C18K)])


_C19B = "SELECT o_custkey AS workbook_id, o_orderkey AS row_no, CASE o_orderkey % 7 WHEN 0 THEN 'kept' WHEN 1 THEN 'after' WHEN 2 THEN 'unmoved' ELSE 'moved' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 'app' ELSE 'periods' END AS by, o_orderkey % 4 = 0 AS by_label, o_totalprice * (1 + (o_orderkey % 9) * 0.08) AS actual, CASE WHEN o_orderkey % 10 = 9 THEN 0.0 ELSE o_totalprice END AS forecast FROM {orders}"


@query("c19_balance_gates", f"""WITH b AS (SELECT *, coalesce(CASE WHEN forecast <> 0 THEN abs(actual - forecast) / abs(forecast) END, 0) AS o FROM ({DUCK(_C19B).replace(' AS by,', ' AS "by",')})),
    g AS (SELECT workbook_id, 'balance off' AS gate, 3 AS s FROM b WHERE state = 'moved' AND o > 0.5 UNION ALL SELECT workbook_id, 'balance ' || state, CASE state WHEN 'moved' THEN CASE WHEN "by" = 'app' OR o > 0.1 THEN 2 ELSE 1 END WHEN 'kept' THEN CASE WHEN by_label THEN 2 ELSE 1 END WHEN 'after' THEN 2 ELSE 3 END FROM b)
    SELECT workbook_id, gate, ['info', 'check', 'block'][max(s)] AS severity, count(*)::BIGINT AS n FROM g GROUP BY 1, 2""")
def c19(spark, sf):
    return gates.balance_gates(table(spark, sf, _C19B.replace(" AS by,", " AS `by`,")))


_G8T = "SELECT 1000000 + c_nationkey AS parent, CAST(c_custkey AS BIGINT) AS child, CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE 0.5 END AS coefficient FROM {customer} UNION ALL SELECT 2000000 + c_nationkey % 5, 1000000 + c_nationkey, 1.5 FROM (SELECT DISTINCT c_nationkey FROM {customer}) n UNION ALL SELECT 2000000 + c_custkey % 5, CAST(c_custkey AS BIGINT), 2.0 FROM {customer} WHERE c_custkey % 10 = 0"


@query("g8_roll_up", """WITH w AS (SELECT 2000000 + c_nationkey % 5 AS root, c_custkey AS node, 1.5 * CASE WHEN c_custkey % 3 = 0 THEN -1.0 ELSE 0.5 END AS k, c_acctbal FROM customer UNION ALL SELECT 2000000 + c_custkey % 5, c_custkey, 2.0, c_acctbal FROM customer WHERE c_custkey % 10 = 0)
    SELECT root::BIGINT AS root, round(sum(k * c_acctbal), 4)::DOUBLE AS value, count(DISTINCT node)::BIGINT AS parts FROM w GROUP BY 1""")
def g8(spark, sf):
    pv = table(spark, sf, "SELECT CAST(c_custkey AS BIGINT) AS node, c_acctbal AS value FROM {customer}")
    return gates.roll_up(table(spark, sf, _G8T), pv).select(F.col("root").cast("long").alias("root"), F.round("value", 4).alias("value"), "parts")


_V26R = "SELECT o_custkey AS core_id, CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'last' END AS walk, concat('c', CAST(o_orderkey % 4 AS STRING)) AS cell, CASE WHEN o_orderkey % 4 = 1 AND o_custkey % 3 > 0 THEN 'Franking utilisation' ELSE 'Input' END AS label, CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 0.3 ELSE 25.0 END ELSE 7.5 END AS value FROM (SELECT o_custkey, o_orderkey FROM {orders} UNION ALL SELECT o_custkey, o_orderkey + 4001 FROM {orders} WHERE o_orderkey % 3 > 0) x"
_V26R = _V26R.replace("CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'last' END AS walk", "CASE WHEN o_orderkey > 4000 AND o_orderkey % 3 > 0 OR o_orderkey % 5 = 0 THEN 'first' ELSE 'last' END AS walk")
_V26V = "SELECT core_id, pv * 10 AS base, pv * 10 - pv * CASE core_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.001 WHEN 2 THEN 1000 ELSE 3 END AS nil FROM (SELECT o_custkey AS core_id, sum(o_totalprice * 0.8) AS pv FROM {orders} GROUP BY 1) x"


@query("v26_franking", f"""WITH r AS ({DUCK(_V26R)}), v AS ({DUCK(_V26V)}), c AS (SELECT core_id, cell, max(value) AS v, bool_or(regexp_matches(label, '(?i)frank')) AS named FROM r WHERE value > 0 AND value <= 1 GROUP BY 1, 2 HAVING count(DISTINCT walk) = 2),
    d AS (SELECT * FROM c QUALIFY v < 1 OR NOT bool_or(v < 1) OVER (PARTITION BY core_id)), e AS (SELECT * FROM d QUALIFY named OR NOT bool_or(named) OVER (PARTITION BY core_id)), f AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY core_id) = 1),
    p AS (SELECT o_custkey AS core_id, sum(o_totalprice * 0.8) AS pv FROM orders GROUP BY 1)
    SELECT core_id, cell, f.v::DOUBLE AS utilisation, round(pv, 2) AS pv, round(base - nil, 2) AS "drop", list_bool_or(list_transform([1.0, 1e-3, 1e-6, 1e3], lambda s: abs(base - nil - pv * s) <= 1e-6 * greatest(1, abs(pv * s)))) AS ok FROM p JOIN v USING (core_id) LEFT JOIN f USING (core_id)""")
def v26(spark, sf):
    s = table(spark, sf, "SELECT o_custkey AS core_id, o_totalprice AS cf, 0.8 AS factor FROM {orders}").withColumn("factor", F.lit(0.8))
    return gates.franking(table(spark, sf, _V26R), s, table(spark, sf, _V26V)).withColumns({"pv": F.round("pv", 2), "drop": F.round("drop", 2), "utilisation": F.col("utilisation").cast("double")})


@query("v21_input_effects", """WITH l AS (SELECT o_custkey AS core_id, CASE WHEN o_orderstatus = 'F' THEN 'flows' ELSE 'timing' END AS grp, o_orderpriority AS input, sum(o_totalprice * 0.9) * 0.01 AS effect FROM orders GROUP BY ALL), u AS (FROM l UNION ALL SELECT c_custkey, 'rates', 'discount rate', c_acctbal FROM customer)
    SELECT core_id, grp, input, round(effect, 2)::DOUBLE AS effect, (row_number() OVER (PARTITION BY core_id ORDER BY grp, abs(effect) DESC, input))::INT AS place FROM u QUALIFY row_number() OVER (PARTITION BY core_id ORDER BY grp, abs(effect) DESC, input) <= 40""")
def v21(spark, sf):
    f = table(spark, sf, "SELECT o_custkey AS core_id, o_orderpriority AS input, CASE WHEN o_orderstatus = 'F' THEN 'flows' ELSE 'timing' END AS grp, o_orderkey AS period_end, o_totalprice AS cf FROM {orders}")
    x = f.select("core_id", "period_end").withColumn("factor", F.lit(0.9))
    s = table(spark, sf, "SELECT c_custkey AS core_id, 'rates' AS grp, 'discount rate' AS input, c_acctbal AS effect FROM {customer}")
    return gates.input_effects(f, x, s).withColumn("effect", F.round("effect", 2))
