"""Queries on texts, logs, values and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.functions import text
from fleetroll.operators import checks, fin, logs, value
from fleetroll.sources import tables
from fleetroll.sources.adapters import cte, view

from .q_finance import _PV, sql_factors
from .registry import query

KEY = ["workbook_id", "sheet", "row_no"]


@query("a5_usage", f"""{cte('calls', 'prices')}, d AS (SELECT c.*, tokens * price / 1e6 AS cost, ts::DATE AS day FROM calls c LEFT JOIN prices USING (model))
    SELECT model, purpose, day, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, round(sum(cost), 8) AS cost, count(*) FILTER (cost IS NULL)::BIGINT AS unpriced FROM d GROUP BY GROUPING SETS ((), (model), (purpose), (day))""")
def a5(spark, sf):
    return logs.usage(view(spark, sf, "calls"), view(spark, sf, "prices")).withColumn("cost", F.round("cost", 8))


@query("a5_sessions", f"""{cte('calls', 'prices')} SELECT session_id, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT model)::BIGINT AS models, sum(tokens)::BIGINT AS tokens, round(sum(tokens * price / 1e6), 8) AS cost FROM calls LEFT JOIN prices USING (model) GROUP BY 1""")
def a5s(spark, sf):
    return logs.sessions(view(spark, sf, "calls"), view(spark, sf, "prices")).withColumn("cost", F.round("cost", 8))


@query("a6_breakdown", f"{cte('calls')} SELECT purpose, model, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, sum(1 - ok)::BIGINT AS failed FROM calls GROUP BY ROLLUP (purpose, model)")
def a6(spark, sf):
    return logs.breakdown(view(spark, sf, "calls"))


@query("a7_calibration", f"{cte('evidence')} SELECT agreed, count(*)::BIGINT AS n, sum(correct)::BIGINT AS correct, round(sum(correct) / count(*), 3) AS share FROM evidence GROUP BY 1")
def a7(spark, sf):
    return logs.calibration(view(spark, sf, "evidence"))


_DUR = f"""{cte('runlog')}, d AS (SELECT engagement_id, stage, id, "at", event, lead(event) OVER w AS nx, lead("at") OVER w AS nat FROM runlog WHERE event IN ('start', 'end', 'failed') WINDOW w AS (PARTITION BY engagement_id, stage ORDER BY id)),
    p AS (SELECT engagement_id, stage, id, epoch_us(nat) - epoch_us("at") AS micros FROM d WHERE event = 'start' AND nx = 'end')"""


@query("a8_typical", f"""{_DUR}, o AS (SELECT engagement_id, stage, arg_max(micros, id) AS own FROM p GROUP BY 1, 2), r AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY stage ORDER BY id DESC) <= 10),
    u AS (SELECT stage, micros AS usual FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY micros, id) AS i, count(*) OVER (PARTITION BY stage) AS n FROM r) WHERE i = n // 2 + 1)
    SELECT e.engagement_id, e.stage, coalesce(own, usual)::BIGINT AS micros FROM (SELECT DISTINCT engagement_id, stage FROM runlog) e LEFT JOIN o USING (engagement_id, stage) LEFT JOIN u USING (stage)""")
def a8(spark, sf):
    return logs.typical(view(spark, sf, "runlog"))


_DOCS = "FROM documents"


@query("x1_normal_forms", f"""SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'), ' ')) AS fold, md5(trim(regexp_replace(regexp_replace(lower(text), '\\b(?:19|20)\\d\\d\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' ')) AS bare,
    md5(regexp_replace(lower(text), '[ \\t\\n\\f\\r\\x0B\\-_./&()'']+', '', 'g')) AS squash, md5(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z][a-z0-9]+)', 1), lambda x: x NOT IN ('the', 'and', 'of', 'for', 'to', 'in')))), ' ')) AS tokens {_DOCS}""")
def x1(spark, sf):
    from fleetroll.operators.match import tokens

    d, t = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null"), F.col("text")
    forms = {"fold": text.fold(t), "bare": text.bare_label(t), "squash": text.squash(t), "tokens": F.array_join(F.array_sort(tokens(t)), " ")}
    return d.select("doc_id", *[F.md5(c).alias(n) for n, c in forms.items()])


@query("x2_numbers", f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(\\(?-?[$€£]?\\d[\\d,]*(?:\\.\\d+)?%?\\)?)', 1), lambda x: CASE WHEN (x LIKE '(%' AND x LIKE '%)') OR x LIKE '%-%' THEN '-' ELSE '' END || regexp_replace(x, '[(),$€£\\-]', '', 'g')), '|') AS numbers {_DOCS}""")
def x2(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.array_join(text.numbers(F.col("text")), "|").alias("numbers"))


@query("x6_mask", f"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)\\b\\d{{1,2}} (?:{text.MONTHS})[a-z]* \\d{{4}}\\b|\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b', '[a date]', 'g'), '\\d[\\d,]*(?:\\.\\d+)?%?', '#', 'g')) AS masked {_DOCS}""")
def x6(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.md5(text.mask(F.col("text"))).alias("masked"))


@query("x14_basis_counts", f"SELECT doc_id, len(regexp_extract_all(lower(text), '\\bex[- ]'))::INT AS ex, len(regexp_extract_all(lower(text), '\\bcum[- ]'))::INT AS cum {_DOCS}")
def x14(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", text.basis_counts(F.col("text")).alias("b")).select("doc_id", "b.*")


_F8 = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'R[-' || p_size || ']C' || p_size || '+''My ' || p_type || '''!R' || p_partkey || 'C3*R[2]C[-1]'
    WHEN 1 THEN 'SUM(R[-' || p_size || ']C:R[-1]C)/Costs.2!R5C' || p_size ELSE 'IF(RC[-' || p_size || ']>0,ROUND(R' || p_partkey || 'C,2),FACTOR(C7)*RATE1)' END AS f FROM part"""


@query("t8_formula_shape", f"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '(''[^'']+''|[A-Za-z_][A-Za-z0-9_.]*)!', '!', 'g'), '\\[-?[0-9]+\\]', '[]', 'g'), '\\bR[0-9]+', 'R#', 'g'), 'C[0-9]+\\b', 'C#', 'g') AS shape FROM ({_F8})""")
def t8(spark, sf):
    n, k = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    f = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("R[-"), n, F.lit("]C"), n, F.lit("+'My "), F.col("p_type"), F.lit("'!R"), k, F.lit("C3*R[2]C[-1]")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("SUM(R[-"), n, F.lit("]C:R[-1]C)/Costs.2!R5C"), n))
        .otherwise(F.concat(F.lit("IF(RC[-"), n, F.lit("]>0,ROUND(R"), k, F.lit("C,2),FACTOR(C7)*RATE1)")))
    )
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", text.formula_shape(f).alias("shape"))


@query("v12_ties", "SELECT p_partkey, abs(p_retailprice * 1.0003 - round(p_retailprice, 1)) <= 0.05 + 1e-9 AS ties FROM part")
def v12(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", text.ties(F.col("p_retailprice") * 1.0003, F.format_number(F.round("p_retailprice", 1), 1)).alias("ties"))


@query("s3_dedup_files", "SELECT doc_id AS id, sha256(text) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars, doc_id) = 1")
def s3(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("uploaded_at"))
    return tables.dedup_files(d).select("id", "sha256")


@query("s4_patch_cells", f"{cte('series', 'series_now')} SELECT s.workbook_id, s.sheet, s.row_no, s.period_end, coalesce(p.value, s.value) AS value, p.value IS NOT NULL AS patched FROM series s LEFT JOIN (SELECT * FROM series_now WHERE workbook_id % 3 = 0) p USING (workbook_id, sheet, row_no, period_end)")
def s4(spark, sf):
    return tables.patch_cells(view(spark, sf, "series"), view(spark, sf, "series_now").where("workbook_id % 3 = 0"), [*KEY, "period_end"], "value").select(*KEY, "period_end", "value", "patched")


@query("s6_redact", "SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM part WHERE p_size < 3) THEN p_name ELSE '<redacted>' END AS p_name FROM part")
def s6(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size")
    return tables.redact(p, p.where("p_size < 3").select(F.col("p_name").alias("word")), "p_name", "p_brand")[0].select("p_partkey", "p_name")


def _factored(spark, sf):
    return fin.factors(view(spark, sf, "flows"), view(spark, sf, "discountings"))


@query("v11_split", f"""{_PV}, s AS (SELECT core_id, sum(CASE WHEN period_end <= DATE '2000-12-31' THEN cf * factor ELSE 0 END) AS f, sum(CASE WHEN period_end > DATE '2000-12-31' THEN cf * factor ELSE 0 END) AS t FROM f GROUP BY 1)
    SELECT core_id, round(f, 4) AS forecast, round(t, 4) AS terminal, CASE WHEN f + t <> 0 THEN round(t / (f + t), 9) END AS terminal_share FROM s""")
def v11(spark, sf):
    out = value.split(_factored(spark, sf), F.col("period_end") > "2000-12-31")
    return out.select("core_id", F.round("forecast", 4).alias("forecast"), F.round("terminal", 4).alias("terminal"), F.round("terminal_share", 9).alias("terminal_share"))


_POINTS = f"""{_PV}, k AS (SELECT d.* EXCLUDE (rate), rate + 0.01 AS rate FROM discountings d), g AS ({sql_factors('flows', 'k')}),
    p AS (SELECT core_id, 'report' AS point, 1 AS step_no, round(sum(cf * factor), 0) AS value FROM f GROUP BY 1 UNION ALL SELECT core_id, 'rebuilt', 2, sum(cf * factor) FROM f GROUP BY 1 UNION ALL SELECT core_id, 'this_year', 3, sum(cf * factor) FROM g GROUP BY 1)"""


def _points(spark, sf):
    flows, d = view(spark, sf, "flows"), view(spark, sf, "discountings")
    a, b = fin.dcf(flows, d), fin.dcf(flows, d.withColumn("rate", F.col("rate") + 0.01))
    return a.select("core_id", F.lit("report").alias("point"), F.round("pv", 0).alias("value")).union(a.select("core_id", F.lit("rebuilt"), "pv")).union(b.select("core_id", F.lit("this_year"), "pv"))


@query("v14_bridge", f"{_POINTS} SELECT core_id, point, step_no, round(value - coalesce(lag(value) OVER (PARTITION BY core_id ORDER BY step_no), 0), 3) AS change FROM p")
def v14(spark, sf):
    return value.bridge(_points(spark, sf), ["report", "rebuilt", "this_year"], ["core_id"]).select("core_id", "point", "step_no", F.round("change", 3).alias("change"))


@query("v15_waterfall", f"""{_POINTS}, c AS (SELECT core_id, step_no, value AS aft, coalesce(lag(value) OVER (PARTITION BY core_id ORDER BY step_no), 0) AS bef FROM p)
    SELECT core_id, step_no, round(aft, 3) AS after, round(CASE WHEN step_no = 1 THEN least(0, aft) ELSE least(bef, aft) END, 3) AS base, round(greatest(aft - bef, 0), 3) AS up, round(greatest(bef - aft, 0), 3) AS down FROM c""")
def v15(spark, sf):
    b = value.bridge(_points(spark, sf), ["report", "rebuilt", "this_year"], ["core_id"]).select("core_id", "step_no", F.col("change").alias("amount"), (F.col("step_no") == 1).alias("is_total"))
    return value.waterfall(b, ["core_id"]).select("core_id", "step_no", *[F.round(c, 3).alias(c) for c in ("after", "base", "up", "down")])


@query("v16_split_step", f"""{_PV}, r AS (SELECT core_id, period_end, cf AS r FROM flows WHERE (core_id + month(period_end)) % 7 <> 0), t AS (SELECT core_id, period_end, cf * 1.1 AS t FROM flows WHERE (core_id + month(period_end)) % 5 <> 0)
    SELECT core_id, round(sum(CASE WHEN r IS NOT NULL AND t IS NOT NULL THEN (t - r) * factor ELSE 0 END), 4) AS revised, round(sum(CASE WHEN r IS NULL THEN t * factor ELSE 0 END), 4) AS added, round(sum(CASE WHEN t IS NULL THEN -r * factor ELSE 0 END), 4) AS dropped
    FROM r FULL JOIN t USING (core_id, period_end) JOIN f USING (core_id, period_end) GROUP BY 1""")
def v16(spark, sf):
    flows = view(spark, sf, "flows")
    n = F.col("core_id") + F.month("period_end")
    out = value.split_step(flows.where(n % 7 != 0), flows.where(n % 5 != 0).withColumn("cf", F.col("cf") * 1.1), _factored(spark, sf))
    return out.select("core_id", *[F.round(c, 4).alias(c) for c in ("revised", "added", "dropped")])


@query("c2_stale", f"""{cte('series', 'series_now')}, j AS (SELECT workbook_id, sheet, row_no, abs(p.value - c.value) <= 1e-9 * greatest(1.0, abs(p.value), abs(c.value)) AS same FROM series p JOIN series_now c USING (workbook_id, sheet, row_no, period_end) WHERE period_end > DATE '1999-12-31')
    SELECT workbook_id, sheet, row_no, count(*)::BIGINT AS periods, count(*) FILTER (same)::BIGINT AS equal, bool_and(same) AS stale FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def c2(spark, sf):
    return checks.stale(view(spark, sf, "series"), view(spark, sf, "series_now"), KEY, F.lit("1999-12-31").cast("date"))


@query("c2_stale_forecast", f"""{cte('series', 'series_now')}, j AS (SELECT workbook_id, sheet, row_no, abs(p.value - c.value) <= 1e-9 * greatest(1.0, abs(p.value), abs(c.value)) AS same FROM series p JOIN series_now c USING (workbook_id, sheet, row_no, period_end) WHERE period_end > DATE '1999-12-31'),
    g AS (SELECT workbook_id, sheet, row_no, count(*)::BIGINT AS periods, count(*) FILTER (same)::BIGINT AS equal FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 2), r AS (SELECT l_suppkey AS workbook_id, l_returnflag AS sheet, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS row_no, l_partkey AS row FROM lineitem GROUP BY ALL),
    n AS (SELECT workbook_id, sheet, row_no, count(*)::BIGINT AS k FROM r JOIN part ON p_partkey = row WHERE p_size = 7 AND row % 5 = 0 GROUP BY 1, 2, 3)
    SELECT workbook_id, sheet, row_no, periods, equal, coalesce(k, 0) AS changed_rows, CASE WHEN periods = equal THEN CASE WHEN k > 0 THEN 'block' ELSE 'check' END END AS finding FROM g LEFT JOIN n USING (workbook_id, sheet, row_no)""")
def c2_forecast(spark, sf):
    """A model's forecasts read the parts it sells; some parts have changed."""
    l, p = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/part.parquet")
    reads = l.select(F.col("l_suppkey").alias("workbook_id"), F.col("l_returnflag").alias("sheet"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("row_no"), F.col("l_partkey").alias("row")).distinct()
    changes = p.where("p_size = 7 and p_partkey % 5 = 0").select(F.col("p_partkey").alias("row"))
    return checks.stale_forecast(view(spark, sf, "series"), view(spark, sf, "series_now"), reads, changes, KEY, F.lit("1999-12-31").cast("date"))


@query("c4_sign_flip", f"""{_PV} SELECT core_id, (a < 0 AND b > 0 OR a > 0 AND b < 0) AND abs(a) > 20000 AND abs(b) > 20000 AS flips FROM (SELECT core_id, round(sum(cf * factor), 4) AS a, round(sum(cf * factor) - 500000, 4) AS b FROM f GROUP BY 1)""")
def c4(spark, sf):
    pv = fin.dcf(view(spark, sf, "flows"), view(spark, sf, "discountings")).select("core_id", F.round("pv", 4).alias("a"), F.round(F.col("pv") - 500000, 4).alias("b")).withColumn("t", F.lit(2e6))
    return checks.sign_flip(pv, "a", "b", "t").select("core_id", "flips")


@query("c5_uncut", f"{_PV} SELECT core_id, count(*)::BIGINT AS periods, round(sum(cf * factor), 4) AS value FROM f WHERE period_end <= DATE '1998-06-30' AND cf * factor <> 0 GROUP BY 1")
def c5(spark, sf):
    return checks.uncut(_factored(spark, sf), F.lit("1998-06-30").cast("date")).withColumn("value", F.round("value", 4))


@query("c6_mid_period", f"""{cte('flows', 'discountings')}, p AS (SELECT core_id, lag(period_end) OVER (PARTITION BY core_id ORDER BY period_end) AS start, period_end FROM flows)
    SELECT core_id, start, period_end, round((valuation_date - start) / (period_end - start), 9) AS elapsed FROM p JOIN discountings USING (core_id) WHERE valuation_date - start > 3 AND period_end - valuation_date > 3""")
def c6(spark, sf):
    d = view(spark, sf, "discountings").select("core_id", F.col("valuation_date").alias("new_date"))
    return checks.mid_period(view(spark, sf, "flows"), d).withColumn("elapsed", F.round("elapsed", 9))


@query("c12_inputs_moved", f"{cte('rows_prior', 'rows_now')} SELECT p.workbook_id, p.row_no, p.figure AS last, n.figure AS this FROM rows_prior p JOIN rows_now n ON p.row_no = n.row_no - 2 WHERE abs(p.figure - n.figure) > 1e-9 * greatest(1.0, abs(p.figure), abs(n.figure))")
def c12(spark, sf):
    p = view(spark, sf, "rows_prior").select("workbook_id", "row_no", F.col("figure").alias("value"))
    n = view(spark, sf, "rows_now").select("workbook_id", (F.col("row_no") - 2).alias("row_no"), F.col("figure").alias("value"))
    return checks.inputs_moved(p, n, ["workbook_id", "row_no"])


@query("c14_current_decisions", """SELECT key, value, is_person, "at" FROM (SELECT user_id AS key, CASE WHEN event_type <> 'signup' THEN event_type END AS value, event_type = 'purchase' AS is_person, ts AS "at", row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS r
    FROM events WHERE event_id % 3 = user_id % 3) WHERE r = 1 AND value IS NOT NULL""")
def c14(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    log = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.when(F.col("event_type") != "signup", F.col("event_type")).alias("value"), (F.col("event_type") == "purchase").alias("is_person"), F.col("ts").alias("at"), (F.col("event_id") % 3).alias("files_key"))
    return checks.current_decisions(log, e.select(F.col("user_id").alias("key"), (F.col("user_id") % 3).alias("current_files_key")).distinct())


@query("c15_validate", f"""{cte('series', 'series_now')}, j AS (SELECT workbook_id, p.value AS s, c.value AS c FROM series p FULL JOIN series_now c USING (workbook_id, sheet, row_no, period_end)), k AS (SELECT *, coalesce(abs(s - c) <= 1e-7 * greatest(1.0, abs(s), abs(c)), false) AS same FROM j)
    SELECT workbook_id, count(*) FILTER (same)::BIGINT AS matched, count(*) FILTER (s IS NOT NULL AND c IS NOT NULL AND NOT same)::BIGINT AS mismatched, count(*) FILTER (c IS NULL)::BIGINT AS not_computed, count(*) FILTER (s IS NULL)::BIGINT AS not_saved FROM k GROUP BY 1""")
def c15(spark, sf):
    return checks.validate(view(spark, sf, "series_now"), view(spark, sf, "series"), [*KEY, "period_end"])
