"""Queries on the evidence for row matches, and on what follows from the matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.operators import evidence, match
from fleetroll.sources.adapters import cte, view
from fleetroll.sources.tables import written

from .q_match import _J2, _J3, _J4, _N, _T
from .registry import query

PAIR = ["workbook_id", "row_no", "cur_row"]
P = "workbook_id, row_no, cur_row"


def _v(spark, sf, *names):
    return [view(spark, sf, f"model_{n}") for n in names]


def _around(edges: str, rows: str, steps: int) -> str:
    one = f"(SELECT DISTINCT workbook_id, 0 AS side, src AS row_no, dst AS other FROM {edges} UNION SELECT workbook_id, 1, dst, src FROM {edges})"
    near = one if steps == 1 else f"(FROM {one} UNION SELECT a.workbook_id, a.side, a.row_no, b.other FROM {one} a JOIN {one} b ON b.workbook_id = a.workbook_id AND b.side = a.side AND b.row_no = a.other WHERE b.other <> a.row_no)"
    return f"SELECT DISTINCT n.workbook_id, side, n.row_no, {_N('label')} AS item FROM {near} n JOIN {rows} r ON r.workbook_id = n.workbook_id AND r.row_no = n.other WHERE {_N('label')} <> ''"


def _alike(name: str, steps: int, least: float) -> str:
    return f"""{name}_p AS ({_around('model_edges', 'model_rows', steps)}), {name}_c AS ({_around('model_edges_now', 'model_rows_now', steps)}),
    {name}_n AS (SELECT workbook_id, side, row_no, count(*) AS na FROM {name}_p GROUP BY ALL), {name}_m AS (SELECT workbook_id, side, row_no AS cur_row, count(*) AS nb FROM {name}_c GROUP BY ALL),
    {name}_b AS (SELECT p.workbook_id, p.side, p.row_no, c.row_no AS cur_row, count(*) AS n FROM {name}_p p JOIN {name}_c c USING (workbook_id, side, item) GROUP BY ALL),
    {name}_j AS (SELECT {P}, sum(n / (na + nb - n)) AS j FROM {name}_b JOIN {name}_n USING (workbook_id, side, row_no) JOIN {name}_m USING (workbook_id, side, cur_row) GROUP BY ALL),
    {name} AS (SELECT {P}, j / (SELECT count(*) FROM {name}_n x WHERE x.workbook_id = {name}_j.workbook_id AND x.row_no = {name}_j.row_no) AS score FROM {name}_j)"""


_V = cte("model_rows", "model_rows_now", "model_edges", "model_edges_now", "model_points", "model_points_now")
_NEAR = f"{_alike('nr', 1, 0.34)}, neighbours AS (SELECT {P}, score FROM nr WHERE score >= 0.34 QUALIFY row_number() OVER (PARTITION BY workbook_id, row_no ORDER BY score DESC, cur_row) <= 3)"


@query("j5_by_neighbours", f"{_V}, {_NEAR} SELECT {P}, round(score, 9) AS score FROM neighbours")
def j5(spark, sf):
    e, en, r, rn = _v(spark, sf, "edges", "edges_now", "rows", "rows_now")
    return evidence.by_neighbours(e, en, r, rn).withColumn("score", F.round("score", 9))


_BANNER = f"""bm AS (SELECT e.workbook_id, e.dst AS row_no, e.src, {_N('r.label')} AS item FROM model_edges e JOIN model_rows r ON r.workbook_id = e.workbook_id AND r.row_no = e.src WHERE e.src <= 10),
    bt AS (SELECT workbook_id, src, min(dst) AS cur_row FROM model_edges_now WHERE dst > 10 GROUP BY 1, 2 HAVING count(DISTINCT dst) = 1), bn AS (SELECT t.workbook_id, t.src AS cur_src, cur_row, {_N('r.label')} AS item FROM bt t JOIN model_rows_now r ON r.workbook_id = t.workbook_id AND r.row_no = t.src WHERE t.src <= 10),
    banner AS (SELECT {P}, least(1.0, 0.7 * count(*)) AS score FROM (SELECT DISTINCT workbook_id, row_no, cur_row, src, cur_src FROM bm JOIN bn USING (workbook_id, item)) GROUP BY ALL)"""


@query("j6_by_banner", f"{_V.replace('model_edges AS (', 'me AS (').replace('model_edges_now AS (', 'mn AS (')}, model_edges AS (SELECT * FROM me WHERE src > 10 OR dst >= src + 20), model_edges_now AS (SELECT * FROM mn WHERE src > 10 OR dst >= src + 20), {_BANNER} SELECT {P}, round(score, 9)::DOUBLE AS score FROM banner")
def j6(spark, sf):
    e, en, r, rn = _v(spark, sf, "edges", "edges_now", "rows", "rows_now")
    own = lambda d: d.where("src > 10 or dst >= src + 20")
    return evidence.by_banner(own(e), own(en), r, rn).withColumn("score", F.round("score", 9))


_BLOCKS = lambda rows: f"SELECT workbook_id, CAST(floor(row_no / 10) AS BIGINT) AS block, concat(min(section) OVER (PARTITION BY workbook_id, CAST(floor(row_no / 10) AS BIGINT)), ' block ', CASE CAST(floor(row_no / 10) AS BIGINT) % 4 WHEN 0 THEN 'income' WHEN 1 THEN 'costs' WHEN 2 THEN 'debt service' ELSE 'equity flows' END) AS heading, row_no, CASE WHEN row_no % 9 = 4 THEN '' ELSE label END AS label FROM {rows}"


_BLOCK = f"""x AS ({_BLOCKS('model_rows')}), y AS ({_BLOCKS('model_rows_now')}),
    a AS (SELECT *, {_N('label')} AS l, row_number() OVER (PARTITION BY workbook_id, block ORDER BY row_no) AS place, count(*) OVER (PARTITION BY workbook_id, block) AS size, {_T('heading')} AS w FROM x),
    b AS (SELECT workbook_id, block AS cur_block, row_no AS cur_row, {_N('label')} AS cl, row_number() OVER (PARTITION BY workbook_id, block ORDER BY row_no) AS cur_place, count(*) OVER (PARTITION BY workbook_id, block) AS cur_size, {_T('heading')} AS cw FROM y),
    p AS (SELECT *, len(list_intersect(w, cw)) / (len(w) + len(cw) - len(list_intersect(w, cw))) AS j FROM a JOIN b USING (workbook_id)), q AS (SELECT * FROM p WHERE j >= 0.5),
    s AS (SELECT workbook_id, row_no, cur_block, j, count(*) AS n, min(cur_row) AS cur_row FROM q WHERE l <> '' AND l = cl GROUP BY ALL),
    u AS (SELECT {P}, round(j, 2) AS score FROM s WHERE n = 1 UNION ALL SELECT {P}, round(CASE WHEN l = '' THEN 0.6 ELSE 0.5 END * j, 2) FROM q ANTI JOIN s USING (workbook_id, row_no, cur_block) WHERE size = cur_size AND place = cur_place)
    SELECT {P}, max(score)::DOUBLE AS score FROM u GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY workbook_id, row_no ORDER BY max(score) DESC, cur_row) <= 3""".replace("GROUP BY ALL QUALIFY", f"GROUP BY {P} QUALIFY")


@query("j8_by_block", f"{cte('model_rows', 'model_rows_now')}, {_BLOCK}")
def j8(spark, sf):
    rows, now = (spark.sql(_BLOCKS("{r}"), r=d) for d in _v(spark, sf, "rows", "rows_now"))
    return evidence.by_block(rows, now)


@query("j9_by_lineage", f"{_V}, {_NEAR}, {_alike('li', 2, 0.5)} SELECT {P}, round(li.score, 9) AS score FROM li SEMI JOIN neighbours USING ({P}) WHERE li.score >= 0.5")
def j9(spark, sf):
    e, en, r, rn = _v(spark, sf, "edges", "edges_now", "rows", "rows_now")
    return evidence.by_lineage(e, en, r, rn, evidence.by_neighbours(e, en, r, rn)).withColumn("score", F.round("score", 9))


@query("j7_by_trace")
def j7(spark, sf):
    """A walk of several hops; a test holds it against brute force."""
    e, en, r, rn, s, sn = _v(spark, sf, "edges", "edges_now", "rows", "rows_now", "points", "points_now")
    agree = written(evidence.numbers_agree(r, rn, s, sn), "agree")
    label = match.by_label(r, rn).where("how = 'label'").select("workbook_id", "row_no", "cur_row")
    anchors = label.join(evidence.by_row(agree), ["workbook_id", "row_no"]).where(F.array_contains("found", F.col("cur_row"))).select(*PAIR)
    return evidence.by_trace(e, en, written(anchors, "anchors"), evidence.pair_scores(r, rn, s, sn, agree), agree)


_CELLS = lambda rows, now: f"SELECT workbook_id, row_no, CASE WHEN row_no % 4 = 1 THEN 0 ELSE 6 END + CASE WHEN {now} AND row_no % 6 = 0 THEN -6 ELSE 0 END AS n_formula, 6 - CASE WHEN row_no % 4 = 1 THEN 0 ELSE 6 END + CASE WHEN {now} AND row_no % 6 = 0 THEN 6 ELSE 0 END AS n_const FROM {rows}"
_NN = lambda c: f"greatest({c}, 0)"
_SHAPE = lambda rows, now: f"SELECT workbook_id, row_no, {_NN('n_formula')} AS n_formula, {_NN('n_const')} AS n_const FROM ({_CELLS(rows, now)}) z"
_LABEL = f"lb AS (SELECT p.workbook_id, p.row_no, c.row_no AS cur_row, CASE WHEN p.sheet = c.sheet THEN 1.0 ELSE 0.8 END AS score FROM model_rows p JOIN model_rows_now c ON c.workbook_id = p.workbook_id AND {_N('c.label')} = {_N('p.label')})"
_ODD = f"""sa AS ({_SHAPE('model_rows', 'false')}), sb AS ({_SHAPE('model_rows_now', 'true')}), shaped AS (SELECT {P} FROM (SELECT DISTINCT {P} FROM ev) e JOIN sa USING (workbook_id, row_no) JOIN (SELECT workbook_id, row_no AS cur_row, n_formula AS f2, n_const AS c2 FROM sb) q USING (workbook_id, cur_row)
      WHERE n_formula + n_const > 0 AND f2 + c2 > 0 AND abs(n_formula / (n_formula + n_const) - f2 / (f2 + c2)) >= 0.6),
    sh AS (SELECT {P}, count(*) AS n, bool_and(abs(c.value - p.value) <= 1e-9 * greatest(1, abs(p.value))) AS same FROM shaped JOIN model_points p USING (workbook_id, row_no) JOIN (SELECT workbook_id, row_no AS cur_row, period_end, value FROM model_points_now) c USING (workbook_id, cur_row, period_end) WHERE p.value <> 0 GROUP BY {P}),
    pasted AS (SELECT {P} FROM sh WHERE n >= 3 AND same)"""
_EV = f"""{_J2}, {_J3('model_points', 'model_points_now')}, {_J4}, {_NEAR}, {_LABEL}, ev0 AS (SELECT {P}, 'label' AS strategy, score FROM lb UNION ALL SELECT {P}, 'history', score FROM history UNION ALL SELECT {P}, 'words', score FROM words UNION ALL SELECT {P}, 'neighbours', score FROM neighbours)"""


def _labels(r, rn):
    a = r.select("workbook_id", "row_no", "sheet", match.norm(F.col("label")).alias("l"))
    b = rn.select("workbook_id", F.col("row_no").alias("cur_row"), F.col("sheet").alias("cur_sheet"), match.norm(F.col("label")).alias("l"))
    return a.join(b, ["workbook_id", "l"]).select(*PAIR, F.when(F.col("sheet") == F.col("cur_sheet"), 1.0).otherwise(0.8).alias("score"))


def _evidence(spark, sf):
    r, rn, e, en, s, sn = _v(spark, sf, "rows", "rows_now", "edges", "edges_now", "points", "points_now")
    kinds = {"label": _labels(r, rn), "history": match.by_history(s, sn), "words": match.by_words(r, rn, s, sn), "neighbours": evidence.by_neighbours(e, en, r, rn)}
    out = None
    for name, d in kinds.items():
        d = d.select(*PAIR, F.lit(name).alias("strategy"), "score")
        out = d if out is None else out.union(d)
    return written(out, "evidence"), r, rn, s, sn


def _odd(spark, sf, ev):
    a, b = (spark.sql(_SHAPE("{r}", now), r=d) for d, now in zip(_v(spark, sf, "rows", "rows_now"), ("false", "true")))
    return evidence.other_shape(ev, a, b)


@query("j11_exclude_copies", f"{_V}, {_EV}, ev AS (SELECT * FROM ev0), {_ODD} SELECT {P}, 'pasted' AS what FROM pasted UNION ALL SELECT {P}, 'shape' FROM shaped ANTI JOIN pasted USING ({P})")
def j11(spark, sf):
    ev, _, _, s, sn = _evidence(spark, sf)
    shapes = written(_odd(spark, sf, ev), "shapes")
    pasted = evidence.pasted_copies(ev, s, sn, shapes)
    return pasted.withColumn("what", F.lit("pasted")).union(shapes.join(pasted, PAIR, "left_anti").withColumn("what", F.lit("shape")))


@query("j11_suspects", f"""{_V}, {_LABEL}, m AS (SELECT workbook_id, row_no, row_no + CASE WHEN row_no > 10 AND workbook_id % 3 > 0 THEN 3 ELSE 0 END AS cur_row FROM model_rows),
    f AS (SELECT m.*, p.sheet, abs(c.value - p.value) <= 1e-9 * greatest(1, abs(p.value)) AS same FROM {{}} m JOIN model_points p USING (workbook_id, row_no) JOIN (SELECT workbook_id, row_no AS cur_row, period_end, value FROM model_points_now) c USING (workbook_id, cur_row, period_end) WHERE p.value <> 0 AND p.period_end > DATE '2022-06-30'),
    g AS (SELECT sheet, {P}, count(*) AS n, bool_and(same) AS still FROM f GROUP BY ALL)""".replace("FROM {} m", "FROM (SELECT DISTINCT workbook_id, row_no, cur_row FROM lb) m") + f""", h AS (SELECT sheet, m.workbook_id, m.row_no, m.cur_row, count(*) AS n, bool_and(abs(c.value - p.value) <= 1e-9 * greatest(1, abs(p.value))) AS still FROM m JOIN model_points p USING (workbook_id, row_no) JOIN (SELECT workbook_id, row_no AS cur_row, period_end, value FROM model_points_now) c USING (workbook_id, cur_row, period_end) WHERE p.value <> 0 AND p.period_end > DATE '2022-06-30' GROUP BY ALL)
    SELECT {P} FROM g WHERE n >= 3 AND still AND EXISTS (FROM h WHERE h.workbook_id = g.workbook_id AND h.sheet = g.sheet AND h.row_no <> g.row_no AND h.n >= 3 AND NOT h.still)""")
def j11_suspects(spark, sf):
    r, rn, s, sn = _v(spark, sf, "rows", "rows_now", "points", "points_now")
    m = r.select("workbook_id", "row_no", (F.col("row_no") + F.when((F.col("row_no") > 10) & (F.col("workbook_id") % 3 > 0), 3).otherwise(0)).alias("cur_row"))
    return evidence.suspect_copies(_labels(r, rn), m, s, sn, F.lit("2022-06-30").cast("date"))


#: A trace for every fourth row, to where it is now or the row after; the walk itself is held against brute force in a test.
_TRACE = "SELECT r.workbook_id, r.row_no, n.row_no AS cur_row, CASE WHEN r.row_no % 3 = 0 THEN 0.9 ELSE 0.6 END AS score FROM {r} r JOIN {n} n ON n.workbook_id = r.workbook_id AND n.row_no = r.row_no + CASE WHEN r.row_no > 10 AND r.workbook_id % 3 > 0 THEN 3 ELSE 0 END + CASE WHEN r.row_no % 8 = 1 THEN 1 ELSE 0 END WHERE r.row_no % 4 = 1"
_OWN = lambda e: f"(SELECT * FROM {e} WHERE src > 10 OR dst >= src + 20)"
_EV8 = f"""{_EV}, {_BANNER.replace('FROM model_edges e', f"FROM {_OWN('model_edges')} e").replace('FROM model_edges_now', f"FROM {_OWN('model_edges_now')}")}, block AS (WITH {_BLOCK}), {_alike('li', 2, 0.5)}, trace AS ({_TRACE.format(r='model_rows', n='model_rows_now')}),
    ev AS (SELECT * FROM ev0 UNION ALL SELECT {P}, 'banner', score FROM banner UNION ALL SELECT {P}, 'block', score FROM block UNION ALL SELECT {P}, 'lineage', score FROM li SEMI JOIN neighbours USING ({P}) WHERE score >= 0.5 UNION ALL SELECT {P}, 'trace', score FROM trace)"""
_case = lambda t, rest: "CASE strategy " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items()) + f" ELSE {rest} END"

_DECIDE = f"""pasted0 AS (SELECT 1), {_ODD}, keep AS (SELECT * FROM ev ANTI JOIN pasted USING ({P})), best AS (SELECT {P}, strategy, max(score)::DOUBLE AS score FROM keep GROUP BY {P}, strategy),
    wt AS (SELECT *, {_case(evidence.WEIGHTS, 0)}::DOUBLE AS w, {_case(evidence.STRONG, 9)}::DOUBLE AS s FROM best),
    tt AS (SELECT {P}, sum(w * score)::DOUBLE AS total, bool_or(score >= s) AS strong, max(score) FILTER (strategy = 'label') AS label, max(score) FILTER (strategy = 'history') AS history, max(score) FILTER (strategy = 'trace') AS trace, arg_max(strategy, struct_pack(a := round(w * score, 9)::DOUBLE, b := strategy)) AS how FROM wt GROUP BY {P}),
    od AS (SELECT {P} FROM shaped),
    t2 AS (SELECT {P}, round(total + CASE WHEN m.cur_sheet IS NULL THEN 0 WHEN n.sheet = m.cur_sheet THEN 0.1 WHEN trace IS NOT NULL THEN 0 ELSE -0.1 END - CASE WHEN od.row_no IS NULL THEN 0 ELSE 0.2 END, 9) AS total, strong AND od.row_no IS NULL AS strong, od.row_no IS NOT NULL AS odd, coalesce(tt.label, 0) >= 1 AND history IS NOT NULL AND od.row_no IS NULL AS sure, how, tt.label, history, trace
      FROM tt JOIN model_rows r USING (workbook_id, row_no) LEFT JOIN sheet_map m ON m.workbook_id = r.workbook_id AND m.sheet = r.sheet LEFT JOIN model_rows_now n ON n.workbook_id = tt.workbook_id AND n.row_no = tt.cur_row LEFT JOIN od USING ({P})),
    co AS (SELECT {P} FROM t2 JOIN model_points p USING (workbook_id, row_no) JOIN (SELECT workbook_id, row_no AS cur_row, period_end, value AS now FROM model_points_now) c USING (workbook_id, cur_row, period_end) WHERE value <> 0 GROUP BY {P} HAVING NOT bool_or(abs(now - value) <= 1e-9 * greatest(1.0, abs(value)))),
    sg AS (SELECT workbook_id, row_no AS cur_row, string_agg(period_end || '=' || round(value, 6), ';' ORDER BY period_end) AS sig FROM model_points_now GROUP BY 1, 2),
    rk AS (SELECT t2.*, co.row_no IS NOT NULL AS contra, coalesce(sig, '') AS sig, row_number() OVER (PARTITION BY t2.workbook_id, t2.row_no ORDER BY sure DESC, strong DESC, total DESC, t2.cur_row) AS r FROM t2 LEFT JOIN co USING ({P}) LEFT JOIN sg ON sg.workbook_id = t2.workbook_id AND sg.cur_row = t2.cur_row),
    ky AS (SELECT workbook_id, row_no, max(trace) AS lead, arg_max(cur_row, struct_pack(a := trace, b := cur_row)) FILTER (trace IS NOT NULL) AS led, min(r) FILTER (history >= 0.5 AND NOT odd) AS hist, bool_or(r = 1 AND history IS NULL AND contra) AS gives, list(sig) FILTER (r BETWEEN 2 AND 4) AS nxt FROM rk GROUP BY 1, 2),
    ch AS (SELECT rk.*, lead, led, coalesce(history, 0) >= 0.5 AND NOT odd AND len(nxt) > 0 AND len(list_filter(nxt, lambda x: x <> sig)) = 0 AND sig <> '' AS same FROM rk JOIN ky USING (workbook_id, row_no) WHERE r = CASE WHEN gives AND hist IS NOT NULL THEN hist ELSE 1 END),
    t3 AS (SELECT *, CASE WHEN same THEN greatest(total, 0.5) ELSE total END AS cf, coalesce(lead, 0) >= 0.7 AND led <> cur_row AND trace IS NULL AND NOT (label IS NOT NULL AND history IS NOT NULL) AS away FROM ch),
    t4 AS (SELECT *, greatest(0, least(1, CASE WHEN away THEN least(cf, 0.49) ELSE cf END)) AS c FROM t3),
    decided AS (SELECT workbook_id, row_no, CASE WHEN pick THEN row_no + 1 ELSE cur_row END AS cur_row, round(CASE WHEN pick THEN 1.0 ELSE c END, 6)::DOUBLE AS confidence, CASE WHEN pick THEN 'pick' ELSE how END AS how,
      CASE WHEN pick THEN 'picked' WHEN NOT (strong OR total >= 0.3) THEN 'open' WHEN c >= 0.5 THEN 'confident' ELSE 'accepted' END AS status FROM (SELECT *, row_no % 25 = 3 AS pick FROM t4))"""


def _decided(spark, sf):
    """All eight kinds of evidence, less pasted copies, decided."""
    ev, r, rn, s, sn = _evidence(spark, sf)
    e, en = _v(spark, sf, "edges", "edges_now")
    own = lambda d: d.where("src > 10 or dst >= src + 20")
    rows, now = (spark.sql(_BLOCKS("{r}"), r=d) for d in (r, rn))
    more = {"banner": evidence.by_banner(own(e), own(en), r, rn), "block": evidence.by_block(rows, now), "lineage": evidence.by_lineage(e, en, r, rn, evidence.by_neighbours(e, en, r, rn)), "trace": spark.sql(_TRACE, r=r, n=rn)}
    for name, d in more.items():
        ev = ev.union(d.select(*PAIR, F.lit(name), F.col("score").cast("double")))
    ev = written(ev, "evidence")
    odd = written(_odd(spark, sf, ev), "odd")
    ev = ev.join(evidence.pasted_copies(ev, s, sn, odd), PAIR, "left_anti")
    picks = r.where("row_no % 25 = 3").select("workbook_id", "row_no", (F.col("row_no") + 1).alias("cur_row"))
    return evidence.decide(ev, r, rn, odd, picks, series=s, series_now=sn)


@query("j10_decide", f"{_V}, {_EV8}, {_DECIDE} SELECT * FROM decided")
def j10(spark, sf):
    return _decided(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query("j15_term_changes", f"""{_V}, m AS (SELECT workbook_id, row_no, row_no + CASE WHEN row_no > 10 AND workbook_id % 3 > 0 THEN 3 ELSE 0 END AS cur_row FROM model_rows), n AS (SELECT m.* FROM m JOIN model_rows_now r ON r.workbook_id = m.workbook_id AND r.row_no = m.cur_row),
    a AS (SELECT DISTINCT n.*, dst AS term FROM n JOIN model_edges e ON e.workbook_id = n.workbook_id AND e.src = n.row_no), b AS (SELECT DISTINCT n.*, dst AS now FROM n JOIN model_edges_now e ON e.workbook_id = n.workbook_id AND e.src = n.cur_row),
    mm AS (SELECT workbook_id, row_no AS term, cur_row AS now FROM n), p AS (SELECT a.*, b.now FROM a JOIN mm USING (workbook_id, term) JOIN b USING ({P}, now)),
    z AS (SELECT {P} FROM (SELECT {P}, count(*) AS k FROM a GROUP BY ALL) LEFT JOIN (SELECT {P}, count(DISTINCT term) AS q FROM p GROUP BY ALL) USING ({P}) WHERE 2 * coalesce(q, 0) >= k),
    gone AS (SELECT a.* FROM a SEMI JOIN z USING ({P}) ANTI JOIN p USING ({P}, term)), fresh AS (SELECT b.* FROM b SEMI JOIN z USING ({P}) ANTI JOIN p USING ({P}, now)),
    d1 AS (SELECT DISTINCT workbook_id, src, dst FROM model_edges_now), d2 AS (FROM d1 UNION SELECT a.workbook_id, a.src, b.dst FROM d1 a JOIN d1 b ON b.workbook_id = a.workbook_id AND b.src = a.dst), d3 AS (FROM d2 UNION SELECT a.workbook_id, a.src, b.dst FROM d2 a JOIN d1 b ON b.workbook_id = a.workbook_id AND b.src = a.dst),
    moved AS (SELECT gone.*, mm.now AS mv FROM gone JOIN mm USING (workbook_id, term)),
    still AS (SELECT moved.* FROM moved JOIN d3 ON d3.workbook_id = moved.workbook_id AND src = cur_row AND dst = mv), under AS (SELECT fresh.* FROM fresh JOIN moved USING ({P}) JOIN d3 ON d3.workbook_id = fresh.workbook_id AND src = now AND dst = mv)
    SELECT {P}, term, 'gone' AS change FROM gone ANTI JOIN still USING ({P}, term) UNION ALL SELECT {P}, now, 'new' FROM fresh ANTI JOIN under USING ({P}, now)""")
def j15(spark, sf):
    r, rn, e, en = _v(spark, sf, "rows", "rows_now", "edges", "edges_now")
    m = r.select("workbook_id", "row_no", (F.col("row_no") + F.when((F.col("row_no") > 10) & (F.col("workbook_id") % 3 > 0), 3).otherwise(0)).alias("cur_row"))
    m = m.join(rn.select("workbook_id", F.col("row_no").alias("cur_row")), ["workbook_id", "cur_row"]).select(*PAIR)
    return match.term_changes(e, en, m, m)
