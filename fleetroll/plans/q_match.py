"""Queries on graphs, matching, versions and likeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.operators import graph, match
from fleetroll.sources.adapters import cte, view
from fleetroll.sources.tables import written

from .registry import query

_E = f"{cte('edges')}, e AS (SELECT src, dst, arg_max(kind, CASE kind WHEN 'direct' THEN 3 WHEN 'offset' THEN 2 WHEN 'active' THEN 1 ELSE 0 END) AS kind FROM edges WHERE src <> dst GROUP BY 1, 2), live AS (SELECT * FROM e WHERE kind <> 'inactive')"
_RE = _E.replace("WITH ", "WITH RECURSIVE ", 1)


def _edges(spark, sf):
    return graph.edges(view(spark, sf, "edges"))


@query("g1_edges", f"{_E} SELECT * FROM e")
def g1(spark, sf):
    return _edges(spark, sf)


@query("g1_line_items", f"{_E} SELECT * FROM e WHERE src % 7 <> 3 AND dst % 5 <> 2 AND dst % 7 <> 3 AND src % 5 <> 2")
def g1_items(spark, sf):
    """Edges between line items; some nodes are none."""
    e = view(spark, sf, "edges")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().where("node % 7 <> 3 and node % 5 <> 2")
    return graph.edges(e, nodes)


@query("g2_reach", f"{_RE}, r AS (SELECT src AS start, src AS node, 0 AS depth FROM live UNION SELECT r.start, live.dst, r.depth + 1 FROM r JOIN live ON r.node = live.src WHERE r.depth < 12) SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2")
def g2(spark, sf):
    e = _edges(spark, sf)
    return graph.reach(e, e.where("kind <> 'inactive'").select(F.col("src").alias("node")))


@query("g2_reach_up", f"{_RE}, r AS (SELECT DISTINCT dst AS start, dst AS node, 0 AS depth FROM live UNION SELECT r.start, live.src, r.depth + 1 FROM r JOIN live ON r.node = live.dst WHERE r.depth < 12) SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2")
def g2_up(spark, sf):
    e = _edges(spark, sf)
    return graph.reach(e, e.where("kind <> 'inactive'").select(F.col("dst").alias("node")), "up")


_DEEP = f"{cte('model_edges').replace('WITH ', 'WITH RECURSIVE ', 1)}, de AS (SELECT workbook_id * 100 + src AS src, workbook_id * 100 + dst AS dst FROM model_edges WHERE (src + dst) % 9 <> 4)"


def _deep(spark, sf):
    e = view(spark, sf, "model_edges")
    at = lambda c: (F.col("workbook_id") * 100 + F.col(c)).alias(c)
    return e.select(at("src"), at("dst"), F.when((F.col("src") + F.col("dst")) % 9 == 4, "inactive").otherwise("direct").alias("kind"))


@query("g3_paths", f"""{_DEEP}, p AS (SELECT DISTINCT src AS start, src AS node, [src] AS path FROM de UNION ALL SELECT p.start, de.dst, list_append(p.path, de.dst) FROM p JOIN de ON de.src = p.node WHERE len(p.path) <= 12)
    SELECT start, node AS goal, array_to_string(path, '>') AS path FROM p QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) = 1""")
def g3(spark, sf):
    e = _deep(spark, sf)
    live = e.where("kind <> 'inactive'")
    nodes = live.select(F.col("src").alias("node")).union(live.select("dst"))
    p = graph.paths(e, live.select(F.col("src").alias("node")), nodes)
    return p.withColumn("path", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))))


@query("g4_leaves", f"""{_DEEP}, p AS (SELECT DISTINCT src AS start, src AS node, 0 AS k FROM de UNION SELECT p.start, de.dst, p.k + 1 FROM p JOIN de ON de.src = p.node WHERE p.k < 12)
    SELECT DISTINCT start, node FROM p WHERE k > 0 AND node NOT IN (SELECT src FROM de)""")
def g4(spark, sf):
    e = _deep(spark, sf)
    return graph.leaves(e, e.where("kind <> 'inactive'").select(F.col("src").alias("node")))


@query("g4_lineage", f"""{_DEEP}, n AS (SELECT src AS node FROM de UNION SELECT dst FROM de), k AS (SELECT node, ['inputs', 'series', 'share', 'subtotal'][(node % 4 + 1)::INT] AS kind FROM n),
    p AS (SELECT node AS start, node, 0 AS k FROM n UNION SELECT p.start, de.dst, p.k + 1 FROM p JOIN de ON de.src = p.node WHERE p.k < 12), u AS (SELECT start, count(DISTINCT node)::BIGINT AS upstream FROM p WHERE k > 0 GROUP BY 1),
    i AS (SELECT start, string_agg(DISTINCT p.node, ',' ORDER BY p.node) AS inputs FROM p JOIN k ON k.node = p.node WHERE p.k > 0 AND kind IN ('inputs', 'share') AND p.node NOT IN (SELECT src FROM de) GROUP BY 1),
    w AS (SELECT node AS start, node, [node] AS path FROM n UNION ALL SELECT w.start, de.src, list_append(w.path, de.src) FROM w JOIN de ON de.dst = w.node WHERE len(w.path) <= 12),
    v AS (SELECT start, path FROM w WHERE node % 100 IN (1, 2, 5, 40) QUALIFY row_number() OVER (PARTITION BY start ORDER BY len(path), path) = 1)
    SELECT n.node AS start, coalesce(upstream, 0) AS upstream, coalesce(inputs, '') AS inputs, path IS NOT NULL AS reaches_value, array_to_string(path, '>') AS via FROM n LEFT JOIN u ON u.start = n.node LEFT JOIN i ON i.start = n.node LEFT JOIN v ON v.start = n.node""")
def g4_lineage(spark, sf):
    """Every row's inputs, and its way to the value rows of its workbook."""
    e = _deep(spark, sf)
    live = e.where("kind <> 'inactive'")
    nodes = written(live.select(F.col("src").alias("node")).union(live.select("dst")).distinct(), "nodes")
    kinds = nodes.withColumn("kind", F.get(F.array(*map(F.lit, ("inputs", "series", "share", "subtotal"))), F.pmod("node", F.lit(4)).cast("int")))
    out = graph.lineage(e, nodes, kinds, nodes.where((F.col("node") % 100).isin(1, 2, 5, 40)))
    show = lambda c, sep: F.concat_ws(sep, F.transform(c, lambda x: x.cast("string")))
    return out.select("start", "upstream", show("inputs", ",").alias("inputs"), "reaches_value", F.when(F.col("reaches_value"), show("via", ">")).alias("via"))


@query("g5_degree", f"{_E}, i AS (SELECT dst AS node, count(DISTINCT src) AS a FROM live GROUP BY 1), o AS (SELECT src AS node, count(DISTINCT dst) AS b FROM live GROUP BY 1) SELECT node, coalesce(a, 0)::BIGINT AS read_by, coalesce(b, 0)::BIGINT AS reads FROM i FULL JOIN o USING (node)")
def g5(spark, sf):
    return graph.degree(_edges(spark, sf))


@query("g5_summary", f"""{cte('model_edges', 'model_rows')}, d AS (SELECT e.workbook_id, src, dst, CASE WHEN (src + dst) % 9 = 4 THEN 'inactive' WHEN src % 4 = 1 THEN 'offset' ELSE 'direct' END AS kind, a.sheet AS ss, b.sheet AS ds FROM model_edges e JOIN model_rows a ON a.workbook_id = e.workbook_id AND a.row_no = src JOIN model_rows b ON b.workbook_id = e.workbook_id AND b.row_no = dst), l AS (SELECT * FROM d WHERE kind <> 'inactive')
    SELECT workbook_id, 'kind' AS what, kind AS name, count(*)::BIGINT AS n, NULL::BIGINT AS sheets FROM d GROUP BY 1, 3 UNION ALL SELECT workbook_id, 'flow', ss || '>' || ds, count(*), NULL FROM l WHERE ss <> ds GROUP BY 1, 3
    UNION ALL SELECT workbook_id, 'most read', dst::VARCHAR, count(*), count(DISTINCT ss) FROM l GROUP BY workbook_id, dst QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY count(*) DESC, dst) <= 15
    UNION ALL SELECT workbook_id, 'most reading', src::VARCHAR, count(*), count(DISTINCT ds) FROM l GROUP BY workbook_id, src QUALIFY row_number() OVER (PARTITION BY workbook_id ORDER BY count(*) DESC, src) <= 15""")
def g5_summary(spark, sf):
    k = F.when((F.col("src") + F.col("dst")) % 9 == 4, "inactive").when(F.col("src") % 4 == 1, "offset").otherwise("direct")
    return graph.summary(view(spark, sf, "model_edges").withColumn("kind", k), view(spark, sf, "model_rows"))


_N = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_RK = "workbook_id, sheet, row_no"


@query("j1_by_label", f"""{cte('model_rows', 'model_rows_now')}, p AS (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet, l ORDER BY row_no) AS occ FROM (SELECT {_RK}, {_N('label')} AS l FROM model_rows)),
    c AS (SELECT *, row_number() OVER (PARTITION BY workbook_id, sheet, l ORDER BY row_no) AS occ FROM (SELECT {_RK}, {_N('label')} AS l FROM model_rows_now)),
    s AS (SELECT p.workbook_id, p.sheet, p.row_no, c.row_no AS cur_row, 'label' AS how FROM p JOIN c USING (workbook_id, sheet, l, occ)),
    n AS (SELECT p.workbook_id, p.sheet, p.row_no, c.row_no AS cur_row, 'nearest' AS how FROM p JOIN c USING (workbook_id, sheet, l) WHERE NOT EXISTS (FROM s WHERE s.workbook_id = p.workbook_id AND s.sheet = p.sheet AND s.row_no = p.row_no)
      QUALIFY row_number() OVER (PARTITION BY p.workbook_id, p.sheet, p.row_no ORDER BY abs(p.row_no - c.row_no), c.row_no) = 1),
    f AS (FROM s UNION ALL FROM n), k AS (SELECT p.workbook_id, p.sheet FROM p LEFT JOIN c ON c.workbook_id = p.workbook_id AND c.sheet = p.sheet AND c.row_no = p.row_no GROUP BY 1, 2 HAVING avg(CASE WHEN c.l = p.l THEN 1.0 ELSE 0.0 END) >= 0.8)
    FROM f UNION ALL SELECT p.workbook_id, p.sheet, p.row_no, p.row_no, 'same row' FROM p JOIN k USING (workbook_id, sheet) JOIN c ON c.workbook_id = p.workbook_id AND c.sheet = p.sheet AND c.row_no = p.row_no ANTI JOIN f ON f.workbook_id = p.workbook_id AND f.sheet = p.sheet AND f.row_no = p.row_no""")
def j1(spark, sf):
    return match.by_label(view(spark, sf, "model_rows"), view(spark, sf, "model_rows_now"))


_J2 = f"""a AS (SELECT DISTINCT workbook_id, sheet, {_N('label')} AS label FROM model_rows), b AS (SELECT DISTINCT workbook_id, sheet AS cur_sheet, {_N('label')} AS label FROM model_rows_now),
    na AS (SELECT workbook_id, sheet, count(*) AS na FROM a GROUP BY 1, 2), nb AS (SELECT workbook_id, cur_sheet, count(*) AS nb FROM b GROUP BY 1, 2),
    j AS (SELECT workbook_id, sheet, cur_sheet, n / (na + nb - n) AS score FROM (SELECT workbook_id, sheet, cur_sheet, count(*) AS n FROM a JOIN b USING (workbook_id, label) GROUP BY 1, 2, 3) JOIN na USING (workbook_id, sheet) JOIN nb USING (workbook_id, cur_sheet)),
    own AS (SELECT * FROM j WHERE sheet = cur_sheet AND score >= 0.35),
    rest AS (SELECT *, lead(score) OVER w AS nx, row_number() OVER w AS r FROM j ANTI JOIN own USING (workbook_id, sheet) ANTI JOIN (SELECT workbook_id, sheet AS cur_sheet FROM na) USING (workbook_id, cur_sheet) WHERE score >= 0.5 WINDOW w AS (PARTITION BY workbook_id, sheet ORDER BY score DESC, cur_sheet)),
    sheet_map AS (SELECT workbook_id, sheet, cur_sheet, score FROM own UNION ALL SELECT workbook_id, sheet, cur_sheet, score FROM rest WHERE r = 1 AND (nx IS NULL OR score - nx > 0.05))"""


@query("j2_sheets", f"{cte('model_rows', 'model_rows_now')}, {_J2} SELECT workbook_id, sheet, cur_sheet, round(score, 9) AS score FROM sheet_map")
def j2(spark, sf):
    return match.sheets(view(spark, sf, "model_rows"), view(spark, sf, "model_rows_now")).withColumn("score", F.round("score", 9))


_PAIR = "workbook_id, sheet, row_no, cur_sheet, cur_row"
_J3 = lambda p, c: f"""hp AS (SELECT * FROM {p} WHERE value <> 0), hc AS (SELECT workbook_id, sheet AS cur_sheet, row_no AS cur_row, period_end, value AS cv FROM {c}),
    hx AS (SELECT p.workbook_id, p.sheet, p.row_no, cur_sheet, cur_row, p.period_end, value, cv, abs(value - cv) <= 1e-9 * greatest(1, abs(value)) AS same FROM hp p JOIN hc USING (workbook_id, period_end)),
    ht AS (SELECT {_PAIR} FROM hx WHERE same GROUP BY {_PAIR} QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet, row_no ORDER BY count(*) DESC, cur_sheet, cur_row) <= 40),
    hd AS (SELECT DISTINCT workbook_id, cur_sheet, period_end FROM hc), hk AS (SELECT p.workbook_id, p.sheet, p.row_no, cur_sheet, count(*) AS could FROM hp p JOIN hd USING (workbook_id, period_end) GROUP BY ALL),
    hn AS (SELECT {_PAIR}, count(*) FILTER (same)::BIGINT AS equal, count(*) FILTER (NOT same)::BIGINT AS differing, list_sort(list(abs(cv / value - 1)) FILTER (NOT same)) AS g FROM hx SEMI JOIN ht USING ({_PAIR}) GROUP BY ALL),
    history AS (SELECT {_PAIR}, equal, differing, least(1.0, 0.5 * equal) * CASE WHEN differing = 0 OR g[differing // 2 + 1] < 0.25 THEN 1.0 ELSE 0.6 END * least(1.0, (equal + differing) / could / 0.8) AS score FROM hn JOIN hk USING (workbook_id, sheet, row_no, cur_sheet) WHERE equal >= 2 OR (equal > 0 AND differing <= 20 * equal))"""  # noqa: E731


@query("j3_by_history", f"{cte('series', 'series_now')}, {_J3('series', 'series_now')} SELECT {_PAIR}, equal, differing, round(score, 9) AS score FROM history")
def j3(spark, sf):
    return match.by_history(view(spark, sf, "series"), view(spark, sf, "series_now")).withColumn("score", F.round("score", 9))


@query("j3_by_history_rows", f"{cte('model_points', 'model_points_now')}, {_J3('model_points', 'model_points_now')} SELECT {_PAIR}, equal, differing, round(score, 9) AS score FROM history")
def j3_rows(spark, sf):
    """The same over models of which many rows hold the same constant."""
    return match.by_history(view(spark, sf, "model_points"), view(spark, sf, "model_points_now")).withColumn("score", F.round("score", 9))


_T = lambda c: f"list_distinct(list_filter(regexp_extract_all(lower({c}), '([a-z][a-z0-9]+)', 1), lambda x: x NOT IN ('the', 'and', 'of', 'for', 'to', 'in')))"
_J4 = f"""wa AS (SELECT {_RK}, {_N('label')} AS l, {_T('label')} AS t, m.cur_sheet AS home FROM model_rows LEFT JOIN sheet_map m USING (workbook_id, sheet)), wb AS (SELECT workbook_id, sheet AS cur_sheet, row_no AS cur_row, {_N('label')} AS cl, {_T('label')} AS ct FROM model_rows_now),
    wj AS (SELECT {_PAIR}, home, len(list_intersect(t, ct)) / (len(t) + len(ct) - len(list_intersect(t, ct))) AS score FROM wa JOIN wb USING (workbook_id) WHERE l <> cl AND (home IS NULL OR home = cur_sheet)),
    wg AS (SELECT {_PAIR}, score, list_sort(list(abs(c.value / p.value - 1))) AS g FROM wj JOIN model_points p USING (workbook_id, sheet, row_no) JOIN (SELECT workbook_id, sheet AS cur_sheet, row_no AS cur_row, period_end, value FROM model_points_now) c USING (workbook_id, cur_sheet, cur_row, period_end)
      WHERE score >= CASE WHEN home IS NULL THEN 0.5 ELSE 0.4 END AND p.value <> 0 GROUP BY ALL),
    words AS (SELECT {_PAIR}, score FROM wg WHERE g[len(g) // 2 + 1] < 0.1 QUALIFY row_number() OVER (PARTITION BY workbook_id, sheet, row_no ORDER BY score DESC, cur_sheet, cur_row) <= 3)"""


@query("j4_by_words", f"{cte('model_rows', 'model_rows_now', 'model_points', 'model_points_now')}, {_J2}, {_J4} SELECT {_PAIR}, round(score, 9) AS score FROM words")
def j4(spark, sf):
    return match.by_words(*[view(spark, sf, n) for n in ("model_rows", "model_rows_now", "model_points", "model_points_now")]).withColumn("score", F.round("score", 9))


@query("j13_near", f"""{cte('series', 'series_now')}, n AS (SELECT {_RK}, count(*) AS periods FROM series WHERE value <> 0 GROUP BY ALL),
    h AS (SELECT p.workbook_id, p.sheet, p.row_no, c.sheet AS cur_sheet, c.row_no AS cur_row, count(*)::BIGINT AS hits FROM series p JOIN series_now c USING (workbook_id, period_end) WHERE p.value <> 0 AND abs(c.value - p.value) <= 0.15 * abs(p.value) GROUP BY ALL)
    SELECT h.* FROM h JOIN n USING (workbook_id, sheet, row_no) WHERE hits >= greatest(3, ceil(periods * 0.5)) QUALIFY row_number() OVER (PARTITION BY h.workbook_id, h.sheet, h.row_no ORDER BY hits DESC, cur_sheet, cur_row) <= 8""")
def j13(spark, sf):
    return match.near(view(spark, sf, "series"), view(spark, sf, "series_now"))


@query("j14_check", f"""{cte('model_points', 'model_points_now')}, pr AS (SELECT DISTINCT p.workbook_id, p.sheet, p.row_no, c.sheet AS cur_sheet, c.row_no AS cur_row FROM model_points p JOIN model_points_now c ON c.workbook_id = p.workbook_id AND c.row_no IN (p.row_no, p.row_no + 3)),
    d AS (SELECT DISTINCT workbook_id, sheet AS cur_sheet, period_end FROM model_points_now),
    j AS (SELECT {_PAIR}, d.period_end IS NOT NULL AS dated, abs(c.value - p.value) / greatest(abs(p.value), abs(c.value), 1e-12) AS gap FROM pr JOIN model_points p USING (workbook_id, sheet, row_no) LEFT JOIN d USING (workbook_id, cur_sheet, period_end)
      LEFT JOIN (SELECT workbook_id, sheet AS cur_sheet, row_no AS cur_row, period_end, value FROM model_points_now) c USING (workbook_id, cur_sheet, cur_row, period_end)),
    g AS (SELECT {_PAIR}, count(gap)::BIGINT AS periods, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l, count(*) FILTER (gap <= 1e-9)::BIGINT AS equal, count(*) FILTER (dated)::BIGINT AS could FROM j GROUP BY ALL HAVING count(gap) > 0)
    SELECT * EXCLUDE (l), round(l[periods // 2 + 1], 9) AS gap, periods >= 3 AND l[periods // 2 + 1] <= 0.15 AND periods >= 0.8 * could AND (row_no * 3 + cur_row) % 11 <> 4 AS holds FROM g""")
def j14(spark, sf):
    p, c = view(spark, sf, "model_points"), view(spark, sf, "model_points_now")
    now = c.select("workbook_id", F.col("sheet").alias("cur_sheet"), F.col("row_no").alias("cur_row")).distinct()
    pairs = p.select("workbook_id", "sheet", "row_no", F.explode(F.array("row_no", F.col("row_no") + 3)).alias("cur_row")).distinct().join(now, ["workbook_id", "cur_row"])
    odd = pairs.where("(row_no * 3 + cur_row) % 11 = 4").select("workbook_id", "row_no", "cur_row")
    return match.check(pairs, p, c, odd=odd).withColumn("gap", F.round("gap", 9))


_DIFF = "SELECT workbook_id, sheet, row_no, period_end, CASE WHEN {now} AND row_no % 13 = 2 AND year(period_end) = 2023 THEN NULL ELSE value END AS value, CASE WHEN (row_no + CASE WHEN {now} AND year(period_end) = 2024 THEN 1 ELSE 0 END) % 3 > 0 THEN 'RC[-1]*2' END AS formula FROM {points}"


@query("j22_diff")
def j22(spark, sf):
    """The alignment of label sequences isn't SQL; a test holds the changes against a walk over both models."""
    r, rn, p, c = (view(spark, sf, f"model_{n}") for n in ("rows", "rows_now", "points", "points_now"))
    a, b = (spark.sql(_DIFF.format(now=now, points="{d}"), d=d) for now, d in (("false", p), ("true", c)))
    return match.diff_models(r, rn, a, b)


@query("j22_cells", f"""{cte('series', 'series_now')} SELECT workbook_id, sheet, row_no, period_end, o.value AS old, n.value AS new, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed'
    WHEN abs(o.value - n.value) <= 1e-9 * greatest(1.0, abs(o.value), abs(n.value)) THEN 'same' ELSE 'changed' END AS change FROM series o FULL JOIN series_now n USING (workbook_id, sheet, row_no, period_end)""")
def j22_cells(spark, sf):
    """The same for versions whose rows stand where they stood."""
    return match.diff_cells(view(spark, sf, "series"), view(spark, sf, "series_now"), ["workbook_id", "sheet", "row_no", "period_end"])


@query("a13_diff_counts", f"""{cte('series', 'series_now')}, d AS (SELECT workbook_id, sheet, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value IS NULL THEN 'removed' WHEN abs(o.value - n.value) <= 1e-9 * greatest(1.0, abs(o.value), abs(n.value)) THEN 'same' ELSE 'changed' END AS change
    FROM series o FULL JOIN series_now n USING (workbook_id, sheet, row_no, period_end)) SELECT workbook_id, sheet, count(*) FILTER (change = 'added')::BIGINT AS added, count(*) FILTER (change = 'removed')::BIGINT AS removed, count(*) FILTER (change = 'changed')::BIGINT AS changed FROM d GROUP BY 1, 2""")
def a13(spark, sf):
    d = match.diff_cells(view(spark, sf, "series"), view(spark, sf, "series_now"), ["workbook_id", "sheet", "row_no", "period_end"])
    return d.groupBy("workbook_id", "sheet").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])


_LIKE = f"""{cte('fleet_items')}, k AS (SELECT DISTINCT workbook_id AS w, 's' AS kind, sheet AS key FROM fleet_items UNION ALL SELECT workbook_id, 'i', concat(sheet, chr(1), label) FROM fleet_items UNION ALL SELECT workbook_id, 'f', concat(sheet, chr(1), label, chr(1), shape) FROM fleet_items),
    n AS (SELECT w, kind, key, count(*) AS n FROM k GROUP BY ALL), t AS (SELECT w, sum(n) FILTER (kind = 's') AS s, sum(n) FILTER (kind = 'i') AS i, sum(n) FILTER (kind = 'f') AS f FROM n GROUP BY 1),
    j AS (SELECT x.w AS a, y.w AS b, coalesce(sum(least(x.n, y.n)) FILTER (kind = 's'), 0) AS s, coalesce(sum(least(x.n, y.n)) FILTER (kind = 'i'), 0) AS i, coalesce(sum(least(x.n, y.n)) FILTER (kind = 'f'), 0) AS f FROM n x JOIN n y USING (kind, key) WHERE x.w < y.w GROUP BY 1, 2),
    v AS (SELECT a, b, j.s / (p.s + q.s - j.s) AS sj, j.i / (p.i + q.i - j.i) AS ij, j.f / (p.f + q.f - j.f) AS fj, j.i / p.i AS ab, j.i / q.i AS ba, p.s AS sheets_a, q.s AS sheets_b, p.i AS items_a, q.i AS items_b FROM j JOIN t p ON p.w = a JOIN t q ON q.w = b),
    l AS (SELECT a, b, round(100 * (0.2 * sj + 0.45 * ij + 0.35 * fj))::INT AS similarity, round(100 * sj)::INT AS sheets, round(100 * ij)::INT AS line_items, round(100 * fj)::INT AS formulas, round(100 * ab)::INT AS a_in_b, round(100 * ba)::INT AS b_in_a,
      sheets_a::BIGINT AS sheets_a, sheets_b::BIGINT AS sheets_b, items_a::BIGINT AS items_a, items_b::BIGINT AS items_b FROM v)"""


@query("j27_likeness", f"{_LIKE} SELECT * FROM l WHERE similarity >= 30 OR greatest(a_in_b, b_in_a) >= 80")
def j27(spark, sf):
    return match.likeness(view(spark, sf, "fleet_items"))


@query("j28_families", f"""{_LIKE.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT a, b FROM l WHERE similarity >= 50 UNION SELECT b, a FROM l WHERE similarity >= 50), r AS (SELECT a AS m, a AS f FROM e UNION SELECT e.b, r.f FROM r JOIN e ON e.a = r.m), fam AS (SELECT m AS w, min(f) AS family FROM r GROUP BY 1),
    o AS (SELECT b AS w, a AS host, a_in_b AS held, items_a AS n FROM l WHERE a_in_b >= 80 AND sheets_a < sheets_b UNION ALL SELECT a, b, b_in_a, items_b FROM l WHERE b_in_a >= 80 AND sheets_b < sheets_a),
    h AS (FROM o QUALIFY row_number() OVER (PARTITION BY w ORDER BY held DESC, n DESC, host) = 1), own AS (SELECT DISTINCT workbook_id AS w, sheet FROM fleet_items),
    x AS (SELECT h.w, string_agg(own.sheet, ',' ORDER BY own.sheet) AS extra FROM h JOIN own ON own.w = h.w ANTI JOIN own q ON q.w = h.host AND q.sheet = own.sheet GROUP BY 1)
    SELECT coalesce(fam.w, h.w) AS member, family, host, held, CASE WHEN h.w IS NOT NULL THEN coalesce(extra, '') END AS extra FROM fam FULL JOIN h ON h.w = fam.w LEFT JOIN x ON x.w = h.w""")
def j28(spark, sf):
    items = view(spark, sf, "fleet_items")
    # families and hosts of contents: the pairs of their copies grow with the square of these
    pairs, books = match.alike_contents(items, similar=50)
    pairs = written(pairs, "likeness")
    fam = graph.families(pairs.where("similarity >= 50"), "a", "b").withColumnRenamed("member", "rep")
    of = fam.join(match.hosts(pairs, items).withColumnRenamed("workbook_id", "rep"), "rep", "full")
    return books.select(F.col("workbook_id").alias("member"), "rep").join(of, "rep").drop("rep")


@query("a14_signature_counts", f"{cte('signatures')} SELECT workbook_id, sheet, label, shape, count(*)::BIGINT AS n FROM signatures GROUP BY ALL")
def a14(spark, sf):
    return view(spark, sf, "signatures").groupBy("workbook_id", "sheet", "label", "shape").agg(F.count("*").alias("n"))


@query("j30_measure", f"""{cte('rows_prior', 'rows_now')}, t AS (SELECT workbook_id, sheet, row_no, CASE WHEN (SELECT count(*) FROM rows_now n WHERE n.row_no = p.row_no + 2) > 0 THEN row_no + 2 END AS cur_row FROM rows_prior p),
    m AS (SELECT p.workbook_id, p.sheet, p.row_no, min(n.row_no) AS found FROM rows_prior p JOIN rows_now n ON n.workbook_id = p.workbook_id AND n.sheet = p.sheet AND n.label = p.label GROUP BY ALL)
    SELECT CASE WHEN found IS NULL AND cur_row IS NOT NULL THEN 'open' WHEN found IS NOT DISTINCT FROM cur_row THEN 'right' ELSE 'wrong' END AS verdict, count(*)::BIGINT AS n FROM t LEFT JOIN m USING (workbook_id, sheet, row_no) GROUP BY 1""")
def j30(spark, sf):
    p, n = view(spark, sf, "rows_prior"), view(spark, sf, "rows_now")
    key = ["workbook_id", "sheet", "row_no"]
    truth = p.select(*key).join(n.select((F.col("row_no") - 2).alias("row_no"), F.col("row_no").alias("cur_row")), "row_no", "left")
    found = p.join(n.select("workbook_id", "sheet", "label", F.col("row_no").alias("cur_row")), ["workbook_id", "sheet", "label"]).groupBy(*key).agg(F.min("cur_row").alias("cur_row"))
    return match.measure(found, truth, key)
