"""Plans and results where tables are larger than the tests' own."""

import datetime
import glob
import random
import time

import duckdb
from pyspark.sql import functions as F

from fleetroll.operators import cells, docs, evidence, facts, graph, match, shape
from fleetroll.plans import q_cells, registry
from fleetroll.sources.adapters import view
from fleetroll.sources.tables import shared_dir


def most_joined(df, kind="Join"):
    """Rows that the largest join, or another kind of step, gives; the query is run."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        below = [p.children().apply(i) for i in range(p.children().size())] + ([p.plan()] if "QueryStage" in name else [])
        own = p.metrics().get("numOutputRows").get().value() if kind in name else 0
        return max([own, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_sides_known_by_their_files_alone_are_not_broadcast(spark):
    """120 KB of files, ten times that in memory: broadcast unseen, several of them fill the driver."""
    rows, now = (view(spark, "/root/testdata/sf0.1", n) for n in ("model_rows", "model_rows_now"))
    j = rows.join(now.select("workbook_id", F.col("row_no").alias("cur_row"), "label"), ["workbook_id", "label"])
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_rates_of_near_total_losses(spark, tmp_path):
    """Most of the money lost within a month is a yearly rate below -99.99 %, which has a rate all the same."""
    day = lambda m: datetime.datetime(2020, m, 15)
    paid = {1: [(1, 100.0), (2, 40.0)], 2: [(1, 100.0), (2, 2.0)], 3: [(1, 100.0), (2, 50.0), (4, 20.0)], 4: [(1, 100.0), (2, 90.0)], 5: [(1, 100.0), (2, 5000.0)], 6: [(1, 100.0)]}
    rows = [(c, day(m), v) for c, flows in paid.items() for m, v in flows]
    spark.createDataFrame(rows, "o_custkey bigint, o_orderdate timestamp, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["v8_irr"]).fetchall()
    got = [tuple(r) for r in registry.queries()["v8_irr"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert dict((c, x) for c, _, x in got)[1] == -0.99999


def test_workbooks_from_one_template_do_not_all_meet(spark):
    """400 workbooks on the same sheets, of which every tenth is another's copy but for one line: pairs that can't be alike are left out in the join."""
    rng = random.Random(3)
    books = [[(f"S{rng.randrange(3)}", f"L{rng.randrange(1600)}", rng.choice("xyz")) for _ in range(45)] for _ in range(400)]
    for w in range(0, 400, 10):
        books[w] = [*books[w + 1][:-1], ("S0", "own", "x")]
    items = spark.createDataFrame([(w, *r) for w, rows in enumerate(books) for r in rows], "workbook_id int, sheet string, label string, shape string")
    found = match.likeness(items)
    assert most_joined(found) <= 400 * 45
    pairs = {(r["a"], r["b"]) for r in found.select("a", "b").collect()}
    assert {(w, w + 1) for w in range(0, 400, 10)} <= pairs and len(pairs) < 60


def test_workbooks_of_one_content_are_compared_as_one(spark):
    """Equal multisets in another order, one with a line twice, one whose ids lie the other way round."""
    a = [("S", f"L{i}", "x") for i in range(12)]
    b = [*a, *[("T", f"M{i}", "y") for i in range(4)]]
    books = {5: a, 9: a[::-1], 7: [*a, a[0]], 1: b, 8: b}
    got = {(r["a"], r["b"]): tuple(r)[2:] for r in match.likeness(spark.createDataFrame([(w, *r) for w, rows in books.items() for r in rows], "workbook_id int, sheet string, label string, shape string")).collect()}
    assert set(got) == {(a, b) for a in books for b in books if a < b}
    assert got[5, 9] == (*[100] * 6, 1, 1, 12, 12) and got[1, 8] == (*[100] * 6, 2, 2, 16, 16)
    assert got[1, 5][4:] == (75, 100, 2, 1, 16, 12) and got[5, 8][4:] == (100, 75, 1, 2, 12, 16)
    assert got[5, 7][4:] == (100, 92, 1, 1, 12, 13) and got[7, 9][4:] == (92, 100, 1, 1, 13, 12)


def test_rules_of_the_same_words_are_compared_as_one(spark):
    """600 rules of 60 sets of words, many of which share their rarest words: the joins give the pairs and little more."""
    sets = [f"alpha{i % 10} beta{i % 9} gamma{i % 8} delta{i % 7} common" for i in range(60)]
    rules = [(i, sets[i * 7 % 60] if i % 2 else " ".join(sets[i * 7 % 60].split()[::-1])) for i in range(600)]
    rules += [(1000, sets[0] + " further"), (1001, "of it"), (1002, None)]
    found = docs.similar_rules(spark.createDataFrame(rules, "rule_id int, text string"))
    words = {i: frozenset(w for w in t.split() if len(w) > 2) for i, t in rules if t}
    want = {(a, b, round(len(p & q) / len(p | q), 9)) for a, p in words.items() for b, q in words.items() if a < b and p and len(p & q) / max(1, len(p | q)) >= 0.75}
    assert {(r["rule_id"], r["other"], round(r["jaccard"], 9)) for r in found.collect()} == want
    assert most_joined(found) <= 2 * len(want) + 61


def test_figures_printed_as_nought_do_not_meet_every_bucket(spark):
    """0.0 billion is up to 50 million: a figure meets a few wide buckets, and all the cells up to there."""
    facts = spark.createDataFrame([(e, 1, "Total value", "$bn", "conclusion", "$0.0", None, None) for e in range(100)], "engagement_id int, fact_id int, label string, unit string, category string, value_text string, low_text string, high_text string")
    values = [1e-7, -1e-7, 0.3, -7.0, 1234.5, -4.9e7, 4.99e7, 5.1e7, 0.0]
    cells = spark.createDataFrame([(e, i, "value", v, True, False) for e in range(100) for i, v in enumerate(values)], "engagement_id int, cell_id int, label string, value double, is_formula boolean, is_anchor boolean")
    found = shape.facts_to_cells(facts, cells, k=1000)
    got = {(r["engagement_id"], r["cell_id"], r["scale"], r["sign"]) for r in found.collect()}
    assert got == {(e, i, s, g) for e in range(100) for i, v in enumerate(values) for s in (1.0, 1e3, 1e6, 1e9) for g in (1, -1) if v and abs(v) <= 0.05 * s}
    assert most_joined(found, "Generate") <= 100 * 3 * len(values)


def test_families_of_copies_are_found_by_their_contents(spark, sf, tmp_path):
    """Four models and this year's of them, 30 times: what is kept of their likeness doesn't grow with the pairs of copies."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + 600 * i AS p_partkey) FROM '{sf}/part.parquet', range(30) r(i) WHERE p_partkey < 200) TO '{tmp_path}/part.parquet'")
    kept = lambda: set(glob.glob(f"{shared_dir(spark).removeprefix('file://')}/likeness-*"))
    before = kept()
    cols = ["member", "family", "host", "held", "extra"]
    got = {tuple(r) for r in registry.queries()["j28_families"](spark, str(tmp_path)).select(*cols).collect()}
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert got == set(con.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()['j28_families']})").fetchall())
    assert len(got) == 240 and sum(spark.read.parquet(p).count() for p in kept() - before) < 100


def test_flows_of_two_feeds_are_not_left_to_two_tasks(spark, sf):
    plan = registry.queries()["a2_flows_by_fy"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(feed" not in plan and "BroadcastHashJoin" in plan


def test_points_are_made_in_several_tasks(spark):
    """200 KB of file are one task, 120,000 points."""
    d = view(spark, "/root/testdata/sf0.1", "model_points")
    sizes = [r["n"] for r in d.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 120_000 and max(sizes) < 30_000


def test_links_of_little_in_common_find_the_workbook_with_most(spark):
    """A renamed file's link shares a few cells with each workbook; the one with most is found, a copy by its smallest id."""
    rng = random.Random(7)
    books = {w: {p: rng.randrange(40) + 0.0 for p in rng.sample(range(900), 300)} for w in range(60)}
    books[60] = dict(books[11])
    saw = {k: {p: rng.randrange(40) + (5e-7 if p % 2 else 0.0) for p in rng.sample(range(900), 300)} for k in range(30)}
    saw[30] = {p: v for p, v in books[11].items() if p % 3}
    row = lambda i, name, c: [(i, name, "S", p // 9, p % 9, v) for p, v in c.items()]
    schema = "{} int, name int, sheet string, row_no int, col int, value double"
    theirs = spark.createDataFrame([x for w, c in books.items() for x in row(w, w // 4, c)], schema.format("workbook_id"))
    own = spark.createDataFrame([x for k, c in saw.items() for x in row(k, k // 4 if k % 2 else -1 - k, c)], schema.format("link"))
    got = {r["link"]: (r["workbook_id"], r["compared"], r["equal"]) for r in cells.link_agreement(own, theirs).collect()}
    for k, c in saw.items():
        all_ = []
        for w, b in books.items():
            if k % 2 == 0 or w // 4 == k // 4:
                both = c.keys() & b.keys()
                all_.append((-sum(abs(c[p] - b[p]) <= 1e-6 * max(1, abs(c[p])) for p in both), w, len(both)))
        e, w, n = min(all_)
        assert got[k] == (w, n, -e)


def test_quotes_in_a_long_page_take_time_by_its_length(spark):
    """Blocks found by counting characters from the page's start would take some minutes here."""
    rng = random.Random(3)
    page = "".join(rng.choice("abcdefgh") for _ in range(2_000_000))
    pages = spark.createDataFrame([(1, 1, page)], "doc_id int, page int, text string")
    quotes = spark.createDataFrame([(i, page[at : at + 60]) for i, at in enumerate(range(0, 2_000_000, 400_000))] + [(9, "x" * 40)], "quote_id int, quote string")
    began = time.time()
    assert sorted(r["quote_id"] for r in docs.quotes_in(quotes, pages).collect()) == list(range(5))
    assert time.time() - began < 60


def test_lineage_walks_down_once(spark, monkeypatch):
    walks, reach = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda *a, **k: walks.append(a[2]) or reach(*a, **k))
    e = spark.createDataFrame([(1, 2, "direct"), (2, 3, "direct"), (1, 4, "offset"), (4, 5, "inactive")], "src int, dst int, kind string")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node int")
    kinds = nodes.selectExpr("node", "if(node = 4, 'series', 'inputs') AS kind")
    got = {r["start"]: (r["upstream"], r["inputs"], r["via"]) for r in graph.lineage(e, nodes, kinds, nodes.where("node = 1")).collect()}
    assert got == {1: (3, [3], [1]), 2: (1, [3], [2, 1]), 3: (0, [], [3, 2, 1]), 4: (0, [], [4, 1]), 5: (0, [], None)}
    assert walks == ["down"]


def test_labels_read_each_text_once(spark):
    f = spark.createDataFrame([(1, "equity", "A$5m", "equity value A$5m", False), (2, "equity", "A$5m", "net debt A$5m", False), (3, "equity", "none", "none", False)], "fact_id int, key string, stated string, quote string, percent boolean")
    over = facts.labels_over(f, {"equity": "equity value"}, "net debt")
    assert [tuple(r) for r in over.collect()] == [(2, "net debt")]
    assert over._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 2


def test_numbers_that_agree_meet_once(spark):
    """Rows are compared once, with all their points, not a period at a time; as the checks one after the other say."""
    rng = random.Random(5)
    day = lambda k: datetime.date(2020 + k, 12, 31)
    series, now = [], []
    for w in range(2):
        for r in range(40):
            v = [rng.choice([0.0, None, 100.0, -100.0, rng.uniform(80, 130), 40.0 * 1.2**k]) for k in range(8)] if r % 3 else [rng.uniform(98, 102) for _ in range(8)]
            series += [(w, f"S{r % 2}", r, day(k), x) for k, x in enumerate(v) if rng.random() < 0.95]
            now += [(w, f"S{r % 2}", r + 3, day(k), None if x is None else x * rng.choice([1.0, 1.0, 1.1, 1.16, 2.0])) for k, x in enumerate(v) if rng.random() < 0.85]
    a, b = (spark.createDataFrame(x, "workbook_id int, sheet string, row_no int, period_end date, value double") for x in (series, now))
    found = evidence.numbers_agree(None, None, a, b)
    got = sorted(tuple(r) for r in found.collect())
    cand = match.near(a, b, 0.15, k=1_000_000).select("workbook_id", "sheet", "row_no", "cur_sheet", "cur_row")
    want = sorted((r["workbook_id"], r["row_no"], r["cur_row"]) for r in match.check(cand, a, b, 0.15).where("holds").collect())
    assert got == want and len(want) > 200
    # before, each pair met in each of its eight periods
    assert most_joined(found) <= 2 * len(want)


def test_steps_are_found_once_for_all_anchors(spark, monkeypatch):
    """60 anchors lead to one row that leads to 60 rows: the steps from there are looked up once, not for each anchor."""
    joined, write = [], evidence.written
    monkeypatch.setattr(evidence, "written", lambda d, name: joined.append(most_joined(d)) or write(d, name))
    n = 60
    edges = [(1, a, 100) for a in range(n)] + [(1, 100, 200 + b) for b in range(n)]
    rows = [*range(n), 100, *range(200, 200 + n)]
    f = spark.createDataFrame
    e, pairs = f(edges, "workbook_id int, src int, dst int"), f([(1, r, r) for r in rows], "workbook_id int, row_no int, cur_row int")
    scores = f([(1, r, r, 1.0) for r in rows], "workbook_id int, row_no int, cur_row int, q double")
    anchors = f([(1, a, a) for a in range(n)], "workbook_id int, row_no int, cur_row int")
    got = {(r["row_no"], r["cur_row"]): r["score"] for r in evidence.by_trace(e, e, anchors, scores, pairs).collect()}
    assert set(got) == {(r, r) for r in rows[n:]} and set(got.values()) == {1.0}
    # before, 60 anchors by 60 rows by 60 of this year's rows
    assert max(joined) <= 2 * n * n


def test_links_of_the_same_cells_are_compared_as_one(spark):
    """200 names of four workbooks each, with the same four contents: a pair of contents is compared once, wherever it is found."""
    rng = random.Random(11)
    made = [{p: rng.choice([None, 1.0, 2.0, 3.0]) for p in rng.sample(range(60), 40)} for _ in range(4)]
    books = {w: made[w % 4] for w in range(800)}
    saw = {k: {p: None if v is None else v + (p % 7 == 0) for p, v in c.items()} for k, c in books.items()}
    row = lambda i, name, c: [(i, name, "S", p // 9, p % 9, v) for p, v in c.items()]
    schema = "{} int, name int, sheet string, row_no int, col int, value double"
    theirs = spark.createDataFrame([x for w, c in books.items() for x in row(w, w // 4, c)], schema.format("workbook_id"))
    own = spark.createDataFrame([x for k, c in saw.items() for x in row(k, -1 if k % 100 == 1 else k // 4, c)], schema.format("link"))
    found = cells.link_agreement(own, theirs)
    got = {r["link"]: (r["workbook_id"], r["compared"], r["equal"]) for r in found.collect()}
    best = {}
    for k in range(4):
        for w in range(4):
            both = saw[k].keys() & made[w].keys()
            best[k, w] = (-sum(None not in (saw[k][p], made[w][p]) and abs(saw[k][p] - made[w][p]) <= 1e-6 * max(1, abs(saw[k][p])) for p in both), len(both))
    for k in range(800):
        e, w, n = min((best[k % 4, w % 4][0], w, best[k % 4, w % 4][1]) for w in (range(4) if k % 100 == 1 else range(k // 4 * 4, k // 4 * 4 + 4)))
        assert got[k] == (w, n, -e)
    # before, 792 links by four workbooks by the cells they share
    assert most_joined(found) <= 2 * 3_200


def test_cells_are_shuffled_once(spark):
    d = q_cells._j20(spark, "/root/testdata/sf0.01")
    assert d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    placed = d.select("workbook_id", "sheet", F.spark_partition_id().alias("task")).distinct()
    assert placed.count() == d.select("workbook_id", "sheet").distinct().count() and placed.select("task").distinct().count() == 8
