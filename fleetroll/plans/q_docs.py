"""Queries on reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetroll.functions import text
from fleetroll.functions.figures import figures
from fleetroll.operators import docs, facts

from .registry import query


def _pages(spark, sf):
    """Each document as one page."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", F.lit(1).alias("page"), "text")


_SENT = "s AS (SELECT doc_id, i - 1 AS n, l[i] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \\t\\n\\f\\r\\x0B]+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+') AS l FROM documents)) WHERE trim(l[i]) <> '')"


@query("x7_sections", """WITH l AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
    h AS (SELECT *, count(*) FILTER (length(line) < 25) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM l)
    SELECT doc_id, s::BIGINT AS section_no, md5(coalesce(max(line) FILTER (length(line) < 25), '')) AS heading, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (length(line) >= 25), '')) AS body FROM h GROUP BY 1, 2""")
def x7(spark, sf):
    # here a heading is a line of under 25 characters; the mark is put before it
    p = _pages(spark, sf)
    marked = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when(F.length(x) < 25, F.concat(F.lit("\x01"), x)).otherwise(x)), "\n")
    out = docs.sections(p.withColumn("text", marked), "^\x01")
    return out.select("doc_id", "section_no", F.md5("heading").alias("heading"), F.md5("body").alias("body"))


@query("x8_passages", f"""WITH {_SENT}, m AS (SELECT * FROM s WHERE regexp_matches(sentence, '(?i)licen[cs]|\\bthe\\b') QUALIFY row_number() OVER (PARTITION BY doc_id, substr(trim(regexp_replace(lower(sentence), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g'), ' '), 1, 120) ORDER BY n) = 1)
    SELECT doc_id, n::INT AS n, sentence FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) <= 12""")
def x8(spark, sf):
    return docs.passages(_pages(spark, sf), r"(?i)licen[cs]|\bthe\b").select("doc_id", "n", "sentence")


@query("x8_mentions", """WITH d AS (SELECT o_custkey AS doc_id, o_orderkey AS k, floor(o_totalprice / 100) / 10 AS v, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS i FROM orders),
    f AS (SELECT c_custkey AS figure_id, c_custkey AS e, c_custkey % 7 + 0.0 AS value FROM customer UNION ALL SELECT 1000000 + k, doc_id, v FROM d WHERE k % 2 = 0), s AS (SELECT doc_id, 2 * i AS n, unnest([k * 1.0, v]) AS x FROM d UNION ALL SELECT doc_id, 2 * i + 1, (k % 7) * 1.0 FROM d)
    SELECT DISTINCT figure_id, doc_id, 1 AS page, n::INT AS n FROM s JOIN f ON doc_id = e AND round(x, 9) = round(value, 9)""")
def x8_mentions(spark, sf):
    """A customer's figures in the report of its orders: a count for every customer, the price of every second order."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, v = F.col("o_orderkey"), F.floor(F.col("o_totalprice") / 100) / 10
    line = F.concat(F.lit("Order "), k.cast("string"), F.lit(" comes to $"), F.format_number(v, 1), F.lit("k. It is "), (k % 7).cast("string"), F.lit("% of all!"))
    d = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("t")))).alias("l"))
    pages = d.select(F.col("doc_id").alias("engagement_id"), "doc_id", F.lit(1).alias("page"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("text"))
    c = spark.read.parquet(f"{sf}/customer.parquet")
    few = c.select(F.col("c_custkey").alias("engagement_id"), F.col("c_custkey").alias("figure_id"), (F.col("c_custkey") % 7).cast("double").alias("value"))
    return docs.mentions(pages, few.union(o.where(k % 2 == 0).select("o_custkey", k + 1_000_000, v)))


_SQ = lambda c: f"regexp_replace(lower({c}), '[ \\t\\n\\f\\r\\x0B]+', '', 'g')"


@query("x10_quotes_in", f"""WITH b AS (SELECT item_id, {_SQ('text')} AS q FROM benchmark), d AS (SELECT doc_id, {_SQ('text')} AS t FROM documents), f AS (SELECT item_id, doc_id FROM b JOIN d ON contains(t, q) WHERE q <> '')
    SELECT item_id, count(doc_id)::BIGINT AS documents, min(doc_id) AS first_doc FROM benchmark LEFT JOIN f USING (item_id) GROUP BY 1""")
def x10_in(spark, sf):
    """In which documents each benchmark passage stands: all passages over all documents."""
    b, d = spark.read.parquet(f"{sf}/benchmark.parquet"), _pages(spark, sf)
    found = docs.quotes_in(b.select(F.col("item_id").cast("long").alias("quote_id"), F.col("text").alias("quote")), d)
    return b.select("item_id").join(found.withColumnRenamed("quote_id", "item_id"), "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


#: Labels of the example facts.
_TERMS, _OTHER = {"rate": "discount rate", "equity": "equity value", "franking": "franking credits?"}, "net debt|enterprise value"


@query("x10_check_quotes", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 19 AS c, floor(o_totalprice) / 10 AS x, o_orderdate::DATE AS d FROM orders),
    t AS (SELECT *, 'A$' || printf('%,.1f', x) || 'm' AS v, printf('%,.1f', x) AS bare FROM o), i AS (SELECT k, c,
    CASE WHEN c = 1 THEN 'quote-quote is on page ' || k || ', not ' || (k + 1) WHEN c = 2 THEN 'quote+quote on page ' || k || ', spacing ignored' WHEN c IN (12, 13) THEN 'quote-quote not found' WHEN c = 17 THEN 'quote-no quote' ELSE 'quote+quote on page ' || k END AS q,
    CASE WHEN c = 3 THEN 'figure-A$' || printf('%,.1f', x + 1) || 'm is not in the quote' WHEN c = 4 THEN 'figure+A$' || bare || 'bn in the quote; figure-A$' || bare || 'bn has another scale in the quote' WHEN c = 5 THEN 'figure+NZ$' || bare || 'm in the quote; figure-NZ$' || bare || 'm has another currency in the quote'
      WHEN c = 6 THEN 'figure+80% in the quote' WHEN c = 7 THEN 'figure-80% is not in the quote' WHEN c = 8 THEN 'figure+7.25% in the quote; figure+7.75% in the quote' WHEN c = 9 THEN 'figure+7.25% in the quote; range-only the low end is given' WHEN c = 10 THEN 'figure+' || strftime(d, '%Y-%m-%d') || ' in the quote'
      WHEN c = 11 THEN 'figure-' || strftime((d + 1)::DATE, '%Y-%m-%d') || ' is not in the quote' WHEN c = 16 THEN 'figure+''Franking  credits valued'' in the quote' WHEN c IN (12, 13, 17) THEN NULL ELSE 'figure+' || v || ' in the quote' END AS f,
    CASE WHEN c IN (8, 9, 12, 13, 16, 17) THEN NULL WHEN c = 15 THEN 'figure-value is not as its text' ELSE 'figure+value as its text' END AS w,
    CASE WHEN c = 14 THEN 'figure-value is under equity value' WHEN c = 18 THEN CASE WHEN k % 2 = 0 THEN 'table+table ' || k || ' is verified' ELSE 'table-table ' || k || ' is draft' END END AS l FROM t)
    SELECT k AS fact_id, concat_ws('; ', q, f, w, l) AS items, NOT (c IN (1, 3, 4, 5, 7, 9, 11, 12, 13, 14, 15, 17) OR (c = 18 AND k % 2 = 1)) AS ok FROM i""")
def x10(spark, sf):
    """A fact of every order against a page of its customer's report: right, and wrong in each of the ways that are checked."""
    k = F.col("o_orderkey")
    c = k % 19
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumns({"x": F.floor("o_totalprice") / 10, "d": F.to_date("o_orderdate")})
    v = lambda n, cur="A$", scale="m": F.concat(F.lit(cur), F.format_number(F.col("x") + n, 1), F.lit(scale))
    dated = F.concat(F.lit("As at "), F.date_format("d", "d MMM yyyy"), F.lit(" "))
    body = F.concat(F.lit("the equity value is "), v(0), F.lit(", discount rate 7.25% to 7.75% and franking credits valued at 0.80 for order "), k.cast("string"))
    pages = o.select(F.col("o_custkey").alias("doc_id"), k.alias("page"), F.concat(dated, body, F.lit(".\nThe next page.")).alias("text"))
    quote = (
        F.when(c == 2, F.replace(F.replace(body, F.lit("the equity"), F.lit("theequity")), F.lit(" is "), F.lit("  is ")))
        .when(c.isin(10, 11), F.concat(dated, body))
        .when(c == 12, F.concat(F.lit("no such words "), k.cast("string")))
        .when(c == 13, F.concat(F.lit("the equity value is A$"), F.format_number(F.floor("x"), 0)))
        .when(c == 17, "  ")
        .otherwise(body)
    )
    said = F.when(c == 3, v(1)).when(c == 4, v(0, scale="bn")).when(c == 5, v(0, "NZ$")).when(c.isin(6, 7), "80%").when(c == 10, F.date_format("d", "yyyy-MM-dd")).when(c == 11, F.date_format(F.date_add("d", 1), "d/M/yyyy")).when(c == 16, "Franking  credits valued").when(~c.isin(8, 9, 12, 13, 17), v(0))
    day = lambda d: F.date_format(d, "yyyyMMdd").cast("double")
    value = F.when(c.isin(8, 9, 12, 13, 16, 17), None).when(c.isin(6, 7), 80.0).when(c == 10, day("d")).when(c == 11, day(F.date_add("d", 1))).otherwise(F.col("x") + F.when(c.isin(3, 15), 1).otherwise(0))
    facts_ = o.select(
        k.alias("fact_id"), F.col("o_custkey").alias("doc_id"), F.when(c == 1, k + 1).otherwise(k).alias("page"), F.when(c.isin(8, 9, 14), "rate").when(c.isin(6, 7, 16), "franking").otherwise("equity").alias("key"), F.when(c == 16, "identity").alias("category"),
        F.when(c.isin(10, 11), "date").alias("unit"), (c == 6).alias("percent"), value.alias("value"), said.alias("value_text"), F.when(c.isin(8, 9), "7.25%").alias("low_text"), F.when(c == 8, "7.75%").alias("high_text"), quote.alias("quote"),
    )
    tables = pages.where(F.col("page") % 19 == 18).select("doc_id", "page", F.col("page").alias("table_id"), F.when(F.col("page") % 2 == 0, "verified").otherwise("draft").alias("status"), "text")
    show = lambda x: F.concat(x["kind"], F.when(x["ok"], "+").otherwise("-"), x["text"])
    return facts.check_quotes(facts_, pages, _TERMS, _OTHER, tables).select("fact_id", F.array_join(F.transform("items", show), "; ").alias("items"), "ok")


@query("x12_compare_reads", """WITH d AS (SELECT o_custkey % 100 AS t, o_orderkey AS r, 'row ' || o_orderkey % 30 AS head, floor(o_totalprice)::INT % 100 AS q, o_orderkey % 9 AS s FROM orders),
    a AS (SELECT *, row_number() OVER (PARTITION BY t, head ORDER BY r) AS occ FROM d WHERE s <> 1), b AS (SELECT t, head, q + CASE WHEN s = 2 THEN 1 ELSE 0 END AS q, row_number() OVER (PARTITION BY t, head ORDER BY r) AS occ FROM d WHERE s <> 3)
    SELECT t AS table_id, head, occ::INT AS occ, CASE WHEN b.q IS NULL THEN 'first only' WHEN a.q IS NULL THEN 'second only' WHEN a.q = b.q THEN 'same' ELSE 'numbers differ' END AS verdict FROM a FULL JOIN b USING (t, head, occ)""")
def x12(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 100).alias("table_id"), F.col("o_orderkey").alias("row_no"), F.concat(F.lit("Row "), (F.col("o_orderkey") % 30).cast("string")).alias("head"), (F.floor("o_totalprice").cast("int") % 100).alias("q"))
    s = F.col("row_no") % 9

    def read(k, d, q):
        cells = F.explode(F.array(F.struct(F.lit(0).alias("col_no"), F.col("head").alias("text")), F.struct(F.lit(1).alias("col_no"), q.cast("string").alias("text"))))
        return d.select("table_id", F.lit(k).alias("read_no"), "row_no", cells.alias("c")).select("table_id", "read_no", "row_no", "c.*")

    return docs.compare_reads(read(1, o.where(s != 1), F.col("q")).union(read(2, o.where(s != 3), F.col("q") + F.when(s == 2, 1).otherwise(0))))


@query("x17_similar_rules", """WITH t AS (SELECT p_partkey AS r, list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type || ' size ' || CASE WHEN p_size < 9 THEN 'small' ELSE 'other' || p_size END || ' ' || p_brand), '[a-z0-9_]+'), lambda x: length(x) > 2)) AS t FROM part)
    SELECT a.r AS rule_id, b.r AS other, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 9) AS jaccard FROM t a JOIN t b ON a.r < b.r WHERE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.75""")
def x17(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    t = F.concat_ws(" ", "p_name", "p_type", F.lit("size"), F.when(F.col("p_size") < 9, "small").otherwise(F.concat(F.lit("other"), F.col("p_size").cast("string"))), "p_brand")
    return docs.similar_rules(p.select(F.col("p_partkey").alias("rule_id"), t.alias("text"))).withColumn("jaccard", F.round("jaccard", 9))


@query("x5_ranges", """SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS low, floor(o_totalprice)::DOUBLE + 10 AS high FROM orders""")
def x5(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = F.concat(F.lit("between $"), F.format_number(F.floor("o_totalprice"), 0), F.lit(" to $"), F.format_number(F.floor("o_totalprice") + 10, 0), F.lit(" million"))
    return o.select("o_orderkey", text.range_of(F.regexp_replace(t, r"\$", "")).alias("r")).select("o_orderkey", "r.*")


@query("x3_dates", """SELECT o_orderkey, concat_ws(',', strftime((o_orderdate::DATE + 3)::DATE, '%Y-%m-%d'), strftime(o_orderdate::DATE, '%Y-%m-%d'), strftime((o_orderdate::DATE + 40)::DATE, '%Y-%m-%d'), CASE WHEN o_orderkey % 2 = 0 THEN strftime((o_orderdate::DATE + 9)::DATE, '%Y-%m-%d') ELSE strftime((o_orderdate::DATE + 10000)::DATE, '%Y-%m-%d') END) AS dates FROM orders""")
def x3(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    short = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.date_add("d", 9), "d/M/yyyy")).otherwise(F.date_format(F.date_add("d", 10000), "d/M/yy"))
    t = F.concat(F.date_format(F.date_add("d", 3), "MMMM d, yyyy"), F.lit(" as at "), F.date_format("d", "d MMM yyyy"), F.lit(" and 31 Feb 2020, "), F.date_format(F.date_add("d", 40), "yyyy-MM-dd"), F.lit("; not 2020-13-01 but "), short, F.lit(" or 45/1/2020"))
    return o.select("o_orderkey", F.array_join(F.transform(text.dates(t), lambda x: x.cast("string")), ",").alias("dates"))


@query("x4_figures", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat_ws(' ', printf('%.1f', a) || '|m|A$', printf('%.1f', a + 5) || '|bn|A$', '12.5||', '850.0||') WHEN 1 THEN concat_ws(' ', printf('%.1f', a * 1.0) || '||NZ$', printf('%.1f', o_orderkey * 1.0) || '|thousand|', '7.25||', '7.75||') ELSE concat_ws(' ', printf('%.1f', a) || '|k|€', '3.0||') END AS figures
    FROM (SELECT o_orderkey, floor(o_totalprice / 100) / 2 AS a FROM orders)""")
def x4(spark, sf):
    a = F.floor(F.col("o_totalprice") / 100) / 2
    n = lambda c: F.format_number(c, 1)
    o = spark.read.parquet(f"{sf}/orders.parquet")
    t = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("A$"), n(a), F.lit("m – A$"), n(a + 5), F.lit("bn at 30 June 2025, 12.5% less net debt - 850.0")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("On 1/7/2024 NZ$"), n(a), F.lit(" of "), F.format_number("o_orderkey", 0), F.lit(" thousand at 7.25% - 7.75%")))
        .otherwise(F.concat(F.lit("about €"), n(a), F.lit("k in 3 markets by 2023-05-06")))
    )
    show = lambda x: F.concat_ws("|", F.when(x["value"] == F.round(x["value"], 1), F.format_string("%.1f", x["value"])).otherwise(F.format_string("%.2f", x["value"])), F.coalesce(x["scale"], F.lit("")), F.coalesce(x["cur"], F.lit("")))
    return o.select("o_orderkey", F.array_join(F.transform(figures(t), show), " ").alias("figures"))


@query("x11_check_labels", """SELECT o_orderkey AS fact_id, CASE o_orderkey % 9 WHEN 1 THEN 'net debt' WHEN 4 THEN 'enterprise value' WHEN 6 THEN 'net debt' END AS under, CASE o_orderkey % 9 WHEN 2 THEN 'scale' WHEN 3 THEN 'currency' END AS off FROM orders""")
def x11(spark, sf):
    k = F.col("o_orderkey")
    v = F.concat(F.floor(F.col("o_totalprice") / 10).cast("string"), F.lit(".5"))
    n = (k % 87 + 11).cast("string")
    cases = [
        (F.concat(F.lit("Equity value of A$"), v, F.lit("m and net debt of A$3.1m")), "A$%sm"),
        (F.concat(F.lit("Net debt A$"), v, F.lit("m; equity value A$9.9m")), "A$%sm"),
        (F.concat(F.lit("equity value A$"), v, F.lit("bn")), "A$%sm"),
        (F.concat(F.lit("equity value NZ$"), v, F.lit("m")), "A$%sm"),
        (F.concat(F.lit("discount rate 7%, enterprise value "), v, F.lit(" in total")), "%s"),
        (F.concat(F.lit("The "), v, F.lit(" of equity value, franking credits 80%")), "%s"),
        (F.concat(F.lit("equity value 9% – 10%, net debt 0."), n), "%s%%"),
        (F.concat(F.lit("net debt of 1, equity value "), v, F.lit("–9e")), "%s"),
        (F.concat(F.lit("net debt 3, "), v, F.lit(" is the equity value")), "%s"),
    ]
    quote, stated = F.coalesce(*[F.when(k % 9 == i, q) for i, (q, _) in enumerate(cases)]), F.coalesce(*[F.when(k % 9 == i, F.format_string(s, n if i == 6 else v)) for i, (_, s) in enumerate(cases)])
    f = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("fact_id"), F.lit("equity").alias("key"), stated.alias("stated"), quote.alias("quote"), (k % 9 == 6).alias("percent"))
    return facts.check_labels(f, _TERMS, _OTHER)


@query("x13_check_text_layer", """WITH o AS (SELECT o_custkey AS t, o_orderkey AS k, floor(o_totalprice / 1000)::BIGINT AS a, o_orderkey % 90 + 10 AS b FROM orders),
    c AS (SELECT t, k, unnest([a, b])::VARCHAR AS x FROM o), l AS (SELECT t, k, unnest(CASE WHEN k % 7 = 0 THEN [a + 1, b] ELSE [a, b] END)::VARCHAR AS x FROM o),
    n AS (SELECT coalesce(c.t, l.t) AS t, greatest(coalesce(c.n, 0) - coalesce(l.n, 0), 0) AS u, greatest(coalesce(l.n, 0) - coalesce(c.n, 0), 0) AS v FROM (SELECT t, x, count(*) AS n FROM c GROUP BY 1, 2) c FULL JOIN (SELECT t, x, count(*) AS n FROM l GROUP BY 1, 2) l ON c.t = l.t AND c.x = l.x),
    w AS (SELECT t, count(*) FILTER (k % 6 = 0) AS lost FROM o GROUP BY 1),
    z AS (SELECT o.t, o.k FROM o WHERE NOT EXISTS (FROM o p WHERE p.t = o.t AND list_position(CASE WHEN p.k % 5 = 0 THEN [p.b, CASE WHEN p.k % 7 = 0 THEN p.a + 1 ELSE p.a END] ELSE [CASE WHEN p.k % 7 = 0 THEN p.a + 1 ELSE p.a END, p.b] END, o.a) = 1 AND (CASE WHEN p.k % 5 = 0 THEN [p.b, CASE WHEN p.k % 7 = 0 THEN p.a + 1 ELSE p.a END] ELSE [CASE WHEN p.k % 7 = 0 THEN p.a + 1 ELSE p.a END, p.b] END)[2] = o.b)),
    q AS (SELECT t, count(*) AS bad FROM z GROUP BY 1)
    SELECT t AS table_id, sum(u)::BIGINT AS not_in_source, sum(v)::BIGINT AS not_read, any_value(lost)::BIGINT AS words_not_in_source, 0::BIGINT AS words_not_read, coalesce(any_value(bad), 0)::BIGINT AS rows_out_of_order, sum(u) + sum(v) + any_value(lost) + coalesce(any_value(bad), 0) = 0 AS ok FROM n JOIN w USING (t) LEFT JOIN q USING (t) GROUP BY 1""")
def x13(spark, sf):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("table_id"), k.alias("row_no"), F.floor(F.col("o_totalprice") / 1000).cast("string").alias("a"), (k % 90 + 10).cast("string").alias("b"), (F.floor(F.col("o_totalprice") / 1000) + F.when(k % 7 == 0, 1).otherwise(0)).cast("string").alias("c"))
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("col_no"), t.alias("text")) for i, t in enumerate((F.lit("Total revenue"), F.col("a"), F.col("b")))]))
    r = F.col("row_no")
    line = F.concat_ws(" ", F.when(r % 6 == 0, "Total").otherwise("Total revenue"), F.when(r % 5 == 0, F.col("b")).otherwise(F.col("c")), F.when(r % 5 == 0, F.col("c")).otherwise(F.col("b")))
    return docs.check_text_layer(o.select("table_id", "row_no", cell.alias("x")).select("table_id", "row_no", "x.*"), o.select("table_id", F.col("row_no").alias("line_no"), line.alias("text")))


_KINDS = {"gordon": r"(?i)perpetu|gordon", "multiple": r"(?i)exit multiple|ev/ebitda", "nil": r"(?i)no terminal"}


@query("x15_terminal_method", """WITH s AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END AS source, CASE o_orderkey % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS k FROM orders), b AS (SELECT doc_id, min(struct_pack(source, k)) AS b FROM s WHERE k IS NOT NULL GROUP BY 1)
    SELECT doc_id, ['gordon', 'multiple', 'nil'][b.k + 1] AS method FROM b""")
def x15(spark, sf):
    k = F.col("o_orderkey")
    words = F.when(k % 9 == 0, "A growing perpetuity, and an exit multiple").when(k % 9 == 1, "An EV/EBITDA of 12x").when(k % 9 == 2, "There is no terminal value").otherwise("Nothing of it")
    p = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("doc_id"), F.when(k % 4 == 0, 0).otherwise(1).alias("source"), words.alias("sentence"))
    return docs.terminal_method(p, _KINDS)


_W = "'[ \\t\\n\\f\\r\\x0B]+'"


@query("x16_proper_nouns", f"""WITH w AS (SELECT doc_id, i, l[i] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), {_W}) AS l FROM documents))),
    m AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS b, regexp_replace(w, '[^\\p{{L}}]', '', 'g') AS word FROM w)
    SELECT doc_id, word, count(*)::BIGINT AS n FROM m WHERE b IS NOT NULL AND b <> '' AND NOT regexp_matches(b, '[.!?]$') AND regexp_matches(word, '^\\p{{Lu}}\\p{{Ll}}+$') AND NOT EXISTS (FROM m x WHERE x.doc_id = m.doc_id AND x.word = lower(m.word) AND regexp_matches(x.word, '^\\p{{Ll}}+$')) GROUP BY 1, 2""")
def x16(spark, sf):
    return docs.proper_nouns(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


@query("x9_select_pages", """WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
    p AS (SELECT doc_id, (floor(i / 5) + 1)::INT AS page, string_agg(line, chr(10) ORDER BY i) AS t FROM l GROUP BY 1, 2), h AS (SELECT doc_id, page, length(t) AS chars, (len(regexp_extract_all(lower(t), 'the')) + len(regexp_extract_all(lower(t), 'ti')))::INT AS hits FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page > 3, hits DESC, page) AS k FROM h),
    f AS (SELECT doc_id, 0::BIGINT AS k, 3000::BIGINT AS room, 0 AS page, 0 AS hits, false AS kept FROM (SELECT DISTINCT doc_id FROM o) UNION ALL SELECT o.doc_id, o.k, CASE WHEN chars <= room THEN room - chars ELSE room END, o.page, o.hits, chars <= room FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
    SELECT doc_id, page, hits FROM f WHERE kept""")
def x9(spark, sf):
    return docs.select_pages(docs.paged(spark.read.parquet(f"{sf}/documents.parquet"), 5), ["the", "ti"], 3000)


@query("x9_rank_tables", """WITH p AS (SELECT doc_id, i AS page, l[i] AS text FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
    k AS (SELECT *, (contains(lower(text), 'the')::INT + contains(lower(text), 'und')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), '1')::INT) AS n FROM p),
    t AS (SELECT doc_id, page * 10 + j AS table_id, page, contains(lower(concat_ws(' ', ti, left(text, 40 * j))), 'the')::INT + contains(lower(concat_ws(' ', ti, left(text, 40 * j))), 'und')::INT + contains(lower(concat_ws(' ', ti, left(text, 40 * j))), 'tion')::INT + contains(lower(concat_ws(' ', ti, left(text, 40 * j))), '1')::INT AS m
      FROM (SELECT doc_id, page, text, j, CASE WHEN (doc_id + page) % 3 = 0 THEN 'Table 1' END AS ti FROM p, (VALUES (1), (2)) v(j)))
    SELECT doc_id, table_id::INT AS table_id, page::INT AS page, 3 * m + n AS score, row_number() OVER (PARTITION BY doc_id ORDER BY 3 * m + n DESC, page, table_id)::INT AS place FROM t JOIN k USING (doc_id, page)""")
def x9_tables(spark, sf):
    """Two tables a line of every document, of its first characters, some with a title."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    p = d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page"), "text")
    t = p.withColumn("j", F.explode(F.array(F.lit(1), F.lit(2))))
    t = t.select("doc_id", (F.col("page") * 10 + F.col("j")).alias("table_id"), "page", F.when((F.col("doc_id") + F.col("page")) % 3 == 0, "Table 1").alias("title"), F.expr("left(text, 40 * j)").alias("text"))
    return docs.rank_tables(t, p, ["the", "und", "tion", "1"])
