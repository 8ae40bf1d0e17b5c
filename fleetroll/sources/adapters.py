"""Views of the given star-schema tables as the library's own tables.

Each view is one SELECT that Spark and other engines read alike; a query's check SQL starts from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: view -> (base tables, SELECT)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    # a model is a supplier; its sheets are the return flags, its rows the line statuses
    "series": (
        ("lineitem",),
        """SELECT l_suppkey AS workbook_id, l_returnflag AS sheet, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS row_no,
           last_day(CAST(l_shipdate AS DATE)) AS period_end, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value
           FROM {lineitem} GROUP BY 1, 2, 3, 4""",
    ),
    # this year's version: some models revised, one row in each dropped, the sheets of others renamed
    "series_now": (
        ("lineitem",),
        """SELECT l_suppkey AS workbook_id, CASE WHEN l_suppkey % 7 = 3 AND l_returnflag = 'A' THEN 'A2' ELSE l_returnflag END AS sheet,
           CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS row_no, last_day(CAST(l_shipdate AS DATE)) AS period_end,
           round(sum(l_extendedprice * (1 - l_discount) * CASE WHEN l_suppkey % 3 = 0 AND l_shipdate >= TIMESTAMP '2000-01-01 00:00:00' THEN 1.04 ELSE 1.0 END), 4) AS value
           FROM {lineitem} WHERE NOT (l_suppkey % 5 = 1 AND l_returnflag = 'R' AND l_linestatus = 'O') GROUP BY 1, 2, 3, 4""",
    ),
    "flows": (
        ("orders",),
        """SELECT core_id, period_end, round(CASE WHEN n = 1 THEN -amount ELSE amount END, 4) AS cf FROM (
           SELECT core_id, period_end, amount, row_number() OVER (PARTITION BY core_id ORDER BY period_end) AS n FROM (
           SELECT o_custkey AS core_id, last_day(CAST(o_orderdate AS DATE)) AS period_end, sum(o_totalprice) AS amount FROM {orders} GROUP BY 1, 2) a) b""",
    ),
    "discountings": (
        ("customer",),
        """SELECT c_custkey AS core_id, round(0.05 + 0.07 * (c_acctbal + 1000) / 11000, 4) AS rate, DATE '1997-06-30' AS valuation_date,
           CASE c_custkey % 3 WHEN 0 THEN 'end' WHEN 1 THEN 'mid' ELSE 'mid-year' END AS timing,
           CASE c_custkey % 2 WHEN 0 THEN 'actual/actual' ELSE 'actual/365' END AS day_count,
           CASE WHEN c_custkey % 4 = 0 THEN DATE '2000-06-30' END AS terminal_date FROM {customer}""",
    ),
    # src reads dst; nodes are numbered apart by kind
    "edges": (
        ("customer", "supplier", "nation", "region"),
        """SELECT src, dst, kind FROM (
           SELECT 1000000000 + c_custkey AS src, 1000 + CAST(c_nationkey AS BIGINT) AS dst, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'direct' END AS kind FROM {customer}
           UNION ALL SELECT 2000000000 + s_suppkey, 1000 + CAST(s_nationkey AS BIGINT), 'offset' FROM {supplier}
           UNION ALL SELECT 1000 + CAST(n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), 'direct' FROM {nation}
           UNION ALL SELECT CAST(r_regionkey AS BIGINT), CAST(r_regionkey AS BIGINT), 'direct' FROM {region}) e""",
    ),
    "rows_prior": (
        ("part",),
        """SELECT p_partkey % 40 AS workbook_id, p_brand AS sheet, CAST(p_partkey AS BIGINT) AS row_no, p_name AS label, p_type AS section, p_retailprice AS figure FROM {part}""",
    ),
    "rows_now": (
        ("part",),
        """SELECT p_partkey % 40 AS workbook_id, CASE WHEN p_brand = 'Brand#3' THEN 'Brand#3 new' ELSE p_brand END AS sheet, CAST(p_partkey AS BIGINT) + 2 AS row_no,
           CASE WHEN p_size = 7 THEN concat(p_name, ' revised') ELSE p_name END AS label, p_type AS section,
           round(p_retailprice * CASE WHEN p_size > 40 THEN 1.1 ELSE 1.0 END, 4) AS figure FROM {part} WHERE p_size <> 13""",
    ),
    # models of fifty rows each on three sheets: rows, what reads what, and values; and this year's version of them, where
    # rows are dropped, relabelled, moved (not the banners above row 11) and revised, and one sheet is renamed
    "model_rows": (
        ("part",),
        """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, concat('S', CAST(p_size % 3 AS STRING)) AS sheet, p_partkey % 50 + 1 AS row_no,
           concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' costs of ' ELSE ' ' END, lower(p_type)) AS label, p_type AS section FROM {part}""",
    ),
    "model_rows_now": (
        ("part",),
        """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, CASE WHEN p_size % 3 = 2 AND CAST(floor(p_partkey / 50) AS BIGINT) % 4 = 1 THEN 'S2 new' ELSE concat('S', CAST(p_size % 3 AS STRING)) END AS sheet,
           p_partkey % 50 + 1 + CASE WHEN p_partkey % 50 >= 10 AND CAST(floor(p_partkey / 50) AS BIGINT) % 3 > 0 THEN 3 ELSE 0 END AS row_no,
           concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ' costs of ' ELSE ' ' END, lower(p_type), CASE WHEN p_size % 7 = 5 THEN ' revised' ELSE '' END) AS label, p_type AS section FROM {part} WHERE p_size <> 13""",
    ),
    "model_edges": (
        ("part",),
        """SELECT CAST(floor(a.p_partkey / 50) AS BIGINT) AS workbook_id, a.p_partkey % 50 + 1 AS src, b.p_partkey % 50 + 1 AS dst FROM {part} a JOIN (
           SELECT p_partkey, p_partkey - 7 AS up FROM {part} UNION ALL SELECT p_partkey, p_partkey - 13 FROM {part} UNION ALL SELECT p_partkey, p_partkey - 20 FROM {part} WHERE p_partkey % 50 < 30) b ON b.up = a.p_partkey
           WHERE CAST(floor(a.p_partkey / 50) AS BIGINT) = CAST(floor(b.p_partkey / 50) AS BIGINT)""",
    ),
    "model_edges_now": (
        ("part",),
        """SELECT w AS workbook_id, x + CASE WHEN x > 10 AND w % 3 > 0 THEN 3 ELSE 0 END AS src, y + CASE WHEN y > 10 AND w % 3 > 0 THEN 3 ELSE 0 END AS dst FROM (
           SELECT CAST(floor(a.p_partkey / 50) AS BIGINT) AS w, CAST(floor(b.p_partkey / 50) AS BIGINT) AS w2, a.p_partkey % 50 + 1 AS x, b.p_partkey % 50 + 1 AS y FROM {part} a JOIN (
           SELECT p_partkey, p_partkey - CASE WHEN p_size % 11 = 4 THEN 8 ELSE 7 END AS up FROM {part} WHERE p_size <> 13 UNION ALL SELECT p_partkey, p_partkey - 13 FROM {part} WHERE p_size <> 13 UNION ALL SELECT p_partkey, p_partkey - 20 FROM {part} WHERE p_size <> 13 AND p_partkey % 50 < 30) b ON b.up = a.p_partkey
           WHERE a.p_size <> 13) e WHERE w = w2""",
    ),
    "model_points": (
        ("part",),
        """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, concat('S', CAST(p_size % 3 AS STRING)) AS sheet, p_partkey % 50 + 1 AS row_no, make_date(2020 + k, 12, 31) AS period_end,
           CAST(round(CASE WHEN p_size = 20 THEN 1.0 ELSE p_retailprice * (1 + p_partkey % 9 * 0.01 * k) END, 4) AS DOUBLE) AS value FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(k)) p""",
    ),
    "model_points_now": (
        ("part",),
        """SELECT CAST(floor(p_partkey / 50) AS BIGINT) AS workbook_id, CASE WHEN p_size % 3 = 2 AND CAST(floor(p_partkey / 50) AS BIGINT) % 4 = 1 THEN 'S2 new' ELSE concat('S', CAST(p_size % 3 AS STRING)) END AS sheet,
           p_partkey % 50 + 1 + CASE WHEN p_partkey % 50 >= 10 AND CAST(floor(p_partkey / 50) AS BIGINT) % 3 > 0 THEN 3 ELSE 0 END AS row_no, make_date(2020 + k, 12, 31) AS period_end,
           CAST(round(CASE WHEN p_size = 20 THEN 1.0 ELSE p_retailprice * (1 + p_partkey % 9 * 0.01 * k) END * CASE WHEN k < 3 THEN 1.0 WHEN p_size % 4 = 1 THEN 1.04 WHEN p_size % 4 = 3 THEN 1.6 ELSE 1.0 END, 4) AS DOUBLE) AS value
           FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) v(k)) p WHERE p_size <> 13 AND NOT (p_size % 5 = 2 AND k > 3)""",
    ),
    # line items of all models of both years, as one fleet of workbooks
    "fleet_items": (
        ("part",),
        """SELECT CAST(floor(p_partkey / 50) AS BIGINT) + v AS workbook_id, CASE WHEN v > 0 AND p_partkey % 50 > 44 THEN 'Value' ELSE concat('S', CAST(p_size % 3 AS STRING)) END AS sheet,
           concat(p_name, ' of ', p_brand, CASE WHEN v > 0 AND p_size % 7 = 5 THEN ' revised' ELSE '' END) AS label, CASE WHEN p_size % 5 = v % 7 THEN concat('R[]C', CAST(p_size AS STRING)) ELSE p_type END AS shape
           FROM {part} CROSS JOIN (SELECT * FROM (VALUES (0), (1000000)) x(v)) y WHERE NOT (v = 0 AND p_partkey % 50 > 44) AND NOT (v > 0 AND CAST(floor(p_partkey / 50) AS BIGINT) % 3 = 1 AND p_size % 2 = 0)""",
    ),
    "calls": (
        ("events",),
        """SELECT event_id AS id, ts, event_type AS model, user_id AS session_id, CASE WHEN user_id % 4 = 0 THEN 'review' ELSE 'draft' END AS purpose,
           CAST(floor(value * 100) AS BIGINT) AS tokens, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok FROM {events}""",
    ),
    "runlog": (
        ("events",),
        """SELECT event_id AS id, ts AS at, user_id % 50 AS engagement_id, CASE WHEN user_id % 2 = 0 THEN 'match' ELSE 'value' END AS stage,
           CASE WHEN event_type IN ('view', 'signup') THEN 'start' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'purchase' THEN 'end' ELSE 'note' END AS event FROM {events}""",
    ),
    "prices": (("region",), """SELECT * FROM (VALUES ('view', 1.5), ('click', 0.5), ('signup', 3.0), ('error', 0.25)) p(model, price)"""),
    "evidence": (
        ("documents", "labels"),
        """SELECT d.doc_id AS id, concat(lang, '+', source) AS agreed, l.quality AS correct FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    ),
    "signatures": (
        ("part",),
        """SELECT p_partkey % 40 AS workbook_id, p_brand AS sheet, p_name AS label, concat(p_type, ':', CAST(p_size % 5 AS STRING)) AS shape FROM {part}""",
    ),
}


#: Bytes of files up to which a side is broadcast unseen (parameter lists, nations), and bytes of rows up to which one is that was counted.
UNSEEN, COUNTED = 64 << 10, 10 << 20


def counted_broadcasts(spark: SparkSession) -> None:
    """Lets Spark broadcast what it has counted in a shuffle only, unless the session says otherwise.

    Before a query runs its sides are known by their compressed files, which may be a fiftieth of the rows in memory:
    several such sides would fill the driver.
    """
    if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(COUNTED))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(UNSEEN))


#: Parts that one task makes points of; and those of small tables, up to eight tasks.
PARTS, FEW = 20_000, 1_000


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    counted_broadcasts(spark)
    tables, sql = VIEWS[name]
    base = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if name.startswith("model_points"):
        # six rows a part: a few MB of compressed file would be one or two tasks, whatever its rows grow to
        parts = base["part"].count()
        n = max(1, min(8, parts // FEW), -(-parts // PARTS))
        base["part"] = base["part"].repartition(n, F.expr("CAST(floor(p_partkey / 50) AS BIGINT)"))
    return spark.sql(sql, **base)


def cte(*names: str) -> str:
    """WITH clause of the views, for check SQL."""
    out = []
    for n in names:
        tables, sql = VIEWS[n]
        out.append(f"{n} AS ({sql.format(**{t: t for t in tables}).replace('AS STRING', 'AS VARCHAR')})")
    return "WITH " + ",\n".join(out)
