import random
import re

import pytest
from pyspark.sql import functions as F

from fleetroll.functions.figures import figures
from fleetroll.operators import docs, facts


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "text,want",
    [
        ("A$1,900m – A$2,100bn at 30 June 2025, 12.5% less net debt - 850.0", [(1900.0, "m", "A$", False, False), (2100.0, "bn", "A$", False, False), (12.5, None, None, True, False), (850.0, None, None, False, True)]),
        ("7.25%–7.75%", [(7.25, None, None, True, False), (7.75, None, None, True, False)]),
        ("Less: net debt (850.0) (A$3m)", [(850.0, None, None, False, True), (3.0, "m", "A$", False, True)]),
        ("-5 in 3 markets by 2023-05-06, 2 thousandths", [(5.0, None, None, False, True), (3.0, None, None, False, False), (2.0, None, None, False, False)]),
        ("", []),
        (None, []),
    ],
)
def test_figures(spark, text, want):
    got = table(spark, [(text,)], "t string").select(figures(F.col("t")).alias("f")).first()["f"]
    assert [(x["value"], x["scale"], x["cur"], x["pct"], x["neg"]) for x in got] == want


def test_located(spark):
    """2: as it stands; 1: spacing ignored; 0: not, inside a number or, with its spacing, inside a word."""
    cases = [
        ("The rate is 7.25% here", "25%", 0), ("The rate is 7.25% here", "7.25%", 2), ("The rate is\n 7.25%  here", "RATE is 7.25%", 2), ("The r ate i s 7.25%", "rate is 7.25%", 1),
        ("therate is 7", "rate", 1), ("rates, rate", "rate", 2), ("3 25%", "25%", 2), ("Value 850.0", "850", 0), ("1850 and 850", "850", 2), ("", "", 0), (None, "a", 0), ("a", None, 0), (r"a \E b", r"\E b", 2), ("a" * 5000 + " b", "b", 2),
    ]
    got = table(spark, [(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string").select("i", facts.located(F.col("a"), F.col("b")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in got} == {i: k for i, (_, _, k) in enumerate(cases)}


def checked(spark, quote, page_text, **fact):
    row = {"fact_id": 1, "doc_id": 1, "page": 1, "key": None, "category": None, "unit": None, "percent": False, "value": None, "value_text": None, "low_text": None, "high_text": None, "quote": quote} | fact
    schema = "fact_id int, doc_id int, page int, key string, category string, unit string, percent boolean, value double, value_text string, low_text string, high_text string, quote string"
    f = table(spark, [tuple(row.values())], schema)
    p = table(spark, [(1, 1, page_text), (1, 2, "another page")], "doc_id int, page int, text string")
    r = facts.check_quotes(f, p, {"rate": "discount rate|wacc", "growth": "growth"}, "net debt").first()
    return r["ok"], [x["text"] for x in r["items"] if not x["ok"]]


def test_check_quotes(spark):
    assert checked(spark, "WACC of 7.25% and growth of 2.5%", "a WACC of 7.25% and growth of 2.5%.", key="growth", value_text="2.5%", value=2.5) == (True, [])
    assert checked(spark, "WACC of 7.25% and growth of 2.5%", "a WACC of 7.25% and growth of 2.5%.", key="rate", value_text="2.5%") == (False, ["value is under growth"])
    assert checked(spark, "as at 30 June 2025 (the", "as at 30 June 2025 (the", unit="date", value_text="30 July 2025", value=20250730.0) == (False, ["2025-07-30 is not in the quote"])
    assert checked(spark, "as at 30 June 2025 it held", "as at 30 June 2025 it held", value_text="A$30m") == (False, ["A$30m is not in the quote"])
    assert checked(spark, "utilisation 0.80", "utilisation 0.80", value_text="80%", percent=True) == (True, [])
    assert checked(spark, "from A$1,900m to A$2.1bn", "from A$1,900m to A$2.1bn", low_text="A$1,900m", high_text="A$2.1bn") == (False, ["the ends are in two scales"])
    assert checked(spark, None, None, value_text=None) == (False, ["no quote"])


def test_quotes_in_against_search(spark):
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choice("ab Ç\n") for _ in range(n))
    pages = [(d, p, letters(rng.choice([0, 1, 3, 40, 200]))) for d in range(12) for p in range(3)] + [(99, 0, None)]
    quotes = [(i, letters(rng.choice([0, 1, 2, 4, 7, 9, 20])) if i % 2 else (pages[i % 36][2] or "")[3 : 3 + i]) for i in range(60)] + [(98, None), (97, "a" * 300)]
    bare = lambda t: re.sub(r"\s+", "", (t or "").lower())
    want = {(q, d, p) for q, t in quotes if bare(t) for d, p, x in pages if bare(t) in bare(x)}
    got = docs.quotes_in(table(spark, quotes, "quote_id int, quote string"), table(spark, pages, "doc_id int, page int, text string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100
