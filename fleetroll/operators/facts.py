"""Facts read from reports against the pages they cite: where the quote stands, what it states, under which label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetroll.functions.figures import equal, figures, let, placed_figures, same_figure, scale_off, tokens
from fleetroll.functions.text import DATES, dates, squeezed

#: Statuses of a table that its facts may rely on; facts from one that is still unread quote the page's own text.
SETTLED = ("verified", "approved", "edited", "resolved")
_ITEM = "array<struct<ok: boolean, text: string, kind: string>>"


# ---------------------------------------------------------------- alignment


def _gaps(c: Column) -> Column:
    """One sign for each character of the squeezed text: 1 where white space stood before it, 0 elsewhere."""
    marked = F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), " [^ ]", "")
    return F.regexp_replace(F.regexp_replace(marked, "(?s)[^]", "0"), "", "1")


def located(text: Column, quote: Column) -> Column:
    """2 where the quote stands in the text, 1 where it does once spacing is ignored, 0 elsewhere or for an empty quote.

    Both are compared without white space; a parallel string keeps where it was, so that a place can be told to be inside
    a number ("25%" isn't in "7.25%", nor "7" in "7.25") or, spacing kept, inside a word.
    """

    def kind(t: Column, g: Column, q: Column, h: Column) -> Column:
        n = F.length(q)
        # all places: what lies between them has their lengths
        parts = F.transform(F.split(t, F.concat(F.lit(r"\Q"), F.replace(q, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), lambda x: F.length(x))
        step = lambda s, x: F.struct((s["end"] + x + n).alias("end"), F.concat(s["at"], F.array(s["end"] + x)).alias("at"))
        at = let(F.aggregate(parts, F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<int>)").alias("at")), step)["at"], lambda e: F.slice(e, 1, F.size(e) - 1))
        first, last = F.substring(q, 1, 1), F.substring(q, -1, 1)
        sub = lambda c, i, k: F.substr(c, F.greatest(i, F.lit(1)), F.when(i < 1, k + i - 1).otherwise(k))

        def place(p: Column) -> Column:
            before, after = sub(t, p - 1, F.lit(2)), sub(t, p + n + 1, F.lit(2))
            apart, apart_after = sub(g, p + 1, F.lit(1)) == "1", sub(g, p + n + 1, F.lit(1)) == "1"
            in_number = (first.rlike(r"\d") & before.rlike(r"\d[.,]?$")), (last.rlike(r"\d") & after.rlike(r"^[.,]?\d"))
            in_word = (first.rlike(r"\p{L}") & before.rlike(r"\p{L}$")), (last.rlike(r"\p{L}") & after.rlike(r"^\p{L}"))
            same = sub(g, p + 2, n - 1) == sub(h, F.lit(2), n - 1)
            strict = same & ~(~apart & (in_number[0] | in_word[0])) & ~(~apart_after & (in_number[1] | in_word[1]))
            return F.when(strict, 2).when(~in_number[0] & ~in_number[1], 1).otherwise(0)

        return F.coalesce(F.array_max(F.transform(at, place)), F.lit(0))

    q = squeezed(quote)
    found = let(F.struct(squeezed(text).alias("t"), _gaps(text).alias("g"), q.alias("q"), _gaps(quote).alias("h")), lambda s: kind(s["t"], s["g"], s["q"], s["h"]))
    return F.when(F.coalesce(F.contains(squeezed(text), q) & (q != ""), F.lit(False)), found).otherwise(0)


# ---------------------------------------------------------------- labels


def labels_over(facts: DataFrame, terms: dict[str, str], others: str) -> DataFrame:
    """(fact_id, under): the label over a fact's figure in its quote, where that is never its own.

    ``facts(fact_id, key, stated, quote, percent)``; ``terms`` are the patterns of the keys, ``others`` those of labels
    that are none, all in lower case.  A quote is a line of figures with the words between them.  A figure's label is in
    the words right before it; where there is none, its own label after it or further back will do, else the one after
    it, else the nearest back.
    """
    t = facts.where(F.col("key").isin(*terms)).select("fact_id", "key", tokens(F.lower("quote")).alias("t"), figures(F.col("stated")).alias("wanted"), F.coalesce("percent", F.lit(False)).alias("percent"))
    f = t.select("*", placed_figures(F.col("t")).alias("f"))
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("f", i - 1)["to"])
    between = F.transform(F.sequence(F.lit(0), F.size("f")), lambda i: F.struct(F.array_join(F.slice("t", start(i) + 1, F.coalesce(F.get("f", i)["at"], F.size("t")) - start(i)), "").alias("words"), F.get("f", i).alias("figure")))
    # a condition before explode, which adds one itself, would read all figures a second time for it
    some = F.when((F.size("f") > 0) & (F.size("wanted") > 0), between)
    line = f.select("fact_id", "key", "wanted", "percent", F.posexplode_outer(some).alias("i", "x")).where("i IS NOT NULL").select("fact_id", "key", "wanted", "percent", "i", "x.*")
    said = F.coalesce(*[F.when(F.col("key") == k, F.when(F.col("words").rlike(p), "own").otherwise(F.regexp_extract("words", "|".join([f"(?:{o})" for n, o in terms.items() if o != p] + [f"(?:{others})"]), 0))) for k, p in terms.items()])
    w = Window.partitionBy("fact_id").orderBy("i")
    line = line.withColumn("said", F.nullif(said, F.lit("")))
    line = line.withColumns({"after": F.lead("said").over(w), "back": F.last("said", True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    own = (F.col("after") == "own") | (F.col("back") == "own")
    line = line.where("figure IS NOT NULL").withColumn("label", F.coalesce("said", F.when(own, "own"), "after", "back"))
    hit = line.select("fact_id", "i", "label", "figure", "percent", F.posexplode("wanted").alias("k", "want")).where(same_figure(F.col("figure"), F.col("want"), F.col("percent")))
    per = hit.groupBy("fact_id", "k").agg(F.count_if(F.col("label").isNull() | (F.col("label") == "own")).alias("fine"), F.max_by("label", "i").alias("label")).where("fine = 0")
    return per.groupBy("fact_id").agg(F.min_by("label", "k").alias("under"))


def check_labels(facts: DataFrame, terms: dict[str, str], others: str) -> DataFrame:
    """``under``: the label a fact's figure stands under in its quote, if never its own; ``off``: scale or currency."""
    f = facts if "percent" in facts.columns else facts.withColumn("percent", F.lit(False))
    off = scale_off(figures(F.col("stated")), figures(F.col("quote")))
    return facts.select("fact_id", off.alias("off")).join(labels_over(f, terms, others), "fact_id", "left").select("fact_id", "under", "off")


# ---------------------------------------------------------------- quotes


def _item(ok: Column, yes: Column | str, no: Column | str, kind: str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, lit(yes)).otherwise(lit(no)).alias("text"), F.lit(kind).alias("kind"))


def _where(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """(fact_id, here, elsewhere): how the quote stands on its page (2, 1 or 0), and the first other page that holds it."""
    text = pages.select("doc_id", "page", F.col("text").alias("_t"))
    own = facts.select("fact_id", "doc_id", "page", "quote").join(text, ["doc_id", "page"], "left").withColumn("here", located(F.col("_t"), F.col("quote")))
    lost = own.where("here = 0 AND trim(coalesce(quote, '')) <> ''").select("fact_id", "doc_id", "quote")
    more = lost.join(text, "doc_id").withColumn("kind", located(F.col("_t"), F.col("quote"))).where("kind > 0")
    first = more.groupBy("fact_id").agg(F.min(F.struct((2 - F.col("kind")).alias("k"), F.col("page").alias("page"))).alias("b"))
    return own.select("fact_id", "here").join(first.select("fact_id", F.col("b.page").alias("elsewhere")), "fact_id", "left")


def _stated(name: str) -> Column:
    """Item on whether a text of the fact is in its quote: each of its figures, or as words; null for an empty text."""
    v, quote, missing = F.col(name), F.col("quote"), F.col(f"_missing_{name}")
    words = F.coalesce((F.col("category") == "identity") | (F.col("unit") == "text"), F.lit(False)) | (F.size(f"_figures_{name}") == 0)
    loose = F.forall(missing, lambda x: located(F.col("_undated"), F.concat(x["digits"], F.when(x["pct"], "%").otherwise(""))) > 0)
    kind = F.when(words, F.when(located(quote, v) == 2, 2).when(F.contains(squeezed(quote), squeezed(v)), 1).otherwise(0)).otherwise(F.when(F.size(missing) == 0, 2).when(loose, 1).otherwise(0))
    shown = F.when(words, F.concat(F.lit("'"), v, F.lit("'"))).otherwise(v)
    item = let(kind, lambda k: _item(k > 0, F.concat(shown, F.when(k == 2, " in the quote").otherwise(" in the quote, spacing ignored")), F.concat(shown, F.lit(" is not in the quote")), "figure"))
    return F.when(v != "", item)


def _missing(name: str) -> Column:
    """Figures of a text of the fact that its quote doesn't have, in either form where it may be a per cent."""
    pct = F.coalesce(F.col("percent") | (F.col("unit") == "%"), F.lit(False))

    def form(x: Column, y: Column) -> Column:
        alike = (x["neg"] == y["neg"]) & (x["pct"] == y["pct"]) & equal(x["value"], y["value"])
        return alike | (pct & (x["pct"] != y["pct"]) & same_figure(x, y, F.lit(True)))

    return F.filter(F.col(f"_figures_{name}"), lambda x: ~F.exists("_figures_quote", lambda y: form(x, y)))


def check_quotes(facts: DataFrame, pages: DataFrame, terms: dict[str, str] | None = None, others: str = "(?!)", tables: DataFrame | None = None) -> DataFrame:
    """(fact_id, ok, items): whether the text that a fact cites supports it, as an array of (ok, text, kind).

    ``facts(fact_id, doc_id, page, key, category, unit, percent, value, value_text, low_text, high_text, quote)``,
    ``pages(doc_id, page, text)``, ``tables(doc_id, page, table_id, status, text)`` if known.  The kinds: ``quote``, it stands on
    its page, inside no word or number, at worst with spacing ignored; ``figure``, every figure of value and ends is in
    the quote with its sign and per cent, 80 % as 0.80 where ``percent``, no other scale or currency, under no other
    label, dates whole, and ``value`` is what its text says; ``range``, both ends or none, in one scale; ``table``, what
    it was taken from is settled.  Nulls are empty texts; a fact without a quote isn't supported.
    """
    text = {c: F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("value_text", "low_text", "high_text", "quote")}
    base = facts.withColumns(text).withColumn("percent", F.coalesce("percent", F.lit(False)))
    texts = ("value_text", "low_text", "high_text")
    f = base.withColumns({f"_figures_{c}": figures(F.col(c)) for c in text}).withColumn("_undated", F.regexp_replace("quote", "|".join(f"(?i:{p})" for p, _ in DATES), " "))
    f = f.withColumns({f"_missing_{c}": _missing(c) for c in texts}).join(_where(base, pages), "fact_id")
    parts = {c: _stated(c) for c in texts}
    fig = lambda c: F.col(f"_figures_{c}")
    date = F.get(F.filter(dates(F.col("value_text")), lambda d: d.isNotNull()), F.lit(0))
    f = f.withColumn("_date", F.when(F.col("unit") == "date", date))
    here, page = F.col("here"), F.col("page").cast("string")
    place = (
        F.when(F.col("quote") == "", _item(F.lit(False), "", "no quote", "quote"))
        .when(here == 2, _item(F.lit(True), F.concat(F.lit("quote on page "), page), "", "quote"))
        .when(here == 1, _item(F.lit(True), F.concat(F.lit("quote on page "), page, F.lit(", spacing ignored")), "", "quote"))
        .when(F.col("elsewhere").isNotNull(), _item(F.lit(False), "", F.concat(F.lit("quote is on page "), F.col("elsewhere").cast("string"), F.lit(", not "), page), "quote"))
        .otherwise(_item(F.lit(False), "", "quote not found", "quote"))
    )
    items = [place]
    for c in parts:
        own = f"_item_{c}"
        f = f.withColumn(own, parts[c] if c != "value_text" else F.when(F.col("_date").isNull(), parts[c]))
        f = f.withColumn(f"_off_{c}", F.when(F.col(own)["ok"], scale_off(fig(c), fig("quote"))))
        off = F.col(f"_off_{c}")
        items += [F.col(own), F.when(off.isNotNull(), _item(F.lit(False), "", F.concat(F.col(c), F.lit(" has another "), off, F.lit(" in the quote")), "figure"))]
    alike = lambda c: F.transform(F.slice(fig(c), 1, 1), lambda x: F.struct(F.lit(1.0).alias("value"), x["scale"].alias("scale"), F.lit(None).cast("string").alias("cur")))
    one = (F.col("low_text") == "") != (F.col("high_text") == "")
    scales = scale_off(alike("low_text"), alike("high_text"))
    items += [
        F.when(one, _item(F.lit(False), "", F.concat(F.lit("only the "), F.when(F.col("low_text") != "", "low").otherwise("high"), F.lit(" end is given")), "range")),
        F.when(scales.isNotNull(), _item(F.lit(False), "", "the ends are in two scales", "range")),
    ]
    shown = F.date_format("_date", "yyyy-MM-dd")
    joined = F.regexp_replace("quote", r"(?<=[A-Za-z])\s+(?=[a-z])", "")
    dated = F.array_contains(dates(F.col("quote")), F.col("_date")) | F.array_contains(dates(joined), F.col("_date"))
    first = F.get(fig("value_text"), F.lit(0))
    says = F.when(F.col("_date").isNotNull(), F.date_format("_date", "yyyyMMdd").cast("double")).when(F.coalesce(F.col("unit") != "date", F.lit(True)), F.when(first["neg"], -first["value"]).otherwise(first["value"]))
    items += [
        F.when(F.col("_date").isNotNull(), _item(dated, F.concat(shown, F.lit(" in the quote")), F.concat(shown, F.lit(" is not in the quote")), "figure")),
        F.when(F.col("value").isNotNull() & says.isNotNull(), _item(equal(F.col("value"), says), "value as its text", "value is not as its text", "figure")),
    ]
    f = f.withColumn("items", F.array_compact(F.array(*items)))
    if terms:
        each = base.select("fact_id", "key", "quote", "percent", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("stated")) for c in texts])).alias("x")).where("x.stated <> ''")
        each = each.select(F.struct("fact_id", "x.c").alias("fact_id"), "key", "quote", "percent", "x.stated")
        under = labels_over(each, terms, others).select("fact_id.*", "under").groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("c", "under"))).alias("_u"))
        f = f.join(under, "fact_id", "left")
        bad = F.transform(F.coalesce("_u", F.array().cast("array<struct<c: string, under: string>>")), lambda x: _item(F.lit(False), "", F.concat(F.regexp_replace(x["c"], "_text", ""), F.lit(" is under "), x["under"]), "figure"))
        f = f.withColumn("items", F.concat("items", bad))
    if tables is not None:
        t = base.select("fact_id", "doc_id", "page", "quote").join(tables.select("doc_id", "page", "table_id", "status", F.col("text").alias("_t")), ["doc_id", "page"]).where(located(F.col("_t"), F.col("quote")) > 0)
        fine = F.col("status").isin(*SETTLED) | (F.col("status") == "unread")
        item = _item(fine, F.concat(F.lit("table "), F.col("table_id").cast("string"), F.lit(" is "), F.col("status")), F.concat(F.lit("table "), F.col("table_id").cast("string"), F.lit(" is "), F.coalesce("status", F.lit("without status"))), "table")
        t = t.groupBy("fact_id").agg(F.array_sort(F.collect_list(item)).alias("_items"))
        f = f.join(t, "fact_id", "left").withColumn("items", F.concat("items", F.coalesce("_items", F.array().cast(_ITEM))))
    return f.select("fact_id", F.forall("items", lambda x: x["ok"]).alias("ok"), "items")
