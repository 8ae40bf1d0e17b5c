"""Tables from cells: timelines, series, kinds of rows, blocks, periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetroll.functions.text import letters


def series(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """Numeric cells with the date at the head of their column: long series."""
    return cells.where("value is not null").join(headers, ["workbook_id", "sheet", "col"]).select("workbook_id", "sheet", "row_no", "period_end", "value")


def timeline(header_cells: DataFrame, least: int = 4) -> DataFrame:
    """Per sheet the row with most dates (the first on a tie) and its longest run of neighbouring date columns.

    ``header_cells(workbook_id, sheet, row_no, col)`` are the cells that hold dates.  Runs shorter than ``least`` don't count.
    """
    by = ["workbook_id", "sheet"]
    n = header_cells.groupBy(*by, "row_no").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = n.groupBy(*by).agg(F.min_by("row_no", F.struct(-F.col("n"), F.col("row_no"))).alias("row_no"))
    d = header_cells.join(best, [*by, "row_no"]).withColumn("_g", F.col("col") - F.row_number().over(Window.partitionBy(*by).orderBy("col")))
    runs = d.groupBy(*by, "row_no", "_g").agg(F.min("col").alias("tl_first"), F.max("col").alias("tl_last"), F.count("*").alias("periods"))
    w = Window.partitionBy(*by).orderBy(F.col("periods").desc(), "tl_first")
    runs = runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).where(F.col("periods") >= least)
    return runs.select(*by, F.col("row_no").alias("header_row"), "tl_first", "tl_last", "periods")


def periodicity(dates: DataFrame, by: list[str]) -> DataFrame:
    """monthly, quarterly, semi-annual, annual or irregular, by the median gap in days."""
    d = dates.select(*by, "period_end").distinct()
    gap = F.date_diff("period_end", F.lag("period_end").over(Window.partitionBy(*by).orderBy("period_end")))
    g = d.withColumn("_g", gap).where("_g is not null").groupBy(*by).agg(F.median("_g").alias("gap"))
    m = F.col("gap")
    return g.withColumn("periodicity", F.when(m.between(26, 33), "monthly").when(m.between(85, 95), "quarterly").when(m.between(178, 187), "semi-annual").when(m.between(360, 370), "annual").otherwise("irregular"))


def row_kinds(s: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """What a row is, by its cells: the first that holds of dates, text, empty, figure, subtotal, flags, share, factors, index, ratio, series, inputs.

    ``s(*by, period_end, value)`` and, where it has them, ``text``, ``date``, ``formula`` (R1C1); a row of formulas is a
    series, one of typed figures inputs.  Without formulas all rows of figures are series.
    """
    have = set(s.columns)
    s = s.withColumns({c: F.lit(None).cast(t) for c, t in (("text", "string"), ("date", "date")) if c not in have})
    typed = "formula" in have
    s = s if typed else s.withColumn("formula", F.lit("="))
    v, at = F.col("value"), Window.partitionBy(*by).orderBy("period_end")
    nz = F.when(v != 0, v)
    before = F.last(nz, ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    d = s.withColumn("_b", before).withColumn("_step", F.when((v != 0) & (F.col("_b") != 0), v / F.col("_b")))
    a = d.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.count("text").alias("texts"),
        F.count("date").alias("dates"),
        F.count_if(F.col("formula").isNotNull() & v.isNotNull()).alias("formulas"),
        F.min_by("formula", F.when(F.col("formula").isNotNull(), F.col("period_end"))).alias("first_formula"),
        F.count(nz).alias("n_nz"),
        F.every(v.isin(0.0, 1.0)).alias("only01"),
        F.max(v).alias("hi"),
        F.min(v).alias("lo"),
        F.count_distinct(F.round(v, 12)).alias("values"),
        F.min_by(nz, F.when(v != 0, F.col("period_end"))).alias("first_nz"),
        F.max_by(nz, F.when(v != 0, F.col("period_end"))).alias("last_nz"),
        F.min(nz).alias("lo_nz"),
        F.max(F.abs(nz)).alias("abs_nz"),
        F.max(nz).alias("hi_nz"),
        F.coalesce(F.every((v == 0) | F.col("_b").isNull() | (v <= F.col("_b") + 1e-12)), F.lit(True)).alias("falling"),
        F.min("_step").alias("lo_step"),
        F.max("_step").alias("hi_step"),
        F.stddev_pop("_step").alias("dev"),
    )
    c = F.col
    long = c("n") >= least
    kind = (
        F.when((c("dates") >= least) & (c("dates") >= c("n")), "dates")
        .when(c("n") == 0, F.when(c("texts") > 0, "text").otherwise("empty"))
        .when(c("n") == 1, "figure")
        .when(c("first_formula").rlike(r"SUM\(R\[-\d+\]C(?:\[\d+\])?:R\[-1\]C|^=?\s*R\[-\d+\]C(?:\s*[+-]\s*R\[-\d+\]C){2,}"), "subtotal")
        .when(long & c("only01") & (c("hi") == 1), "flags")
        .when(long & (c("values") == 1) & (c("lo") > 0) & (c("hi") < 1), "share")
        .when(long & (c("n_nz") >= least) & (c("lo_nz") > 0) & (c("hi_nz") <= 1) & (c("first_nz") > 0.5) & c("falling") & (c("last_nz") < c("first_nz")), "factors")
        .when(long & (c("n_nz") >= 4) & c("first_nz").between(0.5, 2) & (c("lo_nz") > 0) & (c("lo_step") >= 0.995) & (c("hi_step") <= 1.2) & (c("dev") < 0.01), "index")
        .when(long & (c("abs_nz") < 1), "ratio")
        .when(c("formulas") >= F.greatest(F.lit(1), c("n") - c("formulas")), "series")
        .otherwise("inputs")
    )
    return a.select(*by, kind.alias("kind"))


def text_columns(texts: DataFrame, timelines: DataFrame, scan: int = 8) -> DataFrame:
    """The label and the units column of each sheet: (workbook_id, sheet, label_col, units_col).

    ``texts(workbook_id, sheet, row_no, col, text)``; columns left of the timeline count, or the ``scan`` first of a sheet
    without one.  Label: most texts times their mean length, which counts up to 20 (the first on a tie).  Units: right of
    it, a fifth as many texts at least, of 12 characters on average at most, of which at most .6 are distinct: the most.
    """
    sheet = ["workbook_id", "sheet"]
    first = texts.groupBy(*sheet).agg(F.min("col").alias("_first"))
    t = texts.join(timelines.select(*sheet, "tl_first"), sheet, "left").join(first, sheet).where(F.col("col") < F.coalesce("tl_first", F.col("_first") + scan))
    c = t.where("trim(text) <> ''").groupBy(*sheet, "col").agg(F.count("*").alias("n"), F.avg(F.length(F.trim("text"))).alias("len"), (F.count_distinct(F.trim("text")) / F.count("*")).alias("distinct"))
    label = c.groupBy(*sheet).agg(F.max_by(F.struct("col", "n"), F.struct(F.round(F.col("n") * F.least("len", F.lit(20.0)), 9), -F.col("col"))).alias("l")).select(*sheet, F.col("l.col").alias("label_col"), F.col("l.n").alias("_n"))
    u = c.join(label, sheet).where("col > label_col and n >= 0.2 * _n and len <= 12 and `distinct` <= 0.6")
    units = u.groupBy(*sheet).agg(F.max_by("col", F.struct("n", -F.col("col"))).alias("units_col"))
    return label.join(units, sheet, "left").select(*sheet, "label_col", "units_col")


def blocks(rows: DataFrame, by: list[str], gap: int = 2) -> DataFrame:
    """Line items under one section with at most one blank row between them: first, last, count, labels in order."""
    w = Window.partitionBy(*by).orderBy("row_no")
    new = (F.col("row_no") - F.lag("row_no").over(w) > gap) | ~F.col("section").eqNullSafe(F.lag("section").over(w))
    d = rows.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("block", F.sum("_new").over(w))
    g = d.groupBy(*by, "block").agg(F.min("row_no").alias("first"), F.max("row_no").alias("last"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("row_no", "label"))).alias("_l"))
    return g.withColumn("labels", F.array_join(F.transform("_l", lambda x: x["label"]), "|")).drop("_l")


def signed_blocks(rows: DataFrame, by: list[str], gap: int = 2) -> DataFrame:
    """Blocks of line items with their signatures: (by, block, section, first, last, n, by_label, by_shape).

    ``rows(by, row_no, section, label, kind, shape)``: rows that are empty or text belong to none, and at most one such row,
    or one that isn't there, stands between two of a block.  ``by_label`` has a row's kind and its label in letters,
    ``by_shape`` its kind and its formula's shape, in order: what ``structure.block_copies`` compares.
    """
    r = rows.where(~F.coalesce("kind", F.lit("empty")).isin("empty", "text"))
    w = Window.partitionBy(*by).orderBy("row_no")
    new = (F.col("row_no") - F.lag("row_no").over(w) > gap) | ~F.col("section").eqNullSafe(F.lag("section").over(w))
    d = r.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("block", F.sum("_new").over(w))
    one = F.struct("row_no", F.concat_ws("|", "kind", letters(F.col("label"))).alias("l"), F.concat_ws("|", "kind", F.coalesce("shape", F.lit(""))).alias("s"))
    g = d.groupBy(*by, "block").agg(F.first("section").alias("section"), F.min("row_no").alias("first"), F.max("row_no").alias("last"), F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("_x"))
    return g.select(*by, "block", "section", "first", "last", "n", F.transform("_x", lambda x: x["l"]).alias("by_label"), F.transform("_x", lambda x: x["s"]).alias("by_shape"))


def period_ends(starts: DataFrame, by: list[str]) -> DataFrame:
    """Ends of periods given by their first days: the day before the next start; the last by the longest step in months."""
    w = Window.partitionBy(*by).orderBy("start")
    nxt = F.lead("start").over(w)
    months = F.round(F.months_between(nxt, "start")).cast("int")
    usual = F.max(months).over(Window.partitionBy(*by))
    return starts.withColumn("_n", nxt).withColumn("_m", usual).withColumn("period_end", F.date_sub(F.coalesce("_n", F.add_months("start", F.col("_m"))), 1)).drop("_n", "_m")


def sheet_ends(header: DataFrame, dated: DataFrame, by: list[str], pattern: str = r"(?i)period end|end date|ending", cover: float = 0.8) -> DataFrame:
    """(by, col, period_end, how): the end of the period of every column of a sheet, and where it is from.

    'row': the first row labelled as an end that has dates for ``cover`` of the columns; 'starts': a header of firsts of a
    month, whose periods end the day before the next starts, the last after the upper median of the gaps in whole
    months; 'header': the header's dates.  ``header(by, col, date)``, ``dated(by, row_no, label, col, date)`` are cells with dates.
    """
    n = header.groupBy(*by).agg(F.count_distinct("col").alias("_n"), F.every(F.dayofmonth("date") == 1).alias("_starts"))
    ends = dated.where(F.col("label").rlike(pattern)).join(header.select(*by, "col"), [*by, "col"], "left_semi")
    best = ends.groupBy(*by, "row_no").agg(F.count_distinct("col").alias("m")).join(n, by).where(F.col("m") >= cover * F.col("_n")).groupBy(*by).agg(F.min("row_no").alias("row_no"))
    row = ends.join(best, [*by, "row_no"]).select(*by, "col", F.col("date").alias("period_end"), F.lit("row").alias("how"))
    rest = header.join(n, by).join(best.select(*by), by, "left_anti")
    d = rest.select(*by, "date").distinct().withColumn("_next", F.lead("date").over(Window.partitionBy(*by).orderBy("date")))
    g = d.groupBy(*by).agg(F.sort_array(F.collect_list(F.date_diff("_next", "date"))).alias("_g"))
    length = F.greatest(F.lit(1), F.round(F.coalesce(F.get("_g", F.floor(F.size("_g") / 2).cast("int")), F.lit(91)) / 30.44).cast("int"))
    d = d.join(g.select(*by, length.alias("_len")), by)
    end = F.when(F.col("_starts"), F.date_sub(F.coalesce("_next", F.add_months("date", F.col("_len"))), 1)).otherwise(F.col("date"))
    head = rest.join(d, [*by, "date"]).select(*by, "col", end.alias("period_end"), F.when(F.col("_starts"), "starts").otherwise("header").alias("how"))
    return row.unionByName(head)


def phases(flags: DataFrame, by: list[str]) -> DataFrame:
    """Spans of consecutive periods with the same phase: the first flagged row's label, by row. One span is none."""
    p = flags.where("value = 1").groupBy(*by, "period_end").agg(F.min_by("label", "row_no").alias("phase"))
    w = Window.partitionBy(*by).orderBy("period_end")
    d = p.withColumn("_c", F.when(F.col("phase") == F.lag("phase").over(w), 0).otherwise(1)).withColumn("_g", F.sum("_c").over(w))
    g = d.groupBy(*by, "_g", "phase").agg(F.min("period_end").alias("first_end"), F.max("period_end").alias("last_end"), F.count("*").alias("periods"))
    return g.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n > 1").drop("_g", "_n")


#: Rules of a timing row, strongest first; bit i of a row's lattice is set while rule i holds for every period.
TIMING = ["date", "end", "start", "year", "after", "up to", "constant"]


def serial(d: Column) -> Column:
    """A date as a spreadsheet's number."""
    return F.date_diff(d, F.lit("1899-12-30").cast("date"))


def from_serial(v: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), v.cast("int"))


def _month_gaps(d: Column) -> Column:
    months = lambda x: F.year(x) * 12 + F.month(x)
    return F.zip_with(F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))), F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), lambda y, x: months(y) - months(x))


def _own_rule(values: Column) -> Column:
    """The rule of a row that carries its own periods, learned from its values in order: year numbers one apart, or dates a
    fixed number of months apart, on one day or at months' ends, of which the first and the last may be short stubs."""
    n = F.size(values)
    whole = F.forall(values, lambda v: v == F.floor(v))
    years = F.forall(values, lambda v: v.between(1900, 2200))
    one_apart = F.forall(F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda y, x: y - x), lambda g: g == 1)
    as_dates = F.forall(values, lambda v: (v > 3000) & (v < 120000))
    d = F.transform(values, lambda v: from_serial(v))
    gaps = _month_gaps(d)
    inner = lambda x, k: F.when(F.size(x) > k, F.slice(x, 2, F.greatest(F.size(x) - 2, F.lit(0)))).otherwise(x)
    body, days = inner(gaps, 2), inner(d, 3)
    step = F.get(body, F.lit(0))
    even = F.forall(body, lambda g: g == step) & (step > 0) & F.get(gaps, F.lit(0)).between(1, step) & F.get(gaps, F.size(gaps) - 1).between(1, step)
    regular = F.forall(days, lambda x: x == F.last_day(x)) | (F.size(F.array_distinct(F.transform(days, lambda x: F.dayofmonth(x)))) == 1)
    rule = F.when(years, F.when(one_apart, F.struct(F.lit("own years").alias("rule"), F.lit(12).alias("months")))).when(as_dates & even & regular, F.struct(F.lit("own dates").alias("rule"), step.cast("int").alias("months")))
    return F.when((n >= 3) & whole, rule)


def timing_rules(s: DataFrame, date: Column, by: list[str], sheet: list[str]) -> DataFrame:
    """The one rule by which a row's values follow from its periods: (by, rule, offset, months), rule null if there is none.

    ``s(by, period_end, value)``, ``period_end`` the date at the head of the column, ``sheet`` the columns of ``by`` that name its
    sheet.  The rules, of which the first counts: the period's date, its end, its start; the year it ends in with an
    ``offset`` of one at most; 1 after ``date`` or up to it; one constant; the row's own dates, ``months`` apart; its own years.
    Where all dates of a sheet are firsts of a month they start the periods, whose length is the upper median of the
    gaps.  Rows with one value have no rule.
    """
    g = s.select(*sheet, "period_end").distinct()
    g = g.withColumn("_gap", F.date_diff("period_end", F.lag("period_end").over(Window.partitionBy(*sheet).orderBy("period_end"))))
    g = g.groupBy(*sheet).agg(F.sort_array(F.collect_list("_gap")).alias("_g"), F.every(F.dayofmonth("period_end") == 1).alias("_starts"))
    middle = F.get("_g", F.floor(F.size("_g") / 2).cast("int"))
    g = g.select(*sheet, "_starts", F.coalesce(F.greatest(F.lit(1), F.round(middle / 30.44).cast("int")), F.lit(12)).alias("_len"))
    d = s.where("value is not null").join(g, sheet)
    t, v = F.col("period_end"), F.col("value")
    end = F.when(F.col("_starts"), F.date_sub(F.add_months(t, F.col("_len")), 1)).otherwise(t)
    start = F.when(F.col("_starts"), t).otherwise(F.date_add(F.add_months(t, -F.col("_len")), 1))
    near = lambda x: F.abs(serial(x) - v) < 0.5
    flag = lambda c: v == F.when(c, 1.0).otherwise(0.0)
    offset = v - F.year(end)
    holds = [near(t), near(end), near(start), F.abs(offset) <= 1, flag(end > date), flag(end <= date)]
    bits = sum((F.when(F.coalesce(h, F.lit(False)), 1 << i).otherwise(0) for i, h in enumerate(holds)), F.lit(0))
    d = d.withColumns({"_bits": bits, "_off": offset})
    g = d.groupBy(*by).agg(F.count("*").alias("_n"), F.bit_and("_bits").alias("_bits"), F.min("_off").alias("_lo"), F.max("_off").alias("_hi"), F.min("value").alias("_v0"), F.max("value").alias("_v1"), F.array_sort(F.collect_list(F.struct("period_end", "value"))).alias("_p"))
    on = lambda i: F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0
    year = on(3) & (F.col("_lo") == F.col("_hi"))
    known = [on(0), on(1), on(2), year, on(4), on(5), F.col("_v0") == F.col("_v1")]
    rule = F.coalesce(*[F.when(c, F.lit(n)) for c, n in zip(known, TIMING)])
    g = g.withColumn("_rule", F.when(F.col("_n") >= 2, rule)).withColumn("_own", F.when((F.col("_n") >= 2) & F.col("_rule").isNull(), _own_rule(F.transform("_p", lambda x: x["value"]))))
    return g.select(*by, F.coalesce("_rule", F.col("_own.rule")).alias("rule"), F.when(F.col("_rule") == "year", F.col("_lo").cast("int")).alias("offset"), F.col("_own.months").alias("months"))


def rolled(prior: DataFrame, current: DataFrame, matches: DataFrame, months: int) -> DataFrame:
    """Each prior cell with this year's value ``months`` on in the matched row.

    Beyond this year's forecast 0; where it is missing, this year's figure of the same period stands in; ``how`` says so.
    """
    row = ["workbook_id", "sheet", "row_no"]
    c = current.select("workbook_id", F.col("sheet").alias("cur_sheet"), F.col("row_no").alias("cur_row"), "period_end", F.col("value").alias("_v"))
    last = c.groupBy("workbook_id", "cur_sheet", "cur_row").agg(F.max("period_end").alias("_last"))
    d = prior.join(matches, row, "left").withColumn("to_end", F.when(F.col("period_end") == F.last_day("period_end"), F.last_day(F.add_months("period_end", months))).otherwise(F.add_months("period_end", months)))
    at = ["workbook_id", "cur_sheet", "cur_row"]
    d = d.join(c.withColumnRenamed("period_end", "to_end"), [*at, "to_end"], "left").join(last, at, "left")
    d = d.join(c.select(*at, "period_end", F.col("_v").alias("_same")), [*at, "period_end"], "left")
    how = F.when(F.col("cur_row").isNull(), "no match").when(F.col("_v").isNotNull(), "rolled").when(F.col("to_end") > F.col("_last"), "beyond").when(F.col("_same").isNotNull(), "stand-in").otherwise("missing")
    value = F.when(how == "rolled", F.col("_v")).when(how == "beyond", F.lit(0.0)).when(how == "stand-in", F.col("_same"))
    return d.select(*row, "period_end", "to_end", how.alias("how"), value.alias("rolled"))


def find(rows: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Rows whose label or section holds the text, case and spacing aside: the first ``limit`` of each workbook, in order of place."""
    from fleetroll.functions.text import squash

    t = text.lower()
    s = squash(F.lit(text))
    hit = lambda c: F.lower(c).contains(t) | squash(F.col(c)).contains(s)
    found = rows.where(F.coalesce(hit("label"), F.lit(False)) | F.coalesce(hit("section"), F.lit(False)))
    w = Window.partitionBy("workbook_id").orderBy("sheet", "row_no")
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def ranked(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """For each query its rows by the number of its words (three letters at least, six at most) that the label has."""
    q = queries.withColumn("w", F.explode(F.slice(F.filter(F.array_distinct(F.split(F.lower("query"), r"\W+")), lambda x: F.length(x) >= 3), 1, 6)))
    r = rows.withColumn("w", F.explode(F.array_distinct(F.split(F.lower("label"), r"\W+"))))
    hits = q.join(r, "w").groupBy("query", "sheet", "row_no").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("query").orderBy(F.col("hits").desc(), "sheet", "row_no")
    return hits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def tag_terms(texts: DataFrame, terms: dict[str, str], by: str, place: str) -> DataFrame:
    """Which terms occur in a group of texts, with the first place of each."""
    flags = F.array(*[F.when(F.col("text").rlike(p), F.lit(t)) for t, p in terms.items()])
    d = texts.select(by, place, F.explode(F.array_compact(flags)).alias("term"))
    return d.groupBy(by, "term").agg(F.min(place).alias("first_place"), F.count("*").alias("times"))


#: What a figure may be multiplied by, by the words of its unit; the first that fits.
UNIT_SCALES: list[tuple[str, list[float]]] = [
    (r"%", [0.01, 1.0]),
    (r"bn|billion", [1.0, 1e3, 1e6, 1e9]),
    (r"(^|[^a-z])m$|million|\$m|mn", [1.0, 1e3, 1e6]),
    (r"'000|000s|\bk\b|thousand", [1.0, 1e3]),
]


def scales_of(unit: Column) -> Column:
    """The scales of a unit, as an array; 1 alone where its words say nothing."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    arrays = [(p, F.array(*[F.lit(x) for x in xs])) for p, xs in UNIT_SCALES]
    out = F.when(u.rlike(arrays[0][0]), arrays[0][1])
    for p, xs in arrays[1:]:
        out = out.when(u.rlike(p), xs)
    return out.otherwise(F.array(F.lit(1.0)))


def facts_to_cells(facts: DataFrame, cells: DataFrame, k: int = 5) -> DataFrame:
    """Report figures and the cells of their engagement that could hold them: the best ``k``, and how many there are.

    ``facts(engagement_id, fact_id, label, unit, category, value_text, low_text, high_text)`` are as printed;
    ``cells(engagement_id, cell_id, label, value, is_formula, is_anchor)``.  A cell fits a part of a fact (its value,
    low or high) if it lies within half a unit of the last printed digit at one of the unit's scales, of either sign.
    Score: 3 times the share of the fact's words that the cell's label has, 1.5 for an anchor, half for a formula where
    the fact is a result (or a typed cell where it isn't), half for the same sign, .3 for the value itself.  Intervals
    and cells meet in logarithmic buckets of a hundredth, wide intervals in 32 or 4,096 of these as one.
    """
    from .match import tokens

    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_text").alias("text")) for p in ("value", "low", "high")])
    f = facts.withColumn("p", F.explode(parts)).withColumn("digits", F.regexp_extract(F.coalesce("p.text", F.lit("")), r"\d[\d,]*(?:\.\d+)?", 0)).where("digits <> ''")
    x, decimals = F.replace("digits", F.lit(","), F.lit("")).cast("double"), F.length(F.regexp_extract("digits", r"\.(\d+)", 1))
    scale = F.explode(scales_of(F.coalesce(F.nullif("unit", F.lit("")), F.col("p.text"))))
    f = f.select("engagement_id", "fact_id", F.col("p.part").alias("part"), tokens(F.col("label")).alias("want"), F.coalesce(F.col("category").isin("conclusion", "sensitivity"), F.lit(False)).alias("result"), x.alias("x"), (0.5 * F.pow(F.lit(10.0), -decimals)).alias("half"), scale.alias("scale"))
    f = f.withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumns({"lo": F.least(F.col("sign") * (F.col("x") - F.col("half")) * F.col("scale"), F.col("sign") * (F.col("x") + F.col("half")) * F.col("scale")), "hi": F.greatest(F.col("sign") * (F.col("x") - F.col("half")) * F.col("scale"), F.col("sign") * (F.col("x") + F.col("half")) * F.col("scale"))})
    bucket = lambda v: F.when(F.abs(v) < 1e-6, F.lit(-2000)).otherwise(F.floor(F.log(F.abs(v)) * 100)).cast("long")
    # an interval around 0 is that of a figure printed as 0: it meets all buckets up to its end
    near, far = F.when(F.col("lo") * F.col("hi") <= 0, 0.0).otherwise(F.least(F.abs("lo"), F.abs("hi"))), F.greatest(F.abs("lo"), F.abs("hi"))
    f = f.withColumns({"_near": bucket(near), "_far": bucket(far)})
    f = f.withColumn("wide", F.when(F.col("_far") - F.col("_near") < 8, 1).when(F.col("_far") - F.col("_near") < 1024, 32).otherwise(4096))
    f = f.withColumn("b", F.explode(F.sequence(F.floor(F.col("_near") / F.col("wide")), F.floor(F.col("_far") / F.col("wide"))))).drop("_near", "_far")
    c = cells.where("value <> 0").select("engagement_id", "cell_id", F.col("label").alias("cell_label"), "value", "is_formula", "is_anchor", F.explode(F.array(F.lit(1), F.lit(32), F.lit(4096))).alias("wide"))
    c = c.withColumn("b", F.floor(bucket(F.col("value")) / F.col("wide")))
    hit = c.join(f, ["engagement_id", "wide", "b"]).where("value between lo and hi")
    overlap = F.size(F.array_intersect("want", tokens(F.col("cell_label")))) / F.greatest(F.lit(1), F.size("want"))
    score = 3 * overlap + F.when(F.col("is_anchor"), 1.5).otherwise(0.0) + F.when(F.col("is_formula") == F.col("result"), 0.5).otherwise(0.0) + F.when(F.col("sign") == 1, 0.5).otherwise(0.0) + F.when(F.col("part") == "value", 0.3).otherwise(0.0)
    hit = hit.withColumn("located", (overlap > 0) | F.col("is_anchor")).withColumn("score", F.round(score, 2))
    by = ["engagement_id", "fact_id"]
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "cell_id", "part", "scale", F.col("sign").desc())
    d = hit.withColumn("n", F.count("*").over(Window.partitionBy(*by))).withColumn("place", F.row_number().over(w))
    return d.where(F.col("place") <= k).select(*by, "place", "cell_id", "part", "scale", "sign", "score", "located", "n")
