"""Text functions on columns: normal forms, figures, dates, ranges, masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names as read in reports.
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
FIGURE = r"\d[\d,]*(?:\.\d+)?%?"
NUMBER = rf"(\(?-?[$€£]?{FIGURE}\)?)"
WORD_DATE = rf"\d{{1,2}} (?:{MONTHS})[a-z]* \d{{4}}"
#: A reference of the R1C1 form: sheet, row part, column part (with a row, or alone).
_PART = r"(\[-?\d+\]|\d+)"
REFERENCE = rf"((?:'(?:[^']|'')+'|(?<![\w.])[A-Za-z_][\w.]*)!)?(?<![\w.])(?:(R){_PART}?(?:(C){_PART}?)?|(C){_PART})(?![\w(])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def letters(c: Column) -> Column:
    """Lower case, only letters, everything else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z]+", " "))


def bare_label(c: Column) -> Column:
    """Lower case without years and punctuation, white space folded: what a label is called in every version."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\b(?:19|20)\d\d\b", " "), r"[^a-z0-9]+", " "))


def squash(c: Column) -> Column:
    """Lower case without spaces and - _ . / & ( ) '."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s\-_./&()']+", "")


def squeezed(c: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(c), r"\s+", "")


def formula_shape(c: Column) -> Column:
    """A formula in R1C1 form without sheet names and distances: each reference as its shape, such as !R[]C# for Costs!R[-3]C7.

    One pass: what stands between references stays as it is, and each reference is put together from its parts.
    """
    t = F.coalesce(c, F.lit(""))

    def part(ref: Column, name: int, at: int) -> Column:
        where = F.regexp_extract(ref, REFERENCE, at)
        return F.concat(F.regexp_extract(ref, REFERENCE, name), F.when(where == "", "").when(where.startswith("["), "[]").otherwise("#"))

    def shape(ref: Column) -> Column:
        sheet = F.when(F.regexp_extract(ref, REFERENCE, 1) != "", "!").otherwise("")
        return F.concat(sheet, part(ref, 2, 3), part(ref, 4, 5), part(ref, 6, 7))

    between, refs = F.split(t, REFERENCE), F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), 0), shape)
    return F.array_join(F.zip_with(between, refs, lambda x, r: F.concat(x, F.coalesce(r, F.lit("")))), "")


def numbers(c: Column) -> Column:
    """All numbers of a text, in order: brackets or a dash negative, commas and currencies dropped, % kept as text."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), 1)

    def one(x: Column) -> Column:
        bare = F.regexp_replace(x, r"[(),$€£\-]", "")
        return F.concat(F.when(x.startswith("(") & x.endswith(")") | x.contains("-"), "-").otherwise(""), bare)

    return F.transform(found, one)


#: The four forms of a date in a report, each with the groups of its day, month and year.
DATES: list[tuple[str, tuple[int, int, int]]] = [
    (rf"\b(\d{{1,2}})(?:st|nd|rd|th)? ({MONTHS})[a-z]*,? (\d{{4}})\b", (1, 2, 3)),
    (rf"\b({MONTHS})[a-z]* (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b", (2, 1, 3)),
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", (3, 2, 1)),
    (r"\b(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\b", (1, 2, 3)),
]


def _month(c: Column) -> Column:
    named = (F.instr(F.lit(MONTHS), F.substring(c, 1, 3)) + 3) / 4
    return F.when(c.rlike(r"^\d+$"), c.cast("int")).otherwise(named.cast("int"))


def dates(c: Column) -> Column:
    """Valid dates of a text in its order, each once a place: d Mon yyyy, Mon d yyyy, yyyy-mm-dd, d/m/yy (day first)."""
    def placed(t: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
        def one(x: Column) -> Column:
            def made(p: Column) -> Column:
                year = F.when(F.length(p["y"]) == 2, F.concat(F.lit("20"), p["y"])).otherwise(p["y"])
                return F.try_to_date(F.concat_ws("-", year, F.lpad(_month(p["m"]).cast("string"), 2, "0"), F.lpad(p["d"], 2, "0")), "yyyy-MM-dd")

            return let(F.struct(*[F.regexp_extract(x, pattern, i).alias(n) for n, i in zip("dmy", groups)]), made)

        def ranged(found: Column) -> Column:
            # a match starts after the texts and matches before it
            between = F.slice(F.split(t, pattern), 1, F.size(found))
            step = F.zip_with(between, found, lambda b, x: F.struct(F.length(b).alias("gap"), F.length(x).alias("len"), one(x).alias("date")))
            return F.aggregate(step, F.struct(F.lit(0).alias("end"), none.alias("out")), lambda s, x: F.struct((s["end"] + x["gap"] + x["len"]).alias("end"), F.concat(s["out"], F.array(F.struct((s["end"] + x["gap"]).alias("at"), x["date"].alias("date")))).alias("out")))["out"]

        return let(F.regexp_extract_all(t, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, none).otherwise(ranged(found)))

    # what stands in a lambda is worked out anew wherever it is named: text, matches and their parts are each found once
    none = F.expr("cast(array() as array<struct<at:int,date:date>>)")
    every = let(F.lower(F.coalesce(c, F.lit(""))), lambda t: F.concat(*[placed(t, p, g) for p, g in DATES]))
    return F.transform(F.array_sort(F.array_distinct(F.filter(every, lambda x: x["date"].isNotNull()))), lambda x: x["date"])


#: Words of scale.
SCALES = {"k": 1e3, "'000": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "bn": 1e9, "billion": 1e9}


def range_of(c: Column) -> Column:
    """low and high of 'A to B' or 'A - B'."""
    r = r"(\d[\d,]*(?:\.\d+)?)\s*(?:to|–|-)\s*(\d[\d,]*(?:\.\d+)?)"
    end = lambda i: F.expr("double(null)") if c is None else F.replace(F.nullif(F.regexp_extract(c, r, i), F.lit("")), F.lit(",")).cast("double")
    return F.struct(end(1).alias("low"), end(2).alias("high"))


def mask(c: Column) -> Column:
    """Dates as [a date], other figures as #."""
    t = F.regexp_replace(c, rf"(?i)\b(?:{WORD_DATE}|\d{{4}}-\d{{2}}-\d{{2}})\b", "[a date]")
    return F.regexp_replace(t, FIGURE, "#")


def basis_counts(c: Column) -> Column:
    """How often a text speaks of ex and of cum."""
    return F.struct(F.regexp_count(F.lower(c), F.lit(r"\bex[- ]")).alias("ex"), F.regexp_count(F.lower(c), F.lit(r"\bcum[- ]")).alias("cum"))


def ties(value: Column, printed: Column) -> Column:
    """Within half a unit of the last printed digit."""
    bare = F.replace(printed, F.lit(","))
    digits = F.length(F.regexp_extract(bare, r"\.(\d+)", 1))
    return F.abs(value - bare.cast("double")) <= 0.5 * F.pow(F.lit(10.0), -digits) + 1e-9
