"""Figures of a text, read off its tokens: value, per cent, scale, currency and sign, and where they stand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetroll.functions.text import DATES, SCALES, let

_DIGITS = r"\d[\d,]*(?:\.\d+)?"
_MONEY = r"[A-Z]{0,3}[$]|[€£]"
#: What a text falls into, nothing left out: dates, currencies, numbers, thousands, words, blanks, single signs.
TOKEN = "|".join(["(?i:" + p + ")" for p, _ in DATES] + [_MONEY, r"'000\b", _DIGITS, r"\p{L}+", r"\s+", r"(?s:.)"])


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), 0)


def _kinds(t: Column) -> Column:
    """One sign for each token: n number, c currency, % and brackets as they are, - dashes, s scale, blank, w all else."""
    def kind(x: Column) -> Column:
        first = F.substring(x, 1, 1)
        return (
            F.when(x.isin("%", "(", ")", " "), x)
            .when(x.isin("-", "–", "—"), "-")
            .when(F.lower(x).isin(*SCALES), "s")
            .when(first.between("0", "9") & x.rlike(f"^(?:{_DIGITS})$"), "n")
            .when(F.endswith(x, F.lit("$")) | x.isin("€", "£"), "c")
            .otherwise("w")
        )

    return F.array_join(F.transform(t, kind), "")


def placed_figures(t: Column) -> Column:
    """The figures of tokens ``t``: array of (value, scale, cur, pct, neg, at, to, digits), ``at`` and ``to`` their first token and the one after.

    A date is no figure, and a per cent has no scale.  Brackets around a figure and a dash before it make it negative, but
    a dash after another figure is a range.  Neighbours are looked up in the string of the tokens' kinds.
    """

    def read(t: Column, k: Column) -> Column:
        # token i is sign i + 4 of k, counted from 0
        sign = lambda i, n=1: F.substr(k, i + 5, F.lit(n))

        def spans(i: Column) -> Column:
            before, after = sign(i - 2, 2), sign(i + 1, 2)
            cur = F.when(F.endswith(before, F.lit("c")), i - 1).when(before == "c ", i - 2)
            unit = F.when(after.rlike("^[%s]"), i + 1).when(after.isin(" %", " s"), i + 2)
            return F.struct(i.alias("i"), cur.alias("cur"), unit.alias("unit"), F.coalesce(cur, i).alias("at"), (F.coalesce(unit, i) + 1).alias("to"))

        def figure(f: Column) -> Column:
            before = sign(f["at"] - 2, 2)
            dash = F.when(F.endswith(before, F.lit("-")), f["at"] - 1).when(before == "- ", f["at"] - 2)
            minus = dash.isNotNull() & ~sign(dash - 4, 4).rlike("n(?: ?[%s])? ?$")
            brackets = (sign(f["at"] - 1) == "(") & (sign(f["to"]) == ")")
            pct = F.coalesce(sign(f["unit"]) == "%", F.lit(False))
            digits = F.get(t, f["i"])
            return F.struct(
                F.replace(digits, F.lit(","), F.lit("")).cast("double").alias("value"), F.when(~pct, F.lower(F.get(t, f["unit"]))).alias("scale"), F.upper(F.get(t, f["cur"])).alias("cur"),
                pct.alias("pct"), (brackets | minus).alias("neg"), f["at"].alias("at"), f["to"].alias("to"), digits.alias("digits"),
            )

        numbers = F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: sign(i) == "n")
        return F.transform(F.transform(numbers, spans), figure)

    return let(F.struct(t.alias("t"), F.concat(F.lit("wwww"), _kinds(t), F.lit("www")).alias("k")), lambda s: read(s["t"], s["k"]))


def figures(c: Column) -> Column:
    """The figures of a text in order, as ``placed_figures`` gives them."""
    return let(tokens(c), placed_figures)


def equal(a: Column, b: Column) -> Column:
    return F.abs(a - b) < 1e-9 * F.greatest(F.lit(1.0), F.abs(b))


def same_figure(a: Column, b: Column, percent: Column) -> Column:
    """Whether two figures have one value; where the fact may be printed as a per cent or a fraction, 80 % is 0.80."""
    return equal(a["value"], b["value"]) | (percent & (equal(a["value"] * 100, b["value"]) | equal(a["value"], b["value"] * 100)))


def scale_off(stated: Column, quoted: Column) -> Column:
    """What the first differing figure of ``stated`` is otherwise in ``quoted``: 'scale' or 'currency'; null where all fit. Both are ``figures``.

    A figure fits if one of equal value in the quote doesn't clash with it: scales clash if both are named and differ,
    currencies likewise, a bare $ being the report's own.  Figures that the quote doesn't hold say nothing.
    """
    factor = F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv])
    foreign = lambda f: F.when(f["cur"] != "$", f["cur"])
    clash = lambda x, y: F.coalesce((x != y).cast("int"), F.lit(0))

    def least_clash(x: Column, y: Column, so_far: Column) -> Column:
        scale, cur = clash(factor[x["scale"]], factor[y["scale"]]), clash(foreign(x), foreign(y))
        return F.when(equal(y["value"], x["value"]), F.struct(F.least(so_far["scale"], scale).alias("scale"), F.least(so_far["cur"], cur).alias("cur"))).otherwise(so_far)

    none = F.struct(F.lit(9).alias("scale"), F.lit(9).alias("cur"))
    least = F.transform(stated, lambda x: F.aggregate(quoted, none, lambda s, y: least_clash(x, y, s)))
    what = F.transform(least, lambda s: F.when(s["scale"] == 1, "scale").when(s["cur"] == 1, "currency"))
    return F.get(F.array_compact(what), F.lit(0))
