"""Spreadsheet scalars whose rules differ from SQL's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def xround(x: Column, n: int = 0) -> Column:
    """Half away from zero."""
    return F.round(x, n)


def mod(x: Column, y: Column) -> Column:
    """The sign of the divisor; null for a divisor of 0."""
    return F.when(y != 0, x - y * F.floor(x / y))


def mround(x: Column, m: Column) -> Column:
    """The nearest multiple; null if the signs differ."""
    return F.when(m == 0, F.lit(0.0)).when(F.signum(x) * F.signum(m) >= 0, F.round(x / m, 0) * m)


def quotient(x: Column, y: Column) -> Column:
    return F.when(y != 0, F.when(x / y >= 0, F.floor(x / y)).otherwise(F.ceil(x / y)))


def search(what: Column, within: Column) -> Column:
    """Place of a text, case aside; null if absent."""
    return F.nullif(F.instr(F.lower(within), F.lower(what)), F.lit(0))


def textjoin(sep: str, *cols: Column) -> Column:
    """Non-empty texts only."""
    return F.concat_ws(sep, *[F.nullif(c, F.lit("")) for c in cols])


def choose(k: Column, *options: Column) -> Column:
    """The k-th option; null outside."""
    return F.try_element_at(F.array(*options), F.when((k >= 1) & (k <= len(options)), F.floor(k).cast("int")))


def text_fixed(x: Column, decimals: int, thousands: bool = False) -> Column:
    """A number as text with fixed decimals, half up."""
    s = F.format_number(F.round(x, decimals), decimals)
    return s if thousands else F.replace(s, F.lit(","), F.lit(""))


def pmt(rate: Column, nper: Column, pv: Column, fv: Column | float = 0.0, when: int = 0) -> Column:
    fv = F.lit(fv) if isinstance(fv, (int, float)) else fv
    g = F.pow(1 + rate, nper)
    return F.when(nper == 0, None).when(rate == 0, -(pv + fv) / nper).otherwise(-(rate * (pv * g + fv)) / ((1 + rate * when) * (g - 1)))


def annuity_pv(rate: Column, nper: Column, payment: Column, fv: Column | float = 0.0, when: int = 0) -> Column:
    fv = F.lit(fv) if isinstance(fv, (int, float)) else fv
    g = F.pow(1 + rate, nper)
    return F.when(rate == 0, -(fv + payment * nper)).otherwise(-(fv + payment * (1 + rate * when) * (g - 1) / rate) / g)


def annuity_fv(rate: Column, nper: Column, payment: Column, pv: Column | float = 0.0, when: int = 0) -> Column:
    pv = F.lit(pv) if isinstance(pv, (int, float)) else pv
    g = F.pow(1 + rate, nper)
    return F.when(rate == 0, -(pv + payment * nper)).otherwise(-(pv * g + payment * (1 + rate * when) * (g - 1) / rate))
