"""Blank-aware scalar helpers: one place for what NULL, NaN, '' and rounding mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if_nan(c: Column) -> Column:
    """NaN becomes NULL; for float columns only, so that others keep their pushed filters."""
    return F.when(~F.isnan(c), c)


def blank_text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def finite(c: Column) -> Column:
    """NULL for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Halves go towards positive infinity: -2.5 gives -2."""
    f = float(10**digits)
    return F.floor(c * f + 0.5).cast("double") / f


def truncate(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def floored_mod(x: Column, y: Column) -> Column:
    """Sign of the divisor; NULL for a zero divisor."""
    return F.when(y != 0, x - y * F.floor(F.try_divide(x, y)))


def lower_edge(x: Column, width: Column, origin: Column) -> Column:
    return F.when(width > 0, F.floor(F.try_divide(x - origin, width)) * width + origin)


def number(c: Column) -> Column:
    """Text read as a finite number, or NULL."""
    return finite(F.trim(c).try_cast("double"))


def comma_number(c: Column) -> Column:
    """1.234,56 read as 1234.56."""
    return finite(F.regexp_replace(F.regexp_replace(F.trim(c), r"\.", ""), ",", ".").try_cast("double"))


#: Tokens that mean "no value" in two kinds of file, kept apart on purpose.
TABLE_NULLS = ("", "na", "n/a", "nan", "null", "none", "-", "nd")
STREAM_NULLS = ("", "*", "NA", "N/A", "#N/A", "NaN", "nan", "null", "NULL", "VOID", "-99", "-999", "-9999", "-99999")


def null_tokens(c: Column, tokens: tuple[str, ...] = TABLE_NULLS, ignore_case: bool = True) -> Column:
    key = F.lower(F.trim(c)) if ignore_case else F.trim(c)
    return F.when(~key.isin(*tokens), F.trim(c))


#: Length, mass, area, volume, grade, density and angle units, each in its base unit (fixed values).
UNITS: dict[str, dict[str, float]] = {
    "length": {"m": 1.0, "cm": 0.01, "mm": 0.001, "km": 1000.0, "ft": 0.3048, "in": 0.0254, "yd": 0.9144, "mi": 1609.344},
    "mass": {"kg": 1.0, "g": 0.001, "mg": 1e-6, "t": 1000.0, "lb": 0.45359237, "oz": 0.028349523125, "ozt": 0.0311034768},
    "area": {"m2": 1.0, "ha": 10000.0, "km2": 1e6, "ft2": 0.09290304, "acre": 4046.8564224},
    "volume": {"m3": 1.0, "l": 0.001, "ft3": 0.028316846592, "yd3": 0.764554857984},
    "grade": {"fraction": 1.0, "%": 0.01, "g/t": 1e-6, "ppm": 1e-6, "ppb": 1e-9, "kg/t": 1e-3, "oz/t": 31.1034768e-6},
    "density": {"t/m3": 1.0, "g/cm3": 1.0, "kg/m3": 0.001, "lb/ft3": 0.01601846337396},
    "angle": {"deg": 0.017453292519943295, "rad": 1.0, "grad": 0.015707963267948967},
}


def convert(c: Column, from_unit: str, to_unit: str) -> Column:
    for units in UNITS.values():
        if from_unit in units and to_unit in units:
            return c * F.lit(units[from_unit] / units[to_unit])
    raise ValueError(f"{from_unit} and {to_unit} do not measure the same")


def remap(c: Column, a: float, b: float, x: float, y: float) -> Column:
    """Linear rescale of [a, b] onto [x, y]."""
    return F.lit(x) + (c - F.lit(a)) * F.lit((y - x) / (b - a))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def text_join(*columns: Column) -> Column:
    """Joined text of what is there; NULL if nothing is."""
    return blank_text(F.concat_ws("", *columns))


def date_serial(d: Column) -> Column:
    """Spreadsheet day number, with the 29th of February 1900 that never was."""
    days = F.datediff(d, F.lit("1899-12-31").cast("date"))
    return F.when(days >= 60, days + 1).otherwise(days)


def date_from_serial(n: Column) -> Column:
    return F.date_add(F.lit("1899-12-31").cast("date"), F.when(n > 60, n - 1).otherwise(n).cast("int"))


QUALIFIED = r"^\s*([<>])\s*([0-9.]+)\s*$"


def qualified(c: Column, policy: str = "half") -> Column:
    """``<0.01`` by policy (half, limit, zero, blank), ``>10`` as its limit, BDL and other text as NULL."""
    sign, limit = F.regexp_extract(c, QUALIFIED, 1), F.regexp_extract(c, QUALIFIED, 2).try_cast("double")
    below = {"half": limit / 2, "limit": limit, "zero": F.lit(0.0), "blank": F.lit(None).cast("double")}[policy]
    return F.when(sign == "<", below).when(sign == ">", limit).otherwise(number(c))


def qualified_kind(c: Column) -> Column:
    sign = F.regexp_extract(c, QUALIFIED, 1)
    return (
        F.when(blank_text(F.trim(c)).isNull(), "blank").when(sign == "<", "below").when(sign == ">", "above").when(F.upper(F.trim(c)).isin("BDL", "ND", "TR"), "below").when(number(c).isNotNull(), "number").otherwise("text")
    )
