"""Numbers and texts as the rule language sees them: one reading in Python, one as Columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a number may look like as a text: blanks first, sign, decimal or hexadecimal, inf or nan.
NUMBER = re.compile(r"[ \t\n\v\f\r]*([+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN]))")
SMALLEST, LARGEST = 2.2250738585072014e-308, 1.7976931348623157e308


def to_number(text: str) -> float | None:
    """The number a whole text spells, or None. Values out of range don't count."""
    if not 1 <= len(text.encode()) <= 127 or (m := NUMBER.fullmatch(text)) is None:
        return None
    word = m[1].lower()
    try:
        x = float.fromhex(word) if "0x" in word else float(word)
    except (ValueError, OverflowError):
        return None
    if math.isinf(x) and "inf" not in word:
        return None
    mantissa = re.split("[ep]" if "0x" not in word else "p", word)[0]
    if abs(x) < SMALLEST and re.search("[1-9a-f]" if "0x" in word else "[1-9]", mantissa.replace("0x", "")):
        return None
    return x


def number_text(x: float) -> str:
    """The shortest of 15 to 17 digits that reads back as the same number."""
    if math.isnan(x):
        return "nan" if math.copysign(1, x) > 0 else "-nan"
    if math.isinf(x):
        return "inf" if x > 0 else "-inf"
    for digits in (15, 16, 17):
        text = f"{x:.{digits}g}"
        if float(text) == x:
            break
    return text


def fixed_text(x: float, places: int) -> str:
    return f"{x:.{places}f}" if math.isfinite(x) else number_text(x)


# ---------------------------------------------------------------- as Columns


BLANKS = r"^[ \t\n\x0B\f\r]*"


def spelled(text: Column) -> Column:
    """The double that a text spells, out of range or not; hexadecimal ones get the power that the cast wants."""
    number = BLANKS + r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)(?:[pP][+-]?[0-9]+)?|(?i:inf|infinity|nan))\z"
    powered = F.when(text.contains("x") | text.contains("X"), F.regexp_replace(text, r"^([^xX]*[xX][^pP]*)\z", "$1p0")).otherwise(text)
    return F.when(text.rlike(number) & (F.octet_length(text) <= 127), powered).try_cast("double")


def number_of(text: Column, x: Column | None = None) -> Column:
    """``to_number`` in built-in functions; null if there is none. ``x``: a column with ``spelled(text)``,
    which keeps generated code small."""
    x = spelled(text) if x is None else x
    as_it_is = BLANKS + r"[+-]?(?:[0.]+(?:[eE][+-]?[0-9]+)?|0[xX][0.]+(?:[pP][+-]?[0-9]+)?|(?i:inf|infinity))\z"
    signed_nan = text.rlike(BLANKS + r"[+-](?i:nan)\z") & (F.octet_length(text) <= 127)
    return F.when(F.abs(x).between(SMALLEST, LARGEST) | F.isnan(x) | text.rlike(as_it_is), x).when(signed_nan, F.lit(float("nan")))


def divide(a: Column, b: Column) -> Column:
    """IEEE division, which SQL turns into an error or a null."""
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def half_away(x: Column) -> Column:
    """Rounds to a whole number, halves away from zero, on the binary value."""
    return F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(F.signum(x) * F.floor(F.abs(x) + 0.5).cast("double"))


@F.pandas_udf(T.StringType())
def text_of_number(x, places):
    """Sink formatting: fixed places where given, else the shortest spelling."""
    import pandas as pd

    return pd.Series([None if v is None or (v != v and pd.isna(p) and v is None) else number_text(float(v)) if pd.isna(p) else fixed_text(float(v), int(p)) for v, p in zip(x, places, strict=True)], dtype=object)
