"""Null-safe scalar expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Quotient, null where the denominator is zero."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def clip(x: Column | str, lo, hi) -> Column:
    """Bound ``x``; a null stays null (``least`` alone would skip it)."""
    x = col(x)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def finite(x: Column | str) -> Column:
    """Null for NaN and infinities."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def rounded(x: Column | str, digits: int) -> Column:
    """``round(x, digits)`` of a double, value for value; only what lies near a tie, or is large, goes through decimal text."""
    x = col(x)
    scale = 10.0**digits
    shifted = x * F.lit(scale)
    whole = F.floor(shifted)
    clear = (F.abs(shifted) < 1e12) & (F.abs(shifted - whole - 0.5) > 1e-3)
    return F.when(clear, F.floor(shifted + 0.5) / F.lit(scale)).otherwise(F.round(x, digits))


def to_numeric(x: Column | str) -> Column:
    """Double, null where the text is not a number."""
    return finite(col(x).try_cast("double"))


def flag(cond: Column) -> Column:
    """1.0 / 0.0; an unknown comparison counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def row_mean(cols: Sequence[Column | str]) -> Column:
    """Mean over columns of one row, nulls skipped."""
    cols = [col(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return total / F.nullif(n.cast("double"), F.lit(0.0))


def is_blank(x: Column | str) -> Column:
    return col(x).isNull() | (F.trim(col(x).cast("string")) == "")


def yyyymmdd(x: Column | str) -> Column:
    """INT date from text, int or float text; null where it is no calendar date."""
    text = F.regexp_replace(F.trim(col(x).cast("string")), r"\.0$", "")
    number = F.when(text.rlike(r"^\d{8}$"), text).try_cast("int")
    valid = F.try_to_date(number.cast("string"), "yyyyMMdd")
    return F.when(valid.isNotNull(), number)


def _ymd(d: Column) -> tuple[Column, Column, Column]:
    return (d / 10000).cast("int"), (d / 100 % 100).cast("int"), (d % 100).cast("int")


def as_date(x: Column | str) -> Column:
    """DATE of a valid YYYYMMDD integer: plain arithmetic, no text is parsed."""
    return F.make_date(*_ymd(col(x)))


def as_int(d: Column) -> Column:
    """YYYYMMDD integer of a DATE."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column; the last step before results are compared.

    A nudge far below the last digit makes exact decimal ties round the same way
    whatever the order in which a sum was taken.
    """
    nudge = 0.371728349 * 10.0 ** -(digits + 2)
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(rounded(finite(f.name) + nudge, digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
