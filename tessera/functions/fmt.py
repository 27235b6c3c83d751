"""Number rendering as column expressions.

``format_number(x, 2)`` renders like Python's ``,.2f`` and the pattern
form ``format_number(x, '0.00')`` like ``.2f``: both round half-even on the
binary value.  A NULL (pandas NaN, e.g. the sample std of one row) renders
as ``nan`` the way Python prints it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nan(c: Column, rendered: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(rendered)


def money(c) -> Column:
    """``{x:,.2f}``"""
    c = F.col(c) if isinstance(c, str) else c
    return _nan(c, F.format_number(c, 2))


def fixed(c, digits: int = 2) -> Column:
    """``{x:.Nf}`` without thousands separators."""
    c = F.col(c) if isinstance(c, str) else c
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return _nan(c, F.call_function("format_number", c, F.lit(pattern)))


def integer(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint").cast("string")
