"""Predicates as Column factories.

Each is written so Catalyst can push it into the Parquet scan when it
applies to a stored column: ``contains`` becomes ``StringContains``, date
windows become timestamp ranges, exclusions become ``Not(In)``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scope_contains(col: str | Column, code: str = S.SCOPE_COUNTRY) -> Column:
    """Territorial scope text contains a country code (null scope is dropped)."""
    return _c(col).contains(code)


def scope_has_country(col: str | Column, code: str = S.SCOPE_COUNTRY) -> Column:
    """Exact element test on the parsed JSON array (stricter alternative to F1)."""
    return F.array_contains(F.from_json(_c(col), "array<string>"), code)


def date_between(col: str | Column, lo: _dt.date = S.PERIOD_START, hi: _dt.date = S.PERIOD_END) -> Column:
    """Inclusive calendar-day window as a half-open range on the stored value.

    ``lo <= day(col) <= hi`` written as ``col >= lo AND col < hi + 1 day`` so it
    pushes to Parquet as two range filters on the raw timestamp.
    """
    c = _c(col)
    return (c >= F.lit(lo)) & (c < F.lit(hi + _dt.timedelta(days=1)))


def date_between_as_written(col: str | Column, lo: _dt.date = S.PERIOD_START, hi: _dt.date = S.PERIOD_END) -> Column:
    """The study's literal form: timestamp compared with date bounds (a time
    after midnight on the last day is out)."""
    return _c(col).between(F.lit(lo), F.lit(hi))


def month_range(col: str | Column, first_month: str, last_month: str) -> Column:
    """Rows whose date falls in the months ``first_month``..``last_month`` (``YYYY-MM``)."""
    y0, m0 = map(int, first_month.split("-"))
    y1, m1 = map(int, last_month.split("-"))
    lo = _dt.date(y0, m0, 1)
    hi = _dt.date(y1 + (m1 == 12), m1 % 12 + 1, 1)
    c = _c(col)
    return (c >= F.lit(lo)) & (c < F.lit(hi))


def equals(col: str | Column, value) -> Column:
    return _c(col) == F.lit(value)


def not_in(col: str | Column, values: Sequence[str]) -> Column:
    """Exclusion list; a null value is dropped too (``NOT IN`` on null is null)."""
    if not values:
        return F.lit(True)
    return ~_c(col).isin(list(values))


def open_range(col: str | Column, lo: float, hi: float) -> Column:
    """``lo < col < hi`` (both ends open)."""
    c = _c(col)
    return (c > F.lit(lo)) & (c < F.lit(hi))
