"""Column -> Column helpers for derived columns (projections P1-P17).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tag_period(col: str | Column, cutoffs: Sequence[_dt.date] = (S.VERSION_CUTOFF,), labels: Sequence[str] = S.VERSION_LABELS) -> Column:
    """Label a timestamp/date by the interval its calendar day falls in.

    ``labels[i]`` is used for days before ``cutoffs[i]``; the last label for
    everything else, including null dates (the study's rule: a null date falls
    to the ``otherwise`` branch).
    """
    if len(labels) != len(cutoffs) + 1:
        raise ValueError("need exactly one more label than cutoffs")
    day = F.to_date(_c(col))
    expr = None
    for cut, label in zip(cutoffs, labels[:-1]):
        cond = day < F.lit(cut)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def agreement(a: str | Column, b: str | Column) -> Column:
    """Three-way status of ``a`` against reference ``b``: null / equal / different."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull(), F.lit("null")).when(a == b, F.lit("equal")).otherwise(F.lit("different"))


def contains_class(col: str | Column, needle: str, hit: str, miss: str) -> Column:
    """``hit`` when the text contains ``needle`` (mixed arrays count as hit), else ``miss``."""
    return F.when(_c(col).contains(needle), F.lit(hit)).otherwise(F.lit(miss))


def month_text(col: str | Column) -> Column:
    """Month key ``YYYY-MM`` as text, for output and joins (filter on dates, not on this)."""
    return F.date_format(_c(col), "yyyy-MM")


def month_start(col: str | Column) -> Column:
    """Month key as the first day of the month (a date)."""
    return F.trunc(F.to_date(_c(col)), "month")


def normalize_values(col: str | Column, aliases: Mapping[str, str] = S.PLATFORM_ALIASES) -> Column:
    """Replace alias spellings by their canonical value; others pass through."""
    c = _c(col)
    expr = None
    for raw, canon in aliases.items():
        expr = F.when(c == F.lit(raw), F.lit(canon)) if expr is None else expr.when(c == F.lit(raw), F.lit(canon))
    return c if expr is None else expr.otherwise(c)


def strip_trailing_period(col: str | Column) -> Column:
    """Trailing-whitespace and trailing-period normalisation of free text."""
    return F.regexp_replace(F.rtrim(_c(col)), r"\.$", "")


def at_length_limit(col: str | Column, limit: int) -> Column:
    """True where the text length reached a storage ceiling (truncation flag)."""
    return F.length(_c(col)) >= F.lit(limit)


def share_pct(part: str | Column, total: str | Column) -> Column:
    """``part / total * 100`` as double; 0 when the total is 0 (never raises under ANSI)."""
    p, t = _c(part), _c(total)
    return F.when(t > 0, p / t * 100).otherwise(F.lit(0.0))


def per_million(count: str | Column, base: str | Column, digits: int = 2) -> Column:
    """``count / base * 1e6`` rounded half-up; null when the base is 0 or null."""
    c, b = _c(count), _c(base)
    return F.round(F.when(b != 0, c / b * 1_000_000), digits)


def pct_change(a: str | Column, b: str | Column, digits: int | None = 2) -> Column:
    """``(b - a) / a * 100``; null when ``a`` is 0; optionally rounded half-up."""
    a, b = _c(a), _c(b)
    v = F.when(a != 0, (b - a) / a * 100)
    return v if digits is None else F.round(v, digits)


def signed_pct_text(col: str | Column, digits: int = 2) -> Column:
    """Display form ``+1.23%`` of a percentage."""
    return F.format_string(f"%+.{digits}f%%", _c(col))


def json_array(col: str | Column) -> Column:
    """Parse JSON-array text (``["DE","FR"]``) into ``array<string>``; bad text -> null."""
    return F.from_json(_c(col), "array<string>")


def array_arity(col: str | Column) -> Column:
    """Number of elements of a JSON-array text column (null stays null)."""
    return F.size(json_array(col))


def midnight(col: str | Column) -> Column:
    """True where the timestamp has no time-of-day part."""
    c = _c(col)
    return c == F.date_trunc("day", c)
