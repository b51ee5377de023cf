"""Preparation stages: raw -> working -> analysed (v1) datasets.

The study runs these as separate processes linked by files; here they are
one lazy plan per query, so Catalyst prunes to the columns a query needs and
pushes the scope, date and version predicates into the scan of a stored
table. Writing the working table (partitioned by platform and month) is the
job of ``moderata.sinks.write_working`` when a materialised copy is wanted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import columns as C
from ..functions import filters as P


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail with the list of missing names (the study's per-file check, per frame)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError("error_missing_columns:" + ",".join(missing))
    return df


def working_dataset(raw: DataFrame, normalize_platform: bool = False, as_written_dates: bool = False) -> DataFrame:
    """Raw records -> 10-column working records.

    9-column projection, territorial scope contains DE, version tag by the
    2025-07-01 cutoff, inclusive 2025 window on the application date.
    """
    require_columns(raw, S.KEEP_COLUMNS)
    window = P.date_between_as_written if as_written_dates else P.date_between
    out = (
        raw.select(*S.KEEP_COLUMNS)
        .filter(P.scope_contains("territorial_scope"))
        .withColumn("api_version", C.tag_period("application_date"))
        .filter(window("application_date"))
    )
    if normalize_platform:
        out = out.withColumn("platform_name", C.normalize_values("platform_name"))
    return out


def analysed_dataset(
    working: DataFrame,
    version: str | None = "v1",
    exclude: Sequence[str] = S.BLEED_INTENT,
    normalize_platform: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Working records -> one API version, exclusion list applied.

    ``strict``: a frame without ``api_version`` raises instead of silently
    skipping the version filter (the study's lenient behaviour is
    ``strict=False``). A null category is dropped by the exclusion, as in the
    study; pass ``exclude=()`` to keep it.
    """
    df = working
    if normalize_platform:
        df = df.withColumn("platform_name", C.normalize_values("platform_name"))
    if version is not None:
        if "api_version" in df.columns:
            df = df.filter(P.equals("api_version", version))
        elif strict:
            raise ValueError("error_missing_columns:api_version")
    if exclude:
        df = df.filter(P.not_in("category", exclude))
    return df


def v1_dataset(working: DataFrame, exclude: Sequence[str] = S.BLEED_INTENT, normalize_platform: bool = True) -> DataFrame:
    """The analysed dataset of the study: v1 records, boundary-bleed codes removed."""
    return analysed_dataset(working, "v1", exclude, normalize_platform)


def v1_unfiltered(working: DataFrame, normalize_platform: bool = True) -> DataFrame:
    """v1 records without the exclusion list (visibility and intensity analyses)."""
    return analysed_dataset(working, "v1", (), normalize_platform)


def funnel_steps() -> list[tuple[str, object]]:
    """(step name, cumulative predicate) pairs of the preparation funnel."""
    scope = P.scope_contains("territorial_scope")
    window = P.date_between("application_date")
    v1 = C.tag_period("application_date") == F.lit("v1")
    return [
        ("raw", F.lit(True)),
        ("scope_de", scope),
        ("date_2025", scope & window),
        ("v1", scope & window & v1),
    ]
