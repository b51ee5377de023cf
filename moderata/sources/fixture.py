"""Raw statement-of-reasons records derived from the ``lineitem`` table.

The study's own data is not public, so the named queries run on a
deterministic view over the driver's ``lineitem`` table that has the raw
record's shape (FIXTURES.md section 2): two platforms with two spellings of
one of them, both API versions, out-of-window and null dates, null and
unmapped categories, null and mixed visibility arrays, multi-country scopes
and exact duplicate rows. It grows linearly with ``lineitem``.

This is pure projection: one scan of ``lineitem`` (only the 7 columns the
rules read), every rule a codegen'd ``CASE`` stated as Spark SQL text; duplicates come from a
``Generate`` on the same scan instead of a second scan plus ``UNION ALL``.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S

LINEITEM_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_returnflag",
    "l_linestatus",
]

# First fixture day: 400 consecutive days from here straddle the 2025 window.
FIXTURE_EPOCH = _dt.date(2024, 12, 15)

# The free-text sentence whose two spellings differ by a period.
FACTS_SENTENCE = "The decision was taken pursuant to own-initiative investigations."


def _q(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def _cat(code: str) -> str:
    return _q(S.CATEGORY_PREFIX + code)


_CUT = f"DATE'{S.VERSION_CUTOFF.isoformat()}'"

# The rules as Spark SQL expressions over lineitem columns plus two helpers
# (_d: the record's day, _tt: TikTok or not). Stated once as text, parsed on
# the JVM side in one call instead of hundreds of Column round trips.
_HELPERS = [
    f"date_add(DATE'{FIXTURE_EPOCH.isoformat()}', CAST((l_orderkey * 7 + l_linenumber * 3) % 400 AS INT)) AS _d",
    "(l_suppkey % 5) <> 4 AS _tt",
]
_RULES = [
    "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING)) AS uuid",
    f"""CASE WHEN l_partkey % 499 = 498 THEN CAST(NULL AS STRING)
         WHEN l_partkey % 499 = 497 THEN {_cat('TEST_UNMAPPED')}
         WHEN l_partkey % 40 < 18 THEN {_cat('ILLEGAL_OR_HARMFUL_SPEECH')}
         WHEN l_partkey % 40 < 28 THEN CASE WHEN _d < {_CUT} THEN {_cat('SCOPE_OF_PLATFORM_SERVICE')} ELSE {_cat('OTHER_VIOLATION_TC')} END
         WHEN l_partkey % 40 = 28 THEN {_cat('OTHER_VIOLATION_TC')}
         WHEN l_partkey % 40 < 32 THEN CASE WHEN _tt THEN {_cat('NEGATIVE_EFFECTS_ON_CIVIC_DISCOURSE_OR_ELECTIONS')} ELSE {_cat('PROTECTION_OF_MINORS')} END
         WHEN l_partkey % 40 < 34 THEN {_cat('VIOLENCE')}
         WHEN l_partkey % 40 = 34 THEN {_cat('RISK_FOR_PUBLIC_SECURITY')}
         WHEN l_partkey % 40 = 35 THEN CASE WHEN _d < {_CUT} THEN {_cat('NON_CONSENSUAL_BEHAVIOUR')} ELSE {_cat('CYBER_VIOLENCE')} END
         WHEN l_partkey % 40 = 36 THEN {_cat('PORNOGRAPHY_OR_SEXUALIZED_CONTENT')}
         WHEN l_partkey % 40 = 37 THEN {_cat('CYBER_VIOLENCE')}
         ELSE CASE WHEN _d < {_CUT} THEN {_cat('UNSAFE_AND_ILLEGAL_PRODUCTS')} ELSE {_cat('UNSAFE_AND_PROHIBITED_PRODUCTS')} END
    END AS category""",
    """CASE WHEN NOT _tt THEN '["CONTENT_TYPE_SYNTHETIC_MEDIA"]'
         WHEN l_linenumber % 2 = 0 THEN '["CONTENT_TYPE_VIDEO"]'
         ELSE '["CONTENT_TYPE_TEXT"]' END AS content_type""",
    "CASE WHEN NOT _tt THEN 'No' WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'No' END AS automated_detection",
    """CASE WHEN NOT _tt AND l_partkey % 25 > 1 THEN 'AUTOMATED_DECISION_NOT_AUTOMATED'
         WHEN l_returnflag IN ('A', 'N') THEN 'AUTOMATED_DECISION_FULLY'
         WHEN l_linenumber < 3 THEN 'AUTOMATED_DECISION_PARTIALLY'
         ELSE 'AUTOMATED_DECISION_NOT_AUTOMATED' END AS automated_decision""",
    """CASE WHEN l_orderkey % 97 = 0 THEN CAST(NULL AS STRING)
         WHEN l_orderkey % 4 = 0 THEN '["DE"]'
         WHEN l_orderkey % 4 = 1 THEN '["AT","DE","FR"]'
         WHEN l_orderkey % 4 = 2 THEN '["FR"]'
         ELSE '["ES","NL"]' END AS territorial_scope""",
    "CASE WHEN l_orderkey % 1009 = 0 THEN CAST(NULL AS TIMESTAMP_NTZ) ELSE CAST(_d AS TIMESTAMP_NTZ) + make_dt_interval(0, IF(l_partkey % 11 = 3, 13, 0)) END AS application_date",
    "CASE WHEN _tt THEN 'TikTok' WHEN l_linenumber = 7 THEN 'X (formerly Twitter)' ELSE 'X' END AS platform_name",
    """CASE WHEN l_partkey % 23 = 0 THEN CAST(NULL AS STRING)
         WHEN l_partkey % 23 < 13 THEN '["DECISION_VISIBILITY_CONTENT_REMOVED"]'
         WHEN l_partkey % 23 < 21 THEN '["DECISION_VISIBILITY_OTHER"]'
         ELSE '["DECISION_VISIBILITY_CONTENT_DEMOTED","DECISION_VISIBILITY_OTHER"]' END AS decision_visibility""",
    """CASE WHEN l_linenumber = 5 THEN CAST(NULL AS TIMESTAMP_NTZ)
         WHEN l_linenumber % 3 = 0 THEN CAST(date_sub(_d, 1) AS TIMESTAMP_NTZ)
         ELSE CAST(_d AS TIMESTAMP_NTZ) END AS content_date""",
    f"CASE WHEN l_partkey % 101 = 7 THEN {_q(FACTS_SENTENCE + ' ')} WHEN l_linenumber % 4 <> 0 THEN {_q(FACTS_SENTENCE)} ELSE {_q(FACTS_SENTENCE[:-1])} END AS decision_facts",
    "CAST(NULL AS STRING) AS decision_monetary",
    "l_quantity AS score",
]


def sor_columns(li: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Map ``lineitem`` rows to raw SoR rows (one output row per input row), with the input's columns ``kept``."""
    return li.selectExpr(*LINEITEM_COLUMNS, *[c for c in kept if c not in LINEITEM_COLUMNS], *_HELPERS).selectExpr(*_RULES, *kept)


def with_duplicates(sor: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Emit a second, identical copy of rows whose uuid matches ``%-1-%7``; columns ``kept`` stay beside the raw record's."""
    cols = [*[f.name for f in S.RAW_SCHEMA.fields], *kept]
    copies = "explode(CASE WHEN uuid LIKE '%-1-%7' THEN array(1, 2) ELSE array(1) END) AS _copy"
    return sor.selectExpr(*cols, copies).select(*cols)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``lineitem`` that the rules read."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINEITEM_COLUMNS)


def sor_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw SoR records (13 columns, see ``schemas.RAW_SCHEMA``) from ``lineitem``."""
    return with_duplicates(sor_columns(lineitem(spark, sf_dir)))
