"""DuckDB oracle text for every named query that SQL can express.

Each entry is one self-contained SQL statement over the pre-registered
table views (``lineitem`` ...). The common prefix rebuilds the raw records
from ``lineitem`` with the same rules as ``sources.fixture`` and the working
and analysed stages with the same predicates as ``plans.prep``; the tail is
the query. Column names and types are aligned with the Spark side.
"""

from __future__ import annotations

from .. import schemas as S
from ..sources.fixture import FACTS_SENTENCE, FIXTURE_EPOCH
from ..sources.staging import SALTS

_P = S.CATEGORY_PREFIX


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cat(code: str) -> str:
    return _q(_P + code)


_CUT = f"DATE '{S.VERSION_CUTOFF.isoformat()}'"
_LO = f"DATE '{S.PERIOD_START.isoformat()}'"
_HI = f"DATE '{S.PERIOD_END.isoformat()}'"
_NORM = "CASE " + " ".join(f"WHEN platform_name = {_q(a)} THEN {_q(b)}" for a, b in S.PLATFORM_ALIASES.items()) + " ELSE platform_name END"
_BLEED = ", ".join(_q(c) for c in S.BLEED_INTENT)
_BLEED_AS_WRITTEN = ", ".join(_q(c) for c in S.BLEED_AS_WRITTEN)
_KEEP = ", ".join(S.KEEP_COLUMNS)

BASE = f"""
WITH li AS (
  SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, l_quantity,
         l_returnflag, l_linestatus,
         DATE '{FIXTURE_EPOCH.isoformat()}' + CAST((l_orderkey * 7 + l_linenumber * 3) % 400 AS INTEGER) AS d,
         (l_suppkey % 5) <> 4 AS tiktok
  FROM lineitem
),
sor1 AS (
  SELECT
    CAST(ok AS VARCHAR) || '-' || CAST(ln AS VARCHAR) || '-' || CAST(pk AS VARCHAR) AS uuid,
    CASE WHEN pk % 499 = 498 THEN NULL
         WHEN pk % 499 = 497 THEN {_cat('TEST_UNMAPPED')}
         WHEN pk % 40 < 18 THEN {_cat('ILLEGAL_OR_HARMFUL_SPEECH')}
         WHEN pk % 40 < 28 THEN CASE WHEN d < {_CUT} THEN {_cat('SCOPE_OF_PLATFORM_SERVICE')} ELSE {_cat('OTHER_VIOLATION_TC')} END
         WHEN pk % 40 = 28 THEN {_cat('OTHER_VIOLATION_TC')}
         WHEN pk % 40 < 32 THEN CASE WHEN tiktok THEN {_cat('NEGATIVE_EFFECTS_ON_CIVIC_DISCOURSE_OR_ELECTIONS')} ELSE {_cat('PROTECTION_OF_MINORS')} END
         WHEN pk % 40 < 34 THEN {_cat('VIOLENCE')}
         WHEN pk % 40 = 34 THEN {_cat('RISK_FOR_PUBLIC_SECURITY')}
         WHEN pk % 40 = 35 THEN CASE WHEN d < {_CUT} THEN {_cat('NON_CONSENSUAL_BEHAVIOUR')} ELSE {_cat('CYBER_VIOLENCE')} END
         WHEN pk % 40 = 36 THEN {_cat('PORNOGRAPHY_OR_SEXUALIZED_CONTENT')}
         WHEN pk % 40 = 37 THEN {_cat('CYBER_VIOLENCE')}
         ELSE CASE WHEN d < {_CUT} THEN {_cat('UNSAFE_AND_ILLEGAL_PRODUCTS')} ELSE {_cat('UNSAFE_AND_PROHIBITED_PRODUCTS')} END
    END AS category,
    CASE WHEN NOT tiktok THEN '["CONTENT_TYPE_SYNTHETIC_MEDIA"]'
         WHEN ln % 2 = 0 THEN '["CONTENT_TYPE_VIDEO"]'
         ELSE '["CONTENT_TYPE_TEXT"]' END AS content_type,
    CASE WHEN NOT tiktok THEN 'No' WHEN l_linestatus = 'F' THEN 'Yes' ELSE 'No' END AS automated_detection,
    CASE WHEN NOT tiktok AND pk % 25 > 1 THEN 'AUTOMATED_DECISION_NOT_AUTOMATED'
         WHEN l_returnflag IN ('A', 'N') THEN 'AUTOMATED_DECISION_FULLY'
         WHEN ln < 3 THEN 'AUTOMATED_DECISION_PARTIALLY'
         ELSE 'AUTOMATED_DECISION_NOT_AUTOMATED' END AS automated_decision,
    CASE WHEN ok % 97 = 0 THEN NULL
         WHEN ok % 4 = 0 THEN '["DE"]'
         WHEN ok % 4 = 1 THEN '["AT","DE","FR"]'
         WHEN ok % 4 = 2 THEN '["FR"]'
         ELSE '["ES","NL"]' END AS territorial_scope,
    CASE WHEN ok % 1009 = 0 THEN NULL ELSE CAST(d AS TIMESTAMP) + CASE WHEN pk % 11 = 3 THEN INTERVAL 13 HOUR ELSE INTERVAL 0 HOUR END END AS application_date,
    CASE WHEN tiktok THEN 'TikTok' WHEN ln = 7 THEN 'X (formerly Twitter)' ELSE 'X' END AS platform_name,
    CASE WHEN pk % 23 = 0 THEN NULL
         WHEN pk % 23 < 13 THEN '["DECISION_VISIBILITY_CONTENT_REMOVED"]'
         WHEN pk % 23 < 21 THEN '["DECISION_VISIBILITY_OTHER"]'
         ELSE '["DECISION_VISIBILITY_CONTENT_DEMOTED","DECISION_VISIBILITY_OTHER"]' END AS decision_visibility,
    CASE WHEN ln = 5 THEN NULL
         WHEN ln % 3 = 0 THEN CAST(d - 1 AS TIMESTAMP)
         ELSE CAST(d AS TIMESTAMP) END AS content_date,
    CASE WHEN pk % 101 = 7 THEN {_q(FACTS_SENTENCE + ' ')} WHEN ln % 4 <> 0 THEN {_q(FACTS_SENTENCE)} ELSE {_q(FACTS_SENTENCE[:-1])} END AS decision_facts,
    CAST(NULL AS VARCHAR) AS decision_monetary,
    l_quantity AS score
  FROM li
),
sor AS (SELECT * FROM sor1 UNION ALL SELECT * FROM sor1 WHERE uuid LIKE '%-1-%7'),
raw AS (SELECT *, {_NORM} AS platform FROM sor),
working_raw AS (
  SELECT {_KEEP},
         CASE WHEN CAST(application_date AS DATE) < {_CUT} THEN 'v1' ELSE 'v2' END AS api_version
  FROM sor
  WHERE contains(territorial_scope, '{S.SCOPE_COUNTRY}')
    AND CAST(application_date AS DATE) BETWEEN {_LO} AND {_HI}
),
working AS (
  SELECT * REPLACE ({_NORM} AS platform_name) FROM working_raw
),
v1_all AS (SELECT * FROM working WHERE api_version = 'v1'),
v1 AS (SELECT * FROM v1_all WHERE category NOT IN ({_BLEED})),
v1_as_written AS (SELECT * FROM working_raw WHERE api_version = 'v1' AND category NOT IN ({_BLEED_AS_WRITTEN})),
mapping(original_category, api_version, super_cluster, mapping_type) AS (
  VALUES {", ".join("(" + ", ".join(_q(v) for v in row) + ")" for row in S.MAPPING)}
),
recipients(platform_name, month, amar) AS (
  VALUES {", ".join(f"({_q(p)}, {_q(m)}, CAST({a} AS BIGINT))" for p, m, a in S.RECIPIENTS)}
)
"""

_FULLY = _q(S.FULLY_AUTOMATED)


def _share(src: str, keys: str, within: str, cnt: str = '"count"') -> str:
    return (
        f"SELECT {within}, {keys}, CAST({cnt} AS BIGINT) AS \"count\", "
        f"{cnt} / SUM({cnt}) OVER (PARTITION BY {within}) * 100 AS pct FROM {src}"
    )


def _stack(select_per_col: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(select_per_col.values())


PROFILE_RAW_COLUMNS = S.KEEP_COLUMNS + ["content_date", "decision_facts", "decision_monetary", "score"]
_DTYPES = {c: "string" for c in PROFILE_RAW_COLUMNS}
_DTYPES.update({"application_date": "timestamp_ntz", "content_date": "timestamp_ntz", "score": "double"})
_RAW_STRING_COLUMNS = [c for c in PROFILE_RAW_COLUMNS if _DTYPES[c] == "string"]
_NUMERIC = {"score"}


def _screening_profile(columns=PROFILE_RAW_COLUMNS, src: str = "raw", group: str = "platform") -> str:
    parts = {}
    for c in columns:
        var = f"ROUND(VAR_SAMP(TRY_CAST({c} AS DOUBLE)), 6)" if c in _NUMERIC else "CAST(NULL AS DOUBLE)"
        parts[c] = (
            f"SELECT {group}, '{c}' AS \"column\", '{_DTYPES.get(c, 'string')}' AS dtype, "
            f"COUNT(*) AS total_rows, count_if({c} IS NULL) AS null_count, "
            f"COUNT(DISTINCT CAST({c} AS VARCHAR)) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count, "
            f"{var} AS variance FROM {src} GROUP BY {group}"
        )
    return (
        BASE
        + ", p AS (\n"
        + _stack(parts)
        + f"\n)\nSELECT {group}, \"column\", dtype, CAST(null_count AS BIGINT) AS null_count, "
        "null_count / total_rows * 100 AS null_pct, CAST(total_rows - null_count AS BIGINT) AS non_null_count, "
        "CAST(unique_count AS BIGINT) AS unique_count, unique_count / total_rows * 100 AS unique_pct, variance FROM p"
    )


def _null_report() -> str:
    parts = {
        c: f"SELECT platform_name, '{c}' AS \"column\", count_if({c} IS NULL) AS null_count, COUNT(*) AS total_rows FROM working GROUP BY platform_name"
        for c in S.WORKING_COLUMNS
    }
    return BASE + ", n AS (\n" + _stack(parts) + "\n)\nSELECT platform_name, \"column\", CAST(null_count AS BIGINT) AS null_count, null_count / total_rows * 100 AS null_pct, CAST(total_rows AS BIGINT) AS total_rows FROM n"


def _low_cardinality_values() -> str:
    parts = {c: f"SELECT DISTINCT platform_name, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM working" for c in S.LOW_CARDINALITY_COLUMNS}
    return BASE + _stack(parts)


def _topn_values(n: int = 10) -> str:
    parts = {c: f"SELECT platform, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM raw" for c in _RAW_STRING_COLUMNS}
    return (
        BASE
        + ", l AS (\n"
        + _stack(parts)
        + "\n), c AS (SELECT platform, \"column\", value, COUNT(*) AS \"count\" FROM l GROUP BY ALL),"
        " t AS (SELECT platform, \"column\", SUM(\"count\") AS rows_total FROM c GROUP BY ALL),"
        " r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY platform, \"column\" ORDER BY \"count\" DESC, value ASC NULLS FIRST) AS rank FROM c),"
        f" k AS (SELECT * FROM r WHERE rank <= {n}),"
        " s AS (SELECT platform, \"column\", SUM(\"count\") AS top_total FROM k GROUP BY ALL)"
        " SELECT k.platform, k.\"column\", CAST(k.rank AS INTEGER) AS rank, k.value, k.\"count\","
        " k.\"count\" / t.rows_total * 100 AS pct_of_rows, k.\"count\" / s.top_total * 100 AS pct_of_top"
        " FROM k JOIN t USING (platform, \"column\") JOIN s USING (platform, \"column\")"
    )


def _string_stats() -> str:
    parts = {
        c: (
            f"SELECT platform, '{c}' AS \"column\", CAST(MIN(length({c})) AS INTEGER) AS len_min, CAST(MAX(length({c})) AS INTEGER) AS len_max, "
            f"AVG(length({c})) AS len_mean, COUNT(*) FILTER (WHERE {c} <> trim({c})) AS whitespace_anomaly_count FROM raw GROUP BY platform"
        )
        for c in _RAW_STRING_COLUMNS
    }
    return BASE + _stack(parts)


def _column_missing_ctes() -> tuple[str, str]:
    parts = {
        c: (
            f"SELECT platform, '{c}' AS \"column\", COUNT(*) AS total_rows, count_if({c} IS NULL) AS n_null, "
            f"count_if({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_miss FROM raw GROUP BY platform"
        )
        for c in PROFILE_RAW_COLUMNS
    }
    ctes = (
        ", m AS (\n"
        + _stack(parts)
        + "\n), p AS (SELECT platform, \"column\", CAST(total_rows AS BIGINT) AS total_rows, n_null / total_rows * 100 AS null_pct,"
        " n_miss / total_rows * 100 AS total_missing_pct FROM m)"
    )
    select = (
        "SELECT *, CASE WHEN total_missing_pct = 100 THEN 'empty' WHEN total_missing_pct > 10 AND total_missing_pct < 100"
        " THEN 'severe' ELSE 'ok' END AS severity FROM p"
    )
    return ctes, select


def _column_missing() -> str:
    ctes, select = _column_missing_ctes()
    return BASE + ctes + " " + select


def _empty_in_both() -> str:
    ctes, select = _column_missing_ctes()
    return (
        BASE
        + ctes
        + f", cm AS ({select})"
        " SELECT \"column\" FROM cm GROUP BY \"column\" HAVING count_if(severity = 'empty') = COUNT(*) AND COUNT(*) >= 2"
    )


def _constant_columns() -> str:
    parts = {
        c: (
            f"SELECT platform, '{c}' AS \"column\", COUNT(*) AS n, COUNT({c}) AS k, MIN(CAST({c} AS VARCHAR)) AS lo, "
            f"MAX(CAST({c} AS VARCHAR)) AS hi FROM raw GROUP BY platform"
        )
        for c in PROFILE_RAW_COLUMNS
    }
    return BASE + ", s AS (\n" + _stack(parts) + "\n) SELECT platform, \"column\", lo AS value FROM s WHERE k = 0 OR (k = n AND lo = hi)"


def _column_cardinality() -> str:
    parts = {
        c: (
            f"SELECT platform, '{c}' AS \"column\", CAST(COUNT(DISTINCT CAST({c} AS VARCHAR)) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique "
            "FROM raw GROUP BY platform"
        )
        for c in PROFILE_RAW_COLUMNS
    }
    return BASE + _stack(parts)


def _truncation_flags() -> str:
    limit = max(S.TRUNCATION_LIMITS.values())
    return (
        f"SELECT lang, 'text' AS \"column\", {limit} AS \"limit\", CAST(MAX(length(text)) AS INTEGER) AS len_max,"
        f" CAST(count_if(length(text) >= {limit}) AS BIGINT) AS rows_at_limit FROM documents GROUP BY lang"
    )


def _overlap(side: str, a: str, b: str, a_label: str, b_label: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return (
        BASE
        + f"SELECT {g}category, CASE WHEN bool_or({side} = '{a}') AND bool_or({side} = '{b}') THEN 'both' "
        f"WHEN bool_or({side} = '{a}') THEN '{a_label}' ELSE '{b_label}' END AS membership "
        f"FROM working WHERE {side} IN ('{a}', '{b}') GROUP BY {g}category"
    )


def _version_anomalies() -> str:
    parts = {
        f"{c}/{v}": f"SELECT platform_name, {_q(c)} AS category, '{v}' AS api_version, CAST(count_if(category = {_q(c)} AND api_version = '{v}') AS BIGINT) AS \"count\" FROM working GROUP BY platform_name"
        for c, v in S.VERSION_ANOMALIES
    }
    return BASE + _stack(parts)


_MONTHLY_INTENSITY_TAIL = (
    ", c AS (SELECT platform_name, strftime(application_date, '%Y-%m') AS month, COUNT(*) AS raw_count FROM v1_all GROUP BY ALL),"
    " mi AS (SELECT c.platform_name, c.month, c.raw_count, r.amar, ROUND(c.raw_count / r.amar * 1000000, 2) AS intensity_rate"
    " FROM c JOIN recipients r ON c.platform_name = r.platform_name AND c.month = r.month)"
)


def _compare(src: str, rate: str) -> str:
    return (
        f" SELECT platform_name, jan_rate, feb_rate, ROUND((feb_rate - jan_rate) / jan_rate * 100, 2) AS pct_deviation FROM ("
        f"SELECT platform_name, MAX(CASE WHEN month = '{S.JAN}' THEN {rate} END) AS jan_rate, "
        f"MAX(CASE WHEN month = '{S.FEB}' THEN {rate} END) AS feb_rate FROM {src} GROUP BY platform_name) "
        "WHERE jan_rate IS NOT NULL AND feb_rate IS NOT NULL"
    )


_VIS_COUNTS = ", vc AS (SELECT platform_name, decision_visibility, COUNT(*) AS \"count\" FROM v1_all GROUP BY ALL) "
_CAT_COUNTS = ", cc AS (SELECT platform_name, category, api_version, COUNT(*) AS \"count\" FROM working GROUP BY ALL) "
_SCOPE_COUNTS = ", sc AS (SELECT platform_name, territorial_scope, COUNT(*) AS n FROM working GROUP BY ALL) "
_HARMONIZED = (
    ", h AS (SELECT w.uuid, w.category AS category_raw, m.super_cluster AS category_harmonized, w.content_type, w.automated_detection,"
    " w.automated_decision, w.territorial_scope, CAST(w.application_date AS DATE) AS application_date_raw,"
    " CAST(w.application_date AS DATE) AS application_date_harmonized, w.platform_name, w.decision_visibility, w.api_version"
    " FROM working_raw w LEFT JOIN mapping m ON w.category = m.original_category) "
)
_FUNNEL_STEPS = [
    ("raw", "TRUE"),
    ("scope_de", "contains(territorial_scope, 'DE')"),
    ("date_2025", f"contains(territorial_scope, 'DE') AND CAST(application_date AS DATE) BETWEEN {_LO} AND {_HI}"),
    ("v1", f"contains(territorial_scope, 'DE') AND CAST(application_date AS DATE) BETWEEN {_LO} AND {_HI} AND CAST(application_date AS DATE) < {_CUT}"),
]


def _funnel() -> str:
    aggs = ", ".join(f"count_if({p}) AS s{i}" for i, (_, p) in enumerate(_FUNNEL_STEPS))
    parts = {}
    for i, (name, _) in enumerate(_FUNNEL_STEPS):
        prev = f"s{i - 1}" if i else f"s{i}"
        parts[name] = (
            f"SELECT platform AS platform_name, {i + 1} AS step_no, '{name}' AS step, CAST(s{i} AS BIGINT) AS rows, "
            f"CAST({prev} - s{i} AS BIGINT) AS dropped, CASE WHEN {prev} > 0 THEN s{i} / {prev} * 100 ELSE 0.0 END AS retention_pct FROM f"
        )
    return BASE + f", f AS (SELECT platform, {aggs} FROM raw GROUP BY platform) " + _stack(parts)


# The staged files: rows are dealt by platform, day and two bits of the uuid's md5.
_PLACED = f""", placed AS (
  SELECT *, lower(platform) AS plat, coalesce(CAST(application_date AS DATE), CAST(content_date AS DATE), DATE '1970-01-01') AS day,
         CAST('0x' || substr(md5(uuid), 1, 2) AS INTEGER) % {SALTS} AS salt
  FROM raw
)"""
_FILES = _PLACED + """, files AS (
  SELECT platform, day, salt, COUNT(*) AS n, 'sor-' || plat || '-' || strftime(day, '%Y-%m-%d') || '-full' AS folder,
         plat || '___full/daily_dumps_chunked/sor-' || plat || '-' || strftime(day, '%Y-%m-%d') || '-full' AS tree
  FROM placed GROUP BY platform, plat, day, salt
) """
_SAMPLED = _PLACED + f""", zips AS (
  SELECT DISTINCT platform, day, salt, plat || '___full/sor-' || plat || '-' || strftime(day, '%Y-%m-%d') || '-full-' || salt || '-00000.zip' AS path FROM placed
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY platform ORDER BY CAST('0x' || substr(md5('{S.SAMPLE_SEED}:' || path), 1, 15) AS BIGINT), path) AS rn,
         greatest(1, floor(COUNT(*) OVER (PARTITION BY platform) * 0.5)) AS k
  FROM zips
), picked AS (
  SELECT placed.* FROM placed JOIN ranked USING (platform, day, salt) WHERE rn <= k OR platform <> 'TikTok'
) """


def _content_date_agreement(more: str = "", src: str = "raw") -> str:
    return (
        BASE
        + more
        + f", c AS (SELECT platform AS label, CAST(application_date AS DATE) AS ad, CAST(content_date AS DATE) AS cd FROM {src}"
        f" WHERE contains(territorial_scope, 'DE') AND CAST(application_date AS DATE) BETWEEN {_LO} AND {_HI}),"
        " a AS (SELECT label, COUNT(*) AS total, count_if(cd IS NULL) AS s_null, count_if(cd = ad) AS s_equal,"
        " count_if(cd IS NOT NULL AND cd <> ad) AS s_different FROM c GROUP BY label) "
        + _stack(
            {
                s: f"SELECT label, '{s}' AS status, CAST(s_{s} AS BIGINT) AS n, s_{s} / total * 100 AS pct, CAST(total AS BIGINT) AS total FROM a"
                for s in ("null", "equal", "different")
            }
        )
    )


def _other_tables() -> dict[str, str]:
    q: dict[str, str] = {}
    q["orders_status_share"] = (
        "WITH c AS (SELECT o_orderpriority, o_orderstatus, COUNT(*) AS \"count\" FROM orders GROUP BY ALL) "
        + _share("c", "o_orderstatus", "o_orderpriority")
    )
    q["orders_monthly_counts"] = (
        "SELECT o_orderstatus, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month, COUNT(*) AS row_count FROM orders GROUP BY ALL"
    )
    q["events_type_share_by_day"] = (
        "WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS \"count\" FROM events GROUP BY ALL) "
        + _share("c", "event_type", "day")
    )
    q["events_user_multiplicity"] = (
        "WITH k AS (SELECT event_type, user_id, COUNT(*) AS m FROM events GROUP BY ALL) "
        "SELECT event_type, CAST(SUM(m) AS BIGINT) AS total_rows, COUNT(*) AS distinct_keys, CAST(count_if(m > 1) AS BIGINT) AS duplicated_keys, "
        "CAST(SUM(m - 1) AS BIGINT) AS excess_rows FROM k GROUP BY event_type"
    )
    q["events_cardinality"] = _stack(
        {
            c: f"SELECT '{c}' AS \"column\", CAST(COUNT(DISTINCT CAST({c} AS VARCHAR)) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique FROM events"
            for c in ["event_id", "ts", "user_id", "event_type", "value", "props"]
        }
    )
    q["documents_text_stats"] = (
        "SELECT lang, 'text' AS \"column\", CAST(MIN(length(text)) AS INTEGER) AS len_min, CAST(MAX(length(text)) AS INTEGER) AS len_max, AVG(length(text)) AS len_mean, "
        "COUNT(*) FILTER (WHERE text <> trim(text)) AS whitespace_anomaly_count FROM documents GROUP BY lang"
    )
    q["documents_duplicate_texts"] = (
        "WITH k AS (SELECT lang, text, COUNT(*) AS m FROM documents GROUP BY ALL) "
        "SELECT lang, CAST(SUM(m) AS BIGINT) AS total_rows, COUNT(*) AS distinct_keys, CAST(count_if(m > 1) AS BIGINT) AS duplicated_keys, "
        "CAST(SUM(m - 1) AS BIGINT) AS excess_rows FROM k GROUP BY lang"
    )
    q["documents_lang_share"] = (
        "WITH c AS (SELECT lang, COUNT(*) AS \"count\" FROM documents GROUP BY lang) "
        "SELECT lang, \"count\", \"count\" / SUM(\"count\") OVER () * 100 AS pct FROM c"
    )
    parts = {
        c: (
            f"SELECT source, '{c}' AS \"column\", COUNT(*) AS total_rows, count_if({c} IS NULL) AS n_null, "
            f"count_if({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_miss FROM documents GROUP BY source"
        )
        for c in ["doc_id", "text", "lang", "n_chars"]
    }
    q["documents_missing"] = (
        "WITH m AS (" + _stack(parts) + "), p AS (SELECT source, \"column\", CAST(total_rows AS BIGINT) AS total_rows, "
        "n_null / total_rows * 100 AS null_pct, n_miss / total_rows * 100 AS total_missing_pct FROM m) "
        "SELECT *, CASE WHEN total_missing_pct = 100 THEN 'empty' WHEN total_missing_pct > 10 AND total_missing_pct < 100 "
        "THEN 'severe' ELSE 'ok' END AS severity FROM p"
    )
    return q


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = _other_tables()
    for suffix, src in (("", "v1"), ("_as_written", "v1_as_written")):
        q["category_distribution" + suffix] = (
            BASE + f", c AS (SELECT platform_name, category, COUNT(*) AS \"count\" FROM {src} GROUP BY ALL) " + _share("c", "category", "platform_name")
        )
        q["top_category" + suffix] = (
            BASE
            + f", c AS (SELECT platform_name, category, COUNT(*) AS \"count\" FROM {src} GROUP BY ALL), d AS ("
            + _share("c", "category", "platform_name")
            + ") SELECT platform_name, category AS top_category, pct AS top_pct FROM ("
            "SELECT *, ROW_NUMBER() OVER (PARTITION BY platform_name ORDER BY \"count\" DESC, category ASC NULLS FIRST) AS rn FROM d) WHERE rn = 1"
        )
        q["automation_overall" + suffix] = (
            BASE
            + f", a AS (SELECT platform_name, count_if(automated_decision = {_FULLY}) AS n, COUNT(*) AS total FROM {src} GROUP BY platform_name)"
            f" SELECT platform_name, {_FULLY} AS automated_decision, CAST(n AS BIGINT) AS \"count\", n / total * 100 AS pct FROM a WHERE n > 0"
        )
        q["automation_by_category" + suffix] = (
            BASE
            + f", a AS (SELECT platform_name, category, count_if(automated_decision = {_FULLY}) AS n, COUNT(*) AS total FROM {src} GROUP BY ALL)"
            f" SELECT platform_name, category, {_FULLY} AS automated_decision, CAST(n AS BIGINT) AS \"count\", n / total * 100 AS pct FROM a WHERE n > 0"
        )
        q["deviation_automation" + suffix] = (
            BASE
            + f", a AS (SELECT platform_name, strftime(application_date, '%Y-%m') AS month, count_if(automated_decision = {_FULLY}) AS n, COUNT(*) AS total"
            f" FROM {src} WHERE application_date >= TIMESTAMP '2025-01-01' AND application_date < TIMESTAMP '2025-03-01' GROUP BY ALL),"
            " p AS (SELECT platform_name, month, n / total * 100 AS auto_pct FROM a WHERE n > 0)"
            + _compare("p", "auto_pct")
        )
    q["visibility_distribution"] = BASE + _VIS_COUNTS + _share("vc", "decision_visibility", "platform_name")
    q["visibility_other_share"] = (
        BASE
        + _VIS_COUNTS
        + f", k AS (SELECT platform_name, CASE WHEN contains(decision_visibility, '{S.VISIBILITY_OTHER}') THEN 'OTHER' ELSE 'SPECIFIC' END AS visibility_class,"
        " SUM(\"count\") AS \"count\" FROM vc WHERE decision_visibility IS NOT NULL GROUP BY ALL), s AS ("
        + _share("k", "visibility_class", "platform_name")
        + ") SELECT * FROM s WHERE visibility_class = 'OTHER'"
    )
    q["monthly_intensity"] = BASE + _MONTHLY_INTENSITY_TAIL + " SELECT * FROM mi"
    q["deviation_intensity"] = BASE + _MONTHLY_INTENSITY_TAIL + _compare("mi", "intensity_rate")
    q["v1_dataset"] = BASE + "SELECT * FROM v1"
    q["working_dataset"] = BASE + "SELECT * FROM working_raw"
    q["working_preview"] = (
        BASE
        + "SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY platform_name ORDER BY application_date ASC NULLS FIRST,"
        " uuid ASC NULLS FIRST, category ASC NULLS FIRST, content_type ASC NULLS FIRST, automated_detection ASC NULLS FIRST,"
        " automated_decision ASC NULLS FIRST, territorial_scope ASC NULLS FIRST, decision_visibility ASC NULLS FIRST,"
        " api_version ASC NULLS FIRST) AS rn FROM working_raw) WHERE rn <= 5"
    )
    q["filter_funnel"] = _funnel()
    q["version_split"] = BASE + ", c AS (SELECT platform_name, api_version, COUNT(*) AS \"count\" FROM working GROUP BY ALL) " + _share("c", "api_version", "platform_name")
    q["monthly_row_counts"] = (
        BASE
        + "SELECT platform_name AS platform, CAST(date_trunc('month', CAST(application_date AS DATE)) AS DATE) AS month, COUNT(*) AS row_count FROM working GROUP BY ALL"
    )
    q["date_range"] = BASE + "SELECT platform_name, MIN(application_date) AS earliest, MAX(application_date) AS latest FROM working GROUP BY platform_name"
    q["content_date_agreement"] = _content_date_agreement()
    q["content_date_agreement_archives"] = _content_date_agreement()
    q["midnight_check"] = (
        BASE
        + "SELECT platform_name, CAST(count_if(application_date = date_trunc('day', application_date)) AS BIGINT) AS midnight_rows, COUNT(*) AS total_rows FROM working GROUP BY platform_name"
    )
    q["platform_ratio"] = (
        BASE
        + ", a AS (SELECT count_if(platform_name = 'TikTok') AS a_rows, count_if(platform_name = 'X') AS b_rows FROM working)"
        " SELECT CAST(a_rows AS BIGINT) AS a_rows, CAST(b_rows AS BIGINT) AS b_rows, CASE WHEN b_rows > 0 THEN a_rows / b_rows END AS ratio FROM a"
    )
    q["screening_profile"] = _screening_profile()
    q["screening_profile_working"] = _screening_profile(S.WORKING_COLUMNS, "working", "platform_name")
    q["null_report"] = _null_report()
    q["uuid_uniqueness"] = (
        BASE
        + ", k AS (SELECT platform_name, uuid, COUNT(*) AS m FROM working GROUP BY ALL)"
        " SELECT platform_name, CAST(SUM(m) AS BIGINT) AS total_rows, COUNT(*) AS unique_uuids, CAST(count_if(m > 1) AS BIGINT) AS duplicated_uuids,"
        " CAST(SUM(m - 1) AS BIGINT) AS excess_rows, COUNT(*) / CAST(SUM(m) AS BIGINT) * 100 AS unique_pct FROM k GROUP BY platform_name"
    )
    q["uuid_multiplicity"] = (
        BASE
        + ", k AS (SELECT platform_name, uuid, COUNT(*) AS m FROM working GROUP BY ALL)"
        " SELECT platform_name, m AS copies, COUNT(*) AS keys FROM k GROUP BY ALL"
    )
    q["duplicate_rows"] = (
        BASE
        + ", k AS (SELECT *, COUNT(*) AS m FROM working_raw GROUP BY ALL)"
        " SELECT CAST(COALESCE(SUM(m), 0) AS BIGINT) AS total_rows, COUNT(*) AS distinct_rows, CAST(COALESCE(SUM(m - 1), 0) AS BIGINT) AS duplicate_rows FROM k"
    )
    q["low_cardinality_values"] = _low_cardinality_values()
    q["topn_values"] = _topn_values()
    q["string_stats"] = _string_stats()
    q["column_missing"] = _column_missing()
    q["empty_in_both"] = _empty_in_both()
    q["constant_columns"] = _constant_columns()
    q["column_cardinality"] = _column_cardinality()
    q["text_variants"] = (
        BASE
        + ", r AS (SELECT platform, decision_facts AS raw, COUNT(*) AS \"count\" FROM raw GROUP BY ALL),"
        r" n AS (SELECT *, regexp_replace(rtrim(raw), '\.$', '') AS normalized FROM r),"
        " f AS (SELECT platform, normalized FROM n GROUP BY ALL HAVING COUNT(*) > 1),"
        " t AS (SELECT platform, SUM(\"count\") AS rows_total FROM r GROUP BY platform)"
        " SELECT n.platform, n.normalized, n.raw, n.\"count\", n.\"count\" / t.rows_total * 100 AS pct"
        " FROM n JOIN f ON n.platform = f.platform AND n.normalized = f.normalized JOIN t ON n.platform = t.platform"
    )
    q["string_anomalies"] = f"SELECT * FROM ({q['string_stats']}) WHERE len_max > 0 AND whitespace_anomaly_count > 0"
    q["truncation_flags"] = _truncation_flags()
    q["scope_arity"] = (
        BASE
        + _SCOPE_COUNTS
        + ", a AS (SELECT platform_name, CAST(json_array_length(territorial_scope) AS INTEGER) AS n_countries, SUM(n) AS \"count\" FROM sc GROUP BY ALL) "
        + _share("a", "n_countries", "platform_name")
    )
    q["scope_country_counts"] = (
        BASE
        + _SCOPE_COUNTS
        + ", e AS (SELECT platform_name, unnest(from_json(territorial_scope, '[\"VARCHAR\"]')) AS country, n FROM sc)"
        " SELECT platform_name, country, CAST(SUM(n) AS BIGINT) AS \"count\" FROM e GROUP BY ALL"
    )
    q["category_counts"] = BASE + _CAT_COUNTS + "SELECT * FROM cc"
    q["category_cardinality"] = BASE + _CAT_COUNTS + "SELECT platform_name, api_version, COUNT(*) AS unique_categories FROM cc GROUP BY ALL"
    q["category_version_overlap"] = _overlap("api_version", "v1", "v2", "v1_only", "v2_only", "platform_name")
    q["category_version_overlap_pooled"] = _overlap("api_version", "v1", "v2", "v1_only", "v2_only")
    q["category_platform_overlap"] = _overlap("platform_name", "TikTok", "X", "tiktok_only", "x_only")
    q["harmonized_dataset"] = BASE + _HARMONIZED + "SELECT * FROM h"
    q["supercluster_breakdown"] = (
        BASE
        + _CAT_COUNTS
        + "SELECT cc.platform_name, m.super_cluster, cc.api_version, CAST(SUM(cc.\"count\") AS BIGINT) AS total_records"
        " FROM cc LEFT JOIN mapping m ON cc.category = m.original_category GROUP BY ALL"
    )
    q["harmonized_distribution"] = (
        BASE
        + _HARMONIZED
        + f"SELECT {_NORM} AS platform_name, category_harmonized, COUNT(*) AS \"count\" FROM h GROUP BY ALL"
    )
    q["mapping_comparison"] = (
        BASE
        + ", u AS (SELECT category, bool_or(platform_name = 'TikTok') AS t, bool_or(platform_name = 'X') AS x FROM working GROUP BY category)"
        " SELECT m.api_version, m.mapping_type, CASE WHEN coalesce(u.t, FALSE) THEN m.original_category END AS tiktok_original_category,"
        " m.super_cluster, CASE WHEN coalesce(u.x, FALSE) THEN m.original_category END AS x_original_category"
        " FROM mapping m LEFT JOIN u ON m.original_category = u.category"
    )
    q["category_documentation"] = (
        BASE
        + ", c AS (SELECT platform_name, category, COUNT(*) AS record_count FROM working WHERE api_version = 'v1' GROUP BY ALL),"
        " s AS (SELECT *, record_count / SUM(record_count) OVER (PARTITION BY platform_name) * 100 AS share_pct FROM c)"
        " SELECT s.platform_name, s.category AS category_raw, m.super_cluster, s.record_count, ROUND(s.share_pct, 4) AS share_pct"
        " FROM s LEFT JOIN mapping m ON s.category = m.original_category"
    )
    q["version_anomalies"] = _version_anomalies()
    q["reconciliation"] = (
        BASE
        + _HARMONIZED
        + ", i AS (SELECT platform_name, COUNT(*) AS input_rows FROM working_raw GROUP BY platform_name),"
        " g AS (SELECT platform_name, COUNT(*) AS harmonized_rows, CAST(count_if(api_version = 'v1') AS BIGINT) AS v1_rows, CAST(count_if(api_version = 'v2') AS BIGINT) AS v2_rows,"
        " CAST(count_if(category_harmonized IS NULL) AS BIGINT) AS unmapped_rows FROM h GROUP BY platform_name)"
        " SELECT COALESCE(i.platform_name, g.platform_name) AS platform_name, input_rows, harmonized_rows, v1_rows, v2_rows,"
        " (v1_rows + v2_rows) = input_rows AS versions_add_up, harmonized_rows = input_rows AS rows_preserved, unmapped_rows"
        " FROM i FULL OUTER JOIN g ON i.platform_name IS NOT DISTINCT FROM g.platform_name"
    )
    q["unmapped_categories"] = (
        BASE
        + ", c AS (SELECT platform_name, category, COUNT(*) AS \"count\" FROM working GROUP BY ALL)"
        " SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM mapping m WHERE m.original_category = c.category)"
    )
    q["working_from_dumps"] = q["working_dataset"]
    q["category_distribution_stored"] = q["category_distribution"]
    q["supercluster_from_csv_mapping"] = q["supercluster_breakdown"]
    q["reduced_parts"] = BASE + f"SELECT {_KEEP} FROM sor"
    q["uuid_uniqueness_approx"] = (
        BASE + "SELECT platform_name, COUNT(*) AS total_rows, COUNT(DISTINCT uuid) AS unique_uuids, TRUE AS estimate_within_bounds FROM working GROUP BY platform_name"
    )
    day = "COALESCE(CAST(application_date AS DATE), CAST(content_date AS DATE), DATE '1970-01-01')"
    q["platform_tables"] = BASE + 'SELECT platform_name, category, COUNT(*) AS "count" FROM working GROUP BY ALL'
    dumped = f", dumped AS (SELECT {_NORM} AS platform, {day} AS dump_day FROM raw)"
    q["february_dumps"] = BASE + dumped + ' SELECT lower(platform) AS platform, dump_day, COUNT(*) AS "count" FROM dumped WHERE dump_day BETWEEN DATE \'2025-02-01\' AND DATE \'2025-02-28\' GROUP BY ALL'
    q["footer_row_counts"] = BASE + dumped + " SELECT platform, dump_day, COUNT(*) AS row_count FROM dumped GROUP BY ALL"
    columns = ", ".join(_q(f.name) for f in S.RAW_SCHEMA.fields)
    q["part_columns"] = BASE + f'SELECT unnest([{columns}]) AS "column", row_count FROM (SELECT COUNT(*) AS row_count FROM raw)'
    label = "upper(COALESCE(platform_name, 'null') || '|' || COALESCE(category, 'null') || '|{0}')"
    rows = " UNION ALL ".join(f'SELECT {label.format(v)} AS metric, CAST("{v}" AS DOUBLE) AS value FROM s' for v in ("count", "pct"))
    q["run_metrics"] = (
        BASE
        + ', c AS (SELECT platform_name, category, COUNT(*) AS "count" FROM v1 GROUP BY ALL), s AS ('
        + _share("c", "category", "platform_name")
        + f"), m AS ({rows}) SELECT run_id, 'category_distribution' AS description, metric, value FROM m, (VALUES ('run-1'), ('run-2')) r(run_id)"
    )
    q["category_days_clustered"] = (
        BASE + "SELECT platform_name, CAST(application_date AS DATE) AS day, COUNT(*) AS \"count\" FROM working"
        " WHERE category = 'STATEMENT_CATEGORY_CYBER_VIOLENCE' AND application_date >= TIMESTAMP '2025-01-01' AND application_date < TIMESTAMP '2025-03-01' GROUP BY ALL"
    )
    q["footer_date_range"] = BASE + "SELECT platform, MIN(application_date) AS earliest, MAX(application_date) AS latest FROM raw GROUP BY platform"
    for plain, other in (
        ("uuid_multiplicity", "uuid_multiplicity_filtered"),
        ("duplicate_rows", "duplicate_rows_filtered"),
        ("documents_duplicate_texts", "documents_duplicate_texts_filtered"),
        ("topn_values", "topn_values_summaries"),
        ("uuid_uniqueness_approx", "uuid_uniqueness_sketched"),
    ):
        q[other] = q[plain]
    q["replaced_orders"] = (
        'SELECT version, o_orderstatus, COUNT(*) AS "count" FROM orders, (VALUES (1), (2)) v(version)'
        " WHERE version = 1 OR o_orderstatus <> 'O' GROUP BY ALL"
    )
    q["file_manifest"] = (
        BASE + _FILES + f"SELECT tree || '/part-' || salt || '-00000.parquet' AS source_file,"
        " 'dump_folder=' || folder || '/source_part=part-' || salt || '-00000' AS output_file, 'processed' AS status, n AS \"rows\","
        f" CAST({len(PROFILE_RAW_COLUMNS)} AS BIGINT) AS cols_in, CAST({len(S.KEEP_COLUMNS)} AS BIGINT) AS cols_out,"
        f" CAST({len(PROFILE_RAW_COLUMNS) - len(S.KEEP_COLUMNS)} AS BIGINT) AS dropped_cols FROM files"
    )
    q["coverage_audit"] = (
        BASE + _FILES + ", edges AS (SELECT date_trunc('year', min(day)) AS a, date_trunc('year', max(day)) + INTERVAL 11 MONTH AS b FROM files),"
        " cal AS (SELECT platform, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM (SELECT DISTINCT platform FROM files), edges),"
        " m AS (SELECT platform, CAST(date_trunc('month', day) AS DATE) AS month, COUNT(DISTINCT folder) AS day_folders, COUNT(*) AS files FROM files GROUP BY ALL)"
        " SELECT platform, month, CAST(day(last_day(month)) AS INTEGER) AS calendar_days, coalesce(day_folders, 0) AS day_folders,"
        " coalesce(day_folders, 0) AS non_empty_days, coalesce(files, 0) AS files, day(last_day(month)) - coalesce(day_folders, 0) AS missing_days"
        " FROM cal LEFT JOIN m USING (platform, month)"
    )
    q["file_half_sample"] = BASE + _SAMPLED + "SELECT platform, path FROM ranked WHERE rn <= k"
    q["content_date_agreement_sampled"] = _content_date_agreement(_SAMPLED, "picked")
    return q
