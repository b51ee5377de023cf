"""End-of-pipeline job: analyse a stored working table, write the results.

The study's analysis scripts end by printing a table and appending it to a
markdown log. Here each result is written as a one-file CSV extract under
``out_dir/<analysis>/`` (small, aggregated rows) and its headline numbers are
appended as metric rows to ``out_dir/run_metrics`` (Parquet, one ``run_id``
per run), all from DataFrames without collecting.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from .. import sinks
from ..functions import columns as C
from ..operators import compare, order, shares
from ..sources import dims
from . import prep, queries, suite

# (analysis, key columns, value columns) whose values go to the metrics table.
HEADLINES = {
    "top_category": (["platform_name", "top_category"], ["top_pct"]),
    "automation_overall": (["platform_name"], ["pct"]),
    "visibility_other_share": (["platform_name"], ["pct"]),
    "deviation_intensity": (["platform_name"], ["jan_rate", "feb_rate", "pct_deviation"]),
    "deviation_automation": (["platform_name"], ["jan_rate", "feb_rate", "pct_deviation"]),
}


def analyses_from_working(spark: SparkSession, working: DataFrame) -> dict[str, DataFrame]:
    """The v1 analyses on a working-records frame (e.g. a stored working table)."""
    v1 = prep.v1_dataset(working)
    v1_all = prep.v1_unfiltered(working)
    out = dict(suite.analysis_suite(v1))
    vis = shares.count_by(v1_all, ["platform_name", "decision_visibility"])
    out["visibility_distribution"] = order.sort_by(shares.share_of_counts(vis, ["platform_name"]), ["platform_name", ("count", "desc")])
    out["visibility_other_share"] = queries.other_share_from_counts(vis)
    monthly = shares.count_by(v1_all.withColumn("month", C.month_text("application_date")), ["platform_name", "month"], "raw_count")
    intensity = compare.rate_per_million(monthly, dims.recipients(spark), ["platform_name", "month"])
    out["monthly_intensity"] = order.sort_by(intensity.select("platform_name", "month", "raw_count", "amar", "intensity_rate"), ["platform_name", "month"])
    out["deviation_intensity"] = compare.compare_periods(intensity, ["platform_name"], "month", S.JAN, S.FEB, "intensity_rate")
    out["deviation_automation"] = queries.deviation_automation_of(v1)
    return out


def run_analyses(spark: SparkSession, working_path: str, out_dir: str, run_id: str | None = None) -> str:
    """Analyse the stored working table at ``working_path``; returns the run id."""
    rid = run_id or uuid.uuid4().hex[:12]
    results = analyses_from_working(spark, sinks.read_working(spark, working_path))
    for name, df in results.items():
        sinks.write_small_csv(df, f"{out_dir}/{name}")
    for name, (keys, values) in HEADLINES.items():
        metrics = sinks.result_metrics(results[name], keys, values, name, rid)
        sinks.record_metrics(metrics, f"{out_dir}/run_metrics")
    return rid
