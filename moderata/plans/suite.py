"""The v1 analysis suite from one scan.

The study scans its data once per analysis script (and twice in the
automation script). All four category/automation outputs are functions of
one aggregate, the row count per (platform, category, decision): it is
computed once, written as a reliable checkpoint into the shared
``spark.checkpoint.dir`` folder (a few hundred rows; the lineage back to the
raw scan is cut, so a lost executor never re-triggers the scan), and the
outputs are derived from it with weighted conditional shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import filters as P
from ..operators import order, shares
from ..session import checkpoint_dir


def analysis_suite(v1: DataFrame) -> dict[str, DataFrame]:
    """category_distribution, top_category, automation_overall, automation_by_category."""
    checkpoint_dir(v1.sparkSession)  # the shared folder named by the session (set only if unset)
    counts = shares.count_by(v1, ["platform_name", "category", "automated_decision"]).checkpoint(eager=True)
    per_cat = counts.groupBy("platform_name", "category").agg(F.sum("count").alias("count"))
    dist = shares.share_of_counts(per_cat, ["platform_name"])
    top = shares.top_per_group(dist, ["platform_name"], "category", "count", carry=["pct"], value_alias="top_category", carry_alias=["top_pct"])
    fully = P.equals("automated_decision", S.FULLY_AUTOMATED)
    overall = shares.conditional_share(counts, ["platform_name"], fully, weight="count")
    by_cat = shares.conditional_share(counts, ["platform_name", "category"], fully, weight="count")
    label = F.lit(S.FULLY_AUTOMATED).alias("automated_decision")
    return {
        "category_distribution": order.sort_by(dist, ["platform_name", ("count", "desc")]),
        "top_category": order.sort_by(top, ["platform_name"]),
        "automation_overall": order.sort_by(overall.select("platform_name", label, "count", "pct"), ["platform_name"]),
        "automation_by_category": order.sort_by(by_cat.select("platform_name", "category", label, "count", "pct"), ["platform_name", ("pct", "desc")]),
    }
