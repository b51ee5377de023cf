"""Join helper: null-safe equi-joins; Spark picks the strategy from sizes it knows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys, treating null keys as equal (``<=>``).

    With no keys the right side must be a global aggregate (at most one row):
    its columns are attached as scalar subqueries, each computed once and
    used as a constant, so there is no join at all (a join on a constant key
    would be folded into a nested-loop join). An empty right side gives nulls,
    as a left join would.
    """
    if not keys:
        if how not in ("inner", "left", "left_outer", "leftouter"):
            raise ValueError("a keyless join needs a one-row right side and an inner/left join")
        return left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns])
    ren = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(ren[f"_r_{k}"]) for k in keys])
    out = left.join(ren, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti", "leftsemi", "leftanti"):
        return out
    if how in ("full", "outer", "full_outer", "fullouter", "right", "right_outer", "rightouter"):
        # keys that exist only on the right side come from the right's copy
        left_cols = [F.coalesce(left[c], ren[f"_r_{c}"]).alias(c) if c in keys else left[c] for c in left.columns]
        right_cols = [ren[c] for c in ren.columns if not (c.startswith("_r_") and c[3:] in keys)]
        return out.select(*left_cols, *right_cols)
    return out.drop(*[f"_r_{k}" for k in keys])
