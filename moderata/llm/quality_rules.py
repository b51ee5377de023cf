"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Every document gets plain counts and five rule scores (higher is worse). For
each stratum (``lang``) and rule a grid of cutoffs is tested from lenient to
strict on labelled good documents: a cutoff is accepted while the exact
binomial probability of seeing so few rejections, were the true false
rejection rate ``limit``, stays within ``alpha`` shared equally over all
(stratum, rule) pairs (Bonferroni; within a pair the fixed order of tests
needs no further correction). The strictest accepted cutoff holds; a pair
without one rejects nothing. All labelled rows are counted.

Defined cases: null text has no words (base_failed is true); null strata are
one stratum; labels that are null, or not 1, are not good documents; several
labels of one id count once, by the smallest; without labels nothing is
rejected beyond the base rule.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, cut, with_lookup

SYMBOLS = b"#*$%&|<>"
#: Cutoffs from lenient to strict; a score above the cutoff is rejected.
GRID = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeat_words": [0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02],
    "long_words": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.5, 9.0, 8.5, 8.0],
    "short_words": [-1.5, -2.0, -2.25, -2.5, -2.75, -3.0, -3.25, -3.5, -3.75, -4.0],
}
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, lines with a word, of them repeated ones, words in repeated 3-word windows."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and x.strip(WHITE)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        covered = 0  # words before this place are counted
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(at, covered)
                covered = at + 3
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, WHITE))), len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated,
    )


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every row."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [counts(x.as_py()) for x in batch.column(2)]
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "stratum", *names])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, stratum string, {COUNTS}")


def scores() -> dict:
    """The rule scores as columns over the counts."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeat_words": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }


def below(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial X of n trials with probability p, summed exactly in logarithms."""
    if n <= 0:
        return 1.0
    i = np.arange(min(k, n) + 1, dtype=float)
    ratio = np.zeros(len(i))
    ratio[1:] = np.log((n - i[1:] + 1) / i[1:]) + np.log(p) - np.log1p(-p)
    logs = n * np.log1p(-p) + np.cumsum(ratio)
    top = logs.max()
    return float(min(1.0, np.exp(top) * np.exp(logs - top).sum()))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cutoffs(rows: DataFrame, labels: DataFrame, limit: float = 0.005, alpha: float = 0.05) -> DataFrame:
    """stratum and a cutoff column per rule (null: rejects nothing). One row per stratum that has good labelled rows."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1").select(F.col("doc_id").alias("labelled"))
    held = rows.filter(~base_failed()).join(good, F.col("doc_id") == F.col("labelled"), "left_semi")
    made = scores()
    tests = [F.sum((made[rule] > c).cast("long")).alias(f"{rule}_{k}") for rule, grid in GRID.items() for k, c in enumerate(grid)]
    seen = cut(held.groupBy("stratum").agg(F.count("*").alias("n"), *tests))
    pairs = max(1, seen.count() * len(GRID))

    def choose(frames):
        for frame in frames:
            out = {"stratum": frame["stratum"]}
            for rule, grid in GRID.items():
                chosen = []
                for _, row in frame.iterrows():
                    held_to = None
                    for k, c in enumerate(grid):
                        if below(int(row[f"{rule}_{k}"]), int(row["n"]), limit) > alpha / pairs:
                            break
                        held_to = c
                    chosen.append(held_to)
                out[rule] = pd.array(chosen, dtype="Float64")
            yield pd.DataFrame(out)

    return cut(seen.mapInPandas(choose, "stratum string, " + ", ".join(f"{r} double" for r in GRID)))


def judged(docs: DataFrame, labels: DataFrame, limit: float = 0.005, alpha: float = 0.05) -> DataFrame:
    """doc_id, counts, base_failed, the failed rules and kept for every row."""
    rows = cut(measured(docs))
    names = {r: f"cut_{r}" for r in GRID}
    limits = cutoffs(rows, labels, limit, alpha).withColumnsRenamed(names)
    made = scores()
    failed = F.filter(F.array(*[F.when(made[r] > F.col(names[r]), F.lit(r)) for r in GRID]), lambda x: x.isNotNull())
    out = with_lookup(rows, limits, "stratum").withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(*names.values())
