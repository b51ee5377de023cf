"""Toxicity scores by gradient-boosted trees over dense features, calibrated by isotonic regression.

The classifier is fitted on a bounded sample: the ``SAMPLE`` labelled rows
with the smallest hash of their id among those allowed for training. The
sample is split three ways by hash. One part gives the lexicon (words, and
stems of 4 to 6 characters, that mark toxic documents, at most ``LEXICON`` of
each), the second trains the trees, the third calibrates them, so no part is
scored with what was learned from itself. Features are densities of lexicon
words, stems and a short fixed list, proximity of hits to second-person words,
capitals, punctuation and obfuscated spellings. Scores never use labels, lang,
source or doc_id.

Defined cases: null text is the empty text and gets the score of an empty
text; ids without label, null labels and null ids aren't trained on; several
labels of an id count as the largest; without training rows every score is 0,
with one class only it is that class's share, smoothed. ``score`` is
monotone in the calibrated value, with the uncalibrated one breaking ties.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SAMPLE, LEXICON = 16_000, 3_000
TREES, DEPTH = 20, 4
THRESHOLD = 0.3
#: Common insults and second-person words.
INSULTS = "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown dumb fool jerk creep ugly".split()
SECOND_PERSON = set("you your yours you're u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su".split())
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»¡¿…"
_LEET = str.maketrans("013457@$!*", "oieastasi*")
_MIXED = re.compile(r"(?=\S*[A-Za-z])[A-Za-z]+[0-9@$*!]+[A-Za-z]+")
_SHOUT = re.compile(rb"\b[A-Z]{2,}\b")
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
FEATURES = ["words", "stems", "listed", "word_hits", "stem_hits", "listed_hits", "word_weight", "stem_weight", "nearness", "capitals", "shouted", "punctuation", "exclamations", "questions", "obfuscated", "obfuscated_hits", "length"]


def tokens(text: str) -> list[str]:
    return [w.strip(_EDGE) for w in text.lower().split()]


def terms(text: str) -> set[str]:
    """The words of a text, and the stems of longer ones (marked by a leading ^)."""
    words = {w for w in tokens(text) if w}
    return words | {f"^{w[:k]}" for w in words for k in (4, 5, 6) if len(w) > k}


def features(text: str, words: dict[str, float], stems: dict[str, float], listed: set[str]) -> list[float]:
    found = tokens(text)
    n = max(1, len(found))
    distinct = set(found)
    raw = text.encode()
    letters = max(1, len(raw) - len(raw.translate(None, _UPPER + _LOWER)))
    odd = _MIXED.findall(text)
    plain = [w.lower().translate(_LEET) for w in odd]
    stemmed = {w for w in distinct if w not in words and any(w[:k] in stems for k in (4, 5, 6) if len(w) > k)} if stems else set()
    hits = (distinct & words.keys()) | (distinct & listed) | stemmed
    word_hits = stem_hits = listed_hits = 0
    nearness = 0.0
    if hits:
        last_you, last_hit = None, None
        for k, w in enumerate(found):
            if w in SECOND_PERSON:
                last_you = k
                if last_hit is not None:
                    nearness = max(nearness, 1 / (k - last_hit))
            if w in hits:
                last_hit = k
                if last_you is not None:
                    nearness = max(nearness, 1 / max(1, k - last_you))
                word_hits += w in words
                listed_hits += w in listed
                stem_hits += w in stemmed
    return [
        word_hits / n, stem_hits / n, listed_hits / n, float(word_hits), float(stem_hits), float(listed_hits),
        max((words[w] for w in distinct & words.keys()), default=0.0),
        max((stems[w[:k]] for w in stemmed for k in (4, 5, 6) if w[:k] in stems), default=0.0),
        nearness,
        (len(raw) - len(raw.translate(None, _UPPER))) / letters, len(_SHOUT.findall(raw)) / n,
        (len(raw) - len(raw.translate(None, _PUNCTUATION))) / max(1, len(raw)), raw.count(b"!") / n, raw.count(b"?") / n,
        len(odd) / n, float(sum(w in words or w in listed for w in plain)), math.log1p(len(found)),
    ]


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _lexicon(part: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log-odds of marking a toxic document."""

    def run(batches):
        for batch in batches:
            found = [(t, y) for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in terms(text)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([y for _, y in found], pa.int64())], ["term", "toxic"])

    n, bad = part.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad:
        return {}, {}
    seen = part.select("text", "toxic").mapInArrow(run, "term string, toxic long").groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("bad") + 0.5) / (n - bad + 1.0))
    marked = seen.withColumn("weight", odds).filter("bad >= 3 and weight > 2")
    found = []
    for stem in (False, True):
        top = marked.filter(F.col("term").startswith("^") == F.lit(stem)).orderBy(F.desc("weight"), "term").limit(LEXICON)
        found.append({r.term[1:] if stem else r.term: float(r.weight) for r in top.select("term", "weight").collect()})
    return found[0], found[1]


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with columns __held_out, __score and __predicted."""
    taught = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    taught = taught.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    picked = taught.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))  # at most ``sample`` rows of two numbers
    rows = cut(rows.select("text", "toxic", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(10)).alias("part")))

    words, stems = _lexicon(rows.filter("part < 5"))
    listed = set(INSULTS)

    def dense(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, words, stems, listed) for t in texts], dtype=object)

    measured = F.pandas_udf(dense, "array<double>")
    fitted = rows.filter("part >= 5").select("toxic", "part", array_to_vector(measured("text")).alias("features")).withColumn("label", F.col("toxic").cast("double"))
    fitted = cut(fitted.repartition(4))  # at most ``sample`` rows of numbers
    trained, kept = fitted.filter("part < 8"), fitted.filter("part >= 8")
    n, bad = trained.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    out = docs.withColumn("__held_out", held_out(F.col("doc_id")))
    if not n or bad in (0, n):
        share = (bad + 0.5) / (n + 1) if n else 0.0
        return out.withColumn("__score", F.lit(float(share))).withColumn("__predicted", (F.col("__score") >= THRESHOLD).cast("int"))
    learner = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, minInstancesPerNode=3, seed=11, predictionCol="__class", featuresCol="__features")
    learner = learner.setRawPredictionCol("__raw").setProbabilityCol("__probability")
    trees = learner.fit(trained.withColumnRenamed("features", "__features"))
    raw = lambda df: df.withColumn("__p", vector_to_array("__probability")[1])
    calibration = raw(trees.transform(kept.withColumnRenamed("features", "__features")))
    out = raw(trees.transform(out.withColumn("__features", array_to_vector(measured(text)))))
    share = F.col("__p")
    if kept.limit(1).count():
        steps = IsotonicRegression(featuresCol="__p", labelCol="label", predictionCol="__steps").fit(calibration)
        out = steps.transform(out)
        share = 0.99 * F.col("__steps") + 0.01 * F.col("__p")
    out = out.withColumn("__score", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    names = [*[F.col(f"`{c}`") for c in docs.columns], F.col("__held_out"), F.col("__score")]
    return out.select(*names).withColumn("__predicted", (F.col("__score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic."""
    return scored(docs, labels).filter("__predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])
