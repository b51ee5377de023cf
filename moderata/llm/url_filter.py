"""URL filter: host and path rules first, then the ratio of two character language models.

Accepted and rejected URLs (those that an allow or a block rule decides) train
two variable-order Markov models over host and path: n-grams of up to ``ORDER``
characters of context are counted in both, and smoothed by Witten-Bell
interpolation with the next shorter context. A URL's score is the mean over its
characters of the difference of log probabilities. A character that a context
of a model lacks has the context's back-off weight times its probability in the
next shorter context; a context that a model lacks has the next shorter one's
probabilities. A fifth of the ruled URLs isn't counted
but calibrates the cutoff: it lies half-way between the score below which
``FALSE_BLOCKS`` of the held accepted URLs lie and that above which as few of
the rejected do, and never above the former. URLs without a rule that score
lower are blocked.

Everything is DataFrame functions. Counts cover all ruled URLs, and the models
keep every n-gram. Each distinct n-gram to score meets them once, in joins by
n-gram, and its ratio goes back to the URLs: those of n-grams with more than a
part in ``HOT`` of all places (fewer than ``HOT`` rows) are broadcast, all
others are joined. Scores are computed once per distinct host and path.

Defined cases: a null url, or one without ``://``, has empty host and path and
no rule; equal rows are judged alike; a url with empty host and path, and every
url without a rule when there are no ruled ones to learn both kinds from, is
allowed; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ORDER, HOT, FALSE_BLOCKS = 4, 10_000, 0.01
#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def ruled(rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as host and path), and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == at) | F.col("host").endswith(f".{at}")) & F.col("path").startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _framed(text: Column) -> Column:
    return F.concat(F.lit("\u0002" * ORDER), text, F.lit("\u0003"))


def _gram(context: int) -> Column:
    """The character at ``at`` with ``context`` characters before it."""
    return F.substring("framed", F.col("at") - context, F.lit(context + 1))


def _places(rows: DataFrame) -> DataFrame:
    """A row for each character of ``framed`` that is predicted."""
    return rows.withColumn("at", F.explode(F.sequence(F.lit(ORDER + 1), F.length("framed"))))


def _after(level: DataFrame) -> DataFrame:
    """Of each context of ``level``: how many characters and kinds of character follow it, accepted and rejected."""
    return level.groupBy("context").agg(
        F.sum("good").alias("good_n"), F.sum("bad").alias("bad_n"),
        F.count_if(F.col("good") > 0).alias("good_kinds"), F.count_if(F.col("bad") > 0).alias("bad_kinds"),
    )


def _smoothed(side: str) -> Column:
    """Witten-Bell: the counts of a context interpolated with the next shorter one's probability; the latter alone without counts."""
    n, kinds = F.col(f"{side}_n"), F.col(f"{side}_kinds")
    p = (F.col(side) + kinds * F.col(f"{side}_less")) / (n + kinds)
    return F.when(n + kinds > 0, p).otherwise(F.col(f"{side}_less"))


def _ratio() -> Column:
    return F.log("good_p") - F.log("bad_p")


def language_models(taught: DataFrame) -> DataFrame:
    """gram, size, counts and probabilities of its last character after the others (accepted, rejected), ratio: difference of their logs.

    ``taught`` has ``seen`` (host and path), ``good`` and ``bad`` (0 or 1).
    """
    placed = _places(taught.withColumn("framed", _framed(F.col("seen"))))
    grams = placed.select("good", "bad", F.explode(F.array(*[_gram(k) for k in range(ORDER + 1)])).alias("gram"))
    counts = cut(grams.groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).withColumn("size", F.length("gram")))
    shorter, levels = None, []
    for k in range(ORDER + 1):
        level = counts.filter(F.col("size") == k + 1).withColumn("context", F.substring("gram", 1, k))
        level = _with_less(level.join(_after(level), "context"), shorter)
        shorter = cut(level.select("gram", "size", "good", "bad", _smoothed("good").alias("good_p"), _smoothed("bad").alias("bad_p")))
        levels.append(shorter)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.union(level)
    return whole.withColumn("ratio", _ratio())


def _with_less(level: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """``level`` with the probabilities in the next shorter context."""
    if shorter is None:
        return level.withColumn("good_less", F.lit(1 / 256)).withColumn("bad_less", F.lit(1 / 256))
    less = shorter.select(F.col("gram").alias("rest"), F.col("good_p").alias("good_less"), F.col("bad_p").alias("bad_less"))
    return level.withColumn("rest", F.expr("substring(gram, 2)")).join(less, "rest")


def _ratios(wanted: DataFrame, model: DataFrame) -> DataFrame:
    """gram, ratio of every gram of ``wanted`` (distinct, of ORDER + 1 characters), also of those that the models lack."""
    shorter = None
    for k in range(ORDER + 1):
        mine = wanted.select(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).distinct().withColumn("context", F.substring("gram", 1, k))
        known = model.filter(F.col("size") == k + 1)
        after = _after(known.withColumn("context", F.substring("gram", 1, k)))
        level = mine.join(known.select("gram", "good", "bad"), "gram", "left").join(after, "context", "left").na.fill(0, ["good", "bad", "good_n", "bad_n", "good_kinds", "bad_kinds"])
        shorter = cut(_with_less(level, shorter).select("gram", _smoothed("good").alias("good_p"), _smoothed("bad").alias("bad_p")))
    return shorter.select("gram", _ratio().alias("ratio"))


def scores(seen: DataFrame, model: DataFrame) -> DataFrame:
    """seen, score of every row of ``seen`` (one text column): the mean ratio of its characters."""
    rows = _places(seen.select("seen", _framed(F.col("seen")).alias("framed"))).select("seen", _gram(ORDER).alias("gram"))
    wanted = cut(rows.groupBy("gram").agg(F.count("*").alias("n")))
    total = wanted.agg(F.sum("n")).first()[0] or 0
    ratios = cut(wanted.join(_ratios(wanted, model).withColumnRenamed("gram", "gram2"), F.col("gram") == F.col("gram2")).select("gram", "ratio", "n"))
    often = F.col("n") * HOT > total
    hot = F.broadcast(ratios.filter(often).select("gram", "ratio"))  # fewer than HOT rows
    found = rows.join(hot, "gram").select("seen", "ratio")
    others = rows.join(hot, "gram", "left_anti").join(ratios.filter(~often).select("gram", "ratio").hint("merge"), "gram").select("seen", "ratio")
    return found.union(others).groupBy("seen").agg(F.avg("ratio").alias("score"))


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) of every row."""
    split = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = ruled(rules)
    rows = split.withColumn("rule", name).withColumn("decided", verdict).withColumn("seen", F.concat("host", "path"))
    held = F.pmod(F.xxhash64("seen"), F.lit(5)) == 0
    taught = rows.filter(F.col("decided").isNotNull() & ~held)
    model = language_models(taught.select("seen", (F.col("decided") == "allow").cast("int").alias("good"), (F.col("decided") == "block").cast("int").alias("bad")))
    known = rows.filter(held & F.col("decided").isNotNull()).select("seen", "decided").distinct()
    unruled = rows.filter("decided is null and seen != ''").select("seen")
    scored = cut(scores(unruled.union(known.select("seen")).distinct(), model))
    measured = scored.join(known, "seen")
    good, bad = (F.when(F.col("decided") == what, F.col("score")) for what in ("allow", "block"))
    found = measured.agg(
        F.percentile_approx(good, F.lit(FALSE_BLOCKS), F.lit(10000)).alias("least_good"), F.percentile_approx(bad, F.lit(1 - FALSE_BLOCKS), F.lit(10000)).alias("most_bad")
    ).first()
    able = found.least_good is not None and found.most_bad is not None
    cutoff = min(found.least_good, (found.least_good + found.most_bad) / 2) if able else 0.0
    both = taught.agg(F.max((F.col("decided") == "allow").cast("int")), F.max((F.col("decided") == "block").cast("int"))).first()
    blocked = F.coalesce(F.col("score") < F.lit(cutoff), F.lit(False)) if able and all(both) else F.lit(False)
    said = rows.join(scored.withColumnRenamed("seen", "seen2"), F.col("decided").isNull() & (F.col("seen") == F.col("seen2")), "left")
    return said.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
