"""Scores of the URL filter (op7) against brute force: unseen n-grams back off, and no n-gram is left out."""

import math
import random

import pytest

from moderata.llm import url_filter

TAUGHT = [("ab/c", 1, 0), ("ab/d", 1, 0), ("xb/c", 0, 1), ("ab/c", 1, 0), ("yb/é", 0, 1)]
SEEN = ["ab/c", "zzz", "xb/d", "abab", "b/cq", "q", "éb/c/ab/中"]


def framed(seen):
    return "\u0002" * 4 + seen + "\u0003"


def brute(taught, seen):
    counts = {}
    for text, *kinds in taught:
        for at in range(4, len(framed(text))):
            for k in range(5):
                for side in (0, 1):
                    counts.setdefault(framed(text)[at - k : at + 1], [0, 0])[side] += kinds[side]

    def p(gram, side):
        less = p(gram[1:], side) if len(gram) > 1 else 1 / 256
        after = [c[side] for g, c in counts.items() if len(g) == len(gram) and g[:-1] == gram[:-1]]
        n, kinds = sum(after), sum(x > 0 for x in after)
        return (counts.get(gram, [0, 0])[side] + kinds * less) / (n + kinds) if n + kinds else less

    text = framed(seen)
    return sum(math.log(p(text[at - 4 : at + 1], 0)) - math.log(p(text[at - 4 : at + 1], 1)) for at in range(4, len(text))) / (len(text) - 4)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_scores_equal_brute_force_with_unseen_grams(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT", hot)  # nothing broadcast, or everything
    model = url_filter.language_models(spark.createDataFrame(TAUGHT, "seen string, good int, bad int"))
    got = {r.seen: r.score for r in url_filter.scores(spark.createDataFrame([(x,) for x in SEEN], "seen string"), model).collect()}
    assert got.keys() == set(SEEN)
    for seen in SEEN:
        assert math.isclose(got[seen], brute(TAUGHT, seen), abs_tol=1e-9), seen


def test_every_gram_stays(spark):
    rng = random.Random(4)
    taught = [("".join(chr(rng.randrange(0x4E00, 0x9E00)) for _ in range(1000)), k % 2, 1 - k % 2) for k in range(40)]
    grams = {framed(t)[at - k : at + 1] for t, *_ in taught for at in range(4, len(framed(t))) for k in range(5)}
    assert len(grams) > 1 << 17
    assert url_filter.language_models(spark.createDataFrame(taught, "seen string, good int, bad int")).count() == len(grams)
