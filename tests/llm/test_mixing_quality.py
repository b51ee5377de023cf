"""Mixing (op6) and quality rules (op5) against plain arithmetic."""

import math
import re

import pytest

from moderata.llm import mixing, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, total, cap):
    """Targets by resharing the excess until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if each * weight[s] > cap * sizes[s]}
        if not above:
            return out | {s: each * weight[s] for s in open_}
        out |= {s: float(cap * sizes[s]) for s in above}
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def test_targets_and_taken(spark, rows, docs):
    got = mixing.mixed_sizes(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORDS.findall(r[1] or ""))
    want = filled(size, (3, 1, 2), 1.5, 2.0)
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken in (0, r.size, 2 * r.size)
    for source in size:
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - want[source]) <= 2 * max(r.size for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(docs).collect()))


def test_nested_thresholds_meet_budgets_closely(spark):
    many = [(k, " ".join(["w"] * (1 + k % 7)), None, "big" if k % 3 else "small", 0) for k in range(3000)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_sizes(docs).groupBy("source", "target").sum("taken").collect()
    for source, target, taken in got:
        assert abs(target - taken) <= 7


def test_mixed_documents_repeat_rows(spark, docs):
    copies = {str(r.doc_id): r.copies for r in mixing.mixed_sizes(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    found = {}
    for r in out.collect():
        found[str(r.doc_id)] = found.get(str(r.doc_id), 0) + 1
    rows_of = {}
    for r in docs.collect():
        rows_of[str(r.doc_id)] = rows_of.get(str(r.doc_id), 0) + 1
    assert found == {k: n * rows_of[k] for k, n in copies.items() if n}


def test_sources_past_the_broadcast_bound(spark, docs, monkeypatch):
    plain = sorted(map(str, mixing.mixed_sizes(docs).collect()))
    real = mixing.with_lookup
    monkeypatch.setattr(mixing, "with_lookup", lambda a, b, on: real(a, b, on, most_rows=0, salts=3))
    assert sorted(map(str, mixing.mixed_sizes(docs).collect())) == plain


def test_no_documents(spark, empty):
    assert mixing.mixed_sizes(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.judged(empty, labels).count() == 0


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    dups = sum(x in lines[:k] for k, x in enumerate(lines))
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1} if len(words) < 2000 else {w for w in set(windows) if windows.count(w) > 1}
    covered = {j for k, w in enumerate(windows) if w in often for j in range(k, k + 3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), dups, len(covered)


def test_counts(rows):
    for r in rows:
        if r[1] is None or len(r[1]) < 20_000:
            assert quality_rules.counts(r[1]) == plain_counts(r[1]), r[0]


@pytest.mark.parametrize("k,n,p", [(0, 100, 0.01), (3, 50, 0.1), (50, 50, 0.3), (7, 2000, 0.005), (0, 0, 0.5)])
def test_binomial(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n else 1.0
    assert math.isclose(quality_rules.below(k, n, p), min(1.0, want), rel_tol=1e-9)


def test_cutoffs_hold_false_rejection(spark):
    table = []
    for k in range(6000):
        bad = k % 5 == 0
        text = " ".join(f"w{(k * 31 + j) % 997}x{j}" for j in range(60)) + (" ### $$$ %%%" * 12 if bad or k % 2000 == 1 else "")
        table.append((k, text, "en" if k % 2 else None, int(not bad)))
    docs = spark.createDataFrame([(a, b, c) for a, b, c, _ in table], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(a, d) for a, _, _, d in table] + [(None, 1), (10**9, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judged(docs, labels).collect()}
    assert len(got) == 6000
    rejected_good = sum(not got[k].kept for k, _, _, q in table if q == 1)
    rejected_bad = sum(not got[k].kept for k, _, _, q in table if q == 0)
    assert rejected_good <= 0.01 * 4800 and rejected_bad > 0.9 * 1200


def test_without_labels_only_the_base_rule_counts(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality_rules.judged(docs, labels).collect():
        assert r.kept == (not r.base_failed)
