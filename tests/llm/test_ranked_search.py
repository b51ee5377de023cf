"""Ranked lexical search (op11) against brute force."""

import math
import re
from collections import Counter

import pytest

from llm_tables import texts
from moderata.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def expected(rows, items, top=20):
    docs = [(r[0], terms(r[1])) for r in rows]
    docs = [(i, t, Counter(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(len(t) for _, t, _ in docs)
    df = Counter(t for _, _, bag in docs for t in bag)
    out = []
    for item, text in items:
        scored = []
        for doc_id, all_, bag in docs:
            m = 75 + 25 * len(all_) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return sorted(out, key=str)


ITEMS = [(1, " ".join(texts()[0].split()[:12])), (7, texts()[4].upper()), (2, "idiot MORON one two"), (3, None), (4, "no such words zzz"), (5, "中文字符测试 é́ x can't"), (5, "one"), (None, "same line here")]


def test_ranks(spark, docs, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = [(100 + k, rows[0][1], *rows[0][2:]) for k in range(30)]  # one class of many copies
    table = list(rows) + more
    got = sorted((tuple(r) for r in ranked_search.ranked(spark.createDataFrame(table, docs.schema), items).collect()), key=str)
    want = expected(table, ITEMS)
    assert got == want and len(want) > 40


def test_items_in_blocks(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEMS", 2)
    monkeypatch.setattr(ranked_search, "_CELLS", 7)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in ranked_search.ranked(docs, items, top=3).collect()), key=str)
    assert got == expected(rows, ITEMS, 3)


@pytest.mark.parametrize("which", ["docs", "items"])
def test_empty(spark, docs, empty, which):
    items = spark.createDataFrame([] if which == "items" else ITEMS, "item_id long, text string")
    assert ranked_search.ranked(empty if which == "docs" else docs, items).collect() == []
