"""Components (op4, op10) and near-duplicate documents against brute force."""

import random
import re

import numpy as np
import pytest

from moderata.llm import near_dedup
from moderata.llm.graph import components

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


class Parts:
    def __init__(self, names):
        self.up = {n: n for n in names}

    def root(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("kind", ["none", "loop", "path", "random", "star"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "none": [], "loop": [(7, 3), (3, 7), (7, 7), (9, 9)], "path": [(k, k + 1) for k in range(40)],
        "random": [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(80)], "star": [(0, k) for k in range(30)] + [(30, k) for k in range(29, 60)],
    }[kind]
    parts = Parts({x for e in edges for x in e})
    for a, b in edges:
        parts.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: parts.root(x) for x in parts.up}


def brute(rows, percent):
    sets = [shingles(r[1]) for r in rows]
    parts = Parts(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parts.join(a, b)
    return sets, parts


def near_copies(n, rng):
    """Chains of copies, each a little changed from an earlier one."""
    words = [f"w{rng.randrange(3000)}" for _ in range(130)]
    made = [words]
    for _ in range(n - 1):
        copy = list(rng.choice(made))
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        made.append(copy)
    return [" ".join(w) for w in made]


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_equal_brute_force(spark, rows, percent, monkeypatch):
    rng = random.Random(percent)
    table = list(rows) + [(100 + k, t, None, None, 0, *rows[0][5:]) for k, t in enumerate(near_copies(50, rng) + near_copies(20, rng))]
    sets, parts = brute(table, percent)
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, key string, node int, label string, features int, size int, root string, part int, bucket int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.grouped(docs, percent).collect())
    want = []
    for k, r in enumerate(table):
        ids = [table[j][0] for j in range(len(table)) if parts.root(j) == parts.root(k) and (sets[k] or j == k) and table[j][0] is not None]
        least = min(ids) if ids else None
        want.append((str(r[0]), len(sets[k]), str(least), r[0] == least))
    assert got == sorted(want)


def test_blocks_lose_no_link():
    rng = random.Random(9)
    sets = [np.unique(np.array([hash(x) & (2**63 - 1) for x in shingles(t)], np.uint64)) for t in near_copies(60, rng)]
    whole = Parts(range(60))
    for a, b in near_dedup.confirmed_links(sets, 85):
        whole.join(a, b)
    cut = Parts(range(60))
    side = [rng.randrange(3) for _ in sets]
    for p in range(3):
        for q in range(p, 3):
            mine = [k for k in range(60) if side[k] in (p, q)]
            for a, b in near_dedup.confirmed_links([sets[k] for k in mine], 85, [side[k] for k in mine] if p != q else None):
                cut.join(mine[a], mine[b])
    assert [whole.root(k) for k in range(60)] == [cut.root(k) for k in range(60)]


def test_deduplicated_keeps_one_of_each(spark, rows, docs):
    sets, parts = brute(rows, 80)
    kept = near_dedup.deduplicated(docs, 80)
    assert kept.columns == docs.columns
    got = kept.collect()
    with_words = {parts.root(k) for k in range(len(rows)) if sets[k]}
    assert len([r for r in got if shingles(r.text)]) == len(with_words)
    assert len([r for r in got if not shingles(r.text)]) == sum(not s for s in sets)


def test_no_documents(spark, empty):
    assert near_dedup.grouped(empty).count() == 0
    assert near_dedup.deduplicated(empty).count() == 0
