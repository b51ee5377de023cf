"""Improbable-feature digests (op2) against plain loops."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from moderata.llm import fingerprint
from moderata.llm.common import strings


def level(window):
    total = sum(round(n * math.log2(n) * 65536) for n in Counter(window).values())
    return 1000 - total * 1000 // (6 * 65536 * 64)


def features(text, rank):
    raw = text.encode()
    n = len(raw) - 63
    if n < 1:
        return []
    values = [int(rank[level(raw[k : k + 64])]) for k in range(n)]
    if n < 64:
        return [values.index(min(values))] if min(values) < 1023 else []
    points = Counter()
    for k in range(n - 63):
        run = values[k : k + 64]
        if min(run) < 1023:
            points[k + run.index(min(run))] += 1
    return sorted(p for p, c in points.items() if c >= min(16, n - 63))


@pytest.mark.parametrize("piece", [1 << 21, 700])
def test_features(piece, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(fingerprint, "PIECE", piece)
    batch = ["".join(rng.choice("abcdefghijk lmno\n") for _ in range(k)) for k in (0, 1, 63, 64, 65, 100, 126, 127, 128, 140, 141, 200, 1000, 3000)]
    batch += ["a" * 500, "é" * 90]
    column = pa.array(batch)
    rank = fingerprint.ranks(fingerprint.level_counts(column))
    windows = [level(t.encode()[k : k + 64]) for t in batch for k in range(len(t.encode()) - 63)]
    assert fingerprint.level_counts(column).tolist() == np.bincount(windows, minlength=1001).tolist() or piece == 700
    data, offsets = strings(column)
    places, owner = fingerprint._feature_places(data, offsets, rank)
    for k, text in enumerate(batch):
        assert (places[owner == k] - offsets[k]).tolist() == features(text, rank)


def test_likeness():
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ijklm\n") for _ in range(n))
    a, b = text(30_000), text(30_000)
    rank = fingerprint.ranks(fingerprint.level_counts(pa.array([a, b])))
    one, same, half, other, none, short = fingerprint.digests(pa.array([a, a, a[:15_000] + b[:15_000], b, "", "short"]), rank)
    assert fingerprint.likeness(one, same) == 1 and one.text() == same.text() and len(one.filters) > 1
    assert 0.3 < fingerprint.likeness(one, half) < 0.9 and fingerprint.likeness(one, other) < 0.05
    assert fingerprint.likeness(none, none) == 1 and fingerprint.likeness(none, one) == 0 and short.n == 1
    assert (fingerprint.parse(one.text()).filters == one.filters).all()


def test_documents(spark, docs, rows):
    got = {}
    for r in fingerprint.fingerprints(docs).collect():
        got.setdefault(str(r.doc_id), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    digest = {}
    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        sha = hashlib.sha256(changed.encode()).hexdigest()
        mine = [x for x in got[str(r[0])] if x.edited_sha256 == sha]
        assert mine and mine[0].n_chars == len(text)
        digest.setdefault(text, set()).add(mine[0].fingerprint)
        if changed == text:
            assert mine[0].near_edited == 1
    assert all(len(x) == 1 for x in digest.values())


def test_one_and_no_documents(spark, docs, empty):
    one = fingerprint.fingerprints(docs.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprint.fingerprints(empty).count() == 0
