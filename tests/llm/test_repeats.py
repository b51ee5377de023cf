"""Repeated strings by merged Burrows-Wheeler transforms (op13) against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from moderata.llm import repeats

N = repeats.LENGTH


def expected(rows):
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(raw[k : k + N] for _, raw in raws for k in range(len(raw) - N + 1))
    out = []
    for doc_id, raw in raws:
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - N + 1):
            if seen[raw[k : k + N]] > 1:
                gone[k : k + N] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def passages():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß中") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(160), prose(50)
    texts = [prose(rng.randrange(5, 90)) + passage + prose(rng.randrange(5, 90)) for _ in range(12)]
    texts += [prose(30) + short + prose(30) for _ in range(5)]
    texts += [prose(20) + passage[100:] + prose(3) + passage[:900], passage[:390], passage.encode()[:399].decode(errors="ignore"), passage.encode()[:402].decode(errors="ignore")]
    texts += ["b" * 1500, "ab" * 700, "c" * 400, "d" * 401, prose(40) + "xyz " * 300]
    return texts


@pytest.fixture(scope="module")
def table(rows):
    return [r for r in rows if r[1] is None or len(r[1]) < 20_000] + [(500 + k, t, *rows[0][2:]) for k, t in enumerate(passages())]


def got(spark, table, schema):
    return sorted(map(str, (tuple(r)[:5] for r in repeats.without_repeats(spark.createDataFrame(table, schema)).collect())))


def test_documents(spark, docs, table):
    want = expected(table)
    assert sum(w[2] > 0 for w in want) > 15
    assert got(spark, table, docs.schema) == sorted(map(str, want))


def test_crowded_keys_and_small_pieces(spark, docs, table, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 2)
    monkeypatch.setattr(repeats, "_PIECE", 1000)
    assert got(spark, table, docs.schema) == sorted(map(str, expected(table)))


def test_empty_table(spark, empty):
    assert repeats.without_repeats(empty).collect() == []


@pytest.mark.parametrize("shard", [1 << 18, 2000])
def test_merged_shards(monkeypatch, shard):
    """Merging many shards gives the windows that counting gives, weights included."""
    monkeypatch.setattr(repeats, "SHARD", shard)
    rng = random.Random(shard)
    base = bytes(rng.randrange(97, 100) for _ in range(3000))
    segments = []
    for _ in range(40):
        at = rng.randrange(2400)
        piece = bytearray(base[at : at + N + rng.randrange(repeats.STEP)])
        if rng.random() < 0.5:
            piece[rng.randrange(len(piece))] = 122
        segments.append(bytes(piece))
    weights = [rng.choice((1, 1, 1, 3)) for _ in segments]
    seen = Counter()
    for s, w in zip(segments, weights):
        for k in range(len(s) - N + 1):
            seen[s[k : k + N]] += w
    found = repeats.repeated_windows(segments, weights)
    for s, f in zip(segments, found):
        assert f.tolist() == [seen[s[k : k + N]] > 1 for k in range(len(s) - N + 1)]


def test_common_prefixes():
    """The merge's order and common prefixes are those of sorting all suffixes."""
    rng = np.random.default_rng(5)
    step = repeats.SYMBOL
    sizes = [450 - step + 1, 500 - step + 1, 430 - step + 1]
    symbols = [np.repeat(rng.integers(1, 4, -(-n // 50)), 50)[:n].astype(np.int32) for n in sizes]
    shards = [repeats.Shard(s, np.arange(len(s)), np.full(len(s), len(s) - 1)) for s in symbols]
    interleave, common = repeats.merge(shards, 6)
    suffixes, at = [], [0] * 3
    for k in interleave.tolist():
        node = int(shards[k].order[at[k]])
        at[k] += 1
        s = symbols[k]
        suffixes.append([] if node >= len(s) else s[node::step].tolist())
    assert suffixes == sorted(suffixes)
    for a, b, c in zip(suffixes, suffixes[1:], common[1:].tolist()):
        same = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert c == same or (a == b and c >= same)


def test_orders_of_symbols(monkeypatch):
    rng = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 5), (5000, 40), (5000, 1 << 18), (3000, (1 << 31) - 1)):
        columns = [rng.integers(0, top, n).astype(np.int32) for _ in range(6)]
        columns[0][: n // 2] = 7 % top
        want = sorted(range(n), key=lambda k: tuple(c[k] for c in columns))
        assert repeats._stable_order(columns).tolist() == want
        assert repeats._by_symbol(columns[1]).tolist() == sorted(range(n), key=lambda k: columns[1][k])
    hashes = rng.integers(0, 1 << 63, 500).astype(np.uint64)[rng.integers(0, 500, 4000)]
    numbers = repeats._numbered(hashes)
    assert numbers.min() == 1 and len(set(zip(hashes.tolist(), numbers.tolist()))) == len(set(hashes.tolist())) == len(set(numbers.tolist()))


def test_a_shard_is_sorted_by_two_columns_at_once(monkeypatch):
    sorts, sort = [], np.sort
    monkeypatch.setattr(repeats.np, "sort", lambda *a, **k: sorts.append(len(a[0])) or sort(*a, **k))
    rng = np.random.default_rng(4)
    segments = [rng.integers(97, 123, 527, np.uint8).tobytes() for _ in range(60)]
    found = repeats.repeated_windows(segments + [segments[0][50:500]], [1] * 61)
    assert [f.sum() for f in found] == [51, *[0] * 59, 51]
    columns = N // repeats.SYMBOL + -(-repeats.STEP // repeats.SYMBOL)
    assert len(sorts) <= 1 + columns // 2  # before: one a column, and one a round of the merge
