"""Cross-tokenizer alignment (op12) against plain loops over the libraries' own tokens."""

import hashlib
import json
from collections import Counter, defaultdict

import numpy as np
import pytest

from moderata.llm import alignment, bpe


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    back = bpe._byte_characters()
    vocab = {i: bytes(back[c] for c in t) for t, i in json.load(open(path_a, encoding="utf-8"))["model"]["vocab"].items() if all(c in back for c in t)}
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    return a, vocab, b


def pieces_b(b, ids):
    out = []
    for i in ids:
        p = b.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
    return out


def expected(rows, tokenizers):
    a, vocab, b = tokenizers
    done, pairs, docs = [], Counter(), defaultdict(set)
    for at, r in enumerate(rows):
        text = r[1]
        links, groups, n_a, n_b = [], "", 0, 0
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw_a, raw_b = [vocab[i] for i in ids_a], pieces_b(b, ids_b)
            whole = (" " + text).encode()
            if b"".join(raw_a) == whole == b"".join(raw_b):
                n_a, n_b = len(ids_a), len(ids_b)
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                parts, i, j = [], 0, 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    x, y = ends_a.index(end), ends_b.index(end)
                    parts.append(",".join(map(str, ids_a[i : x + 1])) + "|" + ",".join(map(str, ids_b[j : y + 1])))
                    links.append((ids_a[x], ids_b[y]))
                    i, j = x + 1, y + 1
                groups = hashlib.sha256(";".join(parts).encode()).hexdigest()
        pairs.update(links)
        for p in links:
            docs[p].add(at)
        done.append((r[0], n_a, n_b, links, groups))
    highest = Counter()
    for (_, y), n in pairs.items():
        highest[y] = max(highest[y], n)
    out = [(d, x, y, len(ls), len(ls), sum(pairs[p] == highest[p[1]] for p in ls), sum(pairs[p] for p in ls), g) for d, x, y, ls, g in done]
    return out, {p: (len(docs[p]), n, n == highest[p[1]]) for p, n in pairs.items()}


def small(rows):
    """Without the very long text, which the plain loops take too long for."""
    return [r for r in rows if r[1] is None or len(r[1]) < 20_000]


@pytest.mark.parametrize("block", [1 << 23, 600])
def test_scores_and_pairs(spark, docs, rows, tokenizers, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "_SLICE", 500)
    table = small(rows)
    frame = spark.createDataFrame(table, docs.schema)
    want, pairs = expected(table, tokenizers)
    assert sorted(map(str, (tuple(r) for r in alignment.scored(frame).collect()))) == sorted(map(str, want))
    got = {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in alignment.pair_counts(frame).collect()}
    assert got == pairs and any(n > d for d, n, _ in pairs.values())


def test_planes_round_trip():
    rng = np.random.default_rng(3)
    for n_docs in (1, 7, 40, 3000):
        keys, docs = rng.integers(0, 30, 4000), np.sort(rng.integers(0, n_docs, 4000))
        names, at, ends, raw, _ = alignment.planes(keys, docs, n_docs)
        found = Counter()
        for k, name in enumerate(names.tolist()):
            for cell in range(at[k], at[k + 1]):
                for d in alignment.plane_members(raw[ends[cell] : ends[cell + 1]], n_docs).tolist():
                    found[name, d] += 1 << (cell - at[k])
        assert found == Counter(zip(keys.tolist(), docs.tolist()))


def test_empty_table(spark, empty):
    assert alignment.scored(empty).collect() == []
