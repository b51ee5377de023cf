"""BPE, chunk reuse (op3) and rANS files (op9) against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from moderata.llm import bpe, chunk_bpe, rans
from moderata.llm.common import fresh_folder


@pytest.fixture(scope="module")
def coder():
    return bpe.load(bpe.default_path())


def library(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_batches_encode_as_the_library(coder):
    rng = random.Random(1)
    letters = list("abst'srevmlld  \n\t\r  12٣½!?#%éßñ中あ🎉́ “'")
    batch = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(4000)]
    batch += ["<|endoftext|>", "a<|endoftext|> b", "can't we'll I'd they've 're", "", None, "x" * 5000, " " * 100 + "a", "\x85\x1c\x1d a\x1fb"]
    ids, at = coder.encode(pa.array(batch))
    for k, text in enumerate(batch):
        want = library(coder, text)
        got = ids[at[k] : at[k + 1]]
        assert got.tolist() == want, text
        assert coder.decode(got) == coder.tokenizer.decode(want, skip_special_tokens=False).encode()


def test_joins_of_chunks_are_repaired(coder):
    rng = random.Random(2)
    letters = list("abst'srevmlld  \n\t\r  12½!?#%éßñ中あ🎉 “'")
    batch = ["".join(rng.choice(letters) for _ in range(rng.randrange(6000))) for _ in range(120)]
    batch += ["中" * 9000, " " * 9000, "a" * 30000, "x y" * 9000 + "<|endoftext|>" + "z " * 4000, "", None]
    for text, ids in zip(batch, chunk_bpe.encode_texts(coder, pa.array(batch))):
        assert ids.tolist() == library(coder, text)


def test_equal_passages_give_equal_chunks():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n)).encode()
    passage = text(20_000)
    found = []
    for t in (text(3_000) + passage + text(500), text(77) + passage):
        data = np.frombuffer(t, np.uint8)
        begin, stop, _ = chunk_bpe.chunk_spans(data, np.array([0, len(t)]))
        assert begin[0] == 0 and stop[-1] == len(t) and (begin[1:] == stop[:-1]).all()
        found.append({t[a:b] for a, b in zip(begin, stop)})
    assert sum(map(len, found[0] & found[1])) > 0.6 * len(passage)


def test_documents(spark, docs, rows, coder):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunk_bpe.encoded_documents(docs).collect())
    want = []
    for r in rows:
        ids = library(coder, r[1])
        decoded = coder.tokenizer.decode(ids, skip_special_tokens=False)
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want)


def test_no_documents(spark, empty):
    assert chunk_bpe.encoded_documents(empty).count() == 0
    assert rans.round_trip(spark, empty).count() == 0


@pytest.mark.parametrize("n", [1, 3, 1023, 1024, 1025, 50_000])
def test_rans_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 50257
    table = rans.Table(rans.frequencies(np.bincount(ids)))
    state, words = rans.encode(ids, table)
    assert (rans.decode(state.copy(), words, n, table) == ids).all()


def test_rans_frequencies_keep_rare_ids():
    counts = np.ones(50257, np.int64)
    counts[7] = 10**12
    freq = rans.frequencies(counts)
    assert freq.sum() == 1 << rans.SCALE and freq.min() == 1


def test_rans_files(spark, docs, rows, coder, monkeypatch):
    files = rans.write_ids(docs, fresh_folder(spark, "test-rans"))
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in rans.read_ids(files).collect()]
    assert len(got) == len(rows)
    start = 0
    for doc_id, at, n, crc, ids in sorted(got, key=lambda r: r[1]):
        assert at == start and n == len(ids) and ids[-1] == rans.END_ID and crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    want = sorted([(str(r[0]), library(coder, r[1]) + [2]) for r in rows])
    assert sorted((str(r[0]), r[4]) for r in got) == want


def test_rans_damage_is_found(spark, docs):
    file = rans.write_ids(docs.limit(3), fresh_folder(spark, "test-damage"))
    place = file.first().place.removeprefix("file:")
    place = place[place.index("/tmp") :] if "/tmp" in place else place
    with open(place, "r+b") as f:
        f.seek(40)
        byte = f.read(1)
        f.seek(40)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="damaged"):
        rans.read_ids(file).collect()
