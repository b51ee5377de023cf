"""WARC archives (op1) and the URL filter (op7)."""

import gzip
import hashlib
import random

import pytest

from moderata.llm import url_filter, warc
from moderata.llm.common import fresh_folder

SCHEMA = "page_id long, url string, html string, kept string, sha1 string, seen string"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(6)
    long = lambda n: "".join(rng.choice("<p>é text 中\r\n\r\nWARC/1.1 ") for _ in range(n))
    copied, big = long(1500), long(1_200_000)
    html = [copied, copied, "", None, "small", "small", big, big, long(700), copied, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000]
    urls = ["http://A.B.net/en/x", "https://Example.NET/en/1?q=http://z", "x", None, "://", "ftp://h#f", "http://h?q/a", "http://www.example.com/de/1", "http://xexample.com/de/", "http://é.org/fr/%20 x",
            "http://sub.org/fr/a#b", "http://example.net/en", "HTTP://NET/", "http://a.example.net/en/?x"]
    rows = [(k, u, h, "k", "s", "e") for k, (u, h) in enumerate(zip(urls, html))]
    return rows + [(9, urls[9], copied, "k", "s", "e"), (None, None, copied, "k", "s", "e"), (None, "http://n.net/", "null page", None, None, None)]


def test_round_trip(spark, pages):
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in warc.round_trip(spark, spark.createDataFrame(pages, SCHEMA)).collect())))
    kept = {}
    for p, _, h, *_ in pages:
        raw = (h or "").encode()
        if len(raw) >= 1000 and p is not None:
            kept[raw] = max(p, kept.get(raw, -1))
    want = []
    for p, u, h, *_ in pages:
        raw = (h or "").encode()
        to = kept.get(raw)
        revisit = to is not None and to != p
        want.append(str((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None, u)))
    assert got == sorted(want)


def test_chunk_table_carries_running_digests(spark, pages, monkeypatch):
    rows, revisits = warc.records(spark.createDataFrame(pages, SCHEMA))
    files = warc.write_archives(warc.chunked(rows, revisits), fresh_folder(spark, "test-warc"))
    chunks = warc.read_archives(files).filter("page_id = 7 and record_type = 'response'").orderBy("chunk_no").collect()
    raw = pages[7][2].encode()
    assert len(chunks) == -(-len(raw) // warc.CHUNK) > 1
    so_far = b""
    for k, c in enumerate(chunks):
        assert c.chunk_no == k and c.chunk_start == len(so_far) and len(c.chunk) <= warc.CHUNK
        so_far += c.chunk
        assert c.digest == hashlib.sha1(so_far).hexdigest() and c.last == (k == len(chunks) - 1)
    assert so_far == raw
    # any gzip reader sees plain records
    place = files.first().place.removeprefix("file:")
    head = gzip.open(place[place.index("/") :]).read(400).decode()
    assert head.startswith("WARC/1.1\r\nWARC-Type: ") and "WARC-Payload-Digest: sha1:" in head


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.round_trip(spark, none).count() == 0 and url_filter.judged(none).count() == 0


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda r: len(r[0]), default=(None, None))
    return host, path, rule, verdict


def test_rules(spark, pages):
    got = sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in url_filter.judged(spark.createDataFrame(pages, SCHEMA)).collect())))
    assert got == sorted(str((p, *plain(u))) for p, u, *_ in pages)


def test_models_equal_brute_force_and_tell_urls_apart(spark):
    rng = random.Random(7)
    word = lambda s: "".join(rng.choice(s) for _ in range(8))
    rows = [(k, f"http://{word('abcde')}.org/fr/{word('abcde')}" if k % 2 else f"http://{word('vwxyz')}.net/{word('vwxyz')}") for k in range(600)]
    rows += [(1000 + k, f"http://{word('abcde')}.com/{word('abcde')}" if k % 2 else f"http://{word('vwxyz')}.com/{word('vwxyz')}") for k in range(100)]
    out = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    right = sum((out[1000 + k].verdict == "allow") == bool(k % 2) for k in range(100))
    assert right >= 90

    taught = [("ab/c", 1, 0), ("ab/d", 1, 0), ("xb/c", 0, 1)]
    model = {r.gram: r.ratio for r in url_filter.language_models(spark.createDataFrame(taught, "seen string, good int, bad int")).collect()}
    import math

    counts = {}
    for seen, *kinds in taught:
        framed = "\u0002" * 4 + seen + "\u0003"
        for at in range(4, len(framed)):
            for k in range(5):
                gram = framed[at - k : at + 1]
                for side in (0, 1):
                    counts.setdefault(gram, [0, 0])[side] += kinds[side]

    def p(gram, side):
        less = p(gram[1:], side) if len(gram) > 1 else 1 / 256
        after = [c[side] for g, c in counts.items() if len(g) == len(gram) and g[:-1] == gram[:-1]]
        n, kinds = sum(after), sum(x > 0 for x in after)
        return (counts[gram][side] + kinds * less) / (n + kinds) if n + kinds else less

    assert model.keys() == counts.keys()
    assert all(math.isclose(v, math.log(p(g, 0)) - math.log(p(g, 1)), abs_tol=1e-9) for g, v in model.items())


def test_filter_is_native(spark, pages):
    folder = fresh_folder(spark, "test-pages")
    spark.createDataFrame(pages, SCHEMA).write.parquet(folder)
    plan = spark._jvm.PythonSQLUtils.explainString(url_filter.judged(spark.read.parquet(folder))._jdf.queryExecution(), "formatted")
    assert "Python" not in plan and "Arrow" not in plan
