"""Toxicity (op8): held-out accuracy and awkward tables."""

import random
import zlib

from moderata.llm import toxicity


def made(n, rng):
    rows = []
    for k in range(n):
        words = [rng.choice("le la de un mot phrase grand petit chat chien rouge bleu vite".split()) for _ in range(rng.randrange(20, 60))]
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zogru", "vexal"]) + rng.choice(["a", "es", "ent", "eur", "ique"]))
        rows.append((k, " ".join(words), "xx", "s", 0, int(bad)))
    return rows


def test_held_out_accuracy_and_range(spark):
    table = made(1500, random.Random(1))
    docs = spark.createDataFrame([r[:5] for r in table], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 1, r[5]) for r in table if r[0] % 10], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    assert len(got) == 1500
    held = [r for r in table if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]]["__held_out"] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in table)
    assert all(0 <= r["__score"] <= 1 and r["__predicted"] == (r["__score"] >= 0.3) for r in got.values())
    right = sum(got[r[0]]["__predicted"] == r[5] for r in held)
    assert right >= 0.97 * len(held)
    assert toxicity.accepted(docs, labels).count() == sum(r["__predicted"] == 0 for r in got.values())


def test_held_out_labels_are_not_used(spark):
    table = made(400, random.Random(2))
    docs = spark.createDataFrame([r[:5] for r in table], "doc_id long, text string, lang string, source string, n_chars long")
    flip = lambda r: 1 - r[5] if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[5]
    scores = []
    for label in (lambda r: r[5], flip):
        labels = spark.createDataFrame([(r[0], 1, label(r)) for r in table], "doc_id long, quality int, toxic int")
        scores.append(sorted((r.doc_id, r["__score"]) for r in toxicity.scored(docs, labels).collect()))
    assert scores[0] == scores[1]


def test_awkward_tables(spark, docs, rows, empty):
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(20)] + [(None, 1, 1), (3, None, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs, labels)
    assert out.columns == [*docs.columns, "__held_out", "__score", "__predicted"] and out.count() == len(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["__score"] for r in toxicity.scored(docs, none).collect()} == {0.0}
    assert toxicity.scored(empty, none).count() == 0 and toxicity.scored(empty, labels).count() == 0


def test_features_of_words():
    names = dict(zip(toxicity.FEATURES, toxicity.features("YOU are an id1ot, you LOSER!!", {"loser": 3.0}, {"losi": 2.0}, {"idiot", "loser"})))
    assert names["word_hits"] == 1 and names["listed_hits"] == 1 and names["obfuscated_hits"] == 1 and names["nearness"] == 1
    assert len(toxicity.features("", {}, {}, set())) == len(toxicity.FEATURES)
