"""Ranked lexical search by bag deduplication.

Texts are cut into terms (maximal runs of ASCII letters, digits and characters
beyond ASCII; only A-Z lower-cased). Each document is restricted to the items'
vocabulary: a bitmap of 2^25 bits over the vocabulary's 64-bit term hashes (4 MB, whatever the
vocabulary) goes to every task, which keeps the bag (term hash, tf) of the terms
that hit it, and the document's length. Documents with the same length factor
``m`` and the same bag have the same score for every item, so they form a class:
a 64-bit hash of both deals them, and equal hashes are verified by comparing
the bags themselves (the grouping key holds them). Each class is scored once, against blocks of
``ITEMS`` items: postings of a batch of classes meet the items' term lists in
array operations, and a task keeps per item the ``TOP`` best classes by (score,
smallest doc_id). No better document can lie outside the ``TOP`` best classes,
so only these are expanded to their members by ascending doc_id.

A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles; all else is
64-bit integer arithmetic (sums are carried in doubles only while below 2^53).

Defined cases: null or term-less texts have no terms, aren't counted in N and
never rank; repeated rows are documents of their own; null doc_ids rank after
all others of their score; an item without terms, or an empty table, gives no rows; every row of
the items' table is an item, so repeated items each get their ranks.
Two terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap, cut, slices, span_hashes, split_by_bitmap, strings, word_spans

TOP = 20
#: Items scored in one pass over the classes.
ITEMS = 4096
#: Scores, or postings of a batch, held at a time.
_CELLS = 1 << 21
#: Bytes that separate terms are blanks, A-Z small letters.
_TERM = np.array([b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every term of the texts end to end, and the text each is of."""
    data, offsets = strings(column)
    data = _TERM[data]
    starts, stops, owner = word_spans(data, offsets)
    return span_hashes(data, starts, stops).view(np.int64), owner


def _bags(hits):
    """Rows (id, text) to rows (id, number of terms, sorted term hashes, tf); hits: the bitmap's bytes, or None for all terms."""

    def run(batches):
        bits = None if hits is None else np.frombuffer(hits.value, np.uint8)
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                hashes, owner = term_hashes(piece.column(1))
                n = np.bincount(owner, minlength=piece.num_rows)
                if bits is not None:
                    place = hashes % BITMAP_BITS
                    known = bits[place >> 3] >> (place & 7) & 1 == 1
                    hashes, owner = hashes[known], owner[known]
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                fresh = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])) if len(hashes) else np.zeros(0, np.int64)
                tf = np.diff(np.append(fresh, len(hashes)))
                at = pa.array(np.searchsorted(owner[fresh], np.arange(piece.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (hashes[fresh], tf)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return run


def bags(rows: DataFrame, hits=None) -> DataFrame:
    """id, n, terms, tfs of rows (id, text)."""
    kind = dict(rows.dtypes)["id"]
    return rows.select("id", F.col("text").cast("string").alias("text")).mapInArrow(_bags(hits), f"id {kind}, n long, terms array<long>, tfs array<long>")


def _vocabulary_bits(terms: DataFrame) -> bytes:
    """A bitmap of 2^25 bits with a one at each term's hash; 4 MB in the driver."""
    place = F.pmod(F.col("term"), F.lit(BITMAP_BITS)) + 1  # Spark counts places from 1 on
    blocks = terms.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = bytearray(BITMAP_BITS // 8)
    for row in blocks.collect():  # at most 1024 rows of 4 KB
        first = (row.block - 1) * 32768
        out[first >> 3 : (first >> 3) + 4096] = row.bits
    return bytes(out)


class _Items:
    """A block of items: for each term its weight, and the items that hold it with their repeats."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        item, term, times, weight = (np.array(x, np.int64) for x in zip(*rows))
        order = np.argsort(term, kind="stable")
        self.numbers, item = np.unique(item, return_inverse=True)
        self.item, self.times = item[order], times[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.weights = weight[order][self.first]
        self.count = np.diff(np.append(self.first, len(order)))


def _best(items, top: int):
    """Classes (hash, smallest doc_id, m, terms, tfs) to a task's best ones per item: (item, score, hash, smallest doc_id)."""

    def scores(block: _Items, m, owner, terms, tf, n):
        """(class, item, score) of all pairs with a common term."""
        at = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
        known = block.terms[at] == terms
        at, owner, tf = at[known], owner[known], tf[known]
        impact = block.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[owner]))
        count = block.count[at]
        ends = np.cumsum(count)
        width = len(block.numbers)
        total = np.zeros(n * width, np.int64)
        exact = np.zeros(n * width, bool)
        for from_, to in _runs(ends):
            again = np.repeat(np.arange(from_, to), count[from_:to])
            place = np.repeat(block.first[at[from_:to]], count[from_:to]) + np.arange(len(again)) - np.repeat(np.cumsum(count[from_:to]) - count[from_:to], count[from_:to])
            cell = owner[again] * width + block.item[place]
            value = impact[again] * block.times[place]
            exact[cell] = True
            if np.abs(value).sum(dtype=np.float64) < 2.0**52:
                total += np.bincount(cell, weights=value, minlength=len(total)).astype(np.int64)
            else:
                np.add.at(total, cell, value)
        cells = np.flatnonzero(exact & (total > 0))
        return cells // width, cells % width, total[cells]

    def run(batches):
        block: _Items = items.value
        width = len(block.numbers)
        held = [np.zeros(0, np.int64) for _ in range(5)]  # item, -score, no id, doc_id, hash
        least_score = np.ones(width, np.int64)
        for batch in batches:
            rows = max(1, _CELLS // width)
            for from_ in range(0, batch.num_rows, rows):
                piece = batch.slice(from_, rows)
                lists = piece.column(3)
                owner = np.repeat(np.arange(piece.num_rows), np.diff(lists.offsets.to_numpy()))
                terms, tf = lists.flatten().to_numpy(), piece.column(4).flatten().to_numpy()
                cls, item, score = scores(block, piece.column(2).to_numpy(), owner, terms, tf, piece.num_rows)
                good = score >= least_score[item]
                cls, item, score = cls[good], item[good], score[good]
                ids = piece.column(1)
                no_id = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                number = ids.fill_null(0).to_numpy()
                fresh = (item, -score, no_id[cls], number[cls], piece.column(0).to_numpy()[cls])
                held = [np.concatenate([a, b]) for a, b in zip(held, fresh)]
                order = np.lexsort(held[::-1])
                held = [x[order] for x in held]
                first = np.searchsorted(held[0], np.arange(width))
                rank = np.arange(len(held[0])) - first[held[0]]
                last = rank == top - 1
                least_score[held[0][last]] = -held[1][last]
                held = [x[rank < top] for x in held]
        columns = [pa.array(block.numbers[held[0]]), pa.array(-held[1]), pa.array(held[4]), pa.array(held[3], mask=held[2] == 1)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "score", "class", "least"])

    return run


def _runs(ends: np.ndarray):
    """Ranges of postings with about ``_CELLS`` item entries each."""
    from_ = 0
    while from_ < len(ends):
        done = ends[from_ - 1] if from_ else 0
        to = max(from_ + 1, int(np.searchsorted(ends, done + _CELLS, "right")))
        yield from_, to
        from_ = to


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` highest-scoring documents."""
    spark = docs.sparkSession
    numbered = cut(items.select(F.col("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("id")))
    wanted = cut(bags(numbered.select("id", "text")).select(F.col("id").alias("item"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("times")))).toDF("item", "term", "times"))
    vocabulary = wanted.select("term").distinct()
    hits = spark.sparkContext.broadcast(_vocabulary_bits(vocabulary))
    bagged = cut(bags(docs.select(F.col("doc_id").alias("id"), "text"), hits).filter("n > 0"))
    n_docs, n_terms = bagged.agg(F.count("*"), F.sum("n")).first()
    df = bagged.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.lit(2 * n_docs + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))
    weighed = cut(wanted.join(df, "term").select("item", "term", "times", F.floor(1000 * idf).alias("weight")))

    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}) div {n_terms or 1}")
    filled = bagged.filter(F.size("terms") > 0).withColumn("m", m.cast("long")).withColumn("class", F.xxhash64("m", "terms", "tfs"))
    same = ["class", "m", "terms", "tfs"]
    classes = cut(filled.groupBy(*same).agg(F.min("id").cast("long").alias("least")).select("class", "least", "m", "terms", "tfs"))

    best = None
    places = weighed.select("item").distinct().orderBy("item")
    bounds = [r.item for r in cut(places.withColumn("k", F.row_number().over(Window.orderBy("item")))).filter(F.col("k") % ITEMS == 1).orderBy("item").collect()]
    for k, low in enumerate(bounds):
        inside = F.col("item") >= low if k + 1 == len(bounds) else (F.col("item") >= low) & (F.col("item") < bounds[k + 1])
        block = spark.sparkContext.broadcast(_Items([tuple(r) for r in weighed.filter(inside).select("item", "term", "times", "weight").collect()]))
        part = classes.mapInArrow(_best(block, top), "item long, score long, class long, least long")
        best = part if best is None else best.union(part)
    if best is None:
        best = spark.createDataFrame([], "item long, score long, class long, least long")
    order = [F.col("score").desc(), F.col("least").asc_nulls_last(), F.col("class")]
    chosen = cut(best.withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("k") <= top).select("item", "score", "class", "least"))

    likely, _ = split_by_bitmap(filled, "class", bitmap(chosen.select("class").distinct(), "class"))
    first = Window.partitionBy(*same).orderBy(F.col("id").asc_nulls_last())
    members = likely.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= top).drop("k")
    # a class is known by its hash and its first member; its other members have its bag, not only its hash
    heads = classes.join(chosen.select("class").distinct(), "class", "left_semi")
    expanded = members.join(heads, same).select("class", "least", "id")
    found = chosen.join(expanded, (chosen["class"] == expanded["class"]) & chosen["least"].eqNullSafe(expanded["least"])).select("item", "score", "id")
    last = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranks = found.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= top)
    out = ranks.join(numbered.select(F.col("id").alias("item"), "item_id"), "item")
    return out.select("item_id", "rank", F.col("id").alias("doc_id"), "score")


#: DuckDB text of the same ranks. The term pattern.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
full_docs AS (SELECT * FROM d WHERE len(ts) > 0),
total AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM full_docs),
postings AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM full_docs) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM postings GROUP BY t),
i AS (SELECT item_id, row_number() OVER () AS k, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
wanted AS (SELECT k, t, count(*) AS times FROM (SELECT k, unnest(ts) AS t FROM i) GROUP BY k, t),
weighed AS (SELECT k, t, times, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM wanted JOIN df USING (t), total),
sized AS (SELECT r, doc_id, 75 + (25 * len(ts) * n_docs) // n_terms AS m FROM full_docs, total),
scored AS (SELECT k, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM weighed JOIN postings USING (t) JOIN sized USING (r) GROUP BY k, r),
ranks AS (SELECT k, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored JOIN sized USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks JOIN i USING (k) WHERE rank <= 20
"""
