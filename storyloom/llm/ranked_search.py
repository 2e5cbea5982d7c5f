"""Ranked lexical search with bag deduplication.

The items' terms are the vocabulary. One pass over the documents keeps of each text only its bag: the vocabulary's terms
in it with their frequencies, as sorted pairs. What the score takes of a document is its bag and its length measure m, so
documents with equal bag and m form a class: bags are hashed together with m, grouped by the hash and by the bag itself,
so that only identical ones meet, and each class is scored once, against all items at a time (a sparse product of a slice of
bags with the items' postings). A task keeps the best classes of each item only; the best of all tasks are expanded to their
members by ascending doc_id.

No pair of document and item is ever a row: what leaves a scoring task are `top` rows an item. Of a class at most `top` members are needed for
an item's first `top` documents, so partial limits before the shuffle keep a large class small. Items are taken in blocks of
bounded postings (an item's terms stay together), whose vocabulary is broadcast; documents are read once for each block.
Scores are sums of 64-bit integers; terms are equal if two independent 64-bit hashes of their bytes are.

Defined results: a null or empty text, or one without a term, is no document of N and in no result; an item without a term, or
whose terms no document has, has no rows; rows that repeat an item_id are one item with the terms of all of them; rows
that repeat a doc_id are documents of their own, each with a rank; a null doc_id counts as the smallest; documents of equal
score rank by ascending doc_id, of equal doc_id by their class; a very long text is counted whole; extra columns play no
part; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, discard, flat_bytes, materialize, read, slices, text_of, within, word_hashes, words_of

# What a term is, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCALE, GAIN, TF_WEIGHT, M_WEIGHT, FLAT, SLOPE = 1000, 1_000_000_000, 1000, 20, 50, 50
#: Documents of an item; postings of a block of items; cells of scores that a task works out at once.
TOP, BLOCK, CELLS = 50, 1 << 20, 1 << 21
NO_ID = -(1 << 63)


def _folded() -> np.ndarray:
    """Bytes of terms in lower case; all others as a space."""
    table = np.arange(256, dtype=np.uint8)
    plain = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
    table[~plain] = 32
    table[65:91] += 32
    return table


FOLDED = _folded()


@dataclass
class Items:
    """A block of items: the vocabulary by ascending hash, and each term's items."""

    hashes: np.ndarray
    checks: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    n_items: int

    @classmethod
    def of(cls, rows: pa.Table) -> Items:
        """rows: (item, term), each once; items are numbers from 0."""
        raw, off = flat_bytes(rows.column("term"))
        hashes, checks = word_hashes(raw, off[:-1], off[1:]), word_hashes(raw, off[:-1], off[1:], 1)
        order = np.lexsort((checks, hashes))
        hashes, checks = hashes[order], checks[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1]))[: len(order)]
        item = rows.column("item").to_numpy().astype(np.int64)[order]
        return cls(hashes[new], checks[new], np.append(np.flatnonzero(new), len(order)), item, int(item.max()) + 1 if len(item) else 0)

    def terms(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are in the vocabulary, and as what number."""
        found = word_hashes(raw, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == found)
        check = word_hashes(raw, starts[hit], ends[hit], 1)
        number = at[hit]
        while True:  # terms whose first hash is the same stand side by side
            step = np.minimum(number + 1, len(self.hashes) - 1)
            wrong = (self.checks[number] != check) & (step > number) & (self.hashes[step] == self.hashes[number])
            if not wrong.any():
                break
            number = np.where(wrong, step, number)
        right = self.checks[number] == check
        return hit[right], number[right]


def item_terms(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(item_id, term) of every distinct term of an item."""
    words = F.regexp_extract_all(F.translate(text_of(items), UPPER, UPPER.lower()), F.lit(TERM), 0)
    return items.select(F.col(item_id).alias("item_id"), F.explode(words).alias("term")).distinct()


def bags(docs: DataFrame, items: Items) -> DataFrame:
    """(doc, n, bag): a document's terms, and pairs (term, frequency) of 32 bits each, by ascending term."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                raw, off = flat_bytes(part.column("text"))
                raw = FOLDED[raw]
                starts, ends, first = words_of(raw, off)
                hit, term = block.terms(raw, starts, ends)
                text = np.searchsorted(first, hit, side="right") - 1
                pairs, tf = np.unique(text * len(block.hashes) + term, return_counts=True)
                text, term = pairs // len(block.hashes), pairs % len(block.hashes)
                data = np.stack([term, tf], axis=1).astype("<u4")
                ends = 8 * np.searchsorted(text, np.arange(part.num_rows + 1))
                bag = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(np.diff(first), pa.int64()), bag], names=["doc", "n", "bag"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("string").alias("text"))
    return arrow_pass(rows, run, "doc long, n long, bag binary")


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of bags: each pair's bag, term and frequency."""
    raw, off = flat_bytes(column)
    pairs = np.frombuffer(raw.tobytes(), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(off) - 1), np.diff(off) // 8), pairs[:, 0], pairs[:, 1]


def frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """Of each term of the vocabulary the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(unpacked(batch.column("bag"))[1], minlength=n_terms)
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(df[term], pa.int64())], names=["term", "df"])

    rows = arrow_pass(found.select("bag"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def best(item: np.ndarray, score: np.ndarray, first: np.ndarray, key: np.ndarray, top: int) -> np.ndarray:
    """The rows of each item's `top` classes, by descending score, then ascending first document and key."""
    order = np.lexsort((key, first, -score, item))
    item = item[order]
    begin = np.searchsorted(item, item)
    return order[np.arange(len(order)) - begin < top]


def scored(classes: DataFrame, items: Items, weight: np.ndarray, top: int) -> DataFrame:
    """(item, score, first, key): each task's best classes of each item."""
    shared = classes.sparkSession.sparkContext.broadcast((items, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, w = shared.value
        size = np.diff(block.bounds)
        rows = max(1, CELLS // block.n_items)
        least = np.ones(block.n_items, np.int64)  # a class below it is not among an item's best
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "S32")]
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                bag, term, tf = unpacked(batch.column("bag"))
                m = batch.column("m").to_numpy()[bag]
                part = w[term] * ((GAIN * tf) // (TF_WEIGHT * tf + M_WEIGHT * m))
                total = np.zeros(batch.num_rows * block.n_items, np.int64)
                ends = np.cumsum(size[term])
                a = 0
                while a < len(term):
                    b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, side="right")))
                    n = size[term[a:b]]
                    cell = np.repeat(bag[a:b] * block.n_items, n) + block.items[np.repeat(block.bounds[term[a:b]], n) + within(n)]
                    value = np.repeat(part[a:b], n)
                    for shift, low in ((0, value & 0xFFFFFF), (24, value >> 24)):  # doubles add such parts exactly
                        total += np.bincount(cell, low, len(total)).astype(np.int64) << shift
                    a = b
                total = total.reshape(batch.num_rows, block.n_items)
                row, item = np.nonzero(total >= least)
                key = np.array(batch.column("key").to_pylist(), "S32")
                held = [np.concatenate(x) for x in zip(held, (item, total[row, item], batch.column("first").to_numpy()[row], key[row]), strict=True)]
                if len(held[0]) > 4 * top * block.n_items:
                    keep = best(*held, top)
                    held = [x[keep] for x in held]
                    full = np.bincount(held[0], minlength=block.n_items) >= top
                    lowest = np.full(block.n_items, np.iinfo(np.int64).max)
                    np.minimum.at(lowest, held[0], held[1])
                    least = np.where(full, lowest, 1)
        keep = best(*held, top)
        item, score, first, key = (x[keep] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(score, pa.int64()), pa.array(first, pa.int64()), pa.array([k.decode() for k in key.tolist()], pa.string())], names=["item", "score", "first", "key"])

    return arrow_pass(classes.select("key", "m", "bag", "first"), run, "item long, score long, first long, key string")


def bag_key(m: Column, digest_hex: int) -> Column:
    return F.substring(F.md5(F.concat(F.col("bag"), F.encode(m.cast("string"), "utf-8"))), 1, digest_hex)


def rank_block(docs: DataFrame, items: Items, top: int, digest_hex: int) -> DataFrame:
    """(item, rank, doc, score) of one block of items."""
    found = materialize(bags(docs, items))
    facts = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = facts[0], facts[1] or 1
    weight = weights(frequencies(found, len(items.hashes)), n_docs)
    m = F.expr(f"{FLAT}L + ({SLOPE}L * n * {n_docs}L) div {n_terms}L")
    keyed = found.where(F.length("bag") > 0).select("doc", m.alias("m"), "bag").withColumn("key", bag_key(F.col("m"), digest_hex))
    # grouped by the hash and by what was hashed: rows of a group are identical, whatever the hash
    classes = stored = materialize(keyed.groupBy("key", "m", "bag").agg(F.min("doc").alias("first")))
    if classes.select("key").distinct().count() < classes.count():  # different bags of one hash: the bags themselves tell the classes apart
        whole = F.concat(F.hex("bag"), F.lit("/"), F.col("m").cast("string"))
        keyed, classes = keyed.withColumn("key", F.sha2(whole, 256).substr(1, 32)), classes.withColumn("key", F.sha2(whole, 256).substr(1, 32))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "first", "key")
    winners = scored(classes, items, weight, top).withColumn("at", F.row_number().over(order)).where(F.col("at") <= top).drop("at", "first")
    members = keyed.select("key", "doc").withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy("doc"))).where(F.col("at") <= top).drop("at")
    ranked = winners.join(members, "key").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc", "key")))
    out = materialize(ranked.where(F.col("rank") <= top).select("item", "rank", "doc", "score"))
    discard(found)
    discard(stored)
    return out


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id", block: int = BLOCK, digest_hex: int = 32) -> DataFrame:
    """item_id, rank, doc_id, score: of each item its `top` best documents. items: (item_id, text). block: postings of the items taken at once."""
    spark = docs.sparkSession
    terms = materialize(item_terms(items, item_id))
    blocks = max(1, -(-terms.count() // block))
    terms = terms.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        rows = terms.where(F.col("block") == b).select("item_id", "term").toArrow()
        if not rows.num_rows:
            continue
        encoded = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
        ids = encoded.dictionary
        numbered = pa.table({"item": encoded.indices.cast(pa.int64()), "term": rows.column("term")})
        found = rank_block(docs, Items.of(numbered), top, digest_hex)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int64()), "item_id": ids}))
        parts.append(found.join(names, "item").select("item_id", "rank", F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score"))
    if not parts:
        return terms.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, parts)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM documents
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term FROM benchmark
), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), a AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM n, a),
f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, a GROUP BY term),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 50
"""
