"""Document fingerprints by consistent weighted sampling.

A term (word) of a document weighs its count times its length in bytes. For each of 64 samples a term has two
Gamma(2, 1) draws r, c and a uniform draw b, all from a hash of the term, the same in every document. With weight S let
t = floor(ln S / r + b) and ln a = ln c - r (t - b) - r; the document's sample is the (term, t) of the smallest a. Two
documents agree in a sample with a probability equal to their generalised Jaccard similarity, the sum of minima over
the sum of maxima of weights. A fingerprint keeps 16 bits of each sample, 256 hexadecimal digits in all; the likeness of
two fingerprints is the share of equal samples.

For the query each text is also compared with its next document (descending doc_id) and with an edited text that ends
in the next one's beginning. Documents are dealt by ranges of (doc_id, hash of the text) in one shuffle, whose bounds come
from a bounded sample; a task meets neighbours in order, and each range ends in a copy of the next range's first document.

Defined results: a null text counts as empty; texts without words share one fingerprint; equal doc_ids follow each other
in the order of a hash of their texts; null doc_ids come last; a single document is its own next. A very long text
is sampled whole, by one task; columns besides doc_id and text play no part. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, flat_bytes, mix64, read, slices, text_of, word_hashes, words_of

SAMPLES = 64
#: Distinct (term, weight) pairs that are sampled at once.
TERMS = 4096
LOWEST = -(1 << 63)


def weighted_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: number of the text, hash, weight."""
    raw, off = flat_bytes(column)
    starts, ends, first = words_of(raw, off)
    hashes, length = word_hashes(raw, starts, ends), ends - starts
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    doc, hashes, length = doc[order], hashes[order], length[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    i = np.flatnonzero(new)
    return doc[i], hashes[i], length[i] * np.diff(np.append(i, len(doc)))


def draws(terms: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) for each term and sample."""
    seeds = mix64(np.arange(SAMPLES, dtype=np.uint64) * np.uint64(8) + np.uint64(which + 1))
    x = mix64(terms[:, None] ^ seeds[None, :])
    half = np.float32(2.0**-32)
    return ((x >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * half, ((x & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * half


def samples(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and 16 bits of (term, t) for each (term, weight) and sample."""
    tiny = np.float32(1e-12)
    u, v = draws(terms, 0)
    r = np.maximum(-np.log(u * v), tiny)
    u, v = draws(terms, 1)
    log_c = np.log(np.maximum(-np.log(u * v), tiny))
    b, _ = draws(terms, 2)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    log_a = log_c - r * (t - b) - r
    code = mix64(terms[:, None] + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return log_a, code.astype(np.uint16)


def fingerprints(column: pa.Array) -> np.ndarray:
    """A row of SAMPLES 16-bit codes for each text."""
    doc, terms, weights = weighted_terms(column)
    out = np.zeros((len(column), SAMPLES), np.uint16)
    if not len(doc):
        return out
    order = np.lexsort((weights, terms))
    new = np.ones(len(doc), bool)
    new[1:] = (terms[order][1:] != terms[order][:-1]) | (weights[order][1:] != weights[order][:-1])
    pair = np.empty(len(doc), np.int64)
    pair[order] = np.cumsum(new) - 1
    i = order[np.flatnonzero(new)]
    log_a, code = np.empty((len(i), SAMPLES), np.float32), np.empty((len(i), SAMPLES), np.uint16)
    for at in range(0, len(i), TERMS):
        log_a[at : at + TERMS], code[at : at + TERMS] = samples(terms[i[at : at + TERMS]], weights[i[at : at + TERMS]])
    bounds = np.searchsorted(doc, np.arange(len(column) + 1))
    column_of = np.arange(SAMPLES)
    for k in np.flatnonzero(bounds[1:] > bounds[:-1]):
        own = pair[bounds[k] : bounds[k + 1]]
        out[k] = code[own[log_a[own].argmin(axis=0)], column_of]
    return out


def to_text(codes: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in codes.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every text, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(to_text(fingerprints(part.column("text"))), pa.string())], names=["doc_id", "fingerprint"])

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def against_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges in order, the last of each range a copy: every row but the copies with its next."""
    rows: list[tuple] = []  # doc_id, copy, text

    def out() -> pa.RecordBatch:
        texts = [r[2] for r in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        codes = fingerprints(pa.array(texts + changed, pa.large_string()))
        n = len(rows) - 1
        own, following, new = codes[:n], codes[1 : n + 1], codes[n + 1 :]
        keep = [i for i in range(n) if not rows[i][1]]
        columns = [[r[0] for r in rows[:n]], [len(t) for t in texts[:n]], [hashlib.sha256(t.encode()).hexdigest() for t in changed], to_text(own), to_text(new), likeness(own, new).tolist(), likeness(own, following).tolist()]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in OUT.split(", ")]).take(pa.array(keep, pa.int64()))

    for batch in batches:
        for part in slices(batch, "text", 3 << 20):
            rows += zip(part.column("doc_id").to_pylist(), part.column("copy").to_pylist(), part.column("text").to_pylist(), strict=True)
            if len(rows) > 1:
                yield out()
                rows = rows[-1:]


def range_bounds(keys: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """About `ranges` - 1 bounds (id, tag) in ascending order, from a sample of some 32 rows a range."""
    n = keys.count()
    sample = keys.sample(min(1.0, 32 * ranges / n), 1).collect() if n else []  # as many rows as the sort of a table samples
    chosen = sorted(map(tuple, sample))[16::32]
    ids, tags = zip(*sorted(set(chosen)), strict=True) if chosen else ((), ())
    return np.array(ids, np.int64), np.array(tags, np.int64)


def place_of(ids: np.ndarray, tags: np.ndarray, bound_ids: np.ndarray, bound_tags: np.ndarray) -> np.ndarray:
    """How many bounds lie at (id, tag) or above: 0 for the largest keys."""
    low, high = np.searchsorted(bound_ids, ids, side="left"), np.searchsorted(bound_ids, ids, side="right")
    below = low.copy()
    for i in np.flatnonzero(high > low).tolist():  # a bound's own id
        below[i] += np.searchsorted(bound_tags[low[i] : high[i]], tags[i], side="left")
    return (len(bound_ids) - below).astype(np.int32)


def with_next(docs: DataFrame) -> DataFrame:
    """The query's columns for every document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("id"), text_of(docs).alias("text"))
    rows = rows.select("doc_id", "id", "text", F.xxhash64("text").alias("tag"))
    bounds = spark.sparkContext.broadcast(range_bounds(rows.select("id", "tag"), 3 * parts))

    @F.pandas_udf("int")
    def place(id_: pd.Series, tag: pd.Series) -> pd.Series:
        return pd.Series(place_of(id_.to_numpy(), tag.to_numpy(), *bounds.value))

    rows = rows.select("doc_id", "id", "text", "tag", place("id", "tag").alias("range"))
    # one row a range from here on: each range's first document goes behind the range before it
    heads = rows.groupBy("range").agg(F.max(F.struct("id", "tag")).alias("head"))
    behind = heads.select("head", F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy())).alias("behind"))
    behind = behind.select(F.col("head.id").alias("id"), F.col("head.tag").alias("tag"), "behind")
    copies = rows.join(F.broadcast(behind), ["id", "tag"]).dropDuplicates(["behind"]).select("doc_id", "id", "text", "tag", F.col("behind").alias("range"), F.lit(True).alias("copy"))
    dealt = rows.select("doc_id", "id", "text", "tag", "range", F.lit(False).alias("copy")).union(copies).repartition(parts, "range")
    ordered = dealt.sortWithinPartitions("range", "copy", F.desc("id"), F.desc("tag")).select("doc_id", "copy", "text")
    return arrow_pass(ordered, against_next, OUT)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))
