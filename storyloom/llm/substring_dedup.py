"""Substring dedup: a count-min prefilter over word windows, then exact grouping of the windows estimated repeated.

Pass 1. Each window of 20 words is represented by its smallest 10-word hash (its anchor), so neighbouring windows share
one. Tasks send the count-min cells of their anchors; the cells are merged per block of the sketch with saturation at
two. An anchor occurs at least as often as a window that has it, so the sketch overestimates window counts and loses no
repeated window.

Pass 2. Windows whose anchor is estimated repeated get a 128-bit hash of their words. Repeats inside a task's batch are
settled there (all but the first are later occurrences), so a passage that very many documents share sends one row a
batch. The rest goes to buckets by anchor, where the first occurrence of each window in the order of doc_id and start
stays and all others are reported. Intervals of reported starts meet the texts in a join by document.

The sketch's width follows the bytes of text up to MAX_WIDTH cells a row (two bitmaps of 128 MB at most are broadcast);
beyond that the filter lets more windows through to the exact pass, and results stay exact.

Defined results: a null text has no words; texts under 20 words lose none; windows do not cross documents; a null
doc_id sorts first; rows with equal doc_id but other texts are told apart and ordered by a hash of the text; rows that
repeat both are one document and get equal results. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, flat_bytes, mix64, read, slices, text_of, window_hashes, word_hashes, words_of

WINDOW, GRAM = 20, 10
ROWS, BLOCK_BITS, MAX_WIDTH = 2, 18, 1 << 30
#: Low bits of an anchor hold its place, so that equal windows at different places have different occurrences.
PLACE_BITS = 24
BATCH_BYTES = 6 << 20
LOWEST = -(1 << 63)


def anchors(words: np.ndarray) -> np.ndarray:
    """For each window the smallest of its GRAM-word hashes, in the high bits, with its last place in the low ones."""
    grams = window_hashes(words, GRAM)
    place = np.uint64((1 << PLACE_BITS) - 1) - (np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << PLACE_BITS) - 1))
    least = (grams >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | place
    span, have = WINDOW - GRAM + 1, 1
    while have < span:  # minima of 1, 2, 4, 8 and then `span` neighbours
        step = min(have, span - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return least


def cells(anchor: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix64(anchor + np.uint64(0x632BE59BD9B4E019 * (row + 1) % (1 << 64))) & np.uint64(width - 1)).astype(np.uint32)


class Windows:
    """The windows of a slice of texts: word hashes, and the first word of every window that lies in one text."""

    def __init__(self, column: pa.Array):
        raw, off = flat_bytes(column)
        starts, ends, self.first = words_of(raw, off)
        self.hashes = word_hashes(raw, starts, ends)
        counts = np.maximum(np.diff(self.first) - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.at = np.repeat(self.first[:-1], counts) + np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        if len(self.at):
            self.anchor = anchors(self.hashes)[self.at]
            change = np.ones(len(self.at), bool)
            change[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
            self.runs = np.flatnonzero(change)
        self.placed = len(self.hashes) < 1 << PLACE_BITS  # else places repeat, and no window of the slice is filtered

    def keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.at[chosen]
        return window_hashes(self.hashes, WINDOW, 1)[at], window_hashes(mix64(self.hashes ^ np.uint64(0x5851F42D4C957F2D)), WINDOW, 0)[at]


def sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Cells of a task's anchors: block of the sketch, cells seen once, cells seen twice or more."""
    held: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
    rows = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            found, n = np.unique(np.concatenate(held[row]), return_counts=True)
            block = found >> np.uint32(BLOCK_BITS)
            low = found & np.uint32((1 << BLOCK_BITS) - 1)
            cut = np.flatnonzero(np.diff(block)) + 1
            parts = [(int(b[0]) + row * (width >> BLOCK_BITS), x[k == 1].tobytes(), x[k > 1].tobytes()) for b, x, k in zip(np.split(block, cut), np.split(low, cut), np.split(n, cut), strict=True)]
            for i in range(0, len(parts), 64):
                a, b, c = zip(*parts[i : i + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names=["block", "once", "more"])
            held[row] = []

    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            w = Windows(part.column("text"))
            if len(w.at):
                seen = w.anchor[w.runs] >> np.uint64(PLACE_BITS)
                for row in range(ROWS):
                    held[row].append(cells(seen, row, width))
                rows += len(seen)
            if rows > 2_000_000:
                yield from flush()
                rows = 0
    if rows:
        yield from flush()


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block, in order of blocks: the bitmap of cells counted twice or more, all tasks together."""
    block, count = None, np.zeros(1 << BLOCK_BITS, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names=["block", "bits"])

    for batch in batches:
        for b, once, more in zip(*(batch.column(c).to_pylist() for c in ("block", "once", "more")), strict=True):
            if b != block:
                if block is not None:
                    yield done()
                block, count = b, np.zeros(1 << BLOCK_BITS, np.uint8)
            x = np.frombuffer(once, np.uint32)
            count[x] = np.minimum(count[x] + 1, 2)
            count[np.frombuffer(more, np.uint32)] = 2
    if block is not None:
        yield done()


def sketch(texts: DataFrame, width: int) -> np.ndarray:
    """The merged sketch: ROWS bitmaps of `width` bits, 1 where a cell was counted twice or more."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = arrow_pass(texts.select("text"), lambda it: sketched(it, width), "block int, once binary, more binary")
    blocks = arrow_pass(sent.repartition(parts, "block").sortWithinPartitions("block"), merged, "block int, bits binary")
    bits = np.zeros((ROWS * (width >> BLOCK_BITS), 1 << BLOCK_BITS >> 3), np.uint8)
    for r in blocks.toLocalIterator():  # at most ROWS * MAX_WIDTH / 8 bytes, whatever the input
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(ROWS, -1)


def repeated(bits: np.ndarray, anchor: np.ndarray, width: int) -> np.ndarray:
    out = np.ones(len(anchor), bool)
    for row in range(ROWS):
        c = cells(anchor, row, width)
        out &= (bits[row][c >> np.uint32(3)] >> (np.uint32(7) - (c & np.uint32(7))).astype(np.uint8)) & 1 == 1
    return out


RECORD = np.dtype([("a", "u8"), ("b", "u8"), ("doc", "i8"), ("tag", "i8"), ("start", "i8")])


def later(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted records, and which of them have an earlier occurrence of their window before them."""
    r = r[np.lexsort((r["start"], r["tag"], r["doc"], r["b"], r["a"]))]
    head = np.ones(len(r), bool)
    head[1:] = (r["a"][1:] != r["a"][:-1]) | (r["b"][1:] != r["b"][:-1])
    first = r[np.flatnonzero(head)[np.cumsum(head) - 1]]
    return r, (r["doc"] != first["doc"]) | (r["tag"] != first["tag"]) | (r["start"] != first["start"])


def intervals(r: np.ndarray) -> np.ndarray:
    """Records as (doc, tag, begin, end) of neighbouring starts."""
    r = r[np.lexsort((r["start"], r["tag"], r["doc"]))]
    if not len(r):
        return np.zeros((0, 4), np.int64)
    new = np.ones(len(r), bool)
    new[1:] = (r["doc"][1:] != r["doc"][:-1]) | (r["tag"][1:] != r["tag"][:-1]) | (r["start"][1:] > r["start"][:-1] + 1)
    i = np.flatnonzero(new)
    return np.stack([r["doc"][i], r["tag"][i], r["start"][i], r["start"][np.append(i[1:], len(r)) - 1] + 1], axis=1)


def to_blob(r: np.ndarray) -> bytes:
    """Columns one after the other, places as differences: neighbours differ little, so the shuffle's codec shortens them."""
    return b"".join(x.tobytes() for x in (r["a"], r["b"], *(np.diff(r[c], prepend=0) for c in ("doc", "tag", "start"))))


def of_blob(blob: bytes) -> np.ndarray:
    columns = np.frombuffer(blob, np.int64).reshape(5, -1)
    r = np.empty(columns.shape[1], RECORD)
    r["a"], r["b"] = columns[0].view(np.uint64), columns[1].view(np.uint64)
    for c, x in zip(("doc", "tag", "start"), columns[2:], strict=True):
        r[c] = np.cumsum(x)
    return r


SENT = pa.schema([("bucket", pa.int32()), ("settled", pa.bool_()), ("blob", pa.binary())])


def candidates(batches: Iterator[pa.RecordBatch], bits: np.ndarray, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows estimated repeated, by bucket; those with an earlier occurrence in the batch as settled intervals."""
    held: list[np.ndarray] = []
    to: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        r, bucket = np.concatenate(held), np.concatenate(to)
        order = np.lexsort((r["start"], r["tag"], r["doc"], r["b"], r["a"]))
        r, bucket = r[order], bucket[order]
        r, gone = later(r)
        rows = [(int(i) % buckets, True, x.tobytes()) for i, x in enumerate(np.array_split(intervals(r[gone]), 8)) if len(x)]
        r, bucket = r[~gone], bucket[~gone]
        order = np.lexsort((r["start"], r["tag"], r["doc"], bucket))
        r, bucket = r[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        rows += [(int(b[0]), False, to_blob(x)) for b, x in zip(np.split(bucket, cut), np.split(r, cut), strict=True) if len(x)]
        for i in range(0, len(rows), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 16], strict=True), SENT.types, strict=True)], schema=SENT)

    size = 0
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            w = Windows(part.column("text"))
            size += part.column("text").nbytes
            if len(w.at):
                seen = w.anchor[w.runs] >> np.uint64(PLACE_BITS)
                hit = repeated(bits, seen, width) if w.placed else np.ones(len(seen), bool)
                chosen = np.flatnonzero(np.repeat(hit, np.diff(np.append(w.runs, len(w.at)))))
                if len(chosen):
                    r = np.empty(len(chosen), RECORD)
                    r["a"], r["b"] = w.keys(chosen)
                    doc = w.doc[chosen]
                    r["doc"], r["tag"] = (part.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("doc", "tag"))
                    r["start"] = w.at[chosen] - w.first[doc]
                    held.append(r)
                    to.append((mix64(w.anchor[chosen] >> np.uint64(PLACE_BITS)) % np.uint64(buckets)).astype(np.int32))
            if size > BATCH_BYTES and held:
                yield from flush()
                held, to, size = [], [], 0
    if held:
        yield from flush()


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket by bucket: intervals of starts whose window occurs earlier."""
    held: list[np.ndarray] = []
    bucket = None

    def out(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(4)], names=["doc", "tag", "begin", "end"])

    def close() -> pa.RecordBatch:
        r, gone = later(np.concatenate(held))
        return out(intervals(r[gone]))

    for batch in batches:
        for b, ready, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ready:
                yield out(np.frombuffer(blob, np.int64).reshape(-1, 4))
                continue
            if b != bucket and held:
                yield close()
                held = []
            bucket = b
            held.append(of_blob(blob))
    if held:
        yield close()


def repeated_starts(rows: DataFrame) -> DataFrame:
    """rows: doc, tag, text. (doc, tag, begin, end): windows that start there occur earlier."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(MAX_WIDTH, max(1 << BLOCK_BITS, 1 << (3 * size // 40).bit_length()))
    bits = spark.sparkContext.broadcast(sketch(rows, width))
    buckets = 4 * parts
    sent = arrow_pass(rows.select("doc", "tag", "text"), lambda it: candidates(it, bits.value, width, buckets), "bucket int, settled boolean, blob binary")
    return arrow_pass(sent.repartition(parts, "bucket").sortWithinPartitions("bucket"), settled, "doc long, tag long, begin long, end long")


def strip(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            n, removed, digest, texts = [], [], [], []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = text.encode().split()  # bytes.split() knows just the contracts' six characters
                keep = np.ones(len(words), bool)
                for s in spans or ():
                    keep[s["begin"] : s["end"] + WINDOW - 1] = False
                left = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if spans else words
                n.append(len(words))
                removed.append(len(words) - len(left))
                joined = b" ".join(left)
                digest.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if spans else text)
            columns = {"row": part.column("row"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            if with_text:
                columns["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def substring_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """row (all columns but text), n_words, n_removed, kept_sha256 of the kept words joined by one space; text: the same, or the text as it was where nothing goes."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), text_of(docs).alias("text"))
    rows = rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LOWEST)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    found = repeated_starts(rows).groupBy("doc", "tag").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = rows.join(found, ["doc", "tag"], "left").select("row", "text", "spans")
    row_type = rows.schema["row"].dataType.simpleString()
    return arrow_pass(joined, lambda it: strip(it, with_text), f"row {row_type}, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20
), k AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM s
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM k
), g AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE again
), m AS (
  SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id
)
SELECT t.doc_id, len(t.w) AS n_words, coalesce(len(m.gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN m.gone IS NULL THEN t.w
              ELSE list_transform(list_filter(list_zip(t.w, range(1, len(t.w) + 1)), lambda p: NOT list_contains(m.gone, p[2])), lambda p: p[1]) END, ' ')) AS kept_sha256
FROM t LEFT JOIN m ON t.doc_id = m.doc_id
"""
