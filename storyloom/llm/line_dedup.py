"""Line dedup: range-partitioned line hashes, streamed in order of key, document and position.

Lines of every text become (key hash, doc_id, position) rows, range-partitioned by hash and document so that one very
common line spreads over many tasks, and sorted within a task by hash, document (largest first) and position. A task
streams its rows once. Of a key that begins and ends inside the task everything is known; of the task's first and last
key it leaves at most a few rows open, which are resolved against the neighbours' (at most six rows a task, joined by
hash). The result is a compressed bitmap of the lines that stay for each document, not text.

Defined results: a null or empty text has one empty line; a very long text is split whole, a line at a time; a null doc_id counts as the smallest; rows with equal doc_id
count as one document when keys are counted, and each keeps its own lines apart (rows are told apart by their text).
An empty table gives no rows. Other columns pass through `apply_bitmaps` unchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import WS_CHARS, arrow_pass, drop_held, materialize, read, text_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STREAMED = "key binary, doc long, tag long, position int, docs int, open boolean"


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text_of(docs)).alias("tag"), text_of(docs).alias("text"))
    lines = base.select("doc", "tag", F.posexplode(F.split("text", "\n", -1)).alias("position", "line"))
    key = F.translate(F.btrim("line", F.lit(WS_CHARS)), UPPER, UPPER.lower())
    return lines.select("doc", "tag", "position", key.alias("text_key")).where(F.length("text_key") >= min_chars).select(F.unhex(F.substring(F.sha2("text_key", 256), 1, 32)).alias("key"), "doc", "tag", "position")


def streamed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows in, sorted by key, document (largest first) and position; rows out: lines to drop, and open rows.

    A key's rows of its largest document stay. Until `min_docs` documents were seen, rows of the others are held. The
    first and the last key of the task may go on in another task, so what isn't settled by this task's rows stays open;
    `docs`, set on one open row of the key, is the number of its documents here (summed over tasks later: range bounds
    keep one key and document together).
    """
    out: list[tuple] = []
    key = top = last = None
    seen, first = 0, True
    held: list[tuple] = []

    def close(final: bool) -> None:
        if key is not None and (first or final):
            # rows of the largest document here: one is enough to tell the others which document it is, unless an earlier task has the key
            out.extend((key, *r, seen if i == 0 else 0, True) for i, r in enumerate(tops if first else tops[:1]))
            if seen < min_docs:
                out.extend((key, *r, 0, True) for r in held)

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "doc", "tag", "position", "docs", "open"])
        out.clear()
        return batch

    tops: list[tuple] = []
    for batch in batches:
        for k, doc, tag, position in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                close(False)
                first = key is None
                key, top, last, seen, held, tops = k, doc, doc, 1, [], [(doc, tag, position)]
                continue
            if doc != last:
                seen, last = seen + 1, doc
            if doc == top:
                if first:  # only a task's first key needs all lines of its largest document
                    tops.append((doc, tag, position))
            elif seen < min_docs:
                held.append((doc, tag, position))
            else:
                out.extend((key, *r, 0, False) for r in held)
                held = []
                out.append((key, doc, tag, position, 0, False))
        if len(out) >= 65536:
            yield flush()
    close(True)
    yield flush()


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tag, position) of every line that goes."""
    lines = materialize(line_keys(docs, min_chars))  # range bounds are drawn from the rows, which are worked out once only
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = lines.repartitionByRange(parts, F.col("key"), F.col("doc").desc()).sortWithinPartitions(F.col("key"), F.col("doc").desc(), F.col("tag"), F.col("position"))
    found = materialize(arrow_pass(ordered.select("key", "doc", "tag", "position"), lambda it: streamed(it, min_docs), STREAMED))
    pending = found.where("open")
    facts = pending.groupBy("key").agg(F.sum("docs").alias("all_docs"), F.max("doc").alias("top"))
    late = pending.join(facts, "key").where((F.col("all_docs") >= min_docs) & (F.col("doc") < F.col("top")))
    return found.where("not open").select("doc", "tag", "position").unionByName(late.select("doc", "tag", "position"))


def to_bitmap(n_lines: int, positions: np.ndarray) -> bytes:
    keep = np.ones(n_lines, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes())


def of_bitmap(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, positions: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else to_bitmap(n, np.asarray(p, np.int64)) for n, p in zip(n_lines, positions, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t: str, b: bytes) -> str | None:
        if t is None or b is None:
            return None
        lines = t.split("\n")
        return "\n".join(x for x, k in zip(lines, of_bitmap(b, len(lines)), strict=True) if k)

    return pd.Series([one(t, b) for t, b in zip(text, bitmap, strict=True)], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("bitmap", T.BinaryType()), T.StructField("text", T.StringType())]))
def _applied(text: pd.Series, n_lines: pd.Series, positions: pd.Series) -> pd.DataFrame:
    """The bitmap of each text that loses lines, and the lines that it keeps; nulls for the others."""
    out: list[tuple[bytes | None, str | None]] = []
    for t, n, p in zip(text, n_lines, positions, strict=True):
        bitmap = None if p is None else to_bitmap(n, np.asarray(p, np.int64))
        out.append((None, None) if bitmap is None else (bitmap, "\n".join(x for x, k in zip(t.split("\n"), of_bitmap(bitmap, n), strict=True) if k)))
    drop_held()
    return pd.DataFrame(out, columns=["bitmap", "text"], dtype=object)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, tag, n_dropped, positions) of the documents that lose lines; `with_bitmaps` turns positions into bitmaps."""
    gone = dropped_lines(docs, min_chars, min_docs).distinct()
    return gone.groupBy("doc", "tag").agg(F.count("*").alias("n_dropped"), F.collect_list("position").alias("positions"))


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """row, text, n_lines, n_dropped, positions of the lines to drop (null: all lines stay)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), text_of(docs).alias("text"))
    rows = rows.select("row", "text", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("tag"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    joined = rows.join(keep_bitmaps(docs, min_chars, min_docs), ["doc", "tag"], "left")
    return joined.select("row", "text", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "positions")


def with_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """All columns of the documents in a struct `row`, with text, n_lines, n_dropped and keep_bitmap (null: all lines stay)."""
    return _marked(docs, min_chars, min_docs).select("row", "text", "n_lines", "n_dropped", _bitmap("n_lines", "positions").alias("keep_bitmap"))


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """row, n_lines, n_dropped, keep_bitmap, text: bitmaps made and applied in one step, as `apply_bitmaps` of `with_bitmaps` does in two."""
    marked = _marked(docs, min_chars, min_docs)
    done = marked.withColumn("done", _applied(F.when(F.col("positions").isNotNull(), F.col("text")), F.col("n_lines"), F.col("positions")))
    return done.select("row", "n_lines", "n_dropped", F.col("done.bitmap").alias("keep_bitmap"), F.coalesce("done.text", "text").alias("text"))


def apply_bitmaps(marked: DataFrame) -> DataFrame:
    """The documents' columns again, with the lines that stay as text."""
    kept = _kept_text(F.when(F.col("keep_bitmap").isNotNull(), F.col("text")), F.col("keep_bitmap"))
    return marked.select("row", "n_lines", "n_dropped", F.coalesce(kept, F.col("text")).alias("text"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read(spark, sf_dir, "documents"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), d AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.*, d.key IS NOT NULL AND k.doc_id < d.top AS gone FROM k LEFT JOIN d ON k.key = d.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
