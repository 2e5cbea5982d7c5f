"""Exact dedup by a log-structured merge index of text digests.

Each task collects digests in a memtable; a full memtable is aggregated, sorted and flushed as a run of level 0,
a Parquet file with a Bloom filter on the digest. Compaction merges the runs into level 1, sorted by digest, with the
smallest identifier and the number of rows of each digest. Rows whose digest is there more than once (hits) are
compared byte by byte with the row that stays; rows that only share the digest are grouped by their whole text.

Defined results: a null text counts as empty; a null doc_id is larger than any other, and is the keep_id only where all
ids of the group are null; rows that repeat id and text of the row that stays are that same document and stay too.
Texts of any length are compared whole. An empty table gives no rows. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import WS_CLASS, arrow_pass, discard, materialize, read, shared_dir, text_of

#: A group of copies is checked in one task for each so many rows, and in so many at most.
ROWS_A_DEAL, MOST_DEALS = 1000, 1024
FILTERED = {"parquet.bloom.filter.enabled#digest": "true"}


def normalized(docs: DataFrame, digest_hex: int) -> DataFrame:
    norm = F.regexp_replace(text_of(docs), f"{WS_CLASS}+", " ")
    return docs.select("doc_id", norm.alias("norm")).select("doc_id", "norm", F.sha2("norm", 256).alias("text_sha256")).withColumn("digest", F.substring("text_sha256", 1, digest_hex))


def flushed(batches: Iterator[pa.RecordBatch], memtable_rows: int) -> Iterator[pa.RecordBatch]:
    """Memtables of at most `memtable_rows` rows, each aggregated by digest and sorted."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def run() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).append_column("n", pa.array([1] * rows, pa.int64()))
        table = table.group_by("digest").aggregate([("doc_id", "min"), ("n", "sum")]).sort_by("digest")
        yield from table.select(["digest", "doc_id_min", "n_sum"]).rename_columns(["digest", "min_id", "n"]).to_batches(max_chunksize=65536)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= memtable_rows:
            yield from run()
            held, rows = [], 0
    if rows:
        yield from run()


class DigestIndex:
    """Two levels of Parquet below `path`: level0 has a file for each run, level1 the compacted entries."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_dir(spark)

    def flush(self, digests: DataFrame, memtable_rows: int = 1 << 18) -> None:
        """Append runs for rows (digest string, doc_id long)."""
        runs = arrow_pass(digests.select("digest", F.col("doc_id").cast("long").alias("doc_id")), lambda it: flushed(it, memtable_rows), "digest string, min_id long, n long")
        runs.write.mode("append").options(**FILTERED).parquet(f"{self.path}/level0")

    def compact(self) -> DataFrame:
        merged = self.spark.read.schema("digest string, min_id long, n long").parquet(f"{self.path}/level0").groupBy("digest").agg(F.min("min_id").alias("min_id"), F.sum("n").alias("n"))
        merged.sortWithinPartitions("digest").write.mode("overwrite").options(**FILTERED).parquet(f"{self.path}/level1")
        return self.entries()

    def entries(self) -> DataFrame:
        return self.spark.read.schema("digest string, min_id long, n long").parquet(f"{self.path}/level1")

    def lookup(self, digests: list[str]) -> DataFrame:
        """The entries of a few digests; Parquet's Bloom filters and the sort order skip files and row groups."""
        return self.entries().where(F.col("digest").isin(digests))


def exact_dedup(docs: DataFrame, digest_hex: int = 32, memtable_rows: int = 1 << 18) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. digest_hex: hex digits of SHA-256 in the index."""
    rows = normalized(docs, digest_hex)
    index = DigestIndex(docs.sparkSession)
    index.flush(rows, memtable_rows)
    repeated = index.compact().where("n > 1")
    # Only rows of repeated digests go on with their text; on large inputs Spark's runtime Bloom filter drops the others before the shuffle.
    deals = F.least(F.lit(MOST_DEALS), F.floor(F.col("n") / ROWS_A_DEAL) + 1)
    members = materialize(rows.join(repeated, "digest").select("digest", "doc_id", "norm", F.col("min_id").alias("keep_id"), deals.cast("int").alias("deals")))
    # the text that stays goes to each of the tasks over which a large group is dealt
    stays = members.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "deals").agg(F.min("norm").alias("kept_norm"))
    stays = stays.select("digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    dealt = members.select("digest", "doc_id", "norm", F.pmod(F.xxhash64("doc_id"), F.col("deals")).cast("int").alias("deal"))
    other = materialize(dealt.join(stays, ["digest", "deal"]).where("norm != kept_norm").select("digest", "doc_id", "norm"))
    discard(members)
    found = rows.select("doc_id", "text_sha256", "digest").join(repeated, "digest", "left")
    if other.isEmpty():
        found = found.select("doc_id", F.coalesce("min_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "text_sha256")
    else:
        found = resolved(rows, found, other)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def resolved(rows: DataFrame, found: DataFrame, other: DataFrame) -> DataFrame:
    """Digests under which the byte comparison found different texts: their rows are grouped by the whole text."""
    shared = other.select("digest").distinct()
    alone = found.join(shared, "digest", "left_anti").select("doc_id", F.coalesce("min_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), "text_sha256")
    mixed = rows.join(shared, "digest", "left_semi")
    groups = mixed.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return alone.unionByName(mixed.join(groups, "norm").select("doc_id", "keep_id", "group_size", "text_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
