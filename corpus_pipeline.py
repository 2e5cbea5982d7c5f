"""The corpus pipeline: language identification, line dedup, near-dedup, substring dedup and packing, in this order.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept, and returns a DataFrame
that `run` writes as Parquet and reads again for the next one; then what the stage before it left is removed. All stages but the last return the columns of documents.

1. language: documents without a language (null, or without a letter) go. Where no language could be learned, all others pass.
2. lines: lines that many documents share stay in one of them only.
3. near_duplicates: of documents that are alike, that with the smallest doc_id stays.
4. substrings: passages of 20 words and more that stand earlier elsewhere are cut out.
5. packing: token sequences for training.

Defined results: null and empty texts go in the first stage, as they have no letter; a text that loses all its lines goes on
as the empty text; rows that repeat id and text pass or go together, and near duplicates keep both rows of one document; a
null doc_id counts as the smallest where the order matters; extra columns pass through all stages but the last unchanged,
whatever their names; a very long text is treated whole in each stage; an empty table gives no rows. n_chars is renewed
where the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import discard, materialize, read
from storyloom.llm.language_id import UNKNOWN, identify, train
from storyloom.llm.line_dedup import line_dedup
from storyloom.llm.minhash import near_dedup
from storyloom.llm.packing import byte_bpe_path, pack
from storyloom.llm.substring_dedup import substring_dedup


def _columns(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: a struct `row` of all columns but text, and text. The columns of docs in their order, n_chars renewed."""
    chosen = []
    for c in docs.columns:
        if c == "text":
            chosen.append(F.col("text"))
        elif c == "n_chars":
            chosen.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            chosen.append(F.col("row")[c].alias(c))
    return rows.select(*chosen)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs, train(docs.select("doc_id", "text", "lang")), keep_text=True)
    return found.where((F.col("lang_pred") != UNKNOWN) | F.col("row.text").rlike(r"\p{L}")).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(docs, line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _columns(docs, substring_dedup(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, byte_bpe_path())


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: SQL can't express the language model, the components of near duplicates and the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
            if i:
                discard(before)
    return docs
