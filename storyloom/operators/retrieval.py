"""Retrieval: keyword scores (BM25), dense neighbours, fusion by reciprocal rank; look-ups of cards and experiences; top rows by group.

Queries are a stated set, met by all rows. Texts are cut into words once; only words of queries go on. Dense vectors meet blocks
of queries as matrix products in Arrow batches, and each task keeps the best rows of each query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.columns import rounded, total

K1, B, RRF = 1.5, 0.75, 60
#: Rows of a catalogue or of query words that are broadcast at most, and queries in a block of dense search.
CATALOGUE, BLOCK = 100_000, 20_000
#: Queries and rows that meet in one matrix of scores, of 8 MB.
TILE = (2048, 512)
# Function words of the four languages of the sample tables, in place of the reference's stop words.
STOP_WORDS = """
    the and is in at have he this that of or to not also but with we you they it an a
    le la les et est dans je il ce cette que un une des ou ne pas aussi mais avec nous vous ils
    der die das und ist in ich er dies ein eine oder nicht auch aber mit wir sie es von zu
    el los las y es en yo este esta que uno una o no también pero con nosotros ellos de
""".split()


def words(text: Column, pattern: str = "[a-zà-ÿ]+", stop: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Words of two letters and more without stop words, with repeats."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), 1), lambda w: (F.length(w) > 1) & ~w.isin(sorted(set(stop))))


def small(rows: DataFrame, limit: int = CATALOGUE) -> DataFrame:
    """Rows that are broadcast if there are few of them; the check counts `limit` rows at most."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", query: str = "item_id", text: str = "text") -> DataFrame:
    """(query, key, score) of every document that shares a word with a query. text: a column of texts, or of words that were cut before."""
    cut_of = lambda rows: F.col(text) if rows.schema[text].dataType.typeName() == "array" else words(F.col(text))
    asked = queries.select(query, F.explode(F.array_distinct(cut_of(queries))).alias("word"))
    cut = docs.select(key, cut_of(docs).alias("w")).select(key, "w", F.size("w").alias("dl"))
    facts = cut.agg(F.count("*").alias("docs"), (F.sum("dl") / F.count_if(F.col("dl") > 0)).alias("mean"))
    few = small(asked.select("word").distinct())
    tf = cut.select(key, "dl", F.explode("w").alias("word")).join(few, "word", "left_semi").groupBy(key, "word").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    c = F.col
    scored = tf.join(df, "word").join(F.broadcast(facts))
    idf = F.log(1 + (c("docs") - c("df") + 0.5) / (c("df") + 0.5))
    part = scored.select(key, "word", (idf * c("tf") * (K1 + 1) / (c("tf") + K1 * (1 - B + B * c("dl") / c("mean")))).alias("s"))
    return part.join(asked, "word").groupBy(query, key).agg(F.sum("s").alias("score"))


def ranked(scores: DataFrame, query: str, key: str, most: int, digits: int = 6) -> DataFrame:
    """(query, key, score, place): the best rows of each query, ties by key."""
    place = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(F.round("score", digits)), key)).cast("long")
    return scores.withColumn("place", place).where(F.col("place") <= most)


def neighbours(rows: DataFrame, queries: DataFrame, key: str, query: str, vector: str, most: int, skip_self: bool = False) -> DataFrame:
    """(query, key, score): the `most` rows of largest cosine of each query. Vectors are made unit length once; zero vectors have cosine 0."""
    spark = rows.sparkSession
    parts: list[DataFrame] = []
    asked = queries.select(F.col(query).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v"))
    n = asked.count()
    blocks = max(1, -(-n // BLOCK))
    for b in range(blocks):
        block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).collect()  # a block of bounded size
        shared = spark.sparkContext.broadcast((np.array([r.q for r in block], np.int64), unit(np.array([r.v for r in block], np.float64)) if block else np.zeros((0, 0))))
        parts.append(rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(lambda it, shared=shared: nearest(it, *shared.value, most, skip_self), "q long, key long, score double"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return ranked(found.select(F.col("q").alias(query), F.col("key").alias(key), "score"), query, key, most, 7)


def unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray, most: int, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """The best `most` rows of this task for each query; equal scores (to seven digits) go to the smaller key.

    Beside the best rows there is one tile of scores at a time. Only scores that reach a query's last best one, or tie with it, are sorted in.
    """
    best_key, best_score = np.zeros((len(ids), most), np.int64), np.full((len(ids), most), -np.inf)
    for batch in batches:
        if not batch.num_rows or not len(ids):
            continue
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        rows = unit(np.stack(batch.column("v").to_numpy(zero_copy_only=False)))
        for at in range(0, len(keys), TILE[1]):
            k, some = keys[at : at + TILE[1]], rows[at : at + TILE[1]].T
            for q in range(0, len(ids), TILE[0]):
                score = vectors[q : q + TILE[0]] @ some
                if skip_self:
                    score[ids[q : q + TILE[0], None] == k[None, :]] = -np.inf
                reached = (score >= best_score[q : q + TILE[0], -1:] - 1e-7) & (score > -np.inf)
                i, j = np.nonzero(reached)
                merge(best_key[q : q + TILE[0]], best_score[q : q + TILE[0]], i, k[j], score[i, j])
    for at in range(0, len(ids), 4096):
        k, s = best_key[at : at + 4096], best_score[at : at + 4096]
        ok = np.isfinite(s)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[at : at + 4096, None], k.shape)[ok]), pa.array(k[ok]), pa.array(s[ok])], names=["q", "key", "score"])


def merge(best_key: np.ndarray, best_score: np.ndarray, query: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
    """Sort new scores of some queries (places in the arrays) into their best rows, in place."""
    met = np.unique(query)
    if not len(met):
        return
    most = best_key.shape[1]
    query, key, score = np.concatenate([np.repeat(met, most), query]), np.concatenate([best_key[met].ravel(), key]), np.concatenate([best_score[met].ravel(), score])
    order = np.lexsort((key, -np.round(score, 7), query))
    query, key, score = query[order], key[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    top = place < most
    best_key[query[top], place[top]], best_score[query[top], place[top]] = key[top], score[top]


def fused(first: DataFrame, second: DataFrame, query: str, key: str, most: int = 10) -> DataFrame:
    """(query, key, similarity, first_rank, second_rank, place): two rankings of the same rows, fused by reciprocal rank, scaled to 0 .. 1 among those returned."""
    met = first.select(query, key, F.col("place").alias("first_rank")).join(second.select(query, key, F.col("place").alias("second_rank")), [query, key], "full_outer")
    score = total([F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0)) for c in ("first_rank", "second_rank")])
    top = ranked(met.withColumn("score", score), query, key, most, 9)
    w = Window.partitionBy(query)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return top.select(query, key, rounded(F.round((F.col("score") - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)), 9), 3).alias("similarity"), "first_rank", "second_rank", "place")


def as_array(catalogue: DataFrame, limit: int = CATALOGUE) -> DataFrame:
    """A catalogue of checked size as one row with an array of its rows, in order of their id."""
    if catalogue.limit(limit + 1).count() > limit:
        raise ValueError(f"the catalogue has more than {limit} rows")
    return catalogue.agg(F.array_sort(F.collect_list(F.struct(*catalogue.columns))).alias("catalogue"))


ORDER = ("opening", "early", "mid", "late", "ending")


def place_name(number: Column, n: Column) -> Column:
    """The part of a book in which a chapter lies, by its place in per cent."""
    pct = number / n * 100
    return F.when(n <= 0, "any").when(pct <= 10, "opening").when(pct <= 30, "early").when(pct <= 70, "mid").when(pct <= 90, "late").otherwise("ending")


def best_cards(contexts: DataFrame, cards: DataFrame, by: Sequence[str], position: str, wanted: str, most: int = 5) -> DataFrame:
    """(by, id, score, place): the cards (id, position, keywords, text, severity) that fit a context best: the same part of a book, next to it or any, key words in the card's own or in its text, rules before benchmarks. Cards are a catalogue; no pair of context and card becomes a row."""
    index = lambda x: F.array_position(F.array(*[F.lit(o) for o in ORDER]), x)

    def score(card: Column) -> Column:
        here = F.col(position)
        fits = F.when(card["position"] == here, 3.0).when(card["position"] == "any", 1.0).when((index(card["position"]) > 0) & (index(here) > 0) & (F.abs(index(card["position"]) - index(here)) == 1), 1.5).otherwise(0.0)
        named = F.aggregate(F.col(wanted), F.lit(0.0), lambda a, k: a + F.when(F.array_contains(card["keywords"], k), 2.0).when(F.contains(card["text"], k), 1.0).otherwise(0.0))
        return fits + named + F.when(card["severity"] == "rule", 1.0).when(card["severity"] == "benchmark", 0.5).otherwise(0.0)

    scored = contexts.join(F.broadcast(as_array(cards))).select(*by, F.transform("catalogue", lambda card: F.struct((-score(card)).alias("m"), card["id"].alias("id"))).alias("s"))
    top = F.slice(F.array_sort(F.filter("s", lambda x: x["m"] < 0)), 1, most)
    return scored.select(*by, F.posexplode(top).alias("p", "s")).select(*by, F.col("s.id").alias("id"), (-F.col("s.m")).alias("score"), (F.col("p") + 1).cast("long").alias("place"))


def best_experiences(contexts: DataFrame, experiences: DataFrame, by: Sequence[str], genre: str, wanted: str, most: int = 5) -> DataFrame:
    """(by, id, score, place): experiences (id, tags, genre, is_global, symptom, severity, hits) that bear on a context at all, by tags, genre and symptom; then global ones, grave ones and often met ones first."""

    def score(e: Column) -> Column:
        tags = F.size(F.array_intersect(e["tags"], F.concat(F.col(wanted), F.array(F.col(genre))))) * 2.0
        kin = F.when(e["genre"].isNotNull() & (e["genre"] == F.col(genre)), 1.0).when(e["is_global"] & e["genre"].isNull(), 0.5).otherwise(0.0)
        symptom = F.aggregate(F.col(wanted), F.lit(0.0), lambda a, k: a + F.when(F.contains(e["symptom"], k), 1.0).otherwise(0.0))
        relevance = tags + kin + symptom
        return F.when(relevance > 0, relevance + F.when(e["is_global"], 1.5).otherwise(0.0) + e["severity"] * 0.5 + F.least(e["hits"] * 0.3, F.lit(3.0))).otherwise(F.lit(0.0))

    scored = contexts.join(F.broadcast(as_array(experiences))).select(*by, F.transform("catalogue", lambda e: F.struct((-F.round(score(e), 6)).alias("m"), (-e["severity"]).alias("v"), (-e["hits"]).alias("h"), e["id"].alias("id"))).alias("s"))
    top = F.slice(F.array_sort(F.filter("s", lambda x: x["m"] < 0)), 1, most)
    return scored.select(*by, F.posexplode(top).alias("p", "s")).select(*by, F.col("s.id").alias("id"), (-F.col("s.m")).alias("score"), (F.col("p") + 1).cast("long").alias("place"))


def tagged(cards: DataFrame, tags: Sequence[str], every: bool = False, column: str = "tags") -> DataFrame:
    want = F.array(*[F.lit(x) for x in tags])
    return cards.where(F.size(F.array_except(want, column)) == 0 if every else F.arrays_overlap(column, want))


def search(rows: DataFrame, words_: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of which a column contains one of the words."""
    hit = F.lit(False)
    for c in columns:
        for w in words_:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False))
    return rows.where(hit)


def top_classes(rows: DataFrame, by: str, kind: str, order: str, most: int = 3) -> DataFrame:
    """(by, kind, n, k): the most frequent classes, the first met of equal ones first."""
    n = rows.groupBy(by, kind).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "first")).cast("long")).where(F.col("k") <= most).drop("first")


def even_sample(rows: DataFrame, by: str, number: str, k: int = 5) -> DataFrame:
    """Every n//k-th row of a group."""
    n = F.count("*").over(Window.partitionBy(by))
    return rows.withColumn("n", n).where((F.col(number) - 1) % F.greatest(F.floor(F.col("n") / k), F.lit(1)) == 0).drop("n")
