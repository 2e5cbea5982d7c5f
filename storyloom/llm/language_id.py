"""Language identification by prediction with partial matching.

Each language has a byte context tree of variable depth, up to ORDER bytes: a context exists where the training texts have
it. A context's symbol costs -log2 c/(n+d) bits (c: times the symbol followed the context, n: all times, d: distinct
symbols); a symbol that never followed pays the escape d/(n+d) and the price of the next shorter context, down to equal
shares for all 256 bytes; a context that was never seen costs nothing and hands on to the next shorter one. Statistics
are frozen after training, so a text's exact code length is the sum of looked-up prices. Before a text lie spaces.

The trees are kept as sorted arrays of byte sequences, one for each depth, joined over all languages; a sequence that any
language has seen holds its full price in every language. Only the distinct sequences of a batch are looked up.

Training takes at most `per_language` labelled documents of a language (those with the smallest hash of doc_id) and at
most `sample` in all. A value of `lang` teaches with `least` labelled documents at least; of more than `most_languages`
such values those with most documents do (ties: first by name). So the model is bounded by these four parameters, whatever
the corpus. Counts are made in tasks and summed in Spark. The prediction is one narrow pass over the texts.

Defined results: `und` with score 0 for texts that are null or hold no letter, and for all where nothing could be
learned; else the language of the shortest code (ties: first by name) and its share of the probability, 2**-bits, of
all languages. Unlabelled, null or empty texts teach nothing; repeated rows get equal results and teach as often as they
are drawn; a null doc_id teaches as any other. A long text is priced in parts, which see the bytes before them. An empty
table gives no rows. Other columns, whatever their names, pass through in `row`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, flat_bytes, give_back, read, slices

ORDER = 4
UNKNOWN = "und"
#: Bytes that are priced at once.
PART = 1 << 18


class Level(NamedTuple):
    """Of contexts of one length: sequences (context and symbol) with their bits, contexts with the bits of an escape; a column a language."""

    grams: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


class Model(NamedTuple):
    langs: list[str]
    levels: list[Level]  # by length of the context, from 0


def sequences(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each byte the number of it (lowest) and the ORDER bytes before it; starts: where texts begin."""
    out = raw.astype(np.uint64)
    for back in range(1, ORDER + 1):
        before = np.full(len(raw), 32, np.uint64)
        before[back:] = raw[:-back] if len(raw) > back else before[back:]
        for k in range(back):  # the first bytes of a text do not see the text before
            at = starts + k
            before[at[at < len(before)]] = 32
        out |= before << np.uint64(8 * back)
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            raw, off = flat_bytes(part.column("text"))
            langs, lang = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            grams = sequences(raw, off[:-1][off[:-1] < off[1:]])
            of = np.repeat(lang, np.diff(off))
            for i, name in enumerate(langs.tolist()):
                g, n = np.unique(grams[of == i], return_counts=True)
                for at in range(0, len(g), 65536):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(g[at : at + 65536]), pa.string()), pa.array(g[at : at + 65536].astype(np.int64)), pa.array(n[at : at + 65536].astype(np.int64))], names=["lang", "gram", "n"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def drawn(docs: DataFrame, per_language: int, sample: int, least: int, most_languages: int) -> DataFrame:
    """The bounded training sample: lang, text."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & (F.coalesce(F.length("text"), F.lit(0)) > 0))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "lang").limit(most_languages).collect()  # at most most_languages rows
    if not sizes:
        return usable.where("false").select("lang", "text")
    take = max(1, min(per_language, sample // len(sizes)))
    # far more than `take` rows of each language stay below its limit of the hash, so the ranking sees a few hundred rows of each
    limits = [(r.lang, min(1.0, (take + 10 * take**0.5 + 10) / r.n)) for r in sizes]
    spark = docs.sparkSession
    share = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    near = usable.join(F.broadcast(spark.createDataFrame(limits, "lang string, most double")), "lang").withColumn("h", share).where(F.col("h") < F.col("most"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))))
    return ranked.where(F.col("rank") <= take).select("lang", "text")


def train(docs: DataFrame, per_language: int = 300, sample: int = 4000, least: int = 3, most_languages: int = 64) -> Model:
    """docs: doc_id, text, lang; held-out documents are left out here."""
    sample_rows = drawn(docs, per_language, sample, least, most_languages)
    rows = arrow_pass(sample_rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), counted, "lang string, gram long, n long")
    sums = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list("gram").alias("grams"), F.collect_list("n").alias("ns")).toArrow()  # a row a language
    parts = sorted(zip(sums["lang"].to_pylist(), range(len(sums)), strict=True))
    numbers = lambda name, i: sums[name].combine_chunks().slice(i, 1).flatten().to_numpy(zero_copy_only=False)
    model = built([x for x, _ in parts], [(numbers("grams", i).astype(np.uint64), numbers("ns", i).astype(np.float64)) for _, i in parts])
    del sums
    give_back()
    return model


def built(langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of languages with their counts of sequences of ORDER + 1 bytes."""
    levels: list[Level] = []
    for order in range(ORDER + 1 if langs else 0):
        mask = np.uint64((1 << (8 * (order + 1))) - 1)
        own = []
        for grams, n in counts:
            g, inverse = np.unique(grams & mask, return_inverse=True)
            own.append((g, np.bincount(inverse, n)))
        grams = np.unique(np.concatenate([g for g, _ in own]))
        contexts = np.unique(grams >> np.uint64(8))
        bits, escapes = np.zeros((len(grams), len(langs)), np.float32), np.zeros((len(contexts), len(langs)), np.float32)
        shorter = np.full((len(grams), len(langs)), 8, np.float32)
        if order:
            shorter = levels[-1].bits[np.searchsorted(levels[-1].grams, grams & (mask >> np.uint64(8)))]
        at = np.searchsorted(contexts, grams >> np.uint64(8))
        for j, (g, c) in enumerate(own):
            known = np.searchsorted(contexts, g >> np.uint64(8))
            n, d = np.bincount(known, c, len(contexts)), np.bincount(known, minlength=len(contexts))
            seen = n > 0
            escapes[seen, j] = -np.log2(d[seen] / (n[seen] + d[seen]))
            bits[:, j] = escapes[at, j] + shorter[:, j]
            bits[np.searchsorted(grams, g), j] = -np.log2(c / (n[known] + d[known]))
        levels.append(Level(grams, bits, contexts, escapes))
    return Model(langs, levels)


def prices(model: Model, grams: np.ndarray) -> np.ndarray:
    """Bits of sequences of ORDER + 1 bytes, a column a language."""
    out = np.zeros((len(grams), len(model.langs)), np.float32)
    rest, left = np.arange(len(grams)), grams
    for order in range(ORDER, -1, -1):
        level = model.levels[order]
        at = np.minimum(np.searchsorted(level.grams, left), len(level.grams) - 1)
        hit = level.grams[at] == left
        out[rest[hit]] += level.bits[at[hit]]
        rest, left = rest[~hit], left[~hit]
        at = np.minimum(np.searchsorted(level.contexts, left >> np.uint64(8)), len(level.contexts) - 1)
        hit = level.contexts[at] == left >> np.uint64(8)
        out[rest[hit]] += level.escapes[at[hit]]
        left = left & np.uint64((1 << (8 * order)) - 1)
    out[rest] += 8
    return out


def code_lengths(model: Model, column: pa.Array) -> np.ndarray:
    """Bits of each text in each language."""
    raw, off = flat_bytes(column)
    grams = sequences(raw, off[:-1][off[:-1] < off[1:]])
    total = np.zeros((len(off) - 1, len(model.langs)))
    for at in range(0, len(raw), PART):
        distinct, inverse = np.unique(grams[at : at + PART], return_inverse=True)
        bits = prices(model, distinct)[inverse]
        low, high = np.searchsorted(off, at, side="right") - 1, np.searchsorted(off, min(at + PART, len(raw)))
        begin = np.maximum(off[low:high] - at, 0)
        full = np.flatnonzero(np.diff(np.append(begin, len(bits))) > 0)
        total[low + full] += np.add.reduceat(bits, begin[full], axis=0, dtype=np.float64)
    return total


def scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    langs = np.array([*model.langs, UNKNOWN], dtype=object)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            n = part.num_rows
            best, score = np.full(n, len(model.langs)), np.zeros(n)
            ok = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            if model.langs and ok.any():
                bits = code_lengths(model, part.column("text"))
                best[ok] = bits[ok].argmin(axis=1)
                score[ok] = 1 / np.exp2(np.maximum(bits[ok].min(axis=1, keepdims=True) - bits[ok], -1000)).sum(axis=1)
            columns = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] not in ("text", "lettered")]
            names = [x for x in part.schema.names if x not in ("text", "lettered")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs[best].tolist(), pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """row (the documents' columns, without text unless keep_text), lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [docs[c] for c in docs.columns if keep_text or c != "text"]
    rows = docs.select(F.struct(*columns).alias("row"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("row", "text", F.col("text").rlike(r"\p{L}").alias("lettered"))
    return arrow_pass(rows, lambda it: scored(it, shared.value), f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
