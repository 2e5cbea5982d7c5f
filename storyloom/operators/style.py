"""Style of texts: fingerprints of style, layers of machine prose, flavour. Narrow passes of built-in functions, n-grams in Arrow batches; only layers that count characters shuffle, and then counts."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from storyloom.functions.columns import clamp, count, distinct_chars, ladder, paragraphs, parts, rounded, sentences, span_chars, total
from storyloom.functions.style import COMPARED, LATIN_FLAVOUR, LATIN_STYLE, FlavourPack, StylePack
from storyloom.functions.tally import frequent_grams, in_slices


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def array_std(values: Column, mean: Column, sample: bool = True) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    n = F.size(values) - (1 if sample else 0)
    return F.when(n > 0, F.sqrt(squares / n)).otherwise(F.lit(0.0))


def words_count(text: Column, words: Sequence[str]) -> Column:
    """How often each of the words occurs, summed; words may overlap each other."""
    return total([((F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)).cast("long") for w in words])


def style_dna(docs: DataFrame, pack: StylePack = LATIN_STYLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The quantities of style of each text in five dimensions. Texts under 50 letters have none but their letters, those under 100 no vocabulary and perspective."""
    c = F.col
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("low", F.lower("text") if pack.lower else c("text"))
    low, letters = c("low"), lambda x: count(x, pack.letters).cast("double")
    base = base.select(key, "low", count(low, pack.letters).alias("chars"), F.transform(sentences(low, pack.ends), letters).alias("lengths"), F.transform(paragraphs(low), letters).alias("para_lengths"), F.size(F.filter(paragraphs(low), lambda p: F.left(p, F.lit(10)).rlike(pack.description))).alias("described"))
    told = F.regexp_replace(low, F.lit(pack.dialogue), F.lit(""))
    counts = base.select(
        key,
        "chars",
        "lengths",
        "para_lengths",
        "described",
        (c("chars") - count(told, pack.letters)).alias("dialogue_letters"),
        distinct_chars(F.regexp_replace(low, F.lit(pack.letters.replace("[", "[^", 1) + "+"), F.lit(""))).alias("distinct_letters"),
        *[count(low, p).alias(n) for n, p in (("idioms", pack.idiom), ("slangs", pack.slang), ("doubles", pack.doubled), ("scenes", pack.scene), ("ironies", pack.irony), ("mockeries", pack.self_mockery), ("darks", pack.dark), ("monologues", pack.monologue), ("omniscients", pack.omniscient))],
        words_count(low, pack.fingerprints).alias("fingerprints"),
        *[count(x, p).alias(n) for n, x, p in (("first_told", told, pack.first), ("third_told", told, pack.third), ("first_all", low, pack.first), ("third_all", low, pack.third))],
    )
    counts = counts.select("*", array_mean(c("lengths")).alias("mean_length"), array_mean(c("para_lengths")).alias("mean_para"))
    enough, most = c("chars") >= 50, c("chars") >= 100
    kilo = F.greatest(c("chars") / 1000.0, F.lit(1.0))
    keep = lambda condition, x: F.when(condition, x).otherwise(F.lit(0.0))
    dense = lambda n: rounded(F.round(c(n) / kilo, 9), 2)
    told_all = c("first_told") + c("third_told")
    ratio = F.when(told_all > 0, c("first_told") / told_all).when(c("first_all") + c("third_all") > 0, c("first_all") / (c("first_all") + c("third_all"))).otherwise(F.lit(0.0))
    out = counts.select(
        key,
        F.col("chars").alias("total_chars"),
        F.when(enough, F.size("lengths")).otherwise(F.lit(0)).cast("long").alias("sentence_count"),
        F.when(enough, F.size("para_lengths")).otherwise(F.lit(0)).cast("long").alias("paragraph_count"),
        keep(enough & (F.size("lengths") > 0), rounded(F.round("mean_length", 9), 1)).alias("avg_sentence_length"),
        keep(enough & (F.size("lengths") > 1), rounded(F.round(array_std(c("lengths"), c("mean_length")), 9), 1)).alias("sentence_length_std"),
        keep(enough, rounded(c("dialogue_letters") / F.greatest("chars", F.lit(1)), 3)).alias("dialogue_ratio"),
        keep(enough, rounded(c("described") / F.greatest(F.size("para_lengths"), F.lit(1)), 3)).alias("description_density"),
        keep(enough, rounded(F.size(F.filter("lengths", lambda x: x <= 12)) / F.greatest(F.size("lengths"), F.lit(1)), 3)).alias("short_sentence_ratio"),
        keep(most, rounded(c("distinct_letters") / F.greatest("chars", F.lit(1)), 4)).alias("vocab_richness"),
        *[keep(most, dense(n)).alias(d) for n, d in (("idioms", "idiom_density"), ("slangs", "slang_density"), ("fingerprints", "fingerprint_density"), ("doubles", "doubled_density"))],
        keep(enough & (F.size("para_lengths") > 0), rounded(F.round("mean_para", 9), 1)).alias("avg_paragraph_length"),
        keep(enough & (F.size("para_lengths") > 1), rounded(F.round(array_std(c("para_lengths"), c("mean_para")), 9), 1)).alias("paragraph_length_std"),
        *[keep(enough, dense(n)).alias(d) for n, d in (("scenes", "scene_density"), ("ironies", "irony_density"), ("mockeries", "self_mockery_density"), ("darks", "dark_density"))],
        *[keep(most, dense(n)).alias(d) for n, d in (("monologues", "monologue_density"), ("omniscients", "omniscient_density"))],
        keep(most, rounded(F.round(ratio, 9), 3)).alias("first_person_ratio"),
    )
    humour = rounded(F.round(c("irony_density") * 0.3 + c("self_mockery_density") * 0.4 + c("dark_density") * 0.3, 9), 2)
    return out.select("*", humour.alias("humour_total"), ladder((c("first_person_ratio") > 0.6, "first"), (c("first_person_ratio") > 0.3, "mixed"), otherwise="third").alias("perspective"))


METRICS = tuple(dict.fromkeys(m for _, m, *_ in COMPARED))


def dna_baseline(dna: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric.., perspective): means of the metrics, the most frequent perspective."""
    means = dna.groupBy(*by).agg(*[rounded(F.round(F.avg(m), 9), 3).alias(m) for m in METRICS], F.sum("total_chars").alias("total_chars"))
    kinds = dna.groupBy(*by, "perspective").agg(F.count("*").alias("n")).groupBy(*by).agg(F.min_by("perspective", F.struct((-F.col("n")).alias("n"), "perspective")).alias("perspective"))
    return means.join(kinds, list(by)) if by else means.join(F.broadcast(kinds))  # one row each without groups


def dna_deviations(target: DataFrame, current: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """(key, dimension, metric, target, current, diff_pct, severity, weight): every compared metric of each text against its baseline, one row a group."""
    c = F.col
    met = current.join(target.select(*by, *[c(m).alias(f"t_{m}") for m in METRICS]), list(by)) if by else current.join(F.broadcast(target.select(*[c(m).alias(f"t_{m}") for m in METRICS])))
    table = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(m).alias("metric"), c(f"t_{m}").cast("double").alias("target"), c(m).cast("double").alias("current"), F.lit(w).alias("weight"), F.lit(a).alias("warn"), F.lit(b).alias("serious")) for d, m, w, a, b in COMPARED])
    rows = met.select(key, F.explode(table).alias("m")).select(key, "m.*")
    pct = F.when((c("target") == 0) & (c("current") == 0), F.lit(0.0)).when(c("target") == 0, F.lit(100.0)).otherwise(F.round(F.abs(c("current") - c("target")) / F.abs("target") * 100, 9))
    return rows.withColumn("pct", pct).select(key, "dimension", "metric", "target", "current", rounded(c("pct"), 1).alias("diff_pct"), ladder((c("pct") >= c("serious"), "serious"), (c("pct") >= c("warn"), "warning"), otherwise="ok").alias("severity"), "weight")


def dna_consistency(deviations: DataFrame, key: str, most: int = 5) -> DataFrame:
    """(key, consistency, grade, issues): 100 less the weighted deviation of the dimensions, and the metrics that deviate most."""
    c = F.col
    dims = deviations.groupBy(key, "dimension").agg(F.sum(c("diff_pct") * c("weight")).alias("s"), F.sum("weight").alias("w"), F.collect_list(F.when(c("severity") != "ok", F.struct((-c("diff_pct")).alias("d"), "metric"))).alias("bad"))
    dims = dims.select(key, "w", "bad", rounded(F.round(c("s") / F.greatest("w", F.lit(1.0)), 9), 1).alias("deviation"))
    each = dims.groupBy(key).agg(rounded(F.round(F.greatest(F.lit(0.0), 100 - F.sum(c("deviation") * c("w")) / F.greatest(F.sum("w"), F.lit(1.0))), 9), 1).alias("consistency"), F.flatten(F.collect_list("bad")).alias("bad"))
    issues = F.concat_ws(",", F.transform(F.slice(F.array_sort("bad"), 1, most), lambda x: x["metric"]))
    return each.select(key, "consistency", ladder((c("consistency") >= 85, "A"), (c("consistency") >= 70, "B"), (c("consistency") >= 55, "C"), otherwise="D").alias("grade"), issues.alias("issues"))


def characters(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, c, n): counts of the characters of a text but white space; partial counts are made where the text is read."""
    return docs.select(key, F.explode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"\s"), F.lit("")), "")).alias("c")).where("c <> ''").groupBy(key, "c").agg(F.count("*").alias("n"))


def unigram_perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(key, perplexity): two to the entropy of a text's characters; 0 for texts under `least` characters."""
    n = characters(docs, key, text)
    p = F.col("n") / F.sum("n").over(Window.partitionBy(key))
    each = n.select(key, "n", (-p * F.log2(p)).alias("h")).groupBy(key).agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
    return each.select(key, F.when(F.col("n") < least, F.lit(0.0)).otherwise(rounded(F.round(F.pow(F.lit(2.0), "h"), 6), 2)).alias("perplexity"))


def bigram_perplexity(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    """(key, perplexity) of each character after the one before it, under the text's own frequencies; 0 for texts under `least` characters."""
    chars = docs.select(key, F.split(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(r"\s"), F.lit("")), "").alias("s")).select(key, F.filter("s", lambda x: x != "").alias("s"))
    size = F.greatest(F.size("s") - 1, F.lit(0))
    pairs = chars.select(key, F.explode(F.arrays_zip(F.slice("s", F.lit(1), size).alias("a"), F.slice("s", F.lit(2), size).alias("b"))).alias("p")).groupBy(key, "p.a", "p.b").agg(F.count("*").alias("n"))
    single = characters(docs, key, text).select(key, F.col("c").alias("a"), F.col("n").alias("m"), F.sum("n").over(Window.partitionBy(key)).alias("total"))
    met = pairs.join(single, [key, "a"])
    c = F.col
    each = met.groupBy(key).agg(F.sum(-F.log2((c("n") / (c("total") - 1)) / (c("m") / c("total"))) * c("n")).alias("s"), F.max("total").alias("total"))
    return each.select(key, F.when(c("total") < least, F.lit(0.0)).otherwise(rounded(F.round(F.pow(F.lit(2.0), c("s") / (c("total") - 1)), 6), 2)).alias("perplexity"))


def sentence_layers(docs: DataFrame, ends: str = ".!?", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, burstiness, top_prefix, overlap): variation of sentence lengths, the share of the most frequent beginning, the overlap of neighbours; inside the row."""
    c = F.col
    base = docs.select(key, parts(F.coalesce(text, F.lit("")), rf"[{ends}\n]+").alias("s"))
    base = base.select(key, "s", F.transform("s", lambda x: F.length(x).cast("double")).alias("lengths"), F.filter("s", lambda x: F.length(x) > 2).alias("s3"), F.transform(F.filter("s", lambda x: F.length(x) > 5), lambda x: F.array_distinct(F.split(x, ""))).alias("sets"))
    heads = F.transform("s3", lambda x: F.left(x, F.lit(3)))
    base = base.select(key, "lengths", "s3", "sets", array_mean(c("lengths")).alias("mean"), heads.alias("heads"))
    top = F.array_max(F.transform(F.array_distinct("heads"), lambda h: F.size(F.filter("heads", lambda x: x == h))))
    pairs = F.zip_with(F.slice("sets", F.lit(1), F.greatest(F.size("sets") - 1, F.lit(0))), F.slice("sets", F.lit(2), F.greatest(F.size("sets") - 1, F.lit(0))), lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    return base.select(
        key,
        F.size("lengths").cast("long").alias("n"),
        F.when((F.size("lengths") >= 3) & (c("mean") >= 1), rounded(F.round(array_std(c("lengths"), c("mean"), False) / c("mean"), 9), 4)).otherwise(F.lit(0.0)).alias("burstiness"),
        F.when(F.size("s3") >= 5, rounded(top / F.size("s3"), 4)).otherwise(F.lit(0.0)).alias("top_prefix"),
        F.when(F.size("sets") >= 3, rounded(F.round(array_mean(pairs), 9), 4)).otherwise(F.lit(0.0)).alias("overlap"),
    )


def fingerprint_density(docs: DataFrame, words: dict[str, Sequence[str]], key: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """(key, total, high_risk, density, rate): words of each risk class outside quotations, by 1000 characters."""
    told = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))) if lower else F.coalesce(text, F.lit("")), F.lit('"[^"\\n]*"'), F.lit(""))
    base = docs.select(key, told.alias("t")).select(key, F.length(F.translate("t", "\n ", "")).alias("chars"), *[words_count(F.col("t"), w).alias(k) for k, w in words.items()])
    hits = total([F.col(k) for k in words])
    density = hits / F.greatest(F.col("chars") / 1000.0, F.lit(1.0))
    return base.select(key, hits.alias("total"), F.col(next(iter(words))).alias("high_risk"), rounded(F.round(density, 9), 2).alias("density"), rounded(F.round(F.least(F.lit(1.0), hits / F.greatest("chars", F.lit(1)) / 0.01), 9), 3).alias("rate"))


def style_layers(unigram: DataFrame, bigram: DataFrame, layers: DataFrame, fingerprints: DataFrame, key: str = "doc_id", baseline: float | None = None) -> DataFrame:
    """(key, flags, verdict): how many of seven layers speak for a machine: none is fine, two at most a warning."""
    c = F.col
    met = layers.join(unigram.withColumnRenamed("perplexity", "uni"), key, "left").join(bigram.withColumnRenamed("perplexity", "bi"), key, "left").join(fingerprints.select(key, "density"), key, "left")
    drop = (baseline - c("burstiness")) / baseline >= 0.2 if baseline else c("burstiness") <= 0.3
    flags = [(c("uni") > 0) & (c("uni") <= 40), (c("n") >= 3) & (c("burstiness") <= 0.6), c("density") > 2, (c("n") >= 3) & drop, c("top_prefix") >= 0.4, (c("overlap") > 0) & ~((c("overlap") > 0.2) & (c("overlap") < 0.85)), (c("bi") > 0) & (c("bi") <= 5)]
    n = total([F.coalesce(f, F.lit(False)).cast("long") for f in flags])
    return met.select(key, n.alias("flags"), ladder((n == 0, "pass"), (n <= 2, "warning"), otherwise="fail").alias("verdict"))


def human_flavour(docs: DataFrame, pack: FlavourPack = LATIN_FLAVOUR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, positive scores, penalty, score, grade): 50 and half the mean of five marks of living prose, less what betrays a machine."""
    c = F.col
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).select(key, (F.lower("text") if pack.lower else c("text")).alias("t"))
    t = c("t")
    base = base.select(key, count(t, pack.letters).alias("chars"), words_count(t, pack.banned_transitions).alias("transitions"), words_count(t, pack.banned_descriptions).alias("descriptions"), *[count(t, p).alias(n) for n, p in (("mistakes", pack.mistakes), ("preaching", pack.preaching), ("sensory", pack.sensory), ("direct", pack.direct_emotion), ("life", pack.life))], F.regexp_extract_all(t, F.lit(pack.line), 1).alias("lines"), F.transform(F.filter(parts(t, rf"[{pack.ends}\n]"), lambda x: F.length(x) >= 5), lambda x: F.length(x).cast("double")).alias("lengths"))

    def natural(x: Column) -> Column:
        tenths = F.when(F.length(x) <= 15, 30).when(F.length(x) <= 25, 15).otherwise(0) + F.when(x.rlike(pack.particles), 20).otherwise(0) + F.when(x.rlike(r"[，…\.]{2,}"), 15).otherwise(0) + F.when(~x.rlike(rf"^.{{20,}}[{pack.ends}]\z"), 10).otherwise(0) + F.when(~x.rlike(pack.connectives), 10).otherwise(0)
        return tenths.cast("double") / 100

    kilo = c("chars") / 1000.0
    long_enough = c("chars") >= 100
    in_letters = lambda x: F.when(long_enough, rounded(F.round(x, 9), 3)).otherwise(F.lit(0.0))
    base = base.select("*", array_mean(c("lengths")).alias("mean"))
    scored = base.select(
        key,
        "transitions",
        "descriptions",
        F.coalesce(rounded(F.round(array_mean(F.transform("lines", natural)), 9), 3), F.lit(0.0)).alias("naturalness"),
        in_letters(F.least(c("sensory") / kilo / 5, F.lit(1.0))).alias("sensory"),
        in_letters(F.greatest(F.lit(0.0), 1 - c("direct") / kilo / 3)).alias("restraint"),
        F.when((F.size("lengths") >= 5) & (c("mean") > 0), rounded(F.round(F.least(array_std(c("lengths"), c("mean")) / c("mean") / 0.5, F.lit(1.0)), 9), 3)).otherwise(F.lit(0.0)).alias("variety"),
        in_letters(F.least(c("life") / kilo / 2, F.lit(1.0))).alias("life"),
        (~long_enough | (F.round(c("mistakes") / kilo, 9) < 0.5)).alias("perfect"),
        F.when(long_enough, rounded(F.round(c("preaching") / kilo, 9), 2)).otherwise(F.lit(0.0)).alias("preaching"),
    )
    marks = ("naturalness", "sensory", "restraint", "variety", "life")
    penalty = F.least(c("transitions") * 3, F.lit(30)) + F.least(c("descriptions") * 5, F.lit(25)) + F.when(c("perfect"), 15).otherwise(0) + F.when(c("preaching") > 0.3, F.least(c("preaching") * 20, F.lit(20.0))).otherwise(F.lit(0.0))
    scored = scored.withColumn("penalty", F.round(penalty, 6))
    score = F.round(F.round(clamp(50 + total([c(m) for m in marks]) / 5 * 50 - c("penalty"), 0, 100), 6))
    scored = scored.withColumn("score", score)
    return scored.select(key, *marks, "penalty", "score", ladder((c("score") >= 80, "A"), (c("score") >= 60, "B"), (c("score") >= 40, "C"), otherwise="D").alias("grade"))


def gradient_validation(steps: DataFrame, error: str, by: str, order: Sequence[str], success: bool = True) -> DataFrame:
    """The rows with the running product of (1 - error), or of the errors."""
    factor = 1 - F.col(error) if success else F.col(error)
    running = F.sum(F.log(F.greatest(factor, F.lit(1e-12)))).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("cumulative", rounded(F.round(F.exp(running), 9), 6))


#: Bytes of runs of letters whose n-grams a worker counts at once, at some 80 bytes of memory each.
GRAM_BYTES = 1 << 20
#: Repeated keys that are broadcast, and rows of one key that are counted together.
FEW_KEYS, ROWS_TOGETHER = 500_000, 32


def top_ngrams(docs: DataFrame, sizes: Sequence[int] = (2, 3, 4), letters: str = "[a-zà-ÿ]", most: int = 20, least: int = 2, skip: Sequence[str] = (), key: str = "doc_id", text: str = "text", lower: bool = True) -> DataFrame:
    """(key, gram, n, place): the most frequent n-grams inside runs of letters of each text. A text is counted where it is read, and its first n-grams alone leave its task. Texts of keys that several rows have meet to be counted together; where these are very many, the counts of each ROWS_TOGETHER of them are summed up."""
    side = F.coalesce(text, F.lit(""))
    runs = lambda t: F.regexp_extract_all(F.lower(t) if lower else t, F.lit(f"({letters}+)"), 1)

    def counts(rows: DataFrame, **limits) -> DataFrame:
        make = functools.partial(frequent_grams, sizes=tuple(sizes), **limits)
        schema = StructType([rows.schema[key], StructField("gram", StringType()), StructField("n", LongType()), StructField("place", LongType())])
        return rows.mapInArrow(functools.partial(in_slices, make=make, size=GRAM_BYTES), schema)

    own = {"least": least, "skip": tuple(skip), "most": most}
    repeated = docs.groupBy(F.col(key).alias("#key")).agg(F.count("*").alias("#rows")).where(F.col("#rows") > 1)
    found = repeated.limit(FEW_KEYS + 1).count()
    if not found:
        return counts(docs.select(key, runs(side)), **own)
    repeated = F.broadcast(repeated) if found <= FEW_KEYS else repeated
    met, parts = F.col(key).eqNullSafe(F.col("#key")), F.ceil(F.col("#rows") / ROWS_TOGETHER)
    alone = docs.join(repeated, met, "left_anti").select(key, runs(side))
    texts = docs.select(key, side.alias("#text"), F.monotonically_increasing_id().alias("#row")).join(repeated, met)
    shared = texts.groupBy(key, parts.alias("#parts"), (F.col("#row") % parts).alias("#part")).agg(F.collect_list("#text").alias("#texts"))
    together = lambda condition: shared.where(condition).select(key, F.flatten(F.transform("#texts", runs)))
    n = counts(together(F.col("#parts") > 1)).groupBy(key, "gram").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & ~F.col("gram").isin([*skip, ""]))
    summed = n.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "gram")).cast("long")).where(F.col("place") <= most)
    return counts(alone, **own).unionByName(counts(together(F.col("#parts") == 1), **own)).unionByName(summed)
