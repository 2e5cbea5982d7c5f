"""Books against pools of books: summaries, percentiles, shrunken ranks, scores, gates, attribution.

Chapters are aggregated to one row a book before anything compares books, so windows over a pool see a row of a few numbers
for each book. A pool is a genre or another group of books, named by columns; without names all books are one pool.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from storyloom.functions.columns import clamp, ladder, rounded, total
from storyloom.operators.sequence import longest_run, pleasure_level, variability


def pool_of(pool: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*pool) if pool else Window.partitionBy(F.lit(0))


def share(condition: Column) -> Column:
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def mean9(x: Column | str) -> Column:
    """A mean that does not depend on the order of summation."""
    return F.round(F.avg(x), 9)


def book_summary(rows: DataFrame, by: str = "book") -> DataFrame:
    c = F.col
    return rows.groupBy(by).agg(
        F.count("*").alias("n_chapters"),
        F.sum("wc").alias("total_wc"),
        *[rounded(mean9(x), 3).alias(f"avg_{x}") for x in ("pleasure_intensity", "hook_density", "conflict_density", "readability", "dialogue_ratio")],
        rounded(F.round(share(c("conflict")), 9), 3).alias("conflict_rate"),
        *[F.count_if(c("pleasure_type") == k).alias(f"n_{k}") for k in ("climax", "major", "minor")],
        F.count_if(c("pace") == "fast").alias("n_fast"),
        F.count_if(c("hook_type") == "none").alias("n_hookless"),
        F.count_if("slap_noise").alias("n_noise"),
    )


def distributions(rows: DataFrame, kinds: Sequence[str], by: str = "book") -> DataFrame:
    """(by, kind, label, n) of several class columns, from one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("label")) for k in kinds])
    return rows.select(by, F.explode(pairs).alias("p")).groupBy(by, "p.kind", "p.label").agg(F.count("*").alias("n"))


def label_map(rows: DataFrame, kind: str, by: str = "book") -> DataFrame:
    """(by, sub_dist): a map from label to count."""
    return rows.groupBy(by, kind).agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(kind, "n")))).alias("sub_dist"))


def rhythm_stats(rows: DataFrame, by: str = "book") -> DataFrame:
    """What gates read of a book: chapters, means of three digits, the longest run without hooks, the mean variability."""
    varied = variability(rows, by=by)
    streak = longest_run(rows, F.col("hook_density") == 0, by, name="zero_hook_streak")
    means = varied.groupBy(by).agg(F.count("*").alias("total_ch"), *[rounded(mean9(c), 3).alias(n) for c, n in (("hook_density", "avg_hook"), ("conflict_density", "avg_conflict"), ("pleasure_intensity", "avg_pleasure"))], rounded(mean9("ch_variability"), 1).alias("ch_variability_mean"))
    return means.join(streak, by)


# Dimensions of the benchmark with weight and direction (1: higher is better, 0: the middle is best).
DIMS = {"hook_density": (1.0, 1), "conflict_density": (1.0, 1), "pleasure_intensity": (1.0, 1), "dialogue_ratio": (0.5, 0), "readability": (0.5, 0), "avg_sentence_len": (0.5, 0)}


def book_dims(rows: DataFrame, dims: Sequence[str] = tuple(DIMS), least: int = 5, by: str = "book") -> DataFrame:
    """(by, dim, value): means of a book, one row a dimension, from one pass."""
    means = rows.groupBy(by).agg(F.count("*").alias("n"), *[mean9(d).alias(d) for d in dims]).where(F.col("n") >= least)
    return means.unpivot([by], list(dims), "dim", "value")


def benchmark(values: DataFrame, least: int = 3) -> DataFrame:
    """(dim, p10 .. p90, mean, std, n) over the books of a pool."""
    places = (10, 25, 50, 75, 90)
    stats = values.groupBy("dim").agg(*[F.percentile("value", q / 100).alias(f"p{q}") for q in places], F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n")).where(F.col("n") >= least)
    return stats.select("dim", *[rounded(F.round(c, 9), 4).alias(c) for c in (*[f"p{q}" for q in places], "mean", "std")], "n")


def dimension_score(value: Column, higher: Column) -> Column:
    """0 to 25 by the place of a value among p10 .. p90, columns of the same row."""
    p10, p25, p50, p75, p90 = (F.col(f"p{q}") for q in (10, 25, 50, 75, 90))
    between = lambda low, base, span, high: base + span * (value - low) / F.greatest(high - low, F.lit(0.001))
    rising = F.when(value <= p10, F.lit(0.0)).when(value <= p25, F.when(p25 > p10, between(p10, 0.0, 6.25, p25)).otherwise(F.lit(6.25))).when(value <= p50, between(p25, 6.25, 6.25, p50)).when(value <= p75, between(p50, 12.5, 6.25, p75)).when(value <= p90, between(p75, 18.75, 3.75, p90)).otherwise(F.lit(25.0))
    iqr = F.when(p75 > p25, p75 - p25).otherwise(F.abs(p75) * 0.2 + 0.1)
    distance = F.round(F.abs(value - p50) / F.greatest(iqr, F.lit(0.001)), 9)
    middle = F.when(distance <= 0.5, F.lit(25.0)).when(distance <= 1, F.lit(18.75)).when(distance <= 2, F.lit(12.5)).when(distance <= 3, F.lit(6.25)).otherwise(F.lit(0.0))
    return rounded(F.round(F.least(F.when(higher, rising).otherwise(middle), F.lit(25.0)), 9), 2)


def scored_dims(values: DataFrame, bench: DataFrame, dims: dict = DIMS, by: str = "book") -> DataFrame:
    """(by, dim, value, p25, gap, weight, score, rank) of each dimension against the benchmark, which has a row a dimension."""
    weights = F.create_map(*[F.lit(x) for d, (w, _) in dims.items() for x in (d, w)])
    higher = F.col("dim").isin([d for d, (_, way) in dims.items() if way])
    met = values.join(F.broadcast(bench), "dim")
    c, v = F.col, F.col("value")
    rank = ladder((v >= c("p90"), "P90+"), (v >= c("p75"), "P75-P90"), (v >= c("p50"), "P50-P75"), (v >= c("p25"), "P25-P50"), (v >= c("p10"), "P10-P25"), otherwise="<P10")
    return met.select(by, "dim", "value", "p25", rounded(F.round(v - c("p50"), 9), 4).alias("gap"), weights[c("dim")].alias("weight"), dimension_score(v, higher).alias("score"), F.when(higher, rank).alias("rank"), (higher & (v < c("p25"))).alias("weak"))


def signing_probability(scored: DataFrame, by: str = "book") -> DataFrame:
    """(by, probability, label, weak): the weighted mean score in per cent, and the three weakest dimensions by their gap."""
    weak = F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("weak"), F.struct((-F.round(F.col("p25") - F.col("value"), 4)).alias("g"), "dim")))), 1, 3), lambda x: x["dim"])
    p = rounded(F.round(F.sum(F.col("score") * F.col("weight")) / F.sum("weight") / 25 * 100, 9), 1)
    each = scored.groupBy(by).agg(p.alias("probability"), F.concat_ws(",", weak).alias("weak"))
    return each.select(by, "probability", ladder((F.col("probability") >= 75, "near"), (F.col("probability") >= 50, "fair"), (F.col("probability") >= 25, "partly"), otherwise="far").alias("label"), "weak")


def shrunk(rank: Column, n: Column) -> Column:
    """The percentile of the `rank`-th of n values, drawn towards 50 in pools under 30; 50 in pools under three."""
    raw = F.round((rank - 0.5) / n * 100)
    return F.when(n < 3, F.lit(50.0)).when(n < 30, F.round(F.round(50 + (raw - 50) * n / 30.0, 9))).otherwise(raw)


def percentile_score(books: DataFrame, value: str, pool: Sequence[str] = (), name: str = "score") -> DataFrame:
    """The books with the shrunken percentile of a value in their pool."""
    w = pool_of(pool)
    at_most = F.count("*").over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, 0))
    return books.withColumn(name, shrunk(at_most, F.count("*").over(w)))


def leave_one_out(books: DataFrame, value: str, pool: Sequence[str] = ()) -> DataFrame:
    """The books with the mean of all others of their pool: the pool's sum less their own value, no join."""
    w = pool_of(pool)
    others = (F.sum(value).over(w) - F.col(value)) / (F.count("*").over(w) - 1)
    return books.select("*", rounded(F.round(others, 9), 4).alias("others"), rounded(F.round(F.col(value) - others, 9), 4).alias("gap"))


def diversity(rows: DataFrame, kind: str = "dominant_sub", by: str = "book") -> DataFrame:
    """(by, unique_types, diversity): Shannon's measure as a part of its largest value."""
    counts = rows.where(F.col(kind) != "none").groupBy(by, kind).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(by))
    sums = counts.select(by, (-p * F.log(p)).alias("h")).groupBy(by).agg(F.count("*").alias("unique_types"), F.sum("h").alias("h"))
    return sums.select(by, "unique_types", F.when(F.col("unique_types") > 1, rounded(F.round(F.col("h") / F.log("unique_types"), 9), 3)).otherwise(F.lit(0.0)).alias("diversity"))


def opening_features(rows: DataFrame, least: int = 10, by: str = "book") -> DataFrame:
    """Features of a book's first three, first thirty and all chapters, for books of `least` chapters."""
    c, first = F.col, lambda n, x: F.when(F.col("ch_num") <= n, x)
    levels = pleasure_level(variability(rows, by=by), by)
    each = levels.groupBy(by).agg(
        F.count("*").alias("n"),
        *[mean9(first(3, c(x))).alias(n) for x, n in (("hook_density", "hook"), ("conflict_density", "conflict"), ("pleasure_intensity", "intensity"), ("pos_density", "pos"))],
        mean9("readability").alias("readability"),
        F.round(F.sum(first(30, c("slap_count"))) / F.least(F.count("*"), F.lit(30)), 9).alias("slap_rate"),
        *[F.round(share(c("hook_type") == k), 9).alias(f"{k}_rate") for k in ("reversal", "suspense")],
        F.round(share(c("pleasure_level") == "large"), 9).alias("large_rate"),
        mean9(first(30, c("dialogue_ratio"))).alias("dialogue"),
        mean9(first(30, c("avg_para_len"))).alias("para_len"),
        mean9(F.when(c("vocab_diversity") > 0, c("vocab_diversity"))).alias("vocab"),
        F.round(share(c("hook_density") > 0) * 100, 9).alias("hook_coverage"),
        mean9(F.when(c("ch_variability") > 0, c("ch_variability"))).alias("varied"),
    )
    return each.where(c("n") >= least).join(diversity(rows, by=by), by)


def graded(overall: Column) -> Column:
    return ladder((overall >= 80, "S+"), (overall >= 70, "A"), (overall >= 60, "B"), (overall >= 50, "C"), otherwise="D")


def decided(overall: Column) -> Column:
    return ladder((overall >= 75, "hit"), (overall >= 60, "invest"), (overall >= 40, "observe"), otherwise="drop")


def top_share(rows: DataFrame, kind: str = "dominant_sub", k: int = 2, by: str = "book") -> DataFrame:
    """(by, top_share): the share of the k most frequent classes."""
    counts = rows.groupBy(by, kind).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), kind)))
    return ranked.groupBy(by).agg((F.sum(F.when(F.col("r") <= k, F.col("n"))) / F.sum("n")).alias("top_share"))


def commercial_score(rows: DataFrame, labels: DataFrame | None = None, pool: Sequence[str] = (), by: str = "book") -> DataFrame:
    """Signing and retention from shrunken percentiles, overall with penalties for template-like books, grade, decision and the spread over weights.

    labels: (by, ch_num, retention, pace, hook, intensity) as a reader or model gave them, on scales of ten; where a book has
    none, retention is estimated from its opening and pace from its paragraphs. Defects of the original are mended: the
    pool is that of the book, and its retention percentiles come from the books' own estimates.
    """
    c = F.col
    books = opening_features(rows, by=by).join(top_share(rows, by=by), by)
    if labels is None:
        labels = rows.select(by, "ch_num", *[F.lit(None).cast("double").alias(x) for x in ("retention", "intensity")]).limit(0)
    given = labels.where(c("ch_num") <= 30).groupBy(by).agg(mean9("retention").alias("llm_retention"), mean9("intensity").alias("llm_intensity"))
    books = books.join(given, by, "left")
    estimate = clamp(rounded(F.round((c("hook") * 3 + c("conflict") * 3 + c("pos") * 2) / 8 * 10, 9), 1), 1, 10)
    books = books.select("*", F.coalesce("llm_retention", estimate).alias("retention"), F.coalesce("llm_intensity", "intensity").alias("avg_intensity"))
    for value, name in (("avg_intensity", "p_intensity"), ("hook", "p_hook"), ("retention", "p_retention"), ("conflict", "p_conflict"), ("diversity", "p_diversity"), ("hook_coverage", "p_coverage")):
        books = percentile_score(books, value, pool, name)
    signing = F.round(F.round(c("p_intensity") * 0.35 + c("p_hook") * 0.3 + c("p_retention") * 0.1 + c("p_conflict") * 0.25, 6))
    retention = F.round(F.round(c("p_retention") * 0.4 + c("p_intensity") * 0.25 + 50 * 0.2 + c("p_coverage") * 0.15, 6))
    slow = (c("dialogue") > 0.4) & (c("hook") < 1.5) & (F.coalesce("vocab", F.lit(0.2)) > 0.2)
    books = books.select("*", signing.alias("signing"), retention.alias("keeping"), slow.alias("slow_burn"))
    overall = F.round(F.round(F.when(c("slow_burn"), c("signing") * 0.4 + c("keeping") * 0.6).otherwise(c("signing") * 0.5 + c("keeping") * 0.5), 6))
    books = books.withColumn("raw", overall)
    penalty = 1.0 - 0.05 * (
        ((F.coalesce("vocab", F.lit(0.2)) < 0.18) & (c("raw") < 85)).cast("int") + ((c("top_share") > 0.55) & (c("hook") < 1.5) & ~c("slow_burn")).cast("int") + ((F.coalesce("varied", F.lit(0.0)) < 0.1) & (c("n") > 50)).cast("int")
    )
    books = books.withColumn("overall", F.round(F.round(c("raw") * F.greatest(penalty, F.lit(0.7)), 6)))
    grid = F.array(*[F.round(F.round(c("signing") * a + c("keeping") * (1 - a), 6)) for a in (0.4, 0.45, 0.5, 0.55, 0.6) for b in (0.2, 0.25, 0.3, 0.35, 0.4) if 0.05 - 1e-9 <= 1 - a - b <= 0.35 + 1e-9])
    return books.select(by, "signing", c("keeping").alias("retention"), "slow_burn", "overall", graded(c("overall")).alias("grade"), decided(c("overall")).alias("decision"), F.array_min(grid).alias("low"), F.array_max(grid).alias("high"), "p_hook", "p_conflict", "p_intensity", "p_retention", "p_diversity")


def sub_genre(rows: DataFrame, by: str = "book") -> DataFrame:
    """The kind of a book by the ratios of its classes."""
    c, n = F.col, lambda k: F.count_if(F.col("dominant_sub") == k)
    sums = rows.groupBy(by).agg(F.count_if(c("dominant_sub") != "none").alias("n"), F.sum("bond_count").alias("bond"), F.sum("cognitive_count").alias("cognitive"), F.sum("sacrifice_count").alias("sacrifice"), n("slap").alias("slap"), n("comeback").alias("comeback"), (n("slap") + n("level") + n("crush") + n("comeback") + n("hidden")).alias("explicit"))
    implicit = c("bond") + c("cognitive") + c("sacrifice")
    ratio = implicit / F.greatest(c("explicit") + implicit, F.lit(1))
    return sums.select(by, ladder((c("n") == 0, "general"), ((ratio > 0.3) & (c("sacrifice") > 0.5 * c("bond")), "bond"), ((c("cognitive") > c("slap")) & (c("comeback") > c("slap")), "wits"), (c("slap") / F.greatest(c("n"), F.lit(1)) > 0.5, "slap"), otherwise="general").alias("sub_genre"))


def simple_sub_genre(rows: DataFrame, by: str = "book") -> DataFrame:
    c = F.col
    m = rows.groupBy(by).agg(mean9("hook_density").alias("hook"), mean9("conflict_density").alias("conflict"), F.round(F.avg("dialogue_ratio") * 100, 9).alias("dialogue"))
    return m.select(by, ladder((c("dialogue") > 35, "daily"), ((c("conflict") < 0.8) & (c("hook") > 1.8), "pleasure"), ((c("hook") < 1.2) & (c("conflict") > 1), "slow wits"), ((c("hook") >= 1.2) & (c("hook") <= 2.5) & (c("conflict") > 0.8), "bond"), otherwise="standard").alias("sub_genre"))


def zone_weighted(rows: DataFrame, value: str = "pleasure_intensity", front: int = 50, tail: float = 0.85, weights: tuple[float, float, float] = (2.0, 1.0, 1.5), by: str = "book") -> DataFrame:
    n = F.max("ch_num").over(Window.partitionBy(by))
    w = F.when(F.col("ch_num") <= front, F.lit(weights[0])).when(F.col("ch_num") >= n * tail, F.lit(weights[2])).otherwise(F.lit(weights[1]))
    return rows.select(by, value, w.alias("w")).groupBy(by).agg(rounded(F.round(F.sum(F.col("w") * F.col(value)) / F.greatest(F.sum("w"), F.lit(0.001)), 9), 4).alias("weighted"))


def gate(stats: DataFrame, scores: DataFrame, known: Sequence[str] = (), protected: Sequence[str] = (), least: int = 10, streak: int = 5, score: int = 30, by: str = "book") -> DataFrame:
    """(by, verdict, reason, score, source): protected books pass; too few chapters fail; long runs without hooks and low scores are quarantined. scores: (by, score), replaced by a proxy from the stats where a book has none."""
    c = F.col
    part = lambda x, low, span: F.least(F.lit(100.0), F.greatest(F.lit(0.0), (x - low) / span * 100))
    proxy = F.when(c("total_ch") >= 10, F.floor(F.round((part(c("avg_hook"), 0.5, 4.0) + part(c("avg_pleasure"), 0.0, 3.0) + part(c("avg_conflict"), 0.2, 0.8)) / 3, 6)))
    rows = stats.join(scores.select(by, c("score").alias("given")), by, "left").select("*", F.coalesce(c("given").cast("long"), proxy).alias("score"), F.when(c("given").isNotNull(), "scores").when(proxy.isNotNull(), "proxy").alias("source"))
    named = lambda names: c(by).rlike("|".join(names)) if names else F.lit(False)
    longest = F.greatest(F.lit(streak), F.least(F.floor(c("total_ch") * 0.03), F.lit(15)))
    reason = ladder((named(protected), "protected"), (c("total_ch") < least, "few_chapters"), (c("zero_hook_streak") > longest, "zero_hooks"), (c("score") < score, "low_score"), otherwise="ok")
    verdict = F.when(reason.isin("protected", "ok"), "PASS").when((reason == "few_chapters") & ~named(known), "FAIL").otherwise("QUARANTINE")
    return rows.select(by, verdict.alias("verdict"), reason.alias("reason"), "score", "source")


# Instructions as (rule, severity, place, predicate over a chapter's metrics).
INSTRUCTIONS = (
    ("weak_hook", "HIGH", "end", "hook_density < 0.5 AND wc > 500"),
    ("flat_conflict", "HIGH", "all", "conflict_density < 0.3 AND wc > 500"),
    ("low_pleasure", "MED", "all", "pleasure_intensity <= 1 AND wc > 300"),
    ("no_hook", "CRITICAL", "end", "hook_type = 'none' AND wc > 300"),
    ("little_dialogue", "LOW", "all", "dialogue_ratio < 0.15 AND wc > 300"),
    ("much_dialogue", "LOW", "all", "dialogue_ratio > 0.55 AND wc > 300"),
    ("hard_to_read", "LOW", "all", "readability < 0.4 AND wc > 200"),
)
HOOK_WORDS = ("suspense", "reversal", "emotion", "info", "hint")


def fired(rows: DataFrame, rules: Sequence[tuple[str, str, str, str]], keep: Sequence[str]) -> DataFrame:
    """A row for each rule that fires, from one pass: (keep, rule, severity, place). Predicates are SQL expressions over the columns of `rows`, a user's own included."""
    findings = F.array(*[F.when(F.expr(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(w).alias("place"))) for r, s, w, p in rules])
    return rows.select(*keep, F.explode(F.array_compact(findings)).alias("f")).select(*keep, "f.*")


def writing_instructions(rows: DataFrame, rules: Sequence[tuple[str, str, str, str]] = INSTRUCTIONS, by: str = "book") -> DataFrame:
    found = fired(rows, rules, [by, "ch_num", "hook_density", "wc"])
    word = F.element_at(F.array(*[F.lit(x) for x in HOOK_WORDS]), (F.col("ch_num") % len(HOOK_WORDS) + 1).cast("int"))
    return found.select(by, "ch_num", "rule", "severity", "place", F.when(F.col("rule") == "weak_hook", word).alias("hook_word"))


def book_tags(rows: DataFrame, by: str = "book") -> DataFrame:
    c = F.col
    m = rows.groupBy(by).agg(mean9("readability").alias("r"), *[F.round(share(c(k) == v), 9).alias(n) for k, v, n in (("dominant_sub", "slap", "slap"), ("dominant_sub", "crush", "crush"), ("pace", "fast", "fast"), ("pace", "slow", "slow"), ("hook_type", "reversal", "reversal"), ("hook_type", "suspense", "suspense"))])
    tags = F.array(
        F.when(c("r") > 0.1, "literary").when(c("r") < -0.15, "colloquial"), F.when(c("slap") > 0.6, "slap"), F.when(c("crush") > 0.2, "crush"), F.when(c("fast") > 0.5, "fast").when(c("slow") > 0.5, "slow"), F.when(c("reversal") > 0.1, "reversal"), F.when(c("suspense") > 0.08, "suspense")
    )
    return m.select(by, F.concat_ws(",", F.array_compact(tags)).alias("tags"))


def attribution(values: DataFrame, bench: DataFrame, most: int = 3, by: str = "book") -> DataFrame:
    """(by, dim, loss, gain, place, hints): the dimensions in which a book loses most against its pool, and what several losses together point to."""
    c = F.col
    loss = F.round(F.greatest(F.lit(0.0), (c("p50") - c("value")) / F.greatest(c("p75") - c("p25"), F.lit(0.01))), 6)
    each = values.join(F.broadcast(bench), "dim").select(by, "dim", loss.alias("loss"))
    of = lambda d: F.max(F.when(c("dim") == d, c("loss"))).over(Window.partitionBy(by))
    hook, conflict, dialogue, pleasure = (F.coalesce(of(d), F.lit(0.0)) for d in ("hook_density", "conflict_density", "dialogue_ratio", "pleasure_intensity"))
    hints = F.concat_ws(",", F.array_compact(F.array(F.when((hook > 0.3) & (conflict > 0.3), "no_confrontation"), F.when((dialogue > 0.3) & (pleasure > 0.3), "no_talk"), F.when((hook > 0.5) & (pleasure > 0.5), "collapse"))))
    ranked = each.select("*", hints.alias("hints"), F.row_number().over(Window.partitionBy(by).orderBy(F.desc("loss"), "dim")).cast("long").alias("place"))
    return ranked.where((c("place") <= most) & (c("loss") > 0)).select(by, "dim", "loss", F.least(F.floor(F.round(8 * c("loss"), 6)), F.lit(15)).alias("gain"), "place", "hints")


def rhythm_audit(rows: DataFrame, by: str = "book") -> DataFrame:
    """(by, fails, status): six checks of a book's means against fixed bounds and three deviations of all chapters."""
    dims = ("hook_density", "conflict_density", "pleasure_intensity", "readability")
    c = F.col
    genre = rows.agg(*[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("mu", F.avg), ("sd", F.stddev_samp))])
    m = rows.groupBy(by).agg(F.count("*").alias("n"), *[mean9(d).alias(d) for d in dims], mean9("wc").alias("wc"), F.round(share(c("hook_type") == "none"), 9).alias("none"), F.round(share(c("pleasure_type") != "none"), 9).alias("pleased"))
    far = F.lit(False)
    for d in dims:
        far = far | ((c(f"sd_{d}") > 0) & (F.abs(c(d) - c(f"mu_{d}")) > 3 * c(f"sd_{d}")))
    checks = [(c("hook_density") < 0.01) | (c("conflict_density") < 0.01), far, c("none") > 0.95, c("pleased") < 0.05, (c("wc") < 500) | (c("wc") > 10000), (c("readability") < -1) | (c("readability") > 2)]
    fails = total([x.cast("long") for x in checks])
    return m.join(F.broadcast(genre)).select(by, fails.alias("fails"), F.when(c("n") < 5, "FAIL").otherwise(ladder((fails >= 3, "FAIL"), (fails >= 1, "WARN"), otherwise="PASS")).alias("status"))


def column_audit(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, nulls, zeros, low, high, mean, median, std): one row a numeric column, from one pass."""
    stacked = rows.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).cast("double").alias("v")) for x in columns])).alias("p")).select("p.*")
    return stacked.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.col("v") == 0).alias("zeros"), F.min("v").alias("low"), F.max("v").alias("high"), rounded(F.round(F.avg("v"), 9), 4).alias("mean"), F.percentile("v", 0.5).alias("median"), rounded(F.round(F.stddev_samp("v"), 9), 4).alias("std"))


def score_audit(books: DataFrame, score: str = "overall", other: str = "signing", by: str = "book") -> DataFrame:
    """One row: share of elite books, coefficient of variation, ties, the rank correlation of two scores, books whose ranks differ by more than a third."""
    n = F.count("*").over(Window.partitionBy())
    rank = lambda x: F.rank().over(Window.orderBy(F.desc(x))) + (F.count("*").over(Window.partitionBy(x)) - 1) / 2.0
    r = books.select(by, score, rank(score).alias("ra"), rank(other).alias("rb"), n.alias("n"))
    c = F.col
    s = r.agg(F.count("*").alias("n"), F.round(share(c(score) >= 70), 4).alias("elite"), (F.count("*") - F.count_distinct(score)).alias("ties"), F.stddev_samp(score).alias("sd"), F.avg(score).alias("mean"), F.sum((c("ra") - c("rb")) * (c("ra") - c("rb"))).alias("d2"), F.count_if(F.abs(c("ra") - c("rb")) > c("n") / 3).alias("outliers"))
    return s.select("n", "elite", "ties", rounded(F.round(c("sd") / c("mean") * 100, 9), 1).alias("cv"), rounded(F.round(1 - 6 * c("d2") / (c("n") * (c("n") * c("n") - 1)), 9), 3).alias("rho"), "outliers")


def segments(rows: DataFrame, by: str = "book") -> DataFrame:
    """The rows with their segment of five, cut at fifths as 1, 2, 1, 1 and the rest."""
    q = F.floor(F.count("*").over(Window.partitionBy(by)) / 5)
    return rows.withColumn("segment", ladder((F.col("ch_num") <= q, "opening"), (F.col("ch_num") <= 3 * q, "rise"), (F.col("ch_num") <= 4 * q, "middle"), (F.col("ch_num") <= 5 * q, "late"), otherwise="ending"))


def synthesis(rows: DataFrame, by: str = "book") -> DataFrame:
    """(segment, n_books, ranges and pooled means over books, the pace that leads in most of them)."""
    seg = segments(rows, by)
    means = seg.groupBy(by, "segment").agg(*[rounded(mean9(c), 3).alias(n) for c, n in (("hook_density", "hook"), ("conflict_density", "conflict"), ("pleasure_intensity", "pleasure"), ("slap_count", "slap"))])
    paces = seg.groupBy(by, "segment", "pace").agg(F.count("*").alias("n")).groupBy(by, "segment").agg(F.min_by("pace", F.struct((-F.col("n")).alias("n"), "pace")).alias("pace"))
    lead = paces.groupBy("segment", "pace").agg(F.count("*").alias("n")).groupBy("segment").agg(F.min_by("pace", F.struct((-F.col("n")).alias("n"), "pace")).alias("lead_pace"))
    pooled = means.groupBy("segment").agg(F.count("*").alias("n_books"), *[f(c).alias(f"{c}_{n}") for c in ("hook", "conflict") for n, f in (("low", F.min), ("high", F.max))], *[rounded(F.round(F.avg(c), 9), 3).alias(f"{c}_pooled") for c in ("hook", "conflict", "pleasure", "slap")])
    return pooled.join(F.broadcast(lead), "segment")


def retention_risk(rows: DataFrame, by: str = "book") -> DataFrame:
    """(by, fifth, zero_hook_chs, zero_hook_ratio, risk) for books of ten chapters and more."""
    n = F.count("*").over(Window.partitionBy(by))
    fifth = F.least(F.floor((F.col("ch_num") - 1) / F.greatest(F.lit(1), F.floor(n / 5))), F.lit(4))
    each = rows.select(by, "hook_density", n.alias("n"), fifth.alias("fifth")).where("n >= 10").groupBy(by, "fifth").agg(F.count_if(F.col("hook_density") == 0).alias("zero_hook_chs"), F.count("*").alias("m"))
    ratio = F.col("zero_hook_chs") / F.col("m")
    return each.select(by, "fifth", "zero_hook_chs", rounded(ratio, 2).alias("zero_hook_ratio"), ladder((ratio > 0.3, "HIGH"), (ratio > 0.15, "MEDIUM"), otherwise="LOW").alias("risk"))


#: Numbers of chapters that are summed up together, to find the place of the first of them.
BLOCK = 4096


def chunks(rows: DataFrame, n: int, keep: Sequence[str] = ("conflict_density", "pleasure_intensity", "hook_density"), order: Sequence[str] = ("ch_num", "book")) -> DataFrame:
    """Pooled rows in order of chapters, cut into n chunks of equal size: (chunk, from_ch, means). The place of a row is its block's first place plus its chapter's within the block plus its own within the chapter, so no task orders all rows or all numbers of chapters."""
    first, *rest = order
    sizes = rows.groupBy(first).agg(F.count("*").alias("m")).withColumn("block", F.floor(F.col(first) / BLOCK))
    blocks = sizes.groupBy("block").agg(F.sum("m").alias("size"))  # a row in BLOCK numbers of chapters
    starts = blocks.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("start"), F.sum("size").over(Window.partitionBy()).alias("all"))
    within = F.sum("m").over(Window.partitionBy("block").orderBy(first)) - F.col("m")
    before = sizes.withColumn("within", within).join(F.broadcast(starts), "block").select(first, (F.col("start") + F.col("within")).alias("before"), "all")
    placed = rows.join(before, first).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy(first).orderBy(*rest)) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("all") / n))
    each = placed.withColumn("chunk", F.floor(F.col("place") / step)).where(F.col("chunk") < n)
    return each.groupBy("chunk").agg(F.min_by(first, "place").alias("from_ch"), *[rounded(F.round(F.avg(x), 9), 2).alias(x) for x in keep])


def buckets(rows: DataFrame, n: int = 10, keep: Sequence[str] = ("hook_density", "conflict_density", "pleasure_intensity", "dialogue_ratio"), by: str = "book") -> DataFrame:
    """(bucket, n_books, means over books of their means): n equal parts of each book's progress; rows beyond them are left out, as are books of fewer rows."""
    size = F.count("*").over(Window.partitionBy(by))
    part = rows.select(by, *keep, size.alias("size"), F.floor((F.col("ch_num") - 1) / F.floor(size / n)).alias("bucket")).where((F.col("size") >= n) & (F.col("bucket") < n))
    means = part.groupBy(by, "bucket").agg(*[mean9(x).alias(x) for x in keep])
    return means.groupBy("bucket").agg(F.count("*").alias("n_books"), *[rounded(F.round(F.avg(x), 9), 4).alias(x) for x in keep])


def concentration(rows: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(kind, kl, low_frequency): divergence of a class distribution from equal shares, with the three rarest classes under 5 %."""
    counts = distributions(rows.withColumn("_", F.lit(0)), kinds, "_").groupBy("kind", "label").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("kind")
    p = F.col("n") / F.sum("n").over(w)
    shares = counts.select("kind", "label", "n", p.alias("p"), F.count("*").over(w).alias("k"))
    rare = F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("p") < 0.05, F.struct((-F.col("n")).alias("m"), "label")))), 1, 3), lambda x: x["label"])
    return shares.groupBy("kind").agg(rounded(F.round(F.sum(F.col("p") * F.log(F.col("p") * F.col("k"))), 9), 4).alias("kl"), F.concat_ws(",", rare).alias("low_frequency"))


def pearson(rows: DataFrame, features: Sequence[str], targets: Sequence[str], least: float = 0.0) -> DataFrame:
    """(feature, target, r, n): correlations of every feature with every target in one pass; 0 under three rows or without spread."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y")) for f in features for t in targets])
    each = rows.select(F.explode(pairs).alias("p")).select("p.*").groupBy("feature", "target").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"), F.count("*").alias("n"))
    r = F.when((F.col("n") < 3) | F.col("r").isNull() | F.isnan("r"), F.lit(0.0)).otherwise(rounded(F.round("r", 9), 3))
    return each.select("feature", "target", r.alias("r"), "n").where(F.abs("r") > least) if least else each.select("feature", "target", r.alias("r"), "n")


def blend_weight(r: Column) -> tuple[Column, Column]:
    """The weights of rule and label for a correlation r: r**2 / (1 + r**2), 0.05 at least."""
    r2 = F.pow(F.greatest(r, F.lit(0.01)), F.lit(2))
    w = rounded(F.round(F.greatest(F.lit(0.05), r2 / (1 + r2)), 9), 3)
    return w, rounded(F.round(1 - w, 9), 3)


def bootstrap(books: DataFrame, scores: Sequence[str], by: str = "book", times: int = 1000) -> DataFrame:
    """(by, low, high): bounds of the mean of a book's scores over `times` resamples, drawn by a hash so that runs agree."""
    array, k = F.array(*[F.col(x).cast("double") for x in scores]), len(scores)
    draw = lambda i, j: F.element_at(F.col("s"), (F.pmod(F.hash(by, i, j), F.lit(k)) + 1).cast("int"))
    means = F.transform(F.sequence(F.lit(1), F.lit(times)), lambda i: F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda a, j: a + draw(i, j)) / k)
    each = books.select(by, array.alias("s")).select(by, F.array_sort(means).alias("m"))
    return each.select(by, F.element_at("m", max(1, times * 26 // 1000)).alias("low"), F.element_at("m", times * 975 // 1000).alias("high"))


def loocv_mae(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (slope, intercept, mae, n): least squares, and its mean absolute error at points left out, by the closed form residual / (1 - leverage)."""
    c = F.col
    fit = rows.select(c(x).cast("double").alias("x"), c(y).cast("double").alias("y")).where("x is not null and y is not null")
    s = fit.agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("x").alias("mx"), F.regr_sxx("y", "x").alias("sxx"), F.count("*").alias("n"))
    left = F.abs((c("y") - c("a") - c("b") * c("x")) / (1 - 1 / c("n") - (c("x") - c("mx")) * (c("x") - c("mx")) / c("sxx")))
    return fit.join(F.broadcast(s)).groupBy("a", "b", "n").agg(F.avg(left).alias("mae")).select(rounded(F.round("b", 9), 4).alias("slope"), rounded(F.round("a", 9), 1).alias("intercept"), rounded(F.round("mae", 9), 4).alias("mae"), "n")


def borda(books: DataFrame, dims: dict[str, bool], by: str = "book", pool: Sequence[str] = ()) -> DataFrame:
    """(by, rank_<dim>.., total_borda, consensus_rank): ranks in each dimension (True: high is good) and their sum; ties go by name."""
    w = pool_of(pool)
    ranks = {d: F.row_number().over(w.orderBy(F.desc(d) if high else F.asc(d), by)).cast("long") for d, high in dims.items()}
    summed = books.select(by, *pool, *[r.alias(f"rank_{d}") for d, r in ranks.items()]).withColumn("total_borda", total([F.col(f"rank_{d}") for d in dims]))
    return summed.withColumn("consensus_rank", F.row_number().over(w.orderBy("total_borda", by)).cast("long"))


def length_correction(books: DataFrame, n: str = "n", by: str = "book") -> DataFrame:
    """(by, n, factor): books of more than 1.5 times the upper median of lengths gain by the logarithm of their length."""
    per = books.groupBy(F.col(n).alias("v")).agg(F.count("*").alias("k"))  # a row for each length, not for each book
    # the upper median is the smallest length that more than half of the books do not exceed
    line = per.withColumn("upto", F.sum("k").over(Window.orderBy("v"))).withColumn("all", F.sum("k").over(Window.partitionBy()))
    lengths = line.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("v").alias("med"))
    factor = F.when(F.col(n) > 1.5 * F.col("med"), rounded(F.round(F.least(F.lit(1.8), 1 + 0.2 * F.log2(F.col(n) / F.col("med"))), 9), 4)).otherwise(F.lit(1.0))
    return books.join(F.broadcast(lengths)).select(by, n, factor.alias("factor"))


def percent_ranks(books: DataFrame, metrics: Sequence[str], by: str = "book", pool: Sequence[str] = ()) -> DataFrame:
    """(by, pct_<metric>.., composite, place): the share of books at most as high, 50 where all are equal, and the order of the means."""
    w = pool_of(pool)
    pct = lambda m: F.when(F.min(m).over(w) == F.max(m).over(w), F.lit(50.0)).otherwise(rounded(F.round(F.cume_dist().over(w.orderBy(m)) * 100, 9), 1))
    ranked = books.select(by, *pool, *[pct(m).alias(f"pct_{m}") for m in metrics])
    ranked = ranked.withColumn("composite", rounded(F.round(total([F.col(f"pct_{m}") for m in metrics]) / len(metrics), 9), 1))
    return ranked.withColumn("place", F.row_number().over(w.orderBy(F.desc("composite"), by)).cast("long"))


def gaps(books: DataFrame, value: str, by: str = "book", pool: Sequence[str] = ()) -> DataFrame:
    return books.select(by, value, rounded(F.round(F.col(value) - F.lead(value).over(pool_of(pool).orderBy(F.desc(value), by)), 9), 4).alias("gap"))


def interpolated(rows: DataFrame, nodes: Sequence[tuple[float, float]], by: str = "book") -> DataFrame:
    """(by, ch_num, target): the value between the two nodes (place, value) around a chapter's place in its book. The plan is an expression, not a join."""
    place = F.col("ch_num") / F.count("*").over(Window.partitionBy(by))
    target = F.lit(float(nodes[-1][1]))
    for (p0, v0), (p1, v1) in reversed(list(zip(nodes, nodes[1:], strict=False))):
        target = F.when(place < p1, v0 + (v1 - v0) * (place - p0) / (p1 - p0)).otherwise(target)
    return rows.select(by, "ch_num", rounded(F.round(target, 9), 4).alias("target"))


def versions(base: DataFrame, other: DataFrame, metrics: Sequence[str], by: str) -> DataFrame:
    """(by, metric, base, other, delta, highlight) of two versions' rows; a change of 10 % is a highlight."""
    long = lambda d, n: d.select(by, *metrics).unpivot([by], list(metrics), "metric", n)
    met = long(base, "base").join(long(other, "other"), [by, "metric"])
    delta = F.round(F.col("other") - F.col("base"), 9)
    return met.select(by, "metric", "base", "other", rounded(delta, 4).alias("delta"), (F.abs(delta) >= F.round(0.1 * F.abs(F.col("base")), 9)).alias("highlight"))


def competitiveness(rows: DataFrame, pools: DataFrame, own: str, by: str = "book", pool: str = "genre") -> DataFrame:
    """(by, pool, hook_vs, conflict_vs, appeal): a book's opening in per cent of each pool's, its own left out. pools: one row a pool."""
    c = F.col
    mine = rows.where(c("ch_num") <= 3).groupBy(by).agg(mean9("hook_density").alias("hook"), mean9("conflict_density").alias("conflict"))
    h, k = c("hook") / F.greatest(c("pool_hook"), F.lit(0.01)), c("conflict") / F.greatest(c("pool_conflict"), F.lit(0.01))
    met = mine.join(F.broadcast(pools.where(c(pool) != own)))
    return met.select(by, pool, F.round(F.round(h * 100, 6)).alias("hook_vs"), F.round(F.round(k * 100, 6)).alias("conflict_vs"), F.round(F.round(F.least(F.lit(100.0), (h + k) / 2 * 100), 6)).alias("appeal"))
