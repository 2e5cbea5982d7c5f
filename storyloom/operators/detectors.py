"""Detectors: tables of marks that turn texts into findings and scores. A table is data; one narrow pass of built-in functions applies it."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.columns import clamp, count, ladder, paragraphs, parts, rounded, total
from storyloom.operators.hooks import Checks
from storyloom.operators.style import array_mean


class Line(NamedTuple):
    """A red line: words and patterns that a text must not have."""

    name: str
    category: str
    severity: str
    words: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


SEVERITIES = ("critical", "serious", "warning", "info")


def red_lines(docs: DataFrame, lines: Sequence[Line], key: str = "doc_id", text: str = "text", categories: Sequence[str] | None = None, allowed: DataFrame | None = None, around: int = 30) -> DataFrame:
    """(key, rule, severity, matched, position, context): every hit with its place and what stands around it. allowed: (key, rule) overrides, which take hits away."""
    used = [x for x in lines if categories is None or x.category in categories]
    hits = []
    for x in used:
        for pattern in [*map(re.escape, x.words), *x.patterns]:
            whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
            before = F.split(F.col(text), pattern, -1)
            # the place of the k-th hit: the lengths of what stands before it, hits included
            place = F.transform(whole, lambda m, k: F.aggregate(F.slice(before, F.lit(1), k + 1), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(whole, F.lit(1), k), F.lit(0), lambda a, p: a + F.length(p)))  # noqa: B023
            hits.append(F.transform(F.arrays_zip(whole.alias("m"), place.alias("p")), _hit(x)))
    found = docs.where(F.col(text).isNotNull()).select(key, text, F.explode(F.concat(*hits)).alias("h")).select(key, "h.*", F.col(text).substr(F.greatest(F.col("h.position") - around, F.lit(0)).cast("int") + 1, (F.length("h.matched") + around + F.least(F.col("h.position"), F.lit(around))).cast("int")).alias("context"))
    return found if allowed is None else found.join(allowed.select(key, "rule").distinct(), [key, "rule"], "left_anti")


def _hit(line: Line):
    return lambda h: F.struct(F.lit(line.name).alias("rule"), F.lit(line.severity).alias("severity"), h["m"].alias("matched"), h["p"].cast("long").alias("position"))


class Mark(NamedTuple):
    """Points for a pattern in a part of a text: the first or last `chars` characters, or the whole for 0."""

    name: str
    part: str  # head, tail or all
    chars: int
    pattern: str
    points: float


def part_of(text: Column, part: str, chars: int) -> Column:
    return text if part == "all" else F.left(text, F.lit(chars)) if part == "head" else F.right(text, F.lit(chars))


def mark_score(text: Column, marks: Sequence[Mark], base: float = 0.0) -> Column:
    """The sum of points of the marks that a text has, 0 to 10."""
    points = total([F.lit(base), *[F.when(part_of(text, m.part, m.chars).rlike(m.pattern), F.lit(float(m.points))).otherwise(F.lit(0.0)) for m in marks]])
    return clamp(points, 0, 10)


def mark_names(text: Column, marks: Sequence[Mark]) -> Column:
    return F.concat_ws(",", F.array_compact(F.array(*[F.when(part_of(text, m.part, m.chars).rlike(m.pattern), F.lit(m.name)) for m in marks])))


def reader_lens(docs: DataFrame, opening: Sequence[Mark], ending: Sequence[Mark], line: str, particles: str, stiff: str, news: str, letters: str, ends: str = "\\n", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hook, dialogue, density, ending, retention): how a reader's eye goes over a chapter; retention weighs them 3, 2, 2, 3."""
    c = F.col
    base = docs.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    spoken = F.transform(F.regexp_extract_all("t", F.lit(line), 1), lambda x: clamp(5.0 + F.when(F.length(x) <= 15, 2.0).when(F.length(x) <= 25, 1.0).when(F.length(x) > 50, -1.0).otherwise(0.0) + F.when(x.rlike(particles), 1.5).otherwise(0.0) - F.when(x.rlike(stiff), 1.5).otherwise(0.0), 0, 10))
    long_paras = F.filter(parts(c("t"), ends), lambda p: F.length(p) > 30)
    base = base.select(key, "t", count(c("t"), letters).alias("chars"), count(F.left("t", F.lit(300)), letters).alias("head_chars"), spoken.alias("spoken"), count(c("t"), news).alias("news"), F.size(long_paras).alias("paras"), F.size(F.filter(long_paras, lambda p: ~p.rlike(news))).alias("water"))
    rate = c("news") / F.greatest(c("chars") / 1000.0, F.lit(1.0))
    dense = 5.0 + F.when(rate >= 3, 3.0).when(rate >= 1.5, 1.5).when(rate < 0.5, -2.0).otherwise(0.0) - F.when(c("water") > 0.4 * c("paras"), 2.0).otherwise(0.0)
    scored = base.select(
        key,
        F.when(c("head_chars") < 50, F.lit(2.0)).otherwise(mark_score(c("t"), opening)).alias("hook"),
        rounded(F.round(F.coalesce(array_mean(c("spoken")), F.lit(5.0)), 9), 3).alias("dialogue"),
        F.when(c("chars") < 500, F.lit(5.0)).otherwise(clamp(dense, 0, 10)).alias("density"),
        mark_score(c("t"), ending).alias("ending"),
    )
    return scored.select("*", F.round(F.round(c("hook") * 3 + c("dialogue") * 2 + c("density") * 2 + c("ending") * 3, 6)).alias("retention"))


def craft_lens(docs: DataFrame, endings: Sequence[Mark], opening: Sequence[Mark], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, opening, ending, hooks): points of the opening, and the kinds of hooks in the tail with their weights."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(key, mark_score(t, opening, 5.0).alias("opening"), mark_score(t, endings).alias("ending"), mark_names(t, endings).alias("hooks"))


def paragraph_scan(docs: DataFrame, classes: dict[str, str], key: str = "doc_id", text: str = "text", pattern: str = "\n") -> DataFrame:
    """(key, place, label): each paragraph with the first class of which it has a word; the timeline of a text."""
    each = docs.select(key, F.posexplode(parts(F.lower(F.coalesce(F.col(text), F.lit(""))), pattern)).alias("i", "p"))
    return each.select(key, (F.col("i") + 1).cast("long").alias("place"), ladder(*[(F.col("p").rlike(x), n) for n, x in classes.items()], otherwise="none").alias("label"))


def flat_streaks(timeline: DataFrame, flat: Sequence[str], least: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, streaks, longest): runs of `least` flat paragraphs and more."""
    w = Window.partitionBy(key).orderBy("place")
    island = F.sum(F.when(F.col("label").isin(list(flat)), 0).otherwise(1)).over(w)
    lengths = timeline.select(key, island.alias("i"), F.when(F.col("label").isin(list(flat)), 1).otherwise(0).alias("one")).groupBy(key, "i").agg(F.sum("one").alias("run"))
    return lengths.groupBy(key).agg(F.count_if(F.col("run") >= least).alias("streaks"), F.max("run").alias("longest"))


def part_intensity(docs: DataFrame, marks: str, n: int, letters: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, points, shape): marks by 500 letters, at most 1, in n parts of the paragraphs, and the shape of the curve: rising, falling, peak, valley, wave or flat."""
    c = F.col
    base = docs.select(key, paragraphs(F.coalesce(F.col(text), F.lit("")), F.length(F.coalesce(F.col(text), F.lit("")))).alias("p"))
    size = F.floor(F.size("p") / n).cast("int")
    piece = lambda k: F.concat_ws("\n", F.slice("p", size * k + 1, size))
    each = base.where(F.size("p") >= n).select(key, F.array(*[piece(k) for k in range(n)]).alias("s"))
    curve = F.transform("s", lambda x: F.round(F.least(F.lit(1.0), F.regexp_count(x, F.lit(marks)) / F.greatest(F.regexp_count(F.lower(x), F.lit(letters)) / 500.0, F.lit(0.1))), 6))
    each = each.select(key, curve.alias("curve"))
    peaks = F.size(F.filter(F.transform(F.sequence(F.lit(2), F.lit(n - 1)), lambda i: (F.element_at("curve", i) > F.element_at("curve", i - 1)) & (F.element_at("curve", i) > F.element_at("curve", i + 1))), lambda x: x))
    first, last, top, low = F.element_at("curve", 1), F.element_at("curve", n), F.array_max("curve"), F.array_min("curve")
    shape = ladder((top == low, "flat"), (peaks >= 2, "wave"), ((top > first) & (top > last), "peak"), ((low < first) & (low < last), "valley"), (last > first, "rising"), otherwise="falling")
    return each.select(key, F.concat_ws(",", F.transform(c("curve"), lambda x: F.format_number(x, 3))).alias("points"), shape.alias("shape"))


def goal_gate(docs: DataFrame, shapes: DataFrame, goals: DataFrame, letters: str, pleasures: str, key: str = "doc_id", text: str = "text", checks: Checks | None = None) -> DataFrame:
    """(key, failed, result): length, pleasures and curve of a chapter against its goal (low, high, least_pleasures, curve), and checks of the user's own over the docs' columns: none failed passes, two at most are written anew. goals: one row a key."""
    c = F.col
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    own = checks or Checks()
    base = docs.select(key, count(t, letters).alias("chars"), count(t, pleasures).alias("pleasures"), own.failed().alias("own"), (F.size(own.failed("fail")) > 0).alias("fatal")).join(goals, key).join(shapes.select(key, "shape"), key, "left")
    failed = F.array_compact(F.array(F.when(~c("chars").between(c("low"), c("high")), "length"), F.when(c("pleasures") < c("least_pleasures"), "pleasure"), F.when((c("curve") != "any") & (F.coalesce("shape", F.lit("flat")) != c("curve")), "curve")))
    failed = F.concat(failed, c("own"))
    return base.select(key, F.concat_ws(",", failed).alias("failed"), ladder((F.size(failed) == 0, "pass"), (~c("fatal") & (F.size(failed) <= 2), "retry"), otherwise="fail").alias("result"))


def default_goals(chapters: DataFrame, low: int = 2000, high: int = 4000, pleasures: int = 3, key: str = "doc_id") -> DataFrame:
    """Goals by the place of a chapter: the first three ask for more."""
    early = F.col("ch_num") <= 3
    return chapters.select(key, F.lit(low).alias("low"), F.lit(high).alias("high"), F.when(early, pleasures + 2).otherwise(pleasures).alias("least_pleasures"), F.when(early, "rising").otherwise("any").alias("curve"))


def coverage(texts: DataFrame, plans: DataFrame, key: str = "doc_id", text: str = "text", words: str = "words", least: float = 0.3) -> DataFrame:
    """(key, n_words, covered, ratio, missing): how many key words of a plan its text has. plans: (key, words array)."""
    met = texts.select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t")).join(plans.select(key, words), key)
    hit = F.filter(words, lambda w: F.contains(F.col("t"), F.lower(w)))
    each = met.select(key, words, hit.alias("hit"))
    ratio = F.size("hit") / F.greatest(F.size(words), F.lit(1))
    return each.select(key, F.size(words).cast("long").alias("n_words"), F.size("hit").cast("long").alias("covered"), rounded(ratio, 3).alias("ratio"), F.concat_ws(",", F.array_except(words, "hit")).alias("missing"), ((F.size(words) > 0) & (ratio < least)).alias("deviates"))


def missing_terms(canon: dict[str, Sequence[str]], docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, kind, term): what a canon names and no text of a group has. Hits are reduced to one flag a group before they are turned round."""
    flags = [(k, t) for k, terms in canon.items() for t in terms]
    seen = docs.groupBy(by).agg(*[F.max(F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(t))).alias(f"f{i}") for i, (_, t) in enumerate(flags)])
    table = F.array(*[F.when(~F.col(f"f{i}"), F.struct(F.lit(k).alias("kind"), F.lit(t).alias("term"))) for i, (k, t) in enumerate(flags)])
    return seen.select(by, F.explode(F.array_compact(table)).alias("m")).select(by, "m.*")


def sycophancy(docs: DataFrame, flags: Sequence[tuple[str, str, str]], judgement: str, tags: str, ends: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, flags, untagged, passed): flattering phrases of (pattern, label, severity), and sentences of ten characters that judge without a tag of evidence."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.filter(parts(t, ends), lambda s: (F.length(s) >= 10) & s.rlike(judgement) & ~s.rlike(tags))
    n = total([count(t, p) for p, _, _ in flags])
    return docs.select(key, n.alias("flags"), F.size(bare).cast("long").alias("untagged")).select("*", ((F.col("flags") == 0) & (F.col("untagged") == 0)).alias("passed"))


def intents(texts: DataFrame, table: dict[str, str], key: str, text: str) -> DataFrame:
    """(key, dimension, source): the first phrase that a wish contains, else the phrase of which it has most characters, two at least."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    exact = ladder(*[(F.contains(t, F.lit(k)), v) for k, v in table.items()])
    shared = [F.struct(total([F.when(F.contains(t, F.lit(ch)), 1).otherwise(0) for ch in k]).alias("n"), F.lit(-i).alias("i"), F.lit(v).alias("v")) for i, (k, v) in enumerate(table.items())]
    best = F.array_max(F.array(*shared))
    return texts.select(key, F.coalesce(exact, F.when(best["n"] >= 2, best["v"])).alias("dimension"), F.when(exact.isNotNull(), "rule").when(best["n"] >= 2, "partial").otherwise("fallback").alias("source"))


def topic_tags(docs: DataFrame, lexicon: dict[str, str], key: str = "doc_id", text: str = "text", share: float = 0.2, most: int = 3) -> DataFrame:
    """(key, top, tags): the topic of most words, and those of a fifth of it and more."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    scores = F.array_sort(F.filter(F.array(*[F.struct((-count(t, p)).alias("m"), F.lit(n).alias("g")) for n, p in lexicon.items()]), lambda x: x["m"] < 0))
    each = docs.select(key, scores.alias("s"))
    return each.select(key, F.try_element_at("s", F.lit(1))["g"].alias("top"), F.concat_ws(",", F.transform(F.slice(F.filter("s", lambda x: x["m"] <= F.element_at("s", 1)["m"] * share), 1, most), lambda x: x["g"])).alias("tags"))


def book_warnings(rows: DataFrame, value: str = "conflict_density", by: str = "book", order: str = "ch_num", low: float = 0.3, high: float = 0.6) -> DataFrame:
    """(by, order, warning): jumps from low to high, chapters half again as long as the mean, the fifth and later of low ones in a row."""
    w = Window.partitionBy(by).orderBy(order)
    k = F.row_number().over(w)
    lows = rows.select(by, order, value, "wc", k.alias("k"), F.lag(value).over(w).alias("prev"), F.avg("wc").over(Window.partitionBy(by)).alias("mean"))
    last_high = F.max(F.when(F.col(value) >= low, F.col("k"))).over(w)
    marked = lows.withColumn("run", F.col("k") - F.coalesce(last_high, F.lit(0)))
    kinds = F.array(F.when((F.col("prev") < low) & (F.col(value) > high), "jump"), F.when(F.col("wc") > 1.5 * F.col("mean"), "long"), F.when(F.col("run") >= 5, "low_streak"))
    return marked.select(by, order, F.explode(F.array_compact(kinds)).alias("warning"))


def cliches(docs: DataFrame, phrases: dict[str, str], by: str, text: str = "text") -> DataFrame:
    """(by, phrase, coverage, level): in what share of a group's texts a phrase stands."""
    flags = docs.groupBy(by).agg(*[F.avg(F.lower(F.coalesce(F.col(text), F.lit(""))).rlike(p).cast("double")).alias(n) for n, p in phrases.items()])
    long = flags.unpivot([by], list(phrases), "phrase", "coverage").where("coverage >= 0.1")
    return long.select(by, "phrase", rounded(F.round("coverage", 9), 3).alias("coverage"), ladder((F.round("coverage", 9) >= 0.4, "high"), (F.round("coverage", 9) >= 0.2, "medium"), otherwise="low").alias("level"))


def platform_compliance(chapters: DataFrame, hooks: str, conflicts: str, letters: str, by: str = "book", number: str = "ch_num", text: str = "text", window: tuple[int, int, int] = (80_000, 140_000, 150_000)) -> DataFrame:
    """(by, letters, hook_rate, conflict, zero_streak, probability, risk): length, hooks and conflicts of the first ten chapters against a platform's rules."""
    c = F.col
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    each = chapters.select(by, number, count(t, letters).alias("n"), F.right(t, F.lit(300)).rlike(hooks).alias("hook"), count(t, conflicts).alias("hits"))
    dense = F.when(c("n") < 100, F.lit(0.0)).otherwise(rounded(F.round(F.least(c("hits") / (c("n") / 100), F.lit(1.0)), 9), 3))
    each = each.select(by, number, "n", "hook", dense.alias("d"))
    w = Window.partitionBy(by).orderBy(number)
    first = each.where(c(number) <= 10).withColumn("i", F.sum(F.when(c("d") == 0, 0).otherwise(1)).over(w))
    streak = first.groupBy(by, "i").agg(F.sum(F.when(c("d") == 0, 1).otherwise(0)).alias("run")).groupBy(by).agg(F.max("run").alias("zero_streak"))
    ten = first.groupBy(by).agg(F.round(F.avg(c("hook").cast("double")), 9).alias("hook_rate"), F.round(F.avg("d"), 9).alias("conflict"), F.count("*").alias("m"))
    sums = each.groupBy(by).agg(F.sum("n").alias("letters")).join(ten, by).join(streak, by)
    low, high, most = window
    penalty = F.when(c("letters") < low, 30).when(c("letters") >= most, 20).when(c("letters") > high, 10).otherwise(0) + F.when((c("m") >= 10) & (c("hook_rate") < 0.6), 15).otherwise(0) + F.when((c("m") >= 10) & (c("conflict") < 0.4), 15).otherwise(0)
    p = F.greatest(F.lit(0), 100 - penalty).cast("long")
    return sums.select(by, "letters", "hook_rate", "conflict", "zero_streak", p.alias("probability"), ladder((p >= 60, "green"), (p >= 40, "yellow"), otherwise="red").alias("risk"))
