"""The chapter projection: one row of metrics for each chapter of a book.

Texts are counted where they are read: one narrow pass, in Arrow batches, yields counts, and only counts are shuffled to number
the chapters of a book. Every density, class and score is worked out from the counts.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from storyloom.functions.columns import BLANK, clamp, count, dense, distinct_chars, first_max, ladder, matches, paragraphs, rounded, shares, span_chars, total
from storyloom.functions.lexicon import LATIN, RICH_LATIN, Hook, LexiconPack
from storyloom.functions.tally import ends, in_slices, n_paragraphs, pattern_counts, portable, sentence_sizes, short_last, span


def sentence(ends: str) -> str:
    """A trimmed sentence: from its first character that is no space to the last one before an end mark."""
    return rf"[^{BLANK}{ends}](?:[^{ends}]*[^{BLANK}{ends}])?"


def least_first(pattern: str) -> str:
    """A pattern that is found in the same texts: a class that begins it need be repeated no more than its least number of times. The longest runs are tried from every letter else."""
    return re.sub(r"^(\[[^\[\]]+\]\{[0-9]+),\}(?![?+|])(?!.*\|)", r"\1}", pattern)


def hook_type(body: Column, hooks: tuple[Hook, ...], ending: Column) -> Column:
    """body: the text, or as much of its end as the rules read; ending: paragraphs of its last 500 characters."""
    last, before = F.length(F.try_element_at(ending, F.lit(-1))), F.length(F.try_element_at(ending, F.lit(-2)))
    steps = []
    for hook in hooks:
        fires = [matches(F.right(body, F.lit(n)), least_first(pattern)) for n, pattern in hook.rules]
        fires += [F.coalesce((last < 30) & (before > 80), F.lit(False))] * hook.short_last
        steps.append((total_or(fires), hook.label))
    return ladder(*steps, otherwise="none")


def total_or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def chapter_counts(docs: DataFrame, pack: LexiconPack = LATIN, book: str = "source", order: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each text, without the text: a narrow pass. A null text counts as empty. What Java alone reads as it is meant is counted by Spark's functions, all else in Arrow batches."""
    low = {"low": F.lower("text")} if pack.lower else {}
    base = docs.select(F.col(book).alias("book"), F.col(order).alias(order), *keep, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns(low)
    side = "low" if pack.lower else "text"
    counts = _counts(pack, side)
    here = {n: count(F.col(x), p) for n, (x, p) in counts.items() if not portable(p)}
    here |= {n: span_chars(F.col("text"), p) for n, p in _spans(pack).items() if not portable(p)}
    if not _portable_hooks(pack):
        tails = base.withColumns({"tail": F.right("text", F.lit(500)), "low_tail": F.right(side, F.lit(_reach(pack)))})
        base = tails.withColumn("ending", paragraphs(F.col("tail"), F.length("tail")))
        here["hook_type"] = hook_type(F.col("low_tail"), pack.hooks, F.col("ending"))
    rows = base.select("book", order, *keep, F.substring(F.sha2("text", 256), 1, 16).alias("ch_hash"), "text", *low, *[c.alias(n) for n, c in here.items()])
    whole = ["book", order, *keep, "ch_hash"]
    names = ["wc", "para_count", "dialogue_chars", "exclamations", *[n for n in counts if n not in ("exclamations", "sentences", *LATE)], "hook_type", "sentences", "sentence_chars", "distinct_chars", *LATE]
    schema = StructType([*[rows.schema[n] for n in whole], *[StructField(n, StringType() if n == "hook_type" else LongType()) for n in names]])
    return rows.mapInArrow(functools.partial(in_slices, make=functools.partial(tally, pack=pack, whole=whole, names=names)), schema)


#: Counts that come last in the rows.
LATE = ("anti_trope_count", "high_emotion_count", "low_emotion_count", "burnout_count")


def _counts(pack: LexiconPack, side: str) -> dict[str, tuple[str, str]]:
    """(column of texts, pattern) of each count."""
    words = {**{f"{n}_count": e.pattern for n, e in pack.pleasure.items()}, "general_count": pack.general.pattern, "physio_count": pack.physio.pattern, "negatives": pack.negative, **{f"{n}_conflicts": p for n, p in pack.conflict.items()}, "hooks": pack.hook}
    words |= dict(zip(LATE, (pack.anti_trope, pack.high_emotion, pack.low_emotion, pack.burnout), strict=True))
    return {"exclamations": ("text", pack.exclamation), "sentences": ("text", sentence(pack.ends)), **{n: (side, p) for n, p in words.items()}}


def _spans(pack: LexiconPack) -> dict[str, str]:
    return {"dialogue_chars": pack.dialogue, "sentence_chars": sentence(pack.ends)}


def _reach(pack: LexiconPack) -> int:
    """The longest end of a text that a rule of hooks reads."""
    return max((n for h in pack.hooks for n, _ in h.rules), default=1)


def _portable_hooks(pack: LexiconPack) -> bool:
    return all(portable(p) for h in pack.hooks for _, p in h.rules)


def tally(batch: pa.RecordBatch, pack: LexiconPack, whole: list[str], names: list[str]) -> pa.RecordBatch:
    """The counts of a batch of texts; those that it has already are handed on."""
    side = "low" if pack.lower else "text"
    texts = {x: batch[x] for x in ("text", side)}
    strings = {x: t.to_pylist() for x, t in texts.items()}
    dense_ = [s.replace("\n", "").replace(" ", "") for s in strings["text"]]
    done: dict[str, object] = {n: batch[n] for n in names if n in batch.schema.names}
    done |= {"wc": [len(s) for s in dense_], "distinct_chars": [len(set(s)) for s in dense_], "para_count": [n_paragraphs(s, len(d)) for s, d in zip(strings["text"], dense_, strict=True)]}
    if not {"sentences", "sentence_chars"} & done.keys():
        done["sentences"], done["sentence_chars"] = sentence_sizes(strings["text"], pack.ends)
    for x in texts:
        done |= pattern_counts(texts[x], strings[x], {n: p for n, (at, p) in _counts(pack, side).items() if at == x and n not in done})
    done |= {n: span(texts["text"], p) for n, p in _spans(pack).items() if n not in done}
    if "hook_type" not in done:
        done["hook_type"] = hook_types(texts[side], strings["text"], pack)
    return pa.RecordBatch.from_arrays([*[batch[n] for n in whole], *[done[n] if isinstance(done[n], pa.Array) else pa.array(done[n], pa.string() if n == "hook_type" else pa.int64()) for n in names]], [*whole, *names])


def hook_types(low: pa.Array, strings: list[str], pack: LexiconPack) -> list[str]:
    """The first type of hook that fires at the end of each text."""
    tails, kinds = ends(low, _reach(pack)), np.full(len(low), "none", dtype=object)
    for hook in reversed(pack.hooks):
        for n, pattern in hook.rules:
            kinds[pc.match_substring_regex(ends(tails, n), pattern).to_numpy(zero_copy_only=False)] = hook.label
        if hook.short_last:
            kinds[[short_last(s[-500:]) for s in strings]] = hook.label
    return kinds.tolist()


def chapter_metrics(counts: DataFrame, pack: LexiconPack = LATIN, order: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """All metrics of each chapter from its counts; chapters are numbered within a book by `order`, or carry `ch_num` already. Metrics are worked out before the rows of a book meet to be numbered."""
    whole = ["book", order, *keep]
    given = ["ch_num"] if "ch_num" in counts.columns else []
    chars, c = F.greatest("wc", F.lit(1)), F.col
    weighted = total([c(f"{n}_count") * e.weight for n, e in pack.pleasure.items()] + [c("general_count") * pack.general.weight, c("physio_count") * pack.physio.weight])
    conflicts = total([c(f"{n}_conflicts") for n in pack.conflict])
    raw = counts.select(
        "*",
        (100.0 * weighted / chars).alias("pos"),
        (100.0 * c("negatives") / chars).alias("neg"),
        (100.0 * conflicts / chars).alias("conf"),
        (100.0 * c("exclamations") / chars).alias("excl"),
        (c("hooks") / F.greatest(c("wc") / 1000.0, F.lit(1.0))).alias("hook"),
        (c("dialogue_chars") / chars).alias("talk"),
        (c("wc") / F.greatest("para_count", F.lit(1))).alias("para_len"),
        (c("sentence_chars") / F.greatest("sentences", F.lit(1))).alias("asl"),
        (c("distinct_chars") / chars).alias("vd"),
        first_max({e.label or n: c(f"{n}_count") for n, e in pack.pleasure.items()}).alias("dominant_sub"),
    )
    strength = 0.7 * (2.0 * c("pos") + 1.5 * c("conf") + 0.5 * c("excl") + 0.5 * c("hook") + 0.2 * c("neg") + 2.0 * c("physio_count") / F.greatest(c("wc") / 100.0, F.lit(1.0)))
    raw = raw.withColumn("pleasure_intensity", rounded(clamp(strength, 0, 10), 1))
    delight, tension, tragedy, suspense, daily = pack.emotions
    delayed = [e.label or n for n, e in pack.pleasure.items() if e.timing == "delayed"]
    rows = raw.select(
        *whole,
        *given,
        "ch_hash",
        "wc",
        "para_count",
        F.floor("para_len").cast("long").alias("avg_para_len"),
        rounded(c("talk"), 3).alias("dialogue_ratio"),
        rounded(c("excl"), 2).alias("excl_density"),
        rounded(c("pos"), 2).alias("pos_density"),
        rounded(c("neg"), 2).alias("neg_density"),
        rounded(c("conf"), 2).alias("conflict_density"),
        rounded(c("hook"), 2).alias("hook_density"),
        *[f"{n}_count" for n in pack.pleasure],
        "physio_count",
        "dominant_sub",
        ladder((c("pleasure_intensity") >= 6, "climax"), (c("pleasure_intensity") >= 4, "major"), (c("pleasure_intensity") >= 2, "minor"), otherwise="none").alias("pleasure_type"),
        "pleasure_intensity",
        F.when(c("dominant_sub").isin(delayed), F.lit("delayed")).otherwise(F.lit("instant")).alias("pleasure_timing"),
        "hook_type",
        rounded(clamp(0.5 * c("asl") / 80.0 + 0.3 * (1.0 - 3.0 * c("vd")) + F.abs(c("asl") - 35.0) / 50.0 * 0.2, 0, 1), 3).alias("readability"),
        rounded(c("asl"), 1).alias("avg_sentence_len"),
        rounded(c("vd"), 3).alias("vocab_diversity"),
        (c("conf") > 0.3).alias("conflict"),
        ladder((c("conf") > 2.5, "high"), (c("conf") > 1.0, "medium"), (c("conf") > 0.3, "low"), otherwise="none").alias("conflict_level"),
        ladder(
            (c("pos") > 2.0 * c("neg"), delight),
            ((c("conf") > 2.0) & (c("neg") > c("pos")), tension),
            ((c("sacrifice_count") >= 2) & (c("bond_count") >= 2), tragedy),
            (c("conf") > 1.5, tragedy),
            (c("comeback_count") > c("slap_count"), suspense),
            otherwise=daily,
        ).alias("emotion"),
        ladder(((c("para_len") < 45) | ((c("para_len") < 80) & (c("excl") > 0.5)), "fast"), (c("para_len") > 250, "slow"), otherwise="medium").alias("pace"),
        (c("anti_trope_count") >= 1).alias("anti_trope"),
        "anti_trope_count",
        clamp((3 * c("high_emotion_count") + 2 * c("physio_count")) - (2 * c("low_emotion_count") + 4 * c("burnout_count")), -10, 10).cast("long").alias("emotion_valence"),
        ((c("high_emotion_count") >= 2) & (c("burnout_count") >= 1)).alias("emotion_burnout"),
        "high_emotion_count",
        "burnout_count",
        ((c("slap_count") > 5) & (c("pleasure_intensity") < 3)).alias("slap_noise"),
    )
    if given:
        return rows
    number = F.row_number().over(Window.partitionBy("book").orderBy(order)).cast("long")
    return rows.withColumn("ch_num", number).select(*whole, "ch_num", *rows.columns[len(whole) :])


def rich_scan(docs: DataFrame, classes: dict = RICH_LATIN, key: str = "doc_id", text: str = "text", dialogue: str = LATIN.dialogue, ends: str = ".!?", lower: bool = True) -> DataFrame:
    """The second, simplified projection of a text: densities by letters of the script, by 1000 of them, and of three parts."""
    base = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("low", F.lower("text") if lower else F.col("text"))
    body, low = F.col("text"), F.col("low")
    kinds = ("hook", "conflict", "pleasure")
    counts = base.select(
        key,
        count(low, classes["letters"]).alias("chars"),
        F.greatest(count(body, f"[{ends}…\\n]"), F.lit(1)).alias("n_sentences"),
        *[count(low, p).alias(f"{k}_{n}") for k in kinds for n, p in classes[k].items()],
        count(low, classes["positive"]).alias("positives"),
        count(low, classes["negative"]).alias("negatives"),
        count(low, classes["physio"]).alias("physio"),
        count(body, "[！!？?]").alias("exclamations"),
        span_chars(body, dialogue).alias("dialogue_chars"),
        count(body, sentence(ends)).alias("sentences"),
        span_chars(body, sentence(ends)).alias("sentence_chars"),
        distinct_chars(dense(body)).alias("distinct_chars"),
        F.length(dense(body)).alias("dense_chars"),
        *[c.alias(f"{name}_{i}") for i, part in enumerate(shares(low, 3)) for name, c in (("part_chars", count(part, classes["letters"])), *[(f"part_{k}", total([count(part, p) for p in list(classes[k].values())[:2]])) for k in kinds])],
    )
    c = F.col
    letters, kilo = F.greatest("chars", F.lit(1)), F.greatest(c("chars") / 1000.0, F.lit(1.0))
    sums = counts.select("*", *[total([c(f"{k}_{n}") for n in classes[k]]).alias(f"{k}_sum") for k in kinds], (c("sentence_chars") / F.greatest("sentences", F.lit(1))).alias("asl"), (c("distinct_chars") / F.greatest("dense_chars", F.lit(1))).alias("vd"), letters.alias("letters"), kilo.alias("kilo"))
    strength = 0.7 * (200.0 * c("positives") / c("letters") + 150.0 * c("conflict_sum") / c("letters") + 50.0 * c("exclamations") / c("letters") + 0.5 * c("hook_sum") / c("kilo") + 20.0 * c("negatives") / c("letters") + 2.0 * c("physio") / F.greatest(c("letters") / 100.0, F.lit(1.0)))
    return sums.select(
        key,
        "chars",
        F.col("n_sentences").alias("sentences"),
        rounded(c("hook_sum") / c("kilo"), 2).alias("hook_density"),
        rounded(100.0 * c("conflict_sum") / c("letters"), 2).alias("conflict_density"),
        rounded(c("pleasure_sum") / c("kilo"), 3).alias("pleasure_density"),
        rounded(clamp(strength, 0, 10), 1).alias("pleasure_intensity"),
        rounded(c("dialogue_chars") / c("letters"), 3).alias("dialogue_ratio"),
        rounded(c("asl"), 1).alias("avg_sentence_len"),
        rounded(clamp(0.5 * c("asl") / 80.0 + 0.3 * (1.0 - 3.0 * c("vd")) + 0.2 * F.abs(c("asl") - 35.0) / 50.0, 0, 1), 3).alias("readability"),
        *[rounded(c(f"hook_{n}") / c("kilo"), 3).alias(f"hook_{n}") for n in classes["hook"]],
        *[rounded(100.0 * c(f"conflict_{n}") / c("letters"), 3).alias(f"conflict_{n}") for n in classes["conflict"]],
        *[rounded(c(f"pleasure_{n}") / c("kilo"), 3).alias(f"pleasure_{n}") for n in classes["pleasure"]],
        *[e.alias(n) for i in range(3) for n, e in (
            (f"chars_{i}", c(f"part_chars_{i}")),
            (f"hook_density_{i}", rounded(c(f"part_hook_{i}") / F.greatest(F.greatest(c(f"part_chars_{i}"), F.lit(1)) / 1000.0, F.lit(1.0)), 3)),
            (f"conflict_density_{i}", rounded(100.0 * c(f"part_conflict_{i}") / F.greatest(c(f"part_chars_{i}"), F.lit(1)), 3)),
            (f"pleasure_density_{i}", rounded(c(f"part_pleasure_{i}") / F.greatest(F.greatest(c(f"part_chars_{i}"), F.lit(1)) / 1000.0, F.lit(1.0)), 3)),
        )],
    )
