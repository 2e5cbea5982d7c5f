"""Sequence operators: windows, runs and turning points over the ordered rows of a group (the chapters of a book).

Each function takes a DataFrame and the names of its columns and returns a DataFrame. A group's rows meet in one task; the
rows are numbers, not texts. Equal values are ordered by the order column, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from storyloom.functions.columns import ladder, rounded, total


def along(by: str | list[str] = "book", order: str = "ch_num") -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def sized(rows: DataFrame, by: str = "book", name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.count("*").over(Window.partitionBy(by)))


def runs(rows: DataFrame, condition: Column, by: str = "book", order: str = "ch_num") -> DataFrame:
    """(by, first, last, run): maximal runs of neighbouring rows for which the condition holds."""
    marked = rows.select(by, order, F.row_number().over(along(by, order)).alias("k"), F.coalesce(condition, F.lit(False)).alias("hit")).where("hit")
    island = marked.withColumn("island", F.col("k") - F.row_number().over(along(by, order)))
    return island.groupBy(by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("run")).drop("island")


def longest_run(rows: DataFrame, condition: Column, by: str = "book", order: str = "ch_num", name: str = "max_streak") -> DataFrame:
    """(by, name): the longest run of the condition, 0 where it never holds. One sort by group."""
    breaks = F.sum(F.when(F.coalesce(condition, F.lit(False)), 0).otherwise(1)).over(along(by, order))
    lengths = rows.select(by, breaks.alias("island"), F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(0).alias("one")).groupBy(by, "island").agg(F.sum("one").alias("run"))
    return lengths.groupBy(by).agg(F.max("run").alias(name))


#: Columns whose relative change makes the variability, with the least value that each is divided by.
VARIED = (("wc", 1.0), ("dialogue_ratio", 0.001), ("pos_density", 0.001), ("conflict_density", 0.001))


def variability(rows: DataFrame, parts: Sequence[tuple[str, float]] = VARIED, by: str = "book", order: str = "ch_num", name: str = "ch_variability") -> DataFrame:
    """The rows with the mean relative change from the row before; 0 in the first and the last row."""
    w = along(by, order)
    changes = [F.abs(F.col(c) - F.lag(c).over(w)) / F.greatest(F.lag(c).over(w), F.lit(least)) for c, least in parts]
    edge = F.lag(order).over(w).isNull() | F.lead(order).over(w).isNull()
    return rows.withColumn(name, F.when(edge, F.lit(0.0)).otherwise(rounded(total(changes) / len(parts), 3)))


def pleasure_level(rows: DataFrame, by: str = "book", order: str = "ch_num") -> DataFrame:
    """near_intensity and pleasure_level from a row and its two neighbours."""
    near = along(by, order).rowsBetween(-1, 1)
    mean = F.avg("pleasure_intensity").over(near)
    has = lambda kind: F.max((F.col("pleasure_type") == kind).cast("int")).over(near) == 1
    slaps = F.sum("slap_count").over(near)
    level = ladder((has("climax") & (F.round(mean, 6) >= 6), "large"), (has("major") & (F.round(mean, 6) >= 4) & (slaps >= 3), "medium"), ((slaps >= 1) | (F.col("pleasure_intensity") >= 2), "small"), otherwise="none")
    return rows.select("*", rounded(mean, 3).alias("near_intensity"), level.alias("pleasure_level"))


def verify_sample(rows: DataFrame, most: int = 15, by: str = "book", order: str = "ch_num", peaks: Sequence[str] = ("pleasure_intensity", "conflict_density")) -> DataFrame:
    """Every tenth part of a group, its last row and the row of each peak; the first `most` of them."""
    everything = Window.partitionBy(by)
    k = F.row_number().over(along(by, order))
    tops = [F.row_number().over(everything.orderBy(F.desc(p), order)) for p in peaks]
    ranked = rows.select(by, order, k.alias("k"), F.count("*").over(everything).alias("n"), *[t.alias(f"top_{i}") for i, t in enumerate(tops)])
    step = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    hit = ((F.col("k") - 1) % step == 0) | (F.col("k") == F.col("n"))
    for i in range(len(peaks)):
        hit = hit | (F.col(f"top_{i}") == 1)
    return ranked.where(hit).withColumn("pick", F.row_number().over(along(by, order))).where(F.col("pick") <= most).select(by, order)


def vad(rows: DataFrame, by: str = "book", order: str = "ch_num") -> DataFrame:
    """(by, order, v, a, d, before, after, spread, place, n): valence, arousal and dominance with the means of the two rows before and from each row on, and the deviation of the ten around it."""
    w = along(by, order)
    curve = rows.select(by, order, rounded(F.col("pos_density") - F.col("neg_density"), 2).alias("v"), F.col("pleasure_intensity").alias("a"), rounded(10 - F.col("conflict_density"), 2).alias("d"))
    over = lambda f, low, high: f("v").over(w.rowsBetween(low, high))
    return curve.select("*", over(F.avg, -2, -1).alias("before"), over(F.avg, 0, 1).alias("after"), over(F.stddev_samp, -5, 4).alias("spread"), F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy(by)).alias("n"))


def turning_points(rows: DataFrame, by: str = "book", order: str = "ch_num", factor: float = 1.2, least: int = 10) -> DataFrame:
    """Rows at which the valence turns by more than `factor` deviations; none in groups under `least` rows."""
    jump = F.abs(F.col("after") - F.col("before"))
    inner = vad(rows, by, order).where((F.col("n") >= least) & (F.col("place") > 2) & (F.col("place") <= F.col("n") - 2) & (F.col("spread") > 0) & (F.round(jump, 9) > F.round(F.col("spread") * factor, 9)))
    return inner.select(by, order, F.when(F.col("after") > F.col("before"), F.lit("up")).otherwise(F.lit("down")).alias("dir"), rounded(F.round(jump, 9), 2).alias("delta"))


def vad_summary(rows: DataFrame, by: str = "book", order: str = "ch_num") -> DataFrame:
    turns = turning_points(rows, by, order).groupBy(by).agg(F.count("*").alias("turns"))
    means = vad(rows, by, order).groupBy(by).agg(F.avg("v").alias("v"), F.avg("a").alias("a"), F.avg("d").alias("d"), F.count("*").alias("n"))
    keep = lambda x, digits: F.when(F.col("n") >= 10, rounded(F.round(x, 9), digits)).otherwise(F.lit(0.0))
    return means.join(turns, by, "left").select(by, keep("v", 2).alias("v_mean"), keep("a", 1).alias("a_mean"), keep("d", 2).alias("d_mean"), F.coalesce("turns", F.lit(0)).alias("turning_count"))


def state_trajectory(rows: DataFrame, by: str = "book", order: str = "ch_num") -> DataFrame:
    """Changes of valence or arousal by more than 1.5 deviations of the whole group; stability and the kind of arc, for groups of ten rows and more."""
    w, everything = along(by, order), Window.partitionBy(by)
    v = rows.select(by, order, rounded(F.col("pos_density") - F.col("neg_density"), 3).alias("v"), F.col("pleasure_intensity").alias("a"))
    moved = v.select("*", F.row_number().over(w).alias("k"), F.count("*").over(everything).alias("n"), *[F.round(F.abs(F.col(c) - F.lag(c).over(w)), 9).alias(f"d{c}") for c in "va"], *[F.round(F.stddev_samp(c).over(everything) * 1.5, 9).alias(f"s{c}") for c in "va"])
    edge = F.greatest(F.lit(5), F.floor(F.col("n") / 10))
    change = F.coalesce((F.col("dv") > F.col("sv")) | (F.col("da") > F.col("sa")), F.lit(False))
    each = moved.where("n >= 10").groupBy(by).agg(F.sum(change.cast("long")).alias("change_count"), F.max("n").alias("n"), F.max(F.when(F.col("k") == edge, F.col("v"))).alias("v_start"), F.max(F.when(F.col("k") == F.col("n") - edge + 1, F.col("v"))).alias("v_end"))
    stable = 1 - F.least(F.lit(1.0), F.col("change_count") / F.greatest(F.col("n") * 0.05, F.lit(1.0)))
    up, down = F.round(F.col("v_end") - F.col("v_start"), 9), F.round(F.col("v_start") - F.col("v_end"), 9)
    return each.select(by, "change_count", rounded(F.round(stable, 9), 3).alias("stability"), ladder((up > 0.02, "rising"), (down > 0.02, "falling"), otherwise="level").alias("arc"), "v_start", "v_end")


def phases(rows: DataFrame, by: str = "book", order: str = "ch_num") -> DataFrame:
    """(by, phase, start_ch, end_ch, dominant_sub, completeness): phases of an arc. A phase ends where intensity jumps, pace turns with it, or its leading class has given way for more than five rows; the last test depends on where the phase began, so a group's rows are followed in order, as a stream of which a task holds a few phases."""
    w = Window.partitionBy(by).orderBy(order, "pleasure_intensity", "pace", "dominant_sub")
    gap = F.round(F.abs(F.col("pleasure_intensity") - F.lag("pleasure_intensity").over(w)), 6)
    jump = F.coalesce((gap > 3) | ((F.col("pace") != F.lag("pace").over(w)) & (gap > 1.5)), F.lit(False))
    marked = rows.select(by, F.row_number().over(w).cast("long").alias("k"), jump.alias("jump"), F.col("dominant_sub").alias("sub"), F.lead(F.lit(1)).over(w).isNull().alias("last"))
    schema = StructType([marked.schema[by], *[StructField(n, LongType()) for n in ("phase", "start_ch", "end_ch")], StructField("dominant_sub", StringType()), StructField("completeness", DoubleType())])
    return marked.repartition(by).sortWithinPartitions(by, "k").mapInArrow(followed, schema)


def followed(batches: Iterator[pa.RecordBatch], least: int = 10, full: int = 5) -> Iterator[pa.RecordBatch]:
    """The phases of groups of `least` rows and more from (by, k, jump, sub, last), where k counts the rows of a group from 1. Phases are held back until there are `full` of them, or the group ends, and it is long enough."""
    held: list[tuple] = []
    start, own, n = 1, None, 0
    for batch in batches:
        out = []
        for by, k, jump, sub, last in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if k == 1:
                held, start, own, n = [], 1, sub, 0
            elif jump or (k - start > 6 and None not in (sub, own) and sub != own and "none" not in (sub, own)):
                n += 1
                held.append((by, n, start, k - 1, own))
                start, own = k, sub
            if last:
                n += 1
                held.append((by, n, start, k, own))
            if k >= least and (last or n >= full):
                out += [(*phase, round(min(1.0, n / full), 2)) for phase in held]
                held = []
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [batch.schema.names[0], "phase", "start_ch", "end_ch", "dominant_sub", "completeness"])


def transitions(rows: DataFrame, value: str = "dominant_sub", by: str = "book", order: str = "ch_num") -> DataFrame:
    changed = rows.select(by, (F.col(value) != F.lag(value).over(along(by, order))).alias("moved"))
    return changed.groupBy(by).agg(F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)).alias("transitions"))


# Narrative labels in the order in which they are tried, as predicates over the row, its variability and the intensity before.
LABELS = (
    ("opening", "conflict_density < 0.3 AND pleasure_intensity < 3"),
    ("development", "conflict_density >= 0.3 AND conflict_density < 1"),
    ("turn", "ch_variability > 0.5 OR abs(pleasure_intensity - prev_intensity) > 2.5"),
    ("payoff", "pleasure_intensity >= 5"),
    ("tension", "conflict_density > 1.5 AND neg_density > pos_density"),
    ("relief", "conflict_density < 0.2 AND dialogue_ratio > 0.25"),
    ("clue", "hook_type = 'suspense' AND conflict_density < 0.5"),
    ("overturn", "hook_type IN ('reversal', 'info') AND conflict_density < 0.5"),
)
TEMPLATE = ("opening", "development", "development", "turn", "turn", "payoff", "payoff")


def structure_labels(rows: DataFrame, by: str = "book", order: str = "ch_num") -> DataFrame:
    varied = variability(rows, by=by, order=order).withColumn("prev_intensity", F.lag("pleasure_intensity").over(along(by, order)))
    return varied.select(by, order, ladder(*[(F.expr(p), label) for label, p in LABELS], otherwise="development").alias("label"))


def template_match(labelled: DataFrame, template: Sequence[str] = TEMPLATE, by: str = "book", order: str = "ch_num") -> DataFrame:
    """Rows at which the sequence of labels begins."""
    w = along(by, order)
    seen = labelled.withColumn("ahead", F.collect_list("label").over(w.rowsBetween(0, len(template) - 1)))
    return seen.where(F.col("ahead") == F.array(*[F.lit(x) for x in template])).select(by, order)


def risk_events(rows: DataFrame, most: int = 10, by: str = "book", order: str = "ch_num") -> DataFrame:
    """Two neighbours without hooks, jumps of rhythm, and the first run of three flat conflicts; the last row is never one."""
    w = along(by, order)
    varied = variability(rows, by=by, order=order)
    flat = (F.col("conflict_density") < 0.1) & (F.lag("conflict_density").over(w) < 0.1) & (F.lag("conflict_density", 2).over(w) < 0.1)
    marked = varied.select(by, order, "ch_variability", F.lead(order).over(w).isNotNull().alias("inner"), ((F.col("hook_density") == 0) & (F.lag("hook_density").over(w) == 0)).alias("hookless"), flat.alias("flat")).where("inner")
    marked = marked.withColumn("first_flat", F.min(F.when(F.col("flat"), F.col(order))).over(Window.partitionBy(by)))
    kinds = F.array(F.when(F.col("hookless"), F.struct(F.lit(0).alias("late"), F.lit("no_hook_twice").alias("risk"))), F.when(F.col("ch_variability") > 50, F.struct(F.lit(0).alias("late"), F.lit("rhythm_jump").alias("risk"))), F.when(F.col(order) == F.col("first_flat"), F.struct(F.lit(1).alias("late"), F.lit("flat_conflict").alias("risk"))))
    found = marked.select(by, order, F.explode(F.array_compact(kinds)).alias("r")).select(by, order, "r.risk", "r.late")
    return found.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy("late", order, "risk"))).where(F.col("k") <= most).select(by, order, "risk")


def smoothed(rows: DataFrame, by: str = "book", order: str = "ch_num", name: str = "smoothed") -> DataFrame:
    """Conflict and half the hooks, averaged over five rows with zeros beyond the ends; as it is in groups under five rows."""
    raw = rows.select(by, order, (F.col("conflict_density") + 0.5 * F.col("hook_density")).alias("raw"))
    n = F.count("*").over(Window.partitionBy(by))
    return raw.select(by, order, n.alias("n"), F.round(F.when(n >= 5, F.sum("raw").over(along(by, order).rowsBetween(-2, 2)) / 5).otherwise(F.col("raw")), 9).alias(name))


# Beats of a story by their place in it; in two of them the signal is lowest.
BEATS = (("opening", 0.0), ("theme", 0.05), ("catalyst", 0.1), ("debate", 0.15), ("break_into_2", 0.2), ("b_story", 0.25), ("fun_games", 0.35), ("midpoint", 0.5), ("bad_guys_close_in", 0.55), ("all_is_lost", 0.65), ("dark_night", 0.7), ("break_into_3", 0.75), ("finale", 0.8), ("climax", 0.95), ("final_image", 0.98), ("resolution", 1.0))
LOWS = ("all_is_lost", "dark_night")


def beat_detection(rows: DataFrame, beats: Sequence[tuple[str, float]] = BEATS, lows: Sequence[str] = LOWS, by: str = "book", order: str = "ch_num") -> DataFrame:
    """For each beat the row with the highest (or lowest) signal near its place, with the confidence and what follows from it."""
    table = F.array(*[F.struct(F.lit(b).alias("beat"), F.lit(p).alias("place"), F.lit(1 if b in lows else -1).alias("sign")) for b, p in beats])
    c = F.col
    near = smoothed(rows, by, order, "signal").withColumn("reach", F.greatest(F.lit(5.0), F.floor(0.05 * c("n"))))
    # rows meet only the beats within reach of them
    met = near.select("*", F.explode(table).alias("b")).select(by, order, "n", "signal", "reach", "b.beat", "b.sign", F.greatest(F.lit(1), F.floor(c("b.place") * c("n"))).cast("long").alias("target_ch")).where((c(order) >= c("target_ch") - c("reach")) & (c(order) < c("target_ch") + c("reach")))
    best = met.groupBy(by, "beat").agg(F.min(F.struct((c("sign") * c("signal")).alias("s"), c(order).alias("found_ch"), "target_ch", "reach", "n")).alias("m")).select(by, "beat", "m.*")
    confidence = rounded(F.greatest(F.lit(0.0), 1 - F.abs(c("found_ch") - c("target_ch")) / c("reach")), 2)
    scored = best.select(by, "beat", "found_ch", "target_ch", confidence.alias("confidence"), (F.abs(c("found_ch") - c("target_ch")) > 0.08 * c("n")).alias("is_far"))
    return scored.select("*", (c("confidence") < 0.3).alias("is_gap"), rounded(F.avg((c("confidence") >= 0.5).cast("double")).over(Window.partitionBy(by)), 2).alias("completeness"))


def repeats(rows: DataFrame, value: str, by: str, order: list[str], least: int = 3) -> DataFrame:
    """Rows that continue a run of equal values, from the run's row number `least` on: (by, *order, value, run). Rows without a value play no part."""
    w = Window.partitionBy(by).orderBy(*order)
    step = rows.where(F.col(value).isNotNull()).withColumn("new", F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0)))
    known = step.withColumn("island", F.sum("new").over(w))
    run = F.row_number().over(Window.partitionBy(by, "island").orderBy(*order)).cast("long")
    return known.select(by, *order, value, run.alias("run")).where(F.col("run") >= least)


def stagnation(rows: DataFrame, growth: Column, by: str, order: list[str], least: int = 10) -> DataFrame:
    """(by, n, last_growth, stalled): groups whose last growth lies `least` rows back, or that never grew in `least` rows."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    ends = rows.select(by, k.alias("k"), growth.alias("grew")).groupBy(by).agg(F.count("*").alias("n"), F.max(F.when(F.col("grew"), F.col("k"))).cast("long").alias("last_growth"))
    return ends.select("*", (F.col("n") - F.coalesce("last_growth", F.lit(0))).alias("stalled")).where(F.col("stalled") >= least)


def changes(rows: DataFrame, value: str, by: str, order: list[str]) -> DataFrame:
    """(by, changes, variety): how often a known value differs from the known one before, and how many values there are."""
    w = Window.partitionBy(by).orderBy(*order)
    moved = rows.where(F.col(value).isNotNull()).select(by, value, (F.col(value) != F.lag(value).over(w)).cast("long").alias("moved"))
    return moved.groupBy(by).agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("changes"), F.count_distinct(value).alias("variety"))


def decay(planted: DataFrame, now: Column, at: str, critical: Column, warn: int = 20, archive: int = 50) -> DataFrame:
    """The open threads with age and state: old ones are archived, critical ones only warned of."""
    age = now - F.col(at)
    return planted.select("*", age.cast("long").alias("age"), ladder(((age > archive) & ~critical, "archive"), (age > warn, "warn"), otherwise="open").alias("state"))


def context_window(rows: DataFrame, k: int = 3, by: str = "book", order: str = "ch_num") -> DataFrame:
    """For each row what lies in the k rows before it."""
    w = along(by, order).rowsBetween(-k, -1)
    return rows.select(by, order, F.count("wc").over(w).alias("n_before"), F.coalesce(F.sum("wc").over(w), F.lit(0)).alias("wc_before"), rounded(F.avg("pleasure_intensity").over(w), 3).alias("intensity_before"), F.coalesce(F.concat_ws(",", F.collect_list(F.col("dominant_sub")).over(w)), F.lit("")).alias("subs_before"))


def peak_interval(rows: DataFrame, condition: Column, by: str = "book", order: str = "ch_num") -> DataFrame:
    gaps = rows.where(condition).select(by, (F.col(order) - F.lag(order).over(along(by, order))).alias("gap"))
    return gaps.groupBy(by).agg(F.count("*").alias("n_peaks"), rounded(F.avg("gap"), 3).alias("mean_gap"))


def wave_turning(rows: DataFrame, value: str = "pleasure_intensity", factor: float = 1.3, by: str = "book", order: str = "ch_num") -> DataFrame:
    seen = rows.select(by, order, value, F.lag(value).over(along(by, order)).alias("prev")).where("prev > 0")
    return seen.select(by, order, (F.col(value) / F.col("prev")).alias("x")).where(F.col("x") > factor).select(by, order, rounded(F.col("x"), 3).alias("ratio"))


def keyframes(rows: DataFrame, most: int = 30, by: str = "book", order: str = "ch_num") -> DataFrame:
    """Some `most` rows that tell a book: its first three, peaks of conflict and intensity, first hookless ones, switches of hook type, each tenth and the last."""
    everything, w = Window.partitionBy(by), along(by, order)
    typed = F.when(F.col("hook_type") != "none", F.col("hook_type"))
    ranked = rows.select(
        by,
        order,
        F.row_number().over(w).alias("k"),
        F.count("*").over(everything).alias("n"),
        F.row_number().over(everything.orderBy(F.desc("conflict_density"), order)).alias("c"),
        F.row_number().over(everything.orderBy(F.desc("pleasure_intensity"), order)).alias("i"),
        (F.col("hook_density") < 0.1).alias("broken"),
        F.sum((F.col("hook_density") < 0.1).cast("int")).over(w).alias("hookless"),
        F.coalesce(typed != F.last(typed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias("switch"),
    )
    c = F.col
    tenth = F.exists(F.sequence(F.lit(10), F.lit(90), F.lit(10)), lambda p: F.floor(c("n") * p / 100) == c("k") - 1)
    hit = (c("k") <= 3) | (c("c") <= 5) | (c("broken") & (c("hookless") <= 5)) | c("switch") | tenth | (c("i") <= 3) | (c("k") == c("n"))
    return ranked.where(hit).withColumn("pick", F.row_number().over(w)).where(c("pick") <= most).select(by, order)


def climax_positions(rows: DataFrame, value: str = "pleasure_intensity", by: str = "book", order: str = "ch_num") -> DataFrame:
    everything = Window.partitionBy(by)
    seen = rows.select(by, order, value, F.avg(value).over(everything).alias("mean"), F.max(value).over(everything).alias("top"))
    return seen.groupBy(by).agg(F.min(F.when(F.col(value) > 1.3 * F.col("mean"), F.col(order))).alias("first_high"), F.min(F.when(F.col(value) == F.col("top"), F.col(order))).alias("climax_ch"), F.max(order).alias("n"))


def halves(rows: DataFrame, value: str = "pleasure_intensity", by: str = "book", order: str = "ch_num") -> DataFrame:
    """Means of the first and the second half, and the trend where they differ by 15 %, for groups of six rows and more."""
    half = rows.select(by, value, F.row_number().over(along(by, order)).alias("k"), F.count("*").over(Window.partitionBy(by)).alias("n"))
    means = half.groupBy(by).agg(rounded(F.avg(F.when(2 * F.col("k") <= F.col("n"), F.col(value))), 3).alias("first_half"), rounded(F.avg(F.when(2 * F.col("k") > F.col("n"), F.col(value))), 3).alias("second_half"), F.max("n").alias("n"))
    a, b = F.col("first_half"), F.col("second_half")
    return means.select(by, "first_half", "second_half", ladder((F.col("n") < 6, "unknown"), (b > 1.15 * a, "rising"), (b < 0.85 * a, "falling"), otherwise="stable").alias("trend"))


def plot_structure(rows: DataFrame, value: str = "pleasure_intensity", by: str = "book", order: str = "ch_num") -> DataFrame:
    """The kind of plot by the place of its peak and the means of its halves."""
    k, everything = F.row_number().over(along(by, order)), Window.partitionBy(by)
    seen = rows.select(by, value, k.alias("k"), F.count("*").over(everything).alias("n"), F.max(value).over(everything).alias("top"))
    half = F.floor(F.col("n") / 2)
    facts = seen.groupBy(by).agg(F.max("n").alias("n"), F.min(F.when(F.col(value) == F.col("top"), F.col("k") - 1)).alias("peak"), F.avg(F.when(F.col("k") <= half, F.col(value))).alias("a"), F.avg(F.when(F.col("k") > half, F.col(value))).alias("b"))
    c = F.col
    return facts.select(by, "n", c("peak").cast("long").alias("peak"), ladder((c("n") < 10, "short"), (c("peak") > 0.6 * c("n"), "late_climax"), (c("peak") < 0.3 * c("n"), "early_climax"), (F.round(c("b"), 9) > F.round(1.3 * c("a"), 9), "rising"), otherwise="waves").alias("structure"))


# Scores of emotions from low to high, by words that a state may contain.
EMOTION_SCORES_ZH = (("绝望 崩溃 万念俱灰 心如死灰", 1), ("恐惧 惊恐 骇然 胆寒 害怕", 2), ("悲伤 悲痛 心碎 哀伤 凄凉", 3), ("疲惫 乏力 无力 疲倦", 4), ("犹豫 迟疑 纠结 矛盾 动摇", 5), ("平静 淡然 释然 坦然 从容", 6), ("震惊 震撼 不可思议 难以置信", 7), ("愤怒 暴怒 狂怒 震怒 怒火", 7), ("坚定 决意 决心 毅然", 8), ("兴奋 激动 振奋 狂喜", 9), ("热血沸腾", 10))


def emotion_score(state: Column, scores: Sequence[tuple[str, int]] = EMOTION_SCORES_ZH, otherwise: int = 5) -> Column:
    """1 to 10 for the first list that has a word in the state."""
    out = None
    for words, score in scores:
        hit = state.rlike("|".join(words.split()))
        out = F.when(hit, F.lit(score)) if out is None else out.when(hit, F.lit(score))
    return out.otherwise(F.lit(otherwise)).cast("long")
