"""Records of work: decisions, feedback, goals, plans, reviews and scores, folded into what a writer is shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.columns import ladder, rounded


def consistency(rows: DataFrame, by: str, value: str, label: str) -> DataFrame:
    """(by, n, median, mode): what repeated labels of one thing agree on; of equally frequent labels the first by name."""
    counts = rows.groupBy(by, label).agg(F.count("*").alias("n")).groupBy(by).agg(F.min_by(label, F.struct((-F.col("n")).alias("m"), label)).alias("mode"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.percentile(value, 0.5).alias("median")).join(counts, by)


def drift(rows: DataFrame, value: str, by: str, order: str, last: int = 5, factor: float = 0.3) -> DataFrame:
    """(by, mean, std, recent, drifts): the last rows against all of a group."""
    back = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    m = rows.select(by, value, back.alias("back")).groupBy(by).agg(F.round(F.avg(value), 9).alias("mean"), F.round(F.stddev_samp(value), 9).alias("std"), F.round(F.avg(F.when(F.col("back") <= last, F.col(value))), 9).alias("recent"))
    return m.select(by, rounded(F.col("mean"), 4).alias("mean"), rounded(F.col("std"), 4).alias("std"), rounded(F.col("recent"), 4).alias("recent"), (F.abs(F.col("recent") - F.col("mean")) > F.round(factor * F.abs("mean"), 9)).alias("drifts"))


def decision_signals(rows: DataFrame, by: str, label: str, skip: Column, most: int = 3) -> DataFrame:
    """(by, n, skip_rate, top): how often a question was passed over, and the labels chosen most."""
    n = rows.groupBy(by, label).agg(F.count("*").alias("n"), F.count_if(skip).alias("s"))
    top = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), label))), 1, most), lambda x: x[label])
    return n.groupBy(by).agg(F.sum("n").alias("n"), rounded(F.sum("s") / F.sum("n"), 4).alias("skip_rate"), F.concat_ws(",", top).alias("top"))


def preferences(rows: DataFrame, by: str, choice: str) -> DataFrame:
    """(by, choice, share): what was chosen most for each question."""
    n = rows.groupBy(by, choice).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.min_by(choice, F.struct((-F.col("n")).alias("m"), choice)).alias(choice), rounded(F.max("n") / F.sum("n"), 4).alias("share"))


def maturity(n: Column) -> Column:
    return ladder((n >= 50, "mature"), (n >= 30, "stable"), (n >= 10, "forming"), (n >= 3, "early"), otherwise="new")


def progress(all_rows: DataFrame, done: DataFrame, key: str, by: str) -> DataFrame:
    """(by, total, done, pct, state): how much of each group's work is done."""
    marked = all_rows.select(by, key).join(done.select(key).distinct().withColumn("d", F.lit(1)), key, "left")
    n = marked.groupBy(by).agg(F.count("*").alias("total"), F.count("d").alias("done"))
    return n.select("*", rounded(F.round(100 * F.col("done") / F.col("total"), 9), 1).alias("pct"), ladder((F.col("done") == 0, "waiting"), (F.col("done") == F.col("total"), "complete"), otherwise="running").alias("state"))


def score_table(logs: DataFrame, by: str, model: str, score: str, models: Sequence[str]) -> DataFrame:
    """(by, <model>.., gap): mean scores of several models side by side, and how far apart they are."""
    wide = logs.groupBy(by).pivot(model, list(models)).agg(F.round(F.avg(score), 9))
    known = [F.col(m) for m in models]
    return wide.select(by, *[rounded(F.col(m), 3).alias(m) for m in models], rounded(F.round(F.greatest(*known) - F.least(*known), 9), 3).alias("gap"))


def genre_profile(rows: DataFrame, genre: str, most: int = 3) -> DataFrame:
    """(genre, n, totals, rates, top_subs) of all chapters of a genre."""
    c = F.col
    subs = rows.groupBy(genre, "dominant_sub").agg(F.count("*").alias("n")).groupBy(genre).agg(F.concat_ws(",", F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-c("n")).alias("m"), "dominant_sub"))), 1, most), lambda x: x["dominant_sub"])).alias("top_subs"))
    sums = rows.groupBy(genre).agg(F.count("*").alias("n"), F.sum("wc").alias("wc"), rounded(F.round(F.avg("hook_density"), 9), 3).alias("hook"), rounded(F.round(F.avg(c("conflict").cast("double")), 9), 3).alias("conflict_rate"), F.sum("slap_count").alias("slaps"))
    return sums.join(subs, genre)


def extremes(books: DataFrame, rank: str, by: str, k: int = 3) -> DataFrame:
    """(by, rank, side): the first k and the last k by a rank."""
    top = books.select(by, rank).orderBy(rank, by).limit(k).withColumn("side", F.lit("top"))
    return top.unionByName(books.select(by, rank).orderBy(F.desc(rank), F.desc(by)).limit(k).withColumn("side", F.lit("bottom")))


def feedback(authors: DataFrame, approved: DataFrame, dims: Sequence[str], by: str) -> DataFrame:
    """(by, dim, value, gap, advice): each author's dimensions against the mean of approved ones."""
    means = approved.agg(*[F.round(F.avg(d), 9).alias(f"m_{d}") for d in dims])
    rows = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("double").alias("value"), F.round(F.col(d) - F.col(f"m_{d}"), 9).alias("g"), F.col(f"m_{d}").alias("m")) for d in dims])
    each = authors.join(F.broadcast(means)).select(by, F.explode(rows).alias("r")).select(by, "r.*")
    return each.select(by, "dim", "value", rounded(F.col("g"), 4).alias("gap"), ladder((F.col("g") < F.round(-0.2 * F.abs("m"), 9), "raise"), (F.col("g") > F.round(0.2 * F.abs("m"), 9), "lower"), otherwise="keep").alias("advice"))


def rhythm_targets(chapters: DataFrame, targets: dict[str, float], chars: int = 3000) -> DataFrame:
    """The rows with how many hooks, conflicts and pleasures a chapter of `chars` characters should have, from densities (hooks by 1000, others by 100 characters)."""
    return chapters.select("*", *[F.ceil(F.round(F.lit(d * chars / (1000 if n == "hook" else 100)), 6)).alias(f"n_{n}") for n, d in targets.items()])


def chapter_targets(chapters: DataFrame, plan: DataFrame, by: str, chars: str) -> DataFrame:
    """(the chapters' keys, n_hook, n_conflict): what a chapter of its own length should have by its book's densities (hooks by 1000, conflicts by 100 characters). plan: (by, hook, conflict), a row a book."""
    need = lambda c, of: F.ceil(F.round(F.col(c) * F.col(chars) / float(of), 6)).alias(f"n_{c}")
    return chapters.join(plan, by).select(*[c for c in chapters.columns if c != chars], need("hook", 1000), need("conflict", 100))


def weight_grid(sign: Sequence[float], retain: Sequence[float], low: float = 0.05, high: float = 0.35) -> list[tuple[float, float, float]]:
    """Weights of signing, retention and bonus that add up to one, with a bonus within bounds."""
    cells = [(a, b, round(1 - a - b, 6)) for a in sign for b in retain]
    return [x for x in cells if low <= x[2] <= high]


def weight_sensitivity(books: DataFrame, by: str, grid: Sequence[tuple[float, float, float]], grades: Sequence[tuple[float, str]]) -> DataFrame:
    """(by, low, high, grade_stable, n_weights): a book's scores under all weights, worked out in its row, and the share of them that give the grade of its overall score."""
    scores = F.array(*[F.round(F.round(F.col("signing") * a + F.col("retention") * b + F.col("bonus") * d, 6)) for a, b, d in grid])
    letter = lambda x: ladder(*[(x >= n, g) for n, g in grades], otherwise="D")
    each = books.select(by, "overall", scores.alias("s"))
    stable = F.size(F.filter("s", lambda x: letter(x) == letter(F.col("overall")))) / len(grid)
    return each.select(by, F.array_min("s").alias("low"), F.array_max("s").alias("high"), F.round(stable, 4).alias("grade_stable"), F.lit(len(grid)).cast("long").alias("n_weights"))


def plan_validation(rows: DataFrame, level: str, met: Column, empty: Column, by: str, order: str) -> DataFrame:
    """(by, flat_run, met_share, empty_share, passed): runs of one level, targets that are met, chapters without content."""
    w = Window.partitionBy(by).orderBy(order)
    k = F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, level).orderBy(order))
    run = rows.select(by, level, k.alias("i")).groupBy(by, level, "i").agg(F.count("*").alias("run")).groupBy(by).agg(F.max("run").alias("flat_run"))
    s = rows.groupBy(by).agg(F.round(F.avg(met.cast("double")), 9).alias("m"), F.round(F.avg(empty.cast("double")), 9).alias("e")).join(run, by)
    return s.select(by, "flat_run", rounded(F.col("m"), 3).alias("met_share"), rounded(F.col("e"), 3).alias("empty_share"), ((F.col("flat_run") < 3) & (F.col("m") >= 0.8) & (F.col("e") <= 0.5)).alias("passed"))


def length_classes(rows: DataFrame, by: str, value: str = "wc") -> DataFrame:
    """(by, cv, class): how even the lengths of a book's chapters are."""
    cv = F.stddev_pop(value) / F.avg(value)
    m = rows.groupBy(by).agg(F.round(cv, 9).alias("c"))
    return m.select(by, rounded(F.col("c"), 4).alias("cv"), ladder((F.col("c") < 0.15, "even"), (F.col("c") < 0.3, "varied"), otherwise="wild").alias("class"))


def arc_bins(mentions: DataFrame, by: str, entity: str, number: str, size: int = 5, most: int = 5) -> DataFrame:
    """(by, entity, bin, n): mentions of the most frequent entities in bins of chapters, empty bins included."""
    n = mentions.groupBy(by, entity).agg(F.count("*").alias("m"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("m"), entity))).where(F.col("k") <= most).select(by, entity)
    bins = mentions.groupBy(by).agg(F.floor((F.max(number) - 1) / size).alias("last")).select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("bin"))
    counts = mentions.groupBy(by, entity, F.floor((F.col(number) - 1) / size).alias("bin")).agg(F.count("*").alias("n"))
    return top.join(bins, by).join(counts, [by, entity, "bin"], "left").select(by, entity, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def review_end(rounds: DataFrame, by: str, number: str, score: str, added: str, least: float, below: int = 3, idle: int = 2) -> DataFrame:
    """(by, stops_at, reason): the first round that ends a review: all scores reached, `below` rounds in a row under the mark, or `idle` rounds that add nothing."""
    w = Window.partitionBy(by).orderBy(number)
    run = lambda hit: F.row_number().over(w) - F.coalesce(F.max(F.when(~hit, F.col("k"))).over(w), F.lit(0))
    numbered = rounds.withColumn("k", F.row_number().over(w))
    marked = numbered.select(by, "k", score, run(F.col(score) < least).alias("low"), run(F.col(added) == 0).alias("idle"))
    reason = ladder((F.col(score) >= least, "reached"), (F.col("low") >= below, "below"), (F.col("idle") >= idle, "idle"))
    ends = marked.select(by, "k", reason.alias("reason")).where("reason is not null")
    return ends.groupBy(by).agg(F.min(F.struct("k", "reason")).alias("e")).select(by, F.col("e.k").cast("long").alias("stops_at"), F.col("e.reason").alias("reason"))


def contract_seeds(seeds: DataFrame, chapters: DataFrame, number: str, tags: str, by: Sequence[str], most: int = 5) -> DataFrame:
    """(by, id, place): seeds (id, is_global, first, last, tags, weight) that bind a chapter: global ones, those in whose range it lies, those that share a tag. A catalogue of checked size, folded inside the row."""
    from storyloom.operators.retrieval import as_array

    applies = lambda s: s["is_global"] | F.col(number).between(s["first"], s["last"]) | F.arrays_overlap(s["tags"], F.col(tags))
    hit = F.transform(F.filter("catalogue", applies), lambda s: F.struct((-s["weight"]).alias("w"), s["id"].alias("id")))
    rows = chapters.join(F.broadcast(as_array(seeds))).select(*by, F.slice(F.array_sort(hit), 1, most).alias("s"))
    return rows.select(*by, F.posexplode("s").alias("p", "x")).select(*by, F.col("x.id").alias("id"), (F.col("p") + 1).cast("long").alias("place"))


def hook_level(value: Column) -> Column:
    """strong, weak or none from a word or a number of ten."""
    number = value.try_cast("double")
    return F.when(number >= 7, "strong").when(number >= 4, "weak").when(number.isNotNull(), "none").when(F.lower(value).isin("strong", "weak", "none"), F.lower(value)).otherwise("none")


def label_scores(rows: DataFrame) -> DataFrame:
    """Classes as numbers, as scores take them: hook 0, 5 or 10, pace 3, 6 or 9, conflict 0, 3, 6 or 9."""
    of = lambda c, table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)]
    return rows.select("*", of("hook", {"none": 0.0, "weak": 5.0, "strong": 10.0}).alias("hook_score"), of("pace", {"slow": 3.0, "medium": 6.0, "fast": 9.0}).alias("pace_score"), of("conflict_level", {"none": 0.0, "low": 3.0, "medium": 6.0, "high": 9.0}).alias("conflict_score"))


def typed(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Text columns as what a schema says; what cannot be read becomes 0, false or the empty text instead of an error."""
    zero = {"long": F.lit(0).cast("long"), "double": F.lit(0.0), "boolean": F.lit(False), "string": F.lit("")}

    def read(name: str, kind: str) -> Column:
        value = F.trim(F.col(name))
        got = value.try_cast("double").cast("long") if kind == "long" else F.lower(value) == "true" if kind == "boolean" else value.try_cast(kind)
        return F.coalesce(got, zero[kind]).alias(name)

    return rows.select(*[read(n, k) for n, k in schema.items()])


def listing(done: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """(key, state): what is analysed, and what of the raw ones is not."""
    return done.select(key).distinct().withColumn("state", F.lit("analysed")).unionByName(raw.select(key).distinct().join(done.select(key).distinct(), key, "left_anti").withColumn("state", F.lit("raw")))


def top_columns(rows: DataFrame, columns: Sequence[str], by: str, k: int = 2) -> DataFrame:
    """(by, tags): the k columns with the largest sums."""
    sums = rows.groupBy(by).agg(*[F.sum(c).alias(c) for c in columns])
    best = F.slice(F.array_sort(F.filter(F.array(*[F.struct((-F.col(c)).alias("m"), F.lit(c).alias("c")) for c in columns]), lambda x: x["m"] < 0)), 1, k)
    return sums.select(by, F.concat_ws(",", F.transform(best, lambda x: x["c"])).alias("tags"))


def overlap_score(ours: DataFrame, theirs: DataFrame, by: str, values: str) -> DataFrame:
    """(by, shared, only_ours, only_theirs, ratio) of two sets of categories."""
    a, b = (d.groupBy(by).agg(F.array_sort(F.collect_set(values)).alias(n)) for d, n in ((ours, "a"), (theirs, "b")))
    met = a.join(b, by)
    list_ = lambda x: F.concat_ws(",", F.array_sort(x))
    return met.select(by, list_(F.array_intersect("a", "b")).alias("shared"), list_(F.array_except("a", "b")).alias("only_ours"), list_(F.array_except("b", "a")).alias("only_theirs"), rounded(F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b")), 3).alias("ratio"))
