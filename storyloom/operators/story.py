"""The story graph and its joins: events, entities, threads, characters, relations, versions.

Events carry a chapter, a kind and an importance; entity_event has a row for each entity of an event. Multi-hop questions are
equi-joins on entities, with chapter distances cut into ranges, and aggregates by entity in place of pairs of events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.columns import ladder, rounded


def latest(rows: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The last row of each key: partial maxima of whole rows, no sort."""
    rest = [c for c in rows.columns if c not in (by, *order)]
    return rows.groupBy(by).agg(F.max(F.struct(*order, *rest)).alias("m")).select(by, "m.*").select(*rows.columns)


def local_context(entity_event: DataFrame, radius: int = 3) -> DataFrame:
    """(chapter_id, event_id): events within `radius` chapters of a chapter, outside it, that share an entity with it. Chapters meet by entity and range of chapters."""
    here = entity_event.select("chapter_id", "entity").distinct().select(F.col("chapter_id").alias("at"), "entity", F.explode(F.sequence(F.floor((F.col("chapter_id") - radius) / (2 * radius + 1)), F.floor((F.col("chapter_id") + radius) / (2 * radius + 1)))).alias("range"))
    there = entity_event.select("entity", "event_id", "chapter_id", F.floor(F.col("chapter_id") / (2 * radius + 1)).alias("range"))
    near = here.join(there, ["entity", "range"]).where((F.abs(F.col("chapter_id") - F.col("at")) <= radius) & (F.col("chapter_id") != F.col("at")))
    return near.select(F.col("at").alias("chapter_id"), "event_id").distinct()


def character_arc(entity_event: DataFrame, entity: str, kinds: Sequence[str], first: int = 0, last: int = 999_999) -> DataFrame:
    return entity_event.where((F.col("entity") == entity) & F.col("chapter_id").between(first, last) & F.col("event_type").isin(list(kinds))).select("event_id", "chapter_id", "event_type", "importance")


def foreshadow_status(events: DataFrame, entity_event: DataFrame, hook: str = "click", least: int = 6) -> DataFrame:
    """(event_id, planted_at, status, resolver_chapter, since): a hook is resolved by the first later event of some importance that shares an entity and points back to it; else it is as old as the latest such candidate."""
    hooks = events.where(F.col("event_type") == hook).select("event_id", F.col("chapter_id").alias("planted_at"))
    weighty = events.where(F.col("importance") >= least)
    pairs = weighty.select(F.col("event_id").alias("by_event"), F.col("chapter_id").alias("at"), F.col("related_id").alias("event_id")).join(hooks, "event_id").where("at > planted_at")
    own, theirs = entity_event.select("event_id", "entity"), entity_event.select(F.col("event_id").alias("by_event"), "entity")
    resolved = pairs.join(own, "event_id").join(theirs, ["by_event", "entity"]).groupBy("event_id").agg(F.min("at").alias("resolver_chapter"))
    reach = entity_event.where(F.col("importance") >= least).groupBy("entity").agg(F.max("chapter_id").alias("reach"))
    last = own.join(hooks, "event_id", "left_semi").join(reach, "entity").groupBy("event_id").agg(F.max("reach").alias("reach"))
    each = hooks.join(resolved, "event_id", "left").join(last, "event_id", "left")
    since = F.coalesce(F.col("resolver_chapter"), F.greatest(F.coalesce("reach", "planted_at"), "planted_at")) - F.col("planted_at")
    return each.select("event_id", "planted_at", F.when(F.col("resolver_chapter").isNotNull(), "resolved").otherwise("active").alias("status"), "resolver_chapter", since.alias("since"))


# States that may follow a state.
TRANSITIONS = {"active": ("dead", "dormant", "active"), "dead": ("dead",), "dormant": ("active", "dead", "dormant"), "unintroduced": ("active", "unintroduced")}


def lifecycle_violations(rows: DataFrame, status: Column, by: str, order: Sequence[str], allowed: dict = TRANSITIONS) -> DataFrame:
    """Rows whose known status may not follow the known status before it; rows of unknown status are passed over."""
    known = rows.select(by, *order, status.alias("status")).where("status is not null")
    before = known.withColumn("before", F.lag("status").over(Window.partitionBy(by).orderBy(*order))).where("before is not null")
    fits = F.lit(False)
    for a, after in allowed.items():
        fits = fits | ((F.col("before") == a) & F.col("status").isin(list(after)))
    return before.where(~fits & ((F.col("before") != F.col("status")) | F.col("before").isin(list(allowed))))


def entities_in(text: Column, names: dict[str, Sequence[str]]) -> Column:
    """The names that a text has, themselves or by an alias."""
    hits = [F.when(_any([F.contains(text, F.lit(x)) for x in (n, *aliases)]), F.lit(n)) for n, aliases in names.items()]
    return F.array_compact(F.array(*hits))


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def cooccurrence(members: DataFrame, group: str, member: str, most: int = 15) -> DataFrame:
    """(a, b, n, strength): the pairs that share most groups. A group's members are put in one row as a set; pairs are made inside it."""
    sets = members.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("s")).where(F.size("s") > 1)
    first = sets.select("s", F.posexplode("s").alias("i", "a"))
    pairs = first.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(most)
    return n.select("a", "b", "n", ladder((F.col("n") > 10, "strong"), (F.col("n") > 3, "medium"), otherwise="weak").alias("strength"))


def matrix(edges: DataFrame, source: str, target: str, value: Column, columns: Sequence[str]) -> DataFrame:
    """A row for each source with a column for each named target."""
    return edges.groupBy(source).pivot(target, list(columns)).agg(value)


def isolated(nodes: DataFrame, edges: DataFrame, key: str, source: str) -> DataFrame:
    """Nodes without an edge that leaves them."""
    return nodes.select(key).distinct().join(edges.select(F.col(source).alias(key)).distinct(), key, "left_anti")


def schedule(states: DataFrame, now: int) -> DataFrame:
    """states: one row a character with weight, lifecycle, last_appearance and cooldown. The rows with chapters since then and the cooldown that is left."""
    since = F.lit(now) - F.col("last_appearance")
    return states.select("*", since.alias("since"), F.greatest(F.lit(0), F.col("cooldown") - since).alias("cooldown_left"))


# Rules of appearance as (rule, severity, predicate).
SCHEDULE_RULES = (
    ("protagonist_absence", "warning", "weight = 'protagonist' AND since > 3"),
    ("major_cooldown", "info", "weight = 'major' AND cooldown > 0 AND since < cooldown"),
    ("supporting_cooldown", "info", "weight = 'supporting' AND cooldown > 0 AND since < cooldown"),
    ("dead_character_appearance", "fail", "lifecycle = 'dead' AND last_appearance > 0 AND since <= 1"),
    ("unintroduced_referenced", "warning", "lifecycle = 'unintroduced' AND last_appearance > 0"),
    ("dormant_reappearance", "warning", "lifecycle = 'dormant' AND since <= 1 AND last_appearance > 0"),
)


def schedule_findings(scheduled: DataFrame, rules: Sequence[tuple[str, str, str]] = SCHEDULE_RULES, by: str = "character") -> DataFrame:
    findings = F.array(*[F.when(F.expr(p), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, p in rules])
    return scheduled.select(by, "since", F.explode(F.array_compact(findings)).alias("f")).select(by, "since", "f.*")


def active(entity_event: DataFrame, now: int, window: int = 10) -> DataFrame:
    """(entity, last_seen, n, kinds) of the last `window` chapters, kinds joined in order of chapters."""
    near = entity_event.where(F.col("chapter_id").between(max(1, now - window), now))
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("chapter_id", "event_id", "event_type"))), lambda x: x["event_type"])
    return near.groupBy("entity").agg(F.max("chapter_id").alias("last_seen"), F.count("*").alias("n"), F.concat_ws(" | ", kinds).alias("kinds"))


def debts(events: DataFrame, opened: Column, closed: Column, by: str, order: str) -> DataFrame:
    """(event id, chapter, status, gap) of each debt: settled by the next closing event of its owner, by a window that looks ahead instead of a join of all later events."""
    ahead = Window.partitionBy(by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    next_close = F.first(F.when(closed, F.col("chapter_id")), ignorenulls=True).over(ahead)
    seen = events.select(by, order, "event_type", "chapter_id", opened.alias("opened"), next_close.alias("resolved_ch"), F.max("chapter_id").over(Window.partitionBy(by)).alias("now"))
    gap = F.coalesce("resolved_ch", "now") - F.col("chapter_id")
    return seen.where("opened").select(by, order, "event_type", "chapter_id", F.when(F.col("resolved_ch").isNotNull(), "resolved").otherwise("pending").alias("status"), gap.alias("gap"))


def debt_board(board: DataFrame, by: str, overdue: int = 10) -> DataFrame:
    return board.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if((F.col("status") == "pending") & (F.col("gap") > overdue)).alias("overdue"), rounded(F.round(F.avg(F.when(F.col("status") == "resolved", F.col("gap"))), 9), 3).alias("mean_gap"))


def changed(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, state): what is new, gone or changed between two versions; equal rows are left out."""
    met = old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), list(keys), "full_outer")
    state = ladder((F.col("old").isNull(), "new"), (F.col("new").isNull(), "gone"), (F.col("old") != F.col("new"), "changed"))
    return met.select(*keys, state.alias("state")).where("state is not null")


def merged_reports(first: DataFrame, second: DataFrame, by: str, order: str, verdict: str = "negative") -> DataFrame:
    """(by, merged): two reviewers' verdicts by category, the later of repeated ones: both negative agree, different ones conflict, else one-sided."""
    a, b = (latest(d.select(by, order, verdict), by, [order]).select(by, F.col(verdict).alias(n)) for d, n in ((first, "a"), (second, "b")))
    c = F.col
    return a.join(b, by, "full_outer").select(by, ladder((c("a").isNull(), "only_second"), (c("b").isNull(), "only_first"), (c("a") & c("b"), "consensus"), (c("a") != c("b"), "conflict"), otherwise="fine").alias("merged"))


def f1(truth: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of two sets of (keys) pairs."""
    met = truth.select(*keys).distinct().withColumn("t", F.lit(1)).join(found.select(*keys).distinct().withColumn("f", F.lit(1)), list(keys), "full_outer")
    n = met.agg(F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", rounded(tp / F.greatest(tp + fp, F.lit(1)), 4).alias("precision"), rounded(tp / F.greatest(tp + fn, F.lit(1)), 4).alias("recall"), rounded(2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1)), 4).alias("f1"))


def best_overlap(parts: DataFrame, wholes: DataFrame, part: str, whole: str, on: Sequence[str]) -> DataFrame:
    """(part, whole, n): for each part the whole with which it shares most keys, the first by name of equal ones."""
    n = parts.select(part, *on).join(wholes.select(whole, *on), list(on)).groupBy(part, whole).agg(F.count("*").alias("n"))
    return n.groupBy(part).agg(F.min_by(F.struct(whole, "n"), F.struct((-F.col("n")).alias("m"), whole)).alias("b")).select(part, "b.*")


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str, q: int = 3) -> DataFrame:
    """(needle, text): all pairs of distinct values of which the text contains the needle; the empty needle is in each text.

    An index of runs of q letters (fewer for shorter needles) stands for a scan of all pairs: a needle meets the texts that have its rarest
    run, and only those are looked at.
    """
    asked, held = needles.select(needle).where(F.col(needle).isNotNull()).distinct(), texts.select(text).where(F.col(text).isNotNull()).distinct()
    grams = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - k + 1), lambda i: F.substring(c, i, k)))
    size = F.least(F.lit(q), F.length(needle))
    own = asked.where(F.length(needle) > 0).select(needle, F.explode(grams(needle, size)).alias("gram"))
    sizes = F.filter(F.sequence(F.lit(1), F.lit(q)), lambda k: k <= F.length(text))
    index = held.select(text, F.explode(F.flatten(F.transform(sizes, lambda k: grams(text, k)))).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a needle with a run that no text has is in none
    rarest = own.join(often, "gram", "left").groupBy(needle).agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    met = rarest.join(index, "gram").where(F.contains(text, needle)).select(needle, text)
    everywhere = asked.where(F.length(needle) == 0).withColumn("#", F.length(needle)).join(held.withColumn("#", F.length(text) * 0), "#").select(needle, text)
    return met.unionByName(everywhere)


def prefix_pairs(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 6, most: int = 8) -> DataFrame:
    """(a, b): all pairs of names of which one contains the beginning of the other."""
    head = lambda rows, c: rows.select(c, F.left(c, F.greatest(F.lit(least), F.least(F.length(c), F.lit(most)))).alias("head")).distinct()
    first, second = head(left, a), head(right, b)
    in_b = first.join(contained(first, right, "head", b), "head").select(a, b)
    in_a = second.join(contained(second, left, "head", a), "head").select(a, b)
    return in_b.union(in_a).distinct()


def prefix_matches(left: DataFrame, right: DataFrame, a: str, b: str, least: int = 6, most: int = 8) -> DataFrame:
    """(a, b): of each name of the left the first by name on the right of which one contains the beginning of the other."""
    return prefix_pairs(left, right, a, b, least, most).groupBy(a).agg(F.min(b).alias(b))


def quality_pool(books: DataFrame, approved: DataFrame, value: str, by: str = "book", least: int = 3) -> DataFrame:
    """One row (pool_mean, n): the books that are approved if there are `least` of them, else all."""
    marked = books.join(approved.select(by).distinct().withColumn("ok", F.lit(1)), by, "left")
    s = marked.agg(F.count_if(F.col("ok").isNotNull()).alias("k"), F.avg(F.when(F.col("ok").isNotNull(), F.col(value))).alias("own"), F.avg(value).alias("all"), F.count("*").alias("n"))
    few = F.col("k") < least
    return s.select(rounded(F.round(F.when(few, F.col("all")).otherwise(F.col("own")), 9), 4).alias("pool_mean"), F.when(few, F.col("n")).otherwise(F.col("k")).alias("n"))


def folded(log: DataFrame, key: str, order: Sequence[str], op: str, cap: int | None = None) -> DataFrame:
    """The state of each key after a log of put, hit, resolve, archive and delete: a deterministic fold, the later row wins. (key, value, hits, status, updated), the `cap` latest if asked for."""
    c = F.col
    facts = log.groupBy(key).agg(
        F.max_by("value", F.when(c(op) == "put", F.struct(*order))).alias("value"),
        F.count_if(c(op) == "hit").alias("hits"),
        F.max(F.when(c(op).isin("put", "resolve", "archive", "delete"), F.struct(*order, op))).alias("last"),
        F.max(F.struct(*order)).alias("touched"),
    )
    status = ladder((c("last")[op] == "put", "open"), (c("last")[op] == "resolve", "resolved"), (c("last")[op] == "archive", "archived"), (c("last")[op] == "delete", "deleted"), otherwise="unknown")
    rows = facts.select(key, "value", "hits", status.alias("status"), c("touched")[order[-1]].alias("updated"))
    return rows if cap is None else rows.where("status <> 'deleted'").orderBy(F.desc("updated")).limit(cap)
