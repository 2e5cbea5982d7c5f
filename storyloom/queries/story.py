"""The story graph over the event table, with SQL of its own."""

from pyspark.sql import functions as F

from storyloom.operators import story as s
from storyloom.plans.registry import Catalog, Tables

query = Catalog()


@query("latest_state", "SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) a WHERE k = 1")
def _(t):
    return s.latest(t.events.select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


CONTEXT = "SELECT DISTINCT a.chapter_id, b.event_id FROM entity_event a JOIN entity_event b ON a.entity = b.entity AND b.chapter_id BETWEEN a.chapter_id - 3 AND a.chapter_id + 3 AND b.chapter_id <> a.chapter_id"


@query("local_context", f"SELECT chapter_id, count(*) AS n_near, min(event_id) AS first_near FROM ({CONTEXT}) c GROUP BY chapter_id")
def _(t):
    return s.local_context(t.entity_event).groupBy("chapter_id").agg(F.count("*").alias("n_near"), F.min("event_id").alias("first_near"))


@query("character_arc", "SELECT event_id, chapter_id, event_type, importance FROM entity_event WHERE entity = 'u7' AND chapter_id BETWEEN 5 AND 200 AND event_type IN ('view', 'click', 'purchase')")
def _(t):
    return s.character_arc(t.entity_event, "u7", ("view", "click", "purchase"), 5, 200)


@query(
    "foreshadow_status",
    """
    WITH h AS (SELECT event_id, chapter_id AS planted_at FROM sag_events WHERE event_type = 'click'),
    cand AS (SELECT DISTINCT h.event_id, h.planted_at, e.event_id AS by_event, e.chapter_id AS at_ch, e.related_id FROM h JOIN entity_event a ON h.event_id = a.event_id JOIN entity_event b ON a.entity = b.entity AND b.importance >= 6 AND b.chapter_id > h.planted_at JOIN sag_events e ON e.event_id = b.event_id),
    f AS (SELECT event_id, min(at_ch) FILTER (WHERE related_id = event_id) AS resolver_chapter, max(at_ch) AS reach FROM cand GROUP BY event_id)
    SELECT h.event_id, h.planted_at, CASE WHEN f.resolver_chapter IS NULL THEN 'active' ELSE 'resolved' END AS status, f.resolver_chapter, coalesce(f.resolver_chapter, f.reach, h.planted_at) - h.planted_at AS since FROM h LEFT JOIN f ON h.event_id = f.event_id""",
)
def _(t):
    return s.foreshadow_status(t.sag_events, t.entity_event)


def status(kind):
    return F.when(kind == "signup", "active").when(kind == "error", "dormant").when(kind == "purchase", "dead")


@query(
    "lifecycle_violations",
    """
    SELECT user_id, ts, event_id, status, before FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'active' WHEN 'error' THEN 'dormant' WHEN 'purchase' THEN 'dead' END AS status FROM events) a WHERE status IS NOT NULL) b
    LEFT JOIN (VALUES ('active', 'dead'), ('active', 'dormant'), ('active', 'active'), ('dead', 'dead'), ('dormant', 'active'), ('dormant', 'dead'), ('dormant', 'dormant')) v(x, y) ON before = x AND status = y
    WHERE before IS NOT NULL AND x IS NULL""",
)
def _(t):
    return s.lifecycle_violations(t.events, status(F.col("event_type")), "user_id", ["ts", "event_id"])


NAMES = {"Thth": ("Anth",), "Inth": (), "Erth": ("Onth",), "Ouen": ("Hein", "Les "), "Ander": ()}


@query("entity_extraction", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(text, {chr(39)}{x}{chr(39)})' for x in (n, *a))} THEN '{n}' END" for n, a in NAMES.items()) + ") AS names FROM documents WHERE text IS NOT NULL")
def _(t):
    return t.documents.where("text is not null").select("doc_id", F.concat_ws(",", s.entities_in(F.col("text"), NAMES)).alias("names"))


COOC = "SELECT DISTINCT chapter_id, entity FROM entity_event WHERE chapter_id <= 50"


@query("cooccurrence", f"SELECT a.entity AS a, b.entity AS b, count(*) AS n, CASE WHEN count(*) > 10 THEN 'strong' WHEN count(*) > 3 THEN 'medium' ELSE 'weak' END AS strength FROM ({COOC}) a JOIN ({COOC}) b ON a.chapter_id = b.chapter_id AND a.entity < b.entity GROUP BY a.entity, b.entity ORDER BY count(*) DESC, a.entity, b.entity LIMIT 15")
def _(t):
    return s.cooccurrence(t.entity_event.where("chapter_id <= 50"), "chapter_id", "entity")


@query("type_cooccurrence", "SELECT a.event_type AS a, b.event_type AS b, count(*) AS n, CASE WHEN count(*) > 10 THEN 'strong' WHEN count(*) > 3 THEN 'medium' ELSE 'weak' END AS strength FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY a.event_type, b.event_type")
def _(t):
    return s.cooccurrence(t.events, "user_id", "event_type")


@query("relationship_matrix", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("view", "click", "purchase")) + " FROM events GROUP BY user_id")
def _(t):
    return s.matrix(t.events, "user_id", "event_type", F.count(F.lit(1)), ("view", "click", "purchase")).na.fill(0)


@query("speaker_matrix", "SELECT conv_id, " + ", ".join(f"coalesce(CAST(sum(length(text)) FILTER (WHERE role = '{k}') AS BIGINT), 0) AS {k}" for k in ("user", "assistant", "system")) + " FROM conversations GROUP BY conv_id")
def _(t):
    return s.matrix(t.conversations, "conv_id", "role", F.sum(F.length("text")), ("user", "assistant", "system")).na.fill(0)


@query("isolated_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 200000)")
def _(t):
    return s.isolated(t.customer, t.orders.where("o_totalprice > 200000"), "c_custkey", "o_custkey")


@query("unlabelled_documents", "SELECT x.doc_id FROM documents x LEFT JOIN labels l ON x.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def _(t):
    return s.isolated(t.documents, t.labels, "doc_id", "doc_id")


def states(t: Tables):
    """Characters as users: weight and cooldown by their number, lifecycle and last chapter by their last event."""
    last = s.latest(t.sag_events.select("user_id", "event_id", "chapter_id", "event_type"), "user_id", ["event_id"])
    weight = F.element_at(F.array(*[F.lit(x) for x in ("protagonist", "major", "supporting", "cameo")]), (F.col("user_id") % 4 + 1).cast("int"))
    return last.select(F.col("user_id").alias("character"), weight.alias("weight"), F.coalesce(status(F.col("event_type")), F.lit("unintroduced")).alias("lifecycle"), F.col("chapter_id").alias("last_appearance"), (F.col("user_id") % 7).alias("cooldown"))


STATES = """
    SELECT user_id AS character, ['protagonist', 'major', 'supporting', 'cameo'][user_id % 4 + 1] AS weight, CASE event_type WHEN 'signup' THEN 'active' WHEN 'error' THEN 'dormant' WHEN 'purchase' THEN 'dead' ELSE 'unintroduced' END AS lifecycle, chapter_id AS last_appearance, user_id % 7 AS cooldown
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rk FROM sag_events) a WHERE rk = 1"""
NOW = 250


@query("character_schedule", f"SELECT *, {NOW} - last_appearance AS since, greatest(0, cooldown - ({NOW} - last_appearance)) AS cooldown_left FROM ({STATES}) x")
def _(t):
    return s.schedule(states(t), NOW)


@query("schedule_check", " UNION ALL ".join(f"SELECT character, since, '{r}' AS rule, '{v}' AS severity FROM z WHERE {p}" for r, v, p in s.SCHEDULE_RULES).join([f"WITH z AS (SELECT *, {NOW} - last_appearance AS since FROM ({STATES}) x) ", ""]))
def _(t):
    return s.schedule_findings(s.schedule(states(t), NOW))


@query("active_entities", "SELECT entity, max(chapter_id) AS last_seen, count(*) AS n, string_agg(event_type, ' | ' ORDER BY chapter_id, event_id, event_type) AS kinds FROM entity_event WHERE chapter_id BETWEEN 90 AND 100 GROUP BY entity")
def _(t):
    return s.active(t.entity_event, 100)


@query("entity_mentions", "SELECT entity, count(*) AS mentions, min(chapter_id) AS first_ch, max(chapter_id) AS last_ch, count(DISTINCT event_type) AS kinds FROM entity_event GROUP BY entity")
def _(t):
    return t.entity_event.groupBy("entity").agg(F.count("*").alias("mentions"), F.min("chapter_id").alias("first_ch"), F.max("chapter_id").alias("last_ch"), F.count_distinct("event_type").alias("kinds"))


@query("story_stats", "SELECT event_type, count(*) AS n, min(chapter_id) AS first_ch, max(chapter_id) AS last_ch, count(DISTINCT user_id) AS n_entities, round(round(avg(importance), 9), 4) AS mean_importance FROM sag_events GROUP BY event_type")
def _(t):
    return t.sag_events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("chapter_id").alias("first_ch"), F.max("chapter_id").alias("last_ch"), F.count_distinct("user_id").alias("n_entities"), s.rounded(F.round(F.avg("importance"), 9), 4).alias("mean_importance"))


@query("unresolved_events", "SELECT e.event_id, e.chapter_id, e.user_id FROM sag_events e WHERE e.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM sag_events r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND r.event_id > e.event_id)")
def _(t):
    board = s.debts(t.sag_events, F.col("event_type") == "click", F.col("event_type") == "purchase", "user_id", "event_id")
    return board.where("status = 'pending'").select("event_id", "chapter_id", "user_id")


DEBTS = """
    SELECT o.user_id, o.event_id, o.event_type, o.chapter_id, CASE WHEN o.closed IS NULL THEN 'pending' ELSE 'resolved' END AS status, coalesce(c.chapter_id, o.now) - o.chapter_id AS gap FROM (
      SELECT e.*, max(chapter_id) OVER (PARTITION BY user_id) AS now, (SELECT min(p.event_id) FROM sag_events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.event_id > e.event_id) AS closed FROM sag_events e) o
    LEFT JOIN sag_events c ON o.closed = c.event_id WHERE o.event_type IN ('click', 'error')"""


@query("debt_board", f"SELECT event_type, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'pending' AND gap > 10) AS overdue, round(round(avg(gap) FILTER (WHERE status = 'resolved'), 9), 3) AS mean_gap FROM ({DEBTS}) d GROUP BY event_type")
def _(t):
    return s.debt_board(s.debts(t.sag_events, F.col("event_type").isin("click", "error"), F.col("event_type") == "purchase", "user_id", "event_id"), "event_type")


@query(
    "changed_chapters",
    """
    SELECT book, ch_num, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'gone' ELSE 'changed' END AS state FROM (
      SELECT coalesce(a.book, b.book) AS book, coalesce(a.ch_num, b.ch_num) AS ch_num, a.h AS old, b.h AS new
      FROM (SELECT m.book, m.ch_num, substr(sha256(CASE WHEN m.doc_id % 7 = 0 THEN substr(coalesce(d.text, ''), 2) ELSE coalesce(d.text, '') END), 1, 16) AS h FROM metrics m JOIN documents d ON m.doc_id = d.doc_id WHERE m.ch_num > 3) a
      FULL OUTER JOIN (SELECT book, ch_num, ch_hash AS h FROM metrics WHERE ch_num < 40) b ON a.book = b.book AND a.ch_num = b.ch_num) z
    WHERE old IS NULL OR new IS NULL OR old <> new""",
)
def _(t):
    text = F.coalesce("text", F.lit(""))
    earlier = t.documents.select("doc_id", F.substring(F.sha2(F.when(F.col("doc_id") % 7 == 0, F.expr("substr(coalesce(text, ''), 2)")).otherwise(text), 256), 1, 16).alias("ch_hash")).join(t.chapters, "doc_id").where("ch_num > 3")
    return s.changed(earlier, t.metrics.where("ch_num < 40"), ("book", "ch_num"), "ch_hash")


@query(
    "report_merge",
    """
    WITH a AS (SELECT user_id, arg_max(value < 30, event_id) AS v FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 <> 0 GROUP BY user_id), b AS (SELECT user_id, arg_max(value < 50, event_id) AS v FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0 GROUP BY user_id)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.v IS NULL THEN 'only_second' WHEN b.v IS NULL THEN 'only_first' WHEN a.v AND b.v THEN 'consensus' WHEN a.v <> b.v THEN 'conflict' ELSE 'fine' END AS merged FROM a FULL OUTER JOIN b ON a.user_id = b.user_id""",
)
def _(t):
    first = t.events.where("event_type in ('click', 'view') and user_id % 3 <> 0").withColumn("negative", F.col("value") < 30)
    second = t.events.where("event_type = 'purchase' and user_id % 5 <> 0").withColumn("negative", F.col("value") < 50)
    return s.merged_reports(first, second, "user_id", "event_id")


@query(
    "label_f1",
    """
    WITH t AS (SELECT doc_id FROM labels WHERE quality = 1), f AS (SELECT m.doc_id FROM metrics m JOIN labels l ON m.doc_id = l.doc_id WHERE m.pleasure_intensity >= 4)
    SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1), 4) AS precision, round(tp / greatest(tp + fn, 1), 4) AS recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 4) AS f1
    FROM (SELECT (SELECT count(*) FROM t WHERE doc_id IN (SELECT * FROM f)) AS tp, (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT * FROM t)) AS fp, (SELECT count(*) FROM t WHERE doc_id NOT IN (SELECT * FROM f)) AS fn) z""",
)
def _(t):
    found = t.metrics.join(t.labels, "doc_id", "left_semi").where("pleasure_intensity >= 4")
    return s.f1(t.labels.where("quality = 1"), found, ["doc_id"])


@query("label_join", "SELECT m.book, m.ch_num, m.pleasure_intensity, l.quality, l.toxic FROM metrics m LEFT JOIN labels l ON m.doc_id = l.doc_id")
def _(t):
    return t.metrics.join(t.labels, "doc_id", "left").select("book", "ch_num", "pleasure_intensity", "quality", "toxic")


@query(
    "book_by_overlap",
    "SELECT lang, book, n FROM (SELECT d.lang, c.book, count(*) AS n, row_number() OVER (PARTITION BY d.lang ORDER BY count(*) DESC, c.book) AS k FROM documents d JOIN chapters c ON d.doc_id = c.doc_id WHERE d.lang IS NOT NULL AND c.ch_num <= 5 GROUP BY d.lang, c.book) z WHERE k = 1",
)
def _(t):
    return s.best_overlap(t.documents.where("lang is not null"), t.chapters.where("ch_num <= 5"), "lang", "book", ["doc_id"])


@query("prefix_matches", "SELECT n_name, min(other) AS other FROM nation JOIN (SELECT 'THE ' || n_name || ' PRESS' AS other FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name FROM region) o ON contains(other, left(n_name, greatest(6, least(length(n_name), 8)))) OR contains(n_name, left(other, greatest(6, least(length(other), 8)))) GROUP BY n_name")
def _(t):
    other = t.nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("THE "), "n_name", F.lit(" PRESS")).alias("other")).union(t.region.select("r_name"))
    return s.prefix_matches(t.nation.select("n_name"), other, "n_name", "other")


FIRST = "left(split_part(text, chr(10), 1), 40)"
HEAD = "left({0}, greatest(6, least(length({0}), 8)))"


@query("prefix_pairs", f"WITH x AS (SELECT DISTINCT {FIRST} AS name FROM documents WHERE text IS NOT NULL) SELECT p.name, count(*) AS n, max(q.name) AS last FROM x p JOIN x q ON contains(q.name, {HEAD.format('p.name')}) OR contains(p.name, {HEAD.format('q.name')}) GROUP BY p.name")
def _(t):
    """First lines of documents as names: how many others each meets."""
    names = t.documents.where("text is not null").select(F.left(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(40)).alias("name")).distinct()
    return s.prefix_pairs(names, names.withColumnRenamed("name", "other"), "name", "other").groupBy("name").agg(F.count("*").alias("n"), F.max("other").alias("last"))


@query(
    "quality_pool",
    """
    WITH v AS (SELECT book, round(avg(pleasure_intensity), 6) AS v FROM metrics GROUP BY book), g AS (SELECT c.source AS book FROM documents c JOIN labels l ON c.doc_id = l.doc_id GROUP BY c.source HAVING avg(l.quality) >= 0.75), s AS (SELECT (SELECT count(*) FROM v WHERE book IN (SELECT book FROM g)) AS k)
    SELECT round(round(CASE WHEN k < 3 THEN (SELECT avg(v) FROM v) ELSE (SELECT avg(v) FROM v WHERE book IN (SELECT book FROM g)) END, 9), 4) AS pool_mean, CASE WHEN k < 3 THEN (SELECT count(*) FROM v) ELSE k END AS n FROM s""",
)
def _(t):
    approved = t.documents.join(t.labels, "doc_id").groupBy(F.col("source").alias("book")).agg(F.avg("quality").alias("q")).where("q >= 0.75")
    return s.quality_pool(t.metrics.groupBy("book").agg(F.round(F.avg("pleasure_intensity"), 6).alias("v")), approved, "v")


LOG_OPS = {"signup": "put", "view": "hit", "click": "resolve", "error": "archive", "purchase": "put"}
LOG = "SELECT user_id, event_id, value, CASE event_type WHEN 'signup' THEN 'put' WHEN 'view' THEN 'hit' WHEN 'click' THEN 'resolve' WHEN 'error' THEN 'archive' ELSE 'put' END AS op FROM events"


@query(
    "state_fold",
    f"""
    SELECT user_id, (SELECT p.value FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM ({LOG}) l WHERE op = 'put') p WHERE p.user_id = z.user_id AND p.k = 1) AS value, hits, CASE last WHEN 'put' THEN 'open' WHEN 'resolve' THEN 'resolved' WHEN 'archive' THEN 'archived' ELSE 'unknown' END AS status, updated
    FROM (SELECT user_id, count(*) FILTER (WHERE op = 'hit') AS hits, arg_max(op, event_id) FILTER (WHERE op <> 'hit') AS last, max(event_id) AS updated FROM ({LOG}) l GROUP BY user_id) z""",
)
def _(t):
    kinds = F.create_map(*[F.lit(x) for pair in LOG_OPS.items() for x in pair])
    return s.folded(t.events.select("user_id", "event_id", "value", kinds[F.col("event_type")].alias("op")), "user_id", ["event_id"], "op")


@query("distinct_states", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@query("character_timeline", "SELECT event_id, ts, event_type, value FROM events WHERE user_id = 12")
def _(t):
    return t.events.where("user_id = 12").select("event_id", "ts", "event_type", "value")
