"""Records of work over the given tables, with SQL of their own."""

from pyspark.sql import functions as F

from storyloom.operators import records as r
from storyloom.operators import scoring as sc
from storyloom.operators.projection import rich_scan
from storyloom.operators.scoring import mean9, rounded
from storyloom.plans.registry import Catalog
from storyloom.queries.scoring import AUDIT, COMMERCIAL, LABELS, LONG, SCORED, STATS, commercial, labels
from storyloom.queries.text import SCAN

query = Catalog()


@query("label_consistency", "SELECT a.user_id, a.n, a.median, b.mode FROM (SELECT user_id, count(*) AS n, quantile_cont(value, 0.5) AS median FROM events GROUP BY user_id) a JOIN (SELECT user_id, event_type AS mode FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) x WHERE k = 1) b ON a.user_id = b.user_id")
def _(t):
    return r.consistency(t.events, "user_id", "value", "event_type")


@query("style_drift", "SELECT book, round(mean, 4) AS mean, round(std, 4) AS std, round(recent, 4) AS recent, abs(recent - mean) > round(0.3e0 * abs(mean), 9) AS drifts FROM (SELECT book, round(avg(hook_density), 9) AS mean, round(stddev_samp(hook_density), 9) AS std, round(avg(hook_density) FILTER (WHERE back <= 5), 9) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ch_num DESC) AS back FROM metrics) a GROUP BY book) b")
def _(t):
    return r.drift(t.metrics, "hook_density", "book", "ch_num")


@query("decision_signals", "SELECT user_id, CAST(sum(n) AS BIGINT) AS n, round(sum(s) / sum(n), 4) AS skip_rate, string_agg(event_type, ',' ORDER BY k) FILTER (WHERE k <= 3) AS top FROM (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value < 20) AS s, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY user_id, event_type) a GROUP BY user_id")
def _(t):
    return r.decision_signals(t.events, "user_id", "event_type", F.col("value") < 20)


@query("decision_preferences", "SELECT k, event_type, round(n / t, 4) AS share FROM (SELECT k, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY k) AS t, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, event_type) AS p FROM sag_events GROUP BY k, event_type) a WHERE p = 1")
def _(t):
    return r.preferences(t.sag_events, "k", "event_type")


@query("profile_maturity", "SELECT user_id, n, CASE WHEN n >= 50 THEN 'mature' WHEN n >= 30 THEN 'stable' WHEN n >= 10 THEN 'forming' WHEN n >= 3 THEN 'early' ELSE 'new' END AS maturity FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) a")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("maturity", r.maturity(F.col("n")))


@query("label_progress", "SELECT *, round(round(100 * done / total, 9), 1) AS pct, CASE WHEN done = 0 THEN 'waiting' WHEN done = total THEN 'complete' ELSE 'running' END AS state FROM (SELECT d.source, count(*) AS total, count(l.doc_id) AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY d.source) a")
def _(t):
    return r.progress(t.documents, t.labels, "doc_id", "source")


@query("score_table", "SELECT book, round(rule, 3) AS rule, round(reader, 3) AS reader, round(round(greatest(rule, reader) - least(rule, reader), 9), 3) AS gap FROM (SELECT book, round(avg(score) FILTER (WHERE model = 'rule'), 9) AS rule, round(avg(score) FILTER (WHERE model = 'reader'), 9) AS reader FROM (SELECT book, 'rule' AS model, pleasure_intensity AS score FROM metrics UNION ALL SELECT book, 'reader', intensity FROM (" + LABELS + ") l) a GROUP BY book) b")
def _(t):
    logs = t.metrics.select("book", F.lit("rule").alias("model"), F.col("pleasure_intensity").alias("score")).unionByName(labels(t).select("book", F.lit("reader").alias("model"), F.col("intensity").alias("score")))
    return r.score_table(logs, "book", "model", "score", ("rule", "reader"))


@query(
    "genre_profile",
    """
    WITH z AS (SELECT m.*, d.lang AS genre FROM metrics m JOIN documents d ON m.doc_id = d.doc_id WHERE d.lang IS NOT NULL)
    SELECT a.*, b.top_subs FROM (SELECT genre, count(*) AS n, CAST(sum(wc) AS BIGINT) AS wc, round(round(avg(hook_density), 9), 3) AS hook, round(round(avg(CASE WHEN conflict THEN 1e0 ELSE 0e0 END), 9), 3) AS conflict_rate, CAST(sum(slap_count) AS BIGINT) AS slaps FROM z GROUP BY genre) a
    JOIN (SELECT genre, string_agg(dominant_sub, ',' ORDER BY k) AS top_subs FROM (SELECT genre, dominant_sub, row_number() OVER (PARTITION BY genre ORDER BY count(*) DESC, dominant_sub) AS k FROM z GROUP BY genre, dominant_sub) x WHERE k <= 3 GROUP BY genre) b ON a.genre = b.genre""",
)
def _(t):
    return r.genre_profile(t.metrics.join(t.documents.select("doc_id", F.col("lang").alias("genre")), "doc_id").where("genre is not null"), "genre")


@query("extreme_books", f"SELECT book, overall, 'top' AS side FROM (SELECT book, overall, row_number() OVER (ORDER BY overall, book) AS k FROM ({COMMERCIAL}) c) a WHERE k <= 3 UNION ALL SELECT book, overall, 'bottom' FROM (SELECT book, overall, row_number() OVER (ORDER BY overall DESC, book DESC) AS k FROM ({COMMERCIAL}) c) b WHERE k <= 3")
def _(t):
    return r.extremes(commercial(t), "overall", "book")


DIMS3 = ("hook_density", "conflict_density", "readability")


@query("author_feedback", "WITH b AS (SELECT book, " + ", ".join(f"round(avg({d}), 9) AS {d}" for d in DIMS3) + " FROM metrics GROUP BY book), m AS (SELECT " + ", ".join(f"round(avg({d}), 9) AS m_{d}" for d in DIMS3) + " FROM b WHERE hook_density > 2) " + " UNION ALL ".join(f"SELECT book, '{d}' AS dim, {d} AS value, round(round({d} - m_{d}, 9), 4) AS gap, CASE WHEN round({d} - m_{d}, 9) < round(-0.2e0 * abs(m_{d}), 9) THEN 'raise' WHEN round({d} - m_{d}, 9) > round(0.2e0 * abs(m_{d}), 9) THEN 'lower' ELSE 'keep' END AS advice FROM b CROSS JOIN m" for d in DIMS3))
def _(t):
    books = t.metrics.groupBy("book").agg(*[mean9(d).alias(d) for d in DIMS3])
    return r.feedback(books, books.where("hook_density > 2"), DIMS3, "book")


SCANNED = ("hook_density", "conflict_density", "pleasure_intensity")
CHAPTER_SCORES = SCORED.replace(f"({LONG})", "(" + " UNION ALL ".join(f"SELECT doc_id AS book, '{x}' AS dim, {x} AS value FROM scan" for x in SCANNED) + ")", 1)


@query(
    "author_chapters",
    f"""
    WITH scan AS MATERIALIZED ({SCAN}), z AS ({CHAPTER_SCORES})
    SELECT book AS doc_id, dim, value, gap, score, rank, weak, round(round(sum(score * weight) OVER (PARTITION BY book) / sum(weight) OVER (PARTITION BY book) / 25 * 100, 9), 1) AS probability FROM z""",
)
def _(t):
    """Every chapter by itself, scanned and held against the benchmark of all books: its scores, gaps and weak places, and its probability."""
    scan = rich_scan(t.spread("documents")).select("doc_id", *SCANNED)
    dims = {x: sc.DIMS[x] for x in SCANNED}
    scored = sc.scored_dims(scan.unpivot(["doc_id"], list(dims), "dim", "value"), sc.benchmark(sc.book_dims(t.metrics)), dims, "doc_id")
    return scored.join(sc.signing_probability(scored, "doc_id").select("doc_id", "probability"), "doc_id").select("doc_id", "dim", "value", "gap", "score", "rank", F.col("weak").alias("weak"), "probability")


@query("rhythm_targets", "SELECT m.book, ch_num, CAST(ceil(round(h * wc / 1000e0, 6)) AS BIGINT) AS n_hook, CAST(ceil(round(c * wc / 100e0, 6)) AS BIGINT) AS n_conflict FROM metrics m JOIN (SELECT book, round(avg(hook_density), 9) AS h, round(avg(conflict_density), 9) AS c FROM metrics GROUP BY book) p ON m.book = p.book")
def _(t):
    """The book's own densities are its plan; a chapter's targets follow from its length."""
    plan = t.metrics.groupBy("book").agg(mean9("hook_density").alias("hook"), mean9("conflict_density").alias("conflict"))
    return r.chapter_targets(t.metrics.select("book", "ch_num", "wc"), plan, "book", "wc")


@query(
    "plan_validation",
    """
    SELECT a.book, flat_run, round(m, 3) AS met_share, round(e, 3) AS empty_share, flat_run < 3 AND m >= 0.8 AND e <= 0.5 AS passed FROM (SELECT book, round(avg(CASE WHEN hook_density >= 1 THEN 1e0 ELSE 0e0 END), 9) AS m, round(avg(CASE WHEN wc < 300 THEN 1e0 ELSE 0e0 END), 9) AS e FROM metrics GROUP BY book) a
    JOIN (SELECT book, max(run) AS flat_run FROM (SELECT book, conflict_level, i, count(*) AS run FROM (SELECT book, conflict_level, row_number() OVER (PARTITION BY book ORDER BY ch_num) - row_number() OVER (PARTITION BY book, conflict_level ORDER BY ch_num) AS i FROM metrics) x GROUP BY book, conflict_level, i) y GROUP BY book) b ON a.book = b.book""",
)
def _(t):
    return r.plan_validation(t.metrics, "conflict_level", F.col("hook_density") >= 1, F.col("wc") < 300, "book", "ch_num")


@query("length_classes", "SELECT book, round(c, 4) AS cv, CASE WHEN c < 0.15 THEN 'even' WHEN c < 0.3 THEN 'varied' ELSE 'wild' END AS class FROM (SELECT book, round(stddev_pop(wc) / avg(wc), 9) AS c FROM metrics GROUP BY book) a")
def _(t):
    return r.length_classes(t.metrics, "book")


@query(
    "arc_bins",
    """
    WITH m AS (SELECT source AS book, c.ch_num, lang FROM documents d JOIN chapters c ON d.doc_id = c.doc_id WHERE lang IS NOT NULL), t AS (SELECT book, lang FROM (SELECT book, lang, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, lang) AS k FROM m GROUP BY book, lang) x WHERE k <= 2),
    b AS (SELECT book, unnest(generate_series(0, CAST(floor((max(ch_num) - 1) / 5) AS BIGINT))) AS bin FROM m GROUP BY book)
    SELECT t.book, t.lang, b.bin, count(m.lang) AS n FROM t JOIN b ON t.book = b.book LEFT JOIN m ON m.book = t.book AND m.lang = t.lang AND floor((m.ch_num - 1) / 5) = b.bin GROUP BY t.book, t.lang, b.bin""",
)
def _(t):
    mentions = t.chapters.join(t.documents.select("doc_id", "lang"), "doc_id").where("lang is not null")
    return r.arc_bins(mentions, "book", "lang", "ch_num", 5, 2)


@query(
    "review_end",
    """
    WITH n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, length(text) % 10 AS s, length(text) % 3 AS a FROM conversations WHERE text IS NOT NULL),
    m AS (SELECT *, k - coalesce(max(CASE WHEN s >= 9 THEN k END) OVER w, 0) AS low, k - coalesce(max(CASE WHEN a <> 0 THEN k END) OVER w, 0) AS idle FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY k))
    SELECT conv_id, k AS stops_at, reason FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS p FROM (SELECT conv_id, k, CASE WHEN s >= 9 THEN 'reached' WHEN low >= 3 THEN 'below' WHEN idle >= 2 THEN 'idle' END AS reason FROM m) x WHERE reason IS NOT NULL) y WHERE p = 1""",
)
def _(t):
    rounds = t.conversations.where("text is not null").select("conv_id", "turn", (F.length("text") % 10).alias("s"), (F.length("text") % 3).alias("a"))
    return r.review_end(rounds, "conv_id", "turn", "s", "a", 9)


@query(
    "contract_seeds",
    """
    WITH s AS (SELECT item_id AS id, item_id % 11 = 0 AS g, item_id AS a, item_id + 2 AS b, [['slap', 'fast'], ['slow'], ['hidden']][item_id % 3 + 1] AS tags, item_id % 5 AS w FROM benchmark)
    SELECT book, ch_num, id, place FROM (SELECT m.book, m.ch_num, s.id, row_number() OVER (PARTITION BY m.book, m.ch_num ORDER BY s.w DESC, s.id) AS place FROM metrics m JOIN s ON s.g OR m.ch_num BETWEEN s.a AND s.b OR len(list_intersect(s.tags, [m.dominant_sub, m.pace])) > 0) z WHERE place <= 5""",
)
def _(t):
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    seeds = t.benchmark.select(F.col("item_id").alias("id"), (F.col("item_id") % 11 == 0).alias("is_global"), F.col("item_id").alias("first"), (F.col("item_id") + 2).alias("last"), F.element_at(F.array(lit("slap", "fast"), lit("slow"), lit("hidden")), (F.col("item_id") % 3 + 1).cast("int")).alias("tags"), (F.col("item_id") % 5).alias("weight"))
    return r.contract_seeds(seeds, t.metrics.withColumn("t", F.array("dominant_sub", "pace")), "ch_num", "t", ["book", "ch_num"])


@query("label_scores", "SELECT book, ch_num, CASE hook WHEN 'none' THEN 0e0 WHEN 'weak' THEN 5e0 ELSE 10e0 END AS hook_score, CASE pace WHEN 'slow' THEN 3e0 WHEN 'medium' THEN 6e0 ELSE 9e0 END AS pace_score, CASE conflict_level WHEN 'none' THEN 0e0 WHEN 'low' THEN 3e0 WHEN 'medium' THEN 6e0 ELSE 9e0 END AS conflict_score FROM (SELECT book, ch_num, pace, conflict_level, CASE WHEN hook_density >= 7 THEN 'strong' WHEN hook_density >= 4 THEN 'weak' ELSE 'none' END AS hook FROM metrics) a")
def _(t):
    return r.label_scores(t.metrics.withColumn("hook", r.hook_level(F.col("hook_density").cast("string")))).select("book", "ch_num", "hook_score", "pace_score", "conflict_score")


@query("lenient_rows", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END AS user_id, CASE WHEN event_id % 5 = 0 THEN 0e0 ELSE value END AS value, event_type = 'error' AS flag FROM events")
def _(t):
    """Rows as text, some of them spoilt, read back by a schema."""
    raw = t.events.select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.concat("user_id", F.lit(".0"))).alias("user_id"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("value").cast("string")).alias("value"), F.when(F.col("event_type") == "error", "True").otherwise("no").alias("flag"))
    return r.typed(raw, {"event_id": "long", "user_id": "long", "value": "double", "flag": "boolean"})


@query("event_properties", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("book_listing", "SELECT source, CASE WHEN source IN (SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1) THEN 'analysed' ELSE 'raw' END AS state FROM (SELECT DISTINCT source FROM documents) a")
def _(t):
    return r.listing(t.documents.join(t.labels.where("toxic = 1"), "doc_id"), t.documents, "source")


COUNTS = ("slap_count", "level_count", "crush_count", "bond_count", "social_count")


@query("book_top_columns", "SELECT book, string_agg(c, ',' ORDER BY k) AS tags FROM (SELECT book, c, row_number() OVER (PARTITION BY book ORDER BY v DESC, c) AS k FROM (" + " UNION ALL ".join(f"SELECT book, '{c}' AS c, sum({c}) AS v FROM metrics GROUP BY book" for c in COUNTS) + ") a WHERE v > 0) b WHERE k <= 2 GROUP BY book")
def _(t):
    return r.top_columns(t.metrics, COUNTS, "book")


@query("structure_overlap", """
    SELECT book, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_ours, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS only_theirs, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 3) AS ratio
    FROM (SELECT book, list_distinct(list(dominant_sub) FILTER (WHERE ch_num % 2 = 0)) AS a, list_distinct(list(dominant_sub) FILTER (WHERE ch_num % 2 = 1)) AS b FROM metrics GROUP BY book HAVING count(*) FILTER (WHERE ch_num % 2 = 0) > 0) x""")
def _(t):
    return r.overlap_score(t.metrics.where("ch_num % 2 = 0"), t.metrics.where("ch_num % 2 = 1"), "book", "dominant_sub")


@query("manifest", f"SELECT s.book, s.total_ch, c.overall, CASE WHEN s.total_ch >= 50 THEN 'high' WHEN s.total_ch >= 30 THEN 'medium' ELSE 'low' END AS confidence FROM ({STATS}) s LEFT JOIN ({COMMERCIAL}) c ON s.book = c.book")
def _(t):
    n = F.col("total_ch")
    return sc.rhythm_stats(t.metrics).join(commercial(t).select("book", "overall"), "book", "left").select("book", "total_ch", "overall", F.when(n >= 50, "high").when(n >= 30, "medium").otherwise("low").alias("confidence"))


@query("audit_counts", f"SELECT status, count(*) AS n, CAST(sum(fails) AS BIGINT) AS fails, round(100e0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM ({AUDIT}) a GROUP BY status")
def _(t):
    """How many books the audit of rhythm passes, warns of or fails."""
    from pyspark.sql import Window

    n = sc.rhythm_audit(t.metrics).groupBy("status").agg(F.count("*").alias("n"), F.sum("fails").alias("fails"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


@query("pattern_scores", f"SELECT m.dominant_sub, count(*) AS n, round(round(avg(l.retention), 9), 3) AS retention FROM metrics m JOIN ({LABELS}) l ON m.book = l.book AND m.ch_num = l.ch_num GROUP BY m.dominant_sub")
def _(t):
    return t.metrics.join(labels(t), ["book", "ch_num"]).groupBy("dominant_sub").agg(F.count("*").alias("n"), rounded(mean9("retention"), 3).alias("retention"))


@query("kl_uniform", "SELECT book, round(round(sum(greatest(p, 0.001e0) * ln(greatest(p, 0.001e0) * k)), 9), 4) AS kl FROM (SELECT book, n / CAST(sum(n) OVER (PARTITION BY book) AS DOUBLE) AS p, CAST(count(*) OVER (PARTITION BY book) AS DOUBLE) AS k FROM (SELECT book, emotion, count(*) AS n FROM metrics GROUP BY book, emotion) a) b GROUP BY book")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("book")
    n = t.metrics.groupBy("book", "emotion").agg(F.count("*").alias("n"))
    p = F.greatest(F.col("n") / F.sum("n").over(w), F.lit(0.001))
    return n.select("book", (p * F.log(p * F.count("*").over(w))).alias("x")).groupBy("book").agg(rounded(F.round(F.sum("x"), 9), 4).alias("kl"))


MEAN2 = "SELECT book, round(avg(pleasure_intensity), 6) AS a, round(avg(hook_density), 6) AS b FROM metrics GROUP BY book"


@query("spearman", f"SELECT round(round(1 - 6 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1e0)), 9), 3) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2e0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2e0 AS rb FROM ({MEAN2}) y) z")
def _(t):
    """Rank correlation with mean ranks of ties; a row a book."""
    from pyspark.sql import Window

    books = t.metrics.groupBy("book").agg(F.round(F.avg("pleasure_intensity"), 6).alias("a"), F.round(F.avg("hook_density"), 6).alias("b"))
    rank = lambda x: F.rank().over(Window.orderBy(x)) + (F.count("*").over(Window.partitionBy(x)) - 1) / 2.0
    d = books.select((rank("a") - rank("b")).alias("d")).agg(F.sum(F.col("d") * F.col("d")).alias("s"), F.count("*").alias("n"))
    return d.select(rounded(F.round(1 - 6 * F.col("s") / (F.col("n") * (F.col("n") * F.col("n") - 1)), 9), 3).alias("rho"))


SIGN, RETAIN = (0.4, 0.45, 0.5, 0.55, 0.6), (0.2, 0.25, 0.3, 0.35, 0.4)
GRID = ", ".join(f"({a}e0, {b}e0, {c}e0)" for a, b, c in r.weight_grid(SIGN, RETAIN))
LETTER = "CASE WHEN {0} >= 80 THEN 'S+' WHEN {0} >= 70 THEN 'A' WHEN {0} >= 60 THEN 'B' WHEN {0} >= 50 THEN 'C' ELSE 'D' END"


@query(
    "weight_sensitivity",
    f"""
    WITH c AS (SELECT book, signing, retention, overall, retention AS bonus FROM ({COMMERCIAL}) c), g(a, b, d) AS (VALUES {GRID}),
    s AS (SELECT book, overall, round(round(signing * a + retention * b + bonus * d, 6)) AS score FROM c CROSS JOIN g)
    SELECT book, min(score) AS low, max(score) AS high, round(avg(CASE WHEN {LETTER.format('score')} = {LETTER.format('overall')} THEN 1e0 ELSE 0e0 END), 4) AS grade_stable, count(*) AS n_weights FROM s GROUP BY book""",
)
def _(t):
    """Each book's score under the grid of weights of signing, retention and bonus (the bonus is the retention): how far it moves, and in how many cells its grade stays."""
    books = commercial(t).select("book", "signing", "retention", "overall", F.col("retention").alias("bonus"))
    return r.weight_sensitivity(books, "book", r.weight_grid(SIGN, RETAIN), ((80, "S+"), (70, "A"), (60, "B"), (50, "C")))


@query("active_users", "SELECT user_id, count(*) AS n, max(event_id) AS last_event, count(DISTINCT event_type) AS kinds, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.count_distinct("event_type").alias("kinds"), F.round(F.sum("value"), 2).alias("total"))


@query("event_stats", "SELECT event_type, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event, round(avg(value), 4) AS mean_value FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.round(F.avg("value"), 4).alias("mean_value"))


@query("customer_orders", "SELECT n.n_name, count(*) AS n_orders, round(sum(CAST(o.o_totalprice AS DOUBLE)), 1) AS total FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name")
def _(t):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("o_totalprice").cast("double")), 1).alias("total"))


@query("hash_changes", "SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) AS ch_hash, substr(sha256(lower(coalesce(text, ''))), 1, 16) AS new_hash FROM documents WHERE coalesce(text, '') <> lower(coalesce(text, ''))")
def _(t):
    """Hashes of the texts whose lower-cased version differs."""
    text = F.coalesce("text", F.lit(""))
    h = lambda x: F.substring(F.sha2(x, 256), 1, 16)
    return t.documents.where(text != F.lower(text)).select("doc_id", h(text).alias("ch_hash"), h(F.lower(text)).alias("new_hash"))


@query("line_burstiness", "SELECT doc_id, CASE WHEN avg(len) > 0 THEN round(round(stddev_pop(len) / avg(len), 9), 3) ELSE 0e0 END AS burstiness, count(*) AS n FROM (SELECT doc_id, CAST(length(line) AS DOUBLE) AS len FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) a) b GROUP BY doc_id")
def _(t):
    from storyloom.operators.style import array_mean, array_std

    lines = t.documents.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x).cast("double")).alias("l")).withColumn("m", array_mean(F.col("l")))
    return lines.select("doc_id", F.when(F.col("m") > 0, rounded(F.round(array_std(F.col("l"), F.col("m"), False) / F.col("m"), 9), 3)).otherwise(F.lit(0.0)).alias("burstiness"), F.size("l").cast("long").alias("n"))


@query("prefix_share", "SELECT doc_id, round(max(n) / CAST(sum(n) AS DOUBLE), 3) AS top_share FROM (SELECT doc_id, substr(line, 1, 3) AS head, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) a GROUP BY doc_id, substr(line, 1, 3)) b GROUP BY doc_id")
def _(t):
    heads = t.documents.select("doc_id", F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.left(x, F.lit(3))).alias("h"))
    top = F.array_max(F.transform(F.array_distinct("h"), lambda d: F.size(F.filter("h", lambda x: x == d))))
    return heads.select("doc_id", rounded(top / F.size("h"), 3).alias("top_share"))
