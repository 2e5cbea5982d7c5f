"""Retrieval over documents, vectors, cards and experiences, with SQL of its own."""

from pyspark.sql import functions as F

from storyloom.operators import retrieval as r
from storyloom.operators import segmentation as sg
from storyloom.operators.scoring import rounded
from storyloom.plans.registry import Catalog, Tables

query = Catalog()

STOP = ", ".join(f"'{w}'" for w in sorted(set(r.STOP_WORDS)))


def tokens(table: str, key: str) -> str:
    return f"SELECT {key}, word, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT {key}, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-zà-ÿ]+')) AS word FROM {table}) a WHERE length(word) > 1 AND word NOT IN ({STOP}) GROUP BY {key}, word"


SCORES = f"""
    SELECT q.item_id, p.doc_id, sum(i.idf * p.tf * 2.5e0 / (p.tf + 1.5e0 * (0.25e0 + 0.75e0 * l.dl / g.mean))) AS score
    FROM (SELECT DISTINCT item_id, word FROM ({tokens("benchmark", "item_id")}) w WHERE item_id % 20 = 0) q
    JOIN ({tokens("documents", "doc_id")}) p ON q.word = p.word
    JOIN (SELECT word, ln(1 + (max(c.n) - count(*) + 0.5e0) / (count(*) + 0.5e0)) AS idf FROM ({tokens("documents", "doc_id")}) x CROSS JOIN (SELECT count(*) AS n FROM documents) c GROUP BY word) i ON i.word = p.word
    JOIN (SELECT doc_id, sum(tf) AS dl FROM ({tokens("documents", "doc_id")}) y GROUP BY doc_id) l ON l.doc_id = p.doc_id
    CROSS JOIN (SELECT sum(tf) / count(DISTINCT doc_id) AS mean FROM ({tokens("documents", "doc_id")}) z) g GROUP BY q.item_id, p.doc_id"""
BM25 = f"SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS place FROM ({SCORES}) s"


def keyword_channel(t: Tables, most: int):
    return r.ranked(r.bm25(t.documents, t.benchmark.where("item_id % 20 = 0")), "item_id", "doc_id", most)


@query("bm25_search", f"SELECT item_id, doc_id, round(score, 4) AS score, place FROM ({BM25}) b WHERE place <= 10")
def _(t):
    return keyword_channel(t, 10).select("item_id", "doc_id", F.round("score", 4).alias("score"), "place")


COSINE = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"


@query("vector_search", f"SELECT query_id, vec_id, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, vec_id) AS place FROM (SELECT q.vec_id AS query_id, v.vec_id, {COSINE.format(a='q.embedding', b='v.embedding')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) a) b WHERE place <= 10")
def _(t):
    asked = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return r.neighbours(t.embeddings, asked, "vec_id", "query_id", "embedding", 10, skip_self=True).select("query_id", "vec_id", F.round("score", 5).alias("score"), "place")


#: The tables have no script without spaces: runs of letters stand for it, syllables for its words.
LATIN, LEARN = "[a-zà-ÿ]", {"longest": 4, "least": 25, "cohesion": 1.5, "most": 20_000}


def syllables(t: Tables):
    return sg.learned(t.documents.select(F.lower("text").alias("text")), letter=LATIN, **LEARN)


@query(
    "learned_words",
    """
    WITH r AS (SELECT run, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS run FROM documents) a GROUP BY run),
    c AS (SELECT g AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, unnest(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, length(run) - k + 2), lambda i: substr(run, i, k))))) AS g FROM r) b GROUP BY g HAVING length(g) = 1 OR sum(n) >= 25),
    t AS (SELECT sum(n) AS total FROM c WHERE length(word) = 1),
    o AS (SELECT w.word, w.n, min(round(ln(CAST(w.n AS DOUBLE) * t.total / (CAST(x.n AS DOUBLE) * y.n)), 9)) AS odds FROM (SELECT word, n, unnest(range(1, length(word))) AS at_ FROM c WHERE length(word) > 1) w JOIN c x ON x.word = left(w.word, w.at_) JOIN c y ON y.word = substr(w.word, w.at_ + 1) CROSS JOIN t GROUP BY w.word, w.n)
    SELECT word, n FROM (SELECT word, n FROM o WHERE odds >= 1.5 UNION ALL SELECT word, n FROM c WHERE length(word) = 1) z ORDER BY n DESC, word LIMIT 20000""",
)
def _(t):
    return syllables(t)


@query("segmented_search")
def _(t):
    """Keyword search over words that were cut by best paths through learned words."""
    vocabulary = syllables(t)
    docs, asked = (sg.segmented(rows, vocabulary, letter=LATIN, other="[0-9]+") for rows in (t.documents.select("doc_id", "text"), t.benchmark.select("item_id", "text")))
    found = r.ranked(r.bm25(docs, asked, text="words"), "item_id", "doc_id", 10)
    return found.select("item_id", "doc_id", F.round("score", 4).alias("score"), "place")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def profile(text):
    """A vector of a text that needs no model: how often it has each letter."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(ch), F.lit("")))).cast("double") for ch in LETTERS])


PROFILE = "[" + ", ".join(f"CAST(length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{ch}', '')) AS DOUBLE)" for ch in LETTERS) + "]"
DENSE = f"""
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 7) DESC, doc_id) AS place FROM (
      SELECT q.item_id, v.doc_id, CASE WHEN list_inner_product(q.v, q.v) = 0 OR list_inner_product(v.v, v.v) = 0 THEN 0e0 ELSE {COSINE.format(a='q.v', b='v.v')} END AS score FROM (SELECT item_id, {PROFILE} AS v FROM benchmark WHERE item_id % 20 = 0) q CROSS JOIN (SELECT doc_id, {PROFILE} AS v FROM documents) v) s"""


@query(
    "rrf_fusion",
    f"""
    WITH a AS (SELECT item_id, doc_id, place AS first_rank FROM ({BM25}) b WHERE place <= 50), d AS (SELECT item_id, doc_id, place AS second_rank FROM ({DENSE}) e WHERE place <= 50),
    m AS (SELECT coalesce(a.item_id, d.item_id) AS item_id, coalesce(a.doc_id, d.doc_id) AS doc_id, first_rank, second_rank, coalesce(1e0 / (60 + first_rank), 0) + coalesce(1e0 / (60 + second_rank), 0) AS score FROM a FULL OUTER JOIN d ON a.item_id = d.item_id AND a.doc_id = d.doc_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM m), t AS (SELECT *, min(score) OVER (PARTITION BY item_id) AS low, max(score) OVER (PARTITION BY item_id) AS high FROM k WHERE place <= 10)
    SELECT item_id, doc_id, round(round((score - low) / CASE WHEN high > low THEN high - low ELSE 1e0 END, 9), 3) AS similarity, first_rank, second_rank, place FROM t""",
)
def _(t):
    """Keyword and dense ranking of the same documents for the same passages, fifty candidates each."""
    vectors = t.documents.select("doc_id", profile(F.col("text")).alias("v"))
    asked = t.benchmark.where("item_id % 20 = 0").select("item_id", profile(F.col("text")).alias("v"))
    return r.fused(keyword_channel(t, 50), r.neighbours(vectors, asked, "doc_id", "item_id", "v", 50), "item_id", "doc_id")


@query("conflict_peaks", "SELECT book, ch_num, conflict_density FROM metrics ORDER BY conflict_density DESC, book, ch_num LIMIT 20")
def _(t):
    return t.metrics.select("book", "ch_num", "conflict_density").orderBy(F.desc("conflict_density"), "book", "ch_num").limit(20)


@query("keyword_search", "SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%rights%' OR lower(source) LIKE '%license%' OR lower(source) LIKE '%rights%'")
def _(t):
    return r.search(t.documents, ("license", "rights"), ("text", "source")).select("doc_id", "source")


@query("top_classes", "SELECT book, dominant_sub, n, k FROM (SELECT book, dominant_sub, count(*) AS n, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, min(ch_num)) AS k FROM metrics GROUP BY book, dominant_sub) a WHERE k <= 3")
def _(t):
    return r.top_classes(t.metrics, "book", "dominant_sub", "ch_num")


@query("even_sample", "SELECT book, ch_num FROM (SELECT book, ch_num, count(*) OVER (PARTITION BY book) AS n FROM chapters) a WHERE (ch_num - 1) % greatest(CAST(floor(n / 5) AS BIGINT), 1) = 0")
def _(t):
    return r.even_sample(t.chapters, "book", "ch_num").select("book", "ch_num")


PLACES = ("any", "opening", "early", "mid", "late", "ending")


def cards(t: Tables):
    """Passages as technique cards: key words are their longest words."""
    position = F.element_at(F.array(*[F.lit(x) for x in PLACES]), (F.col("item_id") % 6 + 1).cast("int"))
    severity = F.element_at(F.array(F.lit("rule"), F.lit("benchmark"), F.lit("reference")), (F.col("item_id") % 3 + 1).cast("int"))
    low = F.lower(F.coalesce("text", F.lit("")))
    return t.benchmark.select(F.col("item_id").alias("id"), position.alias("position"), F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit("([a-z]{9,})"), 1), lambda x: x != "")).alias("keywords"), low.alias("text"), severity.alias("severity"))


@query(
    "card_retrieval",
    """
    WITH c AS (SELECT item_id AS id, ['any', 'opening', 'early', 'mid', 'late', 'ending'][item_id % 6 + 1] AS position, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{9,}') AS keywords, lower(coalesce(text, '')) AS text, CASE item_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0e0 END AS sev FROM benchmark),
    x AS (SELECT book, ch_num, CASE WHEN pct <= 10 THEN 'opening' WHEN pct <= 30 THEN 'early' WHEN pct <= 70 THEN 'mid' WHEN pct <= 90 THEN 'late' ELSE 'ending' END AS here, w FROM (SELECT m.book, m.ch_num, m.ch_num / count(*) OVER (PARTITION BY m.book) * 100 AS pct, [m.dominant_sub, m.pace, 'th', 'entheroned'] AS w FROM metrics m) y),
    s AS (SELECT book, ch_num, id, CASE WHEN position = here THEN 3e0 WHEN position = 'any' THEN 1e0 WHEN abs(list_position(['opening', 'early', 'mid', 'late', 'ending'], position) - list_position(['opening', 'early', 'mid', 'late', 'ending'], here)) = 1 THEN 1.5e0 ELSE 0e0 END + list_sum(list_transform(w, lambda k: CASE WHEN list_contains(keywords, k) THEN 2e0 WHEN contains(text, k) THEN 1e0 ELSE 0e0 END)) + sev AS score FROM x CROSS JOIN c)
    SELECT book, ch_num, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY book, ch_num ORDER BY score DESC, id) AS place FROM s WHERE score > 0) z WHERE place <= 5""",
)
def _(t):
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("book"))
    contexts = t.metrics.select("book", "ch_num", r.place_name(F.col("ch_num"), n).alias("here"), F.array("dominant_sub", "pace", F.lit("th"), F.lit("entheroned")).alias("wanted"))
    return r.best_cards(contexts, cards(t), ["book", "ch_num"], "here", "wanted")


@query(
    "experience_check",
    """
    WITH e AS (SELECT item_id AS id, [['slap', 'fast'], ['comeback'], ['slow', 'en'], ['de', 'hidden']][item_id % 4 + 1] AS tags, ['en', 'de', 'fr', NULL][item_id % 4 + 1] AS genre, item_id % 3 = 0 AS is_global, lower(coalesce(text, '')) AS symptom, item_id % 4 + 1 AS severity, item_id % 13 AS hits FROM benchmark),
    x AS (SELECT m.doc_id, d.lang AS genre, [m.dominant_sub, m.pace] AS w FROM metrics m JOIN documents d ON m.doc_id = d.doc_id WHERE d.lang IS NOT NULL),
    s AS (SELECT x.doc_id, e.id, e.severity, e.hits, e.is_global, len(list_intersect(e.tags, list_concat(x.w, [x.genre]))) * 2e0 + CASE WHEN e.genre = x.genre THEN 1e0 WHEN e.is_global AND e.genre IS NULL THEN 0.5e0 ELSE 0e0 END + list_sum(list_transform(x.w, lambda k: CASE WHEN contains(e.symptom, k) THEN 1e0 ELSE 0e0 END)) AS rel FROM x CROSS JOIN e),
    t AS (SELECT *, round(rel + CASE WHEN is_global THEN 1.5e0 ELSE 0e0 END + severity * 0.5e0 + least(hits * 0.3e0, 3e0), 6) AS score FROM s WHERE rel > 0)
    SELECT doc_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, severity DESC, hits DESC, id) AS place FROM t) z WHERE place <= 5""",
)
def _(t):
    pick = lambda *x: F.element_at(F.array(*x), (F.col("item_id") % 4 + 1).cast("int"))
    lit = lambda *x: F.array(*[F.lit(y) for y in x])
    experiences = t.benchmark.select(F.col("item_id").alias("id"), pick(lit("slap", "fast"), lit("comeback"), lit("slow", "en"), lit("de", "hidden")).alias("tags"), pick(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit(None).cast("string")).alias("genre"), (F.col("item_id") % 3 == 0).alias("is_global"), F.lower(F.coalesce("text", F.lit(""))).alias("symptom"), (F.col("item_id") % 4 + 1).alias("severity"), (F.col("item_id") % 13).alias("hits"))
    contexts = t.metrics.join(t.documents.select("doc_id", F.col("lang").alias("genre")), "doc_id").where("genre is not null").select("doc_id", "genre", F.array("dominant_sub", "pace").alias("wanted"))
    return r.best_experiences(contexts, experiences, ["doc_id"], "genre", "wanted")


def memories(t: Tables):
    """Dialogue turns as memory cards: tags from what they say."""
    low = F.lower(F.coalesce("text", F.lit("")))
    tags = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(n)) for w, n in (("tion", "plot"), ("ores", "conflict"), ("ment", "style"))], F.col("role")))
    return t.conversations.select("conv_id", "turn", "role", tags.alias("tags"), low.alias("text"))


MEMORIES = "SELECT conv_id, turn, role, contains(lower(coalesce(text, '')), 'tion') AS plot, contains(lower(coalesce(text, '')), 'ores') AS conflict, contains(lower(coalesce(text, '')), 'ment') AS style FROM conversations"


@query("memory_by_tags", f"SELECT conv_id, turn, 'any' AS how FROM ({MEMORIES}) m WHERE plot OR conflict UNION ALL SELECT conv_id, turn, 'all' FROM ({MEMORIES}) m WHERE plot AND style AND role = 'user'")
def _(t):
    m = memories(t)
    return r.tagged(m, ("plot", "conflict")).select("conv_id", "turn", F.lit("any").alias("how")).unionAll(r.tagged(m, ("plot", "style", "user"), True).select("conv_id", "turn", F.lit("all").alias("how")))


@query("memory_counts", f"SELECT role, count(*) AS n, count(*) FILTER (WHERE plot) AS n_plot, max(turn) AS last_turn FROM ({MEMORIES}) m GROUP BY role")
def _(t):
    return memories(t).groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.array_contains("tags", "plot")).alias("n_plot"), F.max("turn").alias("last_turn"))


@query("recent_memories", "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 10")
def _(t):
    return t.conversations.select("conv_id", "turn", "role").orderBy(F.desc("conv_id"), F.desc("turn")).limit(10)


@query("stale_memories", "SELECT user_id, event_type, age, hits FROM (SELECT user_id, event_type, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-15') AS age, count(*) FILTER (WHERE value > 80) AS hits FROM events GROUP BY user_id, event_type) a WHERE age > 17 AND hits <= 3")
def _(t):
    """Records whose last touch lies back and that hardly were of use."""
    last = t.events.groupBy("user_id", "event_type").agg(F.datediff(F.lit("2024-02-15"), F.max("ts").cast("date")).cast("long").alias("age"), F.count_if(F.col("value") > 80).alias("hits"))
    return last.where("age > 17 AND hits <= 3")


@query("index_stats", f"SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words, round(round(avg(n), 9), 3) AS mean_words, count(*) FILTER (WHERE n = 0) AS n_empty FROM (SELECT d.doc_id, coalesce(sum(tf), 0) AS n FROM documents d LEFT JOIN ({tokens('documents', 'doc_id')}) w ON d.doc_id = w.doc_id GROUP BY d.doc_id) z")
def _(t):
    n = t.documents.select(F.size(r.words(F.col("text"))).alias("n"))
    return n.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"), rounded(F.round(F.avg("n"), 9), 3).alias("mean_words"), F.count_if(F.col("n") == 0).alias("n_empty"))


@query("title_dedup", "SELECT source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY source, n_chars")
def _(t):
    """Of rows with one title (here source and length) the first stays."""
    return t.documents.groupBy("source", "n_chars").agg(F.min("doc_id").alias("doc_id"))


@query("shared_subs", "SELECT dominant_sub FROM metrics WHERE ch_num <= 3 INTERSECT SELECT dominant_sub FROM metrics WHERE hook_density = 0")
def _(t):
    return t.metrics.where("ch_num <= 3").select("dominant_sub").intersect(t.metrics.where("hook_density = 0").select("dominant_sub"))


@query("latest_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) a WHERE k <= 2")
def _(t):
    from pyspark.sql import Window

    return t.conversations.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("k <= 2").select("conv_id", "turn", "role")
