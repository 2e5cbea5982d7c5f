"""Texts into parts, and detectors over them, with SQL of their own."""

from pyspark.sql import functions as F

from storyloom.functions.columns import count, paragraphs, shares
from storyloom.operators import detectors as d
from storyloom.operators import text as s
from storyloom.operators.projection import rich_scan
from storyloom.plans.corpus import paragraphs_sql, parts_sql, sentence_sql
from storyloom.plans.registry import Catalog, Tables
from storyloom.functions.lexicon import LATIN, RICH_LATIN

query = Catalog()

TEXT = "coalesce(text, '')"
N = lambda text, p: f"CAST(len(regexp_extract_all({text}, '{p}')) AS BIGINT)"
S = r" \t\n\r\f\x{0B}"
TRIM = lambda x: f"regexp_replace({x}, '^[{S}]+|[{S}]+$', '', 'g')"


@query("chapter_metrics", "SELECT * FROM metrics")
def _(t):
    return t.metrics


def encoded():
    """Each text in one of four encodings, by its number."""
    kinds = {0: "UTF-8", 1: "UTF-16LE", 2: "UTF-16BE", 3: "UTF-8"}
    text = F.coalesce("text", F.lit(""))
    out = F.encode(text, "UTF-8")
    for k, name in kinds.items():
        marked = {1: F.lit(b"\xff\xfe"), 2: F.lit(b"\xfe\xff"), 3: F.lit(b"\xef\xbb\xbf")}.get(k)
        coded = F.encode(text, name)
        out = F.when(F.col("doc_id") % 4 == k, coded if marked is None else F.concat(marked, coded)).otherwise(out)
    return out


@query("decoded_texts", f"SELECT doc_id, ['utf-8', 'utf-16-le', 'utf-16-be', 'utf-8-sig'][doc_id % 4 + 1] AS mark, ['utf-8', 'utf-16-le', 'utf-16-be', 'utf-8'][doc_id % 4 + 1] AS encoding, sha256({TEXT}) AS sha FROM documents")
def _(t):
    raw = t.documents.select("doc_id", encoded().alias("content"))
    return raw.select("doc_id", s.encoding(F.col("content")).alias("mark"), s.decoded("content").alias("d")).select("doc_id", "mark", "d.encoding", F.sha2("d.text", 256).alias("sha"))


#: Headers of four kinds, by doc_id % 4.
HEADED = (("第一章 Alpha", "第2章 Beta", "第一百零三章 Gamma"), ("序章 Alpha", "章2 Beta", "章十二 Gamma"), ("1 Alpha", "22 Beta", "333 Gamma"), ("4", "55", "666"))


def raw_books(t: Tables):
    """Each text cut in thirds under headers of one of four kinds, as a raw book."""
    third = shares(F.coalesce("text", F.lit("")), 3)
    book = [F.concat(*[x for h, p in zip(hs, third, strict=True) for x in (F.lit(f"\n{h}\n"), p)]) for hs in HEADED]
    return t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, book[0]).when(F.col("doc_id") % 4 == 1, book[1]).when(F.col("doc_id") % 4 == 2, book[2]).otherwise(book[3]).alias("book"))


THIRD = "greatest(CAST(floor(length(text) / 3) AS BIGINT), 1)"
THIRDS = f"SELECT doc_id, k, CASE k WHEN 1 THEN substr(text, 1, {THIRD}) WHEN 2 THEN substr(text, {THIRD} + 1, {THIRD}) ELSE substr(text, 2 * {THIRD} + 1) END AS part FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) x"
BODIES = f"SELECT doc_id, k, {TRIM('part')} AS body FROM ({THIRDS}) y"
TITLE_OF = f"{[list(h) for h in HEADED]}[doc_id % 4 + 1][k]"
#: The books of raw_books, in lines with the places of their first letters; a text may hold lines that are headers themselves.
N_OF = "[一二三四五六七八九十百千零0-9]+"
RAW_LINES = f"""
    raw AS (SELECT doc_id, string_agg(chr(10) || {TITLE_OF} || chr(10) || part, '' ORDER BY k) AS book FROM ({THIRDS}) t GROUP BY doc_id),
    lines AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) AS pos FROM (SELECT doc_id, book, unnest(string_split(book, chr(10))) AS line, generate_subscripts(string_split(book, chr(10)), 1) AS i FROM raw) a)"""
#: Headers (kind, pos, title): the first two kinds reach from a mark to the end of the line, the others are a line; a bare number is no year, and 20 letters follow within 50.
FOUND = f"""
    found AS (SELECT doc_id, kind, pos + length(line) - length(title) AS pos, title FROM (
        SELECT doc_id, pos, line, 1 AS kind, regexp_extract(line, '第{N_OF}章[^\\n]*') AS title FROM lines
        UNION ALL SELECT doc_id, pos, line, 2, regexp_extract(line, '(序章|章{N_OF})[^\\n]*') FROM lines
        UNION ALL SELECT doc_id, pos, line, 3, regexp_extract(line, '^[ \\t]*[0-9]{{1,4}}[ \\t]+[^0-9\\n][^\\n]*') FROM lines
        UNION ALL SELECT doc_id, pos, line, 4, line FROM (SELECT * FROM lines WHERE regexp_matches(line, '^[ \\t]*[0-9]{{1,4}}[ \\t]*$') AND NOT regexp_matches(line, '^[ \\t]*(19|20)[0-9][0-9][ \\t]*$')) b
          WHERE length({TRIM('substr(book, CAST(pos + length(line) AS BIGINT), 50)')}) >= 20) h WHERE title <> ''),
    chosen AS (SELECT doc_id, min(kind) AS kind FROM (SELECT doc_id, kind FROM found GROUP BY doc_id, kind HAVING count(*) >= CASE kind WHEN 4 THEN 3 ELSE 2 END) c GROUP BY doc_id),
    cut AS (SELECT f.doc_id, f.pos, {TRIM('f.title')} AS title, {TRIM("substr(book, CAST(f.pos + length(f.title) AS BIGINT), CAST(coalesce(lead(f.pos) OVER (PARTITION BY f.doc_id ORDER BY f.pos), length(book) + 1) - f.pos - length(f.title) AS BIGINT))")} AS body
      FROM found f JOIN chosen c ON f.doc_id = c.doc_id AND f.kind = c.kind JOIN raw r ON f.doc_id = r.doc_id)"""
#: A number in digits or numerals: each unit takes the numeral before it, the last numeral counts as it is.
UNITS = "CASE right(m, 1) WHEN '十' THEN 10 WHEN '百' THEN 100 ELSE 1000 END * greatest(1, strpos('一二三四五六七八九', left(m, 1)))"
SPELLED = f"coalesce(list_sum(list_transform(regexp_extract_all(z, '[零一二三四五六七八九]?[十百千]'), lambda m: {UNITS})), 0) + CASE WHEN z = '' THEN 0 ELSE strpos('一二三四五六七八九', right(z, 1)) END"
NUMBERED = f"""
    numbered AS (SELECT *, CASE WHEN regexp_matches(title, '^第{N_OF}章') OR regexp_matches(title, '^章{N_OF}') THEN coalesce(TRY_CAST(x AS BIGINT), CASE WHEN {SPELLED} > 0 THEN {SPELLED} ELSE length(x) END)
        WHEN starts_with(title, '序章') THEN 0 ELSE coalesce(TRY_CAST(regexp_extract(title, '[0-9]{{1,4}}') AS BIGINT), 0) END AS given
      FROM (SELECT *, regexp_replace(x, '[0-9]', '', 'g') AS z FROM (SELECT *, length(translate(body, chr(10) || ' ', '')) AS wc, regexp_extract(title, '章?({N_OF})', 1) AS x FROM cut) a) b WHERE wc >= 50)"""


@query(
    "extract_chapters",
    f"""
    WITH {RAW_LINES}, {FOUND}, {NUMBERED}
    SELECT doc_id, row_number() OVER w AS place, CAST(CASE WHEN given = 0 THEN count(*) FILTER (WHERE given = 0) OVER w ELSE given END AS BIGINT) AS num, title, CAST(wc AS BIGINT) AS wc, sha256(body) AS sha, CAST(len({paragraphs_sql('body', 'wc')}) AS BIGINT) AS para_count
    FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
)
def _(t):
    return s.extract_chapters(raw_books(t), "doc_id", "book").select("doc_id", "place", "num", "title", "wc", F.sha2("body", 256).alias("sha"), "para_count")


@query("loose_chapters", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS place, sha256({TRIM('body')}) AS sha FROM (SELECT doc_id, 1 AS k, text AS body FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 UNION ALL SELECT doc_id, k, body FROM ({BODIES}) b WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM documents WHERE length(text) > 600) UNION ALL SELECT doc_id, 1, text FROM documents WHERE length(text) <= 600 AND doc_id % 3 = 0) z WHERE length(translate({TRIM('body')}, chr(10) || ' ', '')) >= 50")
def _(t):
    third = shares(F.col("text"), 3)
    headed = F.concat(*[x for i, p in enumerate(third) for x in (F.lit(f"\nChapter {i + 1}: x\n"), p)])
    docs = t.documents.where("text is not null").select("doc_id", F.when((F.length("text") > 600) & (F.col("doc_id") % 3 == 0), headed).otherwise(F.col("text")).alias("book"))
    return s.extract_chapters(docs, "doc_id", "book", s.LOOSE, (1,), whole=True).select("doc_id", "place", F.sha2("body", 256).alias("sha"))


@query("scenes")
def _(t):
    """A fold over sentences; tested against brute force."""
    return s.scenes(t.documents).select("doc_id", "scene", "chars", F.sha2("body", 256).alias("sha"))


@query("paragraphs", f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_paragraphs, CAST(coalesce(list_max(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS longest FROM (SELECT doc_id, {paragraphs_sql(TEXT, f'length({TEXT})')} AS p FROM documents) a")
def _(t):
    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", paragraphs(text, F.length(text)).alias("p")).select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.coalesce(F.array_max(F.transform("p", lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query("sentences", f"SELECT doc_id, {N(TEXT, sentence_sql('.!?'))} AS n_sentences, {N('lower(' + TEXT + ')', '[a-zà-ÿ]')} AS n_letters, {N(TEXT, '[！!？?]')} AS n_exclamations FROM documents")
def _(t):
    from storyloom.operators.projection import sentence

    text = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", count(text, sentence(".!?")).alias("n_sentences"), count(F.lower(text), "[a-zà-ÿ]").alias("n_letters"), count(text, "[！!？?]").alias("n_exclamations"))


@query("dialogues", """SELECT doc_id, len(q) AS n_dialogues, CAST(coalesce(list_sum(list_transform(q, lambda x: length(x))), 0) AS BIGINT) AS chars FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '"[^"\\n]+"|“[^”\\n]+”') AS q FROM documents) a""")
def _(t):
    q = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({LATIN.dialogue})"), 1)
    return t.documents.select("doc_id", q.alias("q")).select("doc_id", F.size("q").cast("long").alias("n_dialogues"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


#: The text may hold lines that begin with `## ` itself: they are sections as well.
MARKDOWN = f"chr(10) || '# T' || chr(10) || chr(10) || '## Facts' || chr(10) || '- ' || left({TEXT}, 200) || chr(10) || chr(10) || '## Rest' || chr(10) || substr({TEXT}, 201)"


@query("markdown_sections", f"SELECT doc_id, {TRIM('head')} AS section, sha256({TRIM('substr(part, length(head) + 2)')}) AS sha FROM (SELECT doc_id, part, split_part(part, chr(10), 1) AS head FROM (SELECT doc_id, unnest(regexp_split_to_array({MARKDOWN}, '\\n## +')[2:]) AS part FROM documents) a) b")
def _(t):
    text = F.coalesce("text", F.lit(""))
    md = F.concat(F.lit("# T\n\n## Facts\n- "), F.left(text, F.lit(200)), F.lit("\n\n## Rest\n"), F.expr("substr(coalesce(text, ''), 201)"))
    return s.sections(t.documents.select("doc_id", md.alias("md")), "doc_id", "md").select("doc_id", "section", F.sha2("body", 256).alias("sha"))


@query("bullet_facts", f"SELECT doc_id, fact FROM (SELECT doc_id, {TRIM('unnest(string_split(' + TEXT + ', chr(10)))')} AS fact, generate_subscripts(string_split({TEXT}, chr(10)), 1) AS i FROM documents) a WHERE i % 3 <> 0 AND length(fact) >= 5")
def _(t):
    """Two of three lines become facts under bullets of several kinds."""
    mark = lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("> "), x)).when(i % 3 == 0, F.concat(F.lit("- "), x)).otherwise(F.concat(F.lit("  12. "), x))
    md = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), mark), "\n")
    return s.bullets(t.documents.select("doc_id", md.alias("md")), "doc_id", "md")


@query("titles_and_authors", "SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'Writer' || c_nationkey END AS author, CAST(round(c_custkey * 1024 / 1.8e0) AS BIGINT) AS words FROM customer")
def _(t):
    file = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("《"), "c_name", F.lit("》（精校版）作者："), F.concat(F.lit("Writer"), "c_nationkey"))).otherwise(F.concat("c_name", F.lit("(全本)"))), F.lit(".txt"))
    title, author = s.title_and_author(F.col("file"))
    return t.customer.select("c_custkey", file.alias("file")).select("c_custkey", title.alias("title"), author.alias("author"), s.estimated_words(F.col("c_custkey")).alias("words"))


@query("plan_keywords", """SELECT doc_id, array_to_string(w[:10], ',') AS words FROM (SELECT doc_id, list_filter(list_transform(generate_series(1, len(a)), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda x: x IS NOT NULL) AS w FROM (SELECT doc_id, list_concat(regexp_extract_all(coalesce(text, ''), '"([^"\\n]+)"', 1), list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]{5,9}'), lambda x: x NOT IN ('which', ''))) AS a FROM documents) b) c""")
def _(t):
    return t.documents.select("doc_id", F.concat_ws(",", s.keywords(F.coalesce("text", F.lit("")), stop=("which",))).alias("words"))


@query("clipped_texts", f"SELECT doc_id, sha256(CASE WHEN length({TEXT}) > 1200 THEN left({TEXT}, 400) || chr(10) || '...' || chr(10) || right({TEXT}, 800) ELSE {TEXT} END) AS sha FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(s.clipped(F.coalesce("text", F.lit(""))), 256).alias("sha"))


@query("repaired_labels", "SELECT doc_id, CASE WHEN quality = 1 THEN 'major' ELSE 'none' END AS pleasure_type, CAST(doc_id % 10 AS VARCHAR) AS pleasure_intensity, NULL::VARCHAR AS conflict_level, CASE WHEN toxic = 1 THEN 'dark' ELSE 'calm' END AS emotion, 'fast' AS pace FROM labels")
def _(t):
    kind, mood = F.when(F.col("quality") == 1, "major").otherwise("none"), F.when(F.col("toxic") == 1, "dark").otherwise("calm")
    raw = F.concat(F.lit('Sure, here it is:\n```json\n{"t": "'), kind, F.lit('", “i”: "'), (F.col("doc_id") % 10).cast("string"), F.lit('",\n "emotion": "'), mood, F.lit('", "p": "fast",\n}\n```'))
    return t.labels.select("doc_id", s.repaired_labels(raw).alias("r")).select("doc_id", "r.*")


RATIOS, DELTAS = {1: 0.4, 2: 0.3, 3: 0.2, 4: 0.1}, {1: 0.1, 4: -0.08}
LIMITS = s.tier_limits(900, RATIOS, DELTAS)


@query("context_packing")
def _(t):
    """A greedy fold with a partial fit; tested against brute force."""
    entries = t.conversations.select("conv_id", (F.col("turn") % 4 + 1).cast("int").alias("tier"), F.col("turn").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("content"), (F.length("text") % 7).alias("priority"))
    return s.packed_context(entries, "conv_id", LIMITS)


GENRES = {"forest": {"wood": 1.0, "erth": 0.5}, "city": {"street": 1.5, "ouen": 0.4, "tion": 0.1}, "sea": {"onre": 0.7, "ment": 0.3}}
TITLES = {"source03": "sea", "source1": "city", "source12": "forest"}
GENRE_SCORES = ", ".join(f"round({' + '.join(f'{N(TEXT, w)} * {x}e0' for w, x in ws.items())}, 2) AS s_{g}" for g, ws in GENRES.items())


@query(
    "detect_genre",
    f"""
    WITH x AS (SELECT doc_id, CASE WHEN contains(source, 'source03') THEN 'sea' WHEN contains(source, 'source12') THEN 'forest' WHEN contains(source, 'source1') THEN 'city' END AS titled, {GENRE_SCORES} FROM documents),
    l AS (SELECT doc_id, unnest(['forest', 'city', 'sea']) AS g, unnest([s_forest, s_city, s_sea]) AS v FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, g) AS k FROM l WHERE v > 0),
    a AS (SELECT x.doc_id, x.titled, max(v) FILTER (WHERE k = 1) AS top, max(g) FILTER (WHERE k = 1) AS best, max(v) FILTER (WHERE k = 2) AS second, sum(v) AS total FROM x LEFT JOIN r ON x.doc_id = r.doc_id GROUP BY x.doc_id, x.titled),
    c AS (SELECT a.doc_id, coalesce(string_agg(r.g, ',' ORDER BY r.k), '') AS close FROM a JOIN r ON a.doc_id = r.doc_id AND r.k > 1 AND r.v > a.top * 0.7e0 GROUP BY a.doc_id)
    SELECT a.doc_id, CASE WHEN titled IS NOT NULL THEN titled WHEN top IS NULL OR top < 2 OR coalesce(second, 0) > top * 0.7e0 THEN 'unknown' ELSE best END AS genre, coalesce(titled, CASE WHEN top IS NULL OR top < 2 THEN 'unknown' ELSE best END) AS primary, CASE WHEN titled IS NULL AND top >= 2 THEN coalesce(close, '') ELSE '' END AS secondary,
      CASE WHEN titled IS NOT NULL THEN 0.95e0 WHEN top IS NULL OR top < 2 THEN 0e0 ELSE least(round(round(top / greatest(total, 1), 9), 3), 1) END AS confidence, CASE WHEN titled IS NOT NULL THEN 'title' WHEN top IS NULL THEN 'unknown' WHEN top < 2 THEN 'keywords' WHEN round(round(top / greatest(total, 1), 9), 3) < 0.3 THEN 'keywords_unsure' ELSE 'keywords' END AS method
    FROM a LEFT JOIN c ON a.doc_id = c.doc_id""".replace("AS primary", 'AS "primary"').replace("AS close", 'AS "close"').replace("coalesce(close, '')", """coalesce("close", '')"""),
)
def _(t):
    return s.detect_genre(t.documents, GENRES, TITLES, name="source")


@query(
    "basic_filter",
    f"""
    SELECT doc_id, reason IN ('known', 'ok') AS passed, reason FROM (SELECT doc_id, CASE WHEN contains(source, 'source07') THEN 'known' WHEN kb < 2 THEN 'too_small' WHEN n < 2 THEN 'few_chapters' WHEN density < 0.6 THEN 'few_letters' WHEN kb <= 50 AND (letters / greatest(n, 1) > 50000 OR (letters / greatest(n, 1) < 200 AND n >= 10)) THEN 'odd_chapters' ELSE 'ok' END AS reason FROM (
      SELECT *, CASE WHEN kb > 50 THEN 2 ELSE chapters END AS n FROM (SELECT doc_id, source, floor(strlen({TEXT}) / 1024) AS kb, {N(TEXT, '(?i)whth|ouen')} AS chapters, {N('lower(' + TEXT + ')', '[a-z]')} AS unused, {N(TEXT, '[a-z]')} / greatest(length(translate({TEXT}, chr(10) || ' ', '')), 1) AS density, {N(TEXT, '[a-z]')} AS letters FROM documents) a) b) c""",
)
def _(t):
    return s.basic_filter(t.documents, ["source07"], name="source", least_kb=2, large_kb=50, least_chapters=2, least_density=0.6, letters="[a-z]", header="(?i)whth|ouen", head_chars=None)


SPOKEN = r"([A-Z][a-zà-ÿ]{2,}),? ([a-z]{2,})"


@query("speakers", f"SELECT doc_id, speaker, count(*) AS lines, CAST(sum(length(what)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(regexp_extract_all({TEXT}, '{SPOKEN}', 1)) AS speaker, unnest(regexp_extract_all({TEXT}, '{SPOKEN}', 2)) AS what FROM documents) a GROUP BY doc_id, speaker")
def _(t):
    return s.speakers(t.documents.where("text is not null"), SPOKEN)


@query("frequent_names", f"SELECT *, CASE WHEN place = 1 THEN 'protagonist' WHEN place <= 5 THEN 'major' ELSE 'supporting' END AS role FROM (SELECT name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, name) AS place FROM (SELECT unnest(regexp_extract_all({TEXT}, '{SPOKEN}', 1)) AS name FROM documents) a GROUP BY name) b WHERE place <= 20")
def _(t):
    return s.frequent_names(t.documents, SPOKEN)


CATEGORIES = {"plot": "ouen|tion", "style": "whth|aber"}
GRAVE = (("critical", "erth"), ("serious", "onre"), ("warning", "ment"))


@query("review_findings", f"SELECT conv_id, turn, i - 1 AS line, concat_ws(',', CASE WHEN regexp_matches(t, 'ouen|tion') THEN 'plot' END, CASE WHEN regexp_matches(t, 'whth|aber') THEN 'style' END) AS categories, CASE WHEN contains(t, 'erth') THEN 'critical' WHEN contains(t, 'onre') THEN 'serious' WHEN contains(t, 'ment') THEN 'warning' ELSE 'info' END AS severity FROM (SELECT conv_id, turn, unnest(string_split(lower({TEXT}), chr(10))) AS t, generate_subscripts(string_split(lower({TEXT}), chr(10)), 1) AS i FROM conversations) a WHERE regexp_matches(t, 'ouen|tion|whth|aber')")
def _(t):
    found = s.line_findings(t.conversations.select(F.struct("conv_id", "turn").alias("key"), "text"), CATEGORIES, GRAVE, "key", "text")
    return found.select("key.conv_id", "key.turn", "line", "categories", "severity")


LOW = f"lower({TEXT})"
R = RICH_LATIN


def rich_sum(kind: str, text: str = "low", n: int | None = None) -> str:
    return " + ".join(N(text, p) for p in list(R[kind].values())[:n])


PARTS = {0: "substr(low, 1, size)", 1: "substr(low, size + 1, size)", 2: "substr(low, 2 * size + 1)"}


SCAN = f"""
    SELECT doc_id, chars, sentences, round(h / kilo, 2) AS hook_density, round(100e0 * c / letters, 2) AS conflict_density, round(p / kilo, 3) AS pleasure_density,
      round(least(10e0, greatest(0e0, 0.7e0 * (200e0 * pos / letters + 150e0 * c / letters + 50e0 * ex / letters + 0.5e0 * h / kilo + 20e0 * neg / letters + 2e0 * phy / greatest(letters / 100e0, 1e0)))), 1) AS pleasure_intensity, round(talk / letters, 3) AS dialogue_ratio, round(asl, 1) AS avg_sentence_len,
      round(least(greatest(asl / 80 * 0.5e0 + (1 - vd * 3) * 0.3e0 + abs(asl - 35) / 50 * 0.2e0, 0e0), 1e0), 3) AS readability,
      {", ".join(f"round({N('low', x)} / kilo, 3) AS hook_{n}" for n, x in R["hook"].items())}, {", ".join(f"round(100e0 * {N('low', x)} / letters, 3) AS conflict_{n}" for n, x in R["conflict"].items())}, {", ".join(f"round({N('low', x)} / kilo, 3) AS pleasure_{n}" for n, x in R["pleasure"].items())},
      {", ".join(f"c{i} AS chars_{i}, round(h{i} / greatest(greatest(c{i}, 1) / 1000e0, 1e0), 3) AS hook_density_{i}, round(100e0 * k{i} / greatest(c{i}, 1), 3) AS conflict_density_{i}, round(p{i} / greatest(greatest(c{i}, 1) / 1000e0, 1e0), 3) AS pleasure_density_{i}" for i in range(3))}
    FROM (SELECT *, greatest(chars, 1) AS letters, greatest(chars / 1000e0, 1e0) AS kilo, sc / greatest(sn, 1) AS asl, dc / greatest(nc, 1) AS vd FROM (
      SELECT doc_id, low, {N("low", R["letters"])} AS chars, greatest({N("text", "[.!?…" + chr(92) + "n]")}, 1) AS sentences, {rich_sum("hook")} AS h, {rich_sum("conflict")} AS c, {rich_sum("pleasure")} AS p, {N("low", R["positive"])} AS pos, {N("low", R["negative"])} AS neg, {N("low", R["physio"])} AS phy, {N("text", "[！!？?]")} AS ex,
        length(text) - length(regexp_replace(text, '{LATIN.dialogue}', '', 'g')) AS talk, {N("text", sentence_sql(".!?"))} AS sn, length(text) - length(regexp_replace(text, '{sentence_sql(".!?")}', '', 'g')) AS sc, len(list_distinct(list_filter(string_split(translate(text, chr(10) || ' ', ''), ''), lambda x: x <> ''))) AS dc, length(translate(text, chr(10) || ' ', '')) AS nc,
        {", ".join(f"{N(x, R['letters'])} AS c{i}, {rich_sum('hook', x, 2)} AS h{i}, {rich_sum('conflict', x, 2)} AS k{i}, {rich_sum('pleasure', x, 2)} AS p{i}" for i, x in PARTS.items())}
      FROM (SELECT doc_id, {TEXT} AS text, {LOW} AS low, greatest(CAST(floor(length({TEXT}) / 3) AS BIGINT), 1) AS size FROM documents) a) b) z"""


@query("rich_scan", SCAN)
def _(t):
    return rich_scan(t.spread("documents"))


@query("text_thirds", "SELECT doc_id, " + ", ".join(f"{N(x.replace('low', 't'), '[.!?]')} AS marks_{i}" for i, x in PARTS.items()) + f" FROM (SELECT doc_id, {TEXT} AS t, greatest(CAST(floor(length({TEXT}) / 3) AS BIGINT), 1) AS size FROM documents) a")
def _(t):
    return t.documents.select("doc_id", *[count(x, "[.!?]").alias(f"marks_{i}") for i, x in enumerate(shares(F.coalesce("text", F.lit("")), 3))])


@query("text_fifths", "SELECT doc_id, " + ", ".join(f"{N(f'substr(t, {i} * size + 1, size)' if i < 4 else 'substr(t, 4 * size + 1)', '[.!?]')} AS marks_{i}" for i in range(5)) + f" FROM (SELECT doc_id, {TEXT} AS t, greatest(CAST(floor(length({TEXT}) / 5) AS BIGINT), 1) AS size FROM documents) a")
def _(t):
    return t.documents.select("doc_id", *[count(x, "[.!?]").alias(f"marks_{i}") for i, x in enumerate(shares(F.coalesce("text", F.lit("")), 5))])


@query("vocabulary", f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all({LOW}, '[a-zà-ÿ]+')) AS word FROM documents) a GROUP BY word")
def _(t):
    """Words of all texts; counts are summed by text and word first, so that a frequent word is no hot key."""
    words = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-zà-ÿ]+)"), 1)).alias("word")).where("word <> ''")
    return words.groupBy("word", "doc_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@query("char_bigrams", f"SELECT g[1] || g[2] AS gram, count(*) AS n FROM (SELECT unnest(list_zip(c[:-2], c[2:])) AS g FROM (SELECT string_split({LOW}, '') AS c FROM documents WHERE length(text) > 1) a) b GROUP BY 1")
def _(t):
    chars = t.documents.where("length(text) > 1").select(F.filter(F.split(F.lower("text"), ""), lambda x: x != "").alias("c"))
    pairs = F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: F.concat(a, b))
    return chars.select(F.explode(pairs).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("chapter_chunks", "SELECT book, CAST(floor((ch_num - 1) / 8) AS BIGINT) AS chunk, CAST(floor((ch_num - 1) / 40) AS BIGINT) AS part, count(*) AS n_chapters, min(ch_num) AS first_ch, max(ch_num) AS last_ch, CAST(sum(wc) AS BIGINT) AS wc FROM metrics GROUP BY 1, 2, 3")
def _(t):
    """The tree of summaries: chunks of eight chapters, parts of five chunks."""
    return t.metrics.groupBy("book", F.floor((F.col("ch_num") - 1) / 8).alias("chunk"), F.floor((F.col("ch_num") - 1) / 40).alias("part")).agg(F.count("*").alias("n_chapters"), F.min("ch_num").alias("first_ch"), F.max("ch_num").alias("last_ch"), F.sum("wc").alias("wc"))


LINES = (d.Line("contact", "privacy", "critical", patterns=(r"[a-z0-9._]+@[a-z0-9.]+[a-z]",)), d.Line("secret", "privacy", "critical", words=("password", "api_key")), d.Line("license", "law", "warning", words=("licensed under", "Released under"), patterns=("Copyright [0-9]{4}",)), d.Line("loud", "style", "info", patterns=("[A-Z]{6,}",)))
LINE_SQL = " UNION ALL ".join(f"SELECT doc_id, '{x.name}' AS rule, '{x.severity}' AS severity, '{p}' AS p FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '{p}')" for x in LINES for p in [*x.words, *x.patterns])


@query(
    "red_lines",
    f"""
    WITH RECURSIVE z AS ({LINE_SQL}), h AS (
      SELECT z.doc_id, rule, severity, p, text AS rest, CAST(0 AS BIGINT) AS base, CAST(NULL AS VARCHAR) AS matched, CAST(NULL AS BIGINT) AS position FROM z JOIN documents x ON z.doc_id = x.doc_id
      UNION ALL
      SELECT doc_id, rule, severity, p, substr(rest, strpos(rest, m) + length(m)), base + strpos(rest, m) - 1 + length(m), m, base + strpos(rest, m) - 1 FROM (SELECT *, regexp_extract(rest, p) AS m FROM h) q WHERE m <> ''
    )
    SELECT h.doc_id, rule, severity, matched, position, substr(x.text, greatest(position - 30, 0) + 1, length(matched) + 30 + least(position, 30)) AS context FROM h JOIN documents x ON h.doc_id = x.doc_id WHERE matched IS NOT NULL AND NOT (rule = 'loud' AND h.doc_id % 2 = 0)""",
)
def _(t):
    allowed = t.documents.where("doc_id % 2 = 0").select("doc_id", F.lit("loud").alias("rule"))
    return d.red_lines(t.documents, LINES, allowed=allowed)


HEAD = (d.Mark("conflict", "head", 300, "war|against|ores", 3), d.Mark("suspense", "head", 300, "what|who", 2), d.Mark("emotion", "head", 300, "love|heart|erth", 2), d.Mark("scenery", "head", 20, "^(?:the|an) ", -2))
TAIL = (d.Mark("question", "tail", 300, "what|who|[?]", 3), d.Mark("promise", "tail", 300, "will|wird|tion", 3), d.Mark("reversal", "tail", 300, "but|mais|aber", 2.5), d.Mark("danger", "tail", 300, "against|onre", 2))


def marks_sql(text: str, marks, base: float = 0.0) -> str:
    part = lambda m: text if m.part == "all" else f"{'left' if m.part == 'head' else 'right'}({text}, {m.chars})"
    return f"least(10e0, greatest(0e0, {base}e0 + " + " + ".join(f"CASE WHEN regexp_matches({part(m)}, '{m.pattern}') THEN {float(m.points)}e0 ELSE 0e0 END" for m in marks) + "))"


SAID = '"([^"\\n]+)"'
LINE = "least(10e0, greatest(0e0, 5e0 + CASE WHEN length(x) <= 15 THEN 2e0 WHEN length(x) <= 25 THEN 1e0 WHEN length(x) > 50 THEN -1e0 ELSE 0e0 END + CASE WHEN regexp_matches(x, 'oh|ah') THEN 1.5e0 ELSE 0e0 END - CASE WHEN regexp_matches(x, 'donc|aber') THEN 1.5e0 ELSE 0e0 END))"


@query(
    "reader_lens",
    f"""
    SELECT *, round(round(hook * 3 + dialogue * 2 + density * 2 + ending * 3, 6)) AS retention FROM (
      SELECT doc_id, CASE WHEN head_chars < 50 THEN 2e0 ELSE {marks_sql("t", HEAD)} END AS hook, round(round(coalesce(list_avg(list_transform(q, lambda x: {LINE})), 5e0), 9), 3) AS dialogue,
        CASE WHEN chars < 500 THEN 5e0 ELSE least(10e0, greatest(0e0, 5e0 + CASE WHEN rate >= 3 THEN 3e0 WHEN rate >= 1.5 THEN 1.5e0 WHEN rate < 0.5 THEN -2e0 ELSE 0e0 END - CASE WHEN water > 0.4e0 * len(paras) THEN 2e0 ELSE 0e0 END)) END AS density, {marks_sql("t", TAIL)} AS ending
      FROM (SELECT *, news / greatest(chars / 1000e0, 1e0) AS rate, len(list_filter(paras, lambda x: NOT regexp_matches(x, 'find|tion'))) AS water FROM (
        SELECT doc_id, t, {N("t", "[a-zà-ÿ]")} AS chars, {N("left(t, 300)", "[a-zà-ÿ]")} AS head_chars, regexp_extract_all(t, '{SAID}', 1) AS q, {N("t", "find|tion")} AS news, list_filter({parts_sql("t", chr(92) + "n")}, lambda x: length(x) > 30) AS paras FROM (SELECT doc_id, {LOW} AS t FROM documents) a) b) c) e""",
)
def _(t):
    return d.reader_lens(t.documents, HEAD, TAIL, SAID, "oh|ah", "donc|aber", "find|tion", "[a-zà-ÿ]")


@query("craft_lens", f"SELECT doc_id, {marks_sql('t', HEAD, 5.0)} AS opening, {marks_sql('t', TAIL)} AS ending, concat_ws(',', {', '.join(f'CASE WHEN regexp_matches(right(t, 300), {chr(39)}{m.pattern}{chr(39)}) THEN {chr(39)}{m.name}{chr(39)} END' for m in TAIL)}) AS hooks FROM (SELECT doc_id, {LOW} AS t FROM documents) a")
def _(t):
    return d.craft_lens(t.documents, TAIL, HEAD)


CLASSES = {"action": "ores|erth", "talk": "ouen|ent", "thought": "that|dass"}
TIMELINE = f"SELECT doc_id, i AS place, CASE WHEN regexp_matches(p, 'ores|erth') THEN 'action' WHEN regexp_matches(p, 'ouen|ent') THEN 'talk' WHEN regexp_matches(p, 'that|dass') THEN 'thought' ELSE 'none' END AS label FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, {parts_sql(LOW, chr(92) + 'n')} AS ps FROM documents) a) b"


@query("paragraph_timeline", TIMELINE)
def _(t):
    return d.paragraph_scan(t.documents, CLASSES)


@query("flat_streaks", f"SELECT doc_id, count(*) FILTER (WHERE run >= 3) AS streaks, max(run) AS longest FROM (SELECT doc_id, island, count(*) FILTER (WHERE label IN ('thought', 'none')) AS run FROM (SELECT *, sum(CASE WHEN label IN ('thought', 'none') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM ({TIMELINE}) t) x GROUP BY doc_id, island) y GROUP BY doc_id")
def _(t):
    return d.flat_streaks(d.paragraph_scan(t.documents, CLASSES), ("thought", "none"))


SHAPES = f"""
    SELECT doc_id, array_to_string(list_transform(c, lambda x: printf('%.3f', x)), ',') AS points, CASE WHEN list_max(c) = list_min(c) THEN 'flat' WHEN (CASE WHEN c[2] > c[1] AND c[2] > c[3] THEN 1 ELSE 0 END + CASE WHEN c[3] > c[2] AND c[3] > c[4] THEN 1 ELSE 0 END + CASE WHEN c[4] > c[3] AND c[4] > c[5] THEN 1 ELSE 0 END) >= 2 THEN 'wave'
      WHEN list_max(c) > c[1] AND list_max(c) > c[5] THEN 'peak' WHEN list_min(c) < c[1] AND list_min(c) < c[5] THEN 'valley' WHEN c[5] > c[1] THEN 'rising' ELSE 'falling' END AS shape
    FROM (SELECT doc_id, list_transform([0, 1, 2, 3, 4], lambda k: round(least(1e0, len(regexp_extract_all(array_to_string(list_slice(p, k * sz + 1, k * sz + sz), chr(10)), '[!?.]')) / greatest(len(regexp_extract_all(lower(array_to_string(list_slice(p, k * sz + 1, k * sz + sz), chr(10))), '[a-zà-ÿ]')) / 500e0, 0.1e0)), 6)) AS c
          FROM (SELECT doc_id, p, CAST(floor(len(p) / 5) AS BIGINT) AS sz FROM (SELECT doc_id, {paragraphs_sql(TEXT, f'length({TEXT})')} AS p FROM documents) a WHERE len(p) >= 5) b) c"""


@query("emotion_shape", SHAPES)
def _(t):
    return d.part_intensity(t.documents, "[!?.]", 5, "[a-zà-ÿ]")


@query(
    "goal_gate",
    f"""
    SELECT doc_id, concat_ws(',', CASE WHEN l THEN 'length' END, CASE WHEN p THEN 'pleasure' END, CASE WHEN e THEN 'curve' END) AS failed, CASE WHEN NOT l AND NOT p AND NOT e THEN 'pass' WHEN l AND p AND e THEN 'fail' ELSE 'retry' END AS result FROM (
      SELECT c.doc_id, {N(LOW, '[a-zà-ÿ]')} NOT BETWEEN 500 AND 4000 AS l, {N(LOW, 'tion|ment')} < CASE WHEN c.ch_num <= 3 THEN 5 ELSE 3 END AS p, c.ch_num <= 3 AND coalesce(s.shape, 'flat') <> 'rising' AS e FROM chapters c JOIN documents x ON c.doc_id = x.doc_id LEFT JOIN ({SHAPES}) s ON s.doc_id = c.doc_id) a""",
)
def _(t):
    shapes = d.part_intensity(t.documents, "[!?.]", 5, "[a-zà-ÿ]")
    return d.goal_gate(t.documents, shapes, d.default_goals(t.chapters, 500, 4000), "[a-zà-ÿ]", "tion|ment")


@query(
    "outline_deviation",
    f"""
    SELECT p.doc_id, len(w) AS n_words, len(list_filter(w, lambda x: contains({LOW}, x))) AS covered, round(len(list_filter(w, lambda x: contains({LOW}, x))) / greatest(len(w), 1), 3) AS ratio, array_to_string(list_filter(w, lambda x: NOT contains({LOW}, x)), ',') AS missing, len(w) > 0 AND len(list_filter(w, lambda x: contains({LOW}, x))) / greatest(len(w), 1) < 0.3 AS deviates
    FROM documents x JOIN (SELECT doc_id, list_filter(list_transform(generate_series(1, len(a)), lambda i: CASE WHEN list_position(a, a[i]) = i THEN a[i] END), lambda y: y IS NOT NULL)[:6] AS w FROM (SELECT c.doc_id, regexp_extract_all(lower(b.text), '[a-zà-ÿ]{{5,9}}') AS a FROM chapters c JOIN benchmark b ON b.item_id = c.ch_num) q) p ON x.doc_id = p.doc_id""",
)
def _(t):
    """The plan of a chapter: the first words of a reference passage with its number."""
    words = s.keywords(F.lower(F.regexp_replace("plan", '"', "")), most=6)
    plans = t.chapters.join(t.benchmark.select(F.col("item_id").alias("ch_num"), F.col("text").alias("plan")), "ch_num").select("doc_id", words.alias("words"))
    return d.coverage(t.documents, plans)


CANON = {"character": ("Thth", "Ouen", "Xanadu"), "rule": ("erth", "zzz")}


@query("canon_gaps", "SELECT book, kind, term FROM (" + " UNION ALL ".join(f"SELECT source AS book, '{k}' AS kind, '{x}' AS term, bool_or(contains({TEXT}, '{x}')) AS seen FROM documents GROUP BY source" for k, xs in CANON.items() for x in xs) + ") a WHERE NOT seen")
def _(t):
    return d.missing_terms(CANON, t.documents.select(F.col("source").alias("book"), "text"), "book")


FLATTERY = (("which.{0,20}good", "flattery", "HIGH"), ("whth", "summary", "LOW"))


@query("sycophancy", f"SELECT *, flags = 0 AND untagged = 0 AS passed FROM (SELECT doc_id, {N(TEXT, 'which.{0,20}good')} + {N(TEXT, 'whth')} AS flags, CAST(len(list_filter({parts_sql(TEXT, '[.!?' + chr(92) + 'n]+')}, lambda x: length(x) >= 10 AND regexp_matches(x, ' is | ist ') AND NOT regexp_matches(x, 'KNOWN'))) AS BIGINT) AS untagged FROM documents) a")
def _(t):
    return d.sycophancy(t.documents, FLATTERY, " is | ist ", "KNOWN", "[.!?\\n]+")


INTENTS = {"tension": "tension", "slow pace": "pacing", "dull talk": "dialogue", "ouen": "agency"}


@query("intents", f"""
    SELECT item_id, CASE WHEN contains(t, 'tension') THEN 'tension' WHEN contains(t, 'slow pace') THEN 'pacing' WHEN contains(t, 'dull talk') THEN 'dialogue' WHEN contains(t, 'ouen') THEN 'agency' WHEN best[1] >= 2 THEN ['tension', 'pacing', 'dialogue', 'agency'][-best[2] + 1] END AS dimension, CASE WHEN contains(t, 'tension') OR contains(t, 'slow pace') OR contains(t, 'dull talk') OR contains(t, 'ouen') THEN 'rule' WHEN best[1] >= 2 THEN 'partial' ELSE 'fallback' END AS source
    FROM (SELECT item_id, t, list_max([{", ".join(f"[{' + '.join(f'CASE WHEN contains(t, {chr(39)}{ch}{chr(39)}) THEN 1 ELSE 0 END' for ch in k)}, -{i}]" for i, k in enumerate(INTENTS))}]) AS best FROM (SELECT item_id, {LOW} AS t FROM benchmark) a) b""")
def _(t):
    return d.intents(t.benchmark, INTENTS, "item_id", "text")


TOPICS = {"forest": "erth|ouen", "city": "tion", "sea": "onre|ment"}


@query("topic_tags", f"""
    WITH l AS (SELECT doc_id, unnest(['forest', 'city', 'sea']) AS g, unnest([{", ".join(N(LOW, p) for p in TOPICS.values())}]) AS n FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS k, max(n) OVER (PARTITION BY doc_id) AS top FROM l WHERE n > 0)
    SELECT x.doc_id, max(g) FILTER (WHERE k = 1) AS top, coalesce(string_agg(g, ',' ORDER BY k) FILTER (WHERE n >= r.top * 0.2e0 AND k <= 3), '') AS tags FROM documents x LEFT JOIN r ON x.doc_id = r.doc_id GROUP BY x.doc_id""")
def _(t):
    return d.topic_tags(t.documents, TOPICS)


@query(
    "book_warnings",
    """
    WITH m AS (SELECT *, lag(conflict_density) OVER (PARTITION BY book ORDER BY ch_num) AS prev, avg(wc) OVER (PARTITION BY book) AS mean, ch_num - coalesce(max(CASE WHEN conflict_density >= 2 THEN ch_num END) OVER (PARTITION BY book ORDER BY ch_num), 0) AS run FROM metrics)
    SELECT book, ch_num, 'jump' AS warning FROM m WHERE prev < 2 AND conflict_density > 3 UNION ALL SELECT book, ch_num, 'long' FROM m WHERE wc > 1.5e0 * mean UNION ALL SELECT book, ch_num, 'low_streak' FROM m WHERE run >= 5""",
)
def _(t):
    return d.book_warnings(t.metrics, low=2.0, high=3.0)


PHRASES = {"whth": "whth", "good_old": "good|bien", "erth": "erth"}


@query("cliches", "SELECT book, phrase, round(round(c, 9), 3) AS coverage, CASE WHEN round(c, 9) >= 0.4 THEN 'high' WHEN round(c, 9) >= 0.2 THEN 'medium' ELSE 'low' END AS level FROM (" + " UNION ALL ".join(f"SELECT source AS book, '{n}' AS phrase, avg(CASE WHEN regexp_matches({LOW}, '{p}') THEN 1e0 ELSE 0e0 END) AS c FROM documents GROUP BY source" for n, p in PHRASES.items()) + ") a WHERE c >= 0.1")
def _(t):
    return d.cliches(t.documents.select(F.col("source").alias("book"), "text"), PHRASES, "book")


@query(
    "platform_compliance",
    f"""
    WITH e AS (SELECT c.book, c.ch_num, {N(LOW, '[a-zà-ÿ]')} AS n, regexp_matches(right({LOW}, 300), 'what|who|but') AS hook, {N(LOW, 'ores|erth')} AS hits FROM chapters c JOIN documents x ON c.doc_id = x.doc_id),
    f AS (SELECT *, CASE WHEN n < 100 THEN 0e0 ELSE round(round(least(hits / (n / 100e0), 1e0), 9), 3) END AS d FROM e), g AS (SELECT *, sum(CASE WHEN d = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY book ORDER BY ch_num) AS i FROM f WHERE ch_num <= 10),
    s AS (SELECT book, max(run) AS zero_streak FROM (SELECT book, i, count(*) FILTER (WHERE d = 0) AS run FROM g GROUP BY book, i) q GROUP BY book), t AS (SELECT book, round(avg(CASE WHEN hook THEN 1e0 ELSE 0e0 END), 9) AS hook_rate, round(avg(d), 9) AS conflict, count(*) AS m FROM g GROUP BY book), a AS (SELECT book, CAST(sum(n) AS BIGINT) AS letters FROM f GROUP BY book)
    SELECT *, CASE WHEN probability >= 60 THEN 'green' WHEN probability >= 40 THEN 'yellow' ELSE 'red' END AS risk FROM (SELECT a.book, letters, hook_rate, conflict, zero_streak, CAST(greatest(0, 100 - CASE WHEN letters < 80000 THEN 30 WHEN letters >= 150000 THEN 20 WHEN letters > 140000 THEN 10 ELSE 0 END - CASE WHEN m >= 10 AND hook_rate < 0.6 THEN 15 ELSE 0 END - CASE WHEN m >= 10 AND conflict < 0.4 THEN 15 ELSE 0 END) AS BIGINT) AS probability FROM a JOIN t ON a.book = t.book JOIN s ON a.book = s.book) z""",
)
def _(t):
    return d.platform_compliance(t.chapters.join(t.documents.select("doc_id", "text"), "doc_id"), "what|who|but", "ores|erth", "[a-zà-ÿ]")


@query("null_audit", "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}_nulls" for c in ("doc_id", "text", "lang", "source")) + ", count(*) AS n, min(n_chars) AS min_chars, max(n_chars) AS max_chars FROM documents")
def _(t):
    return t.documents.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in ("doc_id", "text", "lang", "source")], F.count("*").alias("n"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"))
