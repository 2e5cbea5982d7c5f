"""Style of the documents' texts, with SQL of its own."""

from pyspark.sql import functions as F

from storyloom.functions.style import COMPARED, LATIN_FLAVOUR, LATIN_STYLE
from storyloom.operators import style as s
from storyloom.plans.corpus import parts_sql
from storyloom.plans.registry import Catalog, Tables

query = Catalog()

P = LATIN_STYLE
N = lambda text, p: f"CAST(len(regexp_extract_all({text}, '{p}')) AS BIGINT)"
WORDS = lambda text, ws: " + ".join(f"CAST((length({text}) - length(replace({text}, '{w}', ''))) / {len(w)} AS BIGINT)" for w in ws)
SENTENCES = f"list_filter({parts_sql('low', f'[{P.ends}{chr(92)}n]+')}, lambda x: length(x) >= 2)"
BLOCKS = parts_sql("low", r"\n[ \t\n\r\f\x{0B}]*\n")
D2 = lambda n: f"round(round({n} / kilo, 9), 2)"
DNA = f"""
    SELECT *, round(round(irony_density * 0.3e0 + self_mockery_density * 0.4e0 + dark_density * 0.3e0, 9), 2) AS humour_total, CASE WHEN first_person_ratio > 0.6 THEN 'first' WHEN first_person_ratio > 0.3 THEN 'mixed' ELSE 'third' END AS perspective FROM (
      SELECT doc_id, chars AS total_chars, CASE WHEN chars >= 50 THEN len(ls) ELSE 0 END AS sentence_count, CASE WHEN chars >= 50 THEN len(lp) ELSE 0 END AS paragraph_count,
        CASE WHEN chars >= 50 AND len(ls) > 0 THEN round(round(list_avg(ls), 9), 1) ELSE 0e0 END AS avg_sentence_length, CASE WHEN chars >= 50 AND len(ls) > 1 THEN round(round(list_aggregate(ls, 'stddev_samp'), 9), 1) ELSE 0e0 END AS sentence_length_std,
        CASE WHEN chars >= 50 THEN round((chars - told_chars) / greatest(chars, 1), 3) ELSE 0e0 END AS dialogue_ratio, CASE WHEN chars >= 50 THEN round(described / greatest(len(lp), 1), 3) ELSE 0e0 END AS description_density,
        CASE WHEN chars >= 50 THEN round(len(list_filter(ls, lambda x: x <= 12)) / greatest(len(ls), 1), 3) ELSE 0e0 END AS short_sentence_ratio, CASE WHEN chars >= 100 THEN round(distinct_letters / greatest(chars, 1), 4) ELSE 0e0 END AS vocab_richness,
        {", ".join(f"CASE WHEN chars >= 100 THEN {D2(n)} ELSE 0e0 END AS {d}" for n, d in (("idioms", "idiom_density"), ("slangs", "slang_density"), ("fingerprints", "fingerprint_density"), ("doubles", "doubled_density"), ("monologues", "monologue_density"), ("omniscients", "omniscient_density")))},
        CASE WHEN chars >= 50 AND len(lp) > 0 THEN round(round(list_avg(lp), 9), 1) ELSE 0e0 END AS avg_paragraph_length, CASE WHEN chars >= 50 AND len(lp) > 1 THEN round(round(list_aggregate(lp, 'stddev_samp'), 9), 1) ELSE 0e0 END AS paragraph_length_std,
        {", ".join(f"CASE WHEN chars >= 50 THEN {D2(n)} ELSE 0e0 END AS {d}" for n, d in (("scenes", "scene_density"), ("ironies", "irony_density"), ("mockeries", "self_mockery_density"), ("darks", "dark_density")))},
        CASE WHEN chars >= 100 THEN round(round(CASE WHEN f1 + t1 > 0 THEN f1 / (f1 + t1) WHEN f2 + t2 > 0 THEN f2 / (f2 + t2) ELSE 0e0 END, 9), 3) ELSE 0e0 END AS first_person_ratio
      FROM (
        SELECT *, greatest(chars / 1000e0, 1e0) AS kilo FROM (
          SELECT doc_id, {N("low", P.letters)} AS chars, {N("told", P.letters)} AS told_chars, list_transform({SENTENCES}, lambda x: CAST(len(regexp_extract_all(x, '{P.letters}')) AS DOUBLE)) AS ls, list_transform({BLOCKS}, lambda x: CAST(len(regexp_extract_all(x, '{P.letters}')) AS DOUBLE)) AS lp,
            len(list_filter({BLOCKS}, lambda x: regexp_matches(left(x, 10), '{P.description}'))) AS described, len(list_distinct(regexp_extract_all(low, '{P.letters}'))) AS distinct_letters,
            {", ".join(f"{N('low', p)} AS {n}" for n, p in (("idioms", P.idiom), ("slangs", P.slang), ("doubles", P.doubled), ("scenes", P.scene), ("ironies", P.irony), ("mockeries", P.self_mockery), ("darks", P.dark), ("monologues", P.monologue), ("omniscients", P.omniscient)))}, {WORDS("low", P.fingerprints)} AS fingerprints,
            {N("told", P.first)} AS f1, {N("told", P.third)} AS t1, {N("low", P.first)} AS f2, {N("low", P.third)} AS t2
          FROM (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_replace(lower(coalesce(text, '')), '{P.dialogue}', '', 'g') AS told FROM documents) a) b) c) d"""


@query("style_dna", DNA)
def _(t):
    return s.style_dna(t.spread("documents"))


BASE = ", ".join(f"round(round(avg({m}), 9), 3) AS {m}" for m in s.METRICS)
BASELINE = f"SELECT a.*, b.perspective FROM (SELECT source, {BASE}, CAST(sum(total_chars) AS BIGINT) AS total_chars FROM z GROUP BY source) a JOIN (SELECT source, perspective FROM (SELECT source, perspective, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, perspective) AS k FROM z GROUP BY source, perspective) x WHERE k = 1) b ON a.source = b.source"
WITH = f"WITH z AS MATERIALIZED (SELECT x.*, o.source FROM ({DNA}) x JOIN documents o ON x.doc_id = o.doc_id)"


def dna(t: Tables):
    return s.style_dna(t.documents).join(t.documents.select("doc_id", "source"), "doc_id")


@query("dna_baseline", f"{WITH} {BASELINE}")
def _(t):
    return s.dna_baseline(dna(t), ["source"])


PCT = lambda m: f"CASE WHEN b.{m} = 0 AND a.{m} = 0 THEN 0e0 WHEN b.{m} = 0 THEN 100e0 ELSE round(abs(a.{m} - b.{m}) / abs(b.{m}) * 100, 9) END"
DEVIATIONS = " UNION ALL ".join(f"SELECT a.doc_id, '{d}' AS dimension, '{m}' AS metric, CAST(b.{m} AS DOUBLE) AS target, CAST(a.{m} AS DOUBLE) AS current, round({PCT(m)}, 1) AS diff_pct, CASE WHEN {PCT(m)} >= {serious} THEN 'serious' WHEN {PCT(m)} >= {warn} THEN 'warning' ELSE 'ok' END AS severity, {w}e0 AS weight FROM z a JOIN base b ON a.source = b.source" for d, m, w, warn, serious in COMPARED)


@query("dna_deviations", f"{WITH}, base AS ({BASELINE}) {DEVIATIONS}")
def _(t):
    d = dna(t)
    return s.dna_deviations(s.dna_baseline(d, ["source"]), d, "doc_id", ["source"])


@query(
    "dna_consistency",
    f"""
    {WITH}, base AS ({BASELINE}), dev AS MATERIALIZED ({DEVIATIONS}), dims AS (SELECT doc_id, dimension, round(round(sum(diff_pct * weight) / greatest(sum(weight), 1), 9), 1) AS d, sum(weight) AS w FROM dev GROUP BY doc_id, dimension),
    c AS (SELECT doc_id, round(round(greatest(0, 100 - sum(d * w) / greatest(sum(w), 1)), 9), 1) AS consistency FROM dims GROUP BY doc_id),
    i AS (SELECT doc_id, string_agg(metric, ',' ORDER BY k) AS issues FROM (SELECT doc_id, metric, row_number() OVER (PARTITION BY doc_id ORDER BY diff_pct DESC, metric) AS k FROM dev WHERE severity <> 'ok') x WHERE k <= 5 GROUP BY doc_id)
    SELECT c.doc_id, consistency, CASE WHEN consistency >= 85 THEN 'A' WHEN consistency >= 70 THEN 'B' WHEN consistency >= 55 THEN 'C' ELSE 'D' END AS grade, coalesce(issues, '') AS issues FROM c LEFT JOIN i ON c.doc_id = i.doc_id""",
)
def _(t):
    d = dna(t)
    return s.dna_consistency(s.dna_deviations(s.dna_baseline(d, ["source"]), d, "doc_id", ["source"]), "doc_id")


CHARS = r"(SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\x{0B}]', '', 'g'), ''), lambda x: x <> '') AS s FROM documents)"
UNI = f"""
    SELECT doc_id, CASE WHEN sum(n) < 10 THEN 0e0 ELSE round(round(pow(2, -sum(n / t * log2(n / t))), 6), 2) END AS perplexity
    FROM (SELECT doc_id, n, sum(n) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(s) AS c FROM {CHARS} a) b GROUP BY doc_id, c) d) e GROUP BY doc_id"""


@query("unigram_perplexity", UNI)
def _(t):
    return s.unigram_perplexity(t.documents)


BI = f"""
    WITH p AS (SELECT doc_id, unnest(list_zip(s[:-2], s[2:])) AS g FROM {CHARS} a WHERE len(s) > 1), b AS (SELECT doc_id, g[1] AS a, count(*) AS n FROM p GROUP BY doc_id, g), u AS (SELECT doc_id, c AS a, count(*) AS m FROM (SELECT doc_id, unnest(s) AS c FROM {CHARS} a) x GROUP BY doc_id, c), tt AS (SELECT doc_id, sum(m) AS t FROM u GROUP BY doc_id)
    SELECT b.doc_id, CASE WHEN any_value(t) < 20 THEN 0e0 ELSE round(round(pow(2, sum(-log2((n / (t - 1)) / (m / t)) * n) / (any_value(t) - 1)), 6), 2) END AS perplexity FROM b JOIN u ON b.doc_id = u.doc_id AND b.a = u.a JOIN tt ON b.doc_id = tt.doc_id GROUP BY b.doc_id"""


@query("bigram_perplexity", BI)
def _(t):
    return s.bigram_perplexity(t.documents)


PARTS = parts_sql("coalesce(text, '')", r"[.!?\n]+")
LAYERS = f"""
    SELECT doc_id, len(s) AS n, CASE WHEN len(s) >= 3 AND list_avg(l) >= 1 THEN round(round(list_aggregate(l, 'stddev_pop') / list_avg(l), 9), 4) ELSE 0e0 END AS burstiness,
      CASE WHEN len(s3) >= 5 THEN round(list_max(list_transform(map_values(list_histogram(list_transform(s3, lambda x: left(x, 3)))), lambda x: x)) / len(s3), 4) ELSE 0e0 END AS top_prefix,
      CASE WHEN len(sets) >= 3 THEN round(round(list_avg(list_transform(list_zip(sets[:-2], sets[2:]), lambda p: len(list_intersect(p[1], p[2])) / len(list_distinct(list_concat(p[1], p[2]))))), 9), 4) ELSE 0e0 END AS overlap
    FROM (SELECT doc_id, s, list_transform(s, lambda x: CAST(length(x) AS DOUBLE)) AS l, list_filter(s, lambda x: length(x) > 2) AS s3, list_transform(list_filter(s, lambda x: length(x) > 5), lambda x: list_distinct(string_split(x, ''))) AS sets FROM (SELECT doc_id, {PARTS} AS s FROM documents) a) b"""


@query("sentence_layers", LAYERS.replace("list_histogram(list_transform(s3, lambda x: left(x, 3)))", "list_aggregate(list_transform(s3, lambda x: left(x, 3)), 'histogram')"))
def _(t):
    return s.sentence_layers(t.documents)


RISKS = {"high": ("which", "whth"), "medium": ("that", "dass"), "low": ("with", "donc")}
FP = f"""
    SELECT doc_id, high + medium + low AS total, high AS high_risk, round(round((high + medium + low) / greatest(chars / 1000e0, 1e0), 9), 2) AS density, round(round(least(1e0, (high + medium + low) / greatest(chars, 1) / 0.01e0), 9), 3) AS rate
    FROM (SELECT doc_id, length(translate(t, chr(10) || ' ', '')) AS chars, {", ".join(f"{WORDS('t', w)} AS {k}" for k, w in RISKS.items())} FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '"[^"\\n]*"', '', 'g') AS t FROM documents) a) b"""


@query("fingerprint_density", FP)
def _(t):
    return s.fingerprint_density(t.documents, RISKS)


@query(
    "style_layers",
    f"""
    SELECT doc_id, flags, CASE WHEN flags = 0 THEN 'pass' WHEN flags <= 2 THEN 'warning' ELSE 'fail' END AS verdict FROM (
      SELECT l.doc_id, CAST(coalesce(u.perplexity > 0 AND u.perplexity <= 40, false) AS BIGINT) + CAST(n >= 3 AND burstiness <= 0.6 AS BIGINT) + CAST(coalesce(f.density > 2, false) AS BIGINT) + CAST(n >= 3 AND burstiness <= 0.3 AS BIGINT) + CAST(top_prefix >= 0.4 AS BIGINT) + CAST(overlap > 0 AND NOT (overlap > 0.2 AND overlap < 0.85) AS BIGINT) + CAST(coalesce(b.perplexity > 0 AND b.perplexity <= 5, false) AS BIGINT) AS flags
      FROM ({LAYERS.replace("list_histogram(list_transform(s3, lambda x: left(x, 3)))", "list_aggregate(list_transform(s3, lambda x: left(x, 3)), 'histogram')")}) l LEFT JOIN ({UNI}) u ON l.doc_id = u.doc_id LEFT JOIN ({BI}) b ON l.doc_id = b.doc_id LEFT JOIN ({FP}) f ON l.doc_id = f.doc_id) z""",
)
def _(t):
    d = t.documents
    return s.style_layers(s.unigram_perplexity(d), s.bigram_perplexity(d), s.sentence_layers(d), s.fingerprint_density(d, RISKS))


F_ = LATIN_FLAVOUR
NATURAL = f"(CASE WHEN length(x) <= 15 THEN 30 WHEN length(x) <= 25 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(x, '{F_.particles}') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(x, '[，…\\.]{{2,}}') THEN 15 ELSE 0 END + CASE WHEN NOT regexp_matches(x, '^.{{20,}}[{F_.ends}]\\z') THEN 10 ELSE 0 END + CASE WHEN NOT regexp_matches(x, '{F_.connectives}') THEN 10 ELSE 0 END) / 100e0"
FLAVOUR_PARTS = parts_sql("t", rf"[{F_.ends}\n]")


@query(
    "human_flavour",
    f"""
    SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade FROM (
      SELECT doc_id, naturalness, sensory, restraint, variety, life, penalty, round(round(least(100e0, greatest(0e0, 50 + (naturalness + sensory + restraint + variety + life) / 5 * 50 - penalty)), 6)) AS score FROM (
        SELECT *, round(least(transitions * 3, 30) + least(descriptions * 5, 25) + CASE WHEN perfect THEN 15 ELSE 0 END + CASE WHEN preach > 0.3 THEN least(preach * 20, 20e0) ELSE 0e0 END, 6) AS penalty FROM (
          SELECT doc_id, transitions, descriptions, coalesce(round(round(list_avg(list_transform(lines, lambda x: {NATURAL})), 9), 3), 0) AS naturalness, CASE WHEN chars >= 100 THEN round(round(least(sensory / k / 5, 1e0), 9), 3) ELSE 0e0 END AS sensory, CASE WHEN chars >= 100 THEN round(round(greatest(0e0, 1 - direct / k / 3), 9), 3) ELSE 0e0 END AS restraint,
            CASE WHEN len(l) >= 5 AND list_avg(l) > 0 THEN round(round(least(list_aggregate(l, 'stddev_samp') / list_avg(l) / 0.5e0, 1e0), 9), 3) ELSE 0e0 END AS variety, CASE WHEN chars >= 100 THEN round(round(least(life / k / 2, 1e0), 9), 3) ELSE 0e0 END AS life, chars < 100 OR round(mistakes / k, 9) < 0.5 AS perfect, CASE WHEN chars >= 100 THEN round(round(preaching / k, 9), 2) ELSE 0e0 END AS preach
          FROM (SELECT *, chars / 1000e0 AS k FROM (SELECT doc_id, {N("t", F_.letters)} AS chars, {WORDS("t", F_.banned_transitions)} AS transitions, {WORDS("t", F_.banned_descriptions)} AS descriptions, {", ".join(f"{N('t', p)} AS {n}" for n, p in (("mistakes", F_.mistakes), ("preaching", F_.preaching), ("sensory", F_.sensory), ("direct", F_.direct_emotion), ("life", F_.life)))},
            regexp_extract_all(t, '{F_.line}', 1) AS lines, list_transform(list_filter({FLAVOUR_PARTS}, lambda x: length(x) >= 5), lambda x: CAST(length(x) AS DOUBLE)) AS l FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) a) b) c) d) e) f""",
)
def _(t):
    return s.human_flavour(t.documents)


@query("gradient_validation", "SELECT user_id, event_id, round(round(exp(sum(ln(greatest(1 - error, 1e-12))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)), 9), 6) AS cumulative FROM (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 0.05e0 ELSE 0.01e0 END AS error FROM events) a")
def _(t):
    steps = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "error", 0.05).otherwise(0.01).alias("error"))
    return s.gradient_validation(steps, "error", "user_id", ["event_id"]).select("user_id", "event_id", "cumulative")


@query(
    "top_ngrams",
    """
    SELECT doc_id, gram, n, place FROM (SELECT doc_id, gram, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) AS place FROM (
      SELECT doc_id, substr(w, i, k) AS gram FROM (SELECT doc_id, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-zà-ÿ]+')) AS w FROM documents) a CROSS JOIN (SELECT unnest([2, 3, 4]) AS k) b WHERE length(w) >= k) c) d
      WHERE gram NOT IN ('th', 'he') GROUP BY doc_id, gram HAVING count(*) >= 2) e WHERE place <= 20""",
)
def _(t):
    return s.top_ngrams(t.documents, skip=("th", "he"))
