"""Books against pools of books, with SQL of their own."""

from pyspark.sql import functions as F

from storyloom.operators import scoring as s
from storyloom.operators.sequence import longest_run
from storyloom.plans.registry import Catalog, Tables
from storyloom.queries.sequence import STREAKS, VARIED

query = Catalog()

DIMS = ("hook_density", "conflict_density", "pleasure_intensity", "dialogue_ratio", "readability", "avg_sentence_len")
M9 = lambda c: f"round(avg({c}), 9)"


@query(
    "book_summary",
    f"""
    SELECT book, count(*) AS n_chapters, CAST(sum(wc) AS BIGINT) AS total_wc, {", ".join(f"round({M9(c)}, 3) AS avg_{c}" for c in ("pleasure_intensity", "hook_density", "conflict_density", "readability", "dialogue_ratio"))},
      round(round(avg(CASE WHEN conflict THEN 1e0 ELSE 0e0 END), 9), 3) AS conflict_rate, {", ".join(f"count(*) FILTER (WHERE pleasure_type = '{k}') AS n_{k}" for k in ("climax", "major", "minor"))},
      count(*) FILTER (WHERE pace = 'fast') AS n_fast, count(*) FILTER (WHERE hook_type = 'none') AS n_hookless, count(*) FILTER (WHERE slap_noise) AS n_noise
    FROM metrics GROUP BY book""",
)
def _(t):
    return s.book_summary(t.metrics)


KINDS = ("pace", "emotion", "conflict_level", "pleasure_type", "dominant_sub")


@query("book_distributions", "SELECT book, kind, label, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT book, '{k}' AS kind, {k} AS label FROM metrics" for k in KINDS) + ") a GROUP BY book, kind, label")
def _(t):
    return s.distributions(t.metrics, KINDS)


STATS = f"""
    SELECT a.*, coalesce(b.streak, 0) AS zero_hook_streak FROM (
      SELECT book, count(*) AS total_ch, round({M9('hook_density')}, 3) AS avg_hook, round({M9('conflict_density')}, 3) AS avg_conflict, round({M9('pleasure_intensity')}, 3) AS avg_pleasure, round({M9('ch_variability')}, 1) AS ch_variability_mean FROM ({VARIED}) v GROUP BY book) a
    LEFT JOIN (SELECT book, max(run) AS streak FROM ({STREAKS.format(where='hook_density = 0')}) r GROUP BY book) b ON a.book = b.book"""


@query("rhythm_stats", STATS)
def _(t):
    return s.rhythm_stats(t.metrics)


LONG = " UNION ALL ".join(f"SELECT book, '{d}' AS dim, {M9(d)} AS value FROM metrics GROUP BY book HAVING count(*) >= 5" for d in DIMS)
BENCH = f"SELECT dim, {', '.join(f'round(round(quantile_cont(value, {q / 100}), 9), 4) AS p{q}' for q in (10, 25, 50, 75, 90))}, round(round(avg(value), 9), 4) AS mean, round(round(stddev_samp(value), 9), 4) AS std, count(*) AS n FROM ({LONG}) x GROUP BY dim HAVING count(*) >= 3"


@query("pool_percentiles", BENCH)
def _(t):
    return s.benchmark(s.book_dims(t.metrics))


SCORED = f"""
    SELECT book, dim, value, p25, round(round(value - p50, 9), 4) AS gap, weight, round(round(least(CASE WHEN up THEN CASE WHEN value <= p10 THEN 0e0
          WHEN value <= p25 THEN CASE WHEN p25 > p10 THEN 6.25e0 * (value - p10) / greatest(p25 - p10, 0.001e0) ELSE 6.25e0 END
          WHEN value <= p50 THEN 6.25e0 + 6.25e0 * (value - p25) / greatest(p50 - p25, 0.001e0) WHEN value <= p75 THEN 12.5e0 + 6.25e0 * (value - p50) / greatest(p75 - p50, 0.001e0)
          WHEN value <= p90 THEN 18.75e0 + 3.75e0 * (value - p75) / greatest(p90 - p75, 0.001e0) ELSE 25e0 END
        ELSE CASE WHEN d <= 0.5e0 THEN 25e0 WHEN d <= 1 THEN 18.75e0 WHEN d <= 2 THEN 12.5e0 WHEN d <= 3 THEN 6.25e0 ELSE 0e0 END END, 25e0), 9), 2) AS score,
      CASE WHEN up THEN CASE WHEN value >= p90 THEN 'P90+' WHEN value >= p75 THEN 'P75-P90' WHEN value >= p50 THEN 'P50-P75' WHEN value >= p25 THEN 'P25-P50' WHEN value >= p10 THEN 'P10-P25' ELSE '<P10' END END AS rank, up AND value < p25 AS weak
    FROM (SELECT v.book, v.dim, v.value, b.p10, b.p25, b.p50, b.p75, b.p90, v.dim IN ('hook_density', 'conflict_density', 'pleasure_intensity') AS up, CASE WHEN v.dim IN ('hook_density', 'conflict_density', 'pleasure_intensity') THEN 1e0 ELSE 0.5e0 END AS weight,
            round(abs(value - p50) / greatest(CASE WHEN p75 > p25 THEN p75 - p25 ELSE abs(p75) * 0.2e0 + 0.1e0 END, 0.001e0), 9) AS d
          FROM ({LONG}) v JOIN ({BENCH}) b ON v.dim = b.dim) z"""


@query("dimension_scores", SCORED)
def _(t):
    v = s.book_dims(t.metrics)
    return s.scored_dims(v, s.benchmark(v))


@query(
    "signing_probability",
    f"""
    SELECT book, p AS probability, CASE WHEN p >= 75 THEN 'near' WHEN p >= 50 THEN 'fair' WHEN p >= 25 THEN 'partly' ELSE 'far' END AS label, weak FROM (
      SELECT book, round(round(sum(score * weight) / sum(weight) / 25 * 100, 9), 1) AS p, coalesce(string_agg(dim, ',' ORDER BY k) FILTER (WHERE weak AND k <= 3), '') AS weak
      FROM (SELECT *, row_number() OVER (PARTITION BY book, weak ORDER BY round(p25 - value, 4) DESC, dim) AS k FROM ({SCORED}) y) x GROUP BY book) w""",
)
def _(t):
    v = s.book_dims(t.metrics)
    return s.signing_probability(s.scored_dims(v, s.benchmark(v)))


@query("nearest_rank", "SELECT book, " + ", ".join(f"max(CASE WHEN k = least(floor(n * {p}e0), n - 1) + 1 THEN pleasure_intensity END) AS p{int(100 * p)}" for p in (0.25, 0.5, 0.75)) + " FROM (SELECT book, pleasure_intensity, row_number() OVER (PARTITION BY book ORDER BY pleasure_intensity, ch_num) AS k, count(*) OVER (PARTITION BY book) AS n FROM metrics) a GROUP BY book")
def _(t):
    """The value at place int(n p) of the sorted values."""
    sorted_ = t.metrics.groupBy("book").agg(F.sort_array(F.collect_list("pleasure_intensity")).alias("v"))
    return sorted_.select("book", *[F.element_at("v", (F.least(F.floor(F.size("v") * p), F.size("v") - 1) + 1).cast("int")).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)])


DIVERSITY = """
    SELECT book, count(*) AS unique_types, CASE WHEN count(*) > 1 THEN round(round(-sum(p * ln(p)) / ln(count(*)), 9), 3) ELSE 0e0 END AS diversity
    FROM (SELECT book, dominant_sub, count(*) / CAST(sum(count(*)) OVER (PARTITION BY book) AS DOUBLE) AS p FROM metrics WHERE dominant_sub <> 'none' GROUP BY book, dominant_sub) a GROUP BY book"""


@query("shannon_diversity", DIVERSITY)
def _(t):
    return s.diversity(t.metrics)


LEVELLED = f"""
    SELECT *, CASE WHEN climax = 1 AND round(near, 6) >= 6 THEN 'large' WHEN major = 1 AND round(near, 6) >= 4 AND slaps >= 3 THEN 'medium' WHEN slaps >= 1 OR pleasure_intensity >= 2 THEN 'small' ELSE 'none' END AS pleasure_level
    FROM (SELECT *, avg(pleasure_intensity) OVER w AS near, max(CASE WHEN pleasure_type = 'climax' THEN 1 ELSE 0 END) OVER w AS climax, max(CASE WHEN pleasure_type = 'major' THEN 1 ELSE 0 END) OVER w AS major, sum(slap_count) OVER w AS slaps
          FROM ({VARIED}) v WINDOW w AS (PARTITION BY book ORDER BY ch_num ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) a"""
FEATURES = f"""
    SELECT a.*, d.unique_types, d.diversity FROM (
      SELECT book, count(*) AS n, {", ".join(f"round(avg({c}) FILTER (WHERE ch_num <= 3), 9) AS {n}" for c, n in (("hook_density", "hook"), ("conflict_density", "conflict"), ("pleasure_intensity", "intensity"), ("pos_density", "pos")))}, {M9("readability")} AS readability,
        round(sum(slap_count) FILTER (WHERE ch_num <= 30) / least(count(*), 30), 9) AS slap_rate, {", ".join(f"round(avg(CASE WHEN hook_type = '{k}' THEN 1e0 ELSE 0e0 END), 9) AS {k}_rate" for k in ("reversal", "suspense"))}, round(avg(CASE WHEN pleasure_level = 'large' THEN 1e0 ELSE 0e0 END), 9) AS large_rate,
        round(avg(dialogue_ratio) FILTER (WHERE ch_num <= 30), 9) AS dialogue, round(avg(avg_para_len) FILTER (WHERE ch_num <= 30), 9) AS para_len, round(avg(vocab_diversity) FILTER (WHERE vocab_diversity > 0), 9) AS vocab, round(avg(CASE WHEN hook_density > 0 THEN 1e0 ELSE 0e0 END) * 100, 9) AS hook_coverage,
        round(avg(ch_variability) FILTER (WHERE ch_variability > 0), 9) AS varied
      FROM ({LEVELLED}) l GROUP BY book HAVING count(*) >= 10) a JOIN ({DIVERSITY}) d ON a.book = d.book"""


@query("opening_features", FEATURES)
def _(t):
    return s.opening_features(t.metrics)


MEANS = "SELECT book, round(avg(pleasure_intensity), 6) AS v FROM metrics GROUP BY book"


def shrunk(rank: str, n: str) -> str:
    return f"CASE WHEN {n} < 3 THEN 50e0 WHEN {n} < 30 THEN round(round(50 + (round(({rank} - 0.5e0) / {n} * 100) - 50) * {n} / 30e0, 9)) ELSE round(({rank} - 0.5e0) / {n} * 100) END"


def means(t: Tables):
    return t.metrics.groupBy("book").agg(F.round(F.avg("pleasure_intensity"), 6).alias("v"))


@query("percentile_score", f"SELECT a.book, a.v, {shrunk('count(*) FILTER (WHERE b.v <= a.v)', 'count(*)')} AS score FROM ({MEANS}) a CROSS JOIN ({MEANS}) b GROUP BY a.book, a.v")
def _(t):
    return s.percentile_score(means(t), "v")


@query("leave_one_out", f"SELECT a.book, a.v, round(round(avg(b.v), 9), 4) AS others, round(round(a.v - avg(b.v), 9), 4) AS gap FROM ({MEANS}) a JOIN ({MEANS}) b ON a.book <> b.book GROUP BY a.book, a.v")
def _(t):
    return s.leave_one_out(means(t), "v")


def labels(t: Tables):
    """Readers' scores of chapters, as the given labels have them."""
    return t.chapters.join(t.labels, "doc_id").select("book", "ch_num", (4.0 + 5 * F.col("quality")).alias("retention"), (1.0 + 3 * F.col("quality") + F.col("toxic")).alias("intensity"))


LABELS = "SELECT c.book, c.ch_num, 4e0 + 5 * l.quality AS retention, 1e0 + 3 * l.quality + l.toxic AS intensity FROM chapters c JOIN labels l ON c.doc_id = l.doc_id"


def ranked(value: str) -> str:
    return shrunk(f"count(*) OVER (ORDER BY {value} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "count(*) OVER ()")


COMMERCIAL = f"""
    WITH f AS (
      SELECT f.*, o.top_share, coalesce(g.llm_retention, least(10e0, greatest(1e0, round(round((hook * 3 + conflict * 3 + pos * 2) / 8 * 10, 9), 1)))) AS retention, coalesce(g.llm_intensity, f.intensity) AS avg_intensity
      FROM ({FEATURES}) f JOIN (SELECT book, sum(n) FILTER (WHERE r <= 2) / sum(n) AS top_share FROM (SELECT book, n, row_number() OVER (PARTITION BY book ORDER BY n DESC, dominant_sub) AS r FROM (SELECT book, dominant_sub, count(*) AS n FROM metrics GROUP BY book, dominant_sub) x) y GROUP BY book) o ON f.book = o.book
      LEFT JOIN (SELECT book, round(avg(retention), 9) AS llm_retention, round(avg(intensity), 9) AS llm_intensity FROM ({LABELS}) l WHERE ch_num <= 30 GROUP BY book) g ON f.book = g.book
    ), p AS (
      SELECT *, {ranked("avg_intensity")} AS p_intensity, {ranked("hook")} AS p_hook, {ranked("retention")} AS p_retention, {ranked("conflict")} AS p_conflict, {ranked("diversity")} AS p_diversity, {ranked("hook_coverage")} AS p_coverage FROM f
    ), q AS (
      SELECT *, round(round(p_intensity * 0.35e0 + p_hook * 0.3e0 + p_retention * 0.1e0 + p_conflict * 0.25e0, 6)) AS signing, round(round(p_retention * 0.4e0 + p_intensity * 0.25e0 + 10e0 + p_coverage * 0.15e0, 6)) AS keeping,
        dialogue > 0.4 AND hook < 1.5 AND coalesce(vocab, 0.2) > 0.2 AS slow_burn FROM p
    ), r AS (
      SELECT *, round(round(CASE WHEN slow_burn THEN signing * 0.4e0 + keeping * 0.6e0 ELSE signing * 0.5e0 + keeping * 0.5e0 END, 6)) AS raw FROM q
    ), o AS (
      SELECT *, round(round(raw * greatest(0.7e0, 1 - 0.05e0 * (CASE WHEN coalesce(vocab, 0.2) < 0.18 AND raw < 85 THEN 1 ELSE 0 END + CASE WHEN top_share > 0.55 AND hook < 1.5 AND NOT slow_burn THEN 1 ELSE 0 END + CASE WHEN coalesce(varied, 0) < 0.1 AND n > 50 THEN 1 ELSE 0 END)), 6)) AS overall FROM r
    )
    SELECT book, signing, keeping AS retention, slow_burn, overall, CASE WHEN overall >= 80 THEN 'S+' WHEN overall >= 70 THEN 'A' WHEN overall >= 60 THEN 'B' WHEN overall >= 50 THEN 'C' ELSE 'D' END AS grade, CASE WHEN overall >= 75 THEN 'hit' WHEN overall >= 60 THEN 'invest' WHEN overall >= 40 THEN 'observe' ELSE 'drop' END AS decision,
      least({", ".join(f"round(round(signing * {a}e0 + keeping * {1 - a:.2f}e0, 6))" for a in (0.4, 0.45, 0.5, 0.55, 0.6))}) AS low, greatest({", ".join(f"round(round(signing * {a}e0 + keeping * {1 - a:.2f}e0, 6))" for a in (0.4, 0.45, 0.5, 0.55, 0.6))}) AS high, p_hook, p_conflict, p_intensity, p_retention, p_diversity
    FROM o"""


def commercial(t: Tables):
    return s.commercial_score(t.metrics, labels(t))


@query("commercial_score", COMMERCIAL)
def _(t):
    return commercial(t)


@query("sub_genre", """
    SELECT book, CASE WHEN n = 0 THEN 'general' WHEN imp / greatest(exp + imp, 1) > 0.3 AND sac > 0.5 * bond THEN 'bond' WHEN cog > slap AND come > slap THEN 'wits' WHEN slap / greatest(n, 1) > 0.5 THEN 'slap' ELSE 'general' END AS sub_genre FROM (
      SELECT book, count(*) FILTER (WHERE dominant_sub <> 'none') AS n, sum(bond_count) AS bond, sum(cognitive_count) AS cog, sum(sacrifice_count) AS sac, sum(bond_count + cognitive_count + sacrifice_count) AS imp, count(*) FILTER (WHERE dominant_sub = 'slap') AS slap, count(*) FILTER (WHERE dominant_sub = 'comeback') AS come,
        count(*) FILTER (WHERE dominant_sub IN ('slap', 'level', 'crush', 'comeback', 'hidden')) AS exp FROM metrics GROUP BY book) a""")
def _(t):
    return s.sub_genre(t.metrics)


@query("simple_sub_genre", f"""
    SELECT book, CASE WHEN d > 35 THEN 'daily' WHEN c < 0.8 AND h > 1.8 THEN 'pleasure' WHEN h < 1.2 AND c > 1 THEN 'slow wits' WHEN h BETWEEN 1.2 AND 2.5 AND c > 0.8 THEN 'bond' ELSE 'standard' END AS sub_genre
    FROM (SELECT book, {M9('hook_density')} AS h, {M9('conflict_density')} AS c, round(avg(dialogue_ratio) * 100, 9) AS d FROM metrics GROUP BY book) a""")
def _(t):
    return s.simple_sub_genre(t.metrics)


@query("zone_weighted", "SELECT book, round(round(sum(w * pleasure_intensity) / sum(w), 9), 4) AS weighted FROM (SELECT book, pleasure_intensity, CASE WHEN ch_num <= 50 THEN 2e0 WHEN ch_num >= 0.85e0 * max(ch_num) OVER (PARTITION BY book) THEN 1.5e0 ELSE 1e0 END AS w FROM metrics) a GROUP BY book")
def _(t):
    return s.zone_weighted(t.metrics)


@query(
    "quality_gate",
    f"""
    WITH given AS (SELECT book, overall AS score FROM ({COMMERCIAL}) c WHERE slow_burn = false AND overall >= 35),
    st AS (SELECT a.*, CAST(g.score AS BIGINT) AS given, CASE WHEN total_ch >= 10 THEN CAST(floor(round((least(100e0, greatest(0e0, (avg_hook - 0.5e0) / 4 * 100)) + least(100e0, greatest(0e0, avg_pleasure / 3 * 100)) + least(100e0, greatest(0e0, (avg_conflict - 0.2e0) / 0.8e0 * 100))) / 3, 6)) AS BIGINT) END AS proxy FROM ({STATS}) a LEFT JOIN given g ON a.book = g.book),
    r AS (SELECT *, coalesce(given, proxy) AS score, CASE WHEN regexp_matches(book, 'source0*3') THEN 'protected' WHEN total_ch < 10 THEN 'few_chapters' WHEN zero_hook_streak > greatest(5, least(floor(total_ch * 0.03e0), 15)) THEN 'zero_hooks' WHEN coalesce(given, proxy) < 60 THEN 'low_score' ELSE 'ok' END AS reason FROM st)
    SELECT book, CASE WHEN reason IN ('protected', 'ok') THEN 'PASS' WHEN reason = 'few_chapters' AND NOT regexp_matches(book, 'source0*1') THEN 'FAIL' ELSE 'QUARANTINE' END AS verdict, reason, score, CASE WHEN given IS NOT NULL THEN 'scores' WHEN proxy IS NOT NULL THEN 'proxy' END AS source FROM r""",
)
def _(t):
    given = commercial(t).where("NOT slow_burn AND overall >= 35").select("book", F.col("overall").alias("score"))
    return s.gate(s.rhythm_stats(t.metrics), given, known=["source0*1"], protected=["source0*3"], score=60)


@query(
    "writing_instructions",
    "SELECT book, ch_num, rule, severity, place, CASE WHEN rule = 'weak_hook' THEN ['suspense', 'reversal', 'emotion', 'info', 'hint'][ch_num % 5 + 1] END AS hook_word FROM ("
    + " UNION ALL ".join(f"SELECT book, ch_num, '{r}' AS rule, '{v}' AS severity, '{p}' AS place FROM metrics WHERE {w}" for r, v, p, w in s.INSTRUCTIONS)
    + ") a",
)
def _(t):
    return s.writing_instructions(t.metrics)


USER_RULES = (("long_and_calm", "LOW", "all", "wc > 3000 AND conflict_density < 1"), ("loud", "MED", "all", "excl_density > 0.5 OR emotion_valence > 5"))


@query("user_conditions", " UNION ALL ".join(f"SELECT book, ch_num, '{r}' AS rule, '{v}' AS severity, '{p}' AS place FROM metrics WHERE {w}" for r, v, p, w in USER_RULES))
def _(t):
    return s.fired(t.metrics, USER_RULES, ["book", "ch_num"])


@query("book_tags", f"""
    SELECT book, concat_ws(',', CASE WHEN r > 0.1 THEN 'literary' WHEN r < -0.15 THEN 'colloquial' END, CASE WHEN slap > 0.6 THEN 'slap' END, CASE WHEN crush > 0.2 THEN 'crush' END, CASE WHEN fast > 0.5 THEN 'fast' WHEN slow > 0.5 THEN 'slow' END, CASE WHEN rev > 0.1 THEN 'reversal' END, CASE WHEN sus > 0.08 THEN 'suspense' END) AS tags FROM (
      SELECT book, {M9('readability')} AS r, {", ".join(f"round(avg(CASE WHEN {c} = '{v}' THEN 1e0 ELSE 0e0 END), 9) AS {n}" for c, v, n in (("dominant_sub", "slap", "slap"), ("dominant_sub", "crush", "crush"), ("pace", "fast", "fast"), ("pace", "slow", "slow"), ("hook_type", "reversal", "rev"), ("hook_type", "suspense", "sus")))} FROM metrics GROUP BY book) a""")
def _(t):
    return s.book_tags(t.metrics)


@query(
    "attribution",
    f"""
    WITH l AS (SELECT v.book, v.dim, round(greatest(0e0, (b.p50 - v.value) / greatest(b.p75 - b.p25, 0.01e0)), 6) AS loss FROM ({LONG}) v JOIN ({BENCH}) b ON v.dim = b.dim),
    h AS (SELECT book, {", ".join(f"coalesce(max(loss) FILTER (WHERE dim = '{d}'), 0) AS {n}" for d, n in (("hook_density", "h"), ("conflict_density", "c"), ("dialogue_ratio", "d"), ("pleasure_intensity", "p")))} FROM l GROUP BY book)
    SELECT l.book, dim, loss, CAST(least(floor(round(8 * loss, 6)), 15) AS BIGINT) AS gain, place, concat_ws(',', CASE WHEN h > 0.3 AND c > 0.3 THEN 'no_confrontation' END, CASE WHEN d > 0.3 AND p > 0.3 THEN 'no_talk' END, CASE WHEN h > 0.5 AND p > 0.5 THEN 'collapse' END) AS hints
    FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY loss DESC, dim) AS place FROM l) l JOIN h ON l.book = h.book WHERE place <= 3 AND loss > 0""",
)
def _(t):
    v = s.book_dims(t.metrics)
    return s.attribution(v, s.benchmark(v))


AUDITED = ("hook_density", "conflict_density", "pleasure_intensity", "readability")


AUDIT = f"""
    SELECT book, fails, CASE WHEN n < 5 OR fails >= 3 THEN 'FAIL' WHEN fails >= 1 THEN 'WARN' ELSE 'PASS' END AS status FROM (
      SELECT b.book, b.n, CAST((h < 0.01 OR c < 0.01) AS BIGINT) + CAST(({" OR ".join(f"(sd_{d} > 0 AND abs(m_{d} - mu_{d}) > 3 * sd_{d})" for d in AUDITED)}) AS BIGINT) + CAST(none > 0.95 AS BIGINT) + CAST(pleased < 0.05 AS BIGINT) + CAST(wc NOT BETWEEN 500 AND 10000 AS BIGINT) + CAST(r NOT BETWEEN -1 AND 2 AS BIGINT) AS fails
      FROM (SELECT book, count(*) AS n, {M9("hook_density")} AS h, {M9("conflict_density")} AS c, {M9("readability")} AS r, {M9("wc")} AS wc, {", ".join(f"{M9(d)} AS m_{d}" for d in AUDITED)}, avg(CASE WHEN hook_type = 'none' THEN 1e0 ELSE 0e0 END) AS none, avg(CASE WHEN pleasure_type <> 'none' THEN 1e0 ELSE 0e0 END) AS pleased FROM metrics GROUP BY book) b
      CROSS JOIN (SELECT {", ".join(f"avg({d}) AS mu_{d}, stddev_samp({d}) AS sd_{d}" for d in AUDITED)} FROM metrics) g) z"""


@query("rhythm_audit", AUDIT)
def _(t):
    return s.rhythm_audit(t.metrics)


@query("column_audit", " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {c} = 0) AS zeros, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, round(round(avg({c}), 9), 4) AS mean, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, round(round(stddev_samp({c}), 9), 4) AS std FROM {'documents' if c == 'n_chars' else 'metrics'}" for c in ("wc", "hook_density", "readability", "emotion_valence")))
def _(t):
    return s.column_audit(t.metrics, ("wc", "hook_density", "readability", "emotion_valence"))


@query(
    "score_audit",
    f"""
    SELECT count(*) AS n, round(avg(CASE WHEN overall >= 70 THEN 1e0 ELSE 0e0 END), 4) AS elite, count(*) - count(DISTINCT overall) AS ties, round(round(stddev_samp(overall) / avg(overall) * 100, 9), 1) AS cv, round(round(1 - 6 * sum((ra - rb) * (ra - rb)) / (count(*) * (count(*) * count(*) - 1)), 9), 3) AS rho, count(*) FILTER (WHERE abs(ra - rb) > n / 3) AS outliers
    FROM (SELECT overall, count(*) OVER () AS n, rank() OVER (ORDER BY overall DESC) + (count(*) OVER (PARTITION BY overall) - 1) / 2e0 AS ra, rank() OVER (ORDER BY signing DESC) + (count(*) OVER (PARTITION BY signing) - 1) / 2e0 AS rb FROM ({COMMERCIAL}) c) z""",
)
def _(t):
    return s.score_audit(commercial(t))


SEGMENTS = "SELECT *, CASE WHEN ch_num <= q THEN 'opening' WHEN ch_num <= 3 * q THEN 'rise' WHEN ch_num <= 4 * q THEN 'middle' WHEN ch_num <= 5 * q THEN 'late' ELSE 'ending' END AS segment FROM (SELECT *, floor(count(*) OVER (PARTITION BY book) / 5) AS q FROM metrics) x"


@query("five_segments", f"SELECT book, segment, count(*) AS n, round(round(avg(pleasure_intensity), 9), 3) AS intensity, min(hook_density) AS min_hook, max(hook_density) AS max_hook FROM ({SEGMENTS}) a GROUP BY book, segment")
def _(t):
    return s.segments(t.metrics).groupBy("book", "segment").agg(F.count("*").alias("n"), s.rounded(s.mean9("pleasure_intensity"), 3).alias("intensity"), F.min("hook_density").alias("min_hook"), F.max("hook_density").alias("max_hook"))


@query(
    "genre_synthesis",
    f"""
    WITH m AS (SELECT book, segment, {", ".join(f"round(round(avg({c}), 9), 3) AS {n}" for c, n in (("hook_density", "hook"), ("conflict_density", "conflict"), ("pleasure_intensity", "pleasure"), ("slap_count", "slap")))} FROM ({SEGMENTS}) a GROUP BY book, segment),
    p AS (SELECT book, segment, pace FROM (SELECT book, segment, pace, row_number() OVER (PARTITION BY book, segment ORDER BY count(*) DESC, pace) AS k FROM ({SEGMENTS}) a GROUP BY book, segment, pace) x WHERE k = 1),
    l AS (SELECT segment, pace AS lead_pace FROM (SELECT segment, pace, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, pace) AS k FROM p GROUP BY segment, pace) x WHERE k = 1)
    SELECT m.segment, count(*) AS n_books, min(hook) AS hook_low, max(hook) AS hook_high, min(conflict) AS conflict_low, max(conflict) AS conflict_high, {", ".join(f"round(round(avg({c}), 9), 3) AS {c}_pooled" for c in ("hook", "conflict", "pleasure", "slap"))}, any_value(l.lead_pace) AS lead_pace
    FROM m JOIN l ON m.segment = l.segment GROUP BY m.segment""",
)
def _(t):
    return s.synthesis(t.metrics)


@query(
    "segment_retention",
    """
    SELECT book, fifth, z AS zero_hook_chs, round(z / m, 2) AS zero_hook_ratio, CASE WHEN z / m > 0.3 THEN 'HIGH' WHEN z / m > 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (
      SELECT book, fifth, count(*) FILTER (WHERE hook_density = 0) AS z, count(*) AS m FROM (SELECT book, hook_density, CAST(least(floor((ch_num - 1) / greatest(1, floor(n / 5))), 4) AS BIGINT) AS fifth FROM (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM metrics) x WHERE n >= 10) y GROUP BY book, fifth) z""",
)
def _(t):
    return s.retention_risk(t.metrics)


def chunked(n: int) -> str:
    return f"""
    SELECT chunk, min(place || ':' || ch_num) AS dummy, arg_min(ch_num, place) AS from_ch, round(round(avg(conflict_density), 9), 2) AS conflict_density, round(round(avg(pleasure_intensity), 9), 2) AS pleasure_intensity, round(round(avg(hook_density), 9), 2) AS hook_density
    FROM (SELECT *, CAST(floor(place / greatest(1, floor(n / {n}))) AS BIGINT) AS chunk FROM (SELECT *, row_number() OVER (ORDER BY ch_num, book) - 1 AS place, count(*) OVER () AS n FROM metrics) x) y WHERE chunk < {n} GROUP BY chunk"""


@query("escalation", f"SELECT * EXCLUDE dummy FROM ({chunked(10)}) z")
def _(t):
    return s.chunks(t.metrics, 10)


@query("plot_waves", f"SELECT chunk, from_ch, conflict_density, pleasure_intensity, hook_density, coalesce(prev > 0 AND conflict_density / greatest(prev, 0.01e0) > 1.3, false) AS turning FROM (SELECT *, lag(conflict_density) OVER (ORDER BY chunk) AS prev FROM ({chunked(8)}) z) w")
def _(t):
    from pyspark.sql import Window

    prev = F.lag("conflict_density").over(Window.orderBy("chunk"))  # eight rows
    return s.chunks(t.metrics, 8).withColumn("turning", F.coalesce((prev > 0) & (F.col("conflict_density") / F.greatest(prev, F.lit(0.01)) > 1.3), F.lit(False)))


BUCKETED = ("hook_density", "conflict_density", "pleasure_intensity", "dialogue_ratio")


@query(
    "position_buckets",
    f"""
    SELECT bucket, count(*) AS n_books, {", ".join(f"round(round(avg({c}), 9), 4) AS {c}" for c in BUCKETED)} FROM (
      SELECT book, bucket, {", ".join(f"{M9(c)} AS {c}" for c in BUCKETED)} FROM (SELECT *, CAST(floor((ch_num - 1) / floor(n / 10)) AS BIGINT) AS bucket FROM (SELECT *, count(*) OVER (PARTITION BY book) AS n FROM metrics) a WHERE n >= 10) b WHERE bucket < 10 GROUP BY book, bucket) c GROUP BY bucket""",
)
def _(t):
    return s.buckets(t.metrics)


@query(
    "concentration",
    """
    SELECT kind, round(round(sum(p * ln(p * k)), 9), 4) AS kl, coalesce(string_agg(label, ',' ORDER BY n DESC, label) FILTER (WHERE p < 0.05 AND r <= 3), '') AS low_frequency FROM (
      SELECT *, row_number() OVER (PARTITION BY kind, p < 0.05 ORDER BY n DESC, label) AS r FROM (
        SELECT kind, label, n, n / sum(n) OVER (PARTITION BY kind) AS p, count(*) OVER (PARTITION BY kind) AS k FROM (SELECT 'dominant_sub' AS kind, dominant_sub AS label, count(*) AS n FROM metrics GROUP BY 2 UNION ALL SELECT 'hook_type', hook_type, count(*) FROM metrics GROUP BY 2) a) b) c GROUP BY kind""",
)
def _(t):
    return s.concentration(t.metrics, ("dominant_sub", "hook_type"))


FEATURED = ("wc", "para_count", "avg_para_len", "dialogue_ratio", "excl_density", "pos_density", "neg_density", "conflict_density", "hook_density", "slap_count", "level_count", "bond_count", "readability", "avg_sentence_len", "vocab_diversity")
TARGETS = ("quality", "toxic", "pleasure_intensity")
LABELLED = "SELECT m.*, l.quality, l.toxic FROM metrics m JOIN labels l ON m.doc_id = l.doc_id"
IMPORTANCE = " UNION ALL ".join(f"SELECT '{f}' AS feature, '{y}' AS target, corr(CAST({f} AS DOUBLE), CAST({y} AS DOUBLE)) AS r, count(*) AS n FROM z" for f in FEATURED for y in TARGETS)
IMPORTANCE = f"WITH z AS MATERIALIZED ({LABELLED}), i AS ({IMPORTANCE}) SELECT feature, target, CASE WHEN n < 3 OR r IS NULL OR isnan(r) THEN 0e0 ELSE round(round(r, 9), 3) END AS r, n FROM i"


def labelled(t: Tables):
    return t.metrics.join(t.labels, "doc_id")


@query("feature_importance", f"SELECT * FROM ({IMPORTANCE}) x WHERE abs(r) > 0.02")
def _(t):
    return s.pearson(labelled(t), FEATURED, TARGETS, 0.02)


@query("blend_weights", f"SELECT feature, r, round(round(greatest(0.05e0, pow(greatest(r, 0.01e0), 2) / (1 + pow(greatest(r, 0.01e0), 2))), 9), 3) AS w_rule, round(round(1 - round(round(greatest(0.05e0, pow(greatest(r, 0.01e0), 2) / (1 + pow(greatest(r, 0.01e0), 2))), 9), 3), 9), 3) AS w_llm FROM ({IMPORTANCE}) x WHERE target = 'pleasure_intensity' AND feature IN ('pos_density', 'conflict_density', 'hook_density')")
def _(t):
    r = s.pearson(labelled(t), ("pos_density", "conflict_density", "hook_density"), ("pleasure_intensity",))
    rule, label = s.blend_weight(F.col("r"))
    return r.select("feature", "r", rule.alias("w_rule"), label.alias("w_llm"))


@query("score_bootstrap")
def _(t):
    """Bounds drawn by a hash that SQL engines do not share; tested against the same draws in plain Python."""
    return s.bootstrap(commercial(t), ("p_hook", "p_conflict", "p_intensity", "p_retention", "p_diversity"))


@query(
    "ols_calibration",
    f"""
    WITH z AS (SELECT pleasure_intensity AS x, CAST(quality AS DOUBLE) AS y FROM ({LABELLED}) l), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM z)
    SELECT round(round(any_value(b), 9), 4) AS slope, round(round(any_value(a), 9), 1) AS intercept, round(round(avg(abs(y - (oy - ob * ox) / (n - 1) - ob * x)), 9), 4) AS mae, any_value(n) AS n
    FROM (SELECT z.x, z.y, f.a, f.b, f.n, f.sx - z.x AS ox, f.sy - z.y AS oy, ((f.n - 1) * (f.sxy - z.x * z.y) - (f.sx - z.x) * (f.sy - z.y)) / ((f.n - 1) * (f.sxx - z.x * z.x) - (f.sx - z.x) * (f.sx - z.x)) AS ob FROM z CROSS JOIN f) w""",
)
def _(t):
    return s.loocv_mae(labelled(t), "pleasure_intensity", "quality")


@query("label_bias", f"SELECT dominant_sub, count(*) AS n, round(round(avg(10 * quality - pleasure_intensity), 9), 3) AS bias FROM ({LABELLED}) x GROUP BY dominant_sub HAVING count(*) >= 5")
def _(t):
    each = labelled(t).groupBy("dominant_sub").agg(F.count("*").alias("n"), s.rounded(s.mean9(10 * F.col("quality") - F.col("pleasure_intensity")), 3).alias("bias"))
    return each.where("n >= 5")


BORDA = {"signing": True, "retention": True, "p_diversity": True, "p_conflict": True, "overall": True}


@query(
    "borda_rank",
    f"""
    SELECT *, row_number() OVER (ORDER BY total_borda, book) AS consensus_rank FROM (SELECT *, {" + ".join(f"rank_{d}" for d in BORDA)} AS total_borda FROM (
      SELECT book, {", ".join(f"row_number() OVER (ORDER BY {d} DESC, book) AS rank_{d}" for d in BORDA)} FROM ({COMMERCIAL}) c) a) b""",
)
def _(t):
    return s.borda(commercial(t), BORDA)


LENGTHS = "SELECT book, count(*) AS n FROM metrics WHERE wc > 400 GROUP BY book"


@query("length_correction", f"SELECT a.book, a.n, CASE WHEN a.n > 1.5 * m.med THEN round(round(least(1.8e0, 1 + 0.2e0 * log2(a.n / m.med)), 9), 4) ELSE 1e0 END AS factor FROM ({LENGTHS}) a CROSS JOIN (SELECT list_sort(list(n))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS med FROM ({LENGTHS}) b) m")
def _(t):
    return s.length_correction(t.metrics.where("wc > 400").groupBy("book").agg(F.count("*").alias("n")))


COMPARED = ("pleasure_intensity", "hook_density", "conflict_density", "readability")
COMPARED_SQL = f"SELECT book, {', '.join(f'{M9(c)} AS {c}' for c in COMPARED)} FROM metrics GROUP BY book"


@query(
    "percent_rank_books",
    f"""
    SELECT *, row_number() OVER (ORDER BY composite DESC, book) AS place FROM (SELECT *, round(round(({" + ".join(f"pct_{c}" for c in COMPARED)}) / 4, 9), 1) AS composite FROM (
      SELECT book, {", ".join(f"CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 50e0 ELSE round(round(100 * cume_dist() OVER (ORDER BY {c}), 9), 1) END AS pct_{c}" for c in COMPARED)} FROM ({COMPARED_SQL}) a) b) c""",
)
def _(t):
    return s.percent_ranks(t.metrics.groupBy("book").agg(*[s.mean9(c).alias(c) for c in COMPARED]), COMPARED)


@query("score_gaps", f"SELECT book, v, round(round(v - lead(v) OVER (ORDER BY v DESC, book), 9), 4) AS gap FROM ({MEANS}) a")
def _(t):
    return s.gaps(means(t), "v")


PLAN = ((0.0, 2.0), (0.25, 4.0), (0.6, 3.0), (0.9, 8.0), (1.0, 5.0))


@query(
    "rhythm_interpolation",
    f"""
    SELECT book, ch_num, round(round(CASE WHEN p >= 1 THEN 5e0 ELSE v0 + (v1 - v0) * (p - p0) / (p1 - p0) END, 9), 4) AS target FROM (SELECT book, ch_num, ch_num / CAST(count(*) OVER (PARTITION BY book) AS DOUBLE) AS p FROM chapters) c
    LEFT JOIN ({" UNION ALL ".join(f"SELECT {a[0]}e0 AS p0, {b[0]}e0 AS p1, {a[1]}e0 AS v0, {b[1]}e0 AS v1" for a, b in zip(PLAN, PLAN[1:]))}) n ON c.p >= n.p0 AND c.p < n.p1""",
)
def _(t):
    return s.interpolated(t.chapters, PLAN)


VERSIONED = ("hook_density", "conflict_density", "readability")


@query(
    "version_compare",
    " UNION ALL ".join(f"SELECT a.book, '{c}' AS metric, a.{c} AS base, b.{c} AS other, round(round(b.{c} - a.{c}, 9), 4) AS delta, round(b.{c} - a.{c}, 9) >= round(0.1 * abs(a.{c}), 9) OR round(a.{c} - b.{c}, 9) >= round(0.1 * abs(a.{c}), 9) AS highlight FROM v0 a JOIN v1 b ON a.book = b.book" for c in VERSIONED).join(
        ["WITH " + ", ".join(f"v{k} AS (SELECT book, {', '.join(f'{M9(c)} AS {c}' for c in VERSIONED)} FROM metrics WHERE ch_num % 2 = {k} GROUP BY book)" for k in (0, 1)) + " ", ""]
    ),
)
def _(t):
    part = lambda k: t.metrics.where(F.col("ch_num") % 2 == k).groupBy("book").agg(*[s.mean9(c).alias(c) for c in VERSIONED])
    return s.versions(part(0), part(1), VERSIONED, "book")


POOLS = f"SELECT d.lang AS genre, {M9('m.hook_density')} AS pool_hook, {M9('m.conflict_density')} AS pool_conflict FROM metrics m JOIN documents d ON m.doc_id = d.doc_id WHERE d.lang IS NOT NULL GROUP BY d.lang"


@query(
    "cross_genre",
    f"""
    SELECT book, genre, round(round(h * 100, 6)) AS hook_vs, round(round(c * 100, 6)) AS conflict_vs, round(round(least(100e0, (h + c) / 2 * 100), 6)) AS appeal FROM (
      SELECT a.book, p.genre, hook / greatest(pool_hook, 0.01e0) AS h, conflict / greatest(pool_conflict, 0.01e0) AS c FROM (SELECT book, round(avg(hook_density), 9) AS hook, round(avg(conflict_density), 9) AS conflict FROM metrics WHERE ch_num <= 3 GROUP BY book) a CROSS JOIN ({POOLS}) p WHERE p.genre <> 'en') z""",
)
def _(t):
    pools = t.metrics.join(t.documents.select("doc_id", F.col("lang").alias("genre")), "doc_id").where("genre is not null").groupBy("genre").agg(s.mean9("hook_density").alias("pool_hook"), s.mean9("conflict_density").alias("pool_conflict"))
    return s.competitiveness(t.metrics, pools, "en")


@query("genre_stats", "SELECT " + ", ".join(f"round(round(avg({c}), 9), 4) AS {c}_mean, round(round(stddev_samp({c}), 9), 4) AS {c}_std" for c in AUDITED) + " FROM metrics")
def _(t):
    return t.metrics.agg(*[f for c in AUDITED for f in (s.rounded(F.round(F.avg(c), 9), 4).alias(f"{c}_mean"), s.rounded(F.round(F.stddev_samp(c), 9), 4).alias(f"{c}_std"))])


@query("pleasure_distribution", "SELECT book, count(*) AS total, count(*) FILTER (WHERE pleasure_timing = 'instant') AS instant_count, count(*) FILTER (WHERE pleasure_timing = 'delayed') AS delayed_count, round(round(avg(pos_density), 9), 2) AS avg_pos, round(round(avg(hook_density), 9), 2) AS avg_hook, round(round(100e0 * count(*) FILTER (WHERE pleasure_timing = 'instant') / count(*), 9), 1) AS instant_pct FROM metrics GROUP BY book")
def _(t):
    instant = F.count_if(F.col("pleasure_timing") == "instant")
    return t.metrics.groupBy("book").agg(F.count("*").alias("total"), instant.alias("instant_count"), F.count_if(F.col("pleasure_timing") == "delayed").alias("delayed_count"), s.rounded(s.mean9("pos_density"), 2).alias("avg_pos"), s.rounded(s.mean9("hook_density"), 2).alias("avg_hook"), s.rounded(F.round(100.0 * instant / F.count("*"), 9), 1).alias("instant_pct"))


@query("hook_streaks", "SELECT book, ch_num, hook_density, hook_type, dominant_sub FROM metrics WHERE hook_density = 0")
def _(t):
    return t.metrics.where("hook_density = 0").select("book", "ch_num", "hook_density", "hook_type", "dominant_sub")


@query("emotion_curve", "SELECT book, ch_num, emotion, emotion_valence, emotion_burnout, pos_density, neg_density, conflict_density, pleasure_timing, pleasure_intensity FROM metrics")
def _(t):
    return t.metrics.select("book", "ch_num", "emotion", "emotion_valence", "emotion_burnout", "pos_density", "neg_density", "conflict_density", "pleasure_timing", "pleasure_intensity")


@query(
    "index_report",
    f"""
    SELECT a.*, coalesce(b.streak, 0) AS longest_hookless, c.peak_ch FROM (SELECT book, count(*) AS n, count(*) FILTER (WHERE hook_density = 0) AS n_hookless, count(*) FILTER (WHERE pleasure_timing = 'instant') AS n_instant FROM metrics GROUP BY book) a
    LEFT JOIN (SELECT book, max(run) AS streak FROM ({STREAKS.format(where='hook_density = 0')}) r GROUP BY book) b ON a.book = b.book
    JOIN (SELECT book, ch_num AS peak_ch FROM (SELECT book, ch_num, row_number() OVER (PARTITION BY book ORDER BY conflict_density DESC, ch_num) AS k FROM metrics) x WHERE k = 1) c ON a.book = c.book""",
)
def _(t):
    m = t.metrics
    sums = m.groupBy("book").agg(F.count("*").alias("n"), F.count_if(F.col("hook_density") == 0).alias("n_hookless"), F.count_if(F.col("pleasure_timing") == "instant").alias("n_instant"), F.min_by("ch_num", F.struct((-F.col("conflict_density")).alias("c"), "ch_num")).alias("peak_ch"))
    return sums.join(longest_run(m, F.col("hook_density") == 0, name="longest_hookless"), "book")
