"""Stock phrases and signs of a human hand in the documents, with SQL of its own. Syllables stand for the marks."""

from storyloom.operators import human as h
from storyloom.plans.registry import Catalog
from storyloom.queries.text import TEXT

query = Catalog()

TICS = ("ment de", "tion the", "heit der", " the the ", "elle", "ungch")
M = h.HumanMarks(("onthe", "iqueè", "schver", "ción"), ("able", "keit", "eau"), r"(?:^|[.!?\s])(?:I|Je|Ich)", r"(?:^|[.!?\s])(?:H|E)", "hea.{0,5}ing|(?:th|er)(?:on|ou)")
CHARS = f"length(translate({TEXT}, chr(10) || ' ', ''))"


def times(words):
    return [f"(length({TEXT}) - length(replace({TEXT}, '{w}', ''))) // {len(w)}" for w in words]


@query(
    "tic_density",
    f"""
    SELECT doc_id, n_tics, n_phrases, density, CASE WHEN density <= 0.3 THEN 100 WHEN density <= 0.5 THEN 90 WHEN density <= 1 THEN 70 WHEN density <= 2 THEN 40 ELSE 15 END AS score FROM (
      SELECT doc_id, CASE WHEN chars >= 100 THEN list_sum(n) ELSE 0 END AS n_tics, CASE WHEN chars >= 100 THEN len(list_filter(n, lambda x: x > 0)) ELSE 0 END AS n_phrases, CASE WHEN chars >= 100 THEN round(round(list_sum(n) / (chars / 1000e0), 9), 2) ELSE 0e0 END AS density
      FROM (SELECT doc_id, {CHARS} AS chars, [{", ".join(times(TICS))}] AS n FROM documents) a) b""",
)
def _(t):
    return h.tic_density(t.documents, phrases=TICS)


@query(
    "human_likeness",
    f"""
    WITH n AS (SELECT doc_id, {CHARS} AS chars, len(regexp_extract_all({TEXT}, '{M.first}')) AS a, len(regexp_extract_all({TEXT}, '{M.third}')) AS b, {" + ".join(times(M.thoughts))} AS thoughts, {" + ".join(times(M.doubts))} AS doubts, len(regexp_extract_all({TEXT}, '{M.leaks}')) AS leaks FROM documents),
    p AS (SELECT doc_id, chars, CASE WHEN chars < 50 OR a + b = 0 THEN 'unknown' WHEN a > 2 * b THEN 'first' WHEN b > 2 * a THEN 'third' ELSE 'mixed' END AS perspective, a, b, CASE WHEN chars >= 50 THEN round(round(thoughts / (chars / 1000e0), 9), 2) ELSE 0e0 END AS thought_density, CASE WHEN chars >= 50 THEN doubts ELSE 0 END AS n_doubts, CASE WHEN chars >= 50 THEN leaks ELSE 0 END AS n_leaks FROM n),
    q AS (SELECT *, CASE perspective WHEN 'unknown' THEN 0 WHEN 'first' THEN CAST(floor(round(100e0 * a / (a + b), 9)) AS BIGINT) WHEN 'third' THEN CAST(floor(round(100e0 * b / (a + b), 9)) AS BIGINT) ELSE CAST(floor(round(100e0 * abs(a - b) / (a + b), 9)) AS BIGINT) END AS consistency FROM p)
    SELECT doc_id, perspective, consistency, thought_density, n_doubts, n_leaks, CAST(CASE WHEN chars < 50 THEN 50 ELSE greatest(0, least(100, 50 + CASE perspective WHEN 'first' THEN 25 WHEN 'third' THEN 5 ELSE 0 END + CASE WHEN consistency >= 80 THEN 5 WHEN consistency >= 60 THEN 3 ELSE 0 END
      + CASE WHEN thought_density BETWEEN 1 AND 3 THEN 25 WHEN thought_density > 3 THEN 5 WHEN thought_density >= 0.5 THEN 15 ELSE 0 END + CASE WHEN n_doubts >= 3 THEN 15 WHEN n_doubts >= 1 THEN 8 ELSE 0 END + CASE WHEN n_leaks = 0 THEN 5 WHEN n_leaks > 2 THEN -3 * (n_leaks - 2) ELSE 0 END)) END AS INTEGER) AS score FROM q""",
)
def _(t):
    return h.human_likeness(t.documents, marks=M)
