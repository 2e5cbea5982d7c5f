"""The first three chapters of each book in five dimensions, with SQL of its own. Syllables stand for the marks."""

from pyspark.sql import functions as F

from storyloom.operators import golden as g
from storyloom.operators.scoring import rounded
from storyloom.plans.registry import Catalog

query = Catalog()

M = g.GoldenMarks("[a-zà-ÿ]", "ment|heit", "tion", "ung|ing", "elle", "the|der|el", "en|les|un", "ble|keit", "able|lich", "oush|ción", "ver|re", "ch|on", "gez|tra", "ou|au", "qui|que", "eau|ß", "ai|ä", "ö|é", "ó|á", "([a-zà-ÿ]{2,8}) (?:the|der|de|la) ")


def n(x: str, p: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{p}')) AS BIGINT)"


NAMED = f"""
    SELECT book, name FROM (SELECT book, name, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, min(i)) AS k FROM (SELECT book, unnest(names) AS name, generate_subscripts(names, 1) AS i FROM (SELECT book, regexp_extract_all(left(t, 500), '{M.speaker}', 1) AS names FROM f WHERE num = 1) a) b GROUP BY book, name) c WHERE k = 1"""
GOLDEN = f"""
    WITH f AS (SELECT k.book, k.ch_num AS num, lower(coalesce(d.text, '')) AS t FROM chapters k JOIN documents d ON d.doc_id = k.doc_id WHERE k.ch_num <= 3), w AS ({NAMED}),
    c AS (SELECT f.book, num, name, {n('t', M.letters)} AS cn, {n('left(t, 500)', M.letters)} AS cn500, {" + ".join(f"CAST(regexp_matches(left(t, 100), '{p}') AS INT)" for p in (M.conflict, M.suspense, M.danger))} AS secs, {n('left(t, 500)', M.info)} AS info, {" + ".join(n('left(t, 500)', p) for p in (M.conflict, M.suspense, M.danger, M.anomaly))} AS signals,
      CASE WHEN regexp_matches(left(t, 10), '^({M.scenery})') THEN -2e0 WHEN regexp_matches(left(t, 5), '^({M.person})') THEN 0.5e0 ELSE 0e0 END AS start, (length(t) - length(replace(t, name, ''))) // length(name) AS named,
      {", ".join(f"{n('t', getattr(M, x))} AS {x}" for x in ("goal", "flaw", "want", "obstacle", "confront", "high", "mid", "low", "positive"))}, {n('t', M.foreshadow)} + {n('t', M.hint)} AS planted FROM f LEFT JOIN w ON w.book = f.book),
    e AS (SELECT *, want + obstacle + confront AS clash, CASE WHEN cn >= 50 THEN round((high + mid + low + positive) / greatest(cn / 1000e0, 1e0), 2) ELSE 0e0 END AS felt FROM c),
    b AS (SELECT book, sum(cn) AS cn, {", ".join(f"coalesce(max({x}) FILTER (WHERE num = 1), 0) AS f_{x}" for x in ("cn", "secs", "info", "cn500", "signals", "start"))}, max(name) AS name, sum(named) AS named, {", ".join(f"sum({x}) AS {x}" for x in ("goal", "flaw", "want", "obstacle", "confront", "planted"))},
      coalesce(max(clash) FILTER (WHERE num = 1), 0) AS c1, coalesce(max(clash) FILTER (WHERE num = 3), 0) AS c3, {", ".join(f"coalesce(max(felt) FILTER (WHERE num = {k}), 0e0) AS e{k}" for k in (1, 2, 3))}, coalesce(max(high) FILTER (WHERE cn >= 50), 0) AS peak,
      {" + ".join(f"CAST(coalesce(max({x}) FILTER (WHERE cn >= 50), 0) > 0 AS INT)" for x in ("high", "mid", "low", "positive"))} AS kinds FROM e GROUP BY book),
    r AS (SELECT *, f_info / greatest(f_cn500 / 100e0, 1e0) AS ip, planted / greatest(cn / 1000e0, 1e0) AS pk, round((e1 + e2 + e3) / 3, 9) AS em, round(greatest(e1, e2, e3) - least(e1, e2, e3), 9) AS ec FROM b),
    s AS (SELECT book,
      CASE WHEN f_cn < 50 THEN 2e0 ELSE 5 + CASE WHEN f_secs >= 2 THEN 3e0 WHEN f_secs = 1 THEN 1.5e0 ELSE 0e0 END + CASE WHEN ip >= 1.5 THEN 2e0 WHEN ip >= 1 THEN 1e0 WHEN ip < 0.3 THEN -1.5e0 ELSE 0e0 END + f_start + CASE WHEN f_signals >= 5 THEN 1e0 WHEN f_signals = 0 THEN -1e0 ELSE 0e0 END END AS g1,
      CASE WHEN cn < 500 THEN 3e0 ELSE 5 + CASE WHEN name IS NULL THEN -1e0 WHEN named >= 10 THEN 2e0 WHEN named >= 5 THEN 1e0 WHEN named < 2 THEN -1.5e0 ELSE 0e0 END + CASE WHEN goal > 0 THEN 1.5e0 ELSE 0e0 END + CASE WHEN flaw > 0 THEN 1.5e0 ELSE 0e0 END END AS g2,
      CASE WHEN cn < 500 THEN 3e0 ELSE 5 + CASE WHEN want > 0 AND obstacle > 0 THEN CASE WHEN confront > 0 THEN 3e0 ELSE 2e0 END WHEN want > 0 OR obstacle > 0 THEN 0.5e0 ELSE -2e0 END + CASE WHEN c3 > c1 THEN 1e0 WHEN c3 < c1 * 0.5e0 THEN -1e0 ELSE 0e0 END END AS g3,
      CASE WHEN cn < 500 THEN 3e0 ELSE 5 + CASE WHEN pk >= 2 THEN 3e0 WHEN pk >= 1 THEN 1.5e0 WHEN pk < 0.3 THEN -2e0 ELSE 0e0 END + CASE WHEN planted >= 4 THEN 1e0 ELSE 0e0 END END AS g4,
      CASE WHEN cn < 500 THEN 3e0 ELSE 5 + CASE WHEN em >= 5 THEN 2e0 WHEN em >= 3 THEN 1e0 WHEN em < 1 THEN -2e0 ELSE 0e0 END + CASE WHEN ec >= 2 THEN 1.5e0 WHEN ec < 0.5 AND em < 2 THEN -1e0 ELSE 0e0 END + CASE WHEN peak >= 3 THEN 1.5e0 ELSE 0e0 END + CASE WHEN kinds >= 3 THEN 1e0 ELSE 0e0 END END AS g5 FROM r),
    z AS (SELECT book, {", ".join(f"round(greatest(0e0, least(10e0, {x})), 1) AS {x}" for x in g.WEIGHTS)} FROM s),
    y AS (SELECT *, {" + ".join(f"CAST({x} >= {p} AS INT)" for x, p in g.PASS.items())} AS passed, round(round({" + ".join(f"{x} * {w}e0" for x, w in g.WEIGHTS.items())}, 9), 1) AS total FROM z)
    SELECT *, CASE {" ".join(f"WHEN total >= {a} THEN '{b}'" for a, b in g.GRADES)} ELSE 'F' END AS grade FROM y"""


def scores(t):
    chapters = t.chapters.join(t.documents.select("doc_id", F.lower("text").alias("text")), "doc_id")
    return g.golden_three(chapters, M)


@query("golden_three", GOLDEN)
def _(t):
    return scores(t)


NAMES = [*g.WEIGHTS, "total"]


@query("golden_gaps", f"WITH a AS ({GOLDEN}), m AS (SELECT {', '.join(f'round(round(avg({x}), 9), 1) AS {x}' for x in NAMES)} FROM a) " + " UNION ALL ".join(f"SELECT book, '{x}' AS dimension, a.{x} AS author, m.{x} AS benchmark, round(round(a.{x} - m.{x}, 9), 1) AS gap, round(round(a.{x} - m.{x}, 9), 1) >= 0 AS reached FROM a, m" for x in NAMES))
def _(t):
    """Each book against the mean of all books."""
    each = scores(t)
    return g.golden_gaps(each, each.agg(*[rounded(F.round(F.avg(x), 9), 1).alias(x) for x in NAMES]))
