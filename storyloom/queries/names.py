"""Names and marks in windows over the documents, with SQL of their own. The tables have no Chinese text: a capital and two letters stand for a name, letters for surnames, syllables for marks."""

from storyloom.operators import names as n
from storyloom.plans.registry import Catalog

query = Catalog()

SURNAMES, SKIP = list("ABCDEHILMNOPRSTU"), ["The", "Der"]
SIMPLE = r"""
    SELECT doc_id, name, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z][a-z]')) AS name FROM documents) z
    WHERE name[1] IN ('A', 'B', 'C', 'D', 'E', 'H', 'I', 'L', 'M', 'N', 'O', 'P', 'R', 'S', 'T', 'U') AND NOT contains(name, 'The') AND NOT contains(name, 'Der') GROUP BY doc_id, name"""
PLAIN = {"pattern": "[A-Z][a-z][a-z]", "surnames": SURNAMES, "skip": SKIP}
ALIKE = "x.doc_id = y.doc_id AND x.name < y.name AND x.name[1] = y.name[1] AND CAST(x.name[2] = y.name[2] AS INT) + CAST(x.name[3] = y.name[3] AS INT) = 1"


@query("similar_names", f"WITH c AS ({SIMPLE}) SELECT x.doc_id, x.name AS a, y.name AS b, x.n AS n_a, y.n AS n_b FROM c x JOIN c y ON {ALIKE}")
def _(t):
    return n.similar_pairs(n.name_counts(t.documents, "doc_id", **PLAIN), "doc_id")


@query(
    "name_consistency",
    f"""
    WITH c AS ({SIMPLE}), p AS (SELECT x.doc_id, count(*) AS n FROM c x JOIN c y ON {ALIKE} GROUP BY x.doc_id),
    r AS (SELECT x.doc_id, count(*) AS n FROM c x WHERE x.n = 1 AND (SELECT sum(n) FROM c z WHERE z.doc_id = x.doc_id) > 20 AND EXISTS (SELECT 1 FROM c y WHERE y.doc_id = x.doc_id AND y.name <> x.name AND y.name[1] = x.name[1] AND y.n >= 3) GROUP BY x.doc_id),
    e AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
    SELECT d.doc_id, coalesce(e.n, 0) AS n_names, coalesce(r.n, 0) AS n_rare, coalesce(p.n, 0) AS n_pairs, greatest(0, 100 - 5 * coalesce(r.n, 0) - 3 * coalesce(p.n, 0)) AS score
    FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN p USING (doc_id)""",
)
def _(t):
    return n.name_consistency(t.documents, "doc_id", **PLAIN)


MARKS = ("eheit", "heit", "tion", "ment", "elle", "aeau", "eaue", "ing", "ungch", "ción", "able")


@query(
    "window_density",
    f"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-zà-ÿ]', '', 'g') AS t FROM documents),
    w AS (SELECT doc_id, unnest(list_transform(range(0, length(t) - 100, 50), lambda i: substr(t, i + 1, 100))) AS part FROM d WHERE length(t) >= 100),
    m AS (SELECT doc_id, count(*) AS n, max({" + ".join(f"CAST(contains(part, '{m}') AS INT)" for m in MARKS)}) AS hits FROM w GROUP BY doc_id)
    SELECT d.doc_id, coalesce(m.n, 0) AS n_windows, round(coalesce(m.hits, 0) / 100e0, 4) AS density FROM d LEFT JOIN m USING (doc_id)""",
)
def _(t):
    return n.window_density(t.documents, "doc_id", MARKS, letters="[^A-Za-zà-ÿ]")
