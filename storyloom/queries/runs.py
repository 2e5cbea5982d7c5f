"""Timed runs of stages, reduction trees and checks of the user's own, over the given tables, with SQL of their own."""

from pyspark.sql import functions as F

from storyloom.functions.storage import shared_dir
from storyloom.operators import detectors as d
from storyloom.operators import scoring as sc
from storyloom.operators.hooks import Checks, Stages
from storyloom.operators.projection import chapter_counts, chapter_metrics
from storyloom.plans import stages as st
from storyloom.plans.registry import Catalog
from storyloom.queries.text import LOW, SHAPES, N

query = Catalog()


@query(
    "stage_times",
    """
    SELECT stage, rows FROM (SELECT 'counts' AS stage, count(*) AS rows FROM documents UNION ALL SELECT 'metrics', count(*) FROM documents UNION ALL SELECT 'long_chapters', count(*) FROM metrics WHERE wc >= 300
      UNION ALL SELECT 'books', count(DISTINCT book) FROM metrics WHERE wc >= 300) a""",
)
def _(t):
    """The stages from texts to books, one of them added by the user, with the rows of each as they were written."""
    path = f"{shared_dir(t.spark)}/run"
    stages = Stages([("counts", chapter_counts), ("metrics", chapter_metrics), ("books", sc.rhythm_stats)])
    stages.add("long_chapters", lambda rows: rows.where("wc >= 300"), after="metrics")
    st.run_stages(t.documents, stages, path)
    return st.stage_times(t.spark, path).where("seconds > 0").select("stage", "rows")


@query(
    "reduction_tree",
    """
    WITH l AS (SELECT c.book, c.ch_num AS at_, coalesce(d.text, '') AS value, CAST(floor((row_number() OVER (PARTITION BY c.book ORDER BY c.ch_num) - 1) / 8) AS BIGINT) AS node FROM chapters c JOIN documents d ON d.doc_id = c.doc_id),
    one AS (SELECT book, 1 AS level, node, CAST(count(*) AS INTEGER) AS n, md5(string_agg(left(value, 40), chr(10) ORDER BY at_)) AS value FROM l GROUP BY book, node),
    two AS (SELECT book, 2 AS level, parent AS node, CAST(count(*) AS INTEGER) AS n, md5(string_agg(left(value, 40), chr(10) ORDER BY node)) AS value FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY book) >= 3 THEN CAST(floor(node / 5) AS BIGINT) ELSE node END AS parent FROM one) a GROUP BY book, parent),
    three AS (SELECT book, 3 AS level, CAST(0 AS BIGINT) AS node, CAST(count(*) AS INTEGER) AS n, md5(string_agg(left(value, 40), chr(10) ORDER BY node)) AS value FROM two GROUP BY book)
    SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three""",
)
def _(t):
    """Eight chapters a node, five nodes a volume, one root a book. The reduction here is a digest of the parts' beginnings."""
    leaves = t.chapters.join(t.documents.select("doc_id", "text"), "doc_id").select("book", "ch_num", F.coalesce("text", F.lit("")).alias("value"))
    digest = lambda _, items: F.md5(F.array_join(F.transform(items, lambda x: F.left(x["value"], F.lit(40))), "\n"))
    return st.reduce_tree(leaves, f"{shared_dir(t.spark)}/tree", digest)


@query(
    "checked_gate",
    f"""
    SELECT doc_id, concat_ws(',', CASE WHEN l THEN 'length' END, CASE WHEN p THEN 'pleasure' END, CASE WHEN e THEN 'curve' END, CASE WHEN q THEN 'quiet' END, CASE WHEN o THEN 'opening' END) AS failed, CASE WHEN NOT (l OR p OR e OR q OR o) THEN 'pass' WHEN o OR CAST(l AS INT) + CAST(p AS INT) + CAST(e AS INT) + CAST(q AS INT) > 2 THEN 'fail' ELSE 'retry' END AS result FROM (
      SELECT c.doc_id, {N(LOW, '[a-zà-ÿ]')} NOT BETWEEN 500 AND 4000 AS l, {N(LOW, 'tion|ment')} < CASE WHEN c.ch_num <= 3 THEN 5 ELSE 3 END AS p, c.ch_num <= 3 AND coalesce(s.shape, 'flat') <> 'rising' AS e,
        len(regexp_extract_all(coalesce(text, ''), '[!?]')) > 3 AS q, NOT regexp_matches(coalesce(text, ''), '^[A-ZÀ-Þ]') AS o FROM chapters c JOIN documents x ON c.doc_id = x.doc_id LEFT JOIN ({SHAPES}) s ON s.doc_id = c.doc_id) a""",
)
def _(t):
    """The goal gate with two checks of a user: one over columns, one over pandas series, which is fatal."""
    checks = Checks()
    checks.add("quiet", ["text"], lambda x: F.regexp_count(F.coalesce(x, F.lit("")), F.lit("[!?]")) <= 3)
    checks.add("opening", ["text"], lambda s: s.fillna("").str.match("[A-ZÀ-Þ]"), pandas=True, severity="fail")
    shapes = d.part_intensity(t.documents, "[!?.]", 5, "[a-zà-ÿ]")
    return d.goal_gate(t.documents, shapes, d.default_goals(t.chapters, 500, 4000), "[a-zà-ÿ]", "tion|ment", checks=checks)
