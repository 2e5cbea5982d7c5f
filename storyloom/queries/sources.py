"""Stores written from the given tables and read back, with SQL of their own."""

from pyspark.sql import functions as F

from storyloom.functions.storage import shared_dir
from storyloom.operators import text
from storyloom.plans.registry import Catalog
from storyloom.sources import stores as s

query = Catalog()


@query("csv_index", "SELECT event_id, user_id, value FROM events WHERE event_id <> 0")
def _(t):
    """Two versions of the rows in one store; the later one of a key is the index."""
    path = f"{shared_dir(t.spark)}/index"
    rows = t.events.select("event_id", "user_id", "value")
    both = rows.select("event_id", "user_id", F.lit("n/a").alias("value"), F.lit("1").alias("version")).unionByName(rows.select("event_id", "user_id", F.col("value").cast("string").alias("value"), F.lit("2").alias("version")))
    s.save_csv(both, path)
    return s.load_csv(t.spark, path, {"event_id": "long", "user_id": "long", "value": "double", "version": "long"}, "event_id", "version").drop("version")


@query("retry_queue", "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' OR value < 5")
def _(t):
    path = f"{shared_dir(t.spark)}/retry"
    rows = t.events.select("event_id", "user_id", "event_type", "value")
    for part in ("event_type = 'error'", "event_type <> 'error' AND value < 5"):
        s.append_lines(rows.where(part).drop("value"), path)
    return s.read_lines(t.spark, path, "event_id long, user_id long, event_type string")


@query("shape_findings", "SELECT event_id, 'name' AS field, 'missing' AS problem FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'k', 'not long' FROM events WHERE event_id % 5 = 0")
def _(t):
    """Properties, some of them without a name and some with a word for a number."""
    k = F.when(F.col("event_id") % 5 == 0, F.lit('"many"')).otherwise(F.get_json_object("props", "$.k"))
    raw = F.concat(F.lit('{"k": '), k, F.when(F.col("event_id") % 3 == 0, F.lit(', "name": "x"}')).otherwise(F.lit("}")))
    return s.shape_findings(t.events.select("event_id", raw.alias("json")), "event_id", "json", {"k": "long", "name": "string"})


@query("scene_sentences", "SELECT doc_id, concat_ws('；', CASE WHEN hook_type <> 'none' THEN 'hook: ' || hook_type END, 'pace: ' || pace, CASE WHEN pleasure_type <> 'none' THEN 'pleasure: ' || pleasure_type END, CASE WHEN conflict_level <> 'none' THEN 'conflict: ' || conflict_level END, 'class: ' || dominant_sub) AS sentence FROM metrics")
def _(t):
    c = F.col
    return t.metrics.select("doc_id", s.as_sentence({"hook": c("hook_type"), "pace": c("pace"), "pleasure": c("pleasure_type"), "conflict": c("conflict_level"), "class": c("dominant_sub")}).alias("sentence"))


SPOKEN = r"([A-Z][a-zà-ÿ]{2,}),? ([a-z]{2,})"


@query(
    "speech_shares",
    f"""
    WITH p AS (SELECT doc_id, speaker, CAST(sum(length(what)) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{SPOKEN}', 1)) AS speaker, unnest(regexp_extract_all(coalesce(text, ''), '{SPOKEN}', 2)) AS what FROM documents) a GROUP BY doc_id, speaker)
    SELECT doc_id, speaker, round(round(s, 9), 3) AS share, CASE WHEN round(s, 9) > 0.1 THEN 'dominates' ELSE 'cameo_monologue' END AS finding FROM (SELECT *, chars / sum(chars) OVER (PARTITION BY doc_id) AS s FROM p) b WHERE round(s, 9) > 0.1 OR (speaker IN ('The', 'That') AND chars > 20)""",
)
def _(t):
    return s.speech_shares(text.speakers(t.documents.where("text is not null"), SPOKEN), "doc_id", 0.1, ("The", "That"), 20)
