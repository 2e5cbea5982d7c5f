"""The book store, stores whose columns grow, and nested shapes, over the given tables, with SQL of their own."""

from pyspark.sql import functions as F

from storyloom.functions.storage import shared_dir
from storyloom.plans.registry import Catalog, Tables
from storyloom.sources import library as lib

query = Catalog()


def stored(t: Tables) -> str:
    """The documents as books: genre is the language, book the source. One book is then written again in capitals."""
    path = f"{shared_dir(t.spark)}/books"
    rows = t.documents.select(F.col("lang").alias("genre"), F.col("source").alias("book"), "doc_id", "text")
    lib.write_books(rows, path)
    again = rows.where("genre = 'en'").join(rows.where("genre = 'en'").agg(F.min("book").alias("book")), "book", "left_semi")
    lib.write_books(again.select("genre", "book", "doc_id", F.upper("text").alias("text")), path)
    return path


#: Letters whose capitals are two letters or three, as SS for the sharp s; the checking engine's upper() leaves them one.
TWO, THREE = ("".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) == n) for n in (2, 3))


@query(
    "genre_scan",
    f"""SELECT genre, book, count(*) AS n, CAST(sum(coalesce(CASE WHEN again THEN length(regexp_replace(regexp_replace(text, '[{TWO}]', 'SS', 'g'), '[{THREE}]', 'FFI', 'g')) ELSE length(text) END, 0)) AS BIGINT) AS chars,
      count(*) FILTER (WHERE text IS NOT NULL AND again OR text = upper(text) AND NOT regexp_matches(text, '[{TWO}{THREE}]')) AS capital
    FROM (SELECT lang AS genre, source AS book, text, lang = 'en' AND source = (SELECT min(source) FROM documents WHERE lang = 'en') AS again FROM documents WHERE lang IN ('en', 'de')) a GROUP BY genre, book""",
)
def _(t):
    """The books of two genres: only their folders are read."""
    books = lib.scan_books(t.spark, stored(t), genres=["de", "en"])
    return books.groupBy("genre", "book").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"), F.count_if(F.col("text") == F.upper("text")).alias("capital"))


@query("book_folders", "SELECT DISTINCT coalesce(lang, 'unsorted') AS genre, coalesce(source, 'unsorted') AS book FROM documents")
def _(t):
    """The store's listing, from its folders."""
    return lib.listing(t.spark, stored(t))


STATES = {"narrative_weight": "supporting", "appearance_cooldown": 0, "relationships": "{}"}


@query(
    "evolving_store",
    """SELECT event_id AS id, chapter_id AS ch_num, user_id AS character, CASE WHEN event_id % 3 > 0 AND event_type <> 'view' THEN event_type ELSE 'supporting' END AS narrative_weight,
      CAST(CASE WHEN event_id % 3 = 2 THEN user_id % 7 ELSE 0 END AS INTEGER) AS appearance_cooldown, '{}' AS relationships FROM sag_events""",
)
def _(t):
    """States written under three versions of their columns, the older two migrated twice, read as one table."""
    path = f"{shared_dir(t.spark)}/states"
    e = t.sag_events.select(F.col("event_id").alias("id"), F.col("chapter_id").alias("ch_num"), F.col("user_id").alias("character"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("narrative_weight"), (F.col("user_id") % 7).cast("int").alias("appearance_cooldown"))
    lib.append_version(e.where("id % 3 = 0").drop("narrative_weight", "appearance_cooldown"), path, 1)
    lib.append_version(e.where("id % 3 = 1").drop("appearance_cooldown"), path, 2)
    lib.append_version(e.where("id % 3 = 2"), path, 3)
    lib.migrate(t.spark, path, 3, STATES)
    lib.migrate(t.spark, path, 3, STATES)
    return lib.read_versions(t.spark, path, STATES).drop("v")


SHAPE = {"id": "long", "who": {"user": "long", "name": "string"}, "props": [{"k": "long", "tags": ["string"]}]}


@query(
    "nested_shapes",
    """
    WITH e AS (SELECT event_id, user_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)
    SELECT event_id, '$.who.name' AS path, 'missing' AS problem FROM e WHERE event_id % 3 <> 0
    UNION ALL SELECT event_id, '$.who.user', 'expected long, got string' FROM e WHERE event_id % 7 = 1
    UNION ALL SELECT event_id, '$.props[1].k', 'missing' FROM e WHERE event_id % 5 = 0
    UNION ALL SELECT event_id, '$.props[0].tags[' || (user_id % 3) || ']', 'expected string, got long' FROM e
    UNION ALL SELECT event_id, '$.props[1].tags', 'expected list, got null' FROM e""",
)
def _(t):
    """Nested records made of events, with wrong and missing fields at three depths."""
    k = F.coalesce(F.get_json_object("props", "$.k"), F.lit("0"))
    user = F.when(F.col("event_id") % 7 == 1, F.concat(F.lit('"u'), "user_id", F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    name = F.when(F.col("event_id") % 3 == 0, F.lit(', "name": "x"')).otherwise("")
    tags = F.concat(F.repeat(F.lit('"t", '), (F.col("user_id") % 3).cast("int")), F.lit('5, "last"'))
    second = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise('"k": 1, ')
    raw = F.concat(F.lit('{"id": '), "event_id", F.lit(', "who": {"user": '), user, name, F.lit('}, "props": [{"k": '), k, F.lit(', "tags": ['), tags, F.lit("]}, {"), second, F.lit('"tags": null}]}'))
    return lib.shape_errors(t.events.select("event_id", raw.alias("json")), "event_id", "json", SHAPE)
