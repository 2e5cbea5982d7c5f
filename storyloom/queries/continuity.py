"""Chapters against the states that held at their time, with SQL of its own (its as-of joins). Short words stand for names, events for the log of states."""

from pyspark.sql import functions as F

from storyloom.operators import continuity as c
from storyloom.plans.registry import Catalog, Tables

query = Catalog()

NAMES = ["Les", "Der", "Ent", "Ing", "Que", "Ver", "The", "Una", "Por", "Ich"]
LISTED = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
M = c.LATIN
KINDS = {"signup": "active", "error": "dormant", "purchase": "dead"}
TEXTS = "SELECT d.source AS book, k.ch_num, coalesce(d.text, '') AS text FROM documents d JOIN chapters k ON k.doc_id = d.doc_id"
MENTIONS = f"SELECT * FROM (SELECT book, ch_num, text, unnest({LISTED}) AS character FROM ({TEXTS}) a) b WHERE contains(text, character)"
LOG = f"SELECT character, ch_num, lifecycle FROM (SELECT *, row_number() OVER (PARTITION BY character, ch_num ORDER BY event_id DESC) AS k FROM (SELECT {LISTED}[user_id % 10 + 1] AS character, chapter_id % 13 AS ch_num, event_id, CASE event_type WHEN 'signup' THEN 'active' WHEN 'error' THEN 'dormant' WHEN 'purchase' THEN 'dead' ELSE 'unintroduced' END AS lifecycle FROM sag_events) e) f WHERE k = 1"


def chapters(t: Tables):
    return t.documents.join(t.chapters, "doc_id").select("book", "ch_num", F.coalesce("text", F.lit("")).alias("text"))


def character(n):
    return F.element_at(F.array(*[F.lit(x) for x in NAMES]), (n % len(NAMES) + 1).cast("int"))


def known(t: Tables):
    characters = t.sag_events.select(character(F.col("user_id")).alias("character")).distinct()
    return c.mentions(chapters(t), characters, [])


def around(n: int) -> str:
    return f"regexp_extract_all(text, '.{{0,{n}}}' || character || '.{{0,{n}}}')"


NEAR = "substr(text, greatest(1, instr(text, character) - 100), instr(text, character) + 100 - greatest(1, instr(text, character) - 100))"


@query(
    "lifecycle_scan",
    f"""
    WITH m AS ({MENTIONS}), l AS ({LOG}), s AS (SELECT m.*, l.lifecycle FROM m ASOF JOIN l ON m.character = l.character AND m.ch_num >= l.ch_num),
    p AS (SELECT *, list_filter({around(30)}, lambda x: NOT regexp_matches(x, '{M.memory}')) AS plain FROM s),
    q AS (SELECT *, list_filter(plain, lambda x: regexp_matches(x, character || '.*?(?:{M.speech})') OR regexp_matches(x, character || '.*?(?:{M.action})'))[1] AS hit FROM p)
    SELECT book, ch_num, character, lifecycle, CASE WHEN regexp_matches(hit, character || '.*?(?:{M.speech})') THEN 'dead_speaks' ELSE 'dead_acts' END AS finding FROM q WHERE lifecycle = 'dead' AND hit IS NOT NULL
    UNION ALL SELECT book, ch_num, character, lifecycle, 'dead_referenced' FROM s WHERE lifecycle = 'dead' AND len(list_filter({around(20)}, lambda x: NOT regexp_matches(x, '{M.memory}'))) > 0
    UNION ALL SELECT book, ch_num, character, lifecycle, 'unintroduced_friend' FROM s WHERE lifecycle = 'unintroduced' AND (regexp_matches(text, '(?:{M.friend}|{M.long_ago}).*?' || character) OR regexp_matches(text, character || '.*?(?:{M.friend})'))
    UNION ALL SELECT book, ch_num, character, lifecycle, 'dormant_appears' FROM s WHERE lifecycle = 'dormant' AND len(list_filter({around(50)}, lambda x: NOT regexp_matches(x, '{M.waking}'))) > 0
    UNION ALL SELECT book, ch_num, character, lifecycle, 'dormant_unwoken' FROM s WHERE lifecycle = 'dormant' AND NOT regexp_matches({NEAR}, '{M.waking}|{M.waking_more}')""",
)
def _(t):
    status = F.coalesce(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])[F.col("event_type")], F.lit("unintroduced"))
    log = t.sag_events.select(character(F.col("user_id")).alias("character"), (F.col("chapter_id") % 13).alias("ch_num"), "event_id", status.alias("lifecycle"))
    return c.lifecycle_findings(c.as_of(known(t), log, ["character"], "ch_num", ["event_id"], ["lifecycle"], span=4), ["book", "ch_num"], M)


PAIRS = f"SELECT a, b, ch_num, relation FROM (SELECT *, row_number() OVER (PARTITION BY a, b, ch_num ORDER BY event_id DESC) AS k FROM (SELECT {LISTED}[user_id % 10 + 1] AS a, {LISTED}[(user_id * 3 + 1) % 10 + 1] AS b, chapter_id % 13 AS ch_num, event_id, CASE event_type WHEN 'error' THEN 'hostile' WHEN 'purchase' THEN 'close' WHEN 'click' THEN 'hostile' ELSE 'neutral' END AS relation FROM sag_events) e WHERE a <> b) f WHERE k = 1"


@query(
    "relation_scan",
    f"""
    WITH t AS ({TEXTS}), m AS ({MENTIONS}), l AS ({PAIRS}), w AS (SELECT book, ch_num, a, b FROM (SELECT DISTINCT book, ch_num FROM t) x CROSS JOIN (SELECT DISTINCT a, b FROM l) y),
    r AS (SELECT w.*, l.relation FROM w ASOF JOIN l ON w.a = l.a AND w.b = l.b AND w.ch_num >= l.ch_num),
    h AS (SELECT r.*, m.text, n.character IS NOT NULL AS here FROM r JOIN m ON m.book = r.book AND m.ch_num = r.ch_num AND m.character = r.a LEFT JOIN m n ON n.book = r.book AND n.ch_num = r.ch_num AND n.character = r.b),
    g AS (SELECT *, list_filter(list_transform(list_filter(range(1, length(text) + 1), lambda i: relation = 'hostile' AND here AND substr(text, i, length(a)) = a), lambda i: substr(text, i, 500)), lambda x: contains(x, b))[1] AS met FROM h)
    SELECT book, ch_num, a, b, relation, 'calm_enemies' AS finding FROM g WHERE relation = 'hostile' AND here AND met IS NOT NULL AND NOT regexp_matches(met, '{M.conflict}')
    UNION ALL SELECT book, ch_num, a, b, relation, 'absent_friend' FROM g WHERE relation = 'close' AND NOT here AND NOT regexp_matches(substr(text, greatest(1, instr(text, a) - 100), instr(text, a) + 200 - greatest(1, instr(text, a) - 100)), '{M.absence}')""",
)
def _(t):
    kind = F.create_map(*[F.lit(x) for p in {"error": "hostile", "purchase": "close", "click": "hostile"}.items() for x in p])
    log = t.sag_events.select(character(F.col("user_id")).alias("a"), character(F.col("user_id") * 3 + 1).alias("b"), (F.col("chapter_id") % 13).alias("ch_num"), "event_id", F.coalesce(kind[F.col("event_type")], F.lit("neutral")).alias("relation")).where("a <> b")
    met = known(t)
    asked = met.select("book", "ch_num", F.col("character").alias("a")).join(log.select("a", "b").distinct(), "a")
    relations = c.as_of(asked, log, ["a", "b"], "ch_num", ["event_id"], ["relation"], span=4)
    return c.relation_findings(met, relations, ["book", "ch_num"], M)


RULES = ("heit den", "tion the", "ment de")


@query(
    "canon_conflicts",
    f"""
    WITH t AS ({TEXTS}) SELECT book, ch_num, 'deprecated_rule' AS finding, rule AS detail FROM (SELECT *, unnest(['{"', '".join(RULES)}']) AS rule FROM t) a WHERE contains(text, rule)
    UNION ALL SELECT book, ch_num, 'impossible_marks', CAST(len(regexp_extract_all(text, '{M.impossible}')) AS VARCHAR) FROM t WHERE len(regexp_extract_all(text, '{M.impossible}')) > 5""",
)
def _(t):
    return c.canon_conflicts(chapters(t), ["book", "ch_num"], RULES, M)


CONDUCT = c.Conduct("[A-Za-zà-ÿ]", ("ment de", "tion the", "heit der"), ((("calm",), "och|ung", "calm_rages"), (("kind",), "que|able", "kind_is_cruel")), r"([a-z]{2,3})(?:tion|ment|heit)", ((r"([A-Z])[a-z]+ .*?(?:on|er) ([a-z]{1,4})e", "eyes"), (r"([A-Z])[a-z]+ .*?(?:la|en) ([a-z]{1,4})n", "hair")))
PEOPLE = [(n, ["calm"] if k % 3 == 0 else ["kind"] if k % 3 == 1 else ["calm", "kind"]) for k, n in enumerate(NAMES)]
COUNTED = CONDUCT.counted


def trait_sql(trait: str, acts: str, finding: str) -> str:
    held = ", ".join(f"'{n}'" for n, traits in PEOPLE if trait in traits)
    return f"SELECT book, ch_num, '{finding}' AS finding, who AS detail FROM (SELECT *, unnest([{held}]) AS who FROM t) a WHERE regexp_matches(text, who || '.*?(?:{acts})')"


def colour_sql(pattern: str, finding: str) -> str:
    return f"""SELECT book, ch_num, '{finding}' AS finding, who || ':' || before || '>' || colour AS detail FROM (SELECT book, ch_num, i, who, colour, lag(colour) OVER (PARTITION BY book, ch_num, who ORDER BY i) AS before
      FROM (SELECT book, ch_num, unnest(regexp_extract_all(text, '{pattern}', 1)) AS who, unnest(regexp_extract_all(text, '{pattern}', 2)) AS colour, generate_subscripts(regexp_extract_all(text, '{pattern}', 1), 1) AS i FROM t) a) b WHERE before <> colour"""


@query(
    "conduct_scan",
    f"""
    WITH t AS (SELECT * FROM ({TEXTS}) x WHERE len(regexp_extract_all(text, '{CONDUCT.letters}')) >= 100)
    SELECT book, ch_num, 'forced_acts' AS finding, CAST(n AS VARCHAR) AS detail FROM (SELECT *, {" + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in CONDUCT.forced)} AS n FROM t) a WHERE n > 3
    UNION ALL {" UNION ALL ".join(trait_sql(traits[0], acts, name) for traits, acts, name in CONDUCT.against)}
    UNION ALL SELECT book, ch_num, 'many_numbers', CAST(len(l) AS VARCHAR) FROM (SELECT *, regexp_extract_all(text, '{COUNTED}', 1) AS l FROM t) a WHERE len(l) > 20 AND len(list_distinct(l)) > 10
    UNION ALL {" UNION ALL ".join(colour_sql(p, name) for p, name in CONDUCT.colours)}""",
)
def _(t):
    people = t.spark.createDataFrame(PEOPLE, "character string, traits array<string>")
    return c.conduct_findings(chapters(t), people, ["book", "ch_num"], conduct=CONDUCT)
