"""Point-in-time state: what was known of a character, or of a pair of them, at the chapter that mentions them.

States are logs. A mention meets the last entry of its key that is not later than its chapter (an as-of join): entries and mentions are put
in one order and the last entry is carried on. Keys are cut into stretches of chapters; a stretch takes over the last
entry of those before it from a table with a row for each stretch, so that a key with very many rows is dealt over many tasks.

The rules look at the words around each place of a name. A dead character may be remembered but not speak or act; one that was never
introduced is no old friend; a sleeping one has to be woken; enemies who meet without a conflict, and close ones of whom only one is
there without a word about the other, need a reason.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.columns import total


@dataclass(frozen=True)
class Marks:
    """Alternatives of regular expressions."""

    memory: str
    speech: str
    action: str
    friend: str
    long_ago: str
    waking: str
    waking_more: str
    conflict: str
    absence: str
    impossible: str


# Marks of the domain's script.
ZH = Marks(
    memory="回忆|记得|当年|曾经|往事|墓|碑|遗|亡|死|牺牲|缅怀|怀念|思念",
    speech="说道?|道|喊道?|笑道?|怒道",
    action="走|跑|跳|挥|打|抓|推|拉|站|坐",
    friend="老朋友|老搭档|老相识|旧友|故人",
    long_ago="多年不见|好久不见|别来无恙",
    waking="唤醒|苏醒|重新|再次|回归|复出|出现|登场|醒来",
    waking_more="解除封印|破封|出关",
    conflict="战斗|冲突|对峙|怒视|冷哼|拔剑|出手|攻击|杀意|敌意",
    absence="不在|离开|去了|出差|外出|留守|看家|等候|独自",
    impossible="不可能|不应该|怎能|怎么会",
)
# Syllables that stand for them in the sample tables.
LATIN = Marks("ment|tion", "ing|ait", "ver|ent|on", "heit|able", "elle|ción", "re|un|mo", "och", "ch|er", "ou|in", "que|ung")


def as_of(rows: DataFrame, log: DataFrame, keys: Sequence[str], at: str, order: Sequence[str], values: Sequence[str], span: int = 100) -> DataFrame:
    """The rows with the values of the last log entry of their keys whose `at` is not later; entries of one `at` by `order`, the last one holds. Null where there is none. span: the places of one stretch."""
    names, c = [f"#{v}" for v in values], F.col
    entry = F.struct(c(at), *[c(o) for o in order], *[c(v).alias(n) for v, n in zip(values, names, strict=True)])
    stretch = F.floor(c(at) / span)
    entries = log.select(*keys, stretch.alias("#stretch"), c(at), entry.alias("#entry"))
    ends = entries.groupBy(*keys, "#stretch").agg(F.max("#entry").alias("#end"))
    asked = rows.select(*keys, stretch.alias("#stretch"), c(at), F.struct(*[c(x) for x in rows.columns]).alias("#row"))
    kind = asked.schema["#row"].dataType
    both = entries.select(*keys, "#stretch", at, "#entry", F.lit(None).cast(kind).alias("#row"), F.lit(0).alias("#kind")).unionByName(
        asked.select(*keys, "#stretch", at, F.lit(None).cast(entries.schema["#entry"].dataType).alias("#entry"), "#row", F.lit(1).alias("#kind"))
    )
    within = Window.partitionBy(*keys, "#stretch").orderBy(at, "#kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("#near", F.max("#entry").over(within)).where(F.col("#kind") == 1)
    # of each stretch that is asked for, the last entry of those before it
    wanted = asked.select(*keys, "#stretch").distinct()
    line = ends.select(*keys, "#stretch", "#end", F.lit(0).alias("#ask")).unionByName(wanted.select(*keys, "#stretch", F.lit(None).cast(ends.schema["#end"].dataType).alias("#end"), F.lit(1).alias("#ask")))
    before = Window.partitionBy(*keys).orderBy("#stretch").rangeBetween(Window.unboundedPreceding, -1)
    carried = line.withColumn("#before", F.max("#end").over(before)).where("`#ask` = 1").select(*keys, "#stretch", "#before")
    met = near.join(carried, [*keys, "#stretch"])
    found = F.coalesce("#near", "#before")
    return met.select("#row.*", *[found[n].alias(v) for n, v in zip(names, values, strict=True)])


def mentions(chapters: DataFrame, characters: DataFrame, by: Sequence[str], text: str = "text", name: str = "character") -> DataFrame:
    """The chapters' rows once for each character whose name the text holds. characters: (by, name), some hundred of a book; the names of a book are met as one array."""
    known = characters.groupBy(*by).agg(F.collect_set(name).alias("#names")) if by else characters.agg(F.collect_set(name).alias("#names"))
    met = chapters.join(known, list(by)) if by else chapters.join(F.broadcast(known))
    return met.select(*chapters.columns, F.explode(F.filter("#names", lambda x: (F.length(x) > 0) & F.contains(F.col(text), x))).alias(name))


def quoted(name: Column) -> Column:
    return F.concat(F.lit("\\Q"), name, F.lit("\\E"))


def around(text: Column, name: Column, letters: int) -> Column:
    """The texts around the places of a name, up to so many letters on both sides in its line."""
    return F.regexp_extract_all(text, F.concat(F.lit(f"(.{{0,{letters}}}"), quoted(name), F.lit(f".{{0,{letters}}})")), F.lit(1))


def near_first(text: Column, name: Column, before: int, after: int) -> Column:
    """The letters before and after the first place of a name."""
    at = F.instr(text, name)
    start = F.greatest(F.lit(1), at - before)
    return F.substring(text, start, at + after - start)


def lifecycle_findings(mentioned: DataFrame, by: Sequence[str], marks: Marks = ZH, text: str = "text", name: str = "character", lifecycle: str = "lifecycle") -> DataFrame:
    """(by, name, lifecycle, finding) of mentions with the lifecycle that held at the time: dead_speaks, dead_acts, dead_referenced, unintroduced_friend, dormant_appears, dormant_unwoken."""
    t, n, c = F.col(text), F.col(name), F.col
    then = lambda x, m: F.regexp_like(x, F.concat(quoted(n), F.lit(f".*?(?:{m})")))
    plain = F.filter(around(t, n, 30), lambda x: ~F.rlike(x, F.lit(marks.memory)))
    first = F.try_element_at(F.filter(plain, lambda x: then(x, marks.speech) | then(x, marks.action)), F.lit(1))
    friendly = F.regexp_like(t, F.concat(F.lit(f"(?:{marks.friend}|{marks.long_ago}).*?"), quoted(n))) | F.regexp_like(t, F.concat(quoted(n), F.lit(f".*?(?:{marks.friend})")))
    state = c(lifecycle)
    findings = F.array(
        F.when((state == "dead") & first.isNotNull(), F.when(then(first, marks.speech), "dead_speaks").otherwise("dead_acts")),
        F.when((state == "dead") & F.exists(around(t, n, 20), lambda x: ~F.rlike(x, F.lit(marks.memory))), "dead_referenced"),
        F.when((state == "unintroduced") & friendly, "unintroduced_friend"),
        F.when((state == "dormant") & F.exists(around(t, n, 50), lambda x: ~F.rlike(x, F.lit(marks.waking))), "dormant_appears"),
        F.when((state == "dormant") & ~F.rlike(near_first(t, n, 100, 100), F.lit(f"{marks.waking}|{marks.waking_more}")), "dormant_unwoken"),
    )
    return mentioned.where(state.isNotNull()).select(*by, name, lifecycle, F.explode(F.array_compact(findings)).alias("finding"))


def relation_findings(mentioned: DataFrame, relations: DataFrame, by: Sequence[str], marks: Marks = ZH, text: str = "text", name: str = "character", kind: str = "relation") -> DataFrame:
    """(by, a, b, relation, finding): enemies who meet within 500 letters without a conflict (calm_enemies), close ones of whom b is not there and nothing is said of it (absent_friend). relations: (by, a, b, relation) as it held at the chapter."""
    t, c = F.col(text), F.col
    present = mentioned.select(*by, F.col(name).alias("b"), F.lit(True).alias("here"))
    rows = mentioned.withColumnRenamed(name, "a").join(relations.select(*by, "a", "b", kind), [*by, "a"]).join(present, [*by, "b"], "left")

    def meeting(a: Column, b: Column) -> Column:
        """The first 500 letters from a place of a on that hold b; the text is cut at each a."""
        pieces = F.split(t, F.concat(F.lit("(?="), quoted(a), F.lit(")")), -1)
        ends = F.aggregate(pieces, F.array(F.lit(0)), lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + F.length(p))))
        tails = F.transform(ends, lambda at: F.substring(t, at + 1, 500))
        return F.try_element_at(F.filter(tails, lambda x: F.startswith(x, a) & F.contains(x, b)), F.lit(1))

    met = meeting(c("a"), c("b"))
    calm = (c(kind) == "hostile") & c("here") & met.isNotNull() & ~F.rlike(met, F.lit(marks.conflict))
    absent = (c(kind) == "close") & c("here").isNull() & ~F.rlike(near_first(t, c("a"), 100, 200), F.lit(marks.absence))
    return rows.withColumn("finding", F.when(calm, "calm_enemies").when(absent, "absent_friend")).where("finding is not null").select(*by, "a", "b", kind, "finding")


def canon_conflicts(chapters: DataFrame, by: Sequence[str], deprecated: Sequence[str], marks: Marks = ZH, text: str = "text", most: int = 5) -> DataFrame:
    """(by, finding, detail): rules that no longer hold but are named, and texts with more than `most` words of impossibility."""
    t = F.coalesce(F.col(text), F.lit(""))
    named = F.filter(F.array(*[F.lit(r) for r in deprecated]), lambda r: F.contains(t, r))
    n = F.regexp_count(t, F.lit(marks.impossible))
    rules = F.transform(named, lambda r: F.struct(F.lit("deprecated_rule").alias("finding"), r.alias("detail")))
    often = F.when(n > most, F.array(F.struct(F.lit("impossible_marks").alias("finding"), n.cast("string").alias("detail")))).otherwise(F.array().cast("array<struct<finding:string,detail:string>>"))
    return chapters.select(*by, F.explode(F.concat(rules, often)).alias("f")).select(*by, "f.*")


@dataclass(frozen=True)
class Conduct:
    """Patterns of conduct: acts without a motive, what a calm and what a kind character would not do, counted things, and colours of eyes and hair as (owner, colour)."""

    letters: str
    forced: tuple[str, ...]
    against: tuple[tuple[tuple[str, ...], str, str], ...]  # traits, what contradicts them, the finding
    counted: str
    colours: tuple[tuple[str, str], ...]


# Patterns of the domain's script.
ZH_CONDUCT = Conduct(
    letters="[一-鿿]",
    forced=("(?:不知为何|莫名其妙|鬼使神差|不由自主|不知怎么)", "(?:突然决定|一反常态|破天荒|完全变了)", "(?:为了.*?只好|不得不|被迫|无奈)"),
    against=((("冷静", "理智"), "暴怒|狂怒|失控|疯狂|歇斯底里", "calm_rages"), (("善良", "温柔"), "残忍|冷酷|无情|屠戮|虐杀", "kind_is_cruel")),
    counted=r"(\d+(?:万|千|百|十)?)(?:个|名|位|只|条|把|柄|颗|块|层|阶|级|年|岁|米|里|公里)",
    colours=((r"([\p{L}\p{N}_]+?).*?(?:一双|眼[睛瞳]).*?([^\s，。]{1,4})色", "eyes"), (r"([\p{L}\p{N}_]+?).*?(?:一头|头发|长发|短发).*?([^\s，。]{1,4})色", "hair")),
)


def conduct_findings(chapters: DataFrame, characters: DataFrame, by: Sequence[str], keys: Sequence[str] = (), conduct: Conduct = ZH_CONDUCT, text: str = "text", least: int = 100) -> DataFrame:
    """(by, finding, detail) of chapters of at least `least` letters: too many acts without a motive, characters against their traits, very many counted things, colours that change. characters: (keys, character, traits array), those of a book met as one array."""
    t = F.col("#t")
    known = F.collect_list(F.struct("character", "traits")).alias("#known")
    people = characters.groupBy(*keys).agg(known) if keys else characters.agg(known)
    base = chapters.withColumn("#t", F.coalesce(F.col(text), F.lit(""))).where(F.regexp_count("#t", F.lit(conduct.letters)) >= least)
    rows = base.join(people, list(keys), "left") if keys else base.join(F.broadcast(people))
    found = lambda when, name, detail: F.when(when, F.array(F.struct(F.lit(name).alias("finding"), detail.cast("string").alias("detail")))).otherwise(F.array().cast("array<struct<finding:string,detail:string>>"))
    forced = total([F.regexp_count(t, F.lit(p)) for p in conduct.forced])
    parts = [found(forced > 3, "forced_acts", forced)]

    def broken(traits: Sequence[str], acts: str, name: str) -> Column:
        does = lambda x: (F.length(x["character"]) > 0) & F.arrays_overlap(x["traits"], F.array(*[F.lit(v) for v in traits])) & F.regexp_like(t, F.concat(quoted(x["character"]), F.lit(f".*?(?:{acts})")))
        return F.transform(F.filter(F.coalesce("#known", F.array().cast(people.schema["#known"].dataType)), does), lambda x: F.struct(F.lit(name).alias("finding"), x["character"].alias("detail")))

    parts += [broken(*x) for x in conduct.against]
    numbers = F.regexp_extract_all(t, F.lit(conduct.counted), F.lit(1))
    parts.append(found((F.size(F.array_distinct(numbers)) > 10) & (F.size(numbers) > 20), "many_numbers", F.size(numbers)))

    def changed(pattern: str, name: str) -> Column:
        """Colours that differ from the last one of their owner."""
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)).alias("who"), F.regexp_extract_all(t, F.lit(pattern), F.lit(2)).alias("colour"))

        def of(all_: Column) -> Column:
            last = lambda x, i: F.try_element_at(F.filter(F.slice(all_, F.lit(1), i), lambda y: y["who"] == x["who"]), F.lit(-1))["colour"]
            marked = F.transform(all_, lambda x, i: F.struct(x["who"].alias("who"), x["colour"].alias("colour"), last(x, i).alias("before")))
            return F.transform(F.filter(marked, lambda x: x["before"] != x["colour"]), lambda x: F.struct(F.lit(name).alias("finding"), F.concat(x["who"], F.lit(":"), x["before"], F.lit(">"), x["colour"]).alias("detail")))

        return F.flatten(F.transform(F.array(pairs), of))

    parts += [changed(*x) for x in conduct.colours]
    return rows.select(*by, F.explode(F.concat(*parts)).alias("f")).select(*by, "f.*")
