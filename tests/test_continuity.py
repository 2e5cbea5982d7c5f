"""States at the time of a chapter, in the domain's script, and as-of joins against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.operators import continuity as c


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_as_of_against_a_loop(spark, span):
    r = random.Random(span)
    log = [(r.choice("abc"), r.randint(-5, 30), i, r.choice(["x", "y", None])) for i in range(40)]
    rows = [(r.choice("abcd"), r.randint(-8, 40), i) for i in range(120)] + [(None, 3, 900), ("a", None, 901)]
    got = c.as_of(spark.createDataFrame(rows, "who string, at int, n int").repartition(4), spark.createDataFrame(log, "who string, at int, seq int, state string").repartition(3), ["who"], "at", ["seq"], ["state"], span)
    assert got.columns == ["who", "at", "n", "state"]

    def want(who, at):
        known = [x for x in log if at is not None and x[0] == who and x[1] <= at]
        return max(known, key=lambda x: (x[1], x[2]))[3] if known else None

    assert {x.n: x.state for x in got.collect()} == {n: want(who, at) for who, at, n in rows if who is not None and at is not None}


CHAPTERS = [
    (1, "林风走进山门，拔剑出手。"),
    (2, "众人怀念林风，墓碑之前无人说话。"),
    (3, "林风说道：“我回来了。”苏瑶站在一旁。"),
    (4, "林风挥剑而立。苏瑶忽然看见了他。"),
    (5, "苏瑶苏醒，再次登场。老朋友赵云也在。"),
    (6, "苏瑶坐在窗前。"),
    (7, "赵云来了，好久不见赵云。"),
    (8, "林风与苏瑶同席，二人谈笑。"),
    (9, "林风与苏瑶对峙，杀意顿起。"),
    (10, "赵云独自守城。"),
    (11, "赵云守城。"),
]
LOG = [("林风", 1, 1, "active"), ("林风", 2, 2, "dead"), ("林风", 8, 3, "active"), ("苏瑶", 1, 4, "active"), ("苏瑶", 4, 5, "dormant"), ("苏瑶", 7, 6, "active"), ("赵云", 0, 7, "unintroduced"), ("赵云", 7, 8, "unintroduced"), ("赵云", 7, 9, "active")]


@pytest.fixture(scope="module")
def met(spark):
    chapters = spark.createDataFrame([("甲", n, t) for n, t in CHAPTERS], "book string, ch_num long, text string")
    people = spark.createDataFrame([("甲", "林风"), ("甲", "苏瑶"), ("甲", "赵云"), ("甲", ""), ("乙", "林")], "book string, character string")
    return c.mentions(chapters, people, ["book"])


def test_lifecycles_at_the_right_chapter(spark, met):
    log = spark.createDataFrame([("甲", *x) for x in LOG], "book string, character string, ch_num long, seq long, lifecycle string")
    known = c.as_of(met, log, ["book", "character"], "ch_num", ["seq"], ["lifecycle"], span=2)
    got = {(x.ch_num, x.character, x.finding) for x in c.lifecycle_findings(known, ["book", "ch_num"]).collect()}
    assert got == {
        (3, "林风", "dead_speaks"),
        (3, "林风", "dead_referenced"),
        (4, "林风", "dead_acts"),
        (4, "林风", "dead_referenced"),
        (4, "苏瑶", "dormant_appears"),
        (4, "苏瑶", "dormant_unwoken"),
        (6, "苏瑶", "dormant_appears"),
        (6, "苏瑶", "dormant_unwoken"),
        (5, "赵云", "unintroduced_friend"),
    }


def test_relations_at_the_right_chapter(spark, met):
    log = spark.createDataFrame([("甲", "林风", "苏瑶", 1, 1, "close"), ("甲", "林风", "苏瑶", 3, 2, "hostile"), ("甲", "赵云", "苏瑶", 9, 3, "close")], "book string, a string, b string, ch_num long, seq long, relation string")
    asked = met.select("book", "ch_num", F.col("character").alias("a")).join(log.select("book", "a", "b").distinct(), ["book", "a"])
    relations = c.as_of(asked, log, ["book", "a", "b"], "ch_num", ["seq"], ["relation"])
    got = {(x.ch_num, x.a, x.b, x.finding) for x in c.relation_findings(met, relations, ["book", "ch_num"]).collect()}
    assert got == {(1, "林风", "苏瑶", "absent_friend"), (2, "林风", "苏瑶", "absent_friend"), (3, "林风", "苏瑶", "calm_enemies"), (4, "林风", "苏瑶", "calm_enemies"), (8, "林风", "苏瑶", "calm_enemies"), (11, "赵云", "苏瑶", "absent_friend")}


def test_names_with_signs_are_plain(spark):
    chapters = spark.createDataFrame([(1, "A.B说道"), (2, "AxB说道")], "ch_num long, text string")
    people = spark.createDataFrame([("A.B",)], "character string")
    known = c.mentions(chapters, people, []).withColumn("lifecycle", F.lit("dead"))
    assert {(x.ch_num, x.finding) for x in c.lifecycle_findings(known, ["ch_num"]).collect()} == {(1, "dead_speaks"), (1, "dead_referenced")}


def test_canon(spark):
    chapters = spark.createDataFrame([(1, "飞升之法已废，不可能" + "，怎么会" * 5), (2, "不可能"), (3, None)], "ch_num long, text string")
    got = {(x.ch_num, x.finding, x.detail) for x in c.canon_conflicts(chapters, ["ch_num"], ["飞升之法", "灵根"]).collect()}
    assert got == {(1, "deprecated_rule", "飞升之法"), (1, "impossible_marks", "6")}


def test_conduct(spark):
    long = "天地玄黄宇宙洪荒" * 15
    texts = [
        (1, "林风不知为何停下，又不得不走，无奈叹气，被迫出手。" + long),
        (2, "林风忽然暴怒。苏瑶依旧温和，苏瑶出手残忍。" + long),
        (3, "".join(f"{n}个人" for n in range(10, 32)) + long),
        (4, "瑶有一双青色。瑶睁开眼睛，是黑色。瑶一头银色。" + long),
        (5, "林风暴怒"),
        (6, None),
    ]
    people = spark.createDataFrame([("林风", ["冷静"]), ("苏瑶", ["善良", "理智"]), ("", ["冷静"])], "character string, traits array<string>")
    got = {(r.ch_num, r.finding, r.detail) for r in c.conduct_findings(spark.createDataFrame(texts, "ch_num long, text string"), people, ["ch_num"]).collect()}
    assert {g for g in got if g[0] != 4} == {(1, "forced_acts", "4"), (2, "calm_rages", "林风"), (2, "kind_is_cruel", "苏瑶"), (3, "many_numbers", "22")}
    assert {g[1:] for g in got if g[0] == 4} == {("eyes", "瑶:青>是黑")}
