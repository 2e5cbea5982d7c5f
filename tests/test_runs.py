"""Checks and stages by name, timed runs that go on, reduction trees, and streams with state."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from storyloom.operators import detectors
from storyloom.operators.hooks import Checks, Stages
from storyloom.plans import stages as st
from storyloom.streaming import chapters as ch


def gate(spark, checks=None):
    docs = spark.createDataFrame([(1, "修炼！" * 40, 3), (2, "短", 1), (3, None, 2)], "doc_id long, text string, ch_num long")
    goals = detectors.default_goals(docs, 10, 4000, 1).withColumn("curve", F.lit("any")).withColumn("least_pleasures", F.lit(1))
    shapes = docs.select("doc_id", F.lit("flat").alias("shape"))
    return {r.doc_id: (r.failed, r.result) for r in detectors.goal_gate(docs, shapes, goals, "[一-鿿]", "修炼", checks=checks).collect()}


def test_a_check_changes_the_gate(spark):
    assert gate(spark) == {1: ("", "pass"), 2: ("length,pleasure", "retry"), 3: ("length,pleasure", "retry")}
    checks = Checks()
    checks.add("loud", ["text"], lambda t: F.regexp_count(t, F.lit("！")) < 5)
    checks.add("early", ["ch_num"], lambda n: n > 1, pandas=True, severity="fail")
    assert gate(spark, checks) == {1: ("loud", "retry"), 2: ("length,pleasure,early", "fail"), 3: ("length,pleasure", "retry")}


def test_names_stand_once():
    checks = Checks()
    checks.add("a", ["x"], lambda x: x > 0)
    with pytest.raises(ValueError):
        checks.add("a", ["x"], lambda x: x > 1)
    with pytest.raises(ValueError):
        checks.add("b", ["x"], lambda x: x > 1, severity="never")
    stages = Stages([("a", lambda r: r), ("c", lambda r: r)])
    stages.add("b", lambda r: r, after="a")
    assert stages.names() == ["a", "b", "c"]
    for name, after in (("b", None), ("d", "x")):
        with pytest.raises(ValueError):
            stages.add(name, lambda r: r, after=after)


def test_a_run_goes_on_behind_its_last_stage(spark, tmp_path):
    calls = []

    def stage(name, broken=False):
        def run(rows):
            calls.append(name)
            if broken:
                raise RuntimeError("broken")
            return rows.where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("id"))

        return run

    path, rows = str(tmp_path / "run"), spark.range(16)
    with pytest.raises(RuntimeError):
        st.run_stages(rows, Stages([("one", stage("one")), ("two", stage("two", broken=True))]), path)
    out = st.run_stages(rows, Stages([("one", stage("one")), ("two", stage("two")), ("three", stage("three"))]), path)
    assert calls == ["one", "two", "two", "three"] and sorted(r.id for r in out.collect()) == [0, 1]
    times = {r.stage: (r.place, r.rows, r.seconds > 0) for r in st.stage_times(spark, path).collect()}
    assert times == {"one": (0, 8, True), "two": (1, 4, True), "three": (2, 2, True)}


def leaves(spark, sizes):
    return spark.createDataFrame([(b, i, f"{b}{i}") for b, n in sizes.items() for i in range(n)], "book string, ch_num long, value string").repartition(3)


def tree(sizes, value):
    def node(items):
        return value(items)

    want = {}
    for b, n in sizes.items():
        parts = [f"{b}{i}" for i in range(n)]
        one = [parts[i : i + 8] for i in range(0, n, 8)]
        for k, p in enumerate(one):
            want[b, 1, k] = (len(p), node(p))
        ones = [want[b, 1, k][1] for k in range(len(one))]
        two = [ones[i : i + 5] for i in range(0, len(ones), 5)] if len(ones) >= 3 else [[x] for x in ones]
        for k, p in enumerate(two):
            want[b, 2, k] = (len(p), node(p))
        want[b, 3, 0] = (len(two), node([want[b, 2, k][1] for k in range(len(two))]))
    return want


SIZES = {"甲": 100, "乙": 17, "丙": 3}
DIGEST = lambda _, items: F.sha2(st.joined(items), 256)


def rows_of(df):
    return {(r.book, r.level, r.node): (r.n, r.value) for r in df.collect()}


def test_tree_of_eight_and_five(spark, tmp_path):
    want = tree(SIZES, lambda p: hashlib.sha256("\n".join(p).encode()).hexdigest())
    assert rows_of(st.reduce_tree(leaves(spark, SIZES), str(tmp_path / "t"), DIGEST)) == want


def test_a_tree_broken_after_level_one_goes_on(spark, tmp_path):
    path = str(tmp_path / "t")

    def broken(level, items):
        if level > 1:
            raise RuntimeError("no more today")
        return F.concat(F.lit("first run "), st.joined(items))

    with pytest.raises(RuntimeError):
        st.reduce_tree(leaves(spark, SIZES), path, broken)
    got = rows_of(st.reduce_tree(leaves(spark, SIZES), path, lambda level, items: F.concat(F.lit(f"second run {level} "), F.size(items).cast("string"))))
    assert all(v.startswith("first run") for (_, level, _), (_, v) in got.items() if level == 1)
    assert got["甲", 3, 0] == (3, "second run 3 3")


def test_failed_nodes_are_noted_and_tried_again(spark, tmp_path):
    path = str(tmp_path / "t")
    fails = lambda level, items: F.when(~F.array_contains(F.transform(items, lambda x: x["value"]), "乙0"), F.size(items).cast("string"))
    got = rows_of(st.reduce_tree(leaves(spark, SIZES), path, fails, fallback=lambda level, items: F.lit("instead")))
    assert got["乙", 1, 0] == (8, "instead")
    assert [(r.book, r.level, r.node) for r in st.failed_nodes(spark, path, "book string, level int, node long").collect()] == [("乙", 1, 0)]
    again = rows_of(st.reduce_tree(leaves(spark, SIZES), path, lambda level, items: F.lit("mended")))
    assert again["乙", 1, 0] == (8, "mended") and again["甲", 1, 0] == (8, "8")


def test_unchanged_chapters_are_not_analysed_again(spark, tmp_path):
    path, inbox = str(tmp_path / "q"), str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(inbox)
    read = lambda: spark.readStream.schema("doc_id long, text string").parquet(inbox)
    put([(1, "a"), (2, None), (3, "c")])
    assert ch.run_available(ch.changed_chapters(read()), path).count() == 3
    assert ch.run_available(ch.changed_chapters(read()), path).count() == 3  # nothing new
    put([(1, "a"), (2, ""), (3, "c")])  # the same texts in other files
    assert ch.run_available(ch.changed_chapters(read()), path).count() == 3
    put([(1, "a"), (3, "other"), (4, "new")])
    got = {(r.doc_id, r.text, r.state) for r in ch.run_available(ch.changed_chapters(read()), path).where("text in ('other', 'new')").collect()}
    assert got == {(3, "other", "changed"), (4, "new", "new")}


def test_a_timer_says_that_a_debt_is_overdue(spark, tmp_path):
    path, inbox = str(tmp_path / "q"), str(tmp_path / "in")
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    put = lambda rows: spark.createDataFrame(rows, "owner long, event_id long, ts timestamp, kind string").coalesce(1).write.mode("append").parquet(inbox)

    def run():
        events = spark.readStream.schema("owner long, event_id long, ts timestamp, kind string").parquet(inbox).withWatermark("ts", "1 hour")
        return {(r.owner, r.event_id, r.status) for r in ch.run_available(ch.overdue_debts(events), path).collect()}

    put([(1, 10, day(0), "open"), (1, 11, day(2), "close"), (1, 12, day(3), "open"), (2, 20, day(0), "open")])
    assert run() == {(1, 10, "settled")}
    put([(3, 30, day(11), "close")])  # lets the watermark pass the tenth day
    put([(3, 31, day(11.5), "close")])
    assert run() >= {(1, 10, "settled"), (2, 20, "overdue")} and (1, 12, "overdue") not in run()
    put([(1, 13, day(14), "close")])  # later than the limit, though the timer did not fire yet
    assert (1, 12, "overdue") in run()
