"""Names that are alike and marks in windows, in the domain's script, against loops."""

import collections
import itertools
import random
import re

from storyloom.operators import names as n

ALL = "王林 王琳 王木林 王木琳 王大林 李慕白 李慕云 李小白 张三丰 张三风 张四丰 赵云".split()


def text_of(seed):
    r = random.Random(seed)
    return "，".join(r.choice(ALL + ["没有他们", "今天", "我们"]) for _ in range(r.choice([0, 3, 60])))


def counted(text):
    found = re.findall("[一-鿿]{2,3}", text or "")
    return collections.Counter(x for x in found if x[0] in n.SURNAMES and not any(w in x for w in n.NO_NAMES))


def by_loop(text):
    c = counted(text)
    pairs = [(a, b) for a, b in itertools.combinations(sorted(c), 2) if a[0] == b[0] and len(a) == len(b) and sum(x == y for x, y in zip(a, b, strict=True)) >= 2]
    rare = [x for x, k in c.items() if sum(c.values()) > 20 and k == 1 and len(x) == 3 and any(o != x and m >= 3 and o[0] == x[0] and len(o) == 3 for o, m in c.items())]
    return sorted(pairs), (len(c), len(rare), len(pairs), max(0, 100 - 5 * len(rare) - 3 * len(pairs)))


def test_names_against_all_pairs(spark):
    texts = {i: text_of(i) for i in range(40)} | {90: None, 91: "", 92: "王木林" + "，张三丰" * 30 + "，张三风"}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    pairs = collections.defaultdict(list)
    for r in n.similar_pairs(n.name_counts(docs, "id"), "id").collect():
        pairs[r.id].append((r.a, r.b))
        assert (r.n_a, r.n_b) == (counted(texts[r.id])[r.a], counted(texts[r.id])[r.b])
    score = {r.id: (r.n_names, r.n_rare, r.n_pairs, r.score) for r in n.name_consistency(docs, "id").collect()}
    for i, t in texts.items():
        want = by_loop(t)
        assert (sorted(pairs[i]), score[i]) == want, i
    assert sum(s[1] for s in score.values()) > 0 and sum(s[2] for s in score.values()) > 0


def test_pairs_meet_by_keys(spark):
    docs = spark.createDataFrame([(1, "王木林，王木琳")], "id long, text string")
    plan = n.similar_pairs(n.name_counts(docs, "id"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


MARKS = ["不禁", "不由得", "禁不", "心中一动", "中一", "动", "aa"]


def test_windows_against_a_scan_of_each(spark):
    r = random.Random(7)
    texts = {0: None, 1: "", 2: "不禁" * 50, 3: "不禁" * 50 + "动", 4: "不" * 250, 5: "，".join(["心中一动不禁"] * 60), 6: "a 不禁 " * 80}
    texts |= {10 + i: "".join(r.choice(["不禁", "不由得", "心中一", "动", "好", "坏", "，", "一"]) for _ in range(r.choice([90, 150, 400]))) for i in range(25)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    got = {x.id: (x.n_windows, x.density) for x in n.window_density(docs, "id", MARKS).collect()}
    for i, t in texts.items():
        letters = "".join(re.findall("[一-鿿]", t or ""))
        windows = [letters[k : k + 100] for k in range(0, len(letters) - 100, 50)]
        assert got[i] == (len(windows), round(max((sum(m in w for m in MARKS) for w in windows), default=0) / 100, 4)), i


def test_places_of_overlapping_marks(spark):
    text = "aaab心中一动不禁不禁aa"
    row = spark.createDataFrame([(text,)], "t string").select(n.hit_places(n.F.col("t"), MARKS).alias("h")).first()
    want = sorted((w, i) for w in MARKS for i in range(len(text)) if text.startswith(w, i))
    assert sorted((x.word, x["at"]) for x in row.h) == want


def test_containment_against_a_nested_loop(spark):
    from storyloom.operators import story

    r = random.Random(11)
    some = ["".join(r.choice("地球游戏场ab") for _ in range(r.choice([1, 2, 3, 5, 6, 7, 8, 12]))) for _ in range(120)] + ["", "《地球游戏场》（校对版全本）", "《地球游戏场》（校对版全本）作者：某", None, None]
    left, right = some[:70] + ["", None, "《地球游戏场》（校对版全本）"], some[40:]

    def meet(a, b):
        n = max(6, min(len(a), len(b), 8))
        return a[:n] in b or b[:n] in a

    want = sorted({(a, b) for a in left for b in right if a is not None and b is not None and meet(a, b)})
    x, y = spark.createDataFrame([(v,) for v in left], "a string").repartition(3), spark.createDataFrame([(v,) for v in right], "b string").repartition(2)
    pairs = story.prefix_pairs(x, y, "a", "b")
    assert sorted(map(tuple, pairs.collect())) == want
    assert {z.a: z.b for z in story.prefix_matches(x, y, "a", "b").collect()} == {a: min(v for k, v in want if k == a) for a, _ in want}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
