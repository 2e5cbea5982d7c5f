"""Cutting the domain's script into words, against all paths, and search over them."""

import itertools
import math
import random

import pytest

from storyloom.operators import retrieval
from storyloom.operators import segmentation as s

WORDS = {"修炼": 40, "修": 9, "炼": 8, "灵气": 30, "灵": 5, "气": 6, "天地": 20, "天地灵气": 12, "天": 7, "地": 7, "他": 50, "他在": 3, "在": 20, "山": 10, "山洞": 15, "洞": 4, "中": 25, "洞中": 2}


def all_paths(run, words):
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        path, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                path.append(run[at:i])
                at = i
        path.append(run[at:])
        if all(w in words or len(w) == 1 for w in path):
            yield path


def cost(path, words):
    total, price = sum(words.values()), {}
    for w, n in words.items():
        price[w] = round(-s.SCALE * math.log(n / total))
    unknown = max(price.values()) + round(s.SCALE * math.log(10))
    return sum(price.get(w, unknown) for w in path)


@pytest.mark.parametrize("seed", range(5))
def test_best_path_of_all(seed):
    r = random.Random(seed)
    runs = ["".join(r.choice("修炼灵气天地他在山洞中龘") for _ in range(r.randint(1, 11))) for _ in range(60)] + ["天地灵气", "龘"]
    for run, found in zip(runs, s.cut(runs, s.Words.of(list(WORDS.items()))), strict=True):
        assert "".join(found) == run
        assert cost(found, WORDS) == min(cost(p, WORDS) for p in all_paths(run, WORDS)), run


def test_equal_paths_and_no_words():
    even = {"甲乙": 1, "丙": 1, "甲": 1, "乙丙": 1}
    assert s.cut(["甲乙丙"], s.Words.of(list(even.items()))) == [["甲", "乙丙"]]  # the longer last word
    assert s.cut(["甲乙", ""], s.Words.of([])) == [["甲", "乙"], []]
    with pytest.raises(ValueError):
        s.Words.of([("甲", 1), ("甲", 2)])


def test_a_long_run():
    run = "天地灵气" * 5000
    assert s.cut([run], s.Words.of(list(WORDS.items()))) == [["天地灵气"] * 5000]


@pytest.fixture(scope="module")
def tales(spark):
    r = random.Random(1)
    parts = ["修炼", "灵气", "山洞", "师父", "剑法", "飞行", "丹药", "宗门"]
    glue = list("的了在上下他她有来去")
    rows = [(i, "".join(r.choice(parts) + r.choice(glue) for _ in range(r.randint(5, 30))) + "。Level 99!") for i in range(300)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "玄冰寒铁剑出自北海，玄冰寒铁剑极冷。")], "doc_id long, text string").repartition(3)


def test_learned_words(tales):
    found = {r.word: r.n for r in s.learned(tales, least=20, cohesion=1.5, longest=3).collect()}
    assert {"修炼", "灵气", "山洞", "师父", "剑法", "飞行", "丹药", "宗门"} <= set(found)
    assert not any(len(w) > 1 and w[-1] in "的了上下他她有来去" for w in found)


def test_a_passage_is_found(spark, tales):
    vocabulary = s.learned(tales, least=20, cohesion=1.5).unionByName(spark.createDataFrame([("玄冰", 3), ("寒铁", 2), ("北海", 1)], "word string, n long"))
    docs = s.segmented(tales, vocabulary)
    assert docs.columns == ["doc_id", "text", "words"]
    words = {r.doc_id: r.words for r in docs.collect()}
    assert words[900] == [] and words[901] == [] and words[902] == ["玄冰", "寒铁", "玄冰", "寒铁", "北海"][:2] + ["北海", "玄冰", "寒铁"]
    assert words[0][-2:] == ["level", "99"]
    asked = s.segmented(spark.createDataFrame([(1, "北海的玄冰"), (2, "山洞")], "item_id long, text string"), vocabulary)
    found = retrieval.ranked(retrieval.bm25(docs, asked, text="words"), "item_id", "doc_id", 5).collect()
    assert [r.doc_id for r in found if r.item_id == 1] == [902]
    assert all("山洞" in words[r.doc_id] for r in found if r.item_id == 2) and sum(r.item_id == 2 for r in found) == 5


def test_words_to_leave_out(spark, tales):
    vocabulary = spark.createDataFrame(list(WORDS.items()), "word string, n long")
    docs = spark.createDataFrame([(1, "他在山洞中修炼"), (2, "no runs")], "doc_id long, text string")
    got = {r.doc_id: r.words for r in s.segmented(docs, vocabulary, stop=("修炼",)).collect()}
    assert got == {1: ["山洞"], 2: ["no", "runs"]}
    assert s.segmented(docs.where("false"), vocabulary).count() == 0
