"""Ranked search against plain scoring of every document, with ties, odd rows, small blocks and colliding hashes."""

import collections
import math
import random
import re

import numpy as np
import pytest

from storyloom.llm import ranked_search as s


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plain(docs, items, top):
    counted = [(i if i is not None else -(1 << 63), collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = set()
    for item, own in wanted.items():
        found = []
        for doc, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, doc))
        out |= {(item, k + 1, None if doc == -(1 << 63) else doc, -score) for k, (score, doc) in enumerate(sorted(found)[:top])}
    return out


def texts(seed, n):
    r = random.Random(seed)
    some = [" ".join(f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randint(1, 40))) for _ in range(n)]
    return some + [r.choice(some) for _ in range(n)]


ITEMS = [(7, "w1 W2, w2 w3-w4"), (8, "nowhere to be found"), (9, "w50 w51 w52 w5"), (9, "w10"), (10, None), (11, "--"), (12, "é w7 W30 w31"), (13, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize(("digest_hex", "block", "top"), [(32, 1 << 20, 50), (1, 1 << 20, 5), (32, 20, 7)])
def test_against_plain_scores(spark, digest_hex, block, top):
    rows = list(enumerate(texts(4, 90)))
    rows += [(500, None), (501, ""), (502, "?!"), (None, "w50 É"), (3, rows[3][1]), (3, rows[3][1]), (600, "É é W7 " + "w30 " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, bag string").repartition(5)
    items = spark.createDataFrame([(i, t, 2) for i, t in ITEMS], "item_id long, text string, term int")
    got = s.ranked_search(docs, items, top=top, block=block, digest_hex=digest_hex)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows, ITEMS, top)))
    assert s.ranked_search(docs.where("false"), items).count() == 0
    assert s.ranked_search(docs, items.where("false")).count() == 0


def test_one_class_larger_than_the_result(spark):
    docs = spark.range(5000).selectExpr("4999 - id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same words here' ELSE concat('other ', id) END AS text").repartition(9)
    items = spark.createDataFrame([("a", "same words")], "item_id string, text string")
    got = s.ranked_search(docs, items).orderBy("rank").collect()
    assert [r.doc_id for r in got] == sorted(4999 - i for i in range(0, 5000, 3))[:50]
    assert len({r.score for r in got}) == 1


def test_best_keeps_ties_by_document():
    score = np.array([5, 7, 5, 7, 5])
    keep = s.best(np.array([0, 0, 0, 1, 0]), score, np.array([9, 1, 3, 4, 5]), np.array([b"a"] * 5), 3)
    assert sorted(keep.tolist()) == [1, 2, 3, 4]
