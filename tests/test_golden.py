"""The first three chapters in the domain's script, against a plain version."""

import random
import re
from collections import Counter

import pytest

from storyloom.operators import golden as g
from storyloom.operators import records

M = g.ZH


def hits(p, t):
    return len(re.findall(p, t))


def clamp(x):
    return round(max(0, min(10, x)), 1)


def plain(chapters, canon):
    t = [*chapters, "", "", ""][:3]
    letters = [hits("[一-鿿]", x) for x in t]
    n, one = sum(letters), t[0]
    out = {"g1": 2.0}
    if letters[0] >= 50:
        s, head, opening = 5.0, one[:100], one[:500]
        s += [0, 1.5, 3, 3][sum(bool(re.search(p, head)) for p in (M.conflict, M.suspense, M.danger))]
        info = hits(M.info, opening) / max(hits("[一-鿿]", opening) / 100, 1)
        s += 2 if info >= 1.5 else 1 if info >= 1 else -1.5 if info < 0.3 else 0
        s += -2 if re.match(f"(?:{M.scenery})", one[:10]) else 0.5 if re.match(f"(?:{M.person})", one[:5]) else 0
        k = sum(hits(p, opening) for p in (M.conflict, M.suspense, M.danger, M.anomaly))
        out["g1"] = clamp(s + (1 if k >= 5 else -1 if k == 0 else 0))
    if n < 500:
        out |= dict.fromkeys(("g2", "g3", "g4", "g5"), 3.0)
    else:
        found = re.findall(M.speaker, one[:500])
        name = canon.get("protagonist") or (Counter(found).most_common(1)[0][0] if found else None)
        c = sum(x.count(name) for x in t) if name else 0
        s = 5 + (-1 if not name else 2 if c >= 10 else 1 if c >= 5 else -1.5 if c < 2 else 0)
        s += 1.5 * any(hits(M.goal, x) for x in t) + 1.5 * any(hits(M.flaw, x) for x in t) + 0.5 * any(w in x for w in canon.get("arc_words") or () for x in t)
        out["g2"] = clamp(s)
        want, block, fight = (sum(hits(p, x) for x in t) for p in (M.want, M.obstacle, M.confront))
        s = 5 + (3 if want and block and fight else 2 if want and block else 0.5 if want or block else -2)
        a, b = (sum(hits(p, t[i]) for p in (M.want, M.obstacle, M.confront)) for i in (0, 2))
        out["g3"] = clamp(s + (1 if b > a else -1 if b < a * 0.5 else 0) + 0.5 * any(w in x for w in canon.get("conflict_words") or () for x in t))
        planted = sum(hits(M.foreshadow, x) + hits(M.hint, x) for x in t)
        d = planted / max(n / 1000, 1)
        out["g4"] = clamp(5 + (3 if d >= 2 else 1.5 if d >= 1 else -2 if d < 0.3 else 0) + (planted >= 4) + ((canon.get("early_foreshadows") or 0) > 0) + 0.5 * ((canon.get("golden_hooks") or 0) >= 3))
        felt = [[hits(p, x) if k >= 50 else 0 for p in (M.high, M.mid, M.low, M.positive)] for x, k in zip(t, letters, strict=True)]
        e = [round(sum(f) / max(k / 1000, 1), 2) for f, k in zip(felt, letters, strict=True)]
        mean, gap = sum(e) / 3, max(e) - min(e)
        s = 5 + (2 if mean >= 5 else 1 if mean >= 3 else -2 if mean < 1 else 0) + (1.5 if round(gap, 9) >= 2 else -1 if gap < 0.5 and mean < 2 else 0)
        out["g5"] = clamp(s + 1.5 * any(f[0] >= 3 for f in felt) + (sum(any(f[i] for f in felt) for i in range(4)) >= 3))
    total = sum(out[k] * w for k, w in g.WEIGHTS.items())
    return out, sum(out[k] >= p for k, p in g.PASS.items()), total


def chapter(r, n):
    words = [w for p in (M.conflict, M.suspense, M.info, M.goal, M.flaw, M.obstacle, M.foreshadow, M.high, M.low, M.positive) for w in p.split("|") if re.fullmatch("[一-鿿]+", w)]
    rare = r.choice([0.02, 0.1, 0.3])
    return r.choice(["天色已晚，", "他", "林风说道", ""]) + "".join(r.choice(words) if r.random() < rare else r.choice(["林风说", "苏瑶走", "的", "了", "一日又一日，", "无事。"]) for _ in range(n))


@pytest.fixture(scope="module")
def books():
    r = random.Random(9)
    made = {f"书{i}": [chapter(r, r.choice([0, 15, 120, 400])) for _ in range(r.choice([1, 2, 3, 3, 4]))] for i in range(40)}
    return made | {"空": [None, "", ""]}


@pytest.mark.parametrize("with_canon", [False, True])
def test_scores_against_a_plain_version(spark, books, with_canon):
    rows = [(b, k + 1, t) for b, chapters in books.items() for k, t in enumerate(chapters)]
    facts = {b: {"protagonist": "苏瑶" if i % 2 else "", "arc_words": ["林风"] if i % 3 else None, "conflict_words": ["无此词"], "early_foreshadows": i % 2, "golden_hooks": 3} for i, b in enumerate(books)} if with_canon else {}
    canon = spark.createDataFrame([(b, *f.values()) for b, f in facts.items()], "book string, " + ", ".join(f"{k} {v}" for k, v in g.CANON.items())) if with_canon else None
    got = {x.book: x for x in g.golden_three(spark.createDataFrame(rows, "book string, ch_num int, text string").repartition(4), canon=canon).collect()}
    assert set(got) == set(books)
    for b, chapters in books.items():
        out, passed, total = plain([t or "" for t in chapters], facts.get(b, {}))
        assert ({k: got[b][k] for k in out}, got[b].passed) == (out, passed), b
        assert abs(got[b].total - total) <= 0.05 + 1e-9
    assert len({x.g2 for x in got.values()}) > 3 and len({x.grade for x in got.values()}) > 1


def test_gaps_to_a_benchmark(spark):
    scores = spark.createDataFrame([("a", 5.0, 6.0, 7.0, 8.0, 9.0, 6.7)], "book string, g1 double, g2 double, g3 double, g4 double, g5 double, total double")
    bench = spark.createDataFrame([(6.0, 6.0, None, 7.5, 9.5, 6.0)], "g1 double, g2 double, g3 double, g4 double, g5 double, total double")
    got = {r.dimension: (r.gap, r.reached) for r in g.golden_gaps(scores, bench).collect()}
    assert got == {"g1": (-1.0, False), "g2": (0.0, True), "g4": (0.5, True), "g5": (-0.5, False), "total": (0.7, True)}


def test_weight_grid():
    grid = records.weight_grid((0.4, 0.45, 0.5, 0.55, 0.6), (0.2, 0.25, 0.3, 0.35, 0.4))
    assert len(grid) == 23 and all(abs(sum(x) - 1) < 1e-9 and 0.05 <= x[2] <= 0.35 for x in grid)
