"""Stock phrases and human likeness in the domain's script, against loops."""

import random
import re

from storyloom.operators import human as h


def texts():
    r = random.Random(5)
    parts = [*h.TICS, *h.ZH.thoughts, *h.ZH.doubts, "我", "他", "她暗暗", "此刻他正", "。", "。我", "\n他", "　她", "一日无事", "风起云涌", "山高水长", "行行重行行"]
    out = {i: "".join(r.choice(parts if r.random() < 0.3 else parts[-4:]) for _ in range(r.choice([3, 30, 200]))) for i in range(60)}
    return out | {90: None, 91: "", 92: "我" * 49, 93: "我觉得。" * 30, 94: "他走。" * 60}


def tic(t):
    t = t or ""
    chars = len(t.replace("\n", "").replace(" ", ""))
    if chars < 100:
        return 0, 0, 0.0, 100
    counts = [sum(t.startswith(p, i) for i in range(len(t))) for p in h.TICS]
    d = sum(counts) / (chars / 1000)
    return sum(counts), sum(n > 0 for n in counts), d, next(s for most, s in ((0.3, 100), (0.5, 90), (1, 70), (2, 40), (1e9, 15)) if round(d, 2) <= most)


def human(t):
    t = t or ""
    chars = len(t.replace("\n", "").replace(" ", ""))
    if chars < 50:
        return "unknown", 0, 0.0, 0, 0, 50
    a, b = len(re.findall(r"(?:^|[。！？…；\n\s])我", t)), len(re.findall(r"(?:^|[。！？…；\n\s])(?:他|她)", t))
    pov, share = ("unknown", 0) if a + b == 0 else ("first", a) if a > 2 * b else ("third", b) if b > 2 * a else ("mixed", abs(a - b))
    sure = int(round(share / max(1, a + b) * 100, 9))
    d = round(sum(t.count(w) for w in h.ZH.thoughts) / (chars / 1000), 2)
    doubts, leaks = sum(t.count(w) for w in h.ZH.doubts), len(re.findall(h.ZH.leaks, t))
    s = 50 + {"first": 25, "third": 5}.get(pov, 0) + (5 if sure >= 80 else 3 if sure >= 60 else 0) + (25 if 1 <= d <= 3 else 15 if 0.5 <= d < 1 else 5 if d > 3 else 0)
    s += (15 if doubts >= 3 else 8 if doubts else 0) + (5 if not leaks else -3 * (leaks - 2) if leaks > 2 else 0)
    return pov, sure, d, doubts, leaks, max(0, min(100, s))


def test_against_loops(spark):
    docs = spark.createDataFrame(list(texts().items()), "doc_id long, text string").repartition(3)
    for r in h.tic_density(docs).collect():
        n, kinds, d, score = tic(texts()[r.doc_id])
        assert (r.n_tics, r.n_phrases, r.score) == (n, kinds, score) and abs(r.density - d) <= 0.00501, r.doc_id
    for r in h.human_likeness(docs).collect():
        want = human(texts()[r.doc_id])
        assert (r.perspective, r.consistency, r.n_doubts, r.n_leaks, r.score) == (*want[:2], *want[3:]) and abs(r.thought_density - want[2]) <= 0.00501, r.doc_id
