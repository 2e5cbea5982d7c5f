"""Quality rules: the suffix array against plain counting, and odd tables."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import quality_rules as q


def plain(text, least):
    """All counts by looking at every window of every size."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)

    def places(k):
        found = collections.defaultdict(list)
        for i in range(n - k + 1):
            found[tuple(words[i : i + k])].append(i)
        return [p for p in found.values() if len(p) > 1]

    def covered(k):
        return len({i + j for p in places(k) for i in p for j in range(k)})

    longest = repeats = 0
    for k in range(least, n):
        for p in places(k):
            longest = k
            left = {words[i - 1] if i else (i,) for i in p}
            right = {words[i + k] if i + k < n else (i,) for i in p}
            repeats += len(left) > 1 and len(right) > 1
    return [n, sum(map(len, words)), sum(text.count(c) for c in q.SYMBOLS), dup, covered(3), covered(least), longest, repeats]


def counts(texts, least):
    part = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return [list(x) for x in zip(*[c.to_pylist() for c in q.counted(part, least).columns[1:]], strict=True)]


@pytest.mark.parametrize("seed", range(40))
def test_counts_against_all_windows(seed):
    r = random.Random(seed)
    least = r.choice([1, 2, 4, 8])
    texts = [None, ""]
    for _ in range(r.randint(1, 8)):
        k, n = r.choice([1, 2, 3, 10]), r.choice([0, 1, 5, 40, 90])
        texts.append("".join(r.choice([f"w{r.randrange(k)}", "é#", "|"]) + r.choice([" ", "\n", "\n\n", "\t "]) for _ in range(n)))
        if r.random() < 0.3:
            texts.append(texts[-1])
    assert counts(texts, least) == [plain(t, least) for t in texts]


def test_suffixes_are_sorted_and_their_prefixes_exact():
    r = np.random.default_rng(1)
    words = r.integers(0, 3, 300)
    texts = np.repeat([0, 1, 2], 100)
    rank = q.numbered(words.astype(np.uint64), words.astype(np.uint64), texts)
    found, _ = q.suffixes(rank, texts, 4)
    suffix = [tuple(rank[p : (p // 100 + 1) * 100].tolist()) for p in found.places.tolist()]
    assert suffix == sorted(suffix)
    for i in range(1, len(suffix)):
        common = 0
        while common < min(map(len, suffix[i - 1 : i + 1])) and suffix[i - 1][common] == suffix[i][common]:
            common += 1
        assert found.shared[i] == (common if common >= 4 else 0)


def test_one_word_many_times_is_quick():
    """Every place overlaps the next one: nested repeats as long as the text."""
    assert counts(["again " * 200_000], 8)[0][4:7] == [200_000, 200_000, 199_999]


def test_hashes_that_collide():
    first = np.array([5, 5, 5, 7], np.uint64)
    rank = q.numbered(first, np.array([1, 2, 1, 1], np.uint64), np.zeros(4, np.int64))
    assert rank[0] == rank[2] and len(set(rank.tolist())) == 3


def test_verdict_and_odd_rows(spark):
    own = " ".join(f"word{i}" for i in range(200))
    passage = " ".join(f"p{i}" for i in range(60))
    short = " ".join(f"q{i}" for i in range(10))
    docs = spark.createDataFrame([(1, own, 7), (2, f"{own} {passage} x {passage}", 7), (3, f"{own} {short} y {short}", 7), (4, "few words", 7), (5, None, 7), (6, "", 7), (None, own, 7), (1, own, 7), (7, "ha ha ha " * 60, 7), (8, " ".join([own] * 2), 7), (9, own * 2000, 7)], "doc_id long, text string, kept int").repartition(3)
    got = q.quality(docs).collect()
    assert len(got) == 11
    kept = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert kept == {1: (False, True), 2: (False, False), 3: (False, True), 4: (True, False), 5: (True, False), 6: (True, False), None: (False, True), 7: (True, False), 8: (True, False), 9: (True, False)}
    assert {r.doc_id: r.longest_repeat for r in got}[2] == 60
    assert q.quality(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        q.repetition(docs, 3)
