"""Words of scripts that are written without spaces: a vocabulary learned from the texts, and the best path through each run.

Learning is counting: runs of one to `longest` letters, counted in Spark; a run becomes a word if it is frequent and its
letters stick together more than chance has it, at each place where it could be cut (pointwise mutual information). The vocabulary has a bounded
number of words, so it can be sent to every task.

Cutting is a dynamic programme over each run of letters: the path of words whose probabilities multiply to the most. A task
looks up all substrings of a batch at once (sorted hashes), then takes one step for each place in a run, for all runs together;
runs that occur several times are cut once. Equal paths: the longer last word. A letter that is no word costs as much as the
rarest word and a tenfold more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HAN = "[一-鿿]"
#: Words of a vocabulary at most; runs of letters that a batch cuts at once.
MOST_WORDS, RUNS = 500_000, 1 << 16
SCALE = 1_000_000


def letter_runs(texts: DataFrame, text: str, letter: str) -> DataFrame:
    """(run, n): the distinct runs of letters and how often each occurs."""
    return texts.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({letter}+)"), 1)).alias("run")).groupBy("run").agg(F.count("*").alias("n"))


def learned(texts: DataFrame, text: str = "text", letter: str = HAN, longest: int = 4, least: int = 5, cohesion: float = 2.0, most: int = MOST_WORDS) -> DataFrame:
    """(word, n): single letters, and runs of up to `longest` letters met `least` times whose parts meet `e ** cohesion` times as often as by chance, wherever they are parted; the `most` frequent ones."""
    runs = letter_runs(texts, text, letter)
    sizes = F.sequence(F.lit(1), F.lit(longest))
    grams = F.flatten(F.transform(sizes, lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.length("run")), lambda i: i <= F.length("run") - k + 1), lambda i: F.substring("run", i, k))))
    counts = runs.select(F.explode(grams).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).where((F.length("word") == 1) | (F.col("n") >= least))
    cuts = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    parts = cuts.select("word", "n", F.left("word", F.col("at")).alias("a"), F.substring(F.col("word"), F.col("at") + 1, F.length("word")).alias("b"))
    named = lambda c: counts.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    letters = counts.where(F.length("word") == 1).agg(F.sum("n").cast("double").alias("all"))
    odds = parts.join(named("a"), "a").join(named("b"), "b").join(F.broadcast(letters)).groupBy("word").agg(F.max("n").alias("n"), F.min(F.log(F.col("n") * F.col("all") / (F.col("n_a") * F.col("n_b").cast("double")))).alias("odds"))
    words = odds.where(F.round("odds", 9) >= cohesion).select("word", "n").unionByName(counts.where(F.length("word") == 1))
    return words.orderBy(F.desc("n"), "word").limit(most)


@dataclass
class Words:
    """Words as sorted numbers of up to `longest` letters, and what each costs."""

    hashes: np.ndarray
    costs: np.ndarray
    longest: int
    unknown: int

    @classmethod
    def of(cls, rows: list[tuple[str, float]]) -> Words:
        longest = max((len(w) for w, _ in rows), default=1)
        total = sum(n for _, n in rows) or 1
        hashes = np.array([_hash(np.array([ord(c) for c in w], np.uint64)) for w, _ in rows] or [], np.uint64)
        costs = np.array([round(-SCALE * float(np.log(n / total))) for _, n in rows] or [], np.int64)
        order = np.argsort(hashes)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("a word stands twice in the vocabulary")
        return cls(hashes[order], costs[order], longest, int(costs.max(initial=0)) + round(SCALE * float(np.log(10))))

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(found), bool), np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return self.hashes[at] == found, self.costs[at]


def _mixed(state: np.ndarray, letter: np.ndarray) -> np.ndarray:
    x = (state ^ (letter + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hash(letters: np.ndarray) -> np.uint64:
    state = np.zeros(1, np.uint64)
    for k in range(len(letters)):
        state = _mixed(state, letters[k : k + 1])
    return state[0]


def cut(runs: list[str], words: Words) -> list[list[str]]:
    """The words of each run."""
    if not runs:
        return []
    order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))  # at each place the runs that go on are the first ones
    size = np.array([len(runs[i]) for i in order])
    letters = np.frombuffer("".join(runs[i] for i in order).encode("utf-32-le"), np.uint32).astype(np.uint64)
    base = np.cumsum(size) - size
    n = len(letters)
    price = np.full((words.longest, n), -1, np.int64)  # of the word of k + 1 letters that begins at a place
    state, left = np.zeros(n, np.uint64), np.repeat(base + size, size) - np.arange(n)
    for k in range(words.longest):
        fits = np.flatnonzero(left > k)
        state[fits] = _mixed(state[fits], letters[fits + k])
        known, cost = words.find(state[fits])
        price[k, fits[known]] = cost[known]
    price[0, price[0] < 0] = words.unknown
    best = np.zeros(n + len(runs), np.int64)  # one place more for each run: its end
    last = np.zeros(n + len(runs), np.int64)
    home = base + np.arange(len(runs))
    going = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    for i in range(1, int(size.max(initial=0)) + 1):
        m = going[i - 1]
        value, chosen = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
        for k in range(1, min(i, words.longest) + 1):
            p = price[k - 1, base[:m] + i - k]
            total = np.where(p >= 0, best[home[:m] + i - k] + p, np.iinfo(np.int64).max)
            better = total <= value
            value[better], chosen[better] = total[better], k
        best[home[:m] + i], last[home[:m] + i] = value, chosen
    out: list[list[str]] = [[] for _ in runs]
    for j, i in enumerate(order):
        at, found = len(runs[i]), []
        while at:
            k = int(last[home[j] + at])
            found.append(runs[i][at - k : at])
            at -= k
        out[i] = found[::-1]
    return out


def segmented(texts: DataFrame, vocabulary: DataFrame, text: str = "text", letter: str = HAN, other: str = "[a-z0-9]+", least: int = 2, stop: tuple[str, ...] = (), name: str = "words") -> DataFrame:
    """The rows with their words in order of the text: best paths through runs of letters, and runs of `other` as they are; words of `least` letters that are not in `stop`. vocabulary: (word, n), at most MOST_WORDS rows."""
    rows = vocabulary.select("word", "n").limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"the vocabulary has more than {MOST_WORDS} words")
    shared = texts.sparkSession.sparkContext.broadcast(Words.of([(r.word, r.n) for r in rows]))
    pieces = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({letter}+|{other})"), 1)
    drop = sorted(set(stop))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("#pieces")
            flat = lists.flatten().dictionary_encode()
            distinct = flat.dictionary
            runs = pc.match_substring_regex(distinct, f"^{letter}+$").to_pylist()
            strings = distinct.to_pylist()
            todo = [i for i, r in enumerate(runs) if r]
            cuts: list[list[str]] = [[s] for s in strings]
            for at in range(0, len(todo), RUNS):
                for i, found in zip(todo[at : at + RUNS], cut([strings[i] for i in todo[at : at + RUNS]], shared.value), strict=True):
                    cuts[i] = found
            kept = [[w for w in c if len(w) >= least and w not in drop] for c in cuts]
            sizes = np.array([len(c) for c in kept], np.int64)
            words = pa.array([w for c in kept for w in c], pa.string())
            code = flat.indices.to_numpy()
            first = np.cumsum(sizes) - sizes
            per = sizes[code] if len(code) else np.zeros(0, np.int64)
            total = int(per.sum())
            take = np.repeat(first[code], per) + np.arange(total) - np.repeat(np.cumsum(per) - per, per) if total else np.zeros(0, np.int64)
            ends = np.append(0, np.cumsum(per))[np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))]
            out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), words.take(pa.array(take)))
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "#pieces"]
            yield pa.RecordBatch.from_arrays([*columns, out], names=[*[c for c in batch.schema.names if c != "#pieces"], name])

    whole = texts.withColumn("#pieces", pieces)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema) + f", `{name}` array<string>"
    return whole.mapInArrow(run, schema)

