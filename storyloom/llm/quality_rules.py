"""Quality rules: counts of a text's words, symbols and lines, and repetition by a suffix array over its words.

One narrow pass. The words of some megabytes of texts lie in one row; prefix doubling sorts the suffixes of each text,
and from each round on only suffixes that are still equal to another one. Ranks of a round are equal where the first 2**k
words are, so neighbours in the suffix array are compared by descending rounds: that gives the longest common prefixes.
Prefixes of at least `least` words form intervals (a run of suffixes, and the number of words that they all share); an
interval whose suffixes have different words before them, or begin a text, is a maximal repeated substring. The spans of
all its places are united. A text goes if the united spans cover more than a part of its words, or if one repeat is too long.

A suffix array is over words, not letters: in a script without white space a text is one word, which the base rule on the
number of words rejects anyway. Words are equal if two independent 64-bit hashes of their bytes are.

Defined results: a null or empty text has zero everywhere and fails the base rules; a very long text is treated whole, alone
in its slice, in some 50 bytes a word and 8 more for each doubling of its longest repeat; repeated rows and ids get a row
each with equal results; a null doc_id is passed on; places that overlap each other count as repeats; an empty table gives
no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, flat_bytes, read, slices, word_hashes, words_of

# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A repeat has so many words; repeats cover at most so many hundredths of a text's words; none has more words than the longest.
LEAST, COVERED, LONGEST = 8, 30, 50
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long, n_repeats long"


def numbered(first: np.ndarray, second: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Items as numbers: equal for equal pairs of hashes in one text, ascending in (text, first hash). A number is the place of the group's first item in sorted order."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((second, first))
    order = order[np.argsort(texts[order], kind="stable")]
    a, b, t = first[order], second[order], texts[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (t[1:] != t[:-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return rank


def repeated(rank: np.ndarray) -> np.ndarray:
    """Whether an item's number occurs twice or more."""
    return np.bincount(rank, minlength=len(rank))[rank] > 1 if len(rank) else np.zeros(0, bool)


@dataclass
class Suffixes:
    """The part of a suffix array in which neighbours share at least `least` words: suffixes in order, and the words shared with the one before (0: another group)."""

    places: np.ndarray
    shared: np.ndarray

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each interval: its first suffix, the one behind its last, and the words that all of it share.

        An interval ends on both sides where fewer words are shared than inside. Bounds are found by jumps over bounds of
        neighbours; of equal bounds one is kept.
        """
        n = len(self.places)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        shared = np.append(self.shared, 0)  # shared[i]: of i-1 and i; 0 at both ends
        left, right = np.arange(-1, n), np.arange(1, n + 2)
        inside = np.flatnonzero(shared)
        for bound in (left, right):
            wrong = inside
            while len(wrong):
                wrong = wrong[shared[bound[wrong]] >= shared[wrong]]
                bound[wrong] = bound[bound[wrong]]
        _, one = np.unique(left[inside] * (n + 2) + right[inside], return_index=True)
        one = inside[one]
        return left[one], right[one], shared[one]


def suffixes(rank: np.ndarray, texts: np.ndarray, least: int) -> tuple[Suffixes, np.ndarray]:
    """Sort the suffixes of texts by doubling. rank: of each word, as `numbered`; texts: of each word.

    Returns the suffixes that share `least` words (a power of two) with another one of their text, and each word's rank by
    itself and the word after it.
    """
    n, wanted = len(rank), least.bit_length() - 1
    rank, rounds, pairs = rank.copy(), [], rank
    active = np.flatnonzero(repeated(rank))
    while len(active):
        k = len(rounds)
        rounds.append((active.astype(np.int32), rank[active].astype(np.int32)))
        ahead = active + (1 << k)
        follows = _same_text(ahead, active, texts)
        second = np.where(follows, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(rank[active] * (n + 1) + second)
        active, second = active[order], second[order]
        old = rank[active]
        other = np.ones(len(active), bool)
        other[1:] = old[1:] != old[:-1]
        new = other.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(active))
        # a rank is the place of the group's first suffix among all
        rank[active] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(other, at, 0))
        if k == 0:
            pairs = rank.copy()
        active = np.sort(active[~(new & np.append(new[1:], True))])
    if len(rounds) <= wanted:
        return Suffixes(np.zeros(0, np.int64), np.zeros(0, np.int64)), pairs
    positions, groups = rounds[wanted]
    order = np.argsort(rank[positions])
    places, group = positions[order].astype(np.int64), groups[order]
    after = np.flatnonzero(group[1:] == group[:-1]) + 1
    a, b = places[after - 1], places[after]
    common = np.zeros(len(after), np.int64)
    seen = np.empty(n, np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        seen[:] = np.arange(-1, -n - 1, -1)  # what was alone by this round differs from all others
        seen[rounds[k][0]] = rounds[k][1]
        x, y = a + common, b + common
        equal = _same_text(x, a, texts) & _same_text(y, b, texts)
        equal &= seen[np.minimum(x, n - 1)] == seen[np.minimum(y, n - 1)]
        common += equal * (1 << k)
    shared = np.zeros(len(places), np.int64)
    shared[after] = common
    return Suffixes(places, shared), pairs


def _same_text(place: np.ndarray, other: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return (place < len(texts)) & (texts[np.minimum(place, len(texts) - 1)] == texts[other])


def united(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + sizes, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def totals(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of marks between neighbouring bounds."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return np.diff(sums[bounds])


def repeated_lines(raw: np.ndarray, off: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Of each text, the lines with a word that equal an earlier line. word: whether a byte belongs to a word."""
    n = len(raw)
    begin = np.zeros(n + 1, bool)
    begin[1:] = raw == 10
    begin[off] = True
    starts = np.flatnonzero(begin[:n])
    ends = np.append(starts[1:], n)[: len(starts)]
    ends = ends - (raw[ends - 1] == 10)  # a line has at most one line feed, at its end
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(word, out=sums[1:])
    real = sums[ends] > sums[starts]
    starts, ends = starts[real], ends[real]
    texts = np.searchsorted(off, starts, side="right") - 1
    number = numbered(word_hashes(raw, starts, ends), word_hashes(raw, starts, ends, 1), texts)
    count = np.bincount(texts, minlength=len(off) - 1)
    distinct = np.bincount(texts[np.unique(number, return_index=True)[1]], minlength=len(off) - 1)
    return count - distinct


def counted(part: pa.RecordBatch, least: int) -> pa.RecordBatch:
    """The counts of each text of a slice."""
    raw, off = flat_bytes(part.column("text"))
    starts, ends, first = words_of(raw, off)
    n, n_words = len(starts), np.diff(first)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    texts = np.repeat(np.arange(part.num_rows), n_words)
    rank = numbered(word_hashes(raw, starts, ends), word_hashes(raw, starts, ends, 1), texts)
    array, pairs = suffixes(rank, texts, least)
    threes = np.flatnonzero(repeated(pairs)[: max(0, n - 2)])
    threes = threes[texts[threes] == texts[threes + 2]]
    _, group, size = np.unique(pairs[threes] * (n + 1) + rank[threes + 2], return_inverse=True, return_counts=True)
    threes = threes[size[group] > 1]
    longest, repeats = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
    left, right, shared = array.intervals()
    before = np.where((array.places > 0) & _same_text(array.places - 1, array.places, texts), rank[array.places - 1], -1 - array.places) if n else array.places
    changes = np.zeros(len(before) + 1, np.int64)
    changes[2:] = np.cumsum(before[1:] != before[:-1])
    maximal = changes[right] > changes[left + 1]
    where = texts[array.places[left[maximal]]]
    np.maximum.at(longest, where, shared[maximal])
    repeats += np.bincount(where, minlength=part.num_rows)
    reach = np.maximum(array.shared, np.append(array.shared[1:], 0)) if len(array.places) else array.shared
    covered = united(array.places, reach, n)
    counts = [n_words, totals(word & ((raw & 0xC0) != 0x80), off), totals(symbol[raw], off), repeated_lines(raw, off, word), totals(united(threes, np.full(len(threes), 3), n), first), totals(covered, first), longest, repeats]
    return pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts]], names=[x.split()[0] for x in SCHEMA.split(", ")])


def repetition(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per text: words, their code points, symbols, repeated lines, words in repeated runs of three; then of repeats of at least
    `least` (a power of two) words: words that they cover, words of the longest, and the number of maximal ones."""
    if least & (least - 1) or least < 1:
        raise ValueError("least has to be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield counted(part, least)

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, least: int = LEAST, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """The counts with `base_failed` and `kept`: repeats cover at most `covered` hundredths of the words, and none has over `longest` words."""
    verdict = (100 * F.col("n_covered") <= covered * F.col("n_words")) & (F.col("longest_repeat") <= longest)
    return repetition(docs, least).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).withColumn("long_repeat", F.col("longest_repeat") > LONGEST).drop("longest_repeat", "n_repeats")


def _covered_sql(size: int) -> str:
    """Words in windows of so many words that occur twice or more in their text."""
    return f"""
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times
    FROM (SELECT doc_id, unnest(range(1, len(ws) - {size - 2})) AS i, unnest(list_transform(range(1, len(ws) - {size - 2}), lambda j: array_to_string(list_slice(ws, j, j + {size - 1}), ' '))) AS run FROM w)
  ), range(0, {size}) r(k) WHERE times > 1 GROUP BY doc_id"""


OP11_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), c3 AS ({_covered_sql(3)}), c AS ({_covered_sql(LEAST)}), x AS ({_covered_sql(LONGEST + 1)}), a AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[{SYMBOLS.replace("$", chr(92) + "$")}]', '', 'g')) AS BIGINT) AS n_symbols
  FROM w
), b AS (
  SELECT a.*, coalesce(l.n, 0) AS n_dup_lines, coalesce(c3.n, 0) AS n_repeat_words, coalesce(c.n, 0) AS n_covered,
         a.n_words < 50 OR 100 * coalesce(c3.n, 0) > 50 * a.n_words AS base_failed, x.n IS NOT NULL AS long_repeat
  FROM a LEFT JOIN l USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
)
SELECT *, NOT base_failed AND NOT long_repeat AND 100 * n_covered <= {COVERED} * n_words AS kept FROM b
"""
