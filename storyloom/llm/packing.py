"""Packing token streams into training sequences by order-preserving dynamic programming.

Documents are taken in the order of their partition, each followed by an end token. Cuts are chosen at document ends
(free), sentence ends (small penalty) or, so that no stretch lacks one, at filler places (large penalty). The cheapest
set of cuts minimises padding plus penalties plus a constant for each sequence. A sequence of length n costs
`length - n` of padding, or none at a power of two. As the padding is linear in the place of the cut, the best
predecessor inside the window is the front of a monotone queue; transitions over powers of two are looked up beside it.

A task holds a block of about a million tokens: it solves the block, writes all sequences but the last few and carries
those over, so memory is bounded by the block and the longest document of a task, whose ids are held at once. Nothing is shuffled; sequences do not cross tasks, and
each task pads its last sequence alone.

Defined results: a null or empty text is its end token alone; ids and texts may repeat (rows are packed one by one); a
null doc_id is passed on; equally cheap sets of cuts are told apart the same way each time; columns besides doc_id and text play no part; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, held, read, slices
from storyloom.llm.pieces import Memory

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Costs in tokens of padding: a cut at a sentence end, a cut elsewhere inside a document, each sequence.
SENTENCE, INSIDE, SEQUENCE = 8, 96, 8
#: A task's tokens at once, and the sequences at the end of a block that are decided anew with the next one.
BLOCK, UNDECIDED = 1 << 20, 8


def choose_cuts(places: list[int], penalties: list[int], length: int = 2048) -> tuple[list[int], int]:
    """The cheapest cuts (numbers into `places`, first and last included) and their cost.

    places: ascending, from 0 to the end, with gaps of at most `length`; penalties: of a cut at each place.
    """
    n = len(places)
    at = np.asarray(places, np.int64)
    leaps: list[tuple[int, int]] = []
    for k in range(length.bit_length()):
        before = np.searchsorted(at, at - (1 << k))
        hit = np.flatnonzero((at >= 1 << k) & (at[np.minimum(before, n - 1)] == at - (1 << k)) & (1 << k < length))
        leaps += zip(hit.tolist(), before[hit].tolist(), strict=True)
    leaps.sort(reverse=True)
    best, prior = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, number), ascending in both
    for j in range(1, n):
        p = places[j]
        while places[queue[0][1]] < p - length:
            queue.popleft()
        value, i = queue[0]
        value += length - p
        while leaps and leaps[-1][0] == j:
            h = leaps.pop()[1]
            if best[h] < value:
                value, i = best[h], h
        value += penalties[j] + SEQUENCE
        best[j], prior[j] = value, i
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(prior[cuts[-1]])
    return cuts[::-1], best[-1]


class Tokens:
    """Ids of texts, and which ids end a sentence or begin with white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.memory = Memory(lambda pieces: [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)])
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        size = library.get_vocab_size()
        self.ends, self.spaced = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocab.items():
            self.ends[i] = token.rstrip("\"')Ċ")[-1:] in ".!?" and token.rstrip("\"')Ċ") != "" or "Ċ" in token
            self.spaced[i] = token[0] in "ĠĊĉč"


def loaded(path: str) -> Tokens:
    return held(Tokens, path)


class Block:
    """The tokens of a task that are not in a written sequence yet."""

    def __init__(self, task: int, tokens: Tokens, length: int):
        self.tokens, self.length = tokens, length
        self.ids = np.zeros(0, np.uint32)
        self.base = 0  # the place of ids[0] in the task's stream
        self.doc_ids: list[int | None] = []  # of documents with tokens in `ids`
        self.doc_starts: list[int] = []
        self.end = 0  # of the last document
        self.sequence = task << 40

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = np.append(self.ids, ids)
        self.doc_ids += doc_ids
        self.doc_starts += (self.end + np.cumsum(sizes) - sizes).tolist()
        self.end += int(sizes.sum())

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        penalty = np.full(n + 1, -1, np.int64)
        follows = self.tokens.spaced[self.ids[1:]] | self.tokens.spaced[self.ids[:-1]]
        penalty[1:n][self.tokens.ends[self.ids[:-1]] & follows] = SENTENCE
        starts = np.array([*self.doc_starts, self.end], np.int64) - self.base
        penalty[starts[starts >= 0]] = 0
        penalty[0] = penalty[n] = 0
        places = np.flatnonzero(penalty >= 0)
        step = self.length // 8
        extra = np.maximum((np.diff(places) - 1) // step, 0)
        fill = np.repeat(places[:-1], extra) + step * (1 + _within(extra))
        penalty[fill] = INSIDE
        places = np.flatnonzero(penalty >= 0)
        return places, penalty[places]

    def solve(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not len(self.ids):
            return
        places, penalties = self.candidates()
        numbers, _ = choose_cuts(places.tolist(), penalties.tolist(), self.length)
        cuts = places[numbers]
        if not last:
            cuts = cuts[: max(2, len(cuts) - UNDECIDED)]
        done = int(cuts[-1])
        starts = np.array(self.doc_starts, np.int64) - self.base
        sizes = np.diff(np.append(starts, self.end - self.base))
        bounds = np.union1d(cuts, starts[(starts >= 0) & (starts < done)])
        begin, stop = bounds[:-1], bounds[1:]
        doc = np.searchsorted(starts, begin, side="right") - 1
        row = np.searchsorted(cuts, begin, side="right") - 1
        data = memoryview(self.ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        columns = [pa.array([self.doc_ids[d] for d in doc.tolist()], pa.int64()), begin - starts[doc], stop - begin, crc, sizes[doc], self.sequence + row, begin - cuts[row], np.diff(cuts)[row]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])
        self.sequence += len(cuts) - 1
        first = max(0, int(np.searchsorted(starts, done, side="right")) - 1)
        self.ids, self.base = self.ids[done:], self.base + done
        self.doc_ids, self.doc_starts = self.doc_ids[first:], self.doc_starts[first:]


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def packed(batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    tokens = loaded(path)
    block = Block(context.partitionId() if context else 0, tokens, length)
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            ids, ends = tokens.memory.ids(part.column("text"))
            ids = np.insert(ids, ends[1:], end_id)
            block.add(part.column("doc_id").to_pylist(), ids, np.diff(ends) + 1)
            if len(block.ids) >= BLOCK:
                yield from block.solve(last=False)
    yield from block.solve(last=True)


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: whose tokens, from where, how many, in which sequence at which offset, and that sequence's length."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_pass(rows, lambda it: packed(it, path, length, end_id), SCHEMA)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), byte_bpe_path())
