"""BPE encoding and decoding with an index from each pair to all its positions.

The distinct words of a batch lie in one row of symbols. An index maps each adjacent pair that has a rank to all its
positions in that row; a heap yields active ranks in ascending order. Applying a rank merges its pair at every position,
left to right, and moves the neighbouring pairs to the lists of the pairs that arise. A merge can give a pair of a lower
rank, which the heap then yields next, so each word sees its merges in the same order as if it were encoded alone.

Normalising and splitting into words follow the vocabulary file (its normalizer and pre-tokenizer); merges, vocabulary
look-up, unknown symbols and decoding are done here. Defined results: a null or empty text has no ids and decodes to
the empty text; symbols outside the vocabulary have no id and vanish, as there is no unknown token; equal ranks cannot
occur, and a pair that overlaps itself is merged from the left; repeated rows and ids get a row each with equal results;
a very long text is encoded whole, in the memory of its task; columns besides doc_id and text play no part. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, held, read, slices
from storyloom.llm.pieces import Memory


class PairIndexBPE:
    """A BPE vocabulary file of the tokenizers library: merges with ranks, word-end suffix, special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in (self.vocab | self.special).items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Symbols are numbers: those of the vocabulary their ids, others get numbers behind.
        self.number = dict(self.vocab)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = (self.vocab[a], self.vocab[b])
            self.rank.setdefault(pair, (rank, self.vocab[a + b]))
        self.unknown = 1 << 30

    def symbols(self, word: str) -> list[int]:
        """The characters of a word as numbers, the last one with the suffix; -1 where the vocabulary has none."""
        last = len(word) - 1
        return [self.vocab.get(c + self.suffix if i == last else c, -1) for i, c in enumerate(word)]

    def merge(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        row: list[int] = []
        starts = []
        for w in words:
            starts.append(len(row))
            row += self.symbols(w)
            row.append(-2)  # a wall between words
        n = len(row)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.rank
        positions: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, pair in enumerate(zip(row, row[1:], strict=False)):
            if pair in rank:
                positions[pair].append(i)
        active = [(rank[p][0], p) for p in positions]
        heapq.heapify(active)
        while active:
            r, pair = heapq.heappop(active)
            places = positions.pop(pair, None)
            if places is None:
                continue
            new = rank[pair][1]
            a, b = pair
            places.sort()  # left to right; lists that later merges added to are not in order
            for i in places:
                j = after[i] if row[i] == a else n
                if j >= n or row[j] != b:
                    continue  # one of the two has been merged meanwhile
                row[i], row[j] = new, -3
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    q = (new, row[k])
                    if q in rank:
                        if q not in positions:
                            heapq.heappush(active, (rank[q][0], q))
                        positions[q].append(i)
                h = before[i]
                if h >= 0:
                    q = (row[h], new)
                    if q in rank:
                        if q not in positions:
                            heapq.heappush(active, (rank[q][0], q))
                        positions[q].append(h)
        ends = [*starts[1:], n][: len(starts)]
        return [[x for x in row[s:e] if x >= 0] for s, e in zip(starts, ends, strict=True)]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """The ids of each piece; distinct words are merged together."""
        split = self.split_all(pieces)
        distinct = list(dict.fromkeys(w for p in split for w in p if isinstance(w, str)))
        ids = dict(zip(distinct, self.merge(distinct), strict=True))
        return [ids[p[0]] if len(p) == 1 and isinstance(p[0], str) else [x for w in p for x in (ids[w] if isinstance(w, str) else [w])] for p in split]

    def split_all(self, pieces: list[str]) -> list[list[str | int]]:
        """The words of each piece. Plain pieces go through the normalizer and the pre-tokenizer as one text, joined by spaces."""
        plain = [i for i, p in enumerate(pieces) if p.isprintable() or len(p.split()) == 1 and p.strip().isprintable()]
        plain = [i for i in plain if " " not in pieces[i].strip() and "<|" not in pieces[i] and pieces[i].strip()]
        split: list[list[str | int]] = [[] for _ in pieces]
        text = " ".join(pieces[i].strip() for i in plain)
        text = self.normalizer.normalize_str(text) if self.normalizer and text else text
        ends = np.cumsum([len(x) + 1 for x in text.split(" ")]).tolist()
        if len(ends) != len(plain):  # the normalizer made or removed spaces
            plain = []
        else:
            k = 0
            for word, (begin, _) in self.pre.pre_tokenize_str(text) if text else []:
                while begin >= ends[k]:
                    k += 1
                split[plain[k]].append(word)
        done = set(plain)
        for i, p in enumerate(pieces):
            if i not in done:
                split[i] = list(self.words(p))
        return split

    def words(self, piece: str) -> Iterator[str | int]:
        """The words of a piece in byte-level letters, and the ids of special tokens."""
        rest = [piece]
        for token, number in self.special.items():
            if token in piece:
                rest = [y for x in rest for y in (self._around(x, token, number) if isinstance(x, str) else [x])]
        for x in rest:
            if isinstance(x, int):
                yield x
            elif x:
                text = self.normalizer.normalize_str(x) if self.normalizer else x
                yield from (w for w, _ in self.pre.pre_tokenize_str(text))

    @staticmethod
    def _around(text: str, token: str, number: int) -> list[str | int]:
        parts: list[str | int] = []
        for i, x in enumerate(text.split(token)):
            parts += [number, x] if i else [x]
        return parts

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the library joins tokens by one space."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids if i in tokens])


def _load(path: str) -> tuple[PairIndexBPE, Memory]:
    bpe = PairIndexBPE(path)
    return bpe, Memory(bpe.encode_pieces)


def loaded(path: str) -> tuple[PairIndexBPE, Memory]:
    return held(_load, path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe, memory = loaded(path)
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            ids, ends = memory.ids(part.column("text"))
            ids = ids.astype("<u4", copy=False)
            out: list[tuple] = []
            for i in range(part.num_rows):
                own = ids[ends[i] : ends[i + 1]]
                out.append((len(own), hashlib.sha256(own.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(own.tolist()).encode()).hexdigest()))
            n, a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """The ids of every text: doc_id, ids array<long>. One narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, memory = loaded(path)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, ends = memory.ids(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(ids.astype("int64")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), lists], names=["doc_id", "ids"])

    return arrow_pass(docs.select("doc_id", "text"), run, "doc_id long, ids array<long>")


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) back to (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = loaded(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_pass(encoded_docs.select("doc_id", "ids"), run, "doc_id long, text string")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def roundtrip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text: encoded and decoded again in one narrow pass."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_pass(rows, lambda it: encoded(it, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roundtrip(read(spark, sf_dir, "documents"), word_bpe_path())
