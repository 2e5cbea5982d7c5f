"""Cross-tokenizer alignment by sparse incidence matrices.

Two tokenizers cut the same bytes. Each gives a matrix of tokens by bytes, with a one where a token holds a byte, in
compressed rows (CSR) made here: row bounds, columns, values. Gustavson's product A·Bᵀ goes over A's rows, gathers the rows of Bᵀ
that a row's columns name and adds up equal columns: its cells are the overlap links of token occurrences, with the
bytes that they share. Overlap links whose byte ranges end together are the links; their ends cut the tokens into groups.
Matrices of tokens by groups give, by the same product, the pairs of tokens that share a group.

Counts of id pairs are over the whole corpus. A task writes its documents in blocks of some megabytes of text, each with the distinct pairs
of its links and, for each document, which of them it has how often. Only the blocks' distinct pairs are shuffled to be
counted; counts come back to the block, whose documents add them up. Nothing is broadcast. A frequent pair has a row for each
block, not for each link, and the pairs of one B id are at most as many as A has ids.

Texts whose joined token bytes differ from a space and the text (a tokenizer that normalises them, as a literal U+2581) have no tokens.

Defined results: a null or empty text has no tokens and zero everywhere, its groups_sha256 is empty; strings of special
tokens inside a text are plain text; a repeated row or id gets a row each with equal results, and its links count each time;
pairs of equal counts are all best; a null doc_id is passed on; a very long text is aligned whole, in a block of its own; extra columns
play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.llm.common import arrow_pass, discard, flat_bytes, held, materialize, read, slices, within
from storyloom.llm.pieces import Memory

#: Bytes of text that are aligned at once, bytes of text in a block, products of a slice of rows.
SLICE, BLOCK, PRODUCTS = 1 << 20, 8 << 20, 1 << 22
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")
BLOCKS = f"block long, doc_id array<long>, {', '.join(f'{c} array<long>' for c in COUNTS)}, groups_sha256 array<string>, bounds array<int>, slots array<int>, times array<int>, pairs array<long>, uses array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long, n_shared long"


@dataclass
class CSR:
    """A sparse matrix: of each row the bounds of its entries; the entries' columns and values."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n_columns: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def transposed(self) -> CSR:
        """Entries by column, in a stable order."""
        bounds = np.zeros(self.n_columns + 1, np.int64)
        np.cumsum(np.bincount(self.columns, minlength=self.n_columns), out=bounds[1:])
        order = np.arange(len(self.columns)) if np.all(self.columns[1:] >= self.columns[:-1]) else np.argsort(self.columns, kind="stable")
        return CSR(bounds, self.rows[order], self.values[order], len(self.bounds) - 1)


def incidence(sizes: np.ndarray, columns: np.ndarray, n_columns: int) -> CSR:
    """A matrix of ones. sizes: of each row its entries."""
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return CSR(bounds, columns, np.ones(len(columns), np.int64), n_columns)


def product_sizes(a: CSR, b: CSR) -> np.ndarray:
    """Of each row of A the multiplications of Gustavson's product: its symbolic phase."""
    work = np.zeros(len(a.columns) + 1, np.int64)
    np.cumsum(np.diff(b.bounds)[a.columns], out=work[1:])
    return np.diff(work[a.bounds])


def product(a: CSR, b: CSR, most: int = PRODUCTS) -> CSR:
    """A·B by rows (Gustavson), some rows of at most `most` multiplications at once; a single row may have more."""
    work = np.cumsum(product_sizes(a, b))
    n_rows, at = len(a.bounds) - 1, 0
    sizes, columns, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while at < n_rows:
        stop = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + most, side="right")))
        part = slice(a.bounds[at], a.bounds[stop])
        inner = a.columns[part]
        n = b.bounds[inner + 1] - b.bounds[inner]
        entry = np.repeat(b.bounds[inner], n) + within(n)
        row = np.repeat(np.repeat(np.arange(stop - at), np.diff(a.bounds[at : stop + 1])), n)
        cell = row * b.n_columns + b.columns[entry]
        value = np.repeat(a.values[part], n) * b.values[entry]
        if np.any(cell[1:] < cell[:-1]):
            order = np.argsort(cell, kind="stable")
            cell, value = cell[order], value[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        cell = cell[first]
        sizes.append(np.bincount(cell // b.n_columns, minlength=stop - at))
        columns.append(cell % b.n_columns)
        values.append(np.add.reduceat(value, first) if len(first) else value)
        at = stop
    bounds = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.concatenate(sizes), out=bounds[1:])
    return CSR(bounds, np.concatenate(columns), np.concatenate(values), b.n_columns)


class Vocabulary:
    """The bytes of each id's token, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        n = self.sizes[ids]
        return self.flat[np.repeat(self.starts[ids], n) + within(n)]


def _byte_letters() -> dict[str, int]:
    """The byte of each letter that byte-level vocabularies use: printable ones stand for themselves, others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(path: str) -> tuple[Memory, Vocabulary]:
    """A byte-level vocabulary file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    letters = _byte_letters()
    tokens = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab().items():
        if all(c in letters for c in token):
            tokens[i] = bytes(letters[c] for c in token)
    return Memory(lambda pieces: [e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)]), Vocabulary(tokens)


def space_cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As pieces.cut, before runs of spaces alone: a vocabulary whose spaces only begin tokens never joins them to what is before."""
    raw, off = flat_bytes(column)
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    begin = np.zeros(n, bool)
    begin[1:] = (raw[1:] == 32) & (raw[:-1] != 32)
    begin[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(begin)
    return raw, starts, np.append(starts[1:], n), np.searchsorted(starts, off).astype(np.int64)


def pieces(path: str) -> tuple[Memory, Vocabulary]:
    """A sentencepiece model that puts a space before each text; pieces begin with the space that it puts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
    apart = all("▁" not in t.lstrip("▁") for t in names)
    space = [model.piece_to_id("▁")]

    def encode(found: list[str]) -> list[list[int]]:
        return [ids if p != " " else space for p, ids in zip(found, model.encode([p[1:] for p in found], num_threads=1), strict=True)]

    return Memory(encode, pieces=space_cut if apart else _whole), Vocabulary(tokens)


def _whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, off = flat_bytes(column)
    real = off[:-1] < off[1:]
    return raw, off[:-1][real], off[1:][real], np.append(0, np.cumsum(real)).astype(np.int64)


def loaded(a_path: str, b_path: str) -> tuple[Memory, Vocabulary, Memory, Vocabulary]:
    return *held(byte_level, a_path), *held(pieces, b_path)


@dataclass
class Aligned:
    """The alignment of a slice of texts. Tokens, bytes and groups are numbered through all texts of the slice."""

    a: np.ndarray
    b: np.ndarray
    a_first: np.ndarray  # of each text the number of its first token (n+1 values)
    b_first: np.ndarray
    overlap: CSR
    link_a: np.ndarray  # tokens whose byte ranges end together
    link_b: np.ndarray
    a_groups: CSR
    b_groups: CSR

    def shared(self) -> CSR:
        """The pairs of tokens in one group."""
        return product(self.a_groups, self.b_groups.transposed())


def aligned(texts: pa.Array, a_path: str, b_path: str) -> Aligned:
    a_memory, a_words, b_memory, b_words = loaded(a_path, b_path)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("", texts, " ")]))
    raw, off = flat_bytes(texts)
    a, a_first = a_memory.ids(texts)
    b, b_first = b_memory.ids(texts)
    right = np.ones(len(off) - 1, bool)
    for ids, first, words in ((a, a_first, a_words), (b, b_first, b_words)):
        sums = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(words.sizes[ids], out=sums[1:])
        right &= np.diff(sums[first]) == np.diff(off)
    for ids, first, words in ((a, a_first, a_words), (b, b_first, b_words)):  # of texts with as many bytes: the bytes
        same = words.joined(ids[np.repeat(right, np.diff(first))]) == raw[np.repeat(right, np.diff(off))]
        sizes = np.where(right, np.diff(off), 0)
        differ = np.append(0, np.cumsum(~same))
        ends = np.append(0, np.cumsum(sizes))
        right &= np.diff(differ[ends]) == 0
    a, b = a[np.repeat(right, np.diff(a_first))], b[np.repeat(right, np.diff(b_first))]
    a_first = np.append(0, np.cumsum(np.where(right, np.diff(a_first), 0)))
    b_first = np.append(0, np.cumsum(np.where(right, np.diff(b_first), 0)))
    n = int(np.where(right, np.diff(off), 0).sum())
    by_a, by_b = (incidence(words.sizes[ids], np.arange(n), n) for ids, words in ((a, a_words), (b, b_words)))
    overlap = product(by_a, by_b.transposed())
    row = overlap.rows
    together = np.flatnonzero(by_a.bounds[row + 1] == by_b.bounds[overlap.columns + 1])
    link_a, link_b = row[together], overlap.columns[together]
    cuts = by_a.bounds[link_a + 1]
    groups = [incidence(np.ones(len(m.bounds) - 1, np.int64), np.searchsorted(cuts, m.bounds[1:]), len(cuts)) for m in (by_a, by_b)]
    return Aligned(a, b, a_first, b_first, overlap, link_a, link_b, *groups)


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of 0 .. n-1 with a byte to spare, and how many they are."""
    digits = np.array([str(i).encode() + b"," for i in range(n)])
    return digits.view(np.uint8).reshape(n, -1), np.char.str_len(digits) - 1


def group_texts(found: Aligned) -> list[bytes]:
    """Of each text its groups as `a1,a2|b1;a3|b2,b3`."""
    n_a, n_b = len(found.a), len(found.b)
    a_group, b_group = found.a_groups.columns, found.b_groups.columns
    by_a, by_b = found.a_groups.transposed(), found.b_groups.transposed()
    # tokens in the order of the groups, A before B; the bounds of the transposed matrices count the tokens of the groups before
    at_a, at_b = np.arange(n_a) + by_b.bounds[a_group], np.arange(n_b) + by_a.bounds[b_group + 1]
    ids, mark = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    ids[at_a], ids[at_b] = found.a, found.b
    mark[at_a[by_a.bounds[1:] - 1]] = ord("|")
    mark[at_b[by_b.bounds[1:] - 1]] = ord(";")
    digits, size = held(_decimals, 1 << max(16, int(ids.max(initial=0)).bit_length()))
    out = digits[ids]
    n = size[ids]
    out[np.arange(len(ids)), n] = mark
    text = out[np.arange(out.shape[1]) <= n[:, None]].tobytes()
    ends = np.append(0, np.cumsum(n + 1))[found.a_first + found.b_first]
    return [text[x : y - 1] if y > x else b"" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _per_text(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(marks))[first])


class Block:
    """Documents of a task until they are written together."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.doc_ids: list = []
        self.counts: list[np.ndarray] = []
        self.digests: list[str] = []
        self.docs, self.pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, part: pa.RecordBatch, found: Aligned) -> None:
        per_a = np.bincount(found.link_a, minlength=len(found.a))
        links = _per_text(per_a, found.a_first)
        overlaps = _per_text(np.diff(found.overlap.bounds), found.a_first)
        shared = _per_text(product_sizes(found.a_groups, found.b_groups.transposed()), found.a_first)
        groups = _per_text(per_a > 0, found.a_first)  # each cut is the end of one token of A
        self.counts.append(np.stack([np.diff(found.a_first), np.diff(found.b_first), groups, links, overlaps, shared]))
        self.digests += [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(found)]
        text = np.searchsorted(found.a_first, found.link_a, side="right") - 1
        self.docs.append(text + len(self.doc_ids))
        self.pairs.append(found.a[found.link_a].astype(np.int64) << 32 | found.b[found.link_b].astype(np.int64))
        self.doc_ids += part.column("doc_id").to_pylist()
        self.size += part.nbytes

    def row(self) -> pa.RecordBatch:
        pairs, slot = np.unique(np.concatenate(self.pairs), return_inverse=True)
        uses = np.bincount(slot, minlength=len(pairs))
        both, times = np.unique(np.concatenate(self.docs) * max(1, len(pairs)) + slot, return_counts=True)
        doc, slot = both // max(1, len(pairs)), both % max(1, len(pairs))
        bounds = np.searchsorted(doc, np.arange(len(self.doc_ids) + 1))
        columns = [pa.array([self.number], pa.int64()), pa.array([self.doc_ids], pa.list_(pa.int64()))]
        columns += [pa.array([c], pa.list_(pa.int64())) for c in np.concatenate(self.counts, axis=1)]
        columns += [pa.array([self.digests], pa.list_(pa.string()))]
        columns += [pa.array([c.astype(np.int32)], pa.list_(pa.int32())) for c in (bounds, slot, times)]
        columns += [pa.array([c], pa.list_(pa.int64())) for c in (pairs, uses)]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in BLOCKS.split(", ")])


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Aligned documents in blocks: their counts, and which pairs of the block's list each has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = Block((context.partitionId() if context else 0) << 32)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                block.add(part, aligned(part.column("text"), a_path, b_path))
                if block.size >= BLOCK:
                    yield block.row()
                    block = Block(block.number + 1)
        if block.doc_ids:
            yield block.row()

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, BLOCKS)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, best): the links of each pair of ids in the corpus, and whether its B id has no pair with more. pair: A's id times 2**32 plus B's."""
    uses = found.select(F.explode(F.arrays_zip("pairs", "uses")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.uses").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    return uses.withColumn("best", F.col("count") == most)


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs, as rows of documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i].values  # noqa: B023, E731
            slots, times, bounds = get("slots").to_numpy(), get("times").to_numpy().astype(np.int64), get("bounds").to_numpy()
            count, best = np.zeros(len(get("pairs")), np.int64), np.zeros(len(get("pairs")), np.int64)
            if batch.column("facts")[i].is_valid:
                facts = get("facts")
                at = facts.field("slot").to_numpy()
                count[at], best[at] = facts.field("count").to_numpy(), facts.field("best").to_numpy(zero_copy_only=False)
            sums = [pa.array(_per_text(times * x[slots], bounds)) for x in (best, count)]
            columns = {"doc_id": get("doc_id"), "n_best": sums[0], "count_sum": sums[1], "groups_sha256": get("groups_sha256")} | {c: get(c) for c in COUNTS}
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: its tokens, groups and links, how its links' pairs count in the corpus, a digest of its groups; overlap links and pairs in one group."""
    found = materialize(blocks(docs, a_path, b_path), compression="zstd")
    listed = found.select("block", F.posexplode("pairs").alias("slot", "pair"))
    facts = listed.join(pair_counts(found), "pair").groupBy("block").agg(F.collect_list(F.struct("slot", "count", "best")).alias("facts"))
    out = materialize(arrow_pass(found.drop("uses").join(facts, "block", "left"), summed, RESULT))
    discard(found)
    return out


def token_links(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The overlap links themselves: doc_id, the tokens' numbers in the text and their ids, the bytes that they share, whether they end together. One narrow pass."""
    schema = "doc_id long, a_number long, b_number long, a_id long, b_id long, shared_bytes long, together boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                f = aligned(part.column("text"), a_path, b_path)
                row, column = f.overlap.rows, f.overlap.columns
                text = np.searchsorted(f.a_first, row, side="right") - 1
                together = np.isin(row * f.overlap.n_columns + column, f.link_a * f.overlap.n_columns + f.link_b)
                numbers = [row - f.a_first[text], column - f.b_first[text], f.a[row], f.b[column], f.overlap.values]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), *[pa.array(x, pa.int64()) for x in numbers], pa.array(together)], names=[x.split()[0] for x in schema.split(", ")])

    return arrow_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
