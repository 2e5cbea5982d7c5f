"""Counts over a column of texts in Arrow batches inside tasks.

Spark's own functions take a pass over a text, and a copy of it, for each word; here a word costs one search. Patterns that Java and
RE2 may read differently are not `portable` and stay with the functions of `columns`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from storyloom.functions.columns import words_of

#: Bytes of rows that a worker counts at once.
SLICE_BYTES = 4 << 20
BLANKS = " \t\n\r\f\x0b"
BLOCK = re.compile(f"\n[{BLANKS}]*\n")

_ESCAPE = r"\\(?:[ntrf\\.|*+?()\[\]{}^$-]|x\{[0-9A-Fa-f]+\})"
_PIECE = rf"\[\^?(?:[^\[\]\\&]|{_ESCAPE})+\]|{_ESCAPE}|\\z|\(\?:|\((?!\?)|\)|\||(?:[*+?]|\{{[0-9]{{1,3}}(?:,[0-9]{{0,3}})?\}})\??(?![+*?{{])|[^\\^$.*+?{{}}()\[\]|]"
_PORTABLE = re.compile(rf"(?:{_PIECE})+")


def portable(pattern: str) -> bool:
    """Whether Java and RE2 find the same in any text: letters, classes and repeats, no dot, no anchor but the very end, no looking around, and no match without a letter."""
    if not _PORTABLE.fullmatch(pattern):
        return False
    return not re.match(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern).replace(r"\z", r"\Z"), "")


def word_counts(texts: pa.Array, strings: list[str], words: Iterable[str]) -> dict[str, np.ndarray]:
    """How often each word occurs in each text. The bytes of all texts are sieved once by a hash of three of them, and the places left compared with each word; words of under three bytes, and those that may overlap themselves, are searched for. strings: the same texts."""
    coded = {w: w.encode() for w in words}
    sieved = {w: c for w, c in coded.items() if len(c) > 2 and not any(w.endswith(w[:k]) for k in range(1, len(w)))}
    out = {w: np.fromiter((s.count(w) for s in strings), np.int64, len(strings)) for w in coded if w not in sieved}
    ends_ = np.cumsum(np.array([0, *pc.binary_length(texts).to_pylist()], np.int64))
    data = np.frombuffer(b"".join(pc.cast(texts, pa.binary()).to_pylist()), np.uint8)
    if len(data) < 3:
        return out | {w: np.zeros(len(strings), np.int64) for w in sieved}
    keys = data[:-2].astype(np.uint32)
    keys |= data[1:-1].astype(np.uint32) << np.uint32(8)
    keys |= data[2:].astype(np.uint32) << np.uint32(16)
    hashed = lambda k: (k * np.uint32(2654435761)) >> np.uint32(16)
    first = {w: np.uint32(c[0] | c[1] << 8 | c[2] << 16) for w, c in sieved.items()}
    wanted = np.zeros(1 << 16, bool)
    wanted[hashed(np.array(list(first.values()), np.uint32))] = True
    places = np.flatnonzero(wanted[hashed(keys)])
    keys = keys[places]
    for w, c in sieved.items():
        at = places[keys == first[w]]
        at = at[at <= len(data) - len(c)]
        for j in range(3, len(c)):
            at = at[data[at + j] == c[j]]
        text = np.searchsorted(ends_, at, side="right") - 1
        out[w] = np.bincount(text[at + len(c) <= ends_[text + 1]], minlength=len(strings))
    return out


def pattern_counts(texts: pa.Array, strings: list[str], patterns: dict[str, str]) -> dict[str, np.ndarray]:
    """How often each portable pattern occurs in each text, without overlaps. strings: the same texts."""
    words = {n: words_of(p) for n, p in patterns.items()}
    found = word_counts(texts, strings, dict.fromkeys(w for ws in words.values() for w in ws or ()))
    return {n: pc.count_substring_regex(texts, patterns[n]).to_numpy(zero_copy_only=False).astype(np.int64) if ws is None else sum(found[w] for w in ws) for n, ws in words.items()}


def sentence_sizes(strings: list[str], ends: str) -> tuple[list[int], list[int]]:
    """Trimmed sentences of each text, and the characters in them."""
    split = re.compile(f"[{ends}]").split
    sizes = [[len(p) for x in split(s) if (p := x.strip(BLANKS))] for s in strings]
    return [len(x) for x in sizes], [sum(x) for x in sizes]


def span(texts: pa.Array, pattern: str) -> np.ndarray:
    """Characters inside all matches of a portable pattern together."""
    return pc.subtract(pc.utf8_length(texts), pc.utf8_length(pc.replace_substring_regex(texts, pattern, ""))).to_numpy(zero_copy_only=False).astype(np.int64)


def n_parts(parts: list[str]) -> int:
    """Parts that hold more than white space."""
    return sum(1 for p in parts if p.strip(BLANKS))


def n_paragraphs(text: str, chars: int) -> int:
    """Paragraphs parted by blank lines; where there are fewer than one in 200 characters, parted by lines."""
    n = n_parts(BLOCK.split(text))
    return n if n >= max(1.0, chars / 200.0) else n_parts(text.split("\n"))


def short_last(tail: str) -> bool:
    """Whether the last paragraph of a text's end is short and the one before it long."""
    parts = [p for p in (x.strip(BLANKS) for x in BLOCK.split(tail)) if p]
    if len(parts) < max(1.0, len(tail) / 200.0):
        parts = [p for p in (x.strip(BLANKS) for x in tail.split("\n")) if p]
    return len(parts) > 1 and len(parts[-1]) < 30 and len(parts[-2]) > 80


def ends(texts: pa.Array, n: int) -> pa.Array:
    return pc.utf8_slice_codeunits(texts, start=-n)


def gram_counts(runs: pa.ListArray, sizes: Iterable[int], least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, letters, n, alphabet): how often each n-gram occurs inside the runs of each row, `least` times at least, by row and gram. letters: a column for each place, the place in the alphabet from 1, 0 after the gram's end. A gram is one number in base of the alphabet; numbers that would grow too large are ranked first, which keeps their order."""
    sizes, flat = sorted(k for k in sizes if k > 0), runs.flatten()
    points = np.frombuffer("".join(flat.to_pylist()).encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    alphabet, base = np.flatnonzero(seen), int(seen.sum()) + 1
    letters = np.cumsum(seen)[points]
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points))  # letters to the end of the run
    rows = np.repeat(np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy(zero_copy_only=False)), lengths)
    places = [np.flatnonzero(left >= k) for k in sizes]
    at, width = np.concatenate([np.zeros(0, np.int64), *places]), max(sizes, default=0)
    code, most, ranked = rows[at], len(runs), {}
    for j in range(width):
        if most * base >= 1 << 62:
            ranked[j], code = np.unique(code, return_inverse=True)
            most = len(ranked[j])
        code, most = code * base, most * base
        longer = slice(sum(len(x) for k, x in zip(sizes, places, strict=True) if k <= j), None)
        code[longer] += letters[at[longer] + j]
    code, n = np.unique(code, return_counts=True)
    code, n = code[n >= least], n[n >= least]
    digits = np.zeros((len(code), width), np.int64)
    for j in reversed(range(width)):
        code, digits[:, j] = np.divmod(code, base)
        code = ranked[j][code] if j in ranked else code
    return code, digits, n, alphabet


def frequent_grams(batch: pa.RecordBatch, sizes: tuple[int, ...], least: int = 1, skip: tuple[str, ...] = (), most: int | None = None) -> pa.RecordBatch:
    """(key, gram, n, place) from (key, runs): the `most` most frequent n-grams of each row, or all, by falling n and gram."""
    row, digits, n, alphabet = gram_counts(batch.column(1), sizes, least)
    keep = np.ones(len(row), bool)
    number = {chr(p): i + 1 for i, p in enumerate(alphabet.tolist())}
    for gram in skip:
        if len(gram) <= digits.shape[1]:
            keep &= (digits != [number.get(c, -1) for c in gram] + [0] * (digits.shape[1] - len(gram))).any(axis=1)
    row, digits, n = row[keep], digits[keep], n[keep]
    order = np.lexsort((-n, row))  # stable: equal counts stay in order of their grams
    row, digits, n = row[order], digits[order], n[order]
    place = np.arange(len(row)) - np.searchsorted(row, row) + 1
    keep = place <= (len(row) if most is None else most)
    row, digits, n, place = row[keep], digits[keep], n[keep], place[keep]
    letters = alphabet.astype(np.uint32)[digits[digits > 0] - 1].tobytes().decode("utf-32-le")
    ends_ = np.cumsum((digits > 0).sum(axis=1)).tolist()
    grams = [letters[a:b] for a, b in zip([0, *ends_], ends_, strict=False)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(grams, pa.string()), pa.array(n, pa.int64()), pa.array(place, pa.int64())], [batch.schema.names[0], "gram", "n", "place"])


def in_slices(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches that `make` yields from slices of some `size` bytes."""
    for batch in batches:
        step = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield make(batch.slice(at, step))
