"""Texts as runs of pieces that tokenizers treat alone: a text is cut before each run of white space.

Both vocabularies' pre-tokenizers never join a character with white space after it, and look only at what follows from
the cut on, so the ids of a text are those of its pieces in a row. A batch holds far fewer distinct pieces than pieces;
only the distinct ones are tokenized. Texts with white space outside ASCII stay one piece.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from storyloom.llm.common import flat_bytes, within, word_hashes

#: White space outside ASCII by the Unicode standard.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Distinct pieces that a worker remembers (some 45 bytes each), and the longest piece that it remembers.
REMEMBERED, LONGEST = 1 << 20, 64


def cut(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, the pieces' first byte, the byte after them, and of each text the number of its first piece (n+1 values)."""
    raw, off = flat_bytes(column)
    n = len(raw)
    if not n:
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begin = np.zeros(n, bool)
    begin[1:] = space[1:] & ~space[:-1]
    wide = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), WIDE_SPACE), False).to_numpy(zero_copy_only=False))
    for i in wide:
        begin[off[i] : off[i + 1]] = False
    begin[off[:-1][off[:-1] < off[1:]]] = True
    starts = np.flatnonzero(begin)
    return raw, starts, np.append(starts[1:], n), np.searchsorted(starts, off).astype(np.int64)


class Memory:
    """Ids of pieces seen before, in numpy arrays sorted by a hash; `encode` gives the ids of new pieces.

    Pieces are equal if two 64-bit hashes of at most 64 bytes are. A piece that shares only the first hash with another,
    or that is longer, is encoded each time. A full memory keeps what the last batch used.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], remembered: int = REMEMBERED, pieces: Callable = cut):
        self.encode, self.remembered, self.pieces = encode, remembered, pieces
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.flat, self.base, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (uint32), and the n+1 offsets of the texts in them."""
        raw, starts, ends, first = self.pieces(column)
        short = np.flatnonzero(ends - starts <= LONGEST)
        check = word_hashes(raw, starts, ends, 1)
        keys, sample, inverse = np.unique(word_hashes(raw, starts, ends)[short], return_index=True, return_inverse=True)
        sample = short[sample]
        alone = np.append(np.flatnonzero(ends - starts > LONGEST), short[check[short] != check[sample][inverse]])
        m, near = len(self.keys), np.searchsorted(self.keys, keys)
        taken = np.append(self.keys, np.uint64(0))[near] == keys
        taken[near == m] = False
        known = taken & (np.append(self.checks, np.uint64(0))[near] == check[sample])
        new = np.flatnonzero(~known)
        wanted = np.append(sample[new], alone)
        data = raw.tobytes()
        lists = self.encode([data[a:b].decode() for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist(), strict=True)])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.append(self.flat, np.fromiter(chain.from_iterable(lists), np.uint32))
        base, size = np.append(self.base, len(self.flat) + np.cumsum(sizes) - sizes), np.append(self.size, sizes)
        entry = near.copy()
        entry[new] = m + np.arange(len(new))
        at = np.zeros(len(starts), np.int64)
        at[short] = entry[inverse]
        at[alone] = m + len(new) + np.arange(len(alone))
        counts = size[at]
        stops = np.zeros(len(at) + 1, np.int64)
        np.cumsum(counts, out=stops[1:])
        ids = flat[np.repeat(base[at], counts) + within(counts)]
        fresh = np.flatnonzero(~taken)
        if m + len(fresh) > self.remembered:
            used = np.zeros(m, bool)
            used[near[known]] = True
            self._keep(np.flatnonzero(used))
        self._add(keys[fresh], check[sample[fresh]], flat, base[entry[fresh]], size[entry[fresh]])
        return ids, stops[first]

    def _keep(self, entries: np.ndarray) -> None:
        self.flat = self.flat[np.repeat(self.base[entries], self.size[entries]) + within(self.size[entries])]
        self.keys, self.checks, self.size = self.keys[entries], self.checks[entries], self.size[entries]
        self.base = np.cumsum(self.size) - self.size

    def _add(self, keys: np.ndarray, checks: np.ndarray, flat: np.ndarray, base: np.ndarray, size: np.ndarray) -> None:
        """Take in new entries, whose keys ascend."""
        more = flat[np.repeat(base, size) + within(size)]
        place = np.searchsorted(self.keys, keys)
        self.base = np.insert(self.base, place, len(self.flat) + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.checks = np.insert(self.checks, place, checks)
        self.keys = np.insert(self.keys, place, keys)
        self.flat = np.append(self.flat, more)
