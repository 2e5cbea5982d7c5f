"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20
#: Bytes of rows that Spark hands to a Python worker at once, unless the session has its own figure.
BATCH_SETTING, BATCH_DEFAULT, BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the application ends.

    Where the setting is empty, a temporary folder takes its place on a single machine; elsewhere that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        top = _own_folder()
    path = f"{top.rstrip('/')}/storyloom-{uuid.uuid4().hex}"
    _hadoop(spark, path, lambda fs, at: fs.deleteOnExit(at))
    return path


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-storyloom-")


def _hadoop(spark: SparkSession, path: str, act: Callable) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark._jsc.hadoopConfiguration()), at)


def materialize(df: DataFrame, **options: str) -> DataFrame:
    """Write the rows as Parquet in the shared folder and read them back: lineage is cut, executors may be lost."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    _hadoop(df.sparkSession, df.written, lambda fs, at: fs.delete(at, True))


def arrow_pass(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(work, schema) in batches of a few megabytes; at the end of a task its worker, which Spark uses again, drops what the task did not use and returns its free memory.

    Spark's default batch has 10,000 rows of any size, which JVM and worker hold several times over. The limit is a setting of the session;
    one that is not at its default is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        conf.set(BATCH_SETTING, str(BATCH_LIMIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _used.clear()
        try:
            yield from work(batches)
        finally:
            for key in set(_held) - _used:
                del _held[key]
            give_back()

    return df.mapInArrow(run, schema)


#: What a worker holds from task to task, and what the running task used of it.
_held: dict[tuple, object] = {}
_used: set[tuple] = set()


def held(make: Callable, *args: object) -> object:
    """make(*args), as tokenizers that are slow to load: made once in a worker, and dropped at the end of the first task that does not ask for it."""
    key = (make, *args)
    _used.add(key)
    if key not in _held:
        _held[key] = make(*args)
    return _held[key]


def drop_held() -> None:
    """For functions of tasks that hold nothing: drop what other tasks left in this worker, and return the memory."""
    _held.clear()
    give_back()


def give_back() -> None:
    """Return memory that Arrow and the C library hold free to the operating system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about `most` bytes of `column`; one long text makes a part of its own."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values one after the other, and the n+1 offsets of the values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - (off[0] if len(off) else 0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd constants of the two hash functions, and the bytes of a word that are hashed lane by lane; a longer one goes to BLAKE2b.
SEEDS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
LONG_WORD = 4096
#: Of an eight-byte lane, the bits of its first 0 .. 8 bytes.
LANE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs without the contracts' white space, within one text.

    Returns the words' first byte, the byte after them, and of each text the number of its first word (n+1 values).
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first = np.zeros(n, bool)  # the first byte of a text
    first[offsets[:-1][offsets[:-1] < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(word & (~after | last)) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes. which: 0 or 1, two functions independent of each other.

    Lanes of eight bytes are scrambled into the state one after the other, so that no sum of terms can cancel out.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    seed = np.uint64(SEEDS[which])
    length = (ends - starts).astype(np.int64)
    state = mix64(length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + seed)
    padded = np.append(raw, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(raw), "<u8", padded, 0, (1,))
    left, at, rows = length, starts, None
    if length.max() > LONG_WORD:
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            state[i] = np.uint64(int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([which])).digest(), "little"))
        rows = np.flatnonzero(length <= LONG_WORD)
        left, at = left[rows], at[rows]
    while len(at):
        lane = lanes[at] & LANE[np.minimum(left, 8)]
        if rows is None:
            state = mix64((state ^ lane) * np.uint64(0xFF51AFD7ED558CCD) + seed)
            rows = np.flatnonzero(left > 8)
            left, at = left[rows] - 8, at[rows] + 8
        else:
            state[rows] = mix64((state[rows] ^ lane) * np.uint64(0xFF51AFD7ED558CCD) + seed)
            more = left > 8
            rows, left, at = rows[more], left[more] - 8, at[more] + 8
    return state


def joined_hashes(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each pair of hashes, in their order."""
    return mix64(mix64(a + np.uint64(salt)) * np.uint64(0xC4CEB9FE1A85EC53) ^ b)


def window_hashes(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `size` neighbours (the caller leaves out runs that cross texts): runs of 1, 2, 4 .. are joined to runs of `size`."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, have, power, span = None, 0, hashes, 1
    while True:
        if size & span:
            part = power[have : have + n]
            out = part if out is None else joined_hashes(out, part, SEEDS[which] >> 1)
            have += span
        if have == size:
            return out if size > 1 else out.copy()
        power, span = joined_hashes(power[:-span], power[span:], SEEDS[which] ^ span), span * 2


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[0]-1, 0, 1, .. counts[1]-1 and so on."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
