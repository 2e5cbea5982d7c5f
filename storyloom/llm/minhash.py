"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

Texts that are equal up to white space form one class first; all further work is on classes. Each distinct 5-word shingle
of a class, whatever its count, runs a Poisson process of rate 1: arrivals fall on random components of the signature,
and a component belongs to the shingle that arrives there first. An element stops once its next arrival lies after the
latest first arrival of all components (early termination). With equal weights, components of two texts agree with the
Jaccard similarity of their sets of shingles, the measure by which links are verified.

Signatures are cut into 32 bands of 4 components; a pair at the threshold shares a band with a chance of 1 - 5e-8. Buckets
of equal bands are searched without listing all pairs. First each class meets the smallest member of its buckets, and
verified links are joined to components.

Then all members of buckets are bucketed anew by their rarest shingles (prefix filtering: texts over the threshold share
one of them for certain, while a passage that many unlike texts have in common is no rare shingle). The place of a shingle
in that order bounds the overlap of two texts whose first common shingle it is (positional filtering). Members of a bucket
that agree in component, place and size stand for each other: one row of them is shuffled. A task streams its buckets and
offers, for each member outside the bucket's largest component, the partners of other components that can still reach the
threshold, the likeliest first. A bucket stays open while it has partners that were not offered or rows that stand for
others; each further round splits the rows that stand for others in eight and offers eight times as many partners, so that
after as many rounds as the largest group has octal digits all have met. No pair is tested twice. Components grow in between, and most buckets close in
the first rounds, since members of one component need not meet. A pair is linked if its sets of shingles have a Jaccard
similarity of at least 0.8, from the whole texts.

Defined results: null and empty texts (and those of white space only) form one class; texts under five words have one
shingle, all their words; rows with equal doc_id are one document and share a class; a null doc_id is replaced by a
negative number drawn from the text; ties: the class id is the smallest doc_id. A very long text is handled whole, by one
task, in memory of some 40 bytes a word. An empty table gives no rows; columns besides doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm.common import WS_CHARS, WS_CLASS, arrow_pass, discard, flat_bytes, give_back, joined_hashes, materialize, mix64, read, slices, text_of, window_hashes, within, word_hashes, words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 32, 4
#: Cells in which shingles are counted to tell rare ones from common ones.
CELLS = 1 << 19
#: Bytes of text whose shingles are worked out at once, and the tasks over which the partners of one text are dealt.
PART, DEALT = 1 << 20, 64
#: Rows of numbers that are broadcast at most, and how fast the partners of a member grow from round to round.
BROADCAST_ROWS, GROWTH = 500_000, 8
#: Cells of a bucket's table of pairs that are held at once.
CELLS_AT_ONCE = 1_000_000


def node_id(doc_id: Column, norm: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.xxhash64(norm).bitwiseOR(F.lit(-(1 << 63))))


def normalized(docs: DataFrame) -> DataFrame:
    """id, norm (white space as single spaces, trimmed), digest."""
    rows = docs.select("doc_id", F.btrim(F.regexp_replace(text_of(docs), f"{WS_CLASS}+", " "), F.lit(WS_CHARS)).alias("norm"))
    return rows.select(node_id(F.col("doc_id"), F.col("norm")).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), "norm", F.unhex(F.md5("norm")).alias("digest"))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: number of the text, hash, how often."""
    raw, off = flat_bytes(column)
    starts, ends, first = words_of(raw, off)
    words = word_hashes(raw, starts, ends)
    n = np.diff(first)
    counts = np.maximum(n - WORDS + 1, 0)
    doc = np.repeat(np.arange(len(n)), counts)
    at = np.repeat(first[:-1], counts) + within(counts)
    hashes = window_hashes(words, WORDS)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    whole = mix64(n[short].astype(np.uint64))
    for k in range(WORDS - 1):
        more = n[short] > k
        whole[more] = joined_hashes(whole[more], words[first[short[more]] + k], 0x2545F4914F6CDD1D)
    doc, hashes = np.append(doc, short), np.append(hashes, whole)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    i = np.flatnonzero(new)
    return doc[i], hashes[i], np.diff(np.append(i, len(doc)))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int = BANDS * BAND_ROWS) -> np.ndarray:
    """Signatures (n_docs, size) of weighted sets; size: a power of two. All processes advance together, arrival by arrival."""
    signature = np.zeros(n_docs * size, np.uint64)
    first = np.full(n_docs * size, np.inf)
    latest = np.full(n_docs, np.inf)
    d, e, w, t = doc, element, weight.astype(np.float64), np.zeros(len(doc))
    k = 0
    while len(d):
        r = mix64(e + np.uint64((k * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF))
        t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / w
        going = t < latest[d]
        d, e, w, t, r = d[going], e[going], w[going], t[going], r[going]
        place = d * size + (r & np.uint64(size - 1)).astype(np.int64)
        sooner = np.flatnonzero(t < first[place])
        p, s = place[sooner], t[sooner]
        np.minimum.at(first, p, s)
        won = first[p] == s
        signature[p[won]] = e[sooner[won]]
        active = np.unique(d)
        latest[active] = first.reshape(n_docs, size)[active].max(axis=1)
        k += 1
    return signature.reshape(n_docs, size)


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, doc_id, digest, bands: 64-bit hashes of the bands, none for texts without words."""
    for batch in batches:
        for part in slices(batch, "norm", PART):
            doc, element, _ = shingles(part.column("norm"))
            signature = prob_minhash(doc, element, np.ones(len(doc)), part.num_rows).reshape(part.num_rows, BANDS, BAND_ROWS)
            keys = np.broadcast_to(mix64(np.arange(BANDS, dtype=np.uint64)), signature.shape[:2])
            for k in range(BAND_ROWS):
                keys = joined_hashes(keys, signature[:, :, k], 0x632BE59BD9B4E019)
            sizes = np.zeros(part.num_rows, np.int64)
            sizes[doc] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(keys[sizes > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("doc_id"), part.column("digest"), lists], names=["id", "doc_id", "digest", "bands"])


def compared(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (b, deal, a, norm), each text b (a null) before its partners a: the pairs (a, b) whose shingle sets have a Jaccard similarity of at least `similarity`."""
    held, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch, "norm", PART):
            doc, element, _ = shingles(part.column("norm"))
            sets = np.split(element, np.searchsorted(doc, np.arange(1, part.num_rows)))
            hit: list[tuple[int, int]] = []
            for b, deal, a, x in zip(*(part.column(c).to_pylist() for c in ("b", "deal", "a")), sets, strict=True):
                if a is None:
                    held, own = (b, deal), x.copy()
                elif held == (b, deal) and len(x) and min(len(x), len(own)) >= similarity * max(len(x), len(own)):
                    place = np.minimum(np.searchsorted(own, x), len(own) - 1)
                    common = int((own[place] == x).sum())
                    if common >= similarity * (len(x) + len(own) - common) - 1e-9:
                        hit.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hit], pa.int64()) for i in (0, 1)], names=["a", "b"])


def bounded(rows: DataFrame) -> DataFrame:
    """Materialized rows of a few numbers each, sent to every executor if they are no more than BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def linked(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), materialized, that are alike. A text b that many have as partner is sent to DEALT tasks at most, each with a share of its partners."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = bounded(pairs)
    deal = F.pmod(F.xxhash64("a"), F.lit(DEALT)).cast("int").alias("deal")
    mine = texts.join(few.select("a", "b", deal).withColumnRenamed("a", "id"), "id").select("b", "deal", F.col("id").alias("a"), "norm")
    once = few.select(F.col("b").alias("id"), deal).distinct()
    theirs = texts.join(F.broadcast(once) if few is not pairs else once, "id").select(F.col("id").alias("b"), "deal", F.lit(None).cast("long").alias("a"), "norm")
    rows = mine.union(theirs).repartition(parts, "b", "deal").sortWithinPartitions("b", "deal", F.asc_nulls_first("a"))
    return arrow_pass(rows, lambda it: compared(it, similarity), "a long, b long")


def cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of a task have a shingle in each cell."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for part in slices(batch, "norm", PART):
            _, element, _ = shingles(part.column("norm"))
            total += np.bincount((element & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
    cell = np.flatnonzero(total)
    for i in range(0, len(cell), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + 65536]), pa.array(total[cell[i : i + 65536]])], names=["cell", "n"])


def rarest(batches: Iterator[pa.RecordBatch], counts: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """(key, id, place, n): the rarest shingles of each text, so many that two similar texts have one of them in common, the place of each among the n of the text."""
    for batch in batches:
        for part in slices(batch, "norm", PART):
            doc, element, _ = shingles(part.column("norm"))
            order = np.lexsort((element, counts[(element & np.uint64(CELLS - 1)).astype(np.int64)], doc))
            n = np.bincount(doc, minlength=part.num_rows)
            place = within(n)
            early = place <= np.repeat(n - np.ceil(similarity * n - 1e-9), n)
            chosen = order[early]
            ids = part.column("id").to_numpy(zero_copy_only=False)
            columns = [element[chosen].view(np.int64), ids[doc[chosen]], place[early].astype(np.int32), n[doc[chosen]].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "place", "n"])


def prefixes(texts: DataFrame, similarity: float) -> DataFrame:
    """Buckets by rare shingles. Texts of a Jaccard similarity of at least s share one of the n - ceil(s n) + 1 first shingles in any order that all texts follow; here rare cells come first."""
    counts = np.zeros(CELLS, np.int64)
    found = arrow_pass(texts.select("norm"), cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()  # CELLS numbers, whatever the input
    del found
    give_back()
    shared = texts.sparkSession.sparkContext.broadcast(counts.astype(np.int32) if counts.max() < 1 << 31 else counts)
    return arrow_pass(texts.select("id", "norm"), lambda it: rarest(it, shared.value, similarity), "key long, id long, place int, n int")


def offers(component: np.ndarray, place: np.ndarray, n: np.ndarray, count: np.ndarray, partners: int, share: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the rows of one bucket: the pairs of different components that can reach the threshold, up to `partners` for each row outside the largest component; and whether more is left."""
    names, own, size = np.unique(component, return_inverse=True, return_counts=True)
    left = n - place
    rows = np.flatnonzero(own != size.argmax())
    first, second, more = [], [], False
    for at in range(0, len(rows), max(1, CELLS_AT_ONCE // len(n))):
        i = rows[at : at + max(1, CELLS_AT_ONCE // len(n)), None]
        both = n[i] + n[None, :]
        able = (own[i] != own[None, :]) & (np.minimum(left[i], left[None, :]) >= share * both - 1e-6)
        if not able.any():
            continue
        likely = np.where(able, (left[i] + left[None, :]) / both, -1.0)
        if partners < len(n):
            best = np.argpartition(-likely, partners - 1, axis=1)[:, :partners]
            more = more or bool((able.sum(axis=1) > partners).any())
        else:
            best = np.broadcast_to(np.arange(len(n)), likely.shape)
        ok = np.take_along_axis(able, best, axis=1)
        x, y = np.broadcast_to(i, best.shape)[ok], best[ok]
        first.append(x)
        second.append(y)
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    x, y = np.concatenate(first), np.concatenate(second)
    return x, y, more or bool((count[x] > 1).any() or (count[y] > 1).any())


def met(batches: Iterator[pa.RecordBatch], partners: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, component, place, n, id, count) in order of keys: pairs (key, a, b) to test; a and b are null in a row that says that the bucket stays open."""
    share = similarity / (1 + similarity)
    held: list[np.ndarray] = []

    def closed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """rows: columns one below the other, whole buckets."""
        key = rows[0]
        for _ in range(3):  # drop buckets of one component, and rows too short on remaining shingles for the bucket's smallest text
            begin = np.flatnonzero(np.append(True, rows[0][1:] != rows[0][:-1])) if rows.shape[1] else np.zeros(0, np.int64)
            if not len(begin):
                return
            length = np.diff(np.append(begin, rows.shape[1]))
            mixed = np.repeat(np.minimum.reduceat(rows[1], begin) != np.maximum.reduceat(rows[1], begin), length)
            least = np.repeat(np.minimum.reduceat(rows[3], begin), length)
            rows = rows[:, mixed & (rows[3] - rows[2] >= share * (rows[3] + least) - 1e-6)]
        key = rows[0]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        keys, first, second = [], [], []
        for r in np.split(rows, cut, axis=1) if rows.shape[1] else []:
            if r.shape[1] < 2:
                continue
            x, y, more = offers(r[1], r[2], r[3], r[5], partners, share)
            a, b = np.maximum(r[4][x], r[4][y]).tolist(), np.minimum(r[4][x], r[4][y]).tolist()
            if more:
                a.append(None)
                b.append(None)
            keys += [int(r[0][0])] * len(a)
            first += a
            second += b
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (keys, first, second)], names=["key", "a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
        if held[0][0][0] != held[-1][0][-1]:  # a bucket has ended
            rows = np.concatenate(held, axis=1)
            end = int(np.searchsorted(rows[0], rows[0][-1])) if (np.diff(rows[0]) >= 0).all() else int(np.flatnonzero(rows[0] != rows[0][-1])[-1]) + 1
            yield from closed(rows[:, :end])
            held = [rows[:, end:]]
    if held:
        yield from closed(np.concatenate(held, axis=1))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of edges (a, b) of one task."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    ids = list(above)
    for i in range(0, len(ids), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 65536], pa.int64()), pa.array([root(x) for x in ids[i : i + 65536]], pa.int64())], names=["id", "component"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ends of edges (a, b): the smallest id each can reach.

    Up to BROADCAST_ROWS edges are united in one task; more by alternating large-star and small-star steps, each written.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("u", "m"))

    edges = materialize(edges)
    if edges.count() <= BROADCAST_ROWS:
        out = materialize(arrow_pass(edges.coalesce(1), united, "id long, component long").where("id != component"))
        discard(edges)
        return out
    mark = None
    while True:
        before, edges = edges, materialize(small(large(edges.where("a != b").distinct())).where("a != b").distinct())
        discard(before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            out = materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("component")))
            discard(edges)
            return out
        mark = now


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those of a graph whose nodes are the components so far."""
    name = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    merged = components(between.where("a != b").distinct())
    moved = labels.join(merged.select(F.col("id").alias("component"), F.col("component").alias("now")), "component", "left").select("id", F.coalesce("now", "component").alias("component"))
    out = materialize(moved.union(merged))
    for done in (labels, merged):
        discard(done)
    return out


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id (doc_id, or its stand-in where null), doc_id, copy_of (smallest id of its equal texts), class_id."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = normalized(docs)
    signed = materialize(arrow_pass(rows.select("id", "doc_id", "digest", "norm"), banded, "id long, doc_id long, digest binary, bands array<long>"))
    classes = materialize(signed.groupBy("digest").agg(F.min("id").alias("id"), F.first("bands").alias("bands")))
    keyed = classes.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where("n > 1").select("key", "leader")
    met_first = materialize(keyed.join(shared, "key").groupBy("id").agg(F.min("leader").alias("leader")))  # a row for each member of a bucket
    wanted = materialize(met_first.select("id").join(classes.select("id", "digest"), "id"))
    texts = materialize(rows.select("id", "digest", "norm").join(bounded(wanted), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]))
    tested = materialize(met_first.where("leader != id").select(F.col("id").alias("a"), F.col("leader").alias("b")))
    labels = components(linked(tested, texts, similarity))
    marks = materialize(prefixes(texts, similarity))
    most = 1
    while True:
        named = marks.join(labels, "id", "left").select("key", F.coalesce("component", "id").alias("component"), "place", "n", "id")
        stand = named.groupBy("key", "component", "place", "n", F.pmod(F.xxhash64("id"), F.lit(most)).alias("piece")).agg(F.min("id").alias("id"), F.count("*").alias("count"))
        dealt = stand.select("key", "component", "place", "n", "id", "count").repartition(parts, "key").sortWithinPartitions("key")
        offered = materialize(arrow_pass(dealt, lambda it, most=most: met(it, most, similarity), "key long, a long, b long"))
        fresh = materialize(offered.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        more = materialize(linked(fresh, texts, similarity))
        if not more.isEmpty():
            labels = joined(labels, more)
        still = offered.where("a is null").select("key")
        if still.isEmpty():
            break
        rest, sofar = materialize(marks.join(still, "key", "left_semi")), materialize(tested.union(fresh))
        for done in (marks, offered, tested, fresh, more):
            discard(done)
        marks, tested, most = rest, sofar, most * GROWTH
    members = signed.select("id", "doc_id", "digest").join(classes.select("digest", F.col("id").alias("copy_of")), "digest")
    named = labels.select(F.col("id").alias("copy_of"), F.col("component").alias("class_id"))
    out = materialize(members.join(named, "copy_of", "left").select("id", "doc_id", "copy_of", F.coalesce("class_id", "copy_of").alias("class_id")))
    for done in (signed, classes, met_first, wanted, texts, marks, offered, tested, fresh, more, labels):
        discard(done)
    return out


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, one of each class: that with the smallest doc_id."""
    stays = near_classes(docs, similarity).where("id = class_id").select("id").distinct()
    norm = F.btrim(F.regexp_replace(text_of(docs), f"{WS_CLASS}+", " "), F.lit(WS_CHARS))
    tagged = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), node_id(docs["doc_id"], norm).alias("id"))
    return tagged.join(stays, "id", "left_semi").select("row.*")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "copy_of", "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
