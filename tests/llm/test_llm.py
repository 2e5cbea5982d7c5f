"""The training-data operators on small tables: odd rows, ties, nulls, and brute-force versions."""

import collections
import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyloom.llm import bpe, common, exact_dedup, fingerprints, html_extract, language_id, licenses, line_dedup, minhash, packing, substring_dedup
from storyloom.llm.common import flat_bytes, mix64, read, window_hashes, word_hashes

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(1)
ODD = [
    (1, BASE),
    (2, BASE.replace(" ", "\n\t ", 3)),
    (3, None),
    (4, ""),
    (5, "\n\n"),
    (6, BASE.replace("w", "w", 1) + " one more"),
    (7, prose(2) + " " + " ".join(BASE.split()[10:40])),
    (8, prose(3) + "\n A line that many documents share \n" + prose(4)),
    (9, "a LINE that many documents share\nx"),
    (10, "A line that many documents share"),
    (11, "Déjà vu   <|endoftext|> 's 12345 😀"),
    (12, prose(5, 3000)),
    (12, prose(5, 3000)),
    (None, "lonely text without an id"),
    (14, "Released under the MIT licence.\nCopyright 2020 Foo"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if t else None, "s", 1, "extra") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.mark.parametrize("digest_hex", [32, 1])
def test_exact_dedup(odd, none, digest_hex):
    got = exact_dedup.exact_dedup(odd, digest_hex=digest_hex, memtable_rows=4).collect()
    groups = collections.defaultdict(list)

    def norm(t):
        return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")

    for i, t in ODD:
        groups[norm(t)].append(i)
    want = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)])) for i, t in ODD)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_line_dedup(odd, none):
    got = rows(line_dedup.apply_bitmaps(line_dedup.with_bitmaps(odd)).select("row.doc_id", "n_lines", "n_dropped", "text"))
    assert (got[8].n_dropped, got[9].n_dropped, got[10].n_dropped) == (1, 1, 0)
    assert got[9].text == "x" and got[3].n_lines == 1 and got[5].n_lines == 3 and got[12].n_dropped == 0
    once = rows(line_dedup.line_dedup(odd).select("row.doc_id", "n_lines", "n_dropped", "text", "keep_bitmap"))
    assert all((once[i].n_lines, once[i].n_dropped, once[i].text) == (r.n_lines, r.n_dropped, r.text) for i, r in got.items())
    assert [i for i, r in once.items() if r.keep_bitmap is not None] == [i for i, r in once.items() if r.n_dropped]
    assert line_dedup.with_bitmaps(none).count() == 0 and line_dedup.line_dedup(none).count() == 0


def test_common_line_over_many_tasks(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('The very same line everywhere', chr(10), 'own line number ', id) AS text").repartition(7)
    got = line_dedup.apply_bitmaps(line_dedup.with_bitmaps(docs)).select("row.doc_id", "n_dropped").collect()
    assert {r.doc_id for r in got if not r.n_dropped} == {1999}


def test_substring_dedup(odd, none):
    got = {r.row.doc_id: r for r in substring_dedup.substring_dedup(odd).collect()}
    seen = {}
    for i, t in sorted(set(ODD), key=lambda x: -1 if x[0] is None else x[0]):  # a null id comes first
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone.update(range(k, k + 20))
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone)), i
        assert got[i].kept_sha256 == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert substring_dedup.substring_dedup(odd).count() == len(ODD)
    assert substring_dedup.substring_dedup(none).count() == 0


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_in_polynomial_hashes(spark):
    """The Thue-Morse word and its complement have equal polynomials modulo 2**64 for every odd base."""
    x = thue_morse(1024)
    y = x.translate(str.maketrans("ab", "ba"))
    head = prose(77, 19)
    docs = spark.createDataFrame([(1, f"{head} {x}"), (2, f"{head} {y}"), (3, f"{head} {x}"), (4, "z" * 9000), (5, "z" * 9001)], "doc_id long, text string")
    assert {r.row.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 20, 4: 0, 5: 0}
    raw, off = flat_bytes(pa.array([x, y, x + y, "z" * 9000, "z" * 9001, "z" * 16, "z" * 17, "z"]))
    for which in (0, 1):
        assert len(set(word_hashes(raw, off[:-1], off[1:], which).tolist())) == 8


def test_common_gram_in_many_contexts(spark):
    """All texts share one run of ten words and nothing else: no window repeats."""
    gram = prose(78, 10)
    docs = spark.createDataFrame([(i, f"{prose(5000 + i, 40)} {gram} {prose(6000 + i, 40)}") for i in range(300)], "doc_id long, text string")
    assert substring_dedup.substring_dedup(docs).agg({"n_removed": "sum"}).first()[0] == 0


def test_window_hashes_against_the_words():
    r = np.random.default_rng(5)
    words = r.integers(0, 3, 4000).astype(np.uint64)
    for size in (1, 2, 5, 10, 20):
        seen = {}
        hashes = window_hashes(words, size)
        assert len(hashes) == len(words) - size + 1
        for k, h in enumerate(hashes.tolist()):
            assert seen.setdefault(tuple(words[k : k + size].tolist()), h) == h
        assert len(set(seen.values())) == len(seen)


def test_near_classes(odd, none, spark):
    got = minhash.near_classes(odd).collect()
    by = {r.doc_id: r.class_id for r in got}
    assert by[1] == by[2] == by[6] == 1 and by[3] == by[4] == by[5] == 3 and by[7] == 7 and len(got) == len(ODD)
    assert minhash.near_classes(none).count() == 0
    kept = minhash.near_dedup(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (2, 6, 4, 5)").count() == 0


@pytest.mark.parametrize("few", [500_000, 3])
def test_edited_copies_against_all_pairs(spark, monkeypatch, few):
    """A group of copies of one text, many of them just under the threshold from each other and from the original."""
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", few)  # tables of this many rows are small
    base = prose(900, 200).split()
    texts = []
    for i in range(60):
        words = list(base)
        for k in range(i % 10):
            words[(i * 17 + k * 20) % len(words)] = f"edit{i}x{k}"
        texts.append(" ".join(words[: len(words) - i % 4 * 8]))
    texts += [prose(1000 + i, 150) for i in range(10)]
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(texts)))
    for _ in texts:  # labels spread until none changes
        before = list(root)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(a & b) >= 0.8 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        if root == before:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    assert got == dict(enumerate(root)) and 12 < len(set(root)) < len(texts)


def test_copy_that_repeats_a_passage(spark):
    """Sets of shingles nearly equal, counts far apart: each text and its copy with one passage 50 times are one class."""
    texts = []
    for i in range(12):
        body, passage = prose(2000 + i, 300), prose(3000 + i, 20)
        texts += [f"{body} {passage}", " ".join([body, *[passage] * 50])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()} == {i: i // 2 * 2 for i in range(24)}


def test_prob_minhash_estimates_probability_jaccard():
    r = np.random.default_rng(1)
    common, a, b = (r.integers(1, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    doc = np.repeat([0, 1], 800)
    s = minhash.prob_minhash(doc, np.concatenate([common, a, common, b]), np.ones(1600), 2, 1024)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05


def test_prob_minhash_of_unequal_weights():
    """Probability Jaccard: sum over common elements of 1 / (sum over all of max(x_i / x_c, y_i / y_c))."""
    r = np.random.default_rng(2)
    element = r.integers(1, 2**63, 300).astype(np.uint64)
    x, y = r.integers(1, 30, 300) * (r.random(300) < 0.9), r.integers(1, 30, 300) * (r.random(300) < 0.9)
    both = np.flatnonzero((x > 0) & (y > 0))
    want = sum(1 / np.maximum(x / x[c], y / y[c]).sum() for c in both)
    doc = np.append(np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int))
    s = minhash.prob_minhash(doc, np.append(element[x > 0], element[y > 0]), np.append(x[x > 0], y[y > 0]), 2, 2048)
    assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_near_duplicates_leave_no_tables_but_the_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{tmp_path}/{uuid.uuid4().hex}")
    assert minhash.near_classes(read(spark, SF, "documents").select("doc_id", "text")).count() == 200
    assert len(list(tmp_path.iterdir())) == 1


def test_packing():
    r = random.Random(3)
    for _ in range(100):
        length, n = r.choice([8, 16]), r.randint(1, 50)
        places = sorted({0, n, *r.sample(range(n + 1), r.randint(0, n))} | set(range(0, n, length)))
        cost = [r.randint(0, 9) for _ in places]
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                d = places[j] - places[i]
                if d <= length:
                    best[j] = min(best[j], best[i] + (0 if d & (d - 1) == 0 else length - d) + cost[j] + packing.SEQUENCE)
        assert packing.choose_cuts(places, cost, length)[1] == best[-1]


def test_packed_tokens(odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.byte_bpe_path())
    got = packing.pack(odd.where("doc_id != 12"), packing.byte_bpe_path(), length=64).toPandas()
    for i, t in ODD:
        if i in (None, 12):
            continue
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert all(x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].tobytes()) for x in own.itertuples())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 64


def test_bpe_is_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_bpe_path())
    texts = [t or "" for _, t in ODD] + ["<|startoftext|>x<|endoftext|>'s", "ΣΑΣ ﬁ é 　z\x85", "aaaaaaaa​b", "x" * 5000]
    _, memory = bpe.loaded(bpe.word_bpe_path())
    ids, ends = memory.ids(pa.array(texts))
    for k, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[ends[k] : ends[k + 1]].tolist() == want
        assert bpe.loaded(bpe.word_bpe_path())[0].decode(want) == library.decode(want, skip_special_tokens=False)


def test_language(spark, odd):
    docs = read(spark, SF, "documents")
    model = language_id.train(docs)
    found = language_id.identify(docs, model).selectExpr("row.doc_id", "row.lang", "lang_pred")
    held = found.where(language_id.held_out(found.doc_id))
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    got = rows(language_id.identify(odd, model).selectExpr("row.doc_id", "lang_pred", "score"))
    assert got[3].lang_pred == got[5].lang_pred == "und" and got[3].score == 0 and 0 <= got[1].score <= 1
    empty = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(odd, empty).collect()} == {"und"}


def plain_ppm(text, training):
    """Bits of a text after the training texts, context by context in dictionaries."""
    follow = collections.defaultdict(collections.Counter)
    for t in training:
        raw = b" " * language_id.ORDER + t.encode()
        for i in range(language_id.ORDER, len(raw)):
            for k in range(language_id.ORDER + 1):
                follow[raw[i - k : i]][raw[i]] += 1
    bits, raw = 0.0, b" " * language_id.ORDER + text.encode()
    for i in range(language_id.ORDER, len(raw)):
        for k in range(language_id.ORDER, -1, -1):
            seen = follow[raw[i - k : i]]
            n, d = sum(seen.values()), len(seen)
            if raw[i] in seen:
                bits -= np.log2(seen[raw[i]] / (n + d))
                break
            bits -= np.log2(d / (n + d)) if n else 0
        else:
            bits += 8
    return bits


def test_code_lengths_against_plain_ppm(spark):
    rows = [(i, lang, t) for i, (lang, t) in enumerate([("a", prose(21, 30) + " déjà"), ("a", prose(22, 20)), ("b", "привет мир " * 4), ("b", "мир abc"), ("a", "x y"), ("b", "中文 文本")])]
    docs = spark.createDataFrame([(1000 + 7 * i, lang, t) for i, lang, t in rows for _ in range(2)], "doc_id long, lang string, text string").withColumn("doc_id", F.col("doc_id") * 0 + F.monotonically_increasing_id())
    used = docs.where(~language_id.held_out(docs.doc_id)).collect()
    model = language_id.train(docs, least=1)
    texts = ["w1 w2 w17", "мир 文", "", "zz\x00ÿ", prose(23, 200)]
    got = language_id.code_lengths(model, pa.array(texts))
    for j, lang in enumerate(model.langs):
        for i, t in enumerate(texts):
            assert abs(got[i, j] - plain_ppm(t, [r.text for r in used if r.lang == lang])) < 1e-3 * (1 + len(t)), (lang, t)
    old, language_id.PART = language_id.PART, 5
    assert np.allclose(language_id.code_lengths(model, pa.array(texts)), got, atol=1e-2)
    language_id.PART = old


def test_language_edges(spark, odd, none):
    docs = spark.createDataFrame([(i, None if i % 7 == 0 else "xx" if i % 2 else "yy", prose(i, 20) if i % 2 else prose(i, 20).replace("w", "v")) for i in range(60)], "doc_id long, lang string, text string")
    model = language_id.train(docs)
    assert model.langs == ["xx", "yy"] and language_id.identify(none, model).count() == 0
    twice = spark.createDataFrame([(1, "w1 w2 w3 w4"), (1, "w1 w2 w3 w4"), (None, "v1 v2 v3 v9"), (2, "w5 " * 400_000), (3, "12 34")], "doc_id long, text string")
    got = [(r.row.doc_id, r.lang_pred) for r in language_id.identify(twice, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "xx"), (1, "xx"), (None, "yy"), (2, "xx"), (3, "und")], key=str)
    rare = language_id.train(docs.union(spark.createDataFrame([(1001, "zz", "once")], docs.schema)))
    assert rare.langs == ["xx", "yy"]


def test_fingerprints(odd, none):
    got = [r for r in fingerprints.with_next(odd).collect()]
    assert len(got) == len(ODD)
    order = sorted(ODD, key=lambda x: -(x[0] if x[0] is not None else -(10**9)))
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(order):
        if i == 12 == order[(k + 1) % len(order)][0]:
            continue  # the first of two equal rows
        after, n = order[(k + 1) % len(order)][1] or "", len(t or "") // 3
        want = hashlib.sha256(((t or "")[: len(t or "") - n] + after[:n]).encode()).hexdigest()
        assert want in {r.edited_sha256 for r in got if r.doc_id == i}, i
    assert by[3].fingerprint == by[4].fingerprint and fingerprints.with_next(none).count() == 0


def test_fingerprint_likeness():
    def weights(t):
        return {w: n * len(w) for w, n in collections.Counter(t.split()).items()}

    a, b = prose(8, 400), " ".join(prose(8, 400).split()[:250] + prose(9, 150).split())
    x, y = weights(a), weights(b)
    want = sum(min(x.get(w, 0), y.get(w, 0)) for w in x | y) / sum(max(x.get(w, 0), y.get(w, 0)) for w in x | y)
    codes = fingerprints.fingerprints(pa.array([a, b]))
    assert abs(fingerprints.likeness(codes[:1], codes[1:])[0] - want) < 0.2


def plain_samples(text):
    """Consistent weighted sampling, one term and one sample after the other."""
    weights = collections.Counter()
    for w in text.encode().split():
        weights[w] += len(w)
    out = np.zeros(fingerprints.SAMPLES, np.uint16)
    best = [np.inf] * fingerprints.SAMPLES
    for w, weight in weights.items():
        raw = np.frombuffer(w, np.uint8)
        term = word_hashes(raw, np.array([0]), np.array([len(raw)]))
        (u, v), (x, y), (b, _) = (fingerprints.draws(term, k) for k in range(3))
        for k in range(fingerprints.SAMPLES):
            r, c = -np.log(u[0, k] * v[0, k]), -np.log(x[0, k] * y[0, k])
            t = np.floor(np.log(np.float32(weight)) / r + b[0, k])
            a = c * np.exp(-r * (t - b[0, k])) * np.exp(-r)
            if a < best[k]:
                best[k] = a
                out[k] = (mix64(term + np.uint64(int(t) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(48))[0]
    return out


def test_fingerprints_against_plain_sampling(spark):
    texts = {i: prose(700 + i, 30 + 40 * (i % 3)) if i % 4 else prose(700 + i - 1, 60) for i in range(40)} | {40: "", 41: None, 42: "x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    got = rows(fingerprints.with_next(docs))
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        own, near, edited = (plain_samples(t) for t in (text, after, changed))
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        differ = sum(r.fingerprint[4 * j : 4 * j + 4] != f"{own[j]:04x}" for j in range(fingerprints.SAMPLES))
        assert differ <= 1, (i, differ)  # 32-bit floats
        assert abs(r.near_next - (own == near).mean()) <= 2 / 64 and abs(r.near_edited - (own == edited).mean()) <= 2 / 64


def test_range_places():
    ids, tags = np.array([1, 5, 5, 9]), np.array([3, -2, 7, 0])
    keys = [(0, 0), (1, 3), (1, 4), (5, -3), (5, -2), (5, 0), (5, 8), (9, 0), (9, 1), (10, 0)]
    want = [sum(b >= k for b in zip(ids.tolist(), tags.tolist())) for k in keys]
    assert fingerprints.place_of(*(np.array(x) for x in zip(*keys)), ids, tags).tolist() == want
    assert fingerprints.place_of(np.array([1]), np.array([1]), ids[:0], tags[:0]).tolist() == [0]


def test_exact_dedup_of_a_large_group(spark, monkeypatch):
    """Half of the rows are copies, dealt over many tasks, with another text of the same short digest among them."""
    monkeypatch.setattr(exact_dedup, "ROWS_A_DEAL", 10)
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 2 = 0, 'the same', concat('own ', id)) AS text")
    for hex_digits in (32, 1):
        got = rows(exact_dedup.exact_dedup(docs, digest_hex=hex_digits))
        assert all((r.keep_id, r.group_size) == ((0, 200) if i % 2 == 0 else (i, 1)) for i, r in got.items())


def test_line_dedup_against_plain(spark):
    r = random.Random(9)
    lines = [f"  Line number {k} of the SHARED ones\t" for k in range(12)] + ["short", "", "exactly 20 chars ....", "19 chars ..........."]
    texts = [(i, "\n".join(r.choice([*lines, prose(r.randint(0, 10**6), 5)]) for _ in range(r.randint(0, 12))) or None) for i in range(150)]
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    got = rows(line_dedup.apply_bitmaps(line_dedup.with_bitmaps(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))).select("row.doc_id", "n_lines", "n_dropped", "text"))
    for i, t in texts:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(all_lines), len(all_lines) - len(stay), "\n".join(stay)), i


def test_shared_folder_is_asked_for(spark):
    from types import SimpleNamespace

    from storyloom.llm.common import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_licenses(odd, spark):
    got = rows(licenses.scan(odd))
    assert got[14].text_license == "MIT" and got[14].line_licenses == "MIT" and got[3].text_license is None
    text = "Copyright (c) 2021 Someone\n\n" + licenses.MIT.replace("copies of", "COPIES   of")
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text_license == "MIT"


def test_license_lines_in_all_spellings(spark, none):
    lines = ["Licenced under CC BY 4.0", "  * LICENSED  under CC BY 4.0!", "Released under the MIT Licence.", "Copyright 2020 Foo", "nothing here", "", "under CC BY 4.0"]
    docs = spark.createDataFrame([(i, f"first line {i}\n{x}\nlast line") for i, x in enumerate(lines)] + [(0, f"first line 0\n{lines[0]}\nlast line"), (99, "word " * 300_000 + "\n" + lines[0])], "doc_id long, text string")
    got = {r.doc_id: (r.line_licenses, r.n_license_lines) for r in licenses.scan(docs).collect()}
    assert got == {0: ("CC-BY-4.0", 1), 1: ("CC-BY-4.0", 1), 2: ("MIT", 1), 3: ("", 0), 4: ("", 0), 5: ("", 0), 6: ("", 0), 99: ("CC-BY-4.0", 1)}
    assert licenses.scan(none).count() == 0


def test_bpe_through_spark(odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.word_bpe_path())
    got = collections.Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.roundtrip(odd, bpe.word_bpe_path()).collect())
    want = collections.Counter()
    for _, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want and bpe.roundtrip(none, bpe.word_bpe_path()).count() == 0


def test_packing_edges(spark, none):
    assert packing.pack(none, packing.byte_bpe_path()).count() == 0
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 200_000, 5), (None, "no id", 5), (3, "again", 5)], "doc_id long, text string, length long")
    got = packing.pack(docs, packing.byte_bpe_path()).toPandas()
    assert sorted(got.groupby("doc_id", dropna=False).doc_tokens.first().tolist())[0] == 1 and (got.groupby("sequence_id").length.sum() <= 2048).all()
    assert got.length.sum() == sum(got.groupby(["doc_id", "doc_tokens"], dropna=False).length.sum())


def test_license_files_and_titles(spark):
    texts = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    cases = [(name, open(f"/usr/share/common-licenses/{file}").read()) for file, name in texts.items()]
    cases += [("MIT", f"The MIT License (MIT)\n\nCopyright (c) 2021 Someone\n\n{licenses.MIT}"), ("ISC", f"ISC License\n\n{licenses.ISC}"), ("BSD-3-Clause", "BSD 3-Clause License\n" + licenses.BSD_HEAD + licenses.BSD_THIRD + licenses.BSD_TAIL)]
    cases += [("BSD-2-Clause", (licenses.BSD_HEAD + licenses.BSD_TAIL).replace("\n1.", "\n*").replace("\n2.", "\n*"))]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    assert {i: r.text_license for i, r in rows(licenses.scan(docs)).items()} == {i: name for i, (name, _) in enumerate(cases)}
    own = spark.createDataFrame([("House", "All may read this.")], "license string, text string")
    got = licenses.scan(spark.createDataFrame([(1, "ALL may read this!"), (2, licenses.MIT)], "doc_id long, text string"), own)
    assert {i: r.text_license for i, r in rows(got).items()} == {1: "House", 2: None}


def test_html():
    page = html_extract.Page('<body><nav><a href="/x">x</a></nav><article><h1>T &amp; t</h1><p><b>One  two<br><p>three</article><script>var t="</p>";</script><footer>f</footer>')
    assert [t for _, t in page.blocks] == ["x", "T & t", "One two", "three", "f"]
    keep = page.kept(html_extract.Forest().margins(page.features()))
    assert all(not k or page.parent[v] < 0 or keep[page.parent[v]] for v, k in enumerate(keep))
    assert page.text(html_extract.Forest().margins(page.features())) == "T & t\nOne two\nthree"
    assert html_extract.Page("").text(html_extract.Forest().margins(html_extract.Page("").features())) == ""


def test_html_without_the_end_of_the_head():
    for page in ("<html><head><title>T</title><meta charset=utf-8><div><p>one two</p></div>", "<head><title>T</title><link href=x><b>one</b> two", "<head><title>T</title>one two", "<head><title>T</title></head><body>one two"):
        assert " ".join(t for _, t in html_extract.Page(page).blocks) == "one two", page


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<p title="x>Hello</p>', "Hello"),
        ("<p data-x=it's>Hello</p>", "Hello"),
        ("<p data-x='a>b' class=\"c>d\">Hello</p>", "Hello"),
        ("<template><p>no<template>no</template>no</p></template>yes", "yes"),
        ("<svg><title>t</title><svg></svg>no</svg>yes", "yes"),
        ("<canvas>no</canvas><object>no<object>no</object></object>yes", "yes"),
        ("<button>no</button>yes<select><option>no</select>", "yes"),
        ("<!--><p>yes</p><!-- no", "yes"),
        ("<html><head><title>t</title><p>Hello there</p>", "Hello there"),
        ("yes<script>if (a < b) { x = '<p>no</p>' }</script><style>no", "yes"),
        ("a &lt;b&gt; &amp;amp; &#233;<br>c <p/>d", "a <b> &amp; é c d"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p" + " a" * 20000, ""),
    ],
)
def test_html_tags(page, want):
    assert " ".join(t for _, t in html_extract.Page(page).blocks) == want


ARTICLE = "<body><nav class=menu><a href=x>menu one</a> <a href=y>two</a></nav><article><h1>Head {0}</h1><p>{1}, some words here. And more.</p><div class=comments><p>a reader says, so and so, that.</p></div></article><aside>ads, and ads</aside><footer>end</footer></body>"


def test_html_through_the_query(spark, tmp_path):
    pages = [(i, f"u{i}", ARTICLE.format(i, prose(i, 80)), "clash") for i in range(40)]
    pages += [(40, "u", None, "clash"), (41, "u", "", "clash"), (0, "u0", pages[0][2], "clash"), (42, "u", f"<body><div class=content><p>{prose(3, 120)}.</p></div><div id=footer><a href=x>imprint</a></div>", "clash"), (43, None, "<p>" + "word, " * 200_000 + "</p>", "clash"), (None, "u", "<p>x</p>", "clash")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(5)
    table.write.parquet(f"{tmp_path}/pages.parquet")
    got = html_extract.op6_html_extract(spark, str(tmp_path)).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and r.page_id < 40:
            assert r.text == f"Head {r.page_id}\n{prose(r.page_id, 80)}, some words here. And more."
        if r.page_id in (40, 41):
            assert r.text == ""
        if r.page_id == 42:
            assert r.text == prose(3, 120) + "."
    forests = [html_extract.train(table.repartition(n)) for n in (1, 7)]
    x = np.concatenate([html_extract.Page(p[2] or "").features() for p in pages])
    assert (forests[0].margins(x) == forests[1].margins(x)).all()
    bare = table.where("page_id >= 40")
    assert html_extract.train(bare).margins(x).shape == (len(x),)
    assert html_extract.extract(table.where("false"), html_extract.train(table.where("false"))).count() == 0


def test_training_pages_have_labels(spark):
    article = "<body><nav><a href=x>menu</a></nav><article><p>" + "some words here " * 20 + "</p></article><footer>end</footer></body>"
    pages = spark.createDataFrame([(i, article if i >= 200 else "<body><p>x</p></body>") for i in range(206)], "page_id long, html string")
    assert html_extract.train(pages, train_pages=3).trees


def near_by_brute_force(texts):
    """id -> smallest id of its class, by all pairs of shingle sets."""
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    root = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages on a small table, each worked out in plain Python from what the one before it kept."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    shared, passage = "this line is shared by many documents", prose(8001, 60)
    texts = {i: prose(8100 + i, 80) for i in range(30)}
    texts |= {i: f"{shared}\n{texts[i]}" for i in range(0, 12)}
    texts |= {40 + i: texts[i + 14].replace("w", "w", 1) + " tail" for i in range(5)}
    texts |= {50: f"{prose(8200, 40)} {passage} {prose(8201, 40)}", 51: f"{prose(8202, 40)} {passage} {prose(8203, 40)}", 60: None, 61: "", 62: "12345 678"}
    langs = {i: "xx" for i in texts}
    docs = spark.createDataFrame([(i, t, langs[i], "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    left = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    holders = [i for i, t in left.items() if shared in t.split("\n")]
    left = {i: "\n".join(x for x in t.split("\n") if x != shared or i == max(holders)) for i, t in left.items()}
    root = near_by_brute_force(left)
    left = {i: t for i, t in left.items() if root[i] == i}
    seen, cut = {}, {}
    for i in sorted(left):
        w = left[i].split()
        gone = set()
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone.update(range(k, k + 20))
        cut[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else left[i]
    library = Tokenizer.from_file(packing.byte_bpe_path())
    want = {i: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in cut.items()}
    assert set(got.doc_id) == set(want) and 51 in want and not {40, 41, 60, 61, 62} & set(want)
    whole = got[got.length == got.doc_tokens]
    assert len(whole) and all(want[r.doc_id] == r.ids_crc32 for r in whole.itertuples())
    assert got.groupby("doc_id").length.sum().to_dict() == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in cut.items()}


def test_pipeline_without_labels(spark, tmp_path, monkeypatch):
    """With no language learned only null and letterless texts go in the first stage; stages that were read are removed."""
    import corpus_pipeline

    texts = {i: prose(9100 + i, 40) for i in range(20)} | {30: None, 31: "", 32: "123 456"}
    docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == set(range(20))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shared = tmp_path / "shared"
    monkeypatch.setattr(common, "shared_dir", lambda _: f"{shared}/{uuid.uuid4().hex}")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(range(20))
    assert sum("n_chars" in spark.read.parquet(str(f)).columns for f in shared.iterdir()) == 1


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages(odd):
    import corpus_pipeline

    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(odd.sparkSession, docs, SF)
        assert out.columns == odd.columns, name
        docs = corpus_pipeline.materialize(out)
    assert {r.doc_id for r in docs.collect()} >= {1, 7, 8, 10, 14} and docs.where("doc_id in (2, 3, 4, 5, 6)").count() == 0
