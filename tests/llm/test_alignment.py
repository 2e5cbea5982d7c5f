"""Alignment against both libraries run on whole texts and a walk over the bytes; matrices against dense ones."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from storyloom.llm import alignment as al
from storyloom.llm.common import read

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", "a ", " a", "a  b\t\tc\n\n d", "<|endoftext|> and <s> </s> <unk>", "x▁y", "▁", "Déjà vu 😀 你好，世界。 한국어 　 \xa0 ﬁ", "\x00\x01", "ha" * 500, " " * 70 + "z", "word\n" * 40, "a\r\nb", "日本語" * 60, "é   x", "# | <0x0A> %%"]


def dense(m):
    out = np.zeros((len(m.bounds) - 1, m.n_columns), np.int64)
    np.add.at(out, (m.rows, m.columns), m.values)
    return out


@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_product_against_dense(most):
    r = np.random.default_rng(most)
    for _ in range(20):
        x, y, z = r.integers(1, 9, 3)
        made = []
        for n, k in ((x, y), (y, z)):
            sizes = r.integers(0, k + 1, n)
            m = al.incidence(sizes, np.concatenate([r.permutation(k)[:s] for s in sizes] + [np.zeros(0, int)]), k)
            m.values = r.integers(1, 5, len(m.columns))
            made.append(m)
        a, b = made
        assert (dense(al.product(a, b, most)) == dense(a) @ dense(b)).all()
        assert (dense(a.transposed()) == dense(a).T).all()
        assert al.product_sizes(a, b).tolist() == ((dense(a) > 0).astype(int) @ (dense(b) > 0).sum(1)).tolist()


def plain(rows):
    """By the libraries on whole texts, one byte end after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = al._byte_letters()

    def a_bytes(i):
        return bytes(letters[c] for c in first.id_to_token(i))

    def b_bytes(i):
        return bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()

    def ends(ids, size):
        at, out = 0, {}
        for k, i in enumerate(ids):
            at += len(size(i))
            out[at] = k
        return out

    found, counts = [], collections.Counter()
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        x, y = ends(a, a_bytes), ends(b, b_bytes)
        groups, links, i, j = [], [], 0, 0
        for at in sorted(set(x) & set(y)):
            links.append((a[x[at]], b[y[at]]))
            groups.append(",".join(map(str, a[i : x[at] + 1])) + "|" + ",".join(map(str, b[j : y[at] + 1])))
            i, j = x[at] + 1, y[at] + 1
        counts.update(links)
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = collections.Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return sorted((str(d), a, b, g, len(k), sum(counts[p] == most[p[1]] for p in k), sum(counts[p] for p in k), s) for d, a, b, g, k, s in found)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df):
    return sorted((str(r.doc_id), *r[1:]) for r in df.select(*COLUMNS).collect())


def test_odd_texts_against_the_libraries(spark, monkeypatch):
    r = random.Random(3)
    rows = list(enumerate(ODD)) + [(4, "a"), (4, "a"), (None, "no id"), (99, "long word and line\n" * 3000)]
    rows += [(200 + i, "".join(r.choice(["a", "b", " ", "  ", "\n", "é", "the ", "ing", "你", "▁", "9", "'s"]) for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_a int, block string").repartition(3)
    assert result(al.align(docs, A, B)) == plain(rows)
    assert al.align(docs.where("false"), A, B).count() == 0


def test_whole_table_against_the_libraries(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
    assert result(al.align(docs.repartition(4), A, B)) == plain(rows)


def test_small_blocks_give_the_same(spark):
    """Blocks of one slice each: counts are still of the whole table."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    found = al.blocks(docs.repartition(40), A, B)
    assert found.count() == 40
    assert result(al.align(docs.repartition(40), A, B)) == result(al.align(docs.coalesce(1), A, B))


def test_links_as_rows(spark):
    docs = spark.createDataFrame([(1, "unbelievable tokens"), (2, None)], "doc_id long, text string")
    links = al.token_links(docs, A, B).collect()
    assert {x.doc_id for x in links} == {1}
    row = al.align(docs, A, B).where("doc_id = 1").first()
    assert len(links) == row.n_overlaps and sum(x.together for x in links) == row.n_links
    assert sum(x.shared_bytes for x in links) == len(" unbelievable tokens")


def test_shared_groups_are_the_product_of_group_matrices():
    import pyarrow as pa

    found = al.aligned(pa.array(["some unusual words, 12345 and more", "xyzzy"]), A, B)
    shared = found.shared()
    want = {(i, j) for i, g in enumerate(found.a_groups.columns) for j, h in enumerate(found.b_groups.columns) if g == h}
    assert set(zip(shared.rows.tolist(), shared.columns.tolist(), strict=True)) == want
    assert len(want) == al.product_sizes(found.a_groups, found.b_groups.transposed()).sum()
