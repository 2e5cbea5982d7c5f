"""Licence scans: every full text of the catalogue in any wrapping, altered clauses, shared texts, and digests worked out by hand."""

import hashlib
import re
import textwrap

import pytest

from storyloom.llm import licenses

FULL = sorted({(name, text) for name, text in licenses.KNOWN if len(text) > 400})


def by_hand(text):
    """Both canonical forms without regular expressions shared with the operator."""

    def notice(line):
        line = line.lower().strip()
        while line and not (line[0].isalnum() or line[0] in "©&" or line.startswith("(c)")):
            line = line[1:]
        marks = 0
        while True:
            m = next((m for m in ("copyright", "(c)", "©", "&copy;") if line.startswith(m)), None)
            if not m:
                break
            marks, line = marks + 1, line[len(m) :].lstrip(" \t,:")
        head = line.lstrip("<[{(")[:5]
        dated = head[:4].isdigit() and head[:2] in ("19", "20") or re.match(r"(yyyy|years?|dates?)\b", line.lstrip("<[{("))
        return marks > 1 or marks == 1 and bool(dated) or re.findall(r"\w+", line) == ["all", "rights", "reserved"] and not marks

    def words(lines):
        out = " " + " ".join("".join(c if c.isalnum() else " " for c in "\n".join(lines).lower()).split()) + " "
        for a, b in licenses.EQUIVALENT:
            while f" {a} " in out:
                out = out.replace(f" {a} ", f" {b} ")
        return hashlib.sha256(out.strip().encode()).hexdigest()

    lines = text.split("\n")
    return {words([x for x in lines if not notice(x)]), words(lines)}


def scanned(spark, texts, catalogue=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan(docs, catalogue).collect()}


def rewrapped(text, width):
    return "\n\n".join(textwrap.fill(" ".join(p.split()), width) for p in re.split(r"\n\s*\n", text))


def test_full_texts_in_every_wrapping(spark):
    shapes = [lambda t: t, lambda t: " ".join(t.split()), lambda t: rewrapped(t, 60), lambda t: rewrapped(t, 72), lambda t: rewrapped(t, 100)]
    cases = [(name, shape(text)) for name, text in FULL for shape in shapes]
    got = scanned(spark, [t for _, t in cases])
    assert [got[i].text_license for i in range(len(cases))] == [name for name, _ in cases]


def test_a_changed_clause_is_another_text(spark):
    """One word more, in each sentence part that begins with copyright or (c), and in the middle."""
    cases = []
    for _, text in FULL:
        for m in [*re.finditer(r"(?i)(?:copyright|\(c\)) (?:you|license|notice|holder|under|law|treaty)\w*", text)][:6]:
            cases.append(text[: m.end()] + " never" + text[m.end() :])
        middle = text.index(" ", len(text) // 2)
        cases.append(text[:middle] + " never" + text[middle:])
    apache = next(t for n, t in FULL if n == "Apache-2.0" and "(c) You must retain" in t)
    cases.append(re.sub(r"\(c\) You must retain.*?;", "(c) You may drop anything you like;", apache, flags=re.S))
    assert len(cases) > 60
    assert {r.text_license for r in scanned(spark, cases).values()} == {None}


@pytest.mark.parametrize("notice", ["Copyright (c) 2021 Someone", "© 2019-2024 A, B and C. All rights reserved.", "(C) 1999 X", "  * Copyright 2020 by Foo", "Copyright [yyyy] [name of copyright owner]", "Copyright (c) The Authors", "All rights reserved."])
def test_notices_of_any_holder(spark, notice):
    assert scanned(spark, [f"{notice}\n\n{licenses.MIT}"])[0].text_license == "MIT"


@pytest.mark.parametrize("line", ["Copyright holders may not sell it.", "(c) You must pay.", "copyright license to nobody", "All rights reserved to me alone"])
def test_lines_that_are_no_notices(spark, line):
    assert scanned(spark, [f"{line}\n{licenses.MIT}"])[0].text_license is None


def test_texts_of_two_licences(spark):
    catalogue = spark.createDataFrame([("B", "Same words."), ("A", "same WORDS"), ("C", "Copyright 2020 C\nother words")], "license string, text string")
    got = scanned(spark, ["same words", "other words", "Copyright 1999 D\nOther words!", "copyright 2020 c other words", "x\nSAME, words\ny"], catalogue)
    assert [got[i].text_license for i in range(5)] == ["A,B", "C", "C", "C", None]
    assert got[4].line_licenses == "A,B"


def test_digests_by_hand(spark):
    """The catalogue's digests are those of forms made without the operator's patterns, and one is known."""
    found = {r.digest for r in licenses.known_digests(licenses.default_catalogue(spark)).collect()}
    want = {d for _, t in licenses.KNOWN for d in by_hand(t)}
    assert found == want
    notice = hashlib.sha256(b"licensed under cc by 4 0").hexdigest()
    assert notice in found
