"""The book store, growing stores and nested shapes."""

import json
import os
import pathlib
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from storyloom.sources import library as lib


@pytest.fixture
def shelf(spark, tmp_path):
    path = str(tmp_path / "books")
    rows = [("末世", "甲/一", 1, "a"), ("末世", "乙", 2, "b"), ("玄幻", "丙", 3, None), (None, "丁", 4, "d"), ("a=b", None, 5, "e"), ("2024", "007", 6, "f")]
    lib.write_books(spark.createDataFrame(rows, "genre string, book string, doc_id long, text string"), path)
    return path


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("*.parquet")}


def test_a_scan_reads_its_folders_only(spark, shelf):
    books = lib.scan_books(spark, shelf, genres=["末世"])
    assert sorted((r.book, r.doc_id) for r in books.collect()) == [("乙", 2), ("甲/一", 1)]
    plan = books._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*genre#\d+ = 末世", plan)
    read = [r.f for r in books.select(F.input_file_name().alias("f")).collect()]
    assert read and all("/genre=末世/" in urllib.parse.unquote(f) for f in read)
    assert [r.doc_id for r in lib.scan_books(spark, shelf, books=["007"]).collect()] == [6]
    assert {(r.genre, r.book) for r in lib.scan_books(spark, shelf).collect()} >= {("unsorted", "丁"), ("a=b", "unsorted"), ("2024", "007")}


def test_the_listing_opens_no_file(spark, shelf):
    want = {("末世", "甲/一"), ("末世", "乙"), ("玄幻", "丙"), ("unsorted", "丁"), ("a=b", "unsorted"), ("2024", "007")}
    assert {(r.genre, r.book) for r in lib.listing(spark, shelf).collect()} == want


def test_a_book_written_again_leaves_the_others(spark, shelf):
    before = files(shelf)
    lib.write_books(spark.createDataFrame([("末世", "乙", 20, "new"), ("末世", "乙", 21, "new")], "genre string, book string, doc_id long, text string"), shelf)
    after = files(shelf)
    other = {f: t for f, t in before.items() if "book=乙" not in f and "book=%E4%B9%99" not in f}
    assert len(other) == 5 and all(after.get(f) == t for f, t in other.items())
    assert sorted(r.doc_id for r in lib.scan_books(spark, shelf, books=["乙"]).collect()) == [20, 21]


def test_a_large_book_is_dealt_over_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lib, "FILE_ROWS", 1000)
    path = str(tmp_path / "one")
    lib.write_books(spark.range(5000).selectExpr("'g' AS genre", "'b' AS book", "id AS doc_id"), path)
    assert len(files(path)) > 1 and lib.scan_books(spark, path).count() == 5000


def test_three_versions_read_as_one(spark, tmp_path):
    path, defaults = str(tmp_path / "states"), {"weight": "supporting", "cooldown": 0}
    lib.append_version(spark.createDataFrame([(1, "a")], "id long, name string"), path, 1)
    lib.append_version(spark.createDataFrame([(2, "b", "major"), (3, "c", None)], "id long, name string, weight string"), path, 2)
    lib.append_version(spark.createDataFrame([(4, "d", "cameo", 5)], "id long, name string, weight string, cooldown int"), path, 3)
    want = [(1, "a", "supporting", 0), (2, "b", "major", 0), (3, "c", "supporting", 0), (4, "d", "cameo", 5)]
    read = lambda: sorted(map(tuple, lib.read_versions(spark, path, defaults).select("id", "name", "weight", "cooldown").collect()))
    assert read() == want
    assert lib.migrate(spark, path, 3, defaults) and read() == want
    assert os.listdir(path) == ["v=3"]
    state = files(path)
    assert not lib.migrate(spark, path, 3, defaults) and files(path) == state


def test_a_migration_that_broke_off_goes_on(spark, tmp_path):
    """Rows were moved in, the old folder was not removed: they are not moved in twice."""
    path = str(tmp_path / "states")
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    lib.append_version(rows, path, 1)
    lib.migrate(spark, path, 2, {"w": "x"})
    lib.append_version(rows, path, 1)  # the folder that the broken run left
    assert lib.migrate(spark, path, 2, {"w": "x"})
    assert sorted(r.id for r in lib.read_versions(spark, path, {"w": "x"}).collect()) == [1, 2]


SHAPE = {"name": "string", "n": ("long", "double"), "who": [{"a": "long", "tags": ["string"]}], "o": {"p": {"q": "boolean"}}, "free": [], "deep": [[["long"]]]}
RECORDS = [
    {"name": "x", "n": 1, "who": [{"a": 1, "tags": ["u"]}], "o": {"p": {"q": True}}, "free": 3, "deep": [[[1, 2], []], []]},
    {"name": None, "n": "1", "who": [{"a": 1.5, "tags": [1, "u", None]}, {}, 7], "o": {"p": []}, "deep": [[[1, "x"], 5], {}]},
    {"n": 2.5, "who": {}, "o": {"p": {"q": 0}}, "free": None, "deep": []},
    {},
    [1],
    "text",
]


def plain(value, want, path):
    kinds = {str: "string", bool: "boolean", int: "long", float: "double", list: "list", dict: "object", type(None): "null"}
    got = kinds[type(value)]
    if isinstance(want, (str, tuple)):
        names = (want,) if isinstance(want, str) else want
        return [] if got in names else [(path, f"expected {' or '.join(names)}, got {got}")]
    if isinstance(want, list):
        if not want:
            return []
        if got != "list":
            return [(path, f"expected list, got {got}")]
        return [p for i, x in enumerate(value) for p in plain(x, want[0], f"{path}[{i}]")]
    if got != "object":
        return [(path, f"expected object, got {got}")]
    return [p for k, w in want.items() for p in (plain(value[k], w, f"{path}.{k}") if k in value else [(f"{path}.{k}", "missing")])]


def test_shapes_against_a_recursive_walk(spark):
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(RECORDS)] + [(90, "{broken"), (91, None)], "id long, json string")
    got = sorted((r.id, r.path, r.problem) for r in lib.shape_errors(rows, "id", "json", SHAPE, "canon").collect())
    want = [(i, *p) for i, r in enumerate(RECORDS) for p in plain(r, SHAPE, "canon")] + [(90, "canon", "no record"), (91, "canon", "no record")]
    assert got == sorted(want)
