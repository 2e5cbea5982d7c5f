"""A library of books as a partitioned store, stores whose columns grow, and nested records checked against a shape.

Books lie below `genre=../book=..`, so that a scan of some genres or books reads their folders only, and writing a book
again replaces that book's folder and no other. A store that grows has a folder for each version of its columns; it is
read as one table, with defaults where an older row lacks a column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions.storage import shared_dir

#: Rows of a file, and the files that one book's rows are dealt over at most while they are written.
FILE_ROWS, FILES = 200_000, 16
UNSORTED = "unsorted"


def write_books(books: DataFrame, path: str, genre: str = "genre", book: str = "book", order: str = "doc_id") -> None:
    """Replace the folders of the genres and books among the rows; others stay as they are. A large book is dealt over several files."""
    rows = books.withColumns({genre: F.coalesce(F.col(genre).cast("string"), F.lit(UNSORTED)), book: F.coalesce(F.col(book).cast("string"), F.lit(UNSORTED))})
    dealt = rows.repartition(F.col(genre), F.col(book), F.pmod(F.xxhash64(order), F.lit(FILES)))
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_ROWS)
    writer.partitionBy(genre, book).parquet(path)


def scan_books(spark: SparkSession, path: str, genres: Sequence[str] | None = None, books: Sequence[str] | None = None, genre: str = "genre", book: str = "book") -> DataFrame:
    """The books of some genres, or of names among `books`; only their folders are read. Names of folders stay strings."""
    kinds = spark.read.option("basePath", path).parquet(path).schema
    rows = spark.read.schema(",".join(f"`{f.name}` {'string' if f.name in (genre, book) else f.dataType.simpleString()}" for f in kinds)).parquet(path)
    if genres is not None:
        rows = rows.where(F.col(genre).isin(list(genres)))
    return rows if books is None else rows.where(F.col(book).isin(list(books)))


def listing(spark: SparkSession, path: str, genre: str = "genre", book: str = "book") -> DataFrame:
    """(genre, book) of the store, from its folders alone: no file is opened."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    at = lambda c: F.url_decode(F.regexp_extract("path", rf"/{c}=([^/]+)/", 1))
    return names.select(at(genre).alias(genre), at(book).alias(book)).distinct()


def append_version(rows: DataFrame, path: str, version: int) -> None:
    """Rows written under version number `version` of a store's columns."""
    rows.write.mode("append").parquet(f"{path}/v={version}")


def read_versions(spark: SparkSession, path: str, defaults: Mapping[str, object]) -> DataFrame:
    """All versions as one table: columns that were added later have their default in older rows, also where the row has null in them."""
    rows = spark.read.option("mergeSchema", True).option("basePath", path).parquet(path)
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in rows.columns}
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in rows.columns}
    return rows.withColumns(missing | filled) if defaults else rows


def migrate(spark: SparkSession, path: str, version: int, defaults: Mapping[str, object]) -> bool:
    """Write rows of older versions again under `version`, defaults filled in; their folders go. Whether there was anything to do: a second call does nothing.

    The rows are written aside first and moved in under a name made of the versions that they replace, so that a run broken
    between the move and the removal leaves rows that the next call recognises: it removes the old folders only.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    top = jvm.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(int(f.getPath().getName()[2:]) for f in fs.listStatus(top) if f.getPath().getName().startswith("v="))
    old = [v for v in found if v < version]
    if not old:
        return False
    moved = jvm.Path(f"{path}/v={version}/from-{'-'.join(map(str, old))}")
    if not fs.exists(moved):
        aside = f"{shared_dir(spark)}/aside"
        rows = read_versions(spark, path, defaults).where(F.col("v").isin(old)).drop("v")
        rows.write.parquet(aside)
        fs.mkdirs(moved.getParent())
        fs.rename(jvm.Path(aside), moved)
    for v in old:
        fs.delete(jvm.Path(f"{path}/v={v}"), True)
    return True


# Shapes: a kind (string, long, double, boolean, list, object, null); a tuple of them (any of these); [shape] for a list of such
# items, [] for anything; {field: shape} for an object with these fields at least.


#: The kinds of a variant value by the first word of its schema.
KINDS = {"OBJECT": "object", "ARRAY": "list", "STRING": "string", "BIGINT": "long", "BOOLEAN": "boolean", "DECIMAL": "double", "DOUBLE": "double", "FLOAT": "double"}


def _kind(value: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)), F.lit("null"))


def shape_errors(records: DataFrame, key: str, json: str, shape: object, root: str = "$") -> DataFrame:
    """(key, path, problem) of every place of a JSON record that departs from a nested shape, at any depth.

    The record is parsed once to a variant. The walk follows the shape, which is finite, not the data: each list in the shape is one explode of the
    list's items, wherever it stands; objects and plain fields need none. problem: `missing`, or `expected <kind>, got <kind>`.
    """
    rows = records.select(key, F.try_parse_json(json).alias("at"), F.lit(root).alias("path"))
    parts = [rows.where("at is null").select(key, "path", F.lit("no record").alias("problem"))]
    todo: list[tuple[DataFrame, object]] = [(rows.where("at is not null"), shape)]
    while todo:
        here, want = todo.pop()
        nodes = _nodes(want)
        # a value and its kind become columns, one level after the other, so that no expression is worked out twice
        here = here.select(key, "path", F.col("at").alias("v0")).withColumn("k0", _kind(F.col("v0")))
        for depth in range(1, max((n.depth for n in nodes), default=0) + 1):
            level = [n for n in nodes if n.depth == depth]
            inner = {f"v{n.number}": F.when(F.col(f"k{n.above}") == "object", F.try_variant_get(f"v{n.above}", f"$['{n.field}']", "variant")) for n in level}
            here = here.withColumns(inner).withColumns({f"k{n.number}": _kind(F.col(f"v{n.number}")) for n in level})
        problems = []
        for n in nodes:
            value, kind, place = F.col(f"v{n.number}"), F.col(f"k{n.number}"), F.concat("path", F.lit(n.path))
            if n.depth:
                problems.append(F.when((F.col(f"k{n.above}") == "object") & value.isNull(), F.struct(place.alias("path"), F.lit("missing").alias("problem"))))
            names = n.kinds
            if names:
                problems.append(F.when(value.isNotNull() & ~kind.isin(list(names)), F.struct(place.alias("path"), F.concat(F.lit(f"expected {' or '.join(names)}, got "), kind).alias("problem"))))
            if n.items is not None:
                lists = here.where(kind == "list").select(key, value.alias("of"), place.alias("path"))
                each = lists.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("of").outer()).select("pos", "value"))
                todo.append((each.select(key, F.col("value").alias("at"), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("path")), n.items))
        if problems:
            parts.append(here.select(key, F.explode(F.array_compact(F.array(*problems))).alias("p")).select(key, "p.*"))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class _Node:
    """A place of a shape that is reached without entering a list."""

    number: int
    depth: int
    above: int
    field: str
    path: str
    kinds: tuple[str, ...]
    items: object = None


def _nodes(shape: object) -> list[_Node]:
    out: list[_Node] = []

    def add(want: object, depth: int, above: int, field: str, path: str) -> None:
        node = _Node(len(out), depth, above, field, path, ())
        out.append(node)
        if isinstance(want, (str, tuple)):
            node.kinds = (want,) if isinstance(want, str) else want
        elif isinstance(want, list):
            if want:
                node.kinds, node.items = ("list",), want[0]
        else:
            node.kinds = ("object",)
            for name, below in want.items():
                add(below, depth + 1, node.number, name, f"{path}.{name}")

    add(shape, 0, 0, "", "")
    return out
