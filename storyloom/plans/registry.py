"""Queries by name: an operator applied to the given tables, and SQL for the checking engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.operators.projection import chapter_counts, chapter_metrics
from storyloom.plans.corpus import CHAPTERS, ENTITY_EVENT, SAG_EVENTS, metrics_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


#: Bytes of a table of texts for each task that counts them.
TASK_BYTES = 8 << 20
#: The metrics by application, session and folder, so that their plan is made once.
_metrics: dict[tuple[str, int, str], DataFrame] = {}


class Tables:
    """The tables of a folder as attributes; `metrics` and `chapters` are made from documents."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def metrics(self) -> DataFrame:
        """The metrics of all chapters. Rows of numbers, kept on the executors' memory and disk, so that the texts are read and counted once a session."""
        key = (self.spark.sparkContext.applicationId, id(self.spark), self.sf_dir)
        if key not in _metrics:
            _metrics[key] = chapter_metrics(chapter_counts(self.spread("documents")))
        return _metrics[key].persist(StorageLevel.MEMORY_AND_DISK)

    def spread(self, name: str, key: str = "doc_id") -> DataFrame:
        """A table of texts dealt by its key in tasks of even size, a core's worth of them at least: a file, of whatever size, may be one split, or have all its rows in one of its splits."""
        rows, cores = getattr(self, name), self.spark.sparkContext.defaultParallelism
        size = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(f"{self.sf_dir}/{name}.parquet").agg(F.sum("length")).first()[0] or 0
        return rows.repartition(max(cores, -(-size // TASK_BYTES)), key)

    @property
    def sag_events(self) -> DataFrame:
        """The events as a story: 40 a chapter, by importance, each pointing back to the event before it of its user."""
        e = self.events.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
        before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
        return e.select("event_id", (F.floor(F.col("event_id") / 40) + 1).alias("chapter_id"), "user_id", "event_type", "value", (F.floor("value") % 10 + 1).alias("importance"), "k", before.alias("related_id"))

    @property
    def entity_event(self) -> DataFrame:
        """(entity, event_id, chapter_id, event_type): the user and the key of each event are its entities."""
        e = self.sag_events
        return e.select(F.explode(F.array(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("k"), "k"))).alias("entity"), "event_id", "chapter_id", "event_type", "importance")

    @property
    def chapters(self) -> DataFrame:
        return self.documents.select(F.col("source").alias("book"), "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("ch_num"))


#: Shared projections in SQL, by the name that a statement uses; each may name those before it.
SHARED = {
    "metrics": metrics_sql(),
    "chapters": CHAPTERS,
    "sag_events": SAG_EVENTS,
    "entity_event": ENTITY_EVENT,
}


def with_shared(sql: str) -> str:
    """Put the shared projections that a statement names in front of it."""
    own = re.match(r"\s*WITH( RECURSIVE)?\b", sql)
    parts: list[str] = []
    for name, text in reversed(SHARED.items()):
        if re.search(rf"\b{name}\b", " ".join([sql, *parts])):
            parts.insert(0, f"{name} AS MATERIALIZED ({text})")
    if not parts:
        return sql
    return f"WITH{own[1] or '' if own else ''} {', '.join(parts)}{',' + sql[own.end() :] if own else ' ' + sql}"


class Catalog:
    """DataFrame operators applied to tables, each with SQL written independently of it."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql is not None:
                self.oracles[name] = with_shared(sql)
            return build

        return add
