"""Runs of stages that are timed and can be taken up again, and trees of reductions.

A stage's rows are written to the shared folder and read again as the next one's input, counted on the way by an observation of the
write itself. A row (run, stage, rows, seconds) of each goes to a table of JSON lines. A run that broke off goes on behind the
last stage that was written whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from storyloom.operators.hooks import Stages
from storyloom.sources.stores import append_lines, read_lines

TIMES = "run string, place int, stage string, rows long, seconds double"


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run_stages(rows: DataFrame, stages: Stages, path: str, run: str = "run") -> DataFrame:
    """The rows of the last stage. path: the run's folder; what is there already is not worked out again."""
    spark = rows.sparkSession
    for i, (name, stage) in enumerate(stages.stages):
        at = f"{path}/{i:02d}-{name}"
        if not written(spark, at):
            seen, began = Observation(f"{run}-{name}"), time.time()
            stage(rows).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(at)
            facts = [(run, i, name, int(seen.get["rows"]), round(time.time() - began, 3))]
            append_lines(spark.createDataFrame(facts, TIMES), f"{path}/times")
        rows = spark.read.parquet(at)
    return rows


def stage_times(spark: SparkSession, path: str) -> DataFrame:
    """(run, place, stage, rows, seconds) of the stages of a folder."""
    return read_lines(spark, f"{path}/times", TIMES)


def reduce_tree(leaves: DataFrame, path: str, reduce: Callable[[int, Column], Column], by: str = "book", order: str = "ch_num", value: str = "value", chunk: int = 8, group: int = 5, least: int = 3, fallback: Callable[[int, Column], Column] | None = None) -> DataFrame:
    """(by, level, node, n, value): leaves joined `chunk` at a time to nodes of level 1, these `group` at a time to level 2 where a root has `least` of them, and the rest to one root of level 3.

    reduce: from the level and the array of (order, value) of a node, in order, to its value; null where it failed. Nodes are written level by level below `path`
    and not worked out again; failed ones are noted in `path`/failed with their key, have the fallback's value (null without one) and are tried again by the next run.
    """
    spark = leaves.sparkSession
    schema = f"{by} {leaves.schema[by].dataType.simpleString()}, level int, node long, n int, value string, failed boolean"
    items = leaves.select(by, F.col(order).cast("long").alias("at"), F.col(value).alias("value"))
    items = items.withColumn("node", F.floor((F.row_number().over(Window.partitionBy(by).orderBy("at")) - 1) / chunk).cast("long"))
    out: list[DataFrame] = []
    for level in (1, 2, 3):
        at, done = f"{path}/level={level}", None
        if written(spark, at):
            done = spark.read.schema(schema).parquet(f"{path}/level={level}").drop("level").withColumn("level", F.lit(level)).where("not failed")
            todo = items.join(done.select(by, "node"), [by, "node"], "left_anti")
        else:
            todo = items
        nodes = todo.groupBy(by, "node").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("items"))
        made = nodes.select(by, F.lit(level).alias("level"), "node", F.size("items").alias("n"), "items", reduce(level, F.col("items")).alias("made"))
        instead = fallback(level, F.col("items")) if fallback else F.lit(None).cast("string")
        rows = made.select(by, "level", "node", "n", F.coalesce("made", instead).alias("value"), F.col("made").isNull().alias("failed"))
        attempt = f"{path}/attempts/{level}-{int(time.time() * 1000)}"
        rows.write.parquet(attempt)
        fresh = spark.read.schema(rows.schema).parquet(attempt)
        append_lines(fresh.where("failed").select(by, "level", "node"), f"{path}/failed")
        whole = fresh if done is None else done.select(fresh.columns).unionByName(fresh)
        if not fresh.isEmpty():
            _replace(whole, at)
        level_rows = spark.read.schema(rows.schema).parquet(at)
        out.append(level_rows)
        items = _grouped(level_rows, by, group, least) if level == 1 else level_rows.select(by, F.col("node").alias("at"), "value", F.lit(0).cast("long").alias("node"))
    return out[0].unionByName(out[1]).unionByName(out[2]).drop("failed")


def _grouped(nodes: DataFrame, by: str, group: int, least: int) -> DataFrame:
    """Nodes of level 1 under their parents: `group` each, or one each where there are too few to be grouped."""
    many = F.count("*").over(Window.partitionBy(by)) >= least
    return nodes.select(by, F.col("node").alias("at"), "value", F.when(many, F.floor(F.col("node") / group)).otherwise(F.col("node")).cast("long").alias("node"))


def _replace(rows: DataFrame, path: str) -> None:
    """Write a table beside its old version and put it in that one's place."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark._jvm.org.apache.hadoop.fs
    old, new = jvm.Path(path), jvm.Path(f"{path}.new")
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def failed_nodes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The nodes that were noted as failed, once each."""
    return read_lines(spark, f"{path}/failed", schema).distinct()


def joined(items: Column) -> Column:
    """A reduction that keeps everything: the values of a node's items, one a line."""
    return F.array_join(F.transform(items, lambda x: F.coalesce(x["value"], F.lit(""))), "\n")
