"""Structured Streaming: watermarked windows and sessions, keyed state, and incremental chapter metrics, each run to the end of the available files.

Results go to Parquet files in the shared folder, with the query's checkpoint beside them. Windows and sessions are written in
append mode once the watermark has passed them, and their state is dropped then; a marker far behind the last event, read as a
second file source, lets the watermark pass all of them. Upserts write each batch's rows with the batch's number, so that a
batch that runs again after a failure replaces its own rows; readers take the latest row of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyloom.functions.storage import shared_dir
from storyloom.operators.projection import chapter_counts, chapter_metrics
from storyloom.operators.story import latest


def file_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """New files of a table as a stream; what was seen is kept in the checkpoint."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 1000).parquet(f"{sf_dir}/{table}.parquet*")


def with_marker(events: DataFrame, stored: DataFrame, days: int = 60) -> DataFrame:
    """The stream and a last row without a user, `days` behind all others."""
    spark, path = events.sparkSession, f"{shared_dir(events.sparkSession)}/marker"
    last = stored.agg(F.max("ts").cast("timestamp").alias("ts")).select(*[(F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
    last.coalesce(1).write.parquet(path)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(path))


def appended(stream: DataFrame) -> DataFrame:
    """Run a query over all available input in append mode and return what it wrote."""
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession)
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def upserted(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a query over all available input; the latest row of each key."""
    spark, path = stream.sparkSession, shared_dir(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if len(keys) > 1:
        rows = rows.select(F.struct(*keys).alias("key"), *[c for c in rows.columns if c not in keys])
        return latest(rows, "key", ["batch"]).select("key.*", *[c for c in rows.columns if c not in ("key", "batch")])
    return latest(rows, keys[0], ["batch"]).drop("batch")


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = spark.read.parquet(f"{sf_dir}/events.parquet")
    return with_marker(file_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), stored)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_of(spark, sf_dir).withWatermark("ts", "1 day")
    counts = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return appended(counts).where("event_type is not null").select(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_of(spark, sf_dir).withWatermark("ts", "1 day")
    sessions = events.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return appended(sessions).where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


def board(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Debts of one user: a click opens one, a purchase settles all that are open."""
    opened, pending = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches)).sort_values("event_id")
    for kind in rows["event_type"]:
        if kind == "click":
            opened, pending = opened + 1, pending + 1
        elif kind == "purchase":
            pending = 0
    state.update((opened, pending))
    yield pd.DataFrame({"user_id": [key[0]], "opened": [opened], "pending": [pending]})


def stream_debts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State by key: the debt board of each user, renewed as events arrive."""
    events = file_stream(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    kept = events.groupBy("user_id").applyInPandasWithState(board, "user_id long, opened long, pending long", "opened long, pending long", "update", GroupStateTimeout.NoTimeout)
    return upserted(kept, ["user_id"])


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of new chapters as they arrive, upserted by chapter; metrics of what is there."""
    counts = chapter_counts(file_stream(spark, sf_dir, "documents"))
    return chapter_metrics(upserted(counts, ["book", "doc_id"], "append")).select("book", "ch_num", "ch_hash", "wc", "hook_density", "pleasure_intensity")


QUERIES = {"event_windows": event_windows, "event_sessions": event_sessions, "stream_debts": stream_debts, "stream_metrics": stream_metrics}
ORACLES = {
    "event_windows": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """
        SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (
          SELECT user_id, s, count(*) AS n FROM (
            SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
              SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events) a) b
          GROUP BY user_id, s) c GROUP BY user_id""",
    "stream_debts": "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS opened, count(*) FILTER (WHERE event_type = 'click' AND event_id > last) AS pending FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id), -1) AS last FROM events) a GROUP BY user_id",
}
