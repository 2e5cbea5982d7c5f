"""Streams with state by key: chapters that are analysed again only when their text changed, and debts that fall due.

State lies in the checkpoint of the query, below the shared folder. A chapter's state is the hash of its text; rows whose hash is
known pass no further, so an analysis behind it sees new and changed chapters only, whatever files they come in. A debt is settled by its owner's next
closing event if that is within the limit, else it is overdue: a timer in event time says so once the watermark has passed it, and a later
closing event finds it so, whichever comes first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from storyloom.functions.storage import shared_dir
from storyloom.operators.projection import chapter_counts, chapter_metrics
from storyloom.operators.story import latest
from storyloom.streaming.events import events_of, file_stream

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changed(StatefulProcessor):
    """Rows (key, hash, ..) of which the hash is not the key's last one, with state `new` or `changed`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState("hash", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            keep, states = [], []
            for i, h in enumerate(part["hash"]):
                before = self.hash.get()[0] if self.hash.exists() else None
                if h != before:
                    self.hash.update((h,))
                    keep.append(i)
                    states.append("new" if before is None else "changed")
            if keep:
                yield part.iloc[keep].assign(state=states)

    def close(self) -> None:
        pass


class Debts(StatefulProcessor):
    """Debts of one owner: rows (owner, event_id, opened, status) as they are settled or fall overdue. Input: owner, event_id, ts, kind (open, close)."""

    LIMIT_MS = 10 * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ids array<long>, opened array<long>")

    def _read(self) -> dict[int, int]:
        """The debts that are open, with the time at which each was opened."""
        found = self.open.get() if self.open.exists() else None
        return dict(zip(found[0], found[1], strict=True)) if found else {}

    def _write(self, debts: dict[int, int]) -> None:
        if debts:
            self.open.update((list(debts), list(debts.values())))
        else:
            self.open.clear()

    def _out(self, key, found: list[tuple[int, int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"owner": [key[0]] * len(found), "event_id": [f[0] for f in found], "opened": pd.to_datetime([f[1] for f in found], unit="ms"), "status": [f[2] for f in found]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int, str]] = []
        debts = self._read()
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            now = int(r.ts.value // 1_000_000)
            if r.kind == "open":
                debts[int(r.event_id)] = now
                self.handle.registerTimer(now + self.LIMIT_MS)
                continue
            for event_id, opened in [d for d in debts.items() if d[1] <= now]:
                found.append((event_id, opened, "settled" if now <= opened + self.LIMIT_MS else "overdue"))
                del debts[event_id]
        self._write(debts)
        if found:
            yield self._out(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Debts that are still open at their time; one that was settled meanwhile is not there any more."""
        due, debts = expiredTimerInfo.getExpiryTimeInMs(), self._read()
        found = [(event_id, opened, "overdue") for event_id, opened in debts.items() if opened + self.LIMIT_MS <= due]
        if found:
            self._write({e: o for e, o in debts.items() if o + self.LIMIT_MS > due})
            yield self._out(key, found)

    def close(self) -> None:
        pass


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """Run a stateful query over what is there, appending to `path`; all rows of all runs so far."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def changed_chapters(chapters: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A stream's chapters that are new or changed: the rows with hash and state."""
    hashed = chapters.withColumn("hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hashed.schema) + ", state string"
    return hashed.groupBy(key).transformWithStateInPandas(Changed(), schema, "append", "none")


def overdue_debts(events: DataFrame) -> DataFrame:
    """A watermarked stream (owner, event_id, ts, kind) as (owner, event_id, opened, status)."""
    return events.groupBy("owner").transformWithStateInPandas(Debts(), "owner long, event_id long, opened timestamp, status string", "append", "eventTime")


def stream_reanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, then the same documents again, some of them longer: what was analysed how often, and the metrics that hold."""
    path = shared_dir(spark)
    stored = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    inbox = lambda: spark.readStream.schema(stored.schema).parquet(f"{path}/inbox/*")
    stored.write.parquet(f"{path}/inbox/1")
    run_available(changed_chapters(inbox()), path)
    longer = F.when(F.col("source").endswith("1"), F.concat(F.coalesce("text", F.lit("")), F.lit(" And more!"))).otherwise(F.col("text"))
    stored.withColumn("text", longer).write.parquet(f"{path}/inbox/2")
    seen = run_available(changed_chapters(inbox()), path)
    times = seen.groupBy("doc_id").agg(F.count("*").alias("analysed"), F.count_if(F.col("state") == "new").alias("first"))
    now = latest(seen.select("doc_id", "source", "text", F.when(F.col("state") == "new", 0).otherwise(1).alias("at")), "doc_id", ["at"])
    metrics = chapter_metrics(chapter_counts(now)).select("doc_id", "wc", "ch_hash")
    return times.join(metrics, "doc_id")


def stream_overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks open debts that purchases settle within ten days."""
    kind = F.when(F.col("event_type") == "click", "open").when((F.col("event_type") == "purchase") | F.col("user_id").isNull(), "close")
    events = events_of(spark, sf_dir).withWatermark("ts", "1 day").select(F.coalesce("user_id", F.lit(-1)).alias("owner"), F.coalesce("event_id", F.lit(-1)).alias("event_id"), "ts", kind.alias("kind")).where("kind is not null")
    found = run_available(overdue_debts(events), shared_dir(spark))
    return found.select("owner", "event_id", "status")


QUERIES = {"stream_reanalysis": stream_reanalysis, "stream_overdue": stream_overdue}
ORACLES = {
    "stream_reanalysis": """
        SELECT doc_id, CAST(CASE WHEN source LIKE '%1' THEN 2 ELSE 1 END AS BIGINT) AS analysed, CAST(1 AS BIGINT) AS first, CAST(length(translate(t, chr(10) || ' ', '')) AS BIGINT) AS wc, substr(sha256(t), 1, 16) AS ch_hash
        FROM (SELECT doc_id, source, coalesce(text, '') || CASE WHEN source LIKE '%1' THEN ' And more!' ELSE '' END AS t FROM documents) a""",
    "stream_overdue": """
        SELECT c.user_id AS owner, c.event_id, CASE WHEN p.ts IS NOT NULL AND p.ts <= c.ts + INTERVAL 10 DAY THEN 'settled' ELSE 'overdue' END AS status
        FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts <= p.ts""",
}
