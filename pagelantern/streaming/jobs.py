"""Structured Streaming jobs: continuous audit, usage counts, rates, sessions, duplicates, enrichment, alerts, stalled runs.

Each function takes a streaming (or batch) DataFrame and returns the transformed one; `run_available` drives one to
completion over what is there, for backfills and tests.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType

from pagelantern.operators import rules
from pagelantern.operators.keyed_store import KeyedStore
from pagelantern.sources import features as fx


def read_pages(spark: SparkSession, folder: str, schema: StructType, files: int = 50) -> DataFrame:
    """New page files of a folder as they arrive, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def continuous_audit(pages: DataFrame) -> DataFrame:
    """Findings of all page rules for every arriving page; stateless."""
    return rules.page_findings(rules.rule_inputs(fx.page_features(pages)))


def counts_by_day(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events by day and type; rows later than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n", "value")


def sliding_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Requests by user in windows of an hour every ten minutes."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = e.groupBy(F.window("ts", "1 hour", "10 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions by user: start, end and events, ended by a gap."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_copies(pages: DataFrame, late: str = "7 days") -> DataFrame:
    """Pages (host, content_hash, ts) without those whose text their host already had within the watermark."""
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["host", "content_hash"])


def with_plan(events: DataFrame, orgs: DataFrame) -> DataFrame:
    """Events with their organization's plan, from a static table."""
    return events.join(orgs, "org_id", "left")


_ALERT = StructType([StructField("schedule_id", LongType()), StructField("at", TimestampType()), StructField("score", DoubleType()), StructField("delta", DoubleType())])


class DriftAlerts(StatefulProcessor):
    """Alerts when a schedule's score falls by `threshold` against its last run, at most one in `hours`.

    State for a schedule: its last score and its last alert. A suppressed alert does not restart the clock. Rows of a
    micro-batch are taken in event-time order; a run older than the last one seen is left out.
    """

    def __init__(self, threshold: float = 10.0, hours: int = 24):
        self.threshold, self.gap = threshold, pd.Timedelta(hours=hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("at", TimestampType()), StructField("score", DoubleType())]))
        self.alerted = handle.getValueState("alerted", StructType([StructField("at", TimestampType())]))

    def handleInputRows(self, key, rows, timerValues):
        runs = pd.concat(list(rows)).sort_values("ts")
        last = self.last.get() if self.last.exists() else None
        told = pd.Timestamp(self.alerted.get()[0]) if self.alerted.exists() else None
        out = []
        for at, score in zip(runs["ts"], runs["score"]):
            if last is not None and at < pd.Timestamp(last[0]):
                continue
            if last is not None and score - last[1] <= -self.threshold and (told is None or at - told >= self.gap):
                out.append((key[0], at, float(score), round(float(score - last[1]), 4)))
                told = at
            last = (at, float(score))
        if last is not None:
            self.last.update(last)
        if told is not None:
            self.alerted.update((told,))
        yield pd.DataFrame(out, columns=["schedule_id", "at", "score", "delta"])

    def close(self) -> None:
        pass


def drift_alerts(runs: DataFrame, threshold: float = 10.0, hours: int = 24) -> DataFrame:
    """Drift alerts of runs (schedule_id, ts, score). The session needs the RocksDB state store."""
    return runs.groupBy("schedule_id").transformWithStateInPandas(DriftAlerts(threshold, hours), _ALERT, outputMode="Append", timeMode="None")


class StalledRuns(StatefulProcessor):
    """Reports a run that started and had no end within `minutes` of event time."""

    def __init__(self, minutes: int = 6):
        self.wait = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.started = handle.getValueState("started", StructType([StructField("at", TimestampType())]))

    def handleInputRows(self, key, rows, timerValues):
        events = pd.concat(list(rows)).sort_values("ts")
        ended = events["status"].isin(["completed", "failed"]).any()
        for t in list(self.handle.listTimers()) if ended or self.started.exists() else []:
            self.handle.deleteTimer(t)
        if ended:
            self.started.clear()
        else:
            at = events["ts"].iloc[-1]
            self.started.update((at,))
            self.handle.registerTimer(int(at.timestamp() * 1000) + self.wait)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.started.exists():
            yield pd.DataFrame({"run_id": [key[0]], "started_at": [pd.Timestamp(self.started.get()[0])]})
            self.started.clear()

    def close(self) -> None:
        pass


def stalled_runs(events: DataFrame, minutes: int = 6, late: str = "1 minute") -> DataFrame:
    """run_id and started_at of runs (run_id, ts, status) that did not end in time."""
    out = StructType([StructField("run_id", LongType()), StructField("started_at", TimestampType())])
    e = events.withWatermark("ts", late)
    return e.groupBy("run_id").transformWithStateInPandas(StalledRuns(minutes), out, outputMode="Append", timeMode="EventTime")


def upsert_batches(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str, buckets: int = 16):
    """Keeps the latest row of each key in a stored table, each batch merged as the version that its number names.

    A batch reads and writes the buckets that its rows touch; a repeated batch writes the same again, a broken one is never seen.
    """

    def merge(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, target, keys, order, buckets).merge(batch, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows of a table that upsert_batches keeps, None if nothing was committed yet."""
    return KeyedStore(spark, target, [], "").read()


def arriving(rows: DataFrame, folder: str, by: str, files: int = 2) -> DataFrame:
    """rows as a stream of micro-batches, one for each value of the integer column `by` (few values), in its order.

    Each batch is written as `files` files, after the one before, and a trigger takes as many.
    """
    numbers = sorted(r[by] for r in rows.select(by).distinct().collect())
    for k in numbers:
        rows.where(F.col(by) == k).drop(by).repartition(files).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.drop(by).schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into Parquet and returns the rows; in complete mode each batch replaces them."""
    spark, name = stream.sparkSession, f"run_{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/{name}").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/{name}")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")
