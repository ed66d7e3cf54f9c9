"""Counters of edges under search as streaming state: how often a step was targeted, and how often its search was clean
and found nothing.

Events are rows (key, round, kind, empty, at): ``targeted`` counts a round's choice of the step, ``rolled_back`` takes it back where
the round turned out to be the last, ``searched`` with empty true tells of a clean search without yield. State holds one entry for each round of a
key, so an event that comes again, late, or in another order changes nothing: the counters are those of the batch aggregation
``counted``. Where keys never expire, the entries are a streaming aggregation; a processor of the same entries is kept for timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from claimloom.sources.scratch import shared_dir

EVENT = "key string, round int, kind string, empty boolean, at timestamp"
COUNTERS = "key string, times_targeted int, zero_yield_count int, exhausted boolean, expired boolean"
KINDS = ("targeted", "rolled_back", "searched")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def counted(events: DataFrame, exhaust_after: int = 2) -> DataFrame:
    """key, times_targeted, zero_yield_count, exhausted of a table of events."""
    kind = lambda k: F.max(F.col("kind") == k)
    rounds = events.groupBy("key", "round").agg(kind("targeted").alias("t"), kind("rolled_back").alias("r"), F.max((F.col("kind") == "searched") & F.coalesce("empty", F.lit(False))).alias("e"))
    out = rounds.groupBy("key").agg(F.count_if(F.col("t") & ~F.col("r")).cast("int").alias("times_targeted"), F.count_if(F.col("e")).cast("int").alias("zero_yield_count"))
    return out.withColumn("exhausted", F.col("zero_yield_count") >= exhaust_after)


class LinkCounters(StatefulProcessor):
    """Entries (targeted, rolled_back, empty) by round, for each key; with ``idle`` milliseconds a key that has had no event for so long in
    event time is told one last time (expired) and forgotten."""

    def __init__(self, exhaust_after: int, idle: int | None):
        self.exhaust_after, self.idle = exhaust_after, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rounds = handle.getMapState("rounds", "round int", "targeted boolean, rolled_back boolean, empty boolean")

    def _row(self, key: str, expired: bool) -> pd.DataFrame:
        entries = list(self.rounds.values())
        zero = sum(e[2] for e in entries)
        return pd.DataFrame([(key, sum(e[0] and not e[1] for e in entries), zero, zero >= self.exhaust_after, expired)], columns=["key", "times_targeted", "zero_yield_count", "exhausted", "expired"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told, last = {}, None
        for pdf in rows:
            for n, kind, empty in zip(pdf["round"], pdf["kind"], pdf["empty"], strict=True):
                new = (kind == "targeted", kind == "rolled_back", kind == "searched" and empty is not None and bool(empty))
                told[int(n)] = tuple(a or b for a, b in zip(told.get(int(n), (False, False, False)), new, strict=True))
            last = max(pdf["at"]) if last is None else max(last, max(pdf["at"]))
        for n, new in told.items():  # state is met once a round, however many events tell of it
            old = self.rounds.getValue((n,)) if self.rounds.containsKey((n,)) else None
            both = new if old is None else tuple(bool(a or b) for a, b in zip(old, new, strict=True))
            if old is None or both != tuple(old):
                self.rounds.updateValue((n,), both)
        if self.idle is not None and last is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.idle)
        yield self._row(key[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key[0], True)
        self.rounds.clear()

    def close(self) -> None:
        pass


def _aggregated(events: DataFrame, exhaust_after: int) -> DataFrame:
    """The counters as an aggregation: of each key the set of its entries, a number of round and kind each."""
    nth = F.coalesce(F.col("round").cast("long"), F.lit(1 << 31))  # no round's number
    told = F.when(F.col("kind") == "targeted", 0).when(F.col("kind") == "rolled_back", 1).when((F.col("kind") == "searched") & F.col("empty"), 2)
    sets = events.select("key", (nth * 4 + told).alias("entry")).groupBy("key").agg(F.collect_set("entry").alias("x"))
    rounds = lambda k: F.transform(F.filter("x", lambda e: F.pmod(e, F.lit(4)) == k), lambda e: e - k)
    out = sets.select("key", F.size(F.array_except(rounds(0), rounds(1))).alias("times_targeted"), F.size(rounds(2)).alias("zero_yield_count"))
    return out.select("*", (F.col("zero_yield_count") >= exhaust_after).alias("exhausted"), F.lit(False).alias("expired"))


def link_counters(events: DataFrame, exhaust_after: int = 2, idle_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """A stream of the counters (``COUNTERS``) of the keys that a batch of events touches. State lives in RocksDB, on
    the executors and in the query's checkpoint; only where keys expire does it pass through Python."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    if idle_ms is None:
        return _aggregated(events, exhaust_after)
    return events.withWatermark("at", late).groupBy("key").transformWithStateInPandas(LinkCounters(exhaust_after, idle_ms), outputStructType=COUNTERS, outputMode="Update", timeMode="EventTime")


def follow(counters: DataFrame, name: str, **trigger) -> tuple[StreamingQuery, str]:
    """Run a stream of counters; each batch's rows go to ``<folder>/rows/batch=<n>``, so that a batch which is run again writes the
    same rows again. The query, and the folder."""
    folder = f"{shared_dir(counters.sparkSession)}/{name}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    return counters.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start(), folder


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The last counters of each key that ``follow`` wrote."""
    rows = spark.read.schema(f"{COUNTERS}, batch int").parquet(f"{folder}/rows")
    last = rows.groupBy("key").agg(F.max_by(F.struct("times_targeted", "zero_yield_count", "exhausted", "expired"), F.struct("batch", "expired")).alias("c"))
    return last.select("key", "c.*")
