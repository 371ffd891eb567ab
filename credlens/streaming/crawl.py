"""Crawl state as keyed state of a stream (O-06).

The run log is read as a stream; every (query, language) keeps its latest run,
its latest run that was not low, and the low runs since.  Runs may come in any
order, within a batch and across batches: a late run changes the state as it
would have in time.  Each batch writes the states it changed as a run of a
keyed table (``operators/runs``), so nothing replays the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import runs as Rn
from ..operators import store as St

KEY = "crawl_key"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = ("query_name string, lang string, last_cursor string, exhausted boolean, low_runs long, "
         "run_us long, run_seq long")


class CrawlState(StatefulProcessor):
    """Runs are ordered by (microseconds, sequence number)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "us long, seq long, cursor string, low boolean")
        self.good = handle.getValueState("good", "us long, seq long")
        self.low = handle.getListState("low", "us long, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = self.latest.get() if self.latest.exists() else None
        good = tuple(self.good.get()) if self.good.exists() else None
        low = [tuple(x) for x in self.low.get()] if self.low.exists() else []
        for part in rows:
            is_low = part["last_cursor"].isna() & part["new_cursor"].isna() & (part["n_posts"] <= 1)
            at = list(zip(part["us"].tolist(), part["run_seq"].tolist()))
            best = max(range(len(at)), key=at.__getitem__)
            if latest is None or at[best] > tuple(latest[:2]):
                cursor = part["new_cursor"].iloc[best]
                latest = (*at[best], None if pd.isna(cursor) else cursor, bool(is_low.iloc[best]))
            passed = [a for a, x in zip(at, is_low) if not x]
            if passed:
                good = max(passed) if good is None else max(good, max(passed))
            # only the low runs since the latest other run are held
            low = [a for a in [*low, *(a for a, x in zip(at, is_low) if x)] if good is None or a > good]
        self.latest.update(tuple(latest))
        if good is not None:
            self.good.update(good)
        if low:
            self.low.put(low)
        elif self.low.exists():
            self.low.clear()
        yield pd.DataFrame({"query_name": [key[0]], "lang": [key[1]], "last_cursor": [latest[2]], "exhausted": [latest[3]],
                            "low_runs": [len(low)], "run_us": [latest[0]], "run_seq": [latest[1]]})

    def close(self) -> None:
        pass


def crawl_states(log: DataFrame) -> DataFrame:
    """The changed states of a run log (a stream): see ``STATE``."""
    rows = log.select("query_name", "lang", "last_cursor", "new_cursor", "n_posts", "run_seq",
                      F.unix_micros(F.col("run_ts").cast("timestamp")).alias("us"))
    return rows.groupBy("query_name", "lang").transformWithStateInPandas(
        statefulProcessor=CrawlState(), outputStructType=STATE, outputMode="Update", timeMode="None")


def run_crawl_state(spark: SparkSession, log: Callable[[SparkSession], DataFrame], base: str, checkpoint: str) -> StreamingQuery:
    """Fold what is new in the run log into the state table at ``base``;
    ``log`` gives the run log as a stream of the session it gets."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))

    def each(batch: DataFrame, number: int) -> None:
        key = F.to_json(F.array("query_name", "lang"))
        St.upsert_scored(batch.sparkSession, base, batch.withColumn(KEY, key), KEY)

    return crawl_states(log(own)).writeStream.outputMode("update").foreachBatch(each) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_crawl_state(spark: SparkSession, base: str, max_pages: int = 5, low_limit: int = 3) -> DataFrame | None:
    """The state table with the columns of ``collect.crawl_state``."""
    table = Rn.read(spark, base, KEY, latest=True)
    if table is None:
        return None
    counter = F.when(F.col("lang") == "fr", F.col("low_runs")).otherwise(F.lit(0))
    return table.select(
        "query_name", "lang", "last_cursor", "exhausted", counter.cast("int").alias("low_activity_counter"),
        ((F.col("lang") == "fr") & (counter >= low_limit)).alias("skip_next"),
        F.when(F.col("exhausted"), F.lit(1)).otherwise(F.lit(max(1, max_pages // 2))).alias("page_budget"),
        F.timestamp_micros("run_us").cast("timestamp_ntz").alias("last_updated"))
