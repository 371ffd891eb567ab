"""Exact deduplication as a stateful stream.

The feed is one light row per document: digest of the normalised text, code
points of the original text, identifier and content locator (file and row
it lies in).  A streaming aggregation keeps, per digest and without expiry,
the document that stays, its locator and the number of documents seen; its
state is in RocksDB on local disk, logged to the checkpoint folder, so a
later feed meets all that came before and a lost executor's state is rebuilt.
Copies of one text meet in the map-side combine, so a digest that holds a
third of all rows reaches the state as one row per task.

A digest seen twice is a hit, and hits are checked on full bytes: all texts
of a digest are equal exactly when the smallest and the largest of them in
byte order are.  That pair is an aggregate too (one copy of a text leaves a
task, however often it repeats).  Where it finds different texts under one
digest, those texts are grouped by themselves.

Defined results: null text counts as empty, so null, empty and white-space
texts are one group; of rows with the same length, the smallest doc_id stays;
a null doc_id comes after all others; repeated rows stay one row each, all
with the group's result; an empty table gives no rows; further columns of the
input are not read.  ``drop_copies`` lets one row of each group stay, told from
its copies by its place, so rows that share their doc_id or have none go too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import drop_places, join_groups, place_of, placed, scratch

#: Deleted before texts are compared: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\f\r"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of feed per micro-batch.
BATCH_BYTES = 2 << 30

Digest = Callable[[Column], Column]


def sha256_hex(normalised: Column) -> Column:
    return F.sha2(normalised, 256)


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def digest_feed(docs: DataFrame, digest: Digest = sha256_hex, located: bool = False) -> DataFrame:
    """One light row per document.  ``located`` adds the file and row in it
    (inputs read from files); otherwise the identifier alone locates it."""
    file, row = place_of(docs) if located else (F.lit(None), F.lit(None))
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_points"),
        digest(normalised(text)).alias("digest"),
        file.cast("string").alias("file"),
        row.cast("long").alias("row"))


def run_state(spark: SparkSession, feed_path: str, base: str, batch_bytes: int = BATCH_BYTES) -> None:
    """Pass the feed files that ``base`` has not seen through the keyed state
    and store the changed groups of every micro-batch under ``base``.

    Run again with the same ``base`` after files were added, it goes on from
    the kept state.  A batch that is replayed overwrites its own folder.
    """
    own = spark.newSession()
    for k, v in {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
                 "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
                 "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
                 "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
                 "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
                 "spark.sql.streaming.stateStore.unloadOnCommit": "true",
                 "spark.sql.streaming.noDataMicroBatches.enabled": "false",
                 "spark.sql.streaming.minBatchesToRetain": "2",
                 "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        own.conf.set(k, v)
    schema = spark.read.parquet(feed_path).schema
    feed = own.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(feed_path)
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"), "file", "row"))
    state = feed.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best"))

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/groups/batch={number}")

    query = (state.writeStream.outputMode("update").foreachBatch(store)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


GROUP_SCHEMA = ("digest string, group_size long, "
                "best struct<n_points: long, not_id: long, file: string, row: long>")


def stored_groups(spark: SparkSession, base: str) -> DataFrame:
    """The state as of the last batch: digest, group_size, keep_id, file, row."""
    reader = spark.read.schema(GROUP_SCHEMA + ", batch int")
    last = reader.parquet(f"{base}/groups").groupBy("digest") \
        .agg(F.max(F.struct("group_size", "best")).alias("g"))
    return last.select("digest", F.col("g.group_size").alias("group_size"),
                       F.bitwise_not("g.best.not_id").alias("keep_id"),
                       F.col("g.best.file").alias("file"), F.col("g.best.row").alias("row"))


def false_hits(docs: DataFrame, digest: Digest = sha256_hex) -> DataFrame:
    """Digests that stand for more than one text, by their full bytes."""
    norm = normalised(F.col("text").cast("string"))
    texts = docs.select(digest(norm).alias("digest"), norm.alias("norm"))
    return texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")) \
        .filter("lo <> hi").select("digest")


def _resolved(docs: DataFrame, digest: Digest, located: bool, batch_bytes: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, digest, file and row, and its group's
    group_size, keep_id, keep_file and keep_row."""
    spark = docs.sparkSession
    base = scratch(spark, "exact_dedup")
    digest_feed(docs, digest, located).write.parquet(f"{base}/feed")
    feed = spark.read.parquet(f"{base}/feed")
    if feed.isEmpty():
        return feed.select("doc_id", "digest", "file", "row", F.lit(0).cast("long").alias("group_size"),
                           F.col("doc_id").alias("keep_id"), F.col("file").alias("keep_file"), F.col("row").alias("keep_row"))
    run_state(spark, f"{base}/feed", base, batch_bytes)
    stored_groups(spark, base).select("digest", "group_size", "keep_id", F.col("file").alias("keep_file"),
                                      F.col("row").alias("keep_row")).write.parquet(f"{base}/state")
    groups = spark.read.parquet(f"{base}/state")
    light = feed.select("doc_id", "digest", "file", "row")
    wrong = materialize(false_hits(docs, digest))
    if wrong.isEmpty():
        return join_groups(light, groups, ["digest"], "group_size")
    right = groups.join(wrong, "digest", "left_anti")
    return join_groups(light, right, ["digest"], "group_size").unionByName(_by_text(docs, wrong, digest, located))


def dedup(docs: DataFrame, digest: Digest = sha256_hex, located: bool = False,
          batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per row of ``docs``."""
    return _resolved(docs, digest, located, batch_bytes).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def _by_text(docs: DataFrame, wrong: DataFrame, digest: Digest, located: bool) -> DataFrame:
    """Groups of equal texts among the rows whose digest lies."""
    text = F.col("text").cast("string")
    file, row = place_of(docs) if located else (F.lit(None), F.lit(None))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text).alias("norm"),
                       F.length(F.coalesce(text, F.lit(""))).alias("n_points"),
                       digest(normalised(text)).alias("digest"),
                       file.cast("string").alias("file"),
                       row.cast("long").alias("row")).join(wrong, "digest")
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("not_id"), "file", "row"))
    groups = rows.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), best.alias("best")) \
        .select("digest", "norm", "group_size", F.bitwise_not("best.not_id").alias("keep_id"),
                F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"))
    rows, groups = materialize(rows.select("doc_id", "digest", "norm", "file", "row")), materialize(groups)
    return join_groups(rows, groups, ["digest", "norm"], "group_size").drop("norm")


def drop_copies(docs: DataFrame, digest: Digest = sha256_hex) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: exactly one of each group."""
    docs = placed(docs)
    gone = _resolved(docs, digest, True, BATCH_BYTES).filter("NOT (file = keep_file AND row = keep_row)")
    return drop_places(docs, gone)
