"""Stand-in inputs built from the driver's tables.

The original application reads posts from a document store.  Here every
input record type is derived from the given parquet tables, so each query's
work grows with those tables:

* raw posts      <- ``documents`` (one post per document; German documents
                    carry their text only as a quoted post)
* feed items     <- raw posts, wrapped under ``post`` for even ids
* crawl run log  <- ``events``
* predictions    <- ``labels`` joined with ``documents``
* vectors        <- ``embeddings``
* metric lines, energy rows <- ``events``
* post URLs      <- ``pages.url``
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .paged import START
from .raw import with_source_rank

# FIXED VALUES of the stand-in roles (shared with the SQL oracle)
TEST_SOURCES = tuple(f"src{i}" for i in range(20))
TEST_VERIFIED = ("src0", "src1", "src2", "src3", "src4")
BASE_TS = _dt.datetime(2024, 1, 1)
QUOTED_LANG = "de"
# a fixed "now" for retention and run ids: tests pass the clock in
NOW = _dt.datetime(2024, 1, 31, 0, 0, 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 raw posts (+ ``source_label``, ``source_rank``, ``doc_id``)."""
    return posts_from_documents(table(spark, sf_dir, "documents"))


def posts_from_documents(d: DataFrame) -> DataFrame:
    """The raw-post view of ``documents`` rows (batch or stream)."""
    quoted = F.col("lang") == QUOTED_LANG
    record = F.struct(
        F.when(quoted, F.lit("")).otherwise(F.col("text")).alias("text"),
        F.when(quoted, F.struct(F.struct(F.struct(F.col("text").alias("text")).alias("record"))
                                .alias("record"))).alias("embed"),
    )
    posts = d.select(
        "doc_id",
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri"),
        F.array(F.col("lang")).alias("langs"),
        record.alias("record"),
        (F.lit(BASE_TS).cast("timestamp_ntz")
         + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("inserted_at"),
        F.col("source").alias("source_label"),
    )
    return with_source_rank(posts, TEST_SOURCES)


def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 feed items: even ids wrapped under ``post``, odd ids flat."""
    p = raw_posts(spark, sf_dir)
    fields = ["uri", "langs", "record", "inserted_at"]
    wrapped = (F.col("doc_id") % 2) == 0
    cols = [F.when(wrapped, F.struct(*fields)).alias("post")]
    cols += [F.when(~wrapped, F.col(c)).alias(c) for c in fields]
    return p.select(*cols, "source_label")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 crawl run log from ``events``: a run per event, low when 'error'."""
    return run_log_of(table(spark, sf_dir, "events"))


def run_log_of(e: DataFrame) -> DataFrame:
    low = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").cast("string").alias("query_name"),
        F.when(F.col("event_type").isin("view", "click"), "en").otherwise("fr").alias("lang"),
        F.col("ts").alias("run_ts"),
        F.col("event_id").alias("run_seq"),
        F.when(low, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("c"), (F.col("event_id") - 1).cast("string"))).alias("last_cursor"),
        F.when(low, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("new_cursor"),
        F.when(low, F.lit(0)).otherwise(F.floor("value").cast("int")).alias("n_posts"),
    )


def land_pages(spark: SparkSession, sf_dir: str, path: str, ids: int = 100) -> None:
    """Landed pages from ``documents``: a chain per language, its documents by
    ``ids`` consecutive numbers a page, each page naming the one after it."""
    d = table(spark, sf_dir, "documents").select(
        F.coalesce("lang", F.lit("none")).alias("chain"), F.floor(F.col("doc_id") / ids).alias("page"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("uri"), F.array("lang").alias("langs"),
        F.struct("text").alias("record")).where("page IS NOT NULL")
    order = Window.partitionBy("chain").orderBy("page")
    # as many rows as pages
    pages = d.select("chain", "page").distinct().select(
        "chain", "page", F.lead("page").over(order).alias("following"), (F.row_number().over(order) == 1).alias("first"))
    d.join(pages, ["chain", "page"]).select(
        "uri", "langs", "record", F.concat(F.lit("p"), F.col("following").cast("string")).alias("next_cursor"), "chain",
        F.when(F.col("first"), F.lit(START)).otherwise(F.concat(F.lit("p"), F.col("page").cast("string"))).alias("cursor")) \
        .repartition("chain", "cursor").write.partitionBy("chain", "cursor").json(path)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a capped collection: source = event type, inserted at = ts."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("evt/"), F.col("event_id").cast("string")).alias("uri"),
        F.col("event_type").alias("source_label"),
        F.col("ts").alias("inserted_at"),
        "event_id",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7 truth / prediction pairs: truth = ``quality``, prediction from length."""
    l = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = l.join(d, "doc_id")
    return j.select(
        "doc_id",
        F.when(F.col("quality") == 1, "credible").otherwise("unverified").alias("y_true"),
        F.when(F.col("n_chars") > 2000, "credible").otherwise("unverified").alias("y_pred"),
    )


def metric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prometheus-style lines derived from ``events``: per event one sample
    line; per event type one HELP comment line.  Column ``value`` like
    ``spark.read.text``."""
    e = table(spark, sf_dir, "events")
    samples = e.select(F.format_string(
        "credlens_event_value_%s{user=\"%d\"} %s",
        F.col("event_type"), F.col("user_id"), F.format_string("%.2f", F.col("value"))).alias("value"))
    latency = e.select(F.format_string(
        "api_request_latency_seconds_%s %s",
        F.when(F.col("event_type") == "error", "count").otherwise("sum"),
        F.when(F.col("event_type") == "error", F.lit("1"))
         .otherwise(F.format_string("%.2f", F.col("value")))).alias("value"))
    comments = e.select("event_type").distinct().select(
        F.format_string("# HELP credlens_event_value_%s events of type %s",
                        F.col("event_type"), F.col("event_type")).alias("value"))
    return samples.unionByName(latency).unionByName(comments)


def energy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy report rows (one per run) derived from ``events`` by day."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    g = e.groupBy(day.alias("run_day")).agg(
        F.count("*").alias("n"), F.sum("value").alias("v"), F.max("value").alias("mx"))
    return g.select(
        F.date_format("run_day", "yyyyMMdd").alias("run_id"),
        F.col("n").cast("double").alias("duration"),
        F.round(F.col("v") / 1000.0, 6).alias("emissions"),
        F.round(F.col("v") / 1000.0 / F.col("n"), 9).alias("emissions_rate"),
        F.round(F.col("mx"), 2).alias("cpu_power"),
        F.lit(0.0).alias("gpu_power"),
        F.round(F.col("mx") / 2, 2).alias("ram_power"),
        F.round(F.col("v") / 3600.0, 6).alias("cpu_energy"),
        F.lit(0.0).alias("gpu_energy"),
        F.round(F.col("v") / 7200.0, 6).alias("ram_energy"),
        F.round(F.col("v") / 3600.0 + F.col("v") / 7200.0, 6).alias("energy_consumed"),
        F.lit(32.0).alias("ram_total_size"),
        F.lit(1.0).alias("pue"),
    )
