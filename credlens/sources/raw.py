"""Scans of raw post collections and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import schemas


def read_collection(spark: SparkSession, path: str, fmt: str = "json",
                    schema=schemas.RAW_POST) -> DataFrame:
    """One raw collection; JSON is read with an explicit schema, never inferred."""
    reader = spark.read.schema(schema)
    if fmt == "json":
        return reader.json(path)
    return reader.format(fmt).load(path)


def load_raw_posts(spark: SparkSession, collections: Mapping[str, str] | Sequence[tuple[str, str]],
                   fmt: str = "json", schema=schemas.RAW_POST) -> DataFrame:
    """Union scan of N collections, each row tagged with its collection name
    and the collection's position in the list (``source_rank``)."""
    items = list(collections.items()) if isinstance(collections, Mapping) else list(collections)
    frames = []
    for rank, (name, path) in enumerate(items):
        frames.append(read_collection(spark, path, fmt, schema)
                      .withColumn("source_label", F.lit(name))
                      .withColumn("source_rank", F.lit(rank)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_sources(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Union of already loaded frames in list order (same tagging as above)."""
    out = None
    for rank, (name, df) in enumerate(frames):
        df = df.withColumn("source_label", F.lit(name)).withColumn("source_rank", F.lit(rank))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_partitioned_posts(spark: SparkSession, path: str, sources: Sequence[str],
                           schema=None) -> DataFrame:
    """Raw posts stored as parquet partitioned by ``source_label``: the list
    becomes a partition filter (only those folders are listed and read)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path).where(F.col("source_label").isin(list(sources)))
    return with_source_rank(df, sources)


def with_source_rank(df: DataFrame, sources: Sequence[str], col: str = "source_label") -> DataFrame:
    """Position of the row's source in the configured load order (0-based);
    unknown sources sort last."""
    pos = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col(col))
    return df.withColumn("source_rank",
                         F.when(pos > 0, (pos - 1).cast("int")).otherwise(F.lit(len(sources))))


def unwrap_feed(df: DataFrame, post_col: str = "post") -> DataFrame:
    """Feed items carry the post under ``post`` or are the post itself."""
    flat = [f.name for f in df.schema[post_col].dataType.fields]
    return df.select(F.coalesce(F.col(post_col), F.struct(*[F.col(c) for c in flat])).alias("p")) \
             .select("p.*")


def latest_run(df: DataFrame, ts_col: str = "run_ts", by: Sequence[str] = ()) -> DataFrame:
    """Rows of the latest run (per ``by`` group): the 'latest file' scan over
    a report table with a run time stamp.  One aggregate plus a join on a
    table with one row per group, so no group is gathered into one task."""
    if not by:
        latest = df.agg(F.max(ts_col).alias("_latest"))
        return df.join(F.broadcast(latest), F.col(ts_col) == F.col("_latest"), "left_semi")
    latest = df.groupBy(*by).agg(F.max(ts_col).alias(ts_col))
    return df.join(latest, [*by, ts_col], "left_semi")


def metric_lines(spark: SparkSession, path: str) -> DataFrame:
    """Prometheus exposition text, one row per line (column ``value``)."""
    return spark.read.text(path)


def energy_report(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Energy rows of CSV files, by the names in their header (other columns
    are allowed and left out; one that is missing is NULL).  The run is the
    ``run_id`` column, else the given id, else the file's name."""
    raw = spark.read.option("header", True).csv(path)
    run = F.col("run_id") if "run_id" in raw.columns else \
        F.lit(run_id) if run_id is not None else F.regexp_extract("_metadata.file_name", r"^(.*?)(\.csv)?$", 1)
    cols = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in raw.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.ENERGY.fields if f.name != "run_id"]
    return raw.select(run.cast("string").alias("run_id"), *cols)
