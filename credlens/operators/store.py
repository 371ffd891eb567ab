"""Keyed writes on the scored-post table (O-12, O-13, O-14, O-15, O-16).

``upsert``, ``update_existing`` and ``insert_absent`` compute a table's next
state as a join.  Stored tables are log-structured (``runs``): a batch is a
run of its own, committed at once, so a failed job never leaves a half-written
table and a replayed batch gives the same result (writes are keyed, hence
idempotent).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs as Rn

# FIXED VALUES: field lists written by the two writers of the original application
CLEAN_FIELDS = (
    "uri", "source_label", "credibility_label", "clean_text", "tokens", "lang_detected",
    "sentiment", "emotion_scores", "dominant_emotion", "explanation_terms",
    "explanation_text", "credibility_score", "predicted_label", "alert", "inserted_at",
)
SCORING_FIELDS = (
    "uri", "source_label", "credibility_label", "clean_text", "tokens", "lang_detected",
    "sentiment", "emotion_scores", "dominant_emotion", "emotion_status", "explanation_terms",
    "explanation_text", "credibility_score", "predicted_label", "alert", "inserted_at",
)


def one_per_key(rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the largest by ``order``, ties by the row's content."""
    others = [c for c in rows.columns if c != key]
    if not others:
        return rows.distinct()
    by = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*others)))
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), by).alias("_row")).select(key, "_row.*")


def upsert(table: DataFrame, updates: DataFrame, key: str = "post_id",
           fields: Sequence[str] | None = None, now: Column | None = None,
           order: Sequence[str] = ()) -> DataFrame:
    """``$set`` listed fields by key (the update's value even when NULL),
    keep the table's other fields, ``created_at`` only on insert.

    Full outer join on the (unique) key with hit markers on both sides;
    updates are first made unique per key (``one_per_key``)."""
    fields = [f for f in (fields or updates.columns) if f != key and f in updates.columns]
    u = one_per_key(updates.select(key, *fields), key, order).withColumn("_hit_u", F.lit(True))
    t_cols = [c for c in table.columns if c != key]
    t = table.withColumn("_hit_t", F.lit(True))
    j = t.alias("t").join(u.alias("u"), key, "full_outer")
    hit_u = F.coalesce(F.col("_hit_u"), F.lit(False))
    hit_t = F.coalesce(F.col("_hit_t"), F.lit(False))
    out_cols = [F.col(key)]
    for c in dict.fromkeys(t_cols + fields):
        if c == "created_at":
            continue
        if c in fields and c in t_cols:
            out_cols.append(F.when(hit_u, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        elif c in fields:
            out_cols.append(F.col(f"u.{c}").alias(c))
        else:
            out_cols.append(F.col(f"t.{c}").alias(c))
    stamp = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    created = F.when(hit_t, F.col("t.created_at") if "created_at" in t_cols else F.lit(None)) \
               .otherwise(stamp)
    return j.select(*out_cols, created.alias("created_at"))


def upsert_counts(table: DataFrame, updates: DataFrame, key: str = "post_id") -> DataFrame:
    """inserted / matched counts of an upsert, as one row."""
    u = updates.select(key).distinct()
    m = u.join(table.select(key), key, "left_semi")
    matched = m.agg(F.count("*")).scalar()
    return u.agg(F.count("*").alias("_n")).select(
        (F.col("_n") - matched).alias("inserted"), matched.alias("matched"))


def update_existing(table: DataFrame, updates: DataFrame, key: str = "post_id",
                    fields: Sequence[str] | None = None) -> DataFrame:
    """Update-only (no upsert): matched rows take the listed fields from the
    update, unmatched updates are dropped, other rows are unchanged."""
    fields = [f for f in (fields or updates.columns) if f != key and f in updates.columns]
    u = one_per_key(updates.select(key, *fields), key).withColumn("_hit", F.lit(True))
    j = table.alias("t").join(u.alias("u"), key, "left")
    cols = []
    for c in table.columns:
        if c == key:
            cols.append(F.col(key))
        elif c in fields:
            cols.append(F.when(F.col("_hit"), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"t.{c}"))
    extra = [F.when(F.col("_hit"), F.col(f"u.{c}")).alias(c) for c in fields if c not in table.columns]
    return j.select(*cols, *extra)


def insert_absent(table: DataFrame, rows: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows whose key is not in the table yet (``ON CONFLICT DO NOTHING``);
    known keys go before the rows are gathered by key."""
    return one_per_key(rows.join(table.select(key), key, "left_anti"), key)


def dense_vector_rows(df: DataFrame, features: str = "features", out: str = "embedding") -> DataFrame:
    """The vector table's dense ``array<float>`` from an ML vector column."""
    from pyspark.ml.functions import vector_to_array
    return df.withColumn(out, vector_to_array(F.col(features), "float32"))


# ---------------------------------------------------------------------------
# stored tables and reports
# ---------------------------------------------------------------------------
def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = Rn.file_system(spark, path)
    return fs.exists(p)


def read_rows(spark: SparkSession, base: str, key: str) -> DataFrame | None:
    """An insert-only table; None when there is none yet."""
    return Rn.read(spark, base, key)


def insert_rows(rows: DataFrame, base: str, key: str) -> int:
    """Add the rows whose key the table does not hold yet; returns their number.
    Rows without a key are left out."""
    new = one_per_key(rows.where(F.col(key).isNotNull()), key)
    known = Rn.known_keys(new.select(key), base, key)
    return Rn.append(new.join(known, key, "left_anti"), base, key)


def read_scored(spark: SparkSession, base: str, keys: DataFrame | None = None) -> DataFrame | None:
    """The scored table, or its rows of ``keys`` (post_id, each once); None when there is none."""
    return Rn.read(spark, base, "post_id", latest=True, keys=keys)


def upsert_scored(spark: SparkSession, base: str, updates: DataFrame, key: str = "post_id",
                  now: Column | None = None) -> int:
    """Upsert into the scored table: the batch is written as a run of its own
    and the table is not read; ``created_at`` of a key is that of its first run.
    Rows without a key are left out, of a key's several rows one is kept
    (``one_per_key``; rows are gathered by key only where a key has several).  Returns the number of keys written."""
    stamp = (now if now is not None else F.current_timestamp()).cast("timestamp_ntz")
    rows = updates.drop("created_at").where(F.col(key).isNotNull())
    return Rn.append(rows.withColumn("created_at", stamp), base, key, latest=True,
                     unique=lambda written: one_per_key(written.drop("created_at"), key).withColumn("created_at", stamp))


def append_report(df: DataFrame, path: str, run_id: str, run_ts: Column | None = None) -> None:
    """Add a report stamped with ``run_id`` / ``run_ts``, partitioned by run
    id (the 'timestamped file' of the original); a repeated run replaces its own."""
    ts = run_ts if run_ts is not None else F.current_timestamp().cast("timestamp_ntz")
    (df.withColumn("run_id", F.lit(run_id)).withColumn("run_ts", ts)
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))


def save_json(spark: SparkSession, obj: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(obj),)], "value string").coalesce(1) \
         .write.mode("overwrite").text(path)
