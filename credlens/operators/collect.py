"""Collector-side table operators (O-06, O-10, O-11, O-17, O-20, O-23, O-62).

The original keeps raw posts in per-source collections with a unique index
on ``uri`` and trims them to a cap.  Here a collection is a table; each
operator returns the next version of that table (or its counts) as a lazy
DataFrame, and ``runs`` stores it.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed

# ---------------------------------------------------------------------------
# filters
# ---------------------------------------------------------------------------
def _not_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(fixed.NOT_SPACE_PATTERN)


def filter_author_posts(df: DataFrame, allowed_langs: Sequence[str]) -> DataFrame:
    """uri present; a language in the allow-list (as ``Params`` cleans it) or
    no languages; text not blank."""
    allowed = list(allowed_langs)
    cond = F.col("uri").isNotNull() & (F.col("uri") != "") & _not_blank(F.col("record.text"))
    if allowed:
        langs = F.coalesce(F.col("langs"), F.array().cast("array<string>"))
        cond = cond & ((F.size(langs) == 0)
                       | F.arrays_overlap(langs, F.array(*[F.lit(l) for l in allowed])))
    return df.where(cond)


def skip_reason(df: DataFrame) -> Column:
    """'no_uri' / 'empty_text' / 'kept' for a batch about to be inserted."""
    return (F.when(F.col("uri").isNull() | (F.col("uri") == ""), "no_uri")
             .when(~_not_blank(F.col("record.text")), "empty_text")
             .otherwise("kept"))


# ---------------------------------------------------------------------------
# insert-ignore on a unique key
# ---------------------------------------------------------------------------
def insert_ignore(existing: DataFrame, batch: DataFrame, key: str = "uri",
                  now: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``batch`` that would be inserted: valid rows whose key is not
    in ``existing`` yet, one per key (first by ``order``, ties by content);
    stamped with ``inserted_at``.  Appending them to the table keeps the key
    unique.  Known keys go first, so only new records are gathered by key;
    that dedup is an aggregate (map-side combined)."""
    kept = batch.where(skip_reason(batch) == "kept").join(existing.select(key), key, "left_anti")
    others = [c for c in kept.columns if c != key]
    by = F.struct(*[F.col(c) for c in order], F.to_json(F.struct(*others)))
    new = kept.groupBy(key).agg(F.min_by(F.struct(*others), by).alias("_r")).select(key, "_r.*")
    stamp = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    return new.withColumn("inserted_at", stamp)


def insert_counts(existing: DataFrame, batch: DataFrame, key: str = "uri") -> DataFrame:
    """One row: inserted / duplicates / skipped_no_uri / skipped_empty_text."""
    reason = skip_reason(batch)
    tagged = batch.select(key, reason.alias("reason"))
    kept = tagged.where(F.col("reason") == "kept").select(key).distinct()
    new = kept.join(existing.select(key), key, "left_anti")
    counts = tagged.agg(
        F.count_if(F.col("reason") == "kept").alias("valid"),
        F.count_if(F.col("reason") == "no_uri").alias("skipped_no_uri"),
        F.count_if(F.col("reason") == "empty_text").alias("skipped_empty_text"),
    )
    inserted = new.agg(F.count("*")).scalar()
    return counts.select(
        inserted.alias("inserted"),
        (F.col("valid") - inserted).alias("duplicates"),
        "skipped_no_uri", "skipped_empty_text")


# ---------------------------------------------------------------------------
# retention and cap
# ---------------------------------------------------------------------------
def prune_retention(df: DataFrame, retention_days: int, now: _dt.datetime | Column,
                    ts: str = "inserted_at") -> DataFrame:
    """Rows younger than ``retention_days`` (0 or less = keep all).  Only rows
    known to be older go: a row without a time stays."""
    if not retention_days or retention_days <= 0:
        return df
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    cutoff = now_c - F.make_dt_interval(days=F.lit(int(retention_days)))
    return df.where(F.col(ts).isNull() | (F.col(ts) >= cutoff))


#: Portions in which the rows of a group are ranked before their best meet.
PORTIONS = 64


def newest_per_group(df: DataFrame, group: Sequence[str], n: Column | int, order: Sequence[Column], tie: str) -> DataFrame:
    """The first ``n`` rows of each group, without a group ever being gathered
    whole: every portion of a group keeps its first ``n``, then these are
    ranked, at most ``PORTIONS`` times ``n`` rows whatever the size of the group."""
    limit = n if isinstance(n, Column) else F.lit(n)
    portion = F.pmod(F.xxhash64(tie), F.lit(PORTIONS))
    near = Window.partitionBy(*group, "_portion").orderBy(*order)
    far = Window.partitionBy(*group).orderBy(*order)
    local = df.withColumn("_portion", portion).withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= limit)
    return local.drop("_portion", "_rn").withColumn("_rn", F.row_number().over(far)) \
        .where(F.col("_rn") <= limit).drop("_rn")


def prune_cap(df: DataFrame, caps: Mapping[str, int], default_cap: int,
              source: str = "source_label", ts: str = "inserted_at", tie: str = "uri",
              bucket: str = "hour") -> DataFrame:
    """Newest ``cap`` rows per source (oldest excess removed).  A cap of 0 or
    less keeps all; rows without a time are the oldest; rows without a source
    are a source of their own, under the default cap.

    Exact and skew-safe: rows are first counted per (source, time bucket)
    (a map-side combined aggregate); a running sum over that small table
    (one row per source and bucket) tells which buckets are kept whole,
    dropped whole, or cut.  Only rows of the one cut bucket per source are
    ranked, in portions (``newest_per_group``)."""
    spark = df.sparkSession
    # the columns of the join are never NULL
    keyed = df.withColumn("_src", F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))) \
        .withColumn("_b", F.coalesce(F.date_trunc(bucket, F.col(ts)).cast("string"), F.lit("")))
    counts = keyed.groupBy("_src", "_b").agg(F.count("*").alias("_n"))
    cap_rows = [("1" + k, int(v)) for k, v in caps.items()]
    if cap_rows:
        # as many rows as the caller names sources
        counts = counts.join(F.broadcast(spark.createDataFrame(cap_rows, "_src string, _cap int")), "_src", "left")
        counts = counts.withColumn("_cap", F.coalesce("_cap", F.lit(int(default_cap))))
    else:
        counts = counts.withColumn("_cap", F.lit(int(default_cap)))
    w = Window.partitionBy("_src").orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    counts = counts.withColumn(
        "_state",
        F.when((F.col("_cap") <= 0) | (F.col("_newer") + F.col("_n") <= F.col("_cap")), "keep")
         .when(F.col("_newer") >= F.col("_cap"), "drop").otherwise("cut"))
    plan = counts.where(F.col("_state") != "drop").select(
        "_src", "_b", "_state", (F.col("_cap") - F.col("_newer")).alias("_left"))
    tagged = keyed.join(plan, ["_src", "_b"])
    keep_all = tagged.where(F.col("_state") == "keep")
    newest = [F.col(ts).desc_nulls_last(), F.col(tie).desc()]
    cut = newest_per_group(tagged.where(F.col("_state") == "cut"), ["_src", "_b"], F.col("_left"), newest, tie)
    return keep_all.unionByName(cut).select(*df.columns)


# ---------------------------------------------------------------------------
# crawl state
# ---------------------------------------------------------------------------
def crawl_state(log: DataFrame, max_pages: int = 5, low_limit: int = 3,
                keys: Sequence[str] = ("query_name", "lang"),
                order: Sequence[str] = ("run_ts", "run_seq")) -> DataFrame:
    """State after replaying a run log (query_name, lang, run_ts, run_seq,
    last_cursor, new_cursor, n_posts) per (query, language).

    Built from aggregates only (no window over a key's whole history):
    the latest run by ``max_by``; the low-activity counter is the number of
    low runs after the latest run that was not low."""
    o = F.struct(*[F.col(c) for c in order])
    low = F.col("last_cursor").isNull() & F.col("new_cursor").isNull() & (F.col("n_posts") <= 1)
    g = log.withColumn("_o", o).withColumn("_low", low)
    latest = g.groupBy(*keys).agg(
        F.max_by(F.struct("new_cursor", "_low", "run_ts"), F.col("_o")).alias("_l"),
        F.max(F.when(~F.col("_low"), F.col("_o"))).alias("_last_ok"),
    )
    trailing = (g.where("_low").join(latest.select(*keys, "_last_ok"), list(keys))
                 .where(F.col("_last_ok").isNull() | (F.col("_o") > F.col("_last_ok")))
                 .groupBy(*keys).agg(F.count("*").alias("_trail")))
    s = latest.join(trailing, list(keys), "left")
    exhausted = F.col("_l._low")
    counter = F.when(F.col("lang") == "fr", F.coalesce(F.col("_trail"), F.lit(0))).otherwise(F.lit(0))
    return s.select(
        *keys,
        F.col("_l.new_cursor").alias("last_cursor"),
        exhausted.alias("exhausted"),
        counter.cast("int").alias("low_activity_counter"),
        ((F.col("lang") == "fr") & (counter >= low_limit)).alias("skip_next"),
        F.when(exhausted, F.lit(1)).otherwise(F.lit(max(1, max_pages // 2))).alias("page_budget"),
        F.col("_l.run_ts").alias("last_updated"),
    )
