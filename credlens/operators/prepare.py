"""Clean, deduplicate and weakly label posts (O-18, O-19, O-35, O-40, O-80, O-87).

Key design points for scale:

* ``post_id`` = SHA-256 of the clean text is the compact key used by every
  later per-post table (token, term and contribution tables repeat it once
  per row, so it must be short).
* Deduplication is an aggregate, not a window: ``min_by`` over the load
  order is combined map-side, so a text copied a billion times leaves each
  map task as one row and no task ever holds one hot group.
* The dedup aggregate hash-partitions the table by ``post_id``; every later
  per-post aggregate and join-back on ``post_id`` reuses that partitioning
  (no further exchange, see ``explain``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text


def post_id(clean: Column | str = "clean_text") -> Column:
    c = F.col(clean) if isinstance(clean, str) else clean
    return F.sha2(c, 256)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cores before CPU-heavy text work when the
    input is fewer files than cores (a file of one row group cannot be split by
    the reader).  A large input is many files, so there this adds no shuffle.
    Only the scan's file list is looked at."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def with_text(raw: DataFrame) -> DataFrame:
    """Extracted text; rows without any text are dropped (O-18, O-19)."""
    return spread(raw).withColumn("text", text.extract_text("record")).where(F.length("text") > 0)


def with_clean_text(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """``clean_text`` (O-80); rows whose clean text is '' are dropped unless
    asked.  The text passes through a generator, below which the optimizer
    cannot push a filter, so the cleaning chain runs once per row."""
    out = df.select("*", F.explode_outer(F.array(text.clean_text("text"))).alias("clean_text"))
    return out if keep_empty else out.where(F.col("clean_text") != "")


def clean_posts(raw: DataFrame, keep_empty: bool = False) -> DataFrame:
    return with_clean_text(with_text(raw), keep_empty).withColumn("post_id", post_id())


def dedup_first(df: DataFrame, order: Sequence[str] = ("source_rank", "inserted_at", "uri"),
                key: str = "post_id") -> DataFrame:
    """Exact duplicates of ``clean_text`` collapse to the first row in load
    order (source position, then insertion time, then uri)."""
    others = [c for c in df.columns if c != key]
    # the text is chosen apart (by the same order, so from the same row): where it is not read it is not shuffled
    parts = {"_first": [c for c in others if c != "clean_text"], "_text": [c for c in others if c == "clean_text"]}
    by = F.struct(*[F.col(c) for c in order])
    firsts = [F.min_by(F.struct(*[F.col(c) for c in cols]), by).alias(n) for n, cols in parts.items() if cols]
    at = {c: f"{n}.{c}" for n, cols in parts.items() for c in cols}
    return df.groupBy(key).agg(*firsts).select(key, *[F.col(at[c]).alias(c) for c in others])


def dedup_counts(cleaned: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows in (non-empty clean text), rows kept, duplicates removed, as one
    row: sums over one aggregate by key, so every text is cleaned once."""
    n = F.coalesce(F.sum("_n"), F.lit(0))
    return cleaned.groupBy(key).agg(F.count("*").alias("_n")) \
        .agg(n.alias("rows_in"), F.count("*").alias("rows_kept"), (n - F.count("*")).alias("duplicates_removed"))


def with_weak_labels(df: DataFrame, verified: Sequence[str]) -> DataFrame:
    return df.withColumn("credibility_label", rules.weak_label("source_label", tuple(verified)))


def prepare_posts(raw: DataFrame, verified: Sequence[str]) -> DataFrame:
    """The shared head of both runs: clean -> dedup -> weak label.

    Neither the record nor the extracted text is shuffled: later steps read
    the clean text."""
    return with_weak_labels(dedup_first(clean_posts(raw).drop("record", "text")), verified)
