"""Report tables (O-41..O-48, O-51, O-52, O-67, O-130, O-131).

All of them are aggregates with map-side combine; totals are scalar
subqueries, never a window over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def sentiment_summary(df: DataFrame, by: str = "source_label") -> DataFrame:
    """Mean, sample standard deviation and count of sentiment per group."""
    return df.groupBy(by).agg(
        F.avg("sentiment").alias("mean"),
        F.stddev_samp("sentiment").alias("std"),
        F.count("sentiment").alias("n_posts"),
    )


def emotion_summary(df: DataFrame, by: str = "source_label",
                    emotions: Sequence[str] = (*fixed.EMOTIONS, "unknown")) -> DataFrame:
    """Contingency table group x dominant emotion, zero-filled.  The pivot
    values are given, so Spark runs no extra job to find them; every other
    emotion (another scorer's, or none) counts as ``other``, so a row adds up
    to its posts."""
    known = F.col("dominant_emotion").isin(list(emotions))
    named = df.withColumn("_emotion", F.when(known, F.col("dominant_emotion")).otherwise("other"))
    columns = [*emotions, "other"]
    return named.groupBy(by).pivot("_emotion", columns).count().na.fill(0, subset=columns)


def distribution(df: DataFrame, col: str, key_name: str = "key") -> DataFrame:
    """Normalised value counts of ``col`` (NULLs dropped): key, share."""
    d = df.where(F.col(col).isNotNull())
    total = d.agg(F.count("*")).scalar()
    return d.groupBy(F.col(col).alias(key_name)).agg(F.count("*").alias("_n")) \
            .select(key_name, (F.col("_n") / total).alias("share"))


def js_distance(current: DataFrame, previous: DataFrame, key: str = "key",
                share: str = "share") -> DataFrame:
    """Jensen-Shannon distance (natural log, square root) between two
    distributions given as (key, share) tables; keys missing on one side
    count 0.  See ``js_distance_pq``."""
    j = (current.select(key, F.col(share).alias("p"))
         .join(previous.select(key, F.col(share).alias("q")), key, "full_outer"))
    return js_distance_pq(j)


def paired_counts(df: DataFrame, col: str, is_current: Column) -> DataFrame:
    """(key, p, q): counts of ``col`` values in the current and the previous
    part of one table, in a single aggregate (no join of two scans)."""
    d = df.where(F.col(col).isNotNull())
    return d.groupBy(F.col(col).alias("key")).agg(
        F.count_if(is_current).cast("double").alias("p"),
        F.count_if(~is_current).cast("double").alias("q"))


def js_distance_pq(pq: DataFrame) -> DataFrame:
    """JS distance from a (key, p, q) table of weights; both sides are
    renormalised.  One row; NULL when there are no keys or a side sums to
    0.  The sums are one scalar subquery over the same (small, per-key)
    table, so the input plan is planned once and its exchange reused."""
    j = pq.select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    sums = j.agg(F.struct(F.sum("p").alias("sp"), F.sum("q").alias("sq"),
                          F.count("*").alias("nk")).alias("s")).scalar()
    pn, qn = F.col("p") / sums["sp"], F.col("q") / sums["sq"]
    m = (pn + qn) / 2

    def kl(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / m)).otherwise(F.lit(0.0))

    total = j.agg(F.sum(kl(pn) + kl(qn)).alias("t"), F.count("*").alias("nk"))
    valid = (F.col("nk") > 0) & (sums["sp"] > 0) & (sums["sq"] > 0)
    return total.select(F.when(valid, F.sqrt(F.greatest(F.lit(0.0), F.col("t") / 2))).alias("js_distance"))


def distribution_text(dist: DataFrame, key: str = "key", share: str = "share") -> Column:
    """A distribution as one sorted 'key=share' string (6 decimals)."""
    return F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(share).alias("s")))),
        lambda x: F.concat(x["k"], F.lit("="), F.format_string("%.6f", x["s"]))), ",")


def sentiment_by(df: DataFrame, col: str) -> DataFrame:
    """Mean sentiment per group, NULL groups and values dropped, by mean."""
    d = df.where(F.col(col).isNotNull() & F.col("sentiment").isNotNull())
    return d.groupBy(col).agg(F.avg("sentiment").alias("mean_sentiment")).orderBy("mean_sentiment", col)


def emotion_distribution(df: DataFrame) -> DataFrame:
    e = F.coalesce(F.col("dominant_emotion"), F.lit("unknown"))
    return df.groupBy(e.alias("emotion")).agg(F.count("*").alias("posts")) \
             .orderBy(F.col("posts").desc(), "emotion")


def kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("posts"),
        F.round(F.avg("sentiment"), 3).alias("avg_sentiment"),
        F.countDistinct("source_label").alias("labels"),
    )


def metric_total(lines: DataFrame, name: str, col: str = "value") -> DataFrame:
    """Sum of the last field of non-comment lines starting with ``name``;
    NULL when no line parses."""
    v = F.col(col)
    sel = lines.where(~v.startswith("#") & v.startswith(name))
    num = _try_cast_double(F.substring_index(v, " ", -1))
    return sel.agg(F.sum(num).alias("total"))


def _try_cast_double(c: Column) -> Column:
    return c.try_cast("double")


def metric_avg_latency(lines: DataFrame, prefix: str = "api_request_latency_seconds",
                       col: str = "value") -> DataFrame:
    """latency sum / latency count, NULL when the count is 0 or missing."""
    v = F.col(col)
    num = _try_cast_double(F.substring_index(v, " ", -1))
    ok = ~v.startswith("#")
    s = F.sum(F.when(ok & v.startswith(prefix + "_sum"), num))
    c = F.sum(F.when(ok & v.startswith(prefix + "_count"), num))
    return lines.agg(F.when((c != 0) & s.isNotNull(), s / c).alias("avg_latency"))


def energy_tail(energy: DataFrame, n: int = 10, order: str = "run_id") -> DataFrame:
    """Last ``n`` runs with unit-suffixed column names."""
    cols = [F.col(c).alias(f"{c} ({u})") for c, u in fixed.ENERGY_UNITS if c in energy.columns]
    return energy.orderBy(F.col(order).desc()).limit(n).select(order, *cols)
