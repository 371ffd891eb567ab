"""Dashboard queries as table operators (O-07, O-21, O-22, O-45, O-60,
O-61, O-68, O-93, O-94)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from . import reports as Rp
from .collect import newest_per_group


def latest_per_source(df: DataFrame, sources: Sequence[str], n: int,
                      ts: str = "inserted_at", tie: str = "uri") -> DataFrame:
    """Newest ``n`` rows of each listed source, ranked in portions, so that
    no source is gathered whole whatever ``n`` is."""
    d = df.where(F.col("source_label").isin(list(sources)))
    newest = [F.col(ts).desc_nulls_last(), F.col(tie).desc()]
    return newest_per_group(d, ["source_label"], n, newest, tie)


def dashboard_filter(df: DataFrame, langs: Sequence[str], emotions: Sequence[str] | None) -> DataFrame:
    out = df.where(F.col("lang_detected").isin(list(langs)))
    if emotions:
        out = out.where(F.col("dominant_emotion").isin(list(emotions)))
    return out


def latest_preview(df: DataFrame, n: int = 100, ts: str = "inserted_at", tie: str = "uri") -> DataFrame:
    """Newest ``n`` rows (a top-k: TakeOrderedAndProject), existing columns
    of the post field list renamed to display names."""
    cols = [(c, d) for c, d in fixed.POST_FIELDS if c in df.columns]
    top = df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
    return top.select(*[F.col(c).alias(d) for c, d in cols])


def emotion_ranked(df: DataFrame) -> DataFrame:
    """Long table (uri, position, emotion, score) of emotions with score > 0,
    highest first (ties by lexicon order)."""
    e = df.select("uri", F.posexplode(F.filter("emotion_ranked", lambda x: x["score"] > 0))
                  .alias("_p", "_e"))
    return e.select("uri", (F.col("_p") + 1).alias("position"), "_e.emotion", "_e.score")


def drift_report(lab_pq: DataFrame, lng_pq: DataFrame) -> DataFrame:
    """One row: JS distance of the label and of the language distribution
    (current vs previous) and both current distributions as text.  Inputs
    are (key, p, q) count tables (``reports.paired_counts``)."""
    def current(pq: DataFrame) -> DataFrame:
        tot = pq.agg(F.sum("p")).scalar()
        return pq.where(F.col("p") > 0).select("key", (F.col("p") / tot).alias("share"))

    lab = Rp.js_distance_pq(lab_pq)
    lng = Rp.js_distance_pq(lng_pq)
    lab_cur, lng_cur = current(lab_pq), current(lng_pq)
    return lab.select(
        F.round("js_distance", 6).alias("label_js_distance"),
        F.round(lng.scalar(), 6).alias("language_js_distance"),
        lab_cur.agg(Rp.distribution_text(lab_cur)).scalar().alias("current_label_distribution"),
        lng_cur.agg(Rp.distribution_text(lng_cur)).scalar().alias("current_language_distribution"),
    )


def label_probabilities(df: DataFrame, probs: str = "probabilities",
                        predicted: str = "predicted_label") -> DataFrame:
    """Long table (uri, label, probability): two classes are named
    credible / unverified, more are class_i; if the predicted label is not
    among the names, the most probable entry takes it."""
    p = F.col(probs)
    n = F.size(p)
    best = F.array_position(p, F.array_max(p)) - 1
    names = F.when(n == 2, F.array(*[F.lit(x) for x in fixed.BINARY_CLASS_NAMES])) \
             .otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("class_"), i.cast("string"))))
    has = F.array_contains(names, F.col(predicted))
    e = df.select("uri", predicted, names.alias("_names"), has.alias("_has"), best.alias("_best"),
                  F.posexplode(p).alias("_i", "probability"))
    label = F.when(~F.col("_has") & (F.col("_i") == F.col("_best")), F.col(predicted)) \
             .otherwise(F.get("_names", F.col("_i")))
    return e.select("uri", F.col("_i").alias("class_index"), label.alias("label"), "probability")


def parse_post_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Split a post URL into host, handle and post id with a validity flag
    and reason; the record key needs the handle's DID (``resolve_posts``)."""
    u = F.trim(F.col(url))
    host = F.try_parse_url(u, F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    ok_host = F.coalesce(host.isin(list(fixed.POST_HOSTS)), F.lit(False))
    shape = (F.size(parts) >= 4) & (F.get(parts, 0) == "profile") & (F.get(parts, 2) == "post")
    reason = (F.when(~ok_host | (F.size(parts) < 4), "bad_host_or_path")
               .when(~shape, "not_a_post_url").otherwise("ok"))
    return df.select(
        "*",
        host.alias("host"),
        F.when(reason == "ok", F.get(parts, 1)).alias("handle"),
        F.when(reason == "ok", F.get(parts, 3)).alias("post_id_part"),
        reason.alias("url_status"),
    )


def resolve_posts(parsed: DataFrame, handles: DataFrame, posts: DataFrame) -> DataFrame:
    """Record URI from the handle's DID (handles: handle, did) and the post
    text by that URI (posts: uri, text); status 'no_text' when empty."""
    j = parsed.join(handles, "handle", "left")
    j = j.withColumn("record_uri", F.when(
        F.col("did").isNotNull(),
        F.format_string("at://%s/app.bsky.feed.post/%s", F.col("did"), F.col("post_id_part"))))
    j = j.join(posts.select(F.col("uri").alias("record_uri"), F.trim("text").alias("post_text")),
               "record_uri", "left")
    return j.withColumn("url_status", F.when(
        (F.col("url_status") == "ok") & F.coalesce(F.col("post_text"), F.lit("")).__eq__(""), "no_text")
        .otherwise(F.col("url_status")))
