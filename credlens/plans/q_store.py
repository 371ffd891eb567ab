"""Queries: collector sinks (insert-ignore, prune), crawl state, keyed
writes on the scored table, incremental selection, latest-N scans,
metric and energy reports, classification metrics, URL parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import fixed
from ..operators import collect as C
from ..operators import dashboard as D
from ..operators import incremental as I
from ..operators import metrics as M
from ..operators import reports as Rp
from ..operators import store as St
from ..sources import raw as R
from ..sources import standins as S
from . import oracle as O
from .catalog import register
from .q_enrich import enriched
from .q_prepare import posts

NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


def _now():
    return F.lit(S.NOW).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# insert-ignore on uri
# ---------------------------------------------------------------------------
def _insert_inputs(spark, sf):
    p = S.raw_posts(spark, sf)
    existing = p.where(F.col("doc_id") % 3 == 0).select("uri")
    batch = p.unionByName(p.where(F.col("langs")[0] == "fr"))   # in-batch repeats
    return existing, batch


_INSERT_CTES = [("raw_posts", O.RAW_POSTS),
                ("existing", "SELECT uri FROM raw_posts WHERE doc_id % 3 = 0"),
                ("batch", "SELECT * FROM raw_posts UNION ALL SELECT * FROM raw_posts WHERE langs[1] = 'fr'"),
                ("tagged", f"""
SELECT *, CASE WHEN uri IS NULL OR uri = '' THEN 'no_uri'
               WHEN NOT regexp_matches(coalesce(rec_text, ''), '{fixed.NOT_SPACE_PATTERN}') THEN 'empty_text'
               ELSE 'kept' END AS reason
FROM batch""")]


@register("insert_ignore", O.with_(*_INSERT_CTES, final=f"""
SELECT uri, doc_id, source_label, md5(rec_text) AS text_md5, {NOW_SQL} AS inserted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY uri ORDER BY source_rank, doc_id) AS rn FROM tagged
  WHERE reason = 'kept' AND uri NOT IN (SELECT uri FROM existing))
WHERE rn = 1"""))
def insert_ignore(spark, sf):
    existing, batch = _insert_inputs(spark, sf)
    new = C.insert_ignore(existing, batch, now=_now(), order=("source_rank", "doc_id"))
    return new.select("uri", "doc_id", "source_label", F.md5("record.text").alias("text_md5"), "inserted_at")


@register("insert_counts", O.with_(*_INSERT_CTES, final="""
SELECT (SELECT count(DISTINCT uri) FROM tagged WHERE reason = 'kept' AND uri NOT IN (SELECT uri FROM existing)) AS inserted,
       count(*) FILTER (WHERE reason = 'kept')
         - (SELECT count(DISTINCT uri) FROM tagged WHERE reason = 'kept' AND uri NOT IN (SELECT uri FROM existing)) AS duplicates,
       count(*) FILTER (WHERE reason = 'no_uri') AS skipped_no_uri,
       count(*) FILTER (WHERE reason = 'empty_text') AS skipped_empty_text
FROM tagged"""))
def insert_counts(spark, sf):
    existing, batch = _insert_inputs(spark, sf)
    return C.insert_counts(existing, batch)


# ---------------------------------------------------------------------------
# retention and cap on a collection (events stand in)
# ---------------------------------------------------------------------------
RETENTION_DAYS = 7
# FIXED VALUES of the stand-in caps (per event type; others use the default)
TEST_CAPS = {"view": 1000, "click": 1500, "error": 3000, "uncapped": 0, "two": 2}
TEST_DEFAULT_CAP = 500

# hand-made rows: no time (counted as oldest), no source, a source without a cap
HAND_ROWS = (("hand/1", None, None), ("hand/2", "hand", None), ("hand/3", "hand", "2024-01-01 00:00:00"),
             ("hand/4", None, "2024-01-01 00:00:00"), ("hand/5", "uncapped", None), ("hand/6", "two", None),
             ("hand/7", "two", "2024-01-01 00:00:00"), ("hand/8", "two", "2024-01-01 00:00:00"))

_EVT = ("evt", """
SELECT 'evt/' || CAST(event_id AS VARCHAR) AS uri, event_type AS source_label, ts AS inserted_at, event_id
FROM events""")
_CAP_ROWS = ("cap_rows", f"""
SELECT uri, source_label, inserted_at FROM evt UNION ALL
SELECT uri, source_label, CAST(ts_text AS TIMESTAMP) FROM {O.values(HAND_ROWS, 'uri, source_label, ts_text')}""")


def _cap_rows(spark, sf):
    hand = spark.createDataFrame(list(HAND_ROWS), "uri string, source_label string, ts_text string") \
        .select("uri", "source_label", F.col("ts_text").cast("timestamp_ntz").alias("inserted_at"))
    rows = S.event_rows(spark, sf).select("uri", "source_label", F.col("inserted_at").cast("timestamp_ntz").alias("inserted_at"))
    return rows.unionByName(hand)


@register("prune_retention", O.with_(_EVT, _CAP_ROWS, final=f"""
SELECT uri, source_label FROM cap_rows
WHERE inserted_at IS NULL OR inserted_at >= {NOW_SQL} - INTERVAL {RETENTION_DAYS} DAY"""))
def prune_retention(spark, sf):
    return C.prune_retention(_cap_rows(spark, sf), RETENTION_DAYS, S.NOW).select("uri", "source_label")


_CAP_CASE = "CASE source_label " + " ".join(f"WHEN {O.q(k)} THEN {v}" for k, v in TEST_CAPS.items()) \
            + f" ELSE {TEST_DEFAULT_CAP} END"


@register("prune_cap", O.with_(_EVT, _CAP_ROWS, final=f"""
SELECT uri, source_label FROM (
  SELECT *, row_number() OVER (PARTITION BY source_label ORDER BY inserted_at DESC NULLS LAST, uri DESC) AS rn FROM cap_rows)
WHERE rn <= {_CAP_CASE} OR {_CAP_CASE} <= 0"""))
def prune_cap(spark, sf):
    kept = C.prune_cap(_cap_rows(spark, sf), TEST_CAPS, TEST_DEFAULT_CAP)
    return kept.select("uri", "source_label")


# ---------------------------------------------------------------------------
# crawl state
# ---------------------------------------------------------------------------
@register("crawl_state", O.with_(("log", """
SELECT CAST(user_id AS VARCHAR) AS query_name,
       CASE WHEN event_type IN ('view', 'click') THEN 'en' ELSE 'fr' END AS lang,
       ts AS run_ts, event_id AS run_seq,
       CASE WHEN event_type = 'error' THEN NULL ELSE 'c' || CAST(event_id - 1 AS VARCHAR) END AS last_cursor,
       CASE WHEN event_type = 'error' THEN NULL ELSE 'c' || CAST(event_id AS VARCHAR) END AS new_cursor,
       CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS n_posts
FROM events"""), ("steps", """
SELECT *, (last_cursor IS NULL AND new_cursor IS NULL AND n_posts <= 1) AS low,
       row_number() OVER (PARTITION BY query_name, lang ORDER BY run_ts DESC, run_seq DESC) AS back
FROM log"""), ("islands", """
SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY query_name, lang ORDER BY run_ts, run_seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM steps"""), ("counted", """
SELECT *, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (PARTITION BY query_name, lang, island ORDER BY run_ts, run_seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_low FROM islands"""), final=f"""
SELECT query_name, lang, new_cursor AS last_cursor, low AS exhausted,
       CAST(CASE WHEN lang = 'fr' THEN run_low ELSE 0 END AS INTEGER) AS low_activity_counter,
       (lang = 'fr' AND run_low >= {DEFAULT.crawl_low_activity_limit}) AS skip_next,
       CASE WHEN low THEN 1 ELSE {max(1, DEFAULT.crawl_max_pages // 2)} END AS page_budget,
       run_ts AS last_updated
FROM counted WHERE back = 1"""))
def crawl_state(spark, sf):
    return C.crawl_state(S.run_log(spark, sf), DEFAULT.crawl_max_pages, DEFAULT.crawl_low_activity_limit)


# ---------------------------------------------------------------------------
# keyed writes on the scored table
# ---------------------------------------------------------------------------
def _scored_tables(spark, sf):
    p = posts(spark, sf)
    base = p.select("doc_id", "uri", "source_label", "credibility_label", "post_id", "inserted_at")
    table = base.where(F.col("doc_id") % 3 != 1).select(
        "uri", "source_label", "credibility_label", "post_id",
        F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.col("credibility_label")).alias("predicted_label"),
        F.lit(0.5).alias("credibility_score"),
        F.lit("old").alias("explanation_text"),
        F.lit(False).alias("alert"),
        F.lit("kept").alias("note"),
        "inserted_at",
        F.col("inserted_at").alias("created_at"),
    )
    updates = base.where((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 1)).select(
        "uri", "source_label", "credibility_label", "post_id",
        F.col("credibility_label").alias("predicted_label"),
        F.lit(0.9).alias("credibility_score"),
        F.concat(F.lit("new "), F.col("uri")).alias("explanation_text"),
        F.lit(None).cast("boolean").alias("alert"),
        _now().alias("inserted_at"),
    )
    return table, updates


_SCORED_CTES = O.POSTS_CTES + [
    ("tbl", """
SELECT uri, source_label, credibility_label, post_id,
       CASE WHEN doc_id % 6 = 0 THEN '' ELSE credibility_label END AS predicted_label,
       CAST(0.5 AS DOUBLE) AS credibility_score, 'old' AS explanation_text, FALSE AS alert, 'kept' AS note,
       inserted_at, inserted_at AS created_at
FROM posts WHERE doc_id % 3 <> 1"""),
    ("upd", f"""
SELECT uri, source_label, credibility_label, post_id, credibility_label AS predicted_label,
       CAST(0.9 AS DOUBLE) AS credibility_score, 'new ' || uri AS explanation_text, CAST(NULL AS BOOLEAN) AS alert,
       {NOW_SQL} AS inserted_at
FROM posts WHERE doc_id % 2 = 0 OR doc_id % 3 = 1"""),
]


@register("upsert_posts", O.with_(*_SCORED_CTES, final=f"""
SELECT coalesce(u.uri, t.uri) AS uri,
       CASE WHEN u.post_id IS NOT NULL THEN u.predicted_label ELSE t.predicted_label END AS predicted_label,
       CASE WHEN u.post_id IS NOT NULL THEN u.credibility_score ELSE t.credibility_score END AS credibility_score,
       CASE WHEN u.post_id IS NOT NULL THEN u.explanation_text ELSE t.explanation_text END AS explanation_text,
       CASE WHEN u.post_id IS NOT NULL THEN u.alert ELSE t.alert END AS alert,
       t.note AS note,
       CASE WHEN u.post_id IS NOT NULL THEN u.inserted_at ELSE t.inserted_at END AS inserted_at,
       CASE WHEN t.post_id IS NOT NULL THEN t.created_at ELSE {NOW_SQL} END AS created_at
FROM tbl t FULL OUTER JOIN upd u ON t.post_id = u.post_id"""))
def upsert_posts(spark, sf):
    table, updates = _scored_tables(spark, sf)
    out = St.upsert(table, updates, key="post_id", now=_now())
    return out.select("uri", "predicted_label", "credibility_score", "explanation_text", "alert",
                      "note", "inserted_at", "created_at")


@register("upsert_counts", O.with_(*_SCORED_CTES, final="""
SELECT count(*) FILTER (WHERE t.post_id IS NULL) AS inserted,
       count(*) FILTER (WHERE t.post_id IS NOT NULL) AS matched
FROM upd u LEFT JOIN tbl t ON t.post_id = u.post_id"""))
def upsert_counts(spark, sf):
    table, updates = _scored_tables(spark, sf)
    return St.upsert_counts(table, updates, key="post_id")


@register("update_existing", O.with_(*_SCORED_CTES, final="""
SELECT t.uri,
       CASE WHEN u.post_id IS NOT NULL THEN u.explanation_text ELSE t.explanation_text END AS explanation_text,
       CASE WHEN u.post_id IS NOT NULL THEN u.credibility_score ELSE t.credibility_score END AS credibility_score,
       t.predicted_label, t.note
FROM tbl t LEFT JOIN upd u ON t.post_id = u.post_id"""))
def update_existing(spark, sf):
    table, updates = _scored_tables(spark, sf)
    out = St.update_existing(table, updates.select("post_id", "explanation_text", "credibility_score"))
    return out.select("uri", "explanation_text", "credibility_score", "predicted_label", "note")


@register("vector_insert_absent", O.with_(("old", "SELECT * FROM embeddings WHERE label < 5"), final="""
SELECT vec_id, label, len(embedding) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm
FROM (SELECT * FROM old UNION ALL
      SELECT * FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM old))"""))
def vector_insert_absent(spark, sf):
    e = S.table(spark, sf, "embeddings")
    old = e.where(F.col("label") < 5)
    new = St.insert_absent(old, e, key="vec_id")
    t = old.unionByName(new)
    sq = F.aggregate("embedding", F.lit(0.0),
                     lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return t.select("vec_id", "label", F.size("embedding").alias("dim"), F.round(F.sqrt(sq), 6).alias("norm"))


# ---------------------------------------------------------------------------
# incremental selection
# ---------------------------------------------------------------------------
_DONE_SQL = """
SELECT post_id FROM tbl
WHERE predicted_label IS NOT NULL AND predicted_label <> '' AND explanation_text IS NOT NULL AND explanation_text <> ''"""


@register("incremental_filter", O.with_(*_SCORED_CTES, ("done", _DONE_SQL), final="""
SELECT uri, source_label FROM posts WHERE post_id NOT IN (SELECT post_id FROM done)"""))
def incremental_filter(spark, sf):
    table, _ = _scored_tables(spark, sf)
    return I.select_for_scoring(posts(spark, sf), table).select("uri", "source_label")


INCREMENTAL_TEST_LIMIT = 100


@register("incremental_limit", O.with_(*_SCORED_CTES, ("done", _DONE_SQL), final=f"""
SELECT uri, source_label FROM posts WHERE post_id NOT IN (SELECT post_id FROM done)
ORDER BY source_rank, inserted_at, uri LIMIT {INCREMENTAL_TEST_LIMIT}"""))
def incremental_limit(spark, sf):
    table, _ = _scored_tables(spark, sf)
    return I.select_for_scoring(posts(spark, sf), table, limit=INCREMENTAL_TEST_LIMIT) \
            .select("uri", "source_label")


@register("incremental_estimate", O.with_(*_SCORED_CTES, ("done", _DONE_SQL), final="""
SELECT (SELECT count(*) FROM posts WHERE post_id NOT IN (SELECT post_id FROM done)) AS to_score,
       count(*) AS total FROM posts"""))
def incremental_estimate(spark, sf):
    table, _ = _scored_tables(spark, sf)
    return I.estimate(posts(spark, sf), table)


# ---------------------------------------------------------------------------
# latest-N scans
# ---------------------------------------------------------------------------
LATEST_SOURCES = tuple(f"src{i}" for i in range(10))
LATEST_N = 20


@register("latest_per_source", O.with_(*O.POSTS_CTES, final=f"""
SELECT uri, source_label, inserted_at FROM (
  SELECT *, row_number() OVER (PARTITION BY source_label ORDER BY inserted_at DESC, uri DESC) AS rn
  FROM posts WHERE source_label IN {O.in_list(LATEST_SOURCES)})
WHERE rn <= {LATEST_N}"""))
def latest_per_source(spark, sf):
    out = D.latest_per_source(posts(spark, sf), LATEST_SOURCES, LATEST_N)
    return out.select("uri", "source_label", "inserted_at")


@register("latest_preview", O.with_(*O.ENRICHED_CTES, final=f"""
SELECT clean_text AS "Post text", source_label AS "Source", credibility_label AS "Reference label",
       round(sentiment, 6) AS "Sentiment", dominant_emotion AS "Dominant emotion"
FROM enriched WHERE lang_detected IN ('fr', 'en')
ORDER BY inserted_at DESC, uri DESC LIMIT {DEFAULT.preview_limit}"""))
def latest_preview(spark, sf):
    e = D.dashboard_filter(enriched(spark, sf), ("fr", "en"), None)
    e = e.select("uri", "inserted_at", "clean_text", "source_label", "credibility_label",
                 F.round("sentiment", 6).alias("sentiment"), "dominant_emotion")
    return D.latest_preview(e, DEFAULT.preview_limit)


@register("latest_report", """
SELECT event_id, event_type, date_trunc('day', ts) AS run_ts FROM events e
WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events x WHERE x.event_type = e.event_type)""")
def latest_report(spark, sf):
    rep = S.table(spark, sf, "events").select("event_id", "event_type",
                                             F.date_trunc("day", "ts").alias("run_ts"))
    return R.latest_run(rep, "run_ts", by=("event_type",))


# ---------------------------------------------------------------------------
# metrics text and energy reports
# ---------------------------------------------------------------------------
_METRIC_CTE = ("lines", """
SELECT printf('credlens_event_value_%s{user="%d"} %s', event_type, user_id, printf('%.2f', value)) AS value FROM events
UNION ALL
SELECT printf('api_request_latency_seconds_%s %s', CASE WHEN event_type = 'error' THEN 'count' ELSE 'sum' END,
              CASE WHEN event_type = 'error' THEN '1' ELSE printf('%.2f', value) END) FROM events
UNION ALL
SELECT DISTINCT printf('# HELP credlens_event_value_%s events of type %s', event_type, event_type) FROM events""")


@register("metric_total", O.with_(_METRIC_CTE, final="""
SELECT round(sum(TRY_CAST(string_split(value, ' ')[-1] AS DOUBLE)), 6) AS total FROM lines
WHERE NOT starts_with(value, '#') AND starts_with(value, 'credlens_event_value_click')"""))
def metric_total(spark, sf):
    t = Rp.metric_total(S.metric_text(spark, sf), "credlens_event_value_click")
    return t.select(F.round("total", 6).alias("total"))


@register("metric_avg_latency", O.with_(_METRIC_CTE, ("parts", """
SELECT sum(CASE WHEN starts_with(value, 'api_request_latency_seconds_sum') THEN TRY_CAST(string_split(value, ' ')[-1] AS DOUBLE) END) AS s,
       sum(CASE WHEN starts_with(value, 'api_request_latency_seconds_count') THEN TRY_CAST(string_split(value, ' ')[-1] AS DOUBLE) END) AS c
FROM lines WHERE NOT starts_with(value, '#')"""), final="""
SELECT round(CASE WHEN c <> 0 AND s IS NOT NULL THEN s / c END, 6) AS avg_latency FROM parts"""))
def metric_avg_latency(spark, sf):
    a = Rp.metric_avg_latency(S.metric_text(spark, sf))
    return a.select(F.round("avg_latency", 6).alias("avg_latency"))


_ENERGY_CTE = ("energy", """
SELECT strftime(run_day, '%Y%m%d') AS run_id, CAST(n AS DOUBLE) AS duration,
       round(v / 1000.0, 6) AS emissions, round(v / 1000.0 / n, 9) AS emissions_rate,
       round(mx, 2) AS cpu_power, CAST(0.0 AS DOUBLE) AS gpu_power, round(mx / 2, 2) AS ram_power,
       round(v / 3600.0, 6) AS cpu_energy, CAST(0.0 AS DOUBLE) AS gpu_energy, round(v / 7200.0, 6) AS ram_energy,
       round(v / 3600.0 + v / 7200.0, 6) AS energy_consumed, CAST(32.0 AS DOUBLE) AS ram_total_size, CAST(1.0 AS DOUBLE) AS pue
FROM (SELECT CAST(ts AS DATE) AS run_day, count(*) AS n, sum(value) AS v, max(value) AS mx
      FROM events GROUP BY 1)""")


def _energy_cols_sql():
    return ", ".join(f'{c} AS "{c} ({u})"' for c, u in fixed.ENERGY_UNITS)


@register("energy_tail", O.with_(_ENERGY_CTE, final=f"""
SELECT run_id, {_energy_cols_sql()} FROM energy ORDER BY run_id DESC LIMIT 10"""))
def energy_tail(spark, sf):
    return Rp.energy_tail(S.energy_rows(spark, sf), 10)


@register("energy_latest", O.with_(_ENERGY_CTE, final="""
SELECT run_id, emissions, energy_consumed, duration, emissions_rate FROM energy
WHERE run_id = (SELECT max(run_id) FROM energy)"""))
def energy_latest(spark, sf):
    e = S.energy_rows(spark, sf)
    return R.latest_run(e, "run_id").select("run_id", "emissions", "energy_consumed", "duration",
                                            "emissions_rate")


# ---------------------------------------------------------------------------
# classification metrics on (truth, prediction) pairs
# ---------------------------------------------------------------------------
_PRED_CTE = ("pred", """
SELECT l.doc_id, CASE WHEN quality = 1 THEN 'credible' ELSE 'unverified' END AS y_true,
       CASE WHEN n_chars > 2000 THEN 'credible' ELSE 'unverified' END AS y_pred
FROM labels l JOIN documents d USING (doc_id)""")


@register("confusion_matrix", O.with_(_PRED_CTE, final="""
SELECT y_true, count(*) FILTER (WHERE y_pred = 'credible') AS credible,
       count(*) FILTER (WHERE y_pred = 'unverified') AS unverified
FROM pred GROUP BY 1"""))
def confusion_matrix(spark, sf):
    return M.confusion_matrix(S.predictions(spark, sf), list(fixed.BINARY_CLASS_NAMES))


@register("classification_report", O.with_(_PRED_CTE, ("cls", """
SELECT c AS label,
       (SELECT count(*) FROM pred WHERE y_true = c AND y_pred = c) AS tp,
       (SELECT count(*) FROM pred WHERE y_pred = c) AS npred,
       (SELECT count(*) FROM pred WHERE y_true = c) AS support
FROM (SELECT y_true AS c FROM pred UNION SELECT y_pred FROM pred)"""), ("m", """
SELECT label, CASE WHEN npred > 0 THEN tp * 1.0 / npred ELSE 0.0 END AS precision,
       CASE WHEN support > 0 THEN tp * 1.0 / support ELSE 0.0 END AS recall, support
FROM cls"""), ("m2", """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1_score
FROM m"""), final="""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM m2
UNION ALL
SELECT 'accuracy', NULL, NULL, round((SELECT sum(tp) FROM cls) * 1.0 / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m2
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), CAST(sum(support) AS BIGINT) FROM m2
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1_score * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m2"""))
def classification_report(spark, sf):
    r = M.classification_report(S.predictions(spark, sf))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1_score")], "support")


# ---------------------------------------------------------------------------
# post URLs
# ---------------------------------------------------------------------------
# FIXED VALUES: hand-made post URLs (valid, wrong host, missing post segment)
HAND_URLS = (
    (-1, "https://bsky.app/profile/alice.example/post/3abc"),
    (-2, "https://www.bsky.app/profile/bob.example/post/9xyz?x=1"),
    (-3, "https://example.org/profile/alice.example/post/3abc"),
    (-4, "https://bsky.app/profile/alice.example/feed/3abc"),
    (-5, "https://bsky.app/profile/alice.example"),
)


@register("url_parse", f"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {O.values(HAND_URLS, 'page_id, url')}),
p AS (SELECT page_id, url,
        nullif(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1), '') AS host,
        list_filter(string_split(regexp_extract(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'),
                    lambda s: s <> '') AS parts
      FROM u),
s AS (SELECT *, CASE WHEN NOT coalesce(host IN {O.in_list(fixed.POST_HOSTS)}, FALSE) OR len(parts) < 4 THEN 'bad_host_or_path'
                     WHEN parts[1] <> 'profile' OR parts[3] <> 'post' THEN 'not_a_post_url' ELSE 'ok' END AS url_status
      FROM p)
SELECT page_id, host, CASE WHEN url_status = 'ok' THEN parts[2] END AS handle,
       CASE WHEN url_status = 'ok' THEN parts[4] END AS post_id_part, url_status
FROM s""")
def url_parse(spark, sf):
    pages = S.table(spark, sf, "pages").select("page_id", "url")
    hand = spark.createDataFrame(list(HAND_URLS), "page_id long, url string")
    p = D.parse_post_url(pages.unionByName(hand))
    return p.select("page_id", "host", "handle", "post_id_part", "url_status")


# pages as post URLs of handles; every third handle has no DID, every fifth post is not stored
_LOOKUP_CTES = [("links", """
SELECT page_id, 'h' || CAST(page_id % 7 AS VARCHAR) AS handle, CAST(page_id AS VARCHAR) AS post_id_part,
       'https://' || CASE WHEN page_id % 11 = 0 THEN 'example.org' ELSE 'bsky.app' END || '/profile/h'
         || CAST(page_id % 7 AS VARCHAR) || '/post/' || CAST(page_id AS VARCHAR) AS url FROM pages"""),
    ("stored", """
SELECT 'at://did:h' || CAST(page_id % 7 AS VARCHAR) || '/app.bsky.feed.post/' || CAST(page_id AS VARCHAR) AS uri,
       CASE WHEN page_id % 13 = 0 THEN '  ' ELSE ' ' || url || ' ' END AS text FROM pages WHERE page_id % 5 <> 0""")]


@register("post_lookup", O.with_(*_LOOKUP_CTES, final="""
SELECT page_id, CASE WHEN page_id % 11 <> 0 AND page_id % 7 % 3 <> 0 THEN 'at://did:' || handle || '/app.bsky.feed.post/' || post_id_part END AS record_uri,
       trim(s.text) AS post_text,
       CASE WHEN page_id % 11 = 0 THEN 'bad_host_or_path' WHEN coalesce(trim(s.text), '') = '' THEN 'no_text' ELSE 'ok' END AS url_status
FROM links l LEFT JOIN stored s ON page_id % 11 <> 0 AND page_id % 7 % 3 <> 0
  AND s.uri = 'at://did:' || handle || '/app.bsky.feed.post/' || post_id_part"""))
def post_lookup(spark, sf):
    """Post URL -> handle -> DID -> record -> text."""
    pages = S.table(spark, sf, "pages")
    handle = F.concat(F.lit("h"), (F.col("page_id") % 7).cast("string"))
    host = F.when(F.col("page_id") % 11 == 0, "example.org").otherwise("bsky.app")
    links = pages.select("page_id", F.concat(F.lit("https://"), host, F.lit("/profile/"), handle, F.lit("/post/"),
                                             F.col("page_id").cast("string")).alias("url"))
    handles = pages.select(handle.alias("handle")).distinct().where(F.substring("handle", 2, 9).cast("int") % 3 != 0) \
                   .withColumn("did", F.concat(F.lit("did:"), F.col("handle")))
    stored = pages.where(F.col("page_id") % 5 != 0).select(
        F.concat(F.lit("at://did:"), handle, F.lit("/app.bsky.feed.post/"), F.col("page_id").cast("string")).alias("uri"),
        F.when(F.col("page_id") % 13 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("url"), F.lit(" "))).alias("text"))
    return D.resolve_posts(D.parse_post_url(links), handles, stored).select("page_id", "record_uri", "post_text", "url_status")
