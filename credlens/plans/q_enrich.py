"""Queries: language, tokens, sentiment, emotions, their reports and drift,
dashboard aggregates and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, rules
from ..operators import lexicon as L
from ..operators import dashboard as D
from ..operators import hooks as H
from ..operators import reports as Rp
from ..session import materialize
from ..sources import standins as S
from . import oracle as O
from .catalog import register
from .q_prepare import posts

EN = O.ENRICHED_CTES


def enriched(spark, sf):
    return L.enrich_posts(posts(spark, sf))


def r6(c):
    return F.round(c, 6)


@register("language", O.with_(*O.POSTS_CTES, *[
    (n, b.replace("WHERE len(langs) = 0 OR langs IS NULL", "")) if n == "need_words" else (n, b)
    for n, b in O.LANG_CTES], final="""
SELECT p.uri, coalesce(g.guess, 'en') AS lang_detected, p.lang AS lang_declared
FROM posts p LEFT JOIN lang_guess g USING (post_id)"""))
def language(spark, sf):
    """Language guessed from the text alone (declared languages ignored)."""
    p = posts(spark, sf)
    undeclared = p.withColumn("lang_declared", F.get("langs", 0)) \
                  .withColumn("langs", F.array().cast("array<string>"))
    return L.with_language(undeclared).select("uri", "lang_detected", "lang_declared")


@register("tokens", O.with_(*EN, final="""
SELECT uri, array_to_string(tokens, ' ') AS tokens_text, len(tokens) AS n_tokens FROM enriched"""))
def tokens(spark, sf):
    e = enriched(spark, sf)
    return e.select("uri", F.array_join("tokens", " ").alias("tokens_text"),
                    F.size("tokens").alias("n_tokens"))


# hand-made words (lang2, word) and their lemmas, written out
HAND_LEMMAS = (("en", "cats", "cat"), ("en", "cities", "city"), ("en", "boxes", "box"), ("en", "wishes", "wish"),
               ("en", "classes", "class"), ("en", "class", "class"), ("en", "virus", "virus"), ("en", "crisis", "crisis"),
               ("en", "bus", "bus"), ("en", "ties", "tie"), ("en", "children", "child"), ("en", "was", "be"),
               ("en", "post", "post"), ("fr", "journaux", "journal"), ("fr", "bateaux", "bateau"), ("fr", "chats", "chat"),
               ("fr", "actives", "actif"), ("fr", "heureuse", "heureux"), ("fr", "actrices", "acteur"),
               ("fr", "officielle", "officiel"), ("fr", "italienne", "italien"), ("fr", "pays", "pays"),
               ("fr", "palais", "palais"), ("fr", "sont", "etre"), ("fr", "yeux", "oeil"), ("fr", "mot", "mot"))


@register("lemmas", O.with_(*EN, ("known", "SELECT DISTINCT lang2, w, lemma FROM wj"), final=f"""
SELECT lang2, w, coalesce(lemma, {O.suffix_lemma('lang2', 'w')}) AS lemma FROM known
UNION ALL SELECT lang2, w, lemma FROM {O.values(HAND_LEMMAS, 'lang2, w, lemma')}"""))
def lemmas(spark, sf):
    """The lemma of every distinct word of the posts, and of the hand-made words."""
    p = L.with_language(posts(spark, sf))
    words = L.word_table(p).select("lang2", "w").distinct()
    hand = spark.createDataFrame([r[:2] for r in HAND_LEMMAS], "lang2 string, w string")
    return L.with_lemma(words.unionByName(hand)).select("lang2", "w", "lemma")


@register("sentiment", O.with_(*EN, final="""
SELECT uri, lang_detected, round(sentiment, 6) AS sentiment FROM enriched"""))
def sentiment(spark, sf):
    return enriched(spark, sf).select("uri", "lang_detected", r6(F.col("sentiment")).alias("sentiment"))


@register("emotion_scores", O.with_(*EN, final="""
SELECT p.uri, s.emotion, round(s.score, 6) AS score
FROM emo_scores s JOIN posts p USING (post_id)"""))
def emotion_scores(spark, sf):
    e = enriched(spark, sf)
    return e.select("uri", F.explode("emotion_scores").alias("emotion", "score")) \
            .select("uri", "emotion", r6(F.col("score")).alias("score"))


@register("emotion_ranked", O.with_(*EN, final="""
SELECT p.uri, row_number() OVER (PARTITION BY s.post_id ORDER BY s.score DESC, s.rank) AS position,
       s.emotion, round(s.score, 6) AS score
FROM emo_scores s JOIN posts p USING (post_id) WHERE s.score > 0"""))
def emotion_ranked(spark, sf):
    e = enriched(spark, sf)
    return D.emotion_ranked(e).select("uri", "position", "emotion", r6(F.col("score")).alias("score"))


@register("dominant_emotion", O.with_(*EN, final="""
SELECT uri, dominant_emotion FROM enriched"""))
def dominant_emotion(spark, sf):
    return enriched(spark, sf).select("uri", "dominant_emotion")


# hand-made posts for the scorer hook: one is scored, two hold more words than
# the scorer takes, one has no text; the last two meet a scorer that is not there
HAND_SCORED = (("hand/s1", "good hope", True), ("hand/s2", "one two three four five six", True),
               ("hand/s3", "bad fear bad fear bad fear bad", True), ("hand/s4", "", True),
               ("hand/s5", "good hope", False), ("hand/s6", "", False))
SCORER_WORDS = 5
STATUS_CTES = [("hand", f"""
SELECT CASE WHEN clean_text = '' THEN {O.q(fixed.EMOTION_NO_TEXT)} WHEN NOT there THEN {O.q(fixed.EMOTION_UNAVAILABLE)}
            WHEN len(string_split(clean_text, ' ')) > {SCORER_WORDS} THEN {O.q(fixed.EMOTION_FAILED)}
            ELSE {O.q(fixed.EMOTION_OK)} END AS emotion_status
FROM {O.values(HAND_SCORED, 'uri, clean_text, there')}"""),
    ("every", "SELECT emotion_status FROM enriched UNION ALL SELECT emotion_status FROM hand")]
FAILURES = f"emotion_status IN {O.in_list(fixed.EMOTION_FAILURES)}"


def _limited_scorer(texts):
    """Shares of the lexicon's emotion words; takes ``SCORER_WORDS`` words."""
    out = []
    for t in texts:
        ws = t.split(" ")
        if len(ws) > SCORER_WORDS:
            raise ValueError("text too long")
        hits = [e for w in ws for e in fixed.EMOTION_TERMS.get(w, ())]
        out.append({e: hits.count(e) / len(hits) for e in hits})
    return out


def _statuses(spark, sf):
    """Every post by the lexicon, and the hand-made posts through the hook."""
    hand = spark.createDataFrame(list(HAND_SCORED), "uri string, clean_text string, there boolean") \
        .withColumn("langs", F.array(F.lit("en"))).withColumn("post_id", F.col("uri"))
    hand = L.enrich_posts(hand)
    hooked = H.with_scorer_emotions(hand.where("there"), _limited_scorer, on_failure="empty").unionByName(
        H.with_scorer_emotions(hand.where(~F.col("there")), None, on_failure="empty"))
    return enriched(spark, sf).select("uri", "emotion_status").unionByName(hooked.select("uri", "emotion_status"))


@register("emotion_status_counts", O.with_(*EN, *STATUS_CTES, final=f"""
SELECT emotion_status, count(*) AS n_posts, count(*) FILTER (WHERE {FAILURES}) AS failures
FROM every GROUP BY 1"""))
def emotion_status_counts(spark, sf):
    return _statuses(spark, sf).groupBy("emotion_status").agg(
        F.count("*").alias("n_posts"), F.count_if(F.col("emotion_status").isin(*fixed.EMOTION_FAILURES)).alias("failures"))


@register("emotion_run_summary", O.with_(*EN, *STATUS_CTES, final=f"""
SELECT count(*) AS n_posts, count(*) FILTER (WHERE emotion_status = {O.q(fixed.EMOTION_OK)}) AS ok,
       count(*) FILTER (WHERE emotion_status = {O.q(fixed.EMOTION_NO_TEXT)}) AS missing_text,
       count(*) FILTER (WHERE emotion_status = {O.q(fixed.EMOTION_UNAVAILABLE)}) AS unavailable,
       count(*) FILTER (WHERE emotion_status = {O.q(fixed.EMOTION_FAILED)}) AS failed,
       count(*) FILTER (WHERE {FAILURES}) AS failures
FROM every"""))
def emotion_run_summary(spark, sf):
    """The counts of a run, observed while its rows are checkpointed."""
    return H.checkpoint_with_counts(_statuses(spark, sf))[1]


@register("sentiment_summary", O.with_(*EN, final="""
SELECT source_label, round(avg(sentiment), 6) AS mean, round(stddev_samp(sentiment), 6) AS std,
       count(sentiment) AS n_posts
FROM enriched GROUP BY 1"""))
def sentiment_summary(spark, sf):
    s = Rp.sentiment_summary(enriched(spark, sf))
    return s.select("source_label", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), "n_posts")


_EMO_COLS = (*fixed.EMOTIONS, "unknown")


# hand-made rows: emotions outside the list (another scorer's, none)
HAND_EMOTIONS = (("hand", "calm"), ("hand", None), ("hand", "joy"), (None, "calm"))


@register("emotion_summary", O.with_(*EN, ("every", f"""
SELECT source_label, dominant_emotion FROM enriched UNION ALL
SELECT * FROM {O.values(HAND_EMOTIONS, 'source_label, dominant_emotion')}"""), final="SELECT source_label, " + ", ".join(
    f"count(*) FILTER (WHERE dominant_emotion = {O.q(e)}) AS {e}" for e in _EMO_COLS)
    + f", count(*) FILTER (WHERE coalesce(dominant_emotion, 'none') NOT IN {O.in_list(_EMO_COLS)}) AS other"
    + " FROM every GROUP BY 1"))
def emotion_summary(spark, sf):
    hand = spark.createDataFrame(list(HAND_EMOTIONS), "source_label string, dominant_emotion string")
    e = enriched(spark, sf).select("source_label", "dominant_emotion").unionByName(hand)
    return Rp.emotion_summary(e, emotions=_EMO_COLS)


@register("label_distribution", O.with_(*EN, final="""
SELECT source_label AS key, round(count(*) * 1.0 / (SELECT count(*) FROM enriched WHERE source_label IS NOT NULL), 6) AS share
FROM enriched WHERE source_label IS NOT NULL GROUP BY 1"""))
def label_distribution(spark, sf):
    d = Rp.distribution(enriched(spark, sf), "source_label")
    return d.select("key", r6(F.col("share")).alias("share"))


@register("language_distribution", O.with_(*EN, final="""
SELECT lang_detected AS key, round(count(*) * 1.0 / (SELECT count(*) FROM enriched WHERE lang_detected IS NOT NULL), 6) AS share
FROM enriched WHERE lang_detected IS NOT NULL GROUP BY 1"""))
def language_distribution(spark, sf):
    d = Rp.distribution(enriched(spark, sf), "lang_detected")
    return d.select("key", r6(F.col("share")).alias("share"))


def _js_sql(col: str, name: str) -> list[tuple[str, str]]:
    half = "(SELECT count(*) FROM documents) / 2"
    return [
        (f"{name}_cur", f"SELECT {col} AS key, count(*) * 1.0 / sum(count(*)) OVER () AS share "
                        f"FROM enriched WHERE doc_id >= {half} AND {col} IS NOT NULL GROUP BY 1"),
        (f"{name}_prev", f"SELECT {col} AS key, count(*) * 1.0 / sum(count(*)) OVER () AS share "
                         f"FROM enriched WHERE doc_id < {half} AND {col} IS NOT NULL GROUP BY 1"),
        (f"{name}_j", f"SELECT coalesce(c.key, p.key) AS key, coalesce(c.share, 0.0) AS p, "
                      f"coalesce(p.share, 0.0) AS q FROM {name}_cur c FULL OUTER JOIN {name}_prev p ON c.key = p.key"),
        (f"{name}_n", f"SELECT p / (SELECT sum(p) FROM {name}_j) AS pn, q / (SELECT sum(q) FROM {name}_j) AS qn "
                      f"FROM {name}_j"),
        (f"{name}_js", f"SELECT CASE WHEN (SELECT count(*) FROM {name}_j) > 0 "
                       f"AND (SELECT sum(p) FROM {name}_j) > 0 AND (SELECT sum(q) FROM {name}_j) > 0 THEN "
                       f"sqrt(greatest(0.0, sum(CASE WHEN pn > 0 THEN pn * ln(pn / ((pn + qn) / 2)) ELSE 0.0 END "
                       f"+ CASE WHEN qn > 0 THEN qn * ln(qn / ((pn + qn) / 2)) ELSE 0.0 END) / 2)) END AS d "
                       f"FROM {name}_n"),
    ]


def _half(spark, sf):
    return S.table(spark, sf, "documents").agg((F.count("*") / 2).alias("h")).scalar()


def _paired(spark, sf):
    """(key, p, q) counts of labels and of languages, current half vs
    previous half, from one scan; both are tiny and are checkpointed once
    because several subqueries read them."""
    e = enriched(spark, sf)
    cur = F.col("doc_id") >= _half(spark, sf)
    both = e.select(F.col("source_label"), F.col("lang_detected"), cur.alias("_cur"))
    lab = Rp.paired_counts(both, "source_label", F.col("_cur"))
    lng = Rp.paired_counts(both, "lang_detected", F.col("_cur"))
    return materialize(lab), materialize(lng)


@register("drift_js", O.with_(*EN, *_js_sql("source_label", "lab"), *_js_sql("lang_detected", "lng"), final="""
SELECT round((SELECT d FROM lab_js), 6) AS label_js_distance, round((SELECT d FROM lng_js), 6) AS language_js_distance"""))
def drift_js(spark, sf):
    lab_pq, lng_pq = _paired(spark, sf)
    lab = Rp.js_distance_pq(lab_pq)
    lng = Rp.js_distance_pq(lng_pq)
    return lab.select(r6(F.col("js_distance")).alias("label_js_distance"),
                      r6(lng.scalar()).alias("language_js_distance"))


def _dist_text_sql(col: str) -> str:
    return (f"(SELECT string_agg(key || '=' || printf('%.6f', share), ',' ORDER BY key) FROM ("
            f"SELECT {col} AS key, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM enriched "
            f"WHERE doc_id >= (SELECT count(*) FROM documents) / 2 AND {col} IS NOT NULL GROUP BY 1))")


@register("drift_report", O.with_(*EN, *_js_sql("source_label", "lab"), *_js_sql("lang_detected", "lng"), final=f"""
SELECT round((SELECT d FROM lab_js), 6) AS label_js_distance,
       round((SELECT d FROM lng_js), 6) AS language_js_distance,
       {_dist_text_sql('source_label')} AS current_label_distribution,
       {_dist_text_sql('lang_detected')} AS current_language_distribution"""))
def drift_report(spark, sf):
    return D.drift_report(*_paired(spark, sf))


@register("sentiment_by_source", O.with_(*EN, final="""
SELECT source_label, round(avg(sentiment), 6) AS mean_sentiment FROM enriched
WHERE source_label IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1"""))
def sentiment_by_source(spark, sf):
    s = Rp.sentiment_by(enriched(spark, sf), "source_label")
    return s.select("source_label", r6(F.col("mean_sentiment")).alias("mean_sentiment"))


@register("sentiment_by_lang", O.with_(*EN, final="""
SELECT lang_detected, round(avg(sentiment), 6) AS mean_sentiment FROM enriched
WHERE lang_detected IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1"""))
def sentiment_by_lang(spark, sf):
    s = Rp.sentiment_by(enriched(spark, sf), "lang_detected")
    return s.select("lang_detected", r6(F.col("mean_sentiment")).alias("mean_sentiment"))


@register("emotion_distribution", O.with_(*EN, final="""
SELECT coalesce(dominant_emotion, 'unknown') AS emotion, count(*) AS posts FROM enriched GROUP BY 1"""))
def emotion_distribution(spark, sf):
    return Rp.emotion_distribution(enriched(spark, sf))


_DASH_LANGS = ("fr", "en")
_DASH_EMOTIONS = (*fixed.EMOTIONS, "unknown")


@register("dashboard_filter", O.with_(*EN, final=f"""
SELECT uri, lang_detected, dominant_emotion FROM enriched
WHERE lang_detected IN {O.in_list(_DASH_LANGS)} AND dominant_emotion IN {O.in_list(_DASH_EMOTIONS)}"""))
def dashboard_filter(spark, sf):
    f = D.dashboard_filter(enriched(spark, sf), _DASH_LANGS, _DASH_EMOTIONS)
    return f.select("uri", "lang_detected", "dominant_emotion")


@register("dashboard_kpis", O.with_(*EN, final=f"""
SELECT count(*) AS posts, round(avg(sentiment), 3) AS avg_sentiment, count(DISTINCT source_label) AS labels
FROM enriched WHERE lang_detected IN {O.in_list(_DASH_LANGS)} AND dominant_emotion IN {O.in_list(_DASH_EMOTIONS)}"""))
def dashboard_kpis(spark, sf):
    f = D.dashboard_filter(enriched(spark, sf), _DASH_LANGS, _DASH_EMOTIONS)
    return Rp.kpis(f)


_HAND_SENT_SQL = O.values([("hand/b1", -0.2), ("hand/b2", 0.2), ("hand/b3", -0.5),
                           ("hand/b4", 0.19), ("hand/b5", 0.75)], "uri, sentiment")


@register("sentiment_band", O.with_(*EN, final=f"""
SELECT uri, round(sentiment, 6) AS sentiment,
       CASE WHEN sentiment <= -0.2 THEN 'Negative' WHEN sentiment >= 0.2 THEN 'Positive' ELSE 'Neutral' END AS band
FROM (SELECT uri, sentiment FROM enriched UNION ALL SELECT uri, sentiment FROM {_HAND_SENT_SQL})"""))
def sentiment_band(spark, sf):
    e = enriched(spark, sf).select("uri", "sentiment")
    hand = spark.createDataFrame([("hand/b1", -0.2), ("hand/b2", 0.2), ("hand/b3", -0.5),
                                  ("hand/b4", 0.19), ("hand/b5", 0.75)], "uri string, sentiment double")
    u = e.unionByName(hand)
    return u.select("uri", r6(F.col("sentiment")).alias("sentiment"),
                    rules.sentiment_band("sentiment").alias("band"))


@register("emotion_category", O.with_(*EN, final=f"""
SELECT uri, dominant_emotion,
       CASE WHEN lower(dominant_emotion) IN {O.in_list(fixed.POSITIVE_EMOTIONS)} THEN 'positive'
            WHEN lower(dominant_emotion) IN {O.in_list(fixed.NEGATIVE_EMOTIONS)} THEN 'negative'
            ELSE 'neutral' END AS category
FROM enriched"""))
def emotion_category(spark, sf):
    e = enriched(spark, sf)
    return e.select("uri", "dominant_emotion", rules.emotion_category("dominant_emotion").alias("category"))
