"""Queries: terms, TF-IDF, fixed-coefficient scoring and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import fixed, rules
from ..operators import explain as X
from ..operators import features as Ft
from ..operators import lexicon as L
from ..operators import models as Md
from ..operators import dashboard as D
from ..session import materialize
from . import oracle as O
from .catalog import register
from .q_prepare import posts, stored_posts

STOP = Ft.stopword_list()
CLASSES = fixed.BINARY_CLASS_NAMES
TOP_N = DEFAULT.explain_top_n
MAXF = DEFAULT.max_features
MIN_DF = DEFAULT.min_df


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------------------
# SQL fragments
# ---------------------------------------------------------------------------
def tfidf_ctes(src: str = "posts", fit_src: str | None = None) -> list[tuple[str, str]]:
    """terms -> tf -> df -> vocabulary -> weights, over ``src``; the
    vocabulary is fitted on ``fit_src`` (default: the same rows)."""
    fit_src = fit_src or src
    stop = O.str_list(STOP)

    def terms(name, s):
        return [
            (f"{name}_uni", f"""
SELECT post_id, list_filter(list_filter({O.words('clean_text')}, lambda w: length(w) >= 2),
                            lambda w: NOT list_contains({stop}, w)) AS u
FROM {s}"""),
            (f"{name}_terms", f"""
SELECT post_id, u || list_transform(range(1, len(u)), lambda i: u[i] || ' ' || u[i + 1]) AS terms
FROM {name}_uni"""),
            (f"{name}_tf", f"""
SELECT post_id, term, count(*) AS tf FROM (SELECT post_id, unnest(terms) AS term FROM {name}_terms)
GROUP BY 1, 2"""),
        ]

    ctes = terms("fit", fit_src)
    ctes += [
        ("dfs", "SELECT term, count(*) AS df, sum(tf) AS cf FROM fit_tf GROUP BY 1"),
        ("vocab", f"""
SELECT term, df, CAST(cf AS BIGINT) AS cf,
       ln((1.0 + (SELECT count(*) FROM {fit_src})) / (1.0 + df)) + 1.0 AS idf
FROM dfs WHERE df >= {MIN_DF} ORDER BY cf DESC, term LIMIT {MAXF}"""),
    ]
    if src != fit_src:
        ctes += terms("use", src)
        tf = "use_tf"
    else:
        tf = "fit_tf"
    ctes += [
        ("wt", f"SELECT post_id, term, tf * idf AS w FROM {tf} JOIN vocab USING (term)"),
        ("weights", "SELECT post_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY post_id)) AS weight FROM wt"),
    ]
    return ctes


COEF_CTE = ("coef", """
SELECT term, c1 AS c FROM (
  SELECT term, ((CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 2001) - 1000) / CAST(1000 AS DOUBLE) AS c1
  FROM vocab)""")

SCORE_CTES = [
    COEF_CTE,
    ("marg", """
SELECT p.post_id, coalesce(sum(c.c * w.weight), 0.0) AS margin
FROM posts p LEFT JOIN weights w ON p.post_id = w.post_id LEFT JOIN coef c ON w.term = c.term
GROUP BY p.post_id"""),
    ("prob", "SELECT post_id, margin, 1.0 / (1.0 + exp(-margin)) AS p1 FROM marg"),
    ("pred", f"""
SELECT post_id, margin, 1.0 - p1 AS p0, p1, CASE WHEN 1.0 - p1 >= p1 THEN 0 ELSE 1 END AS pred_idx,
       greatest(1.0 - p1, p1) AS score
FROM prob"""),
    ("contrib", f"""
SELECT w.post_id, w.term, (CASE WHEN p.pred_idx = 0 THEN -c.c ELSE c.c END) * w.weight AS contribution
FROM weights w JOIN pred p USING (post_id) JOIN coef c USING (term)"""),
    ("ranked", f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY round(contribution, 12) DESC, term) AS rank FROM contrib)
WHERE rank <= {TOP_N} AND contribution > 0"""),
    ("terms_arr", "SELECT post_id, list(term ORDER BY rank) AS explanation_terms FROM ranked GROUP BY 1"),
    ("scored", f"""
SELECT p.*, {O.str_list(CLASSES)}[d.pred_idx + 1] AS predicted_label, d.score AS credibility_score,
       d.score < {DEFAULT.alert_threshold} AS alert, d.p0, d.p1, d.margin,
       coalesce(t.explanation_terms, []::VARCHAR[]) AS explanation_terms
FROM posts p JOIN pred d USING (post_id) LEFT JOIN terms_arr t USING (post_id)"""),
]

FEATURE_CTES = O.POSTS_CTES + tfidf_ctes()


def _terms_text_sql(terms: str, n: int) -> str:
    return (f"CASE WHEN len({terms}) > 0 THEN array_to_string({terms}[1:{n}], ', ') ELSE 'none' END")


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
def _fit(spark, sf, key="post_id"):
    p = stored_posts(spark, sf)
    vocab, words = Ft.fit_tfidf(p, key)
    # at most max_features rows
    return p, materialize(vocab), words


def fixed_coef(vocab):
    return X.fixed_coefficients(vocab).where(F.col("class_idx") == 1).select("term", "coef")


def fixed_scored(spark, sf, base=None, vocab=None, known=None):
    """Posts scored by the fixed-coefficient model, with explanations
    (vocabulary fitted on the posts unless given; ``known``: its terms, collected)."""
    p = base if base is not None else stored_posts(spark, sf)
    if vocab is None:
        vocab = materialize(Ft.fit_tfidf(p)[0])
    return X.score_binary(p, vocab, fixed_coef(vocab), 0.0, CLASSES, top_n=TOP_N, known=known)


@register("ngrams", O.with_(*O.POSTS_CTES, *tfidf_ctes()[:2], final=f"""
SELECT p.uri, len(u.u) AS n_unigrams, greatest(len(u.u) - 1, 0) AS n_bigrams,
       array_to_string(t.terms, '|') AS terms
FROM posts p JOIN fit_uni u USING (post_id) JOIN fit_terms t USING (post_id)"""))
def ngrams(spark, sf):
    p = posts(spark, sf)
    t = Ft.with_terms(p.select("uri", "clean_text"))
    # k unigrams give k - 1 bigrams, so k = (size + 1) / 2
    n = F.size("terms")
    t = t.withColumn("n_unigrams", F.when(n > 0, ((n + 1) / 2).cast("int")).otherwise(F.lit(0)))
    return t.select("uri", "n_unigrams", F.greatest(F.col("n_unigrams") - 1, F.lit(0)).alias("n_bigrams"),
                    F.array_join("terms", "|").alias("terms"))


@register("term_df", O.with_(*O.POSTS_CTES, *tfidf_ctes()[:3], final="""
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM fit_tf GROUP BY 1"""))
def term_df(spark, sf):
    p = posts(spark, sf)
    return Ft.document_frequency(Ft.post_words(p)).select("term", "df", "cf")


@register("tfidf_vocab", O.with_(*FEATURE_CTES, final="""
SELECT term, df, cf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx FROM vocab"""))
def tfidf_vocab(spark, sf):
    _, vocab, _ = _fit(spark, sf)
    return Ft.vocabulary_table(spark, Ft.index_vocabulary(vocab)).join(
        vocab.select("term", "df", F.col("cf").cast("long").alias("cf")), "term").select("term", "df", "cf", "idx")


@register("tfidf_idf", O.with_(*FEATURE_CTES, final="SELECT term, round(idf, 6) AS idf FROM vocab"))
def tfidf_idf(spark, sf):
    _, vocab, _ = _fit(spark, sf)
    return vocab.select("term", r6(F.col("idf")).alias("idf"))


@register("tfidf_weights", O.with_(*FEATURE_CTES, final="""
SELECT p.uri, w.term, round(w.weight, 6) AS weight FROM weights w JOIN posts p USING (post_id)"""))
def tfidf_weights(spark, sf):
    _, vocab, words = _fit(spark, sf, "uri")
    w = Ft.tfidf_weights(words, vocab, "uri")
    return w.select("uri", "term", r6(F.col("weight")).alias("weight"))


_HALF = "(SELECT count(*) FROM documents) / 2"


@register("tfidf_transform_new", O.with_(
    *O.POSTS_CTES,
    ("train", f"SELECT * FROM posts WHERE doc_id < {_HALF}"),
    ("newp", f"SELECT * FROM posts WHERE doc_id >= {_HALF}"),
    *tfidf_ctes(src="newp", fit_src="train"), final="""
SELECT p.uri, w.term, round(w.weight, 6) AS weight FROM weights w JOIN newp p USING (post_id)"""))
def tfidf_transform_new(spark, sf):
    """Fit on the older half of the posts, transform the newer half with
    the saved vocabulary (terms outside it are dropped)."""
    from ..sources import standins as S
    p = stored_posts(spark, sf)
    half = S.table(spark, sf, "documents").agg((F.count("*") / 2).alias("h")).scalar()
    train, new = p.where(F.col("doc_id") < half), p.where(F.col("doc_id") >= half)
    vocab, _ = Ft.fit_tfidf(train)
    w = Ft.tfidf_weights(Ft.post_words(new, "uri"), vocab, "uri")
    return w.select("uri", "term", r6(F.col("weight")).alias("weight"))


@register("split_hash", O.with_(*O.POSTS_CTES, final=f"""
SELECT uri, CAST({O.hash_bucket('clean_text', 5)} AS INTEGER) AS bucket,
       {O.hash_bucket('clean_text', 5)} < 1 AS is_test FROM posts"""))
def split_hash(spark, sf):
    s = Md.with_split(posts(spark, sf), "clean_text", 5, 1)
    return s.select("uri", F.col("_bucket").alias("bucket"), "is_test")


@register("score_and_explain", O.with_(*FEATURE_CTES, *SCORE_CTES, final=f"""
SELECT uri, predicted_label, round(credibility_score, 6) AS credibility_score, alert,
       array_to_string(explanation_terms, ', ') AS explanation_terms
FROM scored"""))
def score_and_explain(spark, sf):
    s = fixed_scored(spark, sf)
    return s.select("uri", "predicted_label", r6(F.col("credibility_score")).alias("credibility_score"),
                    "alert", F.array_join("explanation_terms", ", ").alias("explanation_terms"))


@register("explain_terms", O.with_(*FEATURE_CTES, *SCORE_CTES, final="""
SELECT p.uri, r.rank, r.term, round(r.contribution, 6) AS contribution
FROM ranked r JOIN posts p USING (post_id)"""))
def explain_terms(spark, sf):
    s = fixed_scored(spark, sf)
    t = s.select("uri", F.posexplode("explanation_contrib").alias("_r", "_e"))
    return t.select("uri", (F.col("_r") + 1).cast("long").alias("rank"), F.col("_e.term").alias("term"),
                    r6(F.col("_e.contribution")).alias("contribution"))


@register("class_top_terms", O.with_(*FEATURE_CTES, COEF_CTE, final=f"""
SELECT class, rank, term FROM (
  SELECT 'credible' AS class, term, row_number() OVER (ORDER BY -c DESC, term) AS rank FROM coef
  UNION ALL
  SELECT 'unverified' AS class, term, row_number() OVER (ORDER BY c DESC, term) AS rank FROM coef)
WHERE rank <= {TOP_N}"""))
def class_top_terms(spark, sf):
    _, vocab, _ = _fit(spark, sf)
    t = X.class_top_terms(X.fixed_coefficients(vocab), CLASSES, TOP_N)
    return t.select("class", F.col("rank").cast("long").alias("rank"), "term")


@register("decision_rules", O.with_(*FEATURE_CTES, *SCORE_CTES, final="""
SELECT uri, predicted_label, alert,
       CASE WHEN alert THEN 'Review' WHEN predicted_label = 'credible' THEN 'Pass' ELSE 'Reject' END AS decision
FROM scored"""))
def decision_rules(spark, sf):
    s = fixed_scored(spark, sf)
    return s.select("uri", "predicted_label", "alert", rules.decision("predicted_label", "alert").alias("decision"))


@register("label_probabilities", O.with_(*FEATURE_CTES, *SCORE_CTES, final="""
SELECT uri, 0 AS class_index, 'credible' AS label, round(p0, 6) AS probability FROM scored
UNION ALL
SELECT uri, 1, 'unverified', round(p1, 6) FROM scored"""))
def label_probabilities(spark, sf):
    s = fixed_scored(spark, sf)
    lp = D.label_probabilities(s)
    return lp.select("uri", "class_index", "label", r6(F.col("probability")).alias("probability"))


def _enriched_scored(spark, sf):
    p = stored_posts(spark, sf)
    return fixed_scored(spark, sf, base=L.enrich_posts(p), vocab=materialize(Ft.fit_tfidf(p)[0]))


_EXPL_CTES = O.ENRICHED_CTES + tfidf_ctes() + SCORE_CTES


@register("explanation_text", O.with_(*_EXPL_CTES, final=f"""
SELECT s.uri, 'This post is classified as ''' || s.predicted_label || ''' with a credibility score of '
       || {O.score_text('s.credibility_score')} || '. Dominant emotion: ' || e.dominant_emotion
       || '. Key terms: ' || {_terms_text_sql('s.explanation_terms', DEFAULT.terms_in_text)} || '.' AS explanation_text
FROM scored s JOIN enriched e USING (post_id)"""))
def explanation_text(spark, sf):
    s = _enriched_scored(spark, sf)
    return s.select("uri", "explanation_text")


@register("explanation_text_user", O.with_(*_EXPL_CTES, final=f"""
SELECT s.uri, 'This post is classified as ''' || s.predicted_label || ''' with a credibility score of '
       || {O.score_text('s.credibility_score')} || '. Dominant emotion detected: ' || e.dominant_emotion || '. '
       || CASE WHEN len(s.explanation_terms) > 0
               THEN 'Key terms influencing the score: ' || array_to_string(s.explanation_terms[1:{DEFAULT.terms_in_text}], ', ') || '.'
               ELSE 'No strong keyword explanation was available.' END AS explanation_text
FROM scored s JOIN enriched e USING (post_id)"""))
def explanation_text_user(spark, sf):
    s = _enriched_scored(spark, sf)
    return s.select("uri", rules.user_explanation_text(
        "predicted_label", "credibility_score", "dominant_emotion", "explanation_terms",
        DEFAULT.terms_in_text).alias("explanation_text"))


# FIXED VALUES of the stand-in Platt parameters
PLATT_A, PLATT_B = 1.5, -0.2


@register("platt_apply", O.with_(*FEATURE_CTES, *SCORE_CTES, final=f"""
SELECT uri, round(1.0 / (1.0 + exp(-({PLATT_A} * margin + ({PLATT_B})))), 6) AS p_calibrated FROM scored"""))
def platt_apply(spark, sf):
    s = fixed_scored(spark, sf)
    m = F.get(F.col("margins"), 1)
    return s.select("uri", r6(Md.sigmoid(F.lit(PLATT_A) * m + F.lit(PLATT_B))).alias("p_calibrated"))
