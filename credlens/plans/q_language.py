"""Queries: trigram profiles of languages and the guesses by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import language as G
from ..operators import lexicon as L
from ..session import materialize
from . import oracle as O
from .catalog import register
from .q_prepare import posts

#: One bucket of this many of the posts is held out of the fit.
BUCKETS = 5

GRAM_CTES = [
    ("split_posts", f"SELECT *, {O.hash_bucket('uri', BUCKETS)} = 0 AS held_out FROM posts"),
    ("grams", """
SELECT post_id, lang, held_out, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS gram
FROM (SELECT *, ' ' || clean_text || ' ' AS s FROM split_posts)"""),
    ("gram_counts", "SELECT lang, gram, count(*) AS n FROM grams WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2"),
    ("profiles", f"""
SELECT lang, gram, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS INT) AS rank FROM gram_counts)
WHERE rank <= {G.TOP}"""),
    ("gram_scores", f"""
SELECT g.post_id, p.lang, CAST(sum({G.TOP + 1} - p.rank) AS BIGINT) AS score
FROM grams g JOIN profiles p USING (gram) GROUP BY 1, 2"""),
    ("guesses", "SELECT post_id, arg_min(lang, (-score, lang)) AS guess, max(score) AS score FROM gram_scores GROUP BY 1"),
]
ALL = [*O.POSTS_CTES, *GRAM_CTES]
# every post without its declared language
STOP_CTES = [(n, b.replace("WHERE len(langs) = 0 OR langs IS NULL", "")) if n == "need_words" else (n, b)
             for n, b in O.LANG_CTES if n != "posts_lang"]


def _split(spark, sf):
    p = posts(spark, sf).select("post_id", "uri", "clean_text", F.get("langs", 0).alias("lang"))
    return materialize(p.withColumn("held_out", rules.hash_bucket("uri", BUCKETS) == 0))


def _profiles(p):
    return materialize(G.fit_profiles(p.where(~F.col("held_out"))))


@register("language_profiles", O.with_(*ALL, final="SELECT lang, gram, rank FROM profiles"))
def language_profiles(spark, sf):
    """The trigram profile of each language, from the posts that are not held out."""
    return G.fit_profiles(_split(spark, sf).where(~F.col("held_out")))


@register("language_guess", O.with_(*ALL, final="""
SELECT p.uri, p.held_out, p.lang AS lang_declared, coalesce(g.guess, 'en') AS lang_detected, g.score
FROM split_posts p LEFT JOIN guesses g USING (post_id)"""))
def language_guess(spark, sf):
    """The language of every post by the profiles, declared languages ignored."""
    p = _split(spark, sf)
    return p.join(G.profile_guess(p, _profiles(p)), "post_id", "left").select(
        "uri", "held_out", F.col("lang").alias("lang_declared"), F.coalesce("guess", F.lit("en")).alias("lang_detected"), "score")


@register("language_accuracy", O.with_(*ALL, *STOP_CTES, final="""
SELECT p.lang, count(*) AS n_posts, count(*) FILTER (WHERE coalesce(g.guess, 'en') = p.lang) AS right_by_profile,
       count(*) FILTER (WHERE coalesce(s.guess, 'en') = p.lang) AS right_by_stop_words
FROM split_posts p LEFT JOIN guesses g USING (post_id) LEFT JOIN lang_guess s USING (post_id)
WHERE p.held_out AND p.lang IS NOT NULL GROUP BY 1"""))
def language_accuracy(spark, sf):
    """Held-out posts per declared language, and how many each guess gets right."""
    p = _split(spark, sf)
    held = p.where("held_out AND lang IS NOT NULL").withColumn("langs", F.array().cast("array<string>"))
    both = L.with_language(held).withColumnRenamed("lang_detected", "by_stop_words")
    both = G.with_profiled_language(both, _profiles(p))
    return both.groupBy("lang").agg(
        F.count("*").alias("n_posts"), F.count_if(F.col("lang_detected") == F.col("lang")).alias("right_by_profile"),
        F.count_if(F.col("by_stop_words") == F.col("lang")).alias("right_by_stop_words"))
