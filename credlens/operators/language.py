"""Language of a post from character trigrams (O-81).

A language's profile is its most frequent trigrams, by rank.  A post's score
for a language is the sum, over the post's trigrams, of how far up in the
profile each stands; the language with the highest score is the guess.
Profiles are fitted on posts whose language is declared.

Trigrams are counted and looked up text by text inside tasks
(``trigram_blocks``): a piece of texts leaves as one row per (language,
trigram), combined map-side, and a text as one row per language.  The ranking
keeps ``top`` rows a language before its exchange.  A profile table of up to
100,000 rows is collected and sent to the tasks, a larger one is joined with
the exploded trigrams.  The scores are one aggregate keyed by the post, which
needs no exchange where the input is partitioned by it.

Trigrams are taken from the clean text between two blanks, whole texts.
Defined results: a null key meets no guess; it, a null or empty text, or one
without a trigram of any profile gets the default; repeated rows of a key count
as one longer post and each row gets the guess; ties go to the language that
sorts first; an empty profile table gives the default everywhere.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import trigram_blocks as B
from .lexicon import IN_ROW_MAX_ROWS, _small

TOP = 300


def trigrams(clean: Column) -> Column:
    """The trigrams of a clean text, in order, with a blank before and after it."""
    c = F.split(F.concat(F.lit(" "), clean, F.lit(" ")), "")
    made = F.transform(F.array(c), lambda x: F.transform(
        F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2))))
    return F.when(clean != "", F.get(made, F.lit(0)))


def fit_profiles(posts: DataFrame, lang: str = "lang", top: int = TOP) -> DataFrame:
    """(lang, gram, rank): the ``top`` most frequent trigrams of each language,
    equal counts by trigram.  Posts without a language take no part."""
    def run(batches):
        for b in batches:
            yield from B.counts(b.column(0), b.column(1))
    grams = posts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), "clean_text") \
        .mapInArrow(run, "lang string, gram string, n long")
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "gram", "rank")


def profile_guess(posts: DataFrame, profiles: DataFrame, key: str = "post_id", top: int = TOP) -> DataFrame:
    """(key, guess, score) of the posts that hold a trigram of a profile."""
    rows = profiles.select("lang", "gram", (top + 1 - F.col("rank")).alias("up")).limit(IN_ROW_MAX_ROWS + 1).collect()
    if len(rows) <= IN_ROW_MAX_ROWS and all(r["lang"] is not None and r["gram"] and len(r["gram"]) == 3 for r in rows):
        known = B.Profiles([tuple(r) for r in rows])

        @F.arrow_udf("array<struct<lang: string, score: long>>")
        def scored(clean: pa.Array) -> pa.Array:
            return known.scores(clean)
        each = posts.select(key, F.explode_outer(scored("clean_text")).alias("l")).where("l IS NOT NULL")
        return _best(each.groupBy(key, "l.lang").agg(F.sum("l.score").alias("score")), key)
    table = profiles.groupBy("gram").agg(F.collect_list(F.struct("lang", (top + 1 - F.col("rank")).alias("up"))).alias("langs"))
    grams = posts.select(key, F.explode_outer(trigrams(F.col("clean_text"))).alias("gram")).where("gram IS NOT NULL")
    hits = grams.join(_small(table), "gram").select(key, F.explode_outer("langs").alias("l")).where("l IS NOT NULL")
    scores = hits.groupBy(key, "l.lang").agg(F.sum("l.up").alias("score"))
    return _best(scores, key)


def _best(scores: DataFrame, key: str) -> DataFrame:
    best = F.min(F.struct((-F.col("score")).alias("neg"), "lang"))
    return scores.groupBy(key).agg(best.alias("best")).select(key, F.col("best.lang").alias("guess"), (-F.col("best.neg")).alias("score"))


def with_profiled_language(posts: DataFrame, profiles: DataFrame, key: str = "post_id", default: str = "en",
                           top: int = TOP) -> DataFrame:
    """``lang_detected``: the first declared language, else the guess by
    ``profiles``, else ``default``.  Only posts without a declared language are
    split into trigrams."""
    declared = text.first_lang("langs")
    found = profile_guess(posts.where(declared.isNull()), profiles, key, top).select(F.col(key).alias("_key"), F.col("guess").alias("_guess"))
    return posts.join(found, posts[key] == found["_key"], "left").withColumn(
        "lang_detected", F.coalesce(declared, "_guess", F.lit(default))).drop("_key", "_guess")
