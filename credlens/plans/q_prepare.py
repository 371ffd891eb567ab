"""Queries: scans, cleaning, dedup, weak labels, collector filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import fixed
from ..functions import text as T
from ..operators import prepare as P
from ..operators import collect
from ..sources import raw as R
from ..session import materialize
from ..sources import standins as S
from . import oracle as O
from .catalog import register

# FIXED VALUES: hand-made rows for the cleaning rules (URL, mention, hashtag,
# apostrophes, accents; rows that clean to '' and are dropped)
HAND_TEXTS = (
    ("hand/1", "RT @Été_9 voir http://x.y/é? #Climat L'été, c’est  chaud!"),
    ("hand/2", "https://example.org/only-a-link"),
    ("hand/3", "@someone"),
    ("hand/4", "   \t  "),
    ("hand/5", "Straße Œuvre Ærø naïve façade — déjà vu!"),
    ("hand/6", "10\u00a0000 euros"),
    ("hand/7", "a\u202fb\u3000c\u2028d"),
    ("hand/8", "voir http://a.b/c\u00a0puis mot"),
    ("hand/9", "Привет, мир! Щука"),
    ("hand/10", "10 m² et ½ litre"),
    ("hand/11", "Việt Nam"),
    ("hand/12", "Αθήνα"),
    ("hand/13", "\u00a0\u2003"),
    ("hand/14", "שלום, ירושלים"),
    ("hand/15", "مرحبا بالعربية ٢٠٢٤"),
    ("hand/16", "नमस्ते भारत"),
    ("hand/17", "ひらがな・カタカナ"),
    ("hand/18", "한국어 안녕하세요"),
    ("hand/19", "Été Москва 서울 100½"),
)
# what they clean to, written out
HAND_CLEAN = (
    ("hand/1", "rt voir lete cest chaud"),
    ("hand/5", "strasse oeuvre aero naive facade deja vu"),
    ("hand/6", "10 000 euros"),
    ("hand/7", "a b c d"),
    ("hand/8", "voir puis mot"),
    ("hand/9", "privet mir shchuka"),
    ("hand/10", "10 m2 et 1/2 litre"),
    ("hand/11", "viet nam"),
    ("hand/12", "athena"),
    ("hand/14", "SHlvm yrvSHlym"),
    ("hand/15", "mrHb bl`rby@ 2024"),
    ("hand/16", "nmst bhrt"),
    ("hand/17", "hiraganakatakana"),
    ("hand/18", "hangugeo annyeonghaseyo"),
    ("hand/19", "ete moskva seoul 1001/2"),
)


def posts(spark, sf):
    return P.prepare_posts(S.raw_posts(spark, sf), S.TEST_VERIFIED)


def stored_posts(spark, sf):
    """``posts`` for a query that reads them several times: cleaned once, kept
    by post_id in the shared checkpoint folder."""
    return materialize(posts(spark, sf))


@register("label_source_counts", O.with_(*O.POSTS_CTES, final="""
SELECT credibility_label, source_label, count(*) AS n_posts FROM posts GROUP BY 1, 2"""))
def label_source_counts(spark, sf):
    """Flagship slice: documents -> posts -> clean -> dedup -> weak labels -> counts."""
    return posts(spark, sf).groupBy("credibility_label", "source_label") \
                           .agg(F.count("*").alias("n_posts"))


@register("raw_union", O.with_(("raw_posts", O.RAW_POSTS), final="""
SELECT uri, source_label, source_rank, langs[1] AS lang, inserted_at FROM raw_posts"""))
def raw_union(spark, sf):
    """Union scan of the collections in load order, tagged with their name."""
    d = S.raw_posts(spark, sf)
    frames = [(src, d.where(F.col("source_label") == src).drop("source_label", "source_rank"))
              for src in S.TEST_SOURCES]
    rest = d.where(F.col("source_label").isNull() | ~F.col("source_label").isin(list(S.TEST_SOURCES)))
    u = R.union_sources(frames).unionByName(rest)
    return u.select("uri", "source_label", "source_rank", F.get("langs", 0).alias("lang"), "inserted_at")


@register("feed_unwrap", O.with_(("raw_posts", O.RAW_POSTS), final="""
SELECT uri, coalesce(nullif(rec_text, ''), quoted_text, '') AS text, inserted_at FROM raw_posts"""))
def feed_unwrap(spark, sf):
    items = S.feed_items(spark, sf)
    flat = R.unwrap_feed(items.drop("source_label"))
    return flat.select("uri", T.extract_text("record").alias("text"), "inserted_at")


@register("extract_text", O.with_(("raw_posts", O.RAW_POSTS), final="""
SELECT uri, coalesce(nullif(rec_text, ''), quoted_text, '') AS text,
       (rec_text = '' AND quoted_text IS NOT NULL) AS from_quote
FROM raw_posts"""))
def extract_text(spark, sf):
    p = S.raw_posts(spark, sf)
    return p.select("uri", T.extract_text("record").alias("text"),
                    ((F.col("record.text") == "") & F.col("record.embed.record.record.text").isNotNull())
                    .alias("from_quote"))


_HAND_SQL = O.values(HAND_CLEAN, "uri, clean_text")


@register("clean_text", O.with_(*O.POSTS_CTES[:2], final=f"""
SELECT uri, clean_text FROM (
  SELECT uri, {O.clean('text')} AS clean_text FROM posts_text
  UNION ALL SELECT uri, clean_text FROM {_HAND_SQL})
WHERE clean_text <> ''"""))
def clean_text(spark, sf):
    p = P.with_text(S.raw_posts(spark, sf)).select("uri", "text")
    hand = spark.createDataFrame(list(HAND_TEXTS), "uri string, text string")
    return P.with_clean_text(p.unionByName(hand)).select("uri", "clean_text")


@register("dedup_first", O.with_(*O.POSTS_CTES, final="""
SELECT post_id, uri, source_label, source_rank, inserted_at FROM posts"""))
def dedup_first(spark, sf):
    return posts(spark, sf).select("post_id", "uri", "source_label", "source_rank", "inserted_at")


@register("dedup_counts", O.with_(*O.POSTS_CTES, final="""
SELECT (SELECT count(*) FROM posts_clean) AS rows_in, count(*) AS rows_kept,
       (SELECT count(*) FROM posts_clean) - count(*) AS duplicates_removed
FROM posts"""))
def dedup_counts(spark, sf):
    return P.dedup_counts(P.clean_posts(S.raw_posts(spark, sf)))


@register("weak_labels", O.with_(*O.POSTS_CTES, final="""
SELECT uri, source_label, credibility_label FROM posts"""))
def weak_labels(spark, sf):
    return posts(spark, sf).select("uri", "source_label", "credibility_label")


@register("author_filter", O.with_(("raw_posts", O.RAW_POSTS), final=f"""
SELECT uri, langs[1] AS lang FROM raw_posts
WHERE uri IS NOT NULL AND uri <> ''
  AND (len(langs) = 0 OR len(list_intersect(langs, {O.str_list(DEFAULT.langs_filter)})) > 0)
  AND regexp_matches(coalesce(rec_text, ''), '{fixed.NOT_SPACE_PATTERN}')"""))
def author_filter(spark, sf):
    out = collect.filter_author_posts(S.raw_posts(spark, sf), DEFAULT.langs_filter)
    return out.select("uri", F.get("langs", 0).alias("lang"))
