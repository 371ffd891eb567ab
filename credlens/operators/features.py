"""Terms and TF-IDF (O-53, O-66, O-100, O-101, O-102).

Two equal forms:

* long form ``(post_id, term, weight)`` built post by post from its words and
  the vocabulary (bounded by ``max_features``): the truth the SQL oracle
  checks, and the input of explanations;
* ``pyspark.ml`` form: a ``PipelineModel`` (terms -> CountVectorizerModel ->
  ElementwiseProduct(idf) -> Normalizer) with a sparse ``features`` column
  for the classifier and k-means, built from the long-form vocabulary.

Formulas: tf = count of the term in the post; idf = ln((1+n)/(1+df)) + 1
(Spark's own IDF has no +1); rows L2-normalised.  Terms are words of two or
more characters with the English, French and custom stop words removed,
then 1- and 2-grams of what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, NGram, Normalizer,
                                SQLTransformer, StopWordsRemover)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import fixed
from ..session import materialize
from . import term_blocks as B


class DropColumns(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Drops helper columns; saved and loaded with the pipeline."""

    def __init__(self, inputCols=None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=list(inputCols))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getInputCols())


def stopword_list(custom: Sequence[str] = DEFAULT.custom_stopwords) -> list[str]:
    return fixed.vectorizer_stopwords(tuple(custom))


def _terms_stages(stopwords: list[str], src: str = "clean_text", out: str = "terms") -> list:
    words = SQLTransformer(statement=(
        f"SELECT *, filter(CASE WHEN {src} = '' THEN array() ELSE split({src}, ' ') END, "
        f"w -> length(w) >= 2) AS _vw FROM __THIS__"))
    remover = StopWordsRemover(inputCol="_vw", outputCol="_uni", stopWords=stopwords, caseSensitive=True)
    bigrams = NGram(n=2, inputCol="_uni", outputCol="_bi")
    merge = SQLTransformer(statement=f"SELECT *, concat(_uni, _bi) AS {out} FROM __THIS__")
    return [words, remover, bigrams, merge, DropColumns(inputCols=["_vw", "_uni", "_bi"])]


def with_terms(df: DataFrame, stopwords: list[str] | None = None, out: str = "terms") -> DataFrame:
    """``terms`` array: unigrams then bigrams of the clean text."""
    sw = stopwords if stopwords is not None else stopword_list()
    return PipelineModel(stages=_terms_stages(sw, out=out)).transform(df)


def with_words(df: DataFrame, stopwords: list[str] | None = None, out: str = "words") -> DataFrame:
    """``words`` array: the unigrams of the clean text, in order.  The terms
    are these and the pairs of neighbours; they are made and counted post by
    post inside tasks (``term_blocks``), so no row per (post, term) is ever
    aggregated, sorted or shuffled."""
    sw = stopwords if stopwords is not None else stopword_list()
    words, remover = _terms_stages(sw)[:2]
    return PipelineModel(stages=[words, remover.setOutputCol(out), DropColumns(inputCols=["_vw"])]).transform(df)


def post_words(df: DataFrame, key: str | Sequence[str] = "post_id", stopwords: list[str] | None = None) -> DataFrame:
    """(key.., words), one row per row of ``df``."""
    keys = [key] if isinstance(key, str) else list(key)
    return with_words(df.select(*keys, "clean_text"), stopwords).drop("clean_text")


def document_frequency(words: DataFrame, heavy: np.ndarray | None = None) -> DataFrame:
    """(term, df, cf): posts containing the term, total occurrences; ``words``
    has one row per post.  Each piece of posts gives a term once, and these
    rows are combined map-side, so a term in every post is one row per map task.
    With ``heavy``, flags by bucket, the terms of these buckets only."""
    flags = None if heavy is None else np.packbits(heavy)

    def run(batches):
        set_ = None if flags is None else np.unpackbits(flags).astype(bool)
        for b in batches:
            yield from B.frequencies(b.column(0)) if set_ is None else B.heavy_frequencies(b.column(0), set_)
    return words.select("words").mapInArrow(run, "term string, df long, cf long") \
        .groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bucket_loads(words: DataFrame) -> np.ndarray:
    """Occurrences of terms by hash bucket, ``B.BUCKETS`` numbers whatever the
    input: each task adds up its own, and their sums reach the driver."""
    def run(batches):
        n = B.loads(b.column(0) for b in batches)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(n[at])], names=["bucket", "n"])
    sums = words.select("words").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(B.BUCKETS, "int64")
    out[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return out


def most_frequent(words: DataFrame, max_features: int, min_df: int) -> DataFrame:
    """(term, df, cf): the top ``max_features`` terms by corpus count among those
    in at least ``min_df`` posts (ties: term ascending), exactly.

    A term occurs at most as often as its bucket is loaded.  So terms are
    counted only in buckets of a load of ``least`` or more; if ``max_features``
    of them occur ``least`` times, no other term is among the first.  If they do
    not, ``least`` was guessed too high: it falls, in the end to all terms."""
    load = bucket_loads(words)
    ordered = np.sort(load)
    # the load of the last bucket that can hold one of the first terms, less that of an ordinary one
    last = int(ordered[-max_features]) if 0 < max_features <= len(load) else 0
    least = (last - 2 * int(ordered[len(load) // 2])) // 2
    while True:
        d = document_frequency(words, load >= least if least > 1 else None).where(F.col("df") >= min_df)
        top = materialize(d.orderBy(F.col("cf").desc(), F.col("term").asc()).limit(max_features))
        if least <= 1 or top.where(F.col("cf") >= least).count() >= max_features:
            return top
        least //= 8


def fit_vocabulary(words: DataFrame, n_docs, max_features: int = DEFAULT.max_features,
                   min_df: int = DEFAULT.min_df) -> DataFrame:
    """Top ``max_features`` terms by corpus count among those in at least
    ``min_df`` posts (ties: term ascending), with idf and the alphabetical
    column index.  At most ``max_features`` rows, so it is safe to
    broadcast and to collect.  ``words`` is read twice."""
    top = most_frequent(words, int(max_features), min_df)
    n = n_docs if not isinstance(n_docs, int) else F.lit(n_docs)
    idf = F.ln((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return top.select("term", "df", "cf", idf.alias("idf"))


def index_vocabulary(vocab: DataFrame) -> list[tuple[str, float]]:
    """(term, idf) sorted by term: the column order of the sparse vectors.
    Collects at most ``max_features`` rows."""
    rows = vocab.select("term", "idf").orderBy("term").collect()
    return [(r["term"], float(r["idf"])) for r in rows]


def vocabulary_table(spark: SparkSession, indexed: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame([(t, i, w) for i, (t, w) in enumerate(indexed)],
                                 "term string, idx int, idf double")


def collected(vocab: DataFrame, more: Sequence[str] = ()) -> tuple[list[str], list[np.ndarray]]:
    """The vocabulary, at most ``max_features`` rows: terms in order, idf and the columns ``more``."""
    rows = vocab.select("term", "idf", *more).orderBy("term").collect()
    return [r["term"] for r in rows], [np.array([r[c] for r in rows], "float64") for c in ("idf", *more)]


def with_weighted_terms(df: DataFrame, vocab: DataFrame, more: Sequence[str] = (), out: str = "weighted") -> DataFrame:
    """``df`` (with ``words``) and, for each row, the array of its terms of the
    vocabulary: term, weight (tf * idf, L2-normalised over them) and the
    vocabulary's columns ``more``.  The vocabulary, at most ``max_features``
    rows, is collected and sent to the tasks; each row is computed on its own."""
    terms, (idf, *values) = collected(vocab, more)
    schema = f"array<struct<term: string, weight: double{''.join(f', {c}: double' for c in more)}>>"

    @F.arrow_udf(schema)
    def weigh(words: pa.Array) -> pa.Array:
        return B.weighted(words, pa.array(terms, pa.string()), idf, dict(zip(more, values)))
    return df.withColumn(out, weigh("words"))


def with_contributions(df: DataFrame, known: tuple[list[str], list[np.ndarray]], top_n: int, out: str = "contributions") -> DataFrame:
    """``df`` (with ``words``) and, for each row, what its weighted terms and their
    coefficients add up to (``term_blocks.contributions``); ``known``: the terms in order, idf and coefficients."""
    terms, (idf, values) = known
    side = "array<struct<term: string, contribution: double>>"

    @F.arrow_udf(f"struct<margin: double, low: {side}, high: {side}>")
    def add(words: pa.Array) -> pa.Array:
        return B.contributions(words, pa.array(terms, pa.string()), idf, values, top_n)
    return df.select("*", F.explode_outer(F.array(add("words"))).alias(out))


def tfidf_weights(words: DataFrame, vocab: DataFrame, key: str | Sequence[str] = "post_id", arrays: bool = False) -> DataFrame:
    """(key.., term, weight): tf * idf, L2-normalised per post over kept
    terms; posts without kept terms have no rows.  With ``arrays`` a row a
    post, (key.., terms, weights), the arrays of these."""
    keys = [key] if isinstance(key, str) else list(key)
    if arrays:
        w = with_weighted_terms(words.select(*keys, "words"), vocab, out="_w")
        return w.select(*keys, F.col("_w.term").alias("terms"), F.col("_w.weight").alias("weights"))
    w = with_weighted_terms(words.select(*keys, "words"), vocab).select(*keys, F.explode_outer("weighted").alias("_w"))
    return w.where(F.col("_w").isNotNull()).select(*keys, "_w.term", "_w.weight")


def fit_tfidf(posts: DataFrame, key: str = "post_id", max_features: int = DEFAULT.max_features,
              min_df: int = DEFAULT.min_df, stopwords: list[str] | None = None):
    """Fit on ``posts`` (one row per post): returns (vocab_df, words_df)."""
    words = post_words(posts, key, stopwords)
    n = posts.agg(F.count("*")).scalar()
    return fit_vocabulary(words, n, max_features, min_df), words


def tfidf_pipeline_model(indexed: list[tuple[str, float]], stopwords: list[str] | None = None,
                         out: str = "features") -> PipelineModel:
    """The ``pyspark.ml`` vectoriser equal to the long form."""
    sw = stopwords if stopwords is not None else stopword_list()
    terms = [t for t, _ in indexed]
    idf = Vectors.dense([w for _, w in indexed]) if indexed else Vectors.dense([])
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="terms", outputCol="_tf")
    ep = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_tfidf")
    norm = Normalizer(p=2.0, inputCol="_tfidf", outputCol=out)
    drop = DropColumns(inputCols=["terms", "_tf", "_tfidf"])
    return PipelineModel(stages=_terms_stages(sw) + [cv, ep, norm, drop])


def fit_vectorizer(posts: DataFrame, key: str = "post_id", max_features: int = DEFAULT.max_features,
                   min_df: int = DEFAULT.min_df, stopwords: list[str] | None = None):
    """Fit and return (PipelineModel, indexed vocabulary)."""
    vocab, _ = fit_tfidf(posts, key, max_features, min_df, stopwords)
    indexed = index_vocabulary(vocab)
    return tfidf_pipeline_model(indexed, stopwords), indexed
