"""Explanations and long-form scoring (O-63, O-64, O-92, O-93, O-108).

Contribution of a term to a post = coef[class, term] * weight; for a binary
model class 0 uses -coef and class 1 +coef.  The coefficient table has at
most classes x ``max_features`` rows (bounded), so it is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import rules
from . import features as Ft
from . import models as Md


def coefficient_table(spark: SparkSession, model: LogisticRegressionModel,
                      indexed_vocab: Sequence[tuple[str, float]]) -> DataFrame:
    """(term, class_idx, coef) of a fitted model; binary -> two classes."""
    terms = [t for t, _ in indexed_vocab]
    rows = []
    if model.numClasses == 2 and not model.getFamily() == "multinomial":
        coefs = model.coefficients.toArray()
        for t, c in zip(terms, coefs):
            rows.append((t, 0, float(-c)))
            rows.append((t, 1, float(c)))
        intercepts = [-model.intercept, model.intercept]
    else:
        mat = model.coefficientMatrix.toArray()
        for k in range(mat.shape[0]):
            rows += [(t, k, float(c)) for t, c in zip(terms, mat[k])]
        intercepts = list(model.interceptVector.toArray())
    coef = spark.createDataFrame(rows, "term string, class_idx int, coef double")
    return coef, intercepts


def fixed_coefficients(vocab: DataFrame) -> DataFrame:
    """A deterministic stand-in model for tests and the oracle: the class-1
    coefficient of a term is (first 32 bits of md5(term) mod 2001 - 1000)
    / 1000; class 0 gets its negation."""
    c1 = ((F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long") % 2001) - 1000) / F.lit(1000.0)
    v = vocab.select("term", c1.alias("c"))
    return v.select("term", F.lit(0).alias("class_idx"), (-F.col("c")).alias("coef")).unionByName(
        v.select("term", F.lit(1).alias("class_idx"), F.col("c").alias("coef")))


def margins(posts: DataFrame, weights: DataFrame, coef: DataFrame, intercepts: Sequence[float],
            key: str = "post_id") -> DataFrame:
    """Per post the array of class margins sum(coef * weight) + intercept
    (posts without kept terms get the intercepts)."""
    k = len(intercepts)
    contrib = weights.join(F.broadcast(coef), "term") \
                     .groupBy(key).pivot("class_idx", list(range(k))) \
                     .agg(F.sum(F.col("coef") * F.col("weight")))
    m = posts.join(contrib, key, "left")
    arr = F.array(*[F.coalesce(F.col(str(i)), F.lit(0.0)) + F.lit(float(b))
                    for i, b in enumerate(intercepts)])
    return m.withColumn("margins", arr).drop(*[str(i) for i in range(k)])


def probabilities_from_margins(m: Column, k: int) -> Column:
    """Binary: sigmoid of the class-1 margin (the two margins are -z, z);
    more classes: softmax."""
    if k == 2:
        p1 = Md.sigmoid(F.get(m, 1))
        return F.array(1 - p1, p1)
    mx = F.array_max(m)
    ex = F.transform(m, lambda z: F.exp(z - mx))
    tot = F.aggregate(ex, F.lit(0.0), lambda a, z: a + z)
    return F.transform(ex, lambda z: z / tot)


def top_terms(weights: DataFrame, coef: DataFrame, preds: DataFrame, top_n: int = DEFAULT.explain_top_n,
              key: str = "post_id") -> DataFrame:
    """(key, rank, term, contribution): the top ``top_n`` terms of each post
    for its predicted class, then only those with contribution > 0.  The
    window is per post (bounded by the post's term count); with a constant
    limit Spark applies it as a group limit before sorting everything."""
    c = weights.join(preds.select(key, "pred_idx"), key) \
               .join(F.broadcast(coef), ["term"]) \
               .where(F.col("class_idx") == F.col("pred_idx")) \
               .select(key, "term", (F.col("coef") * F.col("weight")).alias("contribution"))
    # ties within float noise (1e-12) are broken by the term, the same way
    # on every engine and partitioning
    w = Window.partitionBy(key).orderBy(F.round("contribution", 12).desc(), F.col("term").asc())
    ranked = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return ranked.where(F.col("contribution") > 0)


def known_terms(vocab: DataFrame, coef1: DataFrame) -> tuple:
    """The vocabulary with the class-1 coefficients (term, coef), collected, for
    a caller that scores several times."""
    return Ft.collected(vocab.select("term", "idf").join(F.broadcast(coef1.select("term", "coef")), "term", "left")
                        .withColumn("coef", F.coalesce("coef", F.lit(0.0))), ["coef"])


def binary_contributions(df: DataFrame, vocab: DataFrame, coef1: DataFrame, top_n: int = DEFAULT.explain_top_n,
                         stopwords: list[str] | None = None, known: tuple | None = None) -> DataFrame:
    """``df`` (with ``clean_text``) and, from each row alone, ``margin1``, the
    class-1 margin of a binary model (without intercept), and ``top0``, ``top1``,
    the top-``top_n`` positive contributions for each class (class 0 uses
    -coef).  ``coef1``: (term, coef) of class 1; ``known``: both tables' ``known_terms``, if there."""
    x = Ft.with_contributions(Ft.with_words(df, stopwords, "words"), known or known_terms(vocab, coef1), top_n, "_c").drop("words")

    def top(side: str, sign: int):
        # ties within float noise (1e-12) are broken by the term
        keyed = F.transform(F.col(f"_c.{side}"), lambda e: F.struct(
            (-F.lit(sign) * F.round(e["contribution"], 12)).alias("k"), e["term"].alias("term"),
            (F.lit(sign) * e["contribution"]).alias("contribution")))
        best = F.slice(F.sort_array(keyed), 1, top_n)
        return F.transform(F.filter(best, lambda e: e["contribution"] > 0),
                           lambda e: F.struct(e["term"].alias("term"), e["contribution"].alias("contribution")))
    return x.select(*df.columns, F.col("_c.margin").alias("margin1"), top("low", -1).alias("top0"), top("high", 1).alias("top1"))


def with_binary_explanations(scored: DataFrame, n_terms: int = DEFAULT.terms_in_text) -> DataFrame:
    """explanation_terms (+ explanation_contrib) of the predicted class and
    the explanation text; ``scored`` needs pred_idx and the columns of
    ``binary_contributions``, of which the two lists are dropped."""
    chosen = F.coalesce(F.when(F.col("pred_idx") == 1, F.col("top1")).otherwise(F.col("top0")),
                        F.array().cast("array<struct<term:string,contribution:double>>"))
    out = scored.withColumn("explanation_contrib", chosen).drop("top0", "top1")
    out = out.withColumn("explanation_terms", F.transform("explanation_contrib", lambda e: e["term"]))
    emo = F.col("dominant_emotion") if "dominant_emotion" in scored.columns else F.lit("unknown")
    return out.withColumn("explanation_text", rules.explanation_text(
        "predicted_label", "credibility_score", emo, "explanation_terms", n_terms))


def score_binary(posts: DataFrame, vocab: DataFrame, coef1: DataFrame, intercept: float,
                 classes: Sequence[str], threshold: float = DEFAULT.alert_threshold,
                 top_n: int = DEFAULT.explain_top_n, stopwords: list[str] | None = None, known: tuple | None = None) -> DataFrame:
    """Linear binary scoring: margin -> sigmoid -> decision -> explanations,
    each post from its own row (no aggregate, no join)."""
    j = binary_contributions(posts, vocab, coef1, top_n, stopwords, known)
    m = F.coalesce(F.col("margin1"), F.lit(0.0)) + F.lit(float(intercept))
    j = j.withColumn("margins", F.array(-m, m)).drop("margin1")
    j = j.withColumn("probabilities", probabilities_from_margins(F.col("margins"), 2))
    return with_binary_explanations(Md.with_decision(j, classes, threshold=threshold))


def term_arrays(explained: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, explanation_terms) ordered by rank."""
    g = explained.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    return g.select(key, F.transform("_t", lambda s: s["term"]).alias("explanation_terms"))


def with_explanations(scored: DataFrame, weights: DataFrame, coef: DataFrame,
                      top_n: int = DEFAULT.explain_top_n, key: str = "post_id",
                      n_terms: int = DEFAULT.terms_in_text) -> DataFrame:
    """Adds explanation_terms and the explanation text (pipeline template)."""
    ex = term_arrays(top_terms(weights, coef, scored, top_n, key), key)
    out = scored.join(ex, key, "left").withColumn(
        "explanation_terms", F.coalesce("explanation_terms", F.array().cast("array<string>")))
    emo = F.col("dominant_emotion") if "dominant_emotion" in scored.columns else F.lit("unknown")
    return out.withColumn("explanation_text", rules.explanation_text(
        "predicted_label", "credibility_score", emo, "explanation_terms", n_terms))


def class_top_terms(coef: DataFrame, classes: Sequence[str], top_n: int = DEFAULT.explain_top_n) -> DataFrame:
    """(class, rank, term): the ``top_n`` largest coefficients per class."""
    w = Window.partitionBy("class_idx").orderBy(F.col("coef").desc(), F.col("term").asc())
    names = F.array(*[F.lit(c) for c in classes])
    r = coef.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return r.select(F.get(names, F.col("class_idx")).alias("class"), "rank", "term")
