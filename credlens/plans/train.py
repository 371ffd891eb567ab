"""Training and scoring runs (the two DAGs of the original), as plain
functions over DataFrames.

``train(...)``  raw posts -> prepare -> enrich -> vectorise -> classifier ->
                calibration -> k-means -> scored table + reports + models
``score(...)``  raw posts -> prepare -> incremental filter -> enrich ->
                saved models -> score + explain -> upsert
``score_texts(...)`` the one-text service as a DataFrame of texts
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Params
from ..functions import text as Tx
from ..session import materialize
from ..operators import clustering as K
from ..operators import explain as X
from ..operators import features as Ft
from ..operators import hooks as H
from ..operators import incremental as I
from ..operators import lexicon as L
from ..operators import metrics as M
from ..operators import models as Md
from ..operators import prepare as P
from ..operators import reports as Rp
from ..operators import store as St


@dataclass
class Bundle:
    vectorizer: PipelineModel
    indexed: list                      # [(term, idf)] in column order
    label_indexer: StringIndexerModel
    classifier: LogisticRegressionModel
    calibrated: Md.Calibrated | None = None
    classes: list = field(default_factory=list)

    def features(self, df: DataFrame) -> DataFrame:
        return self.vectorizer.transform(df)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return Ft.vocabulary_table(spark, self.indexed)


def fit_bundle(posts: DataFrame, params: Params = DEFAULT, calibrate: bool = True,
               calibrate_on_all: bool = False) -> Bundle:
    """Vectoriser on all posts, classifier on the hash-split training part,
    Platt calibration (on the training part unless ``calibrate_on_all``)."""
    vec, indexed = Ft.fit_vectorizer(posts, max_features=params.max_features, min_df=params.min_df,
                                     stopwords=Ft.stopword_list(params.custom_stopwords))
    lab = Md.fit_label_indexer(posts)
    # the vectorised rows are read by every fit below: keep them for the
    # duration of the fits (memory, spilling to disk), then release
    data = lab.transform(vec.transform(Md.with_split(posts))) \
              .select("clean_text", "label", "features", "is_test") \
              .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = data.where(~F.col("is_test"))
        clf = Md.fit_classifier(train)
        cal = None
        classes = list(lab.labels)
        if calibrate and len(classes) > 1:
            cal = Md.fit_calibrated(data if calibrate_on_all else train, folds=params.calibration_folds)
    finally:
        data.unpersist()
    return Bundle(vec, indexed, lab, clf, cal, classes)


def score_posts(posts: DataFrame, b: Bundle, params: Params = DEFAULT, key: str = "post_id",
                calibrated: bool = True) -> DataFrame:
    """predicted_label / credibility_score / alert from the probabilities,
    plain_label from the uncalibrated model, explanation terms for the
    predicted class and the explanation text.  The service takes calibrated
    probabilities; the two runs that write the table take the plain model's."""
    spark = posts.sparkSession
    x = Md.model_probability(b.features(posts), b.classifier)
    names = F.array(*[F.lit(c) for c in b.classes])
    x = x.withColumn("plain_label", F.get(names, F.col("plain_prediction").cast("int")))
    if calibrated and b.calibrated is not None:
        x = Md.calibrated_probability(x, b.calibrated)
    s = Md.with_decision(x.drop("features"), b.classes, threshold=params.alert_threshold)
    vocab, stop = b.vocab_table(spark), Ft.stopword_list(params.custom_stopwords)
    coef, _ = X.coefficient_table(spark, b.classifier, b.indexed)
    if len(b.classes) == 2:
        c = X.binary_contributions(s, vocab, coef.where("class_idx = 1").select("term", "coef"), params.explain_top_n, stop)
        return X.with_binary_explanations(c.drop("margin1"), params.terms_in_text)
    w = Ft.tfidf_weights(Ft.post_words(posts.dropDuplicates([key]), key, stop), vocab, key)
    return X.with_explanations(s, w, coef, params.explain_top_n, key, params.terms_in_text)


# ---------------------------------------------------------------------------
# persistence
# ---------------------------------------------------------------------------
def save_bundle(b: Bundle, path: str) -> None:
    b.vectorizer.write().overwrite().save(f"{path}/vectorizer")
    b.label_indexer.write().overwrite().save(f"{path}/label_indexer")
    b.classifier.write().overwrite().save(f"{path}/classifier")
    spark = SparkSession.getActiveSession()
    meta = {"indexed": b.indexed, "classes": b.classes,
            "platt": b.calibrated.platt if b.calibrated else None}
    St.save_json(spark, meta, f"{path}/meta")
    if b.calibrated:
        for i, m in enumerate(b.calibrated.models):
            m.write().overwrite().save(f"{path}/calibrated/fold_{i}")


def load_bundle(path: str) -> Bundle:
    """Loads a saved bundle; the calibrated part is optional."""
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    cal = None
    if meta.get("platt"):
        models = [LogisticRegressionModel.load(f"{path}/calibrated/fold_{i}")
                  for i in range(len(meta["platt"]))]
        cal = Md.Calibrated(models, [tuple(map(tuple, p)) if isinstance(p[0], list) else tuple(p) for p in meta["platt"]])
    return Bundle(PipelineModel.load(f"{path}/vectorizer"), [tuple(x) for x in meta["indexed"]],
                  StringIndexerModel.load(f"{path}/label_indexer"),
                  LogisticRegressionModel.load(f"{path}/classifier"), cal, meta["classes"])


# ---------------------------------------------------------------------------
# runs
# ---------------------------------------------------------------------------
def train(raw: DataFrame, out_dir: str, params: Params = DEFAULT, run_id: str = "run",
          checkpoint: bool = True) -> dict:
    """Training run: upserts the scored table, writes models and the report
    tables under ``out_dir``; returns their paths."""
    posts = P.prepare_posts(raw, params.verified_sources)
    enriched = L.enrich_posts(posts)
    if checkpoint:
        # cut the lineage once (reliable checkpoint in the shared folder
        # named by spark.checkpoint.dir): every later step reads this table
        enriched, emotion_run = H.checkpoint_with_counts(enriched)
    b = fit_bundle(enriched, params)
    save_bundle(b, f"{out_dir}/models")
    scored = score_posts(enriched, b, params, calibrated=False)
    table = scored.select(*[c for c in St.CLEAN_FIELDS if c in scored.columns],
                          "emotion_status", "plain_label", "post_id")
    # upsert: posts scored by earlier runs stay, and keep their created_at
    path = f"{out_dir}/scored"
    St.upsert_scored(enriched.sparkSession, path, table)
    vectors = St.dense_vector_rows(b.features(enriched)).select("post_id", "uri", "embedding")
    St.insert_rows(vectors, f"{out_dir}/vectors", "post_id")
    reports = {
        "predictions": scored.select("post_id", "uri", "credibility_label", "predicted_label", "credibility_score", "alert"),
        "sentiment_summary": Rp.sentiment_summary(enriched),
        "emotion_summary": Rp.emotion_summary(enriched),
        "label_distribution": Rp.distribution(enriched, "source_label"),
        "language_distribution": Rp.distribution(enriched, "lang_detected"),
    }
    if checkpoint:
        reports["emotion_run"] = emotion_run
    test = Md.with_split(scored).where("is_test").select(
        F.col("credibility_label").alias("y_true"), F.col("plain_label").alias("y_pred"))
    reports["classification_report"] = M.classification_report(test)
    reports["confusion_matrix"] = M.confusion_matrix(test, b.classes)
    reports["class_top_terms"] = X.class_top_terms(
        X.coefficient_table(enriched.sparkSession, b.classifier, b.indexed)[0], b.classes, params.explain_top_n)
    reports.update(cluster_reports(enriched, b, params))
    # drift against the latest earlier run: written before this run's
    # distributions are appended
    St.append_report(drift_against_previous(enriched.sparkSession, f"{out_dir}/reports",
                                            reports["label_distribution"],
                                            reports["language_distribution"]),
                     f"{out_dir}/reports/data_drift", run_id)
    for name, df in reports.items():
        St.append_report(df, f"{out_dir}/reports/{name}", run_id)
    return {"scored": path, "models": f"{out_dir}/models", "reports": f"{out_dir}/reports", "vectors": f"{out_dir}/vectors"}


def drift_against_previous(spark: SparkSession, reports_dir: str, cur_lab: DataFrame,
                           cur_lng: DataFrame) -> DataFrame:
    """One row: JS distances of the current label / language distributions
    to the latest earlier run (NULL on the first run) and the current
    distributions as text."""
    from ..sources import raw as R

    def previous(name: str):
        path = f"{reports_dir}/{name}"
        if not St.path_exists(spark, path):
            return None
        return R.latest_run(spark.read.parquet(path), "run_ts").select("key", "share")

    def distance(cur: DataFrame, prev) -> "F.Column":
        if prev is None:
            return F.lit(None).cast("double")
        return Rp.js_distance(cur, prev).scalar()

    pl, pg = previous("label_distribution"), previous("language_distribution")
    return cur_lab.agg(Rp.distribution_text(cur_lab).alias("current_label_distribution")).select(
        distance(cur_lab, pl).alias("label_js_distance"),
        distance(cur_lng, pg).alias("language_js_distance"),
        "current_label_distribution",
        cur_lng.agg(Rp.distribution_text(cur_lng)).scalar().alias("current_language_distribution"))


def cluster_reports(enriched: DataFrame, b: Bundle, params: Params = DEFAULT,
                    key: str = "post_id") -> dict:
    """Global k-means (best of ``n_init`` seeded fits) with its keywords
    and size report, and per-group k-means when ``cluster_by`` is set."""
    from pyspark.sql import functions as F2
    from ..functions import rules
    spark = enriched.sparkSession
    x = b.features(enriched.select(key, "clean_text", "source_label", "lang_detected"))
    km = K.fit_kmeans(x, params.n_clusters, params.kmeans_seed, params.kmeans_n_init)
    assign = km.transform(x).select(key, "clean_text", F2.col("cluster").cast("int").alias("cluster"))
    keywords = K.centroid_terms(spark, km.clusterCenters(), b.indexed)
    out = {"clusters": assign.drop(key), "cluster_keywords": keywords,
           "cluster_report": K.cluster_report(assign, keywords)}
    if params.cluster_by and params.cluster_by != "none":
        vt = b.vocab_table(spark)
        words = Ft.post_words(enriched, key, Ft.stopword_list(params.custom_stopwords))
        weights = Ft.tfidf_weights(words, vt, key).checkpoint(eager=True)
        g = enriched.select(key, "clean_text", rules.group_key("source_label", "lang_detected",
                                                               params.cluster_by).alias("grp"))
        grouped, _ = K.grouped_kmeans(g, weights, "grp", key, params.n_clusters, params.kmeans_seed,
                                      params.grouped_kmeans_n_init, params.grouped_kmeans_max_iter)
        out["clusters_by_group"] = grouped.join(g.select(key, "clean_text"), key) \
                                          .select("clean_text", F2.col("grp").alias("group"), "cluster")
        out["cluster_keywords_by_group"] = K.centroid_keywords(grouped, weights, key, group=("grp",)) \
            .withColumnRenamed("grp", "group")
    return out


def score(raw: DataFrame, scored_base: str, model_dir: str, params: Params = DEFAULT,
          estimate_only: bool = False) -> DataFrame | str:
    """Incremental run: only posts without a prediction and explanation
    are enriched and scored; the result is upserted by ``post_id``.  Returns
    the table's path, or with ``estimate_only`` the counts."""
    spark = raw.sparkSession
    posts = P.prepare_posts(raw, params.verified_sources)
    table = St.read_scored(spark, scored_base)
    refresh, limit = params.incremental_refresh_existing, params.incremental_limit
    if estimate_only:
        return I.estimate(posts, table, refresh_existing=refresh, limit=limit)
    # enrichment and scoring both read the posts: they are cleaned once
    todo = materialize(I.select_for_scoring(posts, table, refresh_existing=refresh, limit=limit))
    b = load_bundle(model_dir)
    scored = score_posts(L.enrich_posts(todo), b, params, calibrated=False)
    updates = scored.select(*[c for c in St.SCORING_FIELDS if c in scored.columns], "plain_label", "post_id")
    St.upsert_scored(spark, scored_base, updates)
    return scored_base


def score_texts(texts: DataFrame, b: Bundle, params: Params = DEFAULT, text_col: str = "text",
                lang_col: str | None = "lang") -> DataFrame:
    """The scoring service over a table of texts: clean -> features ->
    probabilities -> terms -> sentiment / emotion -> text, alert."""
    df = texts.withColumn("clean_text", Tx.clean_text(text_col)).withColumn("post_id", P.post_id())
    langs = F.array(F.col(lang_col)) if lang_col and lang_col in texts.columns else F.array()
    df = df.withColumn("langs", F.when(F.col(lang_col).isNotNull(), langs).otherwise(F.array().cast("array<string>"))
                       if lang_col and lang_col in texts.columns else F.array().cast("array<string>"))
    e = L.enrich_posts(df)
    return score_posts(e, b, params)
