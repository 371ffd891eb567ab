from pyspark.sql import functions as F

from credlens.config import Params
from credlens.operators import store as St
from credlens.plans import train as T
from credlens.sources import standins as S

from .conftest import SF_SMALL


def test_train_then_incremental_score(spark, tmp_dir):
    params = Params(verified_sources=S.TEST_VERIFIED, max_features=500, kmeans_n_init=2)
    raw = S.raw_posts(spark, SF_SMALL)
    older = raw.where(F.col("doc_id") < 150)
    out = T.train(older, tmp_dir, params, run_id="r1")
    run = spark.read.parquet(f"{out['reports']}/emotion_run").first()
    assert run.n_posts == run.ok == spark.read.parquet(f"{out['reports']}/predictions").count() and run.failures == 0
    table = St.read_scored(spark, out["scored"])
    table = table.checkpoint()
    n_first = table.count()
    assert n_first > 0
    assert table.where("predicted_label IS NULL OR explanation_text IS NULL").count() == 0
    for name in ("sentiment_summary", "classification_report", "class_top_terms", "clusters",
                 "cluster_keywords", "cluster_report", "clusters_by_group", "cluster_keywords_by_group", "predictions", "data_drift"):
        assert spark.read.parquet(f"{out['reports']}/{name}").where("run_id = 'r1'").count() > 0
    vectors = St.read_rows(spark, out["vectors"], "post_id")
    assert vectors.count() == n_first and len(vectors.first().embedding) > 0
    first = spark.read.parquet(f"{out['reports']}/data_drift").first()
    assert first.label_js_distance is None        # no previous run yet

    # nothing new to score for the same posts
    est = T.score(older, f"{tmp_dir}/scored", out["models"], params, estimate_only=True).first()
    assert est.to_score == 0

    # newer posts are scored and upserted; earlier rows keep created_at
    path = T.score(raw, f"{tmp_dir}/scored", out["models"], params)
    after = St.read_scored(spark, path).checkpoint()
    assert after.count() > n_first
    assert after.select("clean_text").distinct().count() == after.count()
    kept = after.join(table.select("clean_text", F.col("created_at").alias("c0")), "clean_text")
    assert kept.where("created_at <> c0").count() == 0

    # a second training run on other posts keeps the rows scored before
    T.train(raw.where(F.col("doc_id") >= 150), tmp_dir, params, run_id="r2")
    again = St.read_scored(spark, f"{tmp_dir}/scored")
    assert again.select("post_id").distinct().count() == again.count() == after.count()
    kept = again.join(after.select("post_id", F.col("created_at").alias("c0")), "post_id")
    assert kept.count() == after.count() and kept.where("created_at <> c0").count() == 0

    # an estimate without a table, with a limit, and with refresh
    from dataclasses import replace
    e = T.score(raw, f"{tmp_dir}/absent", out["models"], replace(params, incremental_limit=7), estimate_only=True).first()
    assert e.to_score == 7
    e = T.score(raw, f"{tmp_dir}/scored", out["models"], replace(params, incremental_refresh_existing=True),
                estimate_only=True).first()
    assert e.to_score == e.total
