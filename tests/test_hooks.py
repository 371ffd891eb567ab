import pytest

from credlens.operators import hooks as H
from credlens.operators import lexicon as L


def _posts(spark, texts):
    rows = [(f"p{k}", t, ["en"]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "post_id string, clean_text string, langs array<string>").coalesce(1)


def _touchy(texts):
    if any("boom" in t for t in texts):
        raise RuntimeError("no")
    return [None if t == "mute" else {"joy": 0.8, "fear": 0.2} for t in texts]


TEXTS = ["good news", "boom fear", "", None, "mute", "hope", "good news"]


def test_failing_texts_do_not_cost_their_batch(spark):
    got = {r.post_id: r for r in H.with_scorer_emotions(L.enrich_posts(_posts(spark, TEXTS)), _touchy, on_failure="empty").collect()}
    assert [got[f"p{k}"].emotion_status for k in range(7)] == [
        "ok", "emotion_failed", "missing_text", "missing_text", "emotion_failed", "ok", "ok"]
    assert got["p1"].emotion_scores == {} and got["p1"].dominant_emotion == "unknown" and got["p1"].emotion_source == "none"
    assert got["p0"].dominant_emotion == "joy" and got["p3"].emotion_scores == {}


def test_fallback_keeps_the_lexicon(spark):
    got = {r.post_id: r for r in H.with_scorer_emotions(L.enrich_posts(_posts(spark, TEXTS)), _touchy).collect()}
    assert (got["p1"].emotion_source, got["p1"].dominant_emotion, got["p1"].emotion_status) == ("lexicon_fallback", "fear", "ok")
    assert got["p0"].emotion_source == "model" and got["p2"].emotion_status == "missing_text"


def test_scorer_or_lexicon_not_there(spark):
    def gone(texts):
        raise H.ScorerUnavailable("no model")
    e = L.enrich_posts(_posts(spark, TEXTS))
    for scorer in (None, gone):
        got = {r.post_id: r.emotion_status for r in H.with_scorer_emotions(e, scorer, on_failure="empty").collect()}
        assert [got[f"p{k}"] for k in (0, 1, 2)] == ["nrcl_ex_unavailable", "nrcl_ex_unavailable", "missing_text"]
    bare = L.enrich(L.with_language(_posts(spark, ["good fear", ""])), lexicon=L.word_lexicon(spark).drop("emotions"))
    got = {r.post_id: r for r in bare.collect()}
    assert got["p0"].emotion_status == "nrcl_ex_unavailable" and got["p0"].dominant_emotion == "unknown"
    assert got["p0"].sentiment != 0 and got["p1"].emotion_status == "missing_text"


def test_errors_are_raised_on_request_and_wrong_sizes_always(spark):
    with pytest.raises(Exception, match="RuntimeError"):
        H.with_scorer_emotions(L.enrich_posts(_posts(spark, TEXTS)), _touchy, on_failure="raise").collect()
    with pytest.raises(Exception, match="1 results for"):
        H.with_scorer_emotions(L.enrich_posts(_posts(spark, TEXTS)), lambda t: [{}]).collect()
    with pytest.raises(ValueError):
        H.with_scorer_emotions(_posts(spark, TEXTS), _touchy, on_failure="ignore")


def test_accounting_counts_each_row_once(spark):
    scored = H.with_scorer_emotions(L.enrich_posts(_posts(spark, TEXTS)), _touchy, on_failure="empty")
    with pytest.warns(UserWarning, match="2 of 7"):
        rows, counts = H.checkpoint_with_counts(scored)
    assert tuple(counts.first()) == (7, 3, 2, 0, 2, 2) and rows.count() == 7
    # again under the same name: the counts are those of this run
    assert tuple(H.checkpoint_with_counts(scored.where("emotion_status = 'ok'"))[1].first()) == (3, 3, 0, 0, 0, 0)
    assert tuple(H.checkpoint_with_counts(scored.limit(0))[1].first()) == (0,) * 6


def test_models_can_be_fitted_after_the_accounting(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors
    H.checkpoint_with_counts(L.enrich_posts(_posts(spark, ["good news"])))
    rows = spark.createDataFrame([(Vectors.dense([x]), float(x > 1)) for x in (0.0, 1.0, 2.0, 3.0)], ["features", "label"])
    assert LogisticRegression().fit(rows).transform(rows).select("prediction").count() == 4
