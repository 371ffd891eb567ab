import math

from pyspark.sql import functions as F

from credlens.functions import rules
from credlens.operators import dashboard as D
from credlens.operators import metrics as M
from credlens.operators import reports as Rp


def _dist(spark, rows):
    return spark.createDataFrame(rows, "key string, share double")


def test_js_distance_properties(spark):
    p = _dist(spark, [("a", 0.5), ("b", 0.5)])
    q = _dist(spark, [("a", 0.9), ("c", 0.1)])
    d1 = Rp.js_distance(p, q).first()[0]
    d2 = Rp.js_distance(q, p).first()[0]
    assert abs(d1 - d2) < 1e-12
    assert Rp.js_distance(p, p).first()[0] < 1e-7
    # a key on one side only: compare with a direct computation
    pa, pb, pc = 0.5, 0.5, 0.0
    qa, qb, qc = 0.9, 0.0, 0.1
    def kl(x, m):
        return x * math.log(x / m) if x > 0 else 0.0
    ms = [(pa + qa) / 2, (pb + qb) / 2, (pc + qc) / 2]
    want = math.sqrt((sum(kl(x, m) for x, m in zip((pa, pb, pc), ms))
                      + sum(kl(x, m) for x, m in zip((qa, qb, qc), ms))) / 2)
    assert abs(d1 - want) < 1e-12
    empty = spark.createDataFrame([], "key string, share double")
    assert Rp.js_distance(empty, empty).first()[0] is None


def test_classification_report_and_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "y_true string, y_pred string")
    cm = {r.y_true: (r.a, r.b) for r in M.confusion_matrix(df, ["a", "b"]).collect()}
    assert cm == {"a": (1, 1), "b": (0, 2)}
    r = {x.label: x for x in M.classification_report(df).collect()}
    assert r["a"].precision == 1.0 and r["a"].recall == 0.5
    assert abs(r["b"].precision - 2 / 3) < 1e-12 and r["b"].recall == 1.0
    assert r["accuracy"].f1_score == 0.75 and r["accuracy"].support == 4
    assert abs(r["macro avg"].recall - 0.75) < 1e-12


def test_metric_parsing(spark):
    lines = spark.createDataFrame([("# HELP x",), ("api_request_latency_seconds_sum 3.0",),
                                   ("api_request_latency_seconds_count 2",), ("bad line",),
                                   ("api_request_latency_seconds_sum{a=\"b\"} nope",)], "value string")
    assert Rp.metric_total(lines, "api_request_latency_seconds_sum").first()[0] == 3.0
    assert Rp.metric_total(lines, "missing").first()[0] is None
    assert Rp.metric_avg_latency(lines).first()[0] == 1.5
    zero = spark.createDataFrame([("api_request_latency_seconds_count 0",)], "value string")
    assert Rp.metric_avg_latency(zero).first()[0] is None


def test_decision_and_bands(spark):
    df = spark.createDataFrame([(0.7, "credible", -0.2), (0.69, "credible", 0.2), (0.9, "unverified", 0.1)],
                               "score double, label string, sentiment double")
    r = df.select(rules.alert("score", 0.7).alias("a"),
                  rules.decision("label", rules.alert("score", 0.7)).alias("d"),
                  rules.sentiment_band("sentiment").alias("b")).collect()
    assert [x.a for x in r] == [False, True, False]
    assert [x.d for x in r] == ["Pass", "Review", "Reject"]
    assert [x.b for x in r] == ["Negative", "Positive", "Neutral"]
    cats = spark.createDataFrame([("Joy",), ("anger",), (None,), ("surprise",)], "e string") \
                .select(rules.emotion_category("e").alias("c")).collect()
    assert [c.c for c in cats] == ["positive", "negative", "neutral", "neutral"]


def test_label_probabilities_renaming(spark):
    df = spark.createDataFrame([("u", [0.2, 0.5, 0.3], "special"), ("v", [0.4, 0.6], "unverified")],
                               "uri string, probabilities array<double>, predicted_label string")
    r = {(x.uri, x.class_index): x.label for x in D.label_probabilities(df).collect()}
    assert r[("u", 0)] == "class_0" and r[("u", 1)] == "special" and r[("u", 2)] == "class_2"
    assert r[("v", 0)] == "credible" and r[("v", 1)] == "unverified"


def test_url_parse(spark):
    df = spark.createDataFrame([("https://bsky.app/profile/al.ice/post/3k",),
                                ("https://evil.example/profile/al.ice/post/3k",),
                                ("https://bsky.app/profile/al.ice/feed/3k",)], "url string")
    r = [(x.handle, x.post_id_part, x.url_status) for x in D.parse_post_url(df).collect()]
    assert r == [("al.ice", "3k", "ok"), (None, None, "bad_host_or_path"), (None, None, "not_a_post_url")]
