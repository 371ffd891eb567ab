import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from credlens.operators import clustering as K
from credlens.operators import explain as X
from credlens.operators import features as Ft
from credlens.operators import models as Md
from credlens.operators import prepare as P
from credlens.plans import train as Tr


def _posts(spark, texts, labels=None):
    labels = labels or ["credible"] * len(texts)
    df = spark.createDataFrame([(f"u{i}", t, l, 0, None) for i, (t, l) in enumerate(zip(texts, labels))],
                               "uri string, clean_text string, credibility_label string, source_rank int, "
                               "inserted_at timestamp_ntz")
    return df.withColumn("post_id", P.post_id())


TEXTS = ["red apple pie", "green apple tart", "red cherry pie", "blue sky clear", "blue sea clear",
         "apple pie red", "sky blue sea", "the red apple"]


def test_tfidf_long_equals_ml(spark):
    p = _posts(spark, TEXTS)
    vocab, tf = Ft.fit_tfidf(p, max_features=50, min_df=2)
    idx = Ft.index_vocabulary(vocab)
    n = len(TEXTS)
    for term, idf in idx:
        df = sum(1 for t in TEXTS if term in (t.split() + [" ".join(x) for x in zip(t.split(), t.split()[1:])]))
        assert abs(idf - (math.log((1 + n) / (1 + df)) + 1)) < 1e-12
    long = {(r.post_id, r.term): r.weight for r in Ft.tfidf_weights(tf, vocab).collect()}
    model = Ft.tfidf_pipeline_model(idx)
    dense = model.transform(p).select("post_id", vector_to_array("features").alias("v")).collect()
    for r in dense:
        v = np.array(r.v)
        if v.any():
            assert abs(np.linalg.norm(v) - 1.0) < 1e-12
        for j, (term, _) in enumerate(idx):
            assert abs(v[j] - long.get((r.post_id, term), 0.0)) < 1e-12


def test_classifier_calibration_and_roundtrip(spark, tmp_dir):
    texts = [f"good solid fact {i}" for i in range(20)] + [f"fake rumor claim {i}" for i in range(20)]
    labels = ["credible"] * 20 + ["unverified"] * 20
    p = _posts(spark, texts, labels)
    b = Tr.fit_bundle(p, calibrate=True)
    assert b.classes == ["credible", "unverified"]
    assert len(b.calibrated.platt) == 3
    s = Tr.score_posts(p, b).collect()
    acc = sum(r.predicted_label == r.credibility_label for r in s) / len(s)
    assert acc >= 0.9
    for r in s:
        assert abs(sum(r.probabilities) - 1.0) < 1e-9
        assert r.credibility_score >= 0.5
        assert r.alert == (r.credibility_score < 0.7)
    texts = spark.createDataFrame([("Good solid FACT!", "en"), ("fake rumor", None)], "text string, lang string")
    svc = {r.clean_text: r for r in Tr.score_texts(texts, b).collect()}
    assert svc["good solid fact"].predicted_label == "credible"
    assert svc["fake rumor"].predicted_label == "unverified"
    assert svc["good solid fact"].explanation_text.startswith("This post is classified as 'credible'")
    Tr.save_bundle(b, f"{tmp_dir}/m")
    b2 = Tr.load_bundle(f"{tmp_dir}/m")
    s2 = {r.uri: r.credibility_score for r in Tr.score_posts(p, b2).collect()}
    for r in s:
        assert abs(s2[r.uri] - r.credibility_score) < 1e-9


def test_split_is_stable(spark):
    p = _posts(spark, [f"text {i}" for i in range(200)])
    a = {r.uri: r.is_test for r in Md.with_split(p).collect()}
    b = {r.uri: r.is_test for r in Md.with_split(p.repartition(7)).collect()}
    assert a == b
    assert 20 <= sum(a.values()) <= 60


def test_explanations_positive_only(spark):
    p = _posts(spark, TEXTS)
    vocab, tf = Ft.fit_tfidf(p, max_features=50, min_df=1)
    w = Ft.tfidf_weights(tf, vocab)
    coef = X.fixed_coefficients(vocab)
    m = X.margins(p, w, coef, [0.0, 0.0]).withColumn(
        "probabilities", X.probabilities_from_margins(F.col("margins"), 2))
    s = Md.with_decision(m, ["credible", "unverified"])
    t = X.top_terms(w, coef, s, 3).collect()
    assert all(r.contribution > 0 and r.rank <= 3 for r in t)


@pytest.mark.parametrize("block_rows", [1024, 8])   # groups of one block, and of several
def test_grouped_kmeans(spark, block_rows):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [("g1", "a", "t0", 1.0)]                                    # group of 1: left out
    rows += [("g2", f"b{i}", f"t{i}", 1.0) for i in range(2)]          # 2 rows: k = 2
    rows += [("g3", f"c{i}", f"t{i % 2}", 1.0) for i in range(20)]     # 20 rows, two points
    rows += [("g4", f"d{i}", f"t{j}", float(rng.normal() + 8 * (j == i % 3))) for i in range(60) for j in range(3)]
    df = spark.createDataFrame(rows, "grp string, post_id string, term string, weight double")
    empty = spark.createDataFrame([("g3", "none")], "grp string, post_id string")   # a row without weights
    members = df.select("grp", "post_id").distinct().unionByName(empty)
    assign, cent = K.grouped_kmeans(members, df.select("post_id", "term", "weight"), "grp", "post_id", k_max=3, block_rows=block_rows)
    got = {}
    for r in assign.collect():
        got.setdefault(r.grp, {})[r.post_id] = r
    assert set(got) == {"g2", "g3", "g4"} and len(got["g3"]) == 21 and len(got["g4"]) == 60
    assert len({r.cluster for r in got["g2"].values()}) == 2
    c = {k: r.cluster for k, r in got["g3"].items()}
    assert all(c[f"c{i}"] == c[f"c{i % 2}"] for i in range(20)) and c["c0"] != c["c1"]
    # every row is at the nearest of its group's centroids, by brute force
    centers = {}
    for r in cent.collect():
        for j in range(3):
            if r[f"c{j}"] is not None:
                centers.setdefault((r.grp, j), {})[r.term] = r[f"c{j}"]
    points = {}
    for g, k, t, w in rows:
        points.setdefault((g, k), {})[t] = w
    for g in got:
        for k, r in got[g].items():
            x = points.get((g, k), {})
            d = {j: sum((x.get(t, 0) - v.get(t, 0)) ** 2 for t in {*x, *v}) for (h, j), v in centers.items() if h == g}
            assert d[r.cluster] <= min(d.values()) + 1e-9


@pytest.mark.parametrize("block_rows", [1024, 4])
def test_grouped_kmeans_keeps_groups_without_terms(spark, block_rows):
    """A group of which no post has a weight, and one whose other rows have some."""
    members = [("none", f"n{i}") for i in range(5)] + [("few", f"f{i}") for i in range(12)]
    weights = [("f0", "t0", 1.0), ("f1", "t1", 1.0)]
    assign, _ = K.grouped_kmeans(spark.createDataFrame(members, "grp string, post_id string"),
                                 spark.createDataFrame(weights, "post_id string, term string, weight double"),
                                 "grp", "post_id", k_max=3, block_rows=block_rows)
    rows = assign.collect()
    assert sorted((r.grp, r.post_id) for r in rows) == sorted(members)
    assert all(0 <= r.cluster < 3 and abs(r.d[r.cluster]) < 1e-12 for r in rows if r.grp == "none")


@pytest.mark.parametrize("block_rows", [1024, 60])
def test_grouped_kmeans_ends_at_a_fixed_point(spark, caplog, block_rows):
    """Evenly spaced points on a line settle slowly: in the end no row moves."""
    from credlens.config import DEFAULT
    assert DEFAULT.grouped_kmeans_n_init == 10 and DEFAULT.grouped_kmeans_max_iter == 300
    x = {f"p{i}": float(i) for i in range(1, 161)}
    members = spark.createDataFrame([("g", k) for k in x], "grp string, post_id string")
    weights = spark.createDataFrame([(k, "t", v) for k, v in x.items()], "post_id string, term string, weight double")

    def moves(**how):
        assign, _ = K.grouped_kmeans(members, weights, "grp", "post_id", k_max=4, n_init=1, block_rows=block_rows, **how)
        rows = assign.collect()
        got = {r.post_id: r.cluster for r in rows}
        assert {r.settled for r in rows} == {"max_iter" not in how}
        assert set(got) == set(x)
        at = {c: np.mean([x[k] for k in got if got[k] == c]) for c in set(got.values())}
        return sum((x[k] - at[got[k]]) ** 2 > min((x[k] - m) ** 2 for m in at.values()) + 1e-9 for k in x)
    assert moves() == 0 and "still move" not in caplog.text
    assert moves(max_iter=2) > 0 and "still move after 2 passes" in caplog.text


def test_grouped_kmeans_of_a_hot_group_does_not_depend_on_blocks(spark):
    """One group with nine tenths of the rows: the same clusters from one block as from many."""
    rng = np.random.default_rng(5)
    rows = [("hot" if i % 10 else f"g{i % 3}", f"p{i:04}", f"t{j}", float(rng.random() + 3 * (j == i % 4)))
            for i in range(600) for j in range(5)]
    df = spark.createDataFrame(rows, "grp string, post_id string, term string, weight double")
    members, weights = df.select("grp", "post_id").distinct(), df.select("post_id", "term", "weight")
    one, many = ({(r.grp, r.post_id): (r.cluster, [None if x is None else round(x, 9) for x in r.d]) for r in K.grouped_kmeans(
        members, weights, "grp", "post_id", k_max=4, n_init=3, block_rows=b)[0].collect()} for b in (4096, 50))
    assert one == many and len(one) == 600


def test_assign_nearest(spark):
    df = spark.createDataFrame([(1, [0.0, 0.1]), (2, [5.0, 5.0])], "id int, embedding array<float>")
    cent = spark.createDataFrame([("near0", 0, 0.0), ("near0", 1, 0.0), ("near5", 0, 5.0), ("near5", 1, 5.0)],
                                 "label string, pos int, mean double")
    r = {x.id: x.cluster for x in K.assign_nearest(df, cent).collect()}
    assert r == {1: "near0", 2: "near5"}


def test_folds_hold_every_class(spark):
    rows = [(f"t{i}", float(i % 50 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "clean_text string, label double")
    got = Md.with_folds(df, "clean_text", 3).groupBy("_fold", "label").count().collect()
    rare = sorted(r["count"] for r in got if r.label == 1)
    assert len(got) == 6 and rare[0] >= 1 and sum(rare) == 6


def test_calibration_of_three_classes_is_newtons(spark):
    """The sigmoids of all classes in one aggregate equal each class fitted against the rest."""
    rng = np.random.default_rng(8)
    rows = [(float(y), (rng.normal(size=3) + 1.5 * np.eye(3)[y]).tolist()) for y in rng.integers(0, 3, 300)]
    df = spark.createDataFrame(rows, "label double, margins array<double>")
    many = Md.fit_platt_many(df, 3)
    for c in range(3):
        one = Md.fit_platt(df.select((F.col("label") == c).cast("double").alias("label"), F.col("margins")[c].alias("margin")))
        assert np.allclose(many[c], one, atol=1e-6)
