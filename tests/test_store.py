import datetime as dt

from pyspark.sql import functions as F

from credlens.operators import incremental as I
from credlens.operators import store as St

T0 = dt.datetime(2024, 1, 1)
T1 = dt.datetime(2024, 2, 1)


def _table(spark):
    return spark.createDataFrame([
        ("a", "x", 0.5, "kept", T0, T0),
        ("b", "", 0.4, "kept", T0, T0),
    ], "clean_text string, predicted_label string, credibility_score double, note string, "
       "inserted_at timestamp_ntz, created_at timestamp_ntz")


def _updates(spark):
    return spark.createDataFrame([
        ("a", "y", None, T1),
        ("c", "z", 0.9, T1),
    ], "clean_text string, predicted_label string, credibility_score double, inserted_at timestamp_ntz")


def test_upsert_semantics(spark):
    now = F.lit(T1).cast("timestamp_ntz")
    out = {r.clean_text: r for r in St.upsert(_table(spark), _updates(spark), "clean_text", now=now).collect()}
    assert out["a"].predicted_label == "y"
    assert out["a"].credibility_score is None          # listed field set even when NULL
    assert out["a"].note == "kept"                     # unlisted field kept
    assert out["a"].created_at == T0                   # set on insert only
    assert out["b"].predicted_label == ""              # untouched row
    assert out["c"].created_at == T1 and out["c"].note is None
    c = St.upsert_counts(_table(spark), _updates(spark), "clean_text").first()
    assert (c.inserted, c.matched) == (1, 1)


def test_upsert_twice_equals_once(spark):
    now = F.lit(T1).cast("timestamp_ntz")
    once = St.upsert(_table(spark), _updates(spark), "clean_text", now=now)
    twice = St.upsert(once, _updates(spark), "clean_text", now=now)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.select(*once.columns).collect()))


def test_update_existing_ignores_unknown(spark):
    out = St.update_existing(_table(spark), _updates(spark).select("clean_text", "predicted_label"), "clean_text")
    got = {r.clean_text: r.predicted_label for r in out.collect()}
    assert got == {"a": "y", "b": ""}


def test_incremental_filter(spark):
    posts = spark.createDataFrame([("a", 0, T0, "u1"), ("b", 0, T0, "u2"), ("d", 1, T0, "u3")],
                                  "clean_text string, source_rank int, inserted_at timestamp_ntz, uri string")
    scored = spark.createDataFrame([("a", "x", "e"), ("b", "x", None)],
                                   "clean_text string, predicted_label string, explanation_text string")
    assert sorted(r.clean_text for r in I.select_for_scoring(posts, scored, "clean_text").collect()) == ["b", "d"]
    assert [r.clean_text for r in I.select_for_scoring(posts, scored, "clean_text", limit=1).collect()] == ["b"]
    assert I.select_for_scoring(posts, scored, "clean_text", refresh_existing=True).count() == 3
    e = I.estimate(posts, scored, "clean_text").first()
    assert (e.to_score, e.total) == (2, 3)


def test_repeated_report_replaces_itself(spark, tmp_dir):
    for run in ("r1", "r2", "r1"):
        St.append_report(spark.range(3).toDF("x"), f"{tmp_dir}/rep", run)
    assert spark.read.parquet(f"{tmp_dir}/rep").count() == 6


def test_one_per_key_is_deterministic(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("j", 0, None)], "key string, n int, s string")
    for p in (1, 3, 7):
        got = sorted(map(tuple, St.one_per_key(df.repartition(p), "key", ["n"]).collect()))
        assert got == [("j", 0, None), ("k", 2, "c")]
