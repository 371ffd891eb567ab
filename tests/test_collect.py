import datetime as dt

from pyspark.sql import functions as F

from credlens.operators import collect as C
from credlens.sources import schemas

BASE = dt.datetime(2024, 1, 1)


def _raw(spark, rows):
    data = [(u, langs, {"text": t, "embed": None}, None) for u, t, langs in rows]
    return spark.createDataFrame(data, schemas.RAW_POST)


def test_author_filter_languages(spark):
    df = _raw(spark, [("a", "x", None), ("b", "x", []), ("c", "x", ["fr-CA", "en"]),
                      ("d", "x", ["de"]), ("e", "  ", ["en"]), (None, "x", ["en"])])
    got = sorted(r.uri for r in C.filter_author_posts(df, ["en", "fr"]).collect())
    assert got == ["a", "b", "c"]


def test_insert_ignore_and_counts(spark):
    existing = spark.createDataFrame([("u1",)], "uri string")
    batch = _raw(spark, [("u1", "old", ["en"]), ("u2", "new", ["en"]), ("u2", "new again", ["en"]),
                         (None, "no uri", ["en"]), ("u3", "   ", ["en"])])
    now = F.lit(BASE).cast("timestamp_ntz")
    new = C.insert_ignore(existing, batch, now=now)
    assert [r.uri for r in new.collect()] == ["u2"]
    c = C.insert_counts(existing, batch).first()
    assert (c.inserted, c.duplicates, c.skipped_no_uri, c.skipped_empty_text) == (1, 2, 1, 1)


def _rows(spark, n, src="s"):
    return spark.createDataFrame(
        [(f"u{i:03d}", src, BASE + dt.timedelta(hours=i // 3, minutes=i)) for i in range(n)],
        "uri string, source_label string, inserted_at timestamp_ntz")


def test_prune_cap_exact(spark):
    df = _rows(spark, 30).unionByName(_rows(spark, 5, "t"))
    for cap in (5, 7, 30, 40):
        kept = C.prune_cap(df, {"s": cap}, default_cap=3)
        got = sorted(r.uri for r in kept.where("source_label = 's'").collect())
        want = sorted(f"u{i:03d}" for i in range(30))[-cap:] if cap < 30 else sorted(f"u{i:03d}" for i in range(30))
        assert got == want, cap
        assert kept.where("source_label = 't'").count() == 3


def test_prune_retention(spark):
    df = _rows(spark, 10)
    now = BASE + dt.timedelta(days=1)
    assert C.prune_retention(df, 0, now).count() == 10
    kept = C.prune_retention(df, 1, now)
    assert kept.count() == 10
    assert C.prune_retention(df, 1, now + dt.timedelta(hours=23, minutes=30)).count() < 10


def test_prune_retention_keeps_rows_without_time(spark):
    from credlens.plans import q_store as Q
    hand = spark.createDataFrame(list(Q.HAND_ROWS), "uri string, source_label string, ts_text string") \
        .select("uri", "source_label", F.col("ts_text").cast("timestamp_ntz").alias("inserted_at"))
    kept = C.prune_retention(hand, Q.RETENTION_DAYS, BASE + dt.timedelta(days=Q.RETENTION_DAYS, hours=1))
    assert sorted(r.uri for r in kept.collect()) == ["hand/1", "hand/2", "hand/5", "hand/6"]
    assert C.prune_retention(hand, Q.RETENTION_DAYS, BASE).count() == len(Q.HAND_ROWS)


def test_crawl_state_counter(spark):
    rows = []
    # fr: ok, low, low, low -> counter 3, skipped next; en: low then ok
    for i, low in enumerate([False, True, True, True]):
        rows.append(("q", "fr", BASE + dt.timedelta(hours=i), i, None if low else "c0",
                     None if low else f"c{i}", 0 if low else 10))
    rows.append(("q", "en", BASE, 10, None, None, 0))
    rows.append(("q", "en", BASE + dt.timedelta(hours=1), 11, None, "n1", 5))
    log = spark.createDataFrame(rows, "query_name string, lang string, run_ts timestamp_ntz, run_seq long, "
                                      "last_cursor string, new_cursor string, n_posts int")
    s = {r.lang: r for r in C.crawl_state(log).collect()}
    assert s["fr"].low_activity_counter == 3 and s["fr"].skip_next and s["fr"].exhausted
    assert s["fr"].page_budget == 1
    assert s["en"].low_activity_counter == 0 and not s["en"].exhausted
    assert s["en"].last_cursor == "n1" and s["en"].page_budget == 2
