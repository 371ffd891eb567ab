import duckdb
import pytest

from credlens.operators import collect as C
from credlens.operators import store as St
from credlens.sources import standins as S
from credlens.streaming import ingest as Ig

from .conftest import SF_SMALL

# fast oracle checks at sf0.001 (the driver runs all of them at sf0.01)
FAST = ["label_source_counts", "clean_text", "dedup_counts", "sentiment_summary", "insert_counts",
        "prune_cap", "crawl_state", "upsert_posts", "incremental_filter", "latest_per_source",
        "tfidf_weights", "score_and_explain", "kmeans_assign", "url_parse", "classification_report"]


def test_stream_ingest_equals_batch_and_replay(spark, tmp_dir):
    docs = S.table(spark, SF_SMALL, "documents")
    stream = Ig.landing_stream(spark, f"{SF_SMALL}/documents.parque[t]", docs.schema, fmt="parquet")
    q = Ig.run_ingest(stream, f"{tmp_dir}/t", f"{tmp_dir}/ck", prepare=S.posts_from_documents)
    q.awaitTermination()
    got = sorted(r.uri for r in St.read_rows(spark, f"{tmp_dir}/t", "uri").collect())
    empty = spark.createDataFrame([], "uri string")
    want = sorted(r.uri for r in C.insert_ignore(empty, S.posts_from_documents(docs)).collect())
    assert got == want
    # replaying the whole input into the same table adds nothing
    n = Ig.insert_batch(S.posts_from_documents(docs), f"{tmp_dir}/t")
    assert n == 0


def test_json_feed_pages(spark, tmp_dir):
    """JSON pages of feed items (wrapped and flat), one page per micro-batch,
    with feed name, language filter, and retention and cap after each insert."""
    import datetime as dt
    import json
    import os

    def item(uri, text, langs, wrapped):
        post = {"uri": uri, "langs": langs, "record": {"text": text}}
        return {"post": post} if wrapped else post
    pages = [[item("u1", "one", ["en"], True), item("u2", "deux", ["fr-CA", "fr"], False), item("u3", "drei", ["de"], True)],
             [item("u1", "one again", ["en"], False), item("u4", "four", [], True), item("u5", " \u00a0 ", ["en"], True)],
             [item("u6", "six", None, False), item("u7", "seven", ["en"], True)]]
    os.makedirs(f"{tmp_dir}/landing")
    for k, page in enumerate(pages):
        with open(f"{tmp_dir}/landing/page{k}.json", "w") as f:
            f.write("\n".join(json.dumps(x) for x in page))
    stream = Ig.landing_stream(spark, f"{tmp_dir}/landing", max_files_per_trigger=1)

    def prune(table):
        young = C.prune_retention(table, 7, dt.datetime(2000, 1, 1))
        return C.prune_cap(young, {"feeds": 4}, 100)
    q = Ig.run_ingest(stream, f"{tmp_dir}/t", f"{tmp_dir}/ck", source_label="feeds", allowed_langs=["en", "fr"],
                      feed_name="science", prune=prune)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    rows = St.read_rows(spark, f"{tmp_dir}/t", "uri").collect()
    assert len(rows) == 4 and {r.uri for r in rows} < {"u1", "u2", "u4", "u6", "u7"}
    assert {(r.source_label, r.feed_name) for r in rows} == {("feeds", "science")}
    assert all(r.record.text != "one again" for r in rows)


def test_json_collections_and_reports(spark, tmp_dir):
    import json
    import os

    from credlens.operators import reports as Rp
    from credlens.sources import raw as R
    for name in ("climate", "news"):
        os.makedirs(f"{tmp_dir}/{name}")
        with open(f"{tmp_dir}/{name}/a.json", "w") as f:
            f.write(json.dumps({"uri": f"{name}/1", "langs": ["en"], "record": {"text": "", "embed": {"record": {
                "record": {"text": "quoted"}}}}}) + "\n")
    raw = R.load_raw_posts(spark, {"climate": f"{tmp_dir}/climate", "news": f"{tmp_dir}/news"})
    from credlens.functions import text as T
    got = sorted((r.uri, r.source_label, r.source_rank, r.t) for r in raw.withColumn("t", T.extract_text("record")).collect())
    assert got == [("climate/1", "climate", 0, "quoted"), ("news/1", "news", 1, "quoted")]
    with open(f"{tmp_dir}/metrics.txt", "w") as f:
        f.write("# HELP x y\nhits_total{a=\"b\"} 2\nhits_total 3.5\nhits_total nan?\n")
    assert Rp.metric_total(R.metric_lines(spark, f"{tmp_dir}/metrics.txt"), "hits_total").first().total == 5.5
    with open(f"{tmp_dir}/run7.csv", "w") as f:
        f.write("timestamp,project,duration,cpu_power,emissions\n2024,p,10.5,42.0,0.1\n2024,p,bad,1,2\n")
    e = sorted(R.energy_report(spark, f"{tmp_dir}/run7.csv").collect(), key=lambda r: r.cpu_power)
    assert (e[1].run_id, e[1].duration, e[1].cpu_power, e[1].emissions, e[1].gpu_power) == ("run7", 10.5, 42.0, 0.1, None)
    assert e[0].duration is None and e[0].cpu_power == 1.0


def test_scoring_stream_of_three_batches(spark, tmp_dir):
    """Three files, three micro-batches: later ones meet the stored table."""
    from pyspark.sql import functions as F

    from credlens.streaming import score as Sc
    docs = S.table(spark, SF_SMALL, "documents")
    for k in range(3):
        docs.where(F.col("doc_id") % 3 <= k).coalesce(1).write.parquet(f"{tmp_dir}/landing/{k}")
    stream = Ig.landing_stream(spark, f"{tmp_dir}/landing/*", docs.schema, fmt="parquet", max_files_per_trigger=1)

    def scorer(df):
        return df.withColumn("predicted_label", F.lit("x")).withColumn("explanation_text", F.lit("y")) \
                 .withColumn("credibility_score", F.lit(0.5))
    q = Sc.run_scoring(stream, f"{tmp_dir}/scored", f"{tmp_dir}/ck", scorer, S.TEST_VERIFIED, prepare=S.posts_from_documents)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 3
    from credlens.operators import prepare as P
    want = {r.post_id for r in P.prepare_posts(S.posts_from_documents(docs), S.TEST_VERIFIED).select("post_id").collect()}
    rows = St.read_scored(spark, f"{tmp_dir}/scored").select("post_id").collect()
    assert sorted(r.post_id for r in rows) == sorted(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 70


def _norm(v):
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    return str(v)


@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, name):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("documents", "events", "labels", "pages", "embeddings", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    df = E.queries()[name](spark, SF_SMALL)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    oorder = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    a = sorted("|".join(_norm(r[i]) for i in order) for r in df.collect())
    b = sorted("|".join(_norm(r[i]) for i in oorder) for r in rel.fetchall())
    assert a == b
