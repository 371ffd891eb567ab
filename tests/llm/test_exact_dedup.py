import hashlib
import re
import tempfile

from pyspark.sql import functions as F

from credlens.llm import exact_dedup as X

TABLE = [(1, "a b"), (2, "ab"), (3, "a  b "), (4, None), (5, ""), (6, " \t\n\x0b\f\r"), (7, "ä"), (8, "a\u00a0b"),
         (9, "x" * 70_000), (10, "x" * 70_000), (10, "x" * 70_000), (None, "a b"), (None, "only"), (12, "é\U0001f600"),
         (11, "é \U0001f600")]


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, t or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for d, _ in members:
            out.append((d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", 1, True) for a, b in rows],
                                 "doc_id long, text string, digest string, group_size int, kept boolean")


def test_groups_are_brute_force(spark):
    got = X.dedup(frame(spark, TABLE)).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()
    assert sorted(map(tuple, got), key=str) == brute(TABLE)
    assert X.dedup(frame(spark, [])).collect() == []
    kept = X.drop_copies(frame(spark, TABLE))
    assert kept.columns == ["doc_id", "text", "digest", "group_size", "kept"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 6, 7, 8, 9, 11]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["only"]


def test_false_hits_are_told_apart(spark):
    def weak(norm):
        return F.substring(F.sha2(norm, 256), 1, 1)
    got = X.dedup(frame(spark, TABLE), digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:4] for r in brute(TABLE)), key=str)


def test_state_meets_earlier_feeds(spark):
    base = tempfile.mkdtemp(prefix="credlens-test-", dir="/tmp")
    rows = [(k, f"text {k % 5}") for k in range(30)]
    for part in (rows[:10], rows[10:20], rows[20:]):
        X.digest_feed(frame(spark, part)).write.mode("append").parquet(f"{base}/feed")
        X.run_state(spark, f"{base}/feed", base, batch_bytes=1)   # one file a batch
    got = X.stored_groups(spark, base).collect()
    assert sorted((r.keep_id, r.group_size) for r in got) == [(k, 6) for k in range(5)]
    X.run_state(spark, f"{base}/feed", base)                      # nothing new: nothing changes
    assert sorted((r.keep_id, r.group_size) for r in X.stored_groups(spark, base).collect()) == [(k, 6) for k in range(5)]


def test_smallest_long_as_id(spark):
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "a b"), (5, "ab "), (7, "c")], "doc_id long, text string")
    got = {r.doc_id: r.keep_id for r in X.dedup(df).collect()}
    assert got == {least: least, 5: least, 7: 7}
