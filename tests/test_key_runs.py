"""The log-structured tables behind the scored, raw and vector tables."""
import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from credlens.operators import runs as Rn
from credlens.operators import store as St

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def rows(spark, ids, label, **more):
    df = spark.createDataFrame([(f"p{i}", label) for i in ids], "post_id string, predicted_label string")
    return df.withColumns({c: F.lit(v) for c, v in more.items()})


def test_upserts_equal_the_join(spark, tmp_dir):
    """Batches of different fields, in any number of runs, read as successive upserts."""
    base, want = f"{tmp_dir}/t", None
    batches = [rows(spark, range(50), "a", note="n0"), rows(spark, [3, 3, 60], "b"),
               rows(spark, [3, 4], None), rows(spark, [4, 61], "c", score=0.5), rows(spark, [50, 3], "d", note=None),
               rows(spark, range(45, 70), "e", score=0.25)]
    for k, batch in enumerate(batches):
        now = F.lit(T0 + dt.timedelta(days=k))
        St.upsert_scored(spark, base, batch.unionByName(rows(spark, [], "x"), allowMissingColumns=True), now=now)
        state = batch.select("post_id").limit(0) if want is None else spark.createDataFrame(want, schema)
        df = St.upsert(state, batch, "post_id", now=now.cast("timestamp_ntz"))
        schema = df.schema
        want = df.collect()
        got = {r.post_id: r.asDict() for r in St.read_scored(spark, base).collect()}
        assert got == {r.post_id: r.asDict() for r in want}
    assert len(Rn.runs(spark, base)) < len(batches)


def test_a_null_key_is_left_out_and_an_empty_batch_changes_nothing(spark, tmp_dir):
    base = f"{tmp_dir}/t"
    St.upsert_scored(spark, base, spark.createDataFrame([("a", 1), (None, 2)], "post_id string, x int"), now=F.lit(T0))
    before = Rn.runs(spark, base)
    assert St.upsert_scored(spark, base, spark.createDataFrame([], "post_id string, x int")) == 0
    assert Rn.runs(spark, base) == before and St.read_scored(spark, base).count() == 1
    assert St.read_scored(spark, f"{tmp_dir}/none") is None and St.read_rows(spark, f"{tmp_dir}/none", "uri") is None


@pytest.mark.parametrize("first", [0, 4000])
def test_written_rows_are_bounded_by_the_batches(spark, tmp_dir, monkeypatch, first):
    """Twenty batches, on an empty and on a large table: what is written,
    merges included, is a small multiple of them; old folders are gone."""
    base, written = f"{tmp_dir}/t", []
    write = Rn._write

    def counted(*args, **kw):
        run = write(*args, **kw)
        written.append(run.rows)
        return run
    if first:
        St.upsert_scored(spark, base, rows(spark, range(first), "old"), now=F.lit(T0))
    monkeypatch.setattr(Rn, "_write", counted)
    n = 0
    for k in range(20):
        n += St.upsert_scored(spark, base, rows(spark, range(k * 5, k * 5 + 20), f"b{k}"), now=F.lit(T1))
    assert n == 400 and sum(written) <= n * (1 + math.log(n / 20, 1.5)) and max(written) < 400
    assert len(Rn.runs(spark, base)) <= Rn.FANOUT + math.log(first + n, 3)
    assert St.read_scored(spark, base).count() == max(first, 115)
    folders = [f for f in os.listdir(base) if f.startswith("r-")]
    assert len(folders) <= Rn.KEEP * (Rn.FANOUT + 1) and len(os.listdir(f"{base}/_versions")) <= 2 * Rn.KEEP


@pytest.mark.parametrize("sizes, want", [([], None), ([5, 5, 5], None), ([5, 5, 5, 5], 0), ([1000, 5, 5, 5], None),
                                         ([1000, 5, 5, 5, 5], 1), ([100, 30, 5, 5, 5], None), ([30, 16, 9, 1, 1], None),
                                         ([30, 16, 9, 3, 2], 0)])
def test_merge_rule(sizes, want):
    assert Rn.merge_from(sizes) == want


def test_unseen_keys_read_no_folder(spark, tmp_dir, monkeypatch):
    base = f"{tmp_dir}/t"
    for k in range(3):
        df = spark.range(k * 20000, (k + 1) * 20000).select(F.concat(F.lit("u"), "id").alias("uri"), F.lit(k).alias("x"))
        St.insert_rows(df, base, "uri")
    assert [r.blocks for r in Rn.runs(spark, base)] == [2, 2, 2]
    read = []
    parquet = type(spark.read).parquet

    def seen(self, *paths, **kw):
        read.extend(p.rsplit("/", 1)[-1] for p in paths)
        return parquet(self, *paths, **kw)
    monkeypatch.setattr(type(spark.read), "parquet", seen)
    unseen = spark.range(500).select(F.concat(F.lit("new"), "id").alias("uri"))
    assert Rn.known_keys(unseen, base, "uri").count() == 0
    assert read and all(p.endswith("-index") for p in read)
    read.clear()
    some = spark.createDataFrame([("u7",), ("u25000",), ("new9",), ("u20001",)], "uri string")
    assert sorted(r.uri for r in Rn.known_keys(some, base, "uri").collect()) == ["u20001", "u25000", "u7"]
    payload = {p for p in read if not p.endswith("-index")}
    assert payload == {r.folder for r in Rn.runs(spark, base)[:2]}


def test_inserts_never_repeat_a_key(spark, tmp_dir):
    base, want = f"{tmp_dir}/t", set()
    for k in range(9):
        ids = range(k * 3, k * 3 + 8)
        df = spark.createDataFrame([(f"u{i}", k) for i in [*ids, *ids]] + [(None, 1)], "uri string, x int")
        assert St.insert_rows(df, base, "uri") == len({f"u{i}" for i in ids} - want)
        want |= {f"u{i}" for i in ids}
    got = [r.uri for r in St.read_rows(spark, base, "uri").collect()]
    assert sorted(got) == sorted(want)
    Rn.compact(spark, base, "uri")
    assert len(Rn.runs(spark, base)) == 1
    assert sorted(r.uri for r in St.read_rows(spark, base, "uri").collect()) == sorted(want)


def test_a_broken_version_folder_raises(spark, tmp_dir):
    St.insert_rows(spark.createDataFrame([("u", 1)], "uri string, x int"), f"{tmp_dir}/t", "uri")
    os.rename(f"{tmp_dir}/t/_versions", f"{tmp_dir}/t/aside")
    with open(f"{tmp_dir}/t/_versions", "w") as f:
        f.write("not a folder")
    with pytest.raises(Exception):
        St.read_rows(spark, f"{tmp_dir}/t", "uri").count()


def test_rows_of_some_keys_come_from_the_runs_that_hold_them(spark, tmp_dir, monkeypatch):
    """The rows of a micro-batch's keys: newest fields, and no folder is read for unseen keys."""
    base = f"{tmp_dir}/t"
    St.upsert_scored(spark, base, rows(spark, range(50), "a"), now=F.lit(T0))
    St.upsert_scored(spark, base, rows(spark, [3, 3, 60], "b"), now=F.lit(T1))
    assert [(r.rows, r.blocks) for r in Rn.runs(spark, base)] == [(50, 1), (2, 1)]
    keys = rows(spark, [3, 7, 60, 99], "x").select("post_id")
    got = {r.post_id: (r.predicted_label, r.created_at) for r in St.read_scored(spark, base, keys).collect()}
    assert got == {"p3": ("b", T0), "p7": ("a", T0), "p60": ("b", T1)}
    frames = []
    newest = Rn._newest
    monkeypatch.setattr(Rn, "_newest", lambda f, key: frames.append(len(f)) or newest(f, key))
    assert St.read_scored(spark, base, rows(spark, [7], "x").select("post_id")).count() == 1 and frames == [1]
    unseen = rows(spark, range(1000, 1020), "x").select("post_id")
    assert St.read_scored(spark, base, unseen).count() == 0 and len(frames) <= 2


def test_a_batch_with_unique_keys_is_written_without_gathering(spark, tmp_dir, monkeypatch):
    gathered = []
    monkeypatch.setattr(St, "one_per_key", lambda rows, key, order=(), f=St.one_per_key: gathered.append(1) or f(rows, key, order))
    assert St.upsert_scored(spark, f"{tmp_dir}/t", rows(spark, range(5), "a"), now=F.lit(T0)) == 5 and not gathered
    assert St.upsert_scored(spark, f"{tmp_dir}/t", rows(spark, [1, 1], "b"), now=F.lit(T0)) == 1 and gathered == [1]
    assert St.read_scored(spark, f"{tmp_dir}/t").count() == 5
