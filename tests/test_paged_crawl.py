"""The paged source and the crawl state kept by a stream."""
import datetime as dt
import json
import os
import random

import pytest

from credlens.operators import collect as C
from credlens.operators import store as St
from credlens.streaming import crawl as Cr
from credlens.streaming import ingest as Ig


def land(path, chain, cursor, uris, following):
    folder = f"{path}/chain={chain}/cursor={cursor}"
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/part-0.json", "w") as f:
        for u in uris:
            f.write(json.dumps({"uri": u, "langs": ["en"], "record": {"text": f"text of {u}", "embed": None},
                                "next_cursor": following, "likes": 3}) + "\n")


def run(spark, tmp_dir, pages):
    q = Ig.run_ingest(Ig.paged_stream(spark, f"{tmp_dir}/pages", pages), f"{tmp_dir}/t", f"{tmp_dir}/ck", allowed_langs=["en"])
    q.awaitTermination()
    t = St.read_rows(spark, f"{tmp_dir}/t", "uri")
    return {} if t is None else {r.uri: (r.chain, r.cursor) for r in t.collect()}


def test_budget_restart_and_ends(spark, tmp_dir):
    path = f"{tmp_dir}/pages"
    land(path, "a", "start", ["a1", "a2"], "x")
    land(path, "a", "x", ["a3"], "y")
    land(path, "a", "y", ["a4", "a1"], "z")
    land(path, "b", "start", ["b1"], None)                 # a chain of one page
    os.makedirs(f"{path}/chain=c/cursor=start")            # an empty page
    assert run(spark, tmp_dir, 2) == {"a1": ("a", "start"), "a2": ("a", "start"), "a3": ("a", "x"), "b1": ("b", "start")}
    # resumed at the cursors in the checkpoint; the page behind y has not landed yet
    assert set(run(spark, tmp_dir, 2)) == {"a1", "a2", "a3", "a4", "b1"}
    assert len(run(spark, tmp_dir, 2)) == 5
    land(path, "a", "z", ["a5"], None)
    land(path, "c", "start", ["c1"], "k")
    land(path, "d", "start", ["d1"], "")
    got = run(spark, tmp_dir, 2)
    assert set(got) == {"a1", "a2", "a3", "a4", "a5", "b1", "c1", "d1"} and got["a1"] == ("a", "start")
    assert len(run(spark, tmp_dir, 2)) == 8


LOG = "query_name string, lang string, run_ts timestamp_ntz, run_seq long, last_cursor string, new_cursor string, n_posts int"


@pytest.mark.parametrize("late", [False, True])
def test_stream_is_the_batch_at_every_prefix(spark, tmp_dir, late):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        low = rng.random() < 0.6
        cursor = None if low else f"c{k}"
        rows.append((f"q{rng.randrange(2)}", rng.choice(["en", "fr"]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k // 2), k,
                     cursor, cursor, 0 if low else 9))
    if late:
        rng.shuffle(rows)
    seen = []
    for part in range(4):
        new = rows[part * 15:(part + 1) * 15]
        seen += new
        spark.createDataFrame(new, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/log")
        Cr.run_crawl_state(spark, lambda s: s.readStream.schema(LOG).parquet(f"{tmp_dir}/log"),
                           f"{tmp_dir}/t", f"{tmp_dir}/ck").awaitTermination()
        want = C.crawl_state(spark.createDataFrame(seen, LOG))
        got = Cr.read_crawl_state(spark, f"{tmp_dir}/t").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_pages_are_few_tasks_and_walked_once(tmp_dir, monkeypatch):
    from credlens.sources import paged as P
    n = 40 * P.TASKS
    for k in range(n):
        land(f"{tmp_dir}/pages", "a", "start" if k == 0 else f"p{k}", [f"a{k}"], f"p{k + 1}" if k + 1 < n else None)
    source = P.PagedPosts({"path": f"{tmp_dir}/pages", "maxPages": str(1 << 30)})
    reader = source.streamReader(None)
    end = reader.latestOffset()
    monkeypatch.setattr(P, "_first_line", lambda f: pytest.fail("a page was opened again"))
    parts = reader.partitions(reader.initialOffset(), end)
    assert len(parts) == P.TASKS and [c for p in parts for _, c in p.pages] == ["start", *[f"p{k}" for k in range(1, n)]]
    assert end == {"a": P.END} and reader.following == {}
