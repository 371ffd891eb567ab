from collections import Counter

import numpy as np
import pytest

from credlens.llm import embedding_dedup as E


def brute(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
          and np.isfinite(v).all() and np.any(v)]
    n = len(ok)
    links, parent = np.zeros(n, int), list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(n):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for k in range(n):
        least[find(k)] = min(least.get(find(k), ok[k][0]), ok[k][0])
    out = Counter((ok[k][0], int(links[k]), least[find(k)]) for k in range(n))
    rest = Counter(i for i, _ in rows) - Counter(i for i, _ in ok)
    for i, m in rest.items():
        out[(i, 0, i)] += m
    return out


def table(seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for f in range(40):
        base = rng.normal(size=16)
        for _ in range([1, 2, 6, 30][f % 4]):
            v = base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.3, 0.45])
            rows.append((k, (v * rng.choice([1.0, 2.0])).astype(np.float32).tolist()))
            k += 1
    far = [(k, None), (k + 1, []), (k + 2, [0.0] * 16), (k + 3, [None] + [1.0] * 15), (k + 4, [float("nan")] * 16),
           (k + 5, [float("inf")] + [0.0] * 15), (k + 6, [1.0, 2.0]), (k + 7, [2.0, 4.0]), (None, [1.0, 2.0]),
           (3, rows[3][1]), (k, None), (k + 8, [1e-30, 2e-30]), (k + 9, [-0.0, 1.0]), (k + 10, [0.0, 1.0])]
    return rows + far


@pytest.mark.parametrize("block", [8, 1024])
def test_links_are_brute_force(spark, block):
    rows = table(4)
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<float>, class string, n int")
    got = E.near_copies(df, block=block).collect()
    single = [(a, None if b is None else [None if x is None else float(np.float32(x)) for x in b]) for a, b in rows]
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute(single)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert E.near_copies(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_recall_of_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    n, dim = 3000, 32
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=(n, dim))
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * o
    k, tables = E.parameters(50_000)
    assert ((E.table_keys(a, k, tables) == E.table_keys(b, k, tables)).any(axis=1)).mean() > 0.999
    assert np.array_equal(E.table_keys(a[:7], k, tables, 3), E.table_keys(a, k, tables)[:7, :3])


def test_two_vectors_under_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [1.0, 0.01]), (4, [1.0, 0.02])]
    got = E.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
