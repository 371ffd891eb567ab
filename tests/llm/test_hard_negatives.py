import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from credlens.llm import hard_negatives as H


def brute(rows, step):
    ok = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(v).all():
            ok.append((i, [math.floor(256 * float(x)) for x in v], label))
    out = []
    for a, (i, x, label) in enumerate(ok):
        if i % step:
            continue
        others = [(sum(p * q for p, q in zip(x, y)), j, m) for b, (j, y, m) in enumerate(ok) if b != a and len(x) == len(y)]
        others.sort(key=lambda r: (-r[0], r[1]))
        for score, j, _ in [r for r in others if r[2] == label][:5]:
            fit = [r for r in others if r[2] != label and 50 * score <= 100 * r[0] <= 95 * score][:3]
            out += [(i, j, k + 1, r[1], score, r[0]) for k, r in enumerate(fit)]
    return sorted(out)


def table(seed):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for f in range(25):
        base = rng.normal(size=8)
        for _ in range([1, 3, 20][f % 3]):
            v = base + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.5])
            rows.append((k, np.float32(v / np.linalg.norm(v)).tolist(), int(rng.integers(4))))
            k += 1
    rows += [(k, None, 1), (k + 1, [None] * 8, 1), (k + 2, [float("nan")] * 8, 1), (k + 3, rows[0][1], None), (None, rows[0][1], 1),
             (k + 4, [1.0, 2.0], 0), (k + 5, [1.0, 1.5], 1), (k + 6, [1.0, 2.0], 0), (k + 7, [], 0), (k + 8, [], 0), (k + 9, [], 1),
             rows[10], rows[10], (k + 10, [float("inf")] + [0.0] * 7, 2)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], m) for i, v, m in rows]


@pytest.mark.parametrize("block, batch", [(8, 5), (512, 8192)])
def test_result_is_brute_force(spark, block, batch):
    rows = table(1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit("x"))
    got = H.mine(df, F.col("vec_id") % 4 == 0, block=block, batch=batch)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4)


def test_empty_and_huge(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert H.mine(empty, F.col("vec_id") % 4 == 0).collect() == []
    rows = [(0, [1e6, 1.0], 0), (1, [1e6, 0.0], 0), (2, [7e5, 3.0], 1)]
    got = H.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, 1 << 40)


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2)])
def test_the_curve_goes_from_cell_to_neighbour(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    order = sorted(range(len(cells)), key=lambda k: H.hilbert_keys(cells, bits)[k].tobytes())
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_all_products_and_skip_blocks(spark, tmp_dir):
    rng = np.random.default_rng(5)
    a, x = rng.integers(-256, 256, (20, 6)).astype(float), rng.integers(-256, 256, (50, 6)).astype(float)
    low, high = H.score_bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    assert (low <= (a @ x.T)).all() and (high >= (a @ x.T)).all()
    rows = [(k, (np.eye(4)[k // 200] + rng.normal(size=4) * 0.02).tolist(), k % 3) for k in range(800)]
    blocks = H.write_blocks(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), tmp_dir,
                            F.col("vec_id") % 50 == 0, block=32)
    anchors = next(H.anchor_batches(blocks, tmp_dir))
    q = H.Batch(anchors)
    n = len(anchors)
    q.searches(np.arange(n), True, np.full(n, H.LEAST), np.full(n, H.LARGEST), 5)
    q.floor[:] = 60000
    needed = blocks.select("block", "low", "high", "least_id", "names") \
        .mapInArrow(H._needed(spark.sparkContext.broadcast(q)), H.NEEDED).collect()
    pairs = sum(len(r.searches) for r in needed)
    assert 0 < pairs < n * blocks.count() / 2
