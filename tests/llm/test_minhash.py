import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credlens.llm import minhash


def brute(rows, k):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(minhash.word_set(t, k))
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in ids}


def rows_of(n_families, seed):
    rng = random.Random(seed)
    rows, doc = [], 0
    passage = " ".join(f"shared{j}" for j in range(40))
    for f in range(n_families):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 30 + 2)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            text = " ".join(w)
            if f % 7 == 0:
                text = passage + " " + text
            rows.append((doc, text.upper() if rng.random() < 0.2 else text))
            doc += 1
    chain = [f"c{j}" for j in range(100)]
    for step in range(40):   # neighbours are similar, ends are not
        rows.append((doc, " ".join(chain)))
        chain[(step * 7) % 100] = f"d{step}"
        doc += 1
    return rows + [(doc, None), (doc + 1, ""), (doc + 2, " \t\n"), (doc + 3, "One two"), (doc + 4, "one\vTWO"),
                   (doc + 5, "É a"), (doc + 6, "é a"), (3, rows[3][1]), (None, rows[5][1])]


@pytest.mark.parametrize("block", [3, minhash.BLOCK])
def test_components_are_brute_force(spark, block):
    rows = rows_of(60, 3)
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n long, bucket string")
    got = minhash.components_of(docs, 4, block=block).collect()
    assert len(got) == len(rows)
    want = brute(rows, 4)
    sizes = {(d, len(minhash.word_set(t, 4))) for d, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in got} == sizes
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.drop_near_copies(docs, 4).collect()
    assert len({r.doc_id for r in kept if r.doc_id is not None}) == len(set(want.values()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.components_of(docs, 4).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("abAB \t\n\x0b\x85é "), max_size=30), max_size=5), st.integers(1, 5))
def test_sets_have_the_right_sizes(texts, k):
    got = [len(s) for s in minhash.shingle_sets(pa.array(texts, pa.string()), k)]
    assert got == [len(minhash.word_set(t, k)) for t in texts]


def test_min_max_estimate_is_unbiased():
    rng = np.random.default_rng(5)
    got = []
    for _ in range(200):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (200, 50, 50))
        got.append(minhash.estimate(minhash.signature(np.append(both, a)), minhash.signature(np.append(both, b))))
    assert abs(np.mean(got) - 200 / 300) < 0.01
    # 160 values of 80 evaluations vary less than 80 independent values
    assert np.var(got) < (2 / 9) / 80


def test_common_counts(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 1, 20, 40, 40, 3)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert minhash.common_counts(sets).astype(int).tolist() == want
