"""The vocabulary counts exactly, but only terms that can be among the first."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from credlens.operators import features as Ft
from credlens.operators import term_blocks as B


def brute(posts, max_features, min_df):
    df, cf = Counter(), Counter()
    for words in posts:
        terms = [*(words or []), *(" ".join(p) for p in zip(words or [], (words or [])[1:]))]
        cf.update(terms)
        df.update(set(terms))
    first = sorted((t for t in cf if df[t] >= min_df), key=lambda t: (-cf[t], t))[:max_features]
    return [(t, df[t], cf[t]) for t in first]


def top(spark, posts, max_features, min_df, monkeypatch):
    """The result, and for each count the terms it was made of."""
    counted, whole = [], Ft.document_frequency

    def seen(words, heavy=None):
        d = whole(words, heavy)
        counted.append(d.count())
        return d
    monkeypatch.setattr(Ft, "document_frequency", seen)
    df = spark.createDataFrame([(p,) for p in posts], "words array<string>").repartition(3)
    rows = Ft.fit_vocabulary(df, len(posts), max_features, min_df).collect()
    return sorted(((r.term, r.df, r.cf) for r in rows), key=lambda r: (-r[2], r[0])), counted


def test_rare_terms_are_not_counted(spark, monkeypatch):
    rng = np.random.default_rng(4)
    posts = [[f"w{int(v)}" for v in rng.zipf(1.3, 60) % 5000] for _ in range(300)] + [None, [], ["w1"]]
    got, counted = top(spark, posts, 40, 2, monkeypatch)
    assert got == brute(posts, 40, 2)
    assert len(counted) == 1 and counted[0] < len(brute(posts, 10 ** 9, 1)) / 10


@pytest.mark.parametrize("max_features", [3, 50, 10 ** 7])
def test_a_guess_that_is_too_high_is_lowered(spark, monkeypatch, max_features):
    """Frequent words of one post each are no terms, and those that are occur twice."""
    posts = [[f"own{i}"] * 500 for i in range(60)] + [[f"a{i}", f"b{i}"] for i in range(20)] * 2
    got, counted = top(spark, posts, max_features, 2, monkeypatch)
    assert got == brute(posts, max_features, 2) and len(got) == min(max_features, 60)


def test_no_posts(spark):
    assert Ft.fit_vocabulary(spark.createDataFrame([], "words array<string>"), 0).collect() == []


def test_buckets_are_those_of_the_term_in_any_piece():
    one, two = pa.array([["x", "y", "x", "y"]]), pa.array([["q", "x", "y"], ["y"]])

    def of(words):
        post, number, table = B.numbered(words)
        return dict(zip(B.terms(words)[1].to_pylist(), B.buckets(number, table).tolist()))
    a, b = of(one), of(two)
    assert {"x", "y", "x y"} <= set(a) & set(b) and all(a[t] == b[t] for t in set(a) & set(b)) and a["x y"] != a["y x"]
    assert B.loads([one, two]).sum() == 7 + 5 + 1
