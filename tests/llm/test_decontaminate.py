import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from credlens.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(doc, items, window):
    w = words(doc)
    hit, found = set(), set()
    for item, text in items:
        v = words(text)
        size = min(window, len(v))
        for i in range(len(v) - size + 1) if item is not None and v else ():
            for j in range(len(w) - size + 1):
                if w[j:j + size] == v[i:i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def table(seed):
    rng = np.random.default_rng(seed)
    say = ["Der", "ÉTÉ", "a", "b", "the", "x9", "日本"]

    def text(n):
        return "".join(say[rng.integers(len(say))] + [" ", "\n", ", ", "--"][rng.integers(4)] for _ in range(n))
    items = [(k, text(int(rng.integers(1, 30)))) for k in range(12)] + [(3, text(14)), (None, "a b"), (50, None), (51, "!"), (52, "zzz")]
    docs = [text(int(rng.integers(0, 60))) for _ in range(30)]
    for k in range(20):
        cut = words(items[k % 12][1])
        docs.append(f"{text(5)} {' . '.join(cut[k % 3:])} {text(3)}")
    docs += [None, "", "...", docs[30], docs[30], "zzz " * 3, "a " * 40]
    return [(k if k % 7 else None, t) for k, t in enumerate(docs)], items


@pytest.mark.parametrize("window, small", [(3, True), (10, False), (4, False)])
def test_hits_are_brute_force(spark, monkeypatch, window, small):
    if small:      # several shards, portions, blocks of items and pieces
        for name, value in (("SHARD_BYTES", 500), ("PORTION_WORDS", 16), ("ITEM_BYTES", 300), ("PIECE_WORDS", 8)):
            monkeypatch.setattr(D, name, value)
    docs, items = table(5)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hit", F.lit(1)).withColumn("file", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(d, b, window).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *brute(t, items, window))) for i, t in docs)


def test_removal_keeps_clean_rows(spark):
    docs, items = table(6)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit("kept"))
    got = D.remove_contaminated(d, spark.createDataFrame(items, "item_id long, text string"), 4)
    assert got.columns == ["doc_id", "text", "row"]
    assert sorted(map(repr, map(tuple, got.select("doc_id", "text").collect()))) == \
        sorted(repr(x) for x in docs if not brute(x[1], items, 4)[4])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(map(tuple, D.contamination(docs, none).collect())) == [(1, 2, 0, 0, empty, False), (2, 0, 0, 0, empty, False)]
    assert D.contamination(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert D.longest_matches(docs, none).collect() == []


def test_longest_matches(spark):
    docs = [(1, "x a b c d e y"), (2, "a b c"), (3, "c d e f a b c d")]
    got = D.longest_matches(spark.createDataFrame(docs, "doc_id long, text string"),
                            spark.createDataFrame([(7, "a b c d e f")], "item_id long, text string"), 3)
    assert sorted((r.doc_id, r.item_word, r.doc_word, r.n_words) for r in got.collect()) == \
        [(1, 0, 1, 5), (2, 0, 0, 3), (3, 0, 4, 4), (3, 2, 0, 4)]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    words_ = np.append(rng.integers(-1, 4, 400), np.full(D.ORDER, -1)).astype(np.int32)
    got = D.suffix_array(words_, np.flatnonzero(words_ >= 0))
    keys = [tuple(words_[k:k + D.ORDER]) for k in got]
    assert keys == sorted(keys) and len(got) == (words_ >= 0).sum()
