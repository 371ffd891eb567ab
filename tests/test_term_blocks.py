"""Terms are counted post by post inside tasks: no row per (post, term) is shuffled."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from credlens.operators import explain as X
from credlens.operators import features as Ft
from credlens.operators import term_blocks as B

WORDS = [["a1", "b1", "a1", "b1"], [], None, ["b1"], ["a1", "a1", "a1"], ["c1", "b1", "a1"]]


def _terms(words):
    return Counter(words + [f"{x} {y}" for x, y in zip(words, words[1:])])


def test_pieces_cover_all_posts():
    words = pa.array(WORDS, pa.list_(pa.string()))
    for size in (1, 3, 4, 100):
        found = [x for p in B.pieces(words, size) for x in p.to_pylist()]
        assert found == WORDS


def test_counts_and_weights(monkeypatch):
    words = pa.array(WORDS, pa.list_(pa.string()))
    for size in (2, 1000):
        monkeypatch.setattr(B.pieces, "__defaults__", (size,))
        df, cf = Counter(), Counter()
        for b in B.frequencies(words):
            for r in b.to_pylist():
                df[r["term"]] += r["df"]
                cf[r["term"]] += r["cf"]
        each = [_terms(w or []) for w in WORDS]
        assert cf == sum(each, Counter())
        assert df == Counter(t for c in each for t in c)
        vocab, idf = ["a1", "a1 b1", "zz"], np.array([1.5, 2.0, 3.0])
        for c, got in zip(each, B.weighted(words, pa.array(vocab), idf, {"coef": np.array([1.0, -1.0, 0.0])}).to_pylist()):
            v = {t: c[t] * i for t, i in zip(vocab, idf) if c[t]}
            n = sum(x * x for x in v.values()) ** 0.5
            assert [g["term"] for g in got] == sorted(v)
            assert all(abs(g["weight"] - v[g["term"]] / n) < 1e-12 for g in got)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_of_terms(spark):
    p = spark.createDataFrame([("p1", "red apple pie red apple"), ("p2", ""), ("p3", "red apple"), (None, "blue pie")],
                              "post_id string, clean_text string")
    vocab, words = Ft.fit_tfidf(p, max_features=50, min_df=1)
    vocab = vocab.checkpoint()
    assert {(r.term, r.df, r.cf) for r in Ft.document_frequency(words).collect()} >= {("red apple", 2, 3), ("red", 2, 3), ("blue pie", 1, 1)}
    w = Ft.tfidf_weights(words, vocab)
    c = X.binary_contributions(p, vocab, spark.createDataFrame([("red", 0.5)], "term string, coef double"))
    for df in (w, c):
        assert not any(op in _plan(df) for op in ("Exchange", "Sort ", "Window", "Aggregate"))
    assert {r.post_id for r in w.collect()} == {"p1", "p3", None}
    norms = w.groupBy("post_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-12 for r in norms)
    by = {r.post_id: r for r in c.collect()}
    assert len(by) == 4 and by["p2"].margin1 == 0.0 and by["p2"].top1 == []
    assert [t.term for t in by["p3"].top1] == ["red"] and by["p3"].top0 == []


def test_enrichment_from_the_posts_own_row(spark, monkeypatch):
    from credlens.operators import lexicon as L
    texts = ["this is not good at all", "very bad news and fear", "", "la ville est tres belle", "x1 y2"]
    p = spark.createDataFrame([(f"p{i}", t, "fr" if "ville" in t else "en") for i, t in enumerate(texts)],
                              "post_id string, clean_text string, lang_detected string")
    in_row = L.enrich(p)
    assert not any(op in _plan(in_row) for op in ("Exchange", "Sort ", "Aggregate", "Join"))
    monkeypatch.setattr(L, "IN_ROW_MAX_ROWS", 0)

    def rows(df):
        return sorted(((r.post_id, r.tokens, None if r.sentiment is None else round(r.sentiment, 9), r.emotion_scores,
                        r.emotion_ranked, r.dominant_emotion, r.emotion_status) for r in df.collect()), key=str)
    by_join = L.enrich(p)
    assert in_row.columns == by_join.columns
    got = rows(in_row)
    assert got == rows(by_join) and [r[1] for r in got if r[0] == "p2"] == [None]
    assert any(r[2] for r in got)


def test_repeated_lexicon_rows_count_each(spark, monkeypatch):
    from credlens.operators import lexicon as L
    lex = spark.createDataFrame([("en", "good", False, None, 0.5), ("en", "good", False, "gut", 1.0), (None, "good", True, None, 0.0)],
                                "lang2 string, w string, is_stop boolean, lemma string, polarity double")
    mods = spark.createDataFrame([("en", "not", -1.0), ("en", "not", -0.5)], "lang2 string, prev string, factor double")
    p = spark.createDataFrame([("p", "good not good", "en")], "post_id string, clean_text string, lang_detected string")
    one = L.enrich(p, lexicon=lex, modifiers=mods).first()
    monkeypatch.setattr(L, "IN_ROW_MAX_ROWS", 0)
    two = L.enrich(p, lexicon=lex, modifiers=mods).first()
    assert one.tokens == two.tokens and abs(one.sentiment - two.sentiment) < 1e-12
    assert one.emotion_status == two.emotion_status and one.dominant_emotion == two.dominant_emotion


def test_keywords_of_carried_clusters_need_no_join_of_weights(spark):
    from credlens.operators import clustering as K
    a = spark.createDataFrame([("p1", 0), ("p2", 0), ("p3", 1)], "post_id string, cluster int")
    w = spark.createDataFrame([("p1", "x", 1.0), ("p2", "x", 0.6), ("p2", "y", 0.8), ("p3", "y", 1.0)],
                              "post_id string, term string, weight double")
    carried = w.join(a, "post_id").drop("post_id").checkpoint()
    got = {tuple(r) for r in K.centroid_keywords(a, carried).collect()}
    assert got == {tuple(r) for r in K.centroid_keywords(a, w).collect()} and len(got) == 3


def test_batches_of_words_equal_words_one_by_one(spark):
    """Other scripts, line ends and blanks, where the engines' letters may differ, included."""
    from credlens.operators import lexicon as L
    texts = ["not good \n bad\n", "中文 good हि not happy", "a  b ", "fear1 fear children cities", "naïve good", "", None]
    p = spark.createDataFrame([(f"{i}{l}", t, l) for i, t in enumerate(texts) for l in ("en", "fr")],
                              "post_id string, clean_text string, lang_detected string")
    lex, mods = L.word_lexicon(spark), L.modifier_table(spark)
    names = ["post_id", "tokens", "sentiment", "emo_hits"]
    one, many = (sorted(f(p, lex, mods).select(*names).collect(), key=str) for f in (L._one_by_one, L._in_row))
    assert one == many and any(r.emo_hits for r in one) and sum(r.tokens is None for r in one) == 4
