import zlib

import numpy as np

from credlens.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(k, "the cat and the dog" if k % 2 else "le chat et la souris", "en" if k % 2 else "fr", "x")
            for k in range(60)]
    rows += [(100, None, "en", "x"), (101, "", "fr", "x"), (102, "12 34 !?", None, "x"), (103, "the dog", None, "x"),
             (103, "the dog", None, "x"), (None, "le chat", None, "x"), (104, "x" * 200_000, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k in (100, 101, 102):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[103].lang_pred == "en" and by[None].lang_pred == "fr" and by[None].held_out is False
    assert langid.identify(docs.limit(0)).collect() == []
    none = langid.identify(docs.select("doc_id", "text").selectExpr("*", "CAST(NULL AS string) AS lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_grams_stay_in_their_text():
    texts = ["ab", "", "b", "héllo"]
    for one in texts:
        alone = [h.tolist() for h, _ in langid.grams([one])] if one else [[], [], []]
        together = [h[at[texts.index(one)]:at[texts.index(one) + 1]].tolist() for h, at in langid.grams(texts)]
        assert alone == together


def test_temperature_recovers_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert 2.6 < langid.fit_temperature(3 * logits, labels) < 3.4


def test_repeated_rows_do_not_grow_the_sample(spark):
    rows = [(1, "the same text again", "en")] * 300 + [(2, "ein anderer text", "de"), (2, "ein anderer text", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(df).collect()
    assert sorted((r.label, r.order) for r in got) == [("de", 1), ("en", 1)]


def test_without_a_model_texts_with_a_letter_stay(spark):
    rows = [(1, "a", 0), (2, "1 2", 0), (3, None, 0), (4, "\u00e9", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, position int")
    assert langid.train_model(df.selectExpr("doc_id", "text", "'x' AS lang").limit(0)) is None
    got = langid.keep_identified(df, None)
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[3]]
