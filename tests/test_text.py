from pyspark.sql import functions as F

from credlens.functions import text
from credlens.sources import schemas


def _clean(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(text.clean_text("t")).first()[0]


def test_clean_text_rules(spark):
    assert _clean(spark, "RT @Été_9 voir http://x.y/é? #Climat L'été, c’est  chaud!") == "rt voir lete cest chaud"
    assert _clean(spark, "https://example.org/only-a-link") == ""
    assert _clean(spark, "@someone") == ""
    assert _clean(spark, "   \t  ") == ""
    assert _clean(spark, "Straße Œuvre naïve") == "strasse oeuvre naive"


def test_extract_text_fallbacks(spark):
    rows = [
        ("a", {"text": "own", "embed": None}),
        ("b", {"text": "", "embed": {"record": {"record": {"text": "quoted"}}}}),
        ("c", None),
        ("d", {"text": None, "embed": None}),
    ]
    df = spark.createDataFrame(
        [(u, None, r, None) for u, r in rows], schemas.RAW_POST)
    got = dict(df.select("uri", text.extract_text("record").alias("t")).collect())
    assert got == {"a": "own", "b": "quoted", "c": "", "d": ""}


def test_first_lang_and_words(spark):
    df = spark.createDataFrame([(["fr-CA", "en"], "a bb"), ([], ""), (None, "x")],
                               "langs array<string>, c string")
    r = df.select(text.first_lang("langs").alias("l"), text.words("c").alias("w")).collect()
    assert [x.l for x in r] == ["fr-CA", None, None]
    assert [x.w for x in r] == [["a", "bb"], [], ["x"]]


def test_other_scripts_are_spelled_in_ascii(spark):
    from credlens.plans.q_prepare import HAND_CLEAN, HAND_TEXTS
    want = dict(HAND_CLEAN)
    for uri, s in HAND_TEXTS:
        assert _clean(spark, s) == want.get(uri, ""), uri
    assert _clean(spark, "漢字 ok") == "漢字 ok"     # not covered: stays
    assert _clean(spark, None) is None


def test_lemmas_by_exception_and_ending(spark):
    from credlens.operators import lexicon as L
    from credlens.plans.q_enrich import HAND_LEMMAS
    df = spark.createDataFrame([r[:2] for r in HAND_LEMMAS], "lang2 string, w string")
    assert {tuple(r) for r in L.with_lemma(df).select("lang2", "w", "lemma").collect()} == set(HAND_LEMMAS)


def test_removals_of_a_batch_are_the_rule_step_by_step(spark):
    import random
    r = random.Random(2)
    chars = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070))] + [*"ab c@#_1", "http", "http://x.y ", "@a", "#b", "  ", "½"]
    texts = ["".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(3000)] + [None, "", "漢字 ab"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower("t")
    for pattern in (text.fixed.URL_PATTERN, text.fixed.MENTION_PATTERN, text.fixed.HASHTAG_PATTERN):
        low = F.regexp_replace(low, pattern, "")
    assert df.select("t", text.clean_text("t").alias("a"), text._finish(low).alias("b")).where("NOT (a <=> b)").collect() == []


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_latin_texts_pass_no_regex_a_character_and_unread_text_is_not_shuffled(spark):
    from credlens.plans.q_prepare import posts
    SF_SMALL = "/root/testdata/sf0.001"
    assert "ArrowEvalPython" in _plan(posts(spark, SF_SMALL))
    first = next(x for x in _plan(posts(spark, SF_SMALL).select("uri")).split("\n") if "partial_min_by" in x)
    assert "clean_text" not in first


def test_stop_words_are_looked_up_in_batches(spark):
    from credlens.operators import lexicon as L
    rows = [("the cat and the dog", None), ("le chat et la rue", []), ("la la", []), ("zzz", None), ("", None), (None, None),
            ("the", ["fr"]), (" the  le ", []), ("la la", None)]
    df = spark.createDataFrame(rows, "clean_text string, langs array<string>")
    got = L.with_language(df)
    assert "array_contains" not in _plan(got)
    assert [r.lang_detected for r in got.collect()] == ["en", "fr", "fr", "en", "en", "en", "fr", "en", "fr"]
    assert {r.lang_detected for r in L.with_language(df, {}, "xx").collect()} == {"xx", "fr"}
