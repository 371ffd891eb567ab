from collections import Counter

from credlens.operators import language as G

TRAIN = [("en", "the man and the dog"), ("en", "that thing there"), ("fr", "le chien et la maison"), ("fr", "les chats dans la rue"),
         ("ja", "猫が好き \U0001f600x"), (None, "the the the"), ("en", ""), ("en", None), ("en", "that thing there")]
POSTS = [(1, "the other thing", None), (2, "la maison et les chiens", []), (3, "", []), (4, None, []), (5, "zzz", []),
         (6, "the other thing", ["fr"]), (7, "猫が", []), (8, "x", []), (None, "la maison", []), (2, "la maison et les chiens", [])]


def grams(t):
    s = f" {t} "
    return [s[i:i + 3] for i in range(len(s) - 2)] if t else []


def profiles(rows, top):
    counts = {}
    for lang, t in rows:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
    return {lang: {g: k + 1 for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top])} for lang, c in counts.items()}


def guess(t, fitted, top):
    scores = {lang: sum(top + 1 - ranks[g] for g in grams(t) if g in ranks) for lang, ranks in fitted.items()}
    best = min(((-s, lang) for lang, s in scores.items() if s > 0), default=None)
    return best[1] if best else "en"


def test_profiles_and_guesses_are_brute_force(spark):
    train = spark.createDataFrame(TRAIN, "lang string, clean_text string")
    posts = spark.createDataFrame(POSTS, "post_id long, clean_text string, langs array<string>")
    for top in (5, 300):
        want = profiles(TRAIN, top)
        fitted = G.fit_profiles(train, top=top)
        assert {(r.lang, r.gram, r["rank"]) for r in fitted.collect()} == {(a, g, k) for a, c in want.items() for g, k in c.items()}
        got = G.with_profiled_language(posts, fitted, top=top)
        assert got.columns == [*posts.columns, "lang_detected"]
        rows = sorted((r.post_id or 0, r.lang_detected) for r in got.collect())
        # a null key meets no guess
        assert rows == sorted((k or 0, langs[0] if langs else "en" if k is None else guess(t, want, top)) for k, t, langs in POSTS)


def test_no_profiles_give_the_default(spark):
    posts = spark.createDataFrame(POSTS, "post_id long, clean_text string, langs array<string>")
    none = G.fit_profiles(spark.createDataFrame([], "lang string, clean_text string"))
    assert {r.lang_detected for r in G.with_profiled_language(posts, none, default="xx").collect()} == {"xx", "fr"}
    assert G.with_profiled_language(posts.limit(0), none).collect() == []


def test_long_text_is_read_whole(spark):
    train = spark.createDataFrame(TRAIN, "lang string, clean_text string")
    t = "zzz " * 50_000 + "la maison"
    posts = spark.createDataFrame([(1, t, None)], "post_id long, clean_text string, langs array<string>")
    assert G.with_profiled_language(posts, G.fit_profiles(train)).first().lang_detected == "fr"


def test_guess_makes_no_row_a_trigram(spark):
    train = spark.createDataFrame(TRAIN, "lang string, clean_text string")
    posts = spark.createDataFrame(POSTS, "post_id long, clean_text string, langs array<string>")
    for df in (G.profile_guess(posts, G.fit_profiles(train)), G.fit_profiles(train)):
        assert "substr" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "sequence(" not in plan


def test_many_characters_in_a_piece(spark):
    from credlens.operators import trigram_blocks as B
    many = [(lang, "".join(chr(0x4e00 + (k * 37 + lang_n * 1000) % 3000) for k in range(2000))) for lang_n, lang in enumerate("ab")]
    train = spark.createDataFrame(many, "lang string, clean_text string")
    want = profiles(many, 300)
    fitted = G.fit_profiles(train)
    assert {(r.lang, r.gram, r["rank"]) for r in fitted.collect()} == {(a, g, k) for a, c in want.items() for g, k in c.items()}
    rows = [(r.lang, r.gram, 301 - r["rank"]) for r in fitted.collect()]
    assert B.Profiles(rows).base ** 3 > B.TABLE
    got = G.profile_guess(train.withColumnRenamed("lang", "post_id"), fitted).collect()
    assert {(r.post_id, r.guess) for r in got} == {("a", "a"), ("b", "b")}
