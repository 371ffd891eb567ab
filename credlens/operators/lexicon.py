"""Language, tokens, sentiment and emotions from lexicon tables (O-81..O-86).

Per-word libraries of the original are re-aimed as lexicon joins: the words
of each post are exploded once, looked up in small broadcast lexicon tables
(fixed, bounded size) and folded back per post with one aggregate keyed by
``post_id``.  When the input comes out of ``dedup_first`` it is already
hash-partitioned by ``post_id``, so neither the aggregate nor the join back
adds an exchange.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed, text

# lexicon tables above this many rows are joined with a shuffle, not broadcast
BROADCAST_MAX_ROWS = 1_000_000
# lexicon tables up to this many rows are looked up inside each post's own row
IN_ROW_MAX_ROWS = 100_000


def _small(df: DataFrame, known_rows: int | None = None) -> DataFrame:
    """Broadcast a lexicon only behind a size check."""
    n = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if n <= BROADCAST_MAX_ROWS else df


# ----------------------------------------------------------------------------
# lexicon tables (constant)
# ----------------------------------------------------------------------------
def stopword_table(spark: SparkSession) -> DataFrame:
    rank = {l: i for i, l in enumerate(fixed.LANG_ORDER)}
    rows = [(l, w, rank[l]) for l, w in fixed.stopword_rows()]
    return spark.createDataFrame(rows, "lang string, term string, lang_rank int")


_WORDS = T.StructType([
    T.StructField("lang2", T.StringType()), T.StructField("w", T.StringType()),
    T.StructField("is_stop", T.BooleanType()), T.StructField("lemma", T.StringType()),
    T.StructField("polarity", T.DoubleType()),
    T.StructField("emotions", T.ArrayType(T.StructType([
        T.StructField("emotion", T.StringType()), T.StructField("rank", T.IntegerType())]))),
])


@functools.cache
def _word_rows() -> tuple:
    stops = {(l, w) for l, w in fixed.stopword_rows() if l in ("en", "fr")}
    lemmas = {(l, f): m for l, f, m in fixed.lemma_rows()}
    pol = {(l, t): p for l, t, p in fixed.sentiment_rows()}
    emo: dict[str, list[tuple[str, int]]] = {}
    for t, e, r in fixed.emotion_rows():
        emo.setdefault(t, []).append((e, r))
    keys = set(stops) | set(lemmas) | set(pol) | {(l, t) for t in emo for l in ("en", "fr")}
    return tuple((l, w, (l, w) in stops, lemmas.get((l, w)), pol.get((l, w)),
                  [(e, r) for e, r in emo.get(w, [])] or None)
                 for l, w in sorted(keys))


def word_lexicon(spark: SparkSession) -> DataFrame:
    """(lang2, w) -> is_stop, lemma, polarity, emotions; lang2 in {en, fr}."""
    return spark.createDataFrame(list(_word_rows()), _WORDS)


def modifier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.modifier_rows(), "lang2 string, prev string, factor double")


# ----------------------------------------------------------------------------
# language
# ----------------------------------------------------------------------------
def with_language(df: DataFrame, stop_words: Mapping[str, Sequence[str]] | None = None,
                  default: str = "en") -> DataFrame:
    """``lang_detected`` = first declared language, else the language whose
    stop words occur most often in the clean text (ties: language order),
    else ``default``.  The guess looks up each post's own words, a batch of
    posts at a time, and only of posts without a declared language."""
    stop = stop_words if stop_words is not None else {l: fixed.STOP_WORDS[l] for l in fixed.LANG_ORDER}
    declared = text.first_lang("langs")
    langs, known = list(stop), sorted({w for l in stop for w in stop[l]})
    of = np.array([[w in set(stop[l]) for l in langs] for w in known], "float64").reshape(len(known), len(langs))

    @F.arrow_udf("string")
    def guess(clean: pa.Array) -> pa.Array:
        clean = pc.if_else(pc.equal(clean, ""), pa.scalar(None, clean.type), clean)
        words = pc.split_pattern(clean, " ")
        code = pc.index_in(words.flatten(), value_set=pa.array(known, clean.type))
        post = np.repeat(np.arange(len(words)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        hit = pc.is_valid(code).to_numpy(zero_copy_only=False)
        post, code = post[hit], code.drop_null().to_numpy()
        n = np.stack([np.bincount(post, of[code, k], len(words)) for k in range(len(langs))])
        # the first of the largest
        return pa.array(np.array(langs, object)[n.argmax(axis=0)], pa.string(), mask=n.max(axis=0) <= 0)
    guessed = guess(F.when(declared.isNull(), F.col("clean_text"))) if langs else F.lit(None).cast("string")
    return df.withColumn("lang_detected", F.coalesce(declared, guessed, F.lit(default)))


# ----------------------------------------------------------------------------
# tokens, sentiment, emotions in one pass over the words
# ----------------------------------------------------------------------------
def _lang2(lang: Column) -> Column:
    return F.when(lang.startswith("fr"), "fr").otherwise("en")


def word_table(df: DataFrame, key: str = "post_id") -> DataFrame:
    """(key, lang2, pos, w, prev) one row per word of the clean text."""
    step = df.select(key, _lang2(F.col("lang_detected")).alias("lang2"),
                     text.words("clean_text").alias("_ws"))
    pairs = F.transform(F.col("_ws"), lambda x, i: F.struct(
        x.alias("w"), F.when(i > 0, F.get(F.col("_ws"), i - 1)).alias("prev")))
    # posexplode_outer + filter keeps the optimizer from pushing an inferred
    # size(...) > 0 test under the projection (which would rebuild the pairs)
    return (step.select(key, "lang2", F.posexplode_outer(pairs).alias("pos", "_p"))
                .where(F.col("pos").isNotNull())
                .select(key, "lang2", "pos", "_p.w", "_p.prev"))


def _lemma() -> Column:
    """Of a word (lang2, w) and its row of the lexicon."""
    return F.coalesce(F.col("lemma"), text.suffix_lemma(F.col("lang2"), F.col("w")))


def with_lemma(words: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``words`` (lang2, w) with ``lemma``: by the lexicon's exceptions, else
    by the longest listed ending, else the word itself."""
    lex = lexicon if lexicon is not None else word_lexicon(words.sparkSession)
    lex = lex.select("lang2", "w", "lemma")
    return words.join(_small(lex, None if lexicon is not None else 1000), ["lang2", "w"], "left").withColumn("lemma", _lemma())


def enrichment_table(df: DataFrame, key: str = "post_id", lexicon: DataFrame | None = None,
                     modifiers: DataFrame | None = None) -> DataFrame:
    """Per post: tokens, sentiment, emotion hits (one aggregate).  A token is
    the word's lemma: by the lexicon's exceptions, else by its ending."""
    spark = df.sparkSession
    lex = lexicon if lexicon is not None else word_lexicon(spark)
    mods = modifiers if modifiers is not None else modifier_table(spark)
    if "emotions" not in lex.columns:
        lex = lex.withColumn("emotions", F.lit(None).cast("array<struct<emotion: string, rank: int>>"))
    w = word_table(df, key)
    w = w.join(_small(lex, None if lexicon is not None else 1000), ["lang2", "w"], "left")
    w = w.join(_small(mods, None if modifiers is not None else 100), ["lang2", "prev"], "left")
    keep = ~F.coalesce(F.col("is_stop"), F.lit(False)) & F.col("w").rlike(fixed.ALPHA_PATTERN)
    adj = F.when(F.col("polarity").isNotNull(),
                 F.greatest(F.lit(-1.0), F.least(F.lit(1.0),
                            F.col("polarity") * F.coalesce(F.col("factor"), F.lit(1.0)))))
    agg = w.groupBy(key).agg(
        F.collect_list(F.when(keep, F.struct("pos", _lemma().alias("t")))).alias("_toks"),
        F.sum(adj).alias("_pol_sum"),
        F.count(adj).alias("_pol_n"),
        F.flatten(F.collect_list("emotions")).alias("emo_hits"),
    )
    return agg.select(
        key,
        F.transform(F.array_sort("_toks"), lambda s: s["t"]).alias("tokens"),
        F.when(F.col("_pol_n") > 0, F.col("_pol_sum") / F.col("_pol_n"))
         .otherwise(F.lit(0.0)).alias("sentiment"),
        "emo_hits",
    )


def _by_key(table: DataFrame, key: Sequence[str], values: Sequence[str]) -> tuple[list[str], DataFrame]:
    """The keys of a lexicon ("lang2 word") and, as one row, an array with the
    list of each key's rows (``values``) in the same order."""
    groups: dict[str, list] = {}
    for r in table.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).select(*key, *values).collect():
        groups.setdefault(" ".join(r[k] for k in key), []).append(tuple(r[v] for v in values))
    kind = T.ArrayType(T.ArrayType(table.select(*values).schema))
    one = table.sparkSession.createDataFrame([(list(groups.values()),)], T.StructType([T.StructField("rows", kind)]))
    return list(groups), one


def _places(keys: list[str], lang: Column, words: Column) -> Column:
    """For each word the place of (lang, word) in ``keys``, NULL where it is not there."""
    @F.arrow_udf("array<int>")
    def places(lang: pa.Array, words: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
        flat = words.flatten()
        named = pc.binary_join_element_wise(lang.take(pa.array(np.repeat(np.arange(len(words)), n))), flat, pa.scalar(" ", flat.type))
        found = pc.index_in(named, value_set=pa.array(keys, flat.type))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), found)
    return places(lang, words)


def _row_words(rows: Sequence[Mapping], mods: Sequence[Mapping], kind: pa.DataType) -> Callable[[pa.Array, pa.Array, pa.Array], pa.Array]:
    """Of texts, their languages (en or fr) and, where the engines' letter classes
    may differ, which words are letters only, the struct of tokens, sentiment and
    emo_hits, as ``_in_row`` has them.  Each distinct word of a batch is looked up
    once in ``rows`` and ``mods``, which have a word once."""
    lex_keys, mod_keys = [f"{r['lang2']} {r['w']}" for r in rows], [f"{r['lang2']} {r['prev']}" for r in mods]
    # the last place stands for words without a row
    stop = np.array([bool(r["is_stop"]) for r in rows] + [False])
    lemmas = [r["lemma"] for r in rows] + [None]
    polarity = np.array([np.nan if r["polarity"] is None else r["polarity"] for r in rows] + [np.nan], "float64")
    valued = np.array([r["polarity"] is not None for r in rows] + [False])
    factor = np.array([1.0 if r["factor"] is None else r["factor"] for r in mods] + [1.0], "float64")
    fields = [f.name for f in kind.value_type]
    emotions = [None if r["emotions"] is None else [None if e is None else dict(zip(fields, e)) for e in r["emotions"]] for r in rows] + [None]
    endings = {lang: list(fixed.lemma_suffixes(lang)) for lang in ("en", "fr")}
    letters = fixed.LEMMA_LETTERS

    def run(clean: pa.Array, lang: pa.Array, letter: pa.Array) -> pa.Array:
        clean = pc.if_else(pc.equal(clean, ""), pa.scalar(None, clean.type), clean)
        split = pc.split_pattern(clean, " ")
        n = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.string())
        word, post = coded.indices.to_numpy(zero_copy_only=False).astype("int64"), np.repeat(np.arange(len(n)), n)
        french = pc.fill_null(pc.equal(lang, "fr"), False).to_numpy(zero_copy_only=False).astype("int64")
        # every distinct word in both languages: the English ones, then the French ones
        at, width = french[post] * len(names) + word, len(names)
        alpha = pc.match_substring_regex(names, r"^\p{L}+$").to_numpy(zero_copy_only=False)
        long = pc.utf8_length(names).to_numpy(zero_copy_only=False)
        place, by, lemma = [], [], []
        for name in ("en", "fr"):
            named = pc.binary_join_element_wise(pa.scalar(name), names, pa.scalar(" "))
            for out, keys in ((place, lex_keys), (by, mod_keys)):
                found = pc.fill_null(pc.index_in(named, value_set=pa.array(keys, pa.string())), len(keys))
                out.append(found.to_numpy(zero_copy_only=False))
            of, open_ = names, np.ones(width, bool)
            for ending, instead in endings[name]:
                hit = open_ & pc.ends_with(names, ending).to_numpy(zero_copy_only=False) & (long - len(ending) + len(instead) >= letters)
                if hit.any():
                    stem = pc.utf8_slice_codeunits(names.filter(pa.array(hit)), 0, -len(ending))
                    of = pc.replace_with_mask(of, pa.array(hit), pc.binary_join_element_wise(stem, pa.scalar(instead), pa.scalar("")))
                    open_ &= ~hit
            lemma.append(pc.coalesce(pa.array(lemmas, pa.string()).take(pa.array(place[-1])), of))
        place, by, lemma = np.concatenate(place), np.concatenate(by), pa.concat_arrays(lemma)
        alpha = alpha[word]
        given = letter.is_valid().to_numpy(zero_copy_only=False)[post]
        alpha[given] = letter.flatten().to_numpy(zero_copy_only=False)
        kept = alpha & ~stop[place][at]
        ends = np.concatenate([[0], np.cumsum(np.bincount(post[kept], minlength=len(n)))])
        empty = pa.array(n == 0)
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lemma.take(pa.array(at[kept])), mask=empty)
        here = place[at]
        some = np.flatnonzero(valued[here])
        first = np.concatenate([[True], post[1:] != post[:-1]]) if len(post) else np.zeros(0, bool)
        times = np.where(first[some], 1.0, factor[by[at[some - 1]]]) if len(some) else np.zeros(0)
        value = np.fmax(-1.0, np.fmin(1.0, polarity[here[some]] * times))
        total, count = np.bincount(post[some], value, len(n)), np.bincount(post[some], minlength=len(n))
        sentiment = pa.array(np.where(count > 0, total / np.maximum(count, 1), 0.0), mask=n == 0)
        lists = pa.array(emotions, kind)
        felt = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)[here])
        hits = lists.take(pa.array(here[felt]))
        sizes = pc.list_value_length(hits).to_numpy(zero_copy_only=False) if len(felt) else np.zeros(0, int)
        ends = np.concatenate([[0], np.cumsum(np.bincount(post[felt], sizes, len(n)).astype("int64"))])
        emo = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), hits.flatten(), type=kind, mask=empty)
        return pa.StructArray.from_arrays([tokens, sentiment, emo], names=["tokens", "sentiment", "emo_hits"])
    return run


#: Texts with other than Latin characters, or with line ends, before which $ matches in Java only.
_OTHER_LETTERS = rf"{text.NOT_LATIN}|[\n\r\x{{85}}\x{{2028}}\x{{2029}}]"


def _in_row(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame) -> DataFrame:
    """``df`` with tokens, sentiment and emo_hits, as ``enrichment_table`` has
    them, each row from its own words: small lexicons are collected and sent to
    the tasks, and no row per word is aggregated, sorted or shuffled.  Texts are
    worked off in batches; where a word has several rows, one by one."""
    rows = lexicon.where("lang2 IS NOT NULL AND w IS NOT NULL").select("lang2", "w", "is_stop", "lemma", "polarity", "emotions").collect()
    mods = modifiers.where("lang2 IS NOT NULL AND prev IS NOT NULL").select("lang2", "prev", "factor").collect()
    if len({(r["lang2"], r["w"]) for r in rows}) < len(rows) or len({(r["lang2"], r["prev"]) for r in mods}) < len(mods):
        return _one_by_one(df, lexicon, modifiers)
    return _in_batches(df, rows, mods, lexicon.schema["emotions"].dataType)


def _in_batches(df: DataFrame, rows: Sequence[Mapping], mods: Sequence[Mapping], emotions: T.DataType) -> DataFrame:
    run = F.arrow_udf(_row_words(rows, mods, to_arrow_type(emotions)),
                      f"struct<tokens: array<string>, sentiment: double, emo_hits: {emotions.simpleString()}>")
    clean = F.col("clean_text")
    # most texts are ASCII, which is quickly seen
    special = (F.octet_length(clean) != F.char_length(clean)) | clean.contains("\n") | clean.contains("\r")
    letter = F.when(special & clean.rlike(_OTHER_LETTERS), F.transform(text.words(clean), lambda w: w.rlike(fixed.ALPHA_PATTERN)))
    # it passes through a generator, so that the optimizer computes it once for all uses
    x = df.select("*", F.explode_outer(F.array(run("clean_text", _lang2(F.col("lang_detected")), letter))).alias("_b"))
    return x.select(*df.columns, "_b.tokens", "_b.sentiment", "_b.emo_hits")


def _one_by_one(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame) -> DataFrame:
    """``_in_row`` in expressions."""
    lex_keys, lex = _by_key(lexicon, ["lang2", "w"], ["is_stop", "lemma", "polarity", "emotions"])
    mod_keys, mod = _by_key(modifiers, ["lang2", "prev"], ["factor"])
    lang2 = _lang2(F.col("lang_detected"))
    x = df.withColumn("_lang2", lang2).withColumn("_ws", text.words("clean_text"))
    x = x.withColumn("_at", _places(lex_keys, F.col("_lang2"), F.col("_ws"))) \
         .withColumn("_by", _places(mod_keys, F.col("_lang2"), F.col("_ws"))) \
         .withColumn("_lex", lex.scalar()).withColumn("_mod", mod.scalar())
    no_lex, no_mod = (F.array(F.lit(None).cast(o.schema["rows"].dataType.elementType.elementType)) for o in (lex, mod))

    def looked_up(w: Column, i: Column) -> Column:
        mods = F.coalesce(F.when(i > 0, F.get(F.col("_mod"), F.get(F.col("_by"), i - 1))), no_mod)
        return F.flatten(F.transform(F.coalesce(F.get(F.col("_lex"), F.get(F.col("_at"), i)), no_lex), lambda e: F.transform(
            mods, lambda m: F.struct(i.alias("pos"), w.alias("w"), e.alias("e"), m["factor"].alias("factor")))))
    x = x.withColumn("_r", F.when(F.size("_ws") > 0, F.flatten(F.transform("_ws", looked_up)))).drop("_lex", "_mod", "_at", "_by", "_ws")

    def lemma(r: Column) -> Column:
        return F.coalesce(r["e"]["lemma"], text.suffix_lemma(F.col("_lang2"), r["w"]))

    def keep(r: Column) -> Column:
        return ~F.coalesce(r["e"]["is_stop"], F.lit(False)) & r["w"].rlike(fixed.ALPHA_PATTERN)

    def adjusted(r: Column) -> Column:
        p = r["e"]["polarity"] * F.coalesce(r["factor"], F.lit(1.0))
        return F.when(r["e"]["polarity"].isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p)))
    toks = F.transform(F.filter("_r", keep), lambda r: F.struct(r["pos"].alias("pos"), lemma(r).alias("t")))
    x = x.withColumn("_pol", F.filter(F.transform("_r", adjusted), lambda p: p.isNotNull()))
    total = F.aggregate("_pol", F.lit(0.0), lambda acc, p: acc + p)
    return x.select(
        *df.columns, F.transform(F.array_sort(toks), lambda s: s["t"]).alias("tokens"),
        F.when(F.size("_pol") > 0, total / F.size("_pol")).when(F.col("_r").isNotNull(), F.lit(0.0)).alias("sentiment"),
        F.flatten(F.filter(F.transform("_r", lambda r: r["e"]["emotions"]), lambda e: e.isNotNull())).alias("emo_hits"))


def emotion_columns(hits: Column) -> dict[str, Column]:
    """emotion_scores map, ranked array and dominant emotion from the hits."""
    total = F.size(hits)
    scored = F.transform(F.array_distinct(hits), lambda e: F.struct(
        e["emotion"].alias("emotion"), e["rank"].alias("rank"),
        (F.size(F.filter(hits, lambda h: h["emotion"] == e["emotion"])) / total).alias("score")))
    ordered = F.sort_array(F.transform(scored, lambda s: F.struct(
        (-s["score"]).alias("neg_score"), s["rank"].alias("rank"),
        s["emotion"].alias("emotion"), s["score"].alias("score"))))
    return {
        "emotion_scores": F.map_from_entries(F.transform(scored, lambda s: F.struct(s["emotion"], s["score"]))),
        "emotion_ranked": F.transform(ordered, lambda s: F.struct(s["emotion"].alias("emotion"),
                                                                  s["score"].alias("score"))),
        "dominant_emotion": F.when(total > 0, F.get(ordered, 0)["emotion"]).otherwise("unknown"),
    }


def enrich(df: DataFrame, key: str = "post_id", lexicon: DataFrame | None = None,
           modifiers: DataFrame | None = None) -> DataFrame:
    """Adds tokens, sentiment, emotion_scores, emotion_ranked,
    dominant_emotion, emotion_status.  Needs ``clean_text`` and
    ``lang_detected``.  A lexicon without a column ``emotions`` gives no
    scores, ``unknown`` and the status ``nrcl_ex_unavailable``."""
    known = lexicon is None or "emotions" in lexicon.columns
    spark = df.sparkSession
    first = [key, *[c for c in df.columns if c != key]]
    cols = {n: F.when(F.col("emo_hits").isNotNull(), c) for n, c in emotion_columns(F.col("emo_hits")).items()}
    cols = [F.col("tokens"), F.col("sentiment"), *[c.alias(n) for n, c in cols.items()]]
    if lexicon is None and modifiers is None and len(_word_rows()) <= IN_ROW_MAX_ROWS:
        # known here, a word once: no job for them
        rows, mods = ([dict(zip(names, r)) for r in table] for names, table in (
            (_WORDS.names, _word_rows()), (("lang2", "prev", "factor"), fixed.modifier_rows())))
        out = _in_batches(df, rows, mods, _WORDS["emotions"].dataType).select(*first, *cols)
    else:
        lex = lexicon if lexicon is not None else word_lexicon(spark)
        mods = modifiers if modifiers is not None else modifier_table(spark)
        if all(t.limit(IN_ROW_MAX_ROWS + 1).count() <= IN_ROW_MAX_ROWS for t in (lex, mods)):
            if not known:
                lex = lex.withColumn("emotions", F.lit(None).cast("array<struct<emotion: string, rank: int>>"))
            out = _in_row(df, lex, mods).select(*first, *cols)
        else:
            e = enrichment_table(df, key, lex, mods).select(key, *cols)
            out = df.join(e, key, "left").select(*first, *[c for c in e.columns if c != key])
    return out.withColumn(
        "emotion_status",
        F.when(F.coalesce(F.col("clean_text"), F.lit("")) == "", fixed.EMOTION_NO_TEXT)
         .otherwise(fixed.EMOTION_OK if known else fixed.EMOTION_UNAVAILABLE))


def enrich_posts(df: DataFrame, key: str = "post_id") -> DataFrame:
    return enrich(with_language(df), key=key)

