"""License scan by a positional index of rare licence words.

The templates' words are weighed by their inverse document frequency over all
documents of the corpus; a template's index entries are its words of above
average weight (its rare words) with their positions.  In each file, the rare
words of a template are taken by falling weight, as many as are needed for
those left over to weigh less than ``SHARE`` of the template: any place that
reaches ``SHARE`` holds one of them.  They are looked up in the index, and
postings of a template meet where position in the file minus position in the
template is the same: an alignment, scored by the weight of the index words
that lie where the template has them.  Last, all mandatory key phrases of a
template that reaches ``SHARE`` must stand in the file, word by word.

Base phrases (``PHRASES``) are labels by themselves.

Only DataFrame functions are used.  Word frequencies are counted over all
documents; the index is as large as the templates and is broadcast.

Defined results: null texts count as empty; texts without words have no
places and score 0; repeated rows are scanned each; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch

#: What separates words, after A-Z are lowered; phrases and labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARE = 0.6

#: Fixed values: (label, mandatory key phrases, text) of public licence notices.
TEMPLATES = (
    ("gpl", ("gnu general public license",),
     "this work is licensed under the gnu general public license version 3"),
    ("gpl", ("gnu general public license",),
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license as published by the free software foundation either version 3 of the license or at your "
     "option any later version"),
    ("gpl", ("gnu general public license",),
     "this program is distributed in the hope that it will be useful but without any warranty without even the "
     "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license "
     "for more details"),
    ("lgpl", ("gnu lesser general public license",),
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
     "general public license as published by the free software foundation"),
    ("apache", ("apache license",), "licensed under the apache license version 2 0"),
    ("apache", ("apache license", "apache org licenses"),
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
     "with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by", ("cc by",), "licensed under cc by 4 0"),
    ("cc-by", ("cc by",), "licensed under cc by nc 4 0"),
    ("cc-by", ("creative commons attribution",),
     "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit", ("mit license",), "released under the mit license"),
    ("mit", ("permission is hereby granted free of charge",),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation "
     "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("bsd", ("redistribution and use in source and binary forms",),
     "redistribution and use in source and binary forms with or without modification are permitted provided that "
     "the following conditions are met"),
    ("isc", ("permission to use copy modify",),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", ("mozilla public license",),
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
     "not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
)
VOCABULARY = sorted({w for _, _, text in TEMPLATES for w in text.split()})
KEY_PHRASES = sorted({p for _, keys, _ in TEMPLATES for p in keys} | set(PHRASES))


def padded_words(text: Column) -> Column:
    """The words of a text, each with a space before it, and a space at the end."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, SEPARATORS, " ")), F.lit(" "))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _holds(words: Column, phrase: str) -> Column:
    return F.contains(words, F.lit(f" {phrase} "))


def _phrase_places(words: Column, n_words: Column, phrase: str) -> Column:
    """struct<n, first, last>: how often a phrase stands, and its first and last word."""
    pieces = F.split(words, f" {phrase}(?= )", -1)
    size = len(phrase.split())
    found = F.struct((F.size(pieces) - 1).cast("long").alias("n"),
                     spaces(F.element_at(pieces, 1)).cast("long").alias("first"),
                     (n_words - spaces(F.element_at(pieces, -1)) + 1 - size).cast("long").alias("last"))
    return F.when(_holds(words, phrase), found)


def scan(docs: DataFrame, rare: list[str]) -> DataFrame:
    """doc_id, n_words, base columns, the key phrases that stand in the file
    (by number), and the places of the ``rare`` words."""
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), padded_words(F.col("text")).alias("words"))
    w = F.col("words")
    n = F.when(w == "  ", F.lit(0)).otherwise(spaces(w) - 1).cast("long")
    counted = split.withColumn("n_words", n)
    places = {label: _phrase_places(w, F.col("n_words"), phrase) for phrase, label in PHRASES.items()}
    stands = F.array_compact(F.array(*[F.when(_holds(w, p), F.lit(k)) for k, p in enumerate(KEY_PHRASES)]))
    each = F.transform(F.split(F.trim(w), " "), lambda x, at: F.struct(at.alias("at"), x.alias("word")))
    found = counted.select("doc_id", "n_words", stands.alias("phrases"), F.filter(each, lambda x: x["word"].isin(rare)).alias("hits"),
                           F.array(*[F.struct(F.lit(label).alias("label"), p.alias("at")) for label, p in places.items()]).alias("places"))
    there = found.withColumn("places", F.filter("places", lambda p: p["at"].isNotNull()))
    return there.select(
        "doc_id", "n_words", "phrases", "hits",
        F.aggregate("places", F.lit(0).cast("long"), lambda acc, p: acc + p["at"]["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"]["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"]["last"])).alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("base"))


def document_frequency(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each template word occurs, and the number of documents.
    The result has a row per template word."""
    n = docs.count()
    words = F.array_distinct(F.split(F.trim(padded_words(F.col("text"))), " "))
    each = docs.select(F.explode(words).alias("word")).filter(F.col("word").isin(VOCABULARY))
    return {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}, n


def index(df: dict[str, int], n: int) -> list[tuple[str, int, int, float, float, float]]:
    """(word, template, position, weight, of the word in the template, total) of the templates' rare words."""
    import math

    rows = []
    for t, (_, _, text) in enumerate(TEMPLATES):
        words = text.split()
        weights = [math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in words]
        mean = sum(weights) / len(weights)
        # equal weights are all rare, whatever their mean rounds to
        rare = [(w, t, i, x) for i, (w, x) in enumerate(zip(words, weights, strict=True)) if x >= mean - 1e-9]
        total = sum(x for *_, x in rare)
        rows += [(*r, sum(x for w, *_, x in rare if w == r[0]), total) for r in rare]
    return rows


INDEX = "word string, template int, position int, weight double, of_word double, total double"


def looked_up(hits: DataFrame, rare: DataFrame) -> DataFrame:
    """(place, template, word): each file's words of highest weight, so many
    that the template's other words in it weigh less than ``SHARE``.  A file
    has a row per word of a template here, however often it occurs."""
    entries = rare.select("template", "word", "weight", "of_word", "total").distinct()
    own = hits.select("place", "word").distinct().join(F.broadcast(entries), "word")
    falling = Window.partitionBy("place", "template").orderBy(F.desc("weight"), "word")
    rest = F.sum("of_word").over(Window.partitionBy("place", "template")) \
        - F.coalesce(F.sum("of_word").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return own.withColumn("rest", rest).filter(F.col("rest") >= SHARE * F.col("total") - 1e-9).select("place", "template", "word")


def alignments(scanned: DataFrame, rare: DataFrame) -> DataFrame:
    """Per file (``place``) its verified labels and its best share."""
    hits = scanned.select("place", F.explode("hits").alias("h")).select("place", "h.word", "h.at")
    shift = (F.col("at") - F.col("position")).alias("shift")
    seeds = looked_up(hits, rare)
    postings = hits.join(F.broadcast(rare.select("word", "template", "position", "weight", "total")), "word")
    # a template that a file cannot reach has no words to look up
    postings = postings.join(seeds.select("place", "template").distinct(), ["place", "template"], "left_semi") \
        .select("place", "template", "word", shift, "weight", "total")
    met = postings.join(seeds, ["place", "template", "word"], "left_semi").select("place", "template", "shift").distinct()
    shares = postings.join(met, ["place", "template", "shift"], "left_semi").groupBy("place", "template", "shift") \
        .agg((F.sum("weight") / F.first("total")).alias("share"))
    best = shares.groupBy("place", "template").agg(F.max("share").alias("share")).filter(F.col("share") >= SHARE)
    verified = F.lit(False)
    label = F.lit(None).cast("string")
    for t, (name, keys, _) in enumerate(TEMPLATES):
        needed = F.array(*[F.lit(KEY_PHRASES.index(k)) for k in keys])
        verified = verified | ((F.col("template") == t) & (F.size(F.array_except(needed, F.col("phrases"))) == 0))
        label = F.when(F.col("template") == t, F.lit(name)).otherwise(label)
    there = best.join(scanned.select("place", "phrases"), "place").filter(verified)
    return there.groupBy("place").agg(F.collect_set(label).alias("found"), F.max("share").alias("share"))


def find_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row."""
    spark = docs.sparkSession
    path = scratch(spark, "licenses")
    entries = index(*document_frequency(docs))
    # a row's place in the stored table stands for it: ids may repeat
    scan(docs, sorted({e[0] for e in entries})).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    scanned = spark.read.parquet(path)
    found = alignments(scanned, spark.createDataFrame(entries, INDEX))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    return scanned.join(found, "place", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.least(F.lit(1.0), F.coalesce("share", F.lit(0.0))).alias("score"))
