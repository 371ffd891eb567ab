import math
import random
import re

from credlens.llm import license_scan as L


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    w = words_of(text)
    places, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


MIT = next(t for _, _, t in L.TEMPLATES if t.startswith("permission is hereby"))
TEXTS = [None, "", " .,- ", "one", "Released under the MIT License.", "mit license mit license MIT-License",
         "x Licensed under the Apache License, Version 2.0. cc by y CC-BY", "xmit license", "mit licensee",
         "This work is licensed under the GNU General Public License, version 3.", "gnu general public\nlicense",
         "Intro. " + MIT.capitalize() + ". The end.", MIT.replace("free of charge", "for money"),
         "Kelvin mit é license İ MIT LICENSE", "a " * 60_000 + "apache license",
         "permission is hereby granted free of charge to nobody", "Redistribution and use in source and binary forms, "
         "with or without modification, are permitted provided that the following conditions are met:"]


def brute_labels(texts):
    """Labels and score of every text by trying all places of all templates."""
    files = [words_of(t) for t in texts]
    n = len(files)
    out = []
    for w in files:
        labels, score = set(filter(None, brute(" ".join(w))[4].split(","))), 0.0
        for label, keys, template in L.TEMPLATES:
            t = template.split()
            weight = [math.log((1 + n) / (1 + sum(x in set(f) for f in files))) + 1 for x in t]
            rare = [i for i, x in enumerate(weight) if x >= sum(weight) / len(weight) - 1e-9]
            best = max((sum(weight[i] for i in rare if 0 <= at + i < len(w) and w[at + i] == t[i])
                        for at in range(-len(t), len(w))), default=0) / sum(weight[i] for i in rare)
            text = f" {' '.join(w)} "
            if best >= L.SHARE and all(f" {k} " in text for k in keys):
                labels.add(label)
                score = max(score, min(best, 1.0))
        out.append((",".join(sorted(labels)), round(score, 9)))
    return out


def test_labels_by_brute_force(spark):
    rng = random.Random(4)
    texts = ["", None, "free software", "the the the"]
    for k in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(L.TEMPLATES)[2].split()
            damaged = [x if rng.random() > 0.15 * (k % 4) else rng.choice(L.VOCABULARY + ["plain", "prose"]) for x in words]
            parts += damaged[rng.randint(0, 2):] + rng.choices(["plain", "prose", "the", "license", "of"], k=rng.randint(0, 9))
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 9)) for r in L.find_licenses(docs).collect()}
    want = brute_labels(texts)
    assert [got[k] for k in range(len(texts))] == want
    assert len({w[0] for w in want}) > 8


def test_base_and_labels(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x", 1), (None, TEXTS[4], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, place int")
    got = L.find_licenses(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = TEXTS[4 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[11].labels == "mit" and by[11].base_labels == "" and by[11].score > 0.99
    assert by[12].labels == ""                      # its key phrase is not there
    assert by[15].labels == ""                      # a key phrase, but no alignment
    assert by[16].labels == "bsd" and by[4].score > 0.99 and by[9].score > 0.99
    assert by[3].score == 0 and by[0].score == 0
    assert L.find_licenses(docs.limit(0)).collect() == []
