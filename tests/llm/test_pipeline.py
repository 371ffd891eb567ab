import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from credlens.llm import exact_dedup, langid, minhash

from .test_minhash import brute as near_brute
from .test_packing import check
from .test_secret_scan import all_spans

EXTRA = [(900_001, None, "en"), (900_002, "", None), (900_003, "123 456", "fr"), (900_004, "the house and the tree " * 3, None),
         (900_005, "the house and the tree " * 3 + " ", "en"), (None, "a text without an id", "en"),
         (900_006, 'in the word token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and the end', "en")]


def masked(text, spans):
    out, at = "", 0
    for lo, _, hi, _ in spans:
        if lo >= at:
            out += text[at:lo] + "[SECRET]"
        at = max(at, hi)
    return out + text[at:]


def test_stages_are_brute_force(spark, tmp_dir):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(d, t, lang, "x", len(t or "")) for d, t, lang in EXTRA], docs.schema)
    docs = docs.unionByName(extra).selectExpr("*", "1 AS n", "'y' AS kept", "doc_id AS place", "'p' AS position", "0 AS place_file", "0 AS _base",
                                                      "'r' AS _runs", "'t' AS _text", "'s' AS _spans", "'m' AS _metadata")
    docs.write.parquet(f"{tmp_dir}/in")
    docs = spark.read.parquet(f"{tmp_dir}/in")
    at = [{r.doc_id: r for r in docs.collect()}]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_dir}/{k}")
        docs = spark.read.parquet(f"{tmp_dir}/{k}")
        at.append(docs.collect() if k == len(P.STAGES) - 1 else {r.doc_id: r for r in docs.collect()})
    start, spoken, single, apart, clean, pieces = at
    letters = {d for d, r in start.items() if r.text and any(c.isalpha() for c in r.text)}
    assert set(spoken) <= letters and len(spoken) > 0.98 * len(letters)
    groups = {}
    for d, r in spoken.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), d is None, d))
    assert set(single) == {min(g)[2] for g in groups.values()}
    rows = [(d, r.text) for d, r in single.items()]
    component = near_brute(rows, 5)
    assert set(apart) == {d for d in single if d is None or component[d] == d}
    ids = sorted(apart, key=str)
    spans = all_spans([apart[d].text for d in ids])
    for d, s in zip(ids, spans, strict=True):
        assert clean[d].text == masked(apart[d].text, s)
        assert clean[d].n_chars == (len(clean[d].text) if s else apart[d].n_chars)
    table = [(d, r.text) for d, r in clean.items()]
    packed = spark.createDataFrame(table, "doc_id long, text string")
    assert {(r.doc_id, r.start, r.length, r.ids_crc32) for r in pieces} == \
        {(r.doc_id, r.start, r.length, r.ids_crc32) for r in P.packing(spark, packed, sf).collect()}
    from credlens.llm import packing
    check(packing.pack(packed, P.public_tokenizers.path("word_bpe_49k.json")).collect(), table)


def test_dedup_stages_keep_one_row(spark, tmp_dir):
    """Repeated rows, equal texts without an id, and one id with other texts: one row of each group stays."""
    near = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "a text twice"), (1, "a text twice"), (None, "no id"), (None, "no id"), (None, "no  id "), (None, "other"),
            (2, "one id"), (2, "two texts"), (3, near), (3, near), (3, near + " x"), (None, near + " y"), (None, near + " y"),
            (4, None), (4, ""), (None, " ")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    docs.repartition(3).write.parquet(f"{tmp_dir}/twice/part=1")
    stored = spark.read.parquet(f"{tmp_dir}/twice/part=1")
    for table in (stored, docs):
        single = P.exact(spark, table, "")
        assert single.columns == docs.columns
        single.write.mode("overwrite").parquet(f"{tmp_dir}/single")
        want = [(1, "a text twice"), (2, "one id"), (2, "two texts"), (3, near), (3, near + " x"), (None, near + " y"),
                (None, "no  id "), (None, "other")]
        got = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_dir}/single").collect()]
        assert sorted([x for x in got if x[1] and x[1].strip()], key=str) == sorted(want, key=str)
        assert len(got) == len(want) + 1   # of the texts without a letter one
        apart = [(r.doc_id, r.text) for r in P.near(spark, spark.read.parquet(f"{tmp_dir}/single"), "").collect()]
        assert len(apart) == 7 and sum(near in (t or "") for _, t in apart) == 1
        assert [d for d, t in apart if near in (t or "")] == [3]
        alone = [(r.doc_id, r.text) for r in P.near(spark, table, "").collect()]
        assert [d for d, t in alone if near in (t or "")] == [3]
        assert alone.count((1, "a text twice")) == 1 and sum(t in ("no id", "no  id ") for _, t in alone) == 1

    def weak(norm):
        return F.substring(F.sha2(norm, 256), 1, 1)
    assert exact_dedup.drop_copies(stored, weak).count() == 9


def test_empty_table(spark, tmp_dir):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, "").collect() == []
    assert langid.train_model(docs.select("doc_id", "text", "lang")) is None
    assert minhash.drop_near_copies(docs).columns == docs.columns
