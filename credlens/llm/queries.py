"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, decontaminate, embedding_dedup, exact_dedup, hard_negatives, langid, license_scan, minhash,
               packing, prefix_trie, secret_scan, sharding, warc)
from .common import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f
    return put


_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v[{g}] >> {s} & 31) + 1, 1)"
    for g in range(1, 9) for s in (15, 10, 5, 0))


@register("op1_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     h AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
     v AS (SELECT *, list_transform(range(0, 8), lambda g:
                list_sum(list_transform(range(0, 5), lambda d: (strpos('0123456789abcdef', substr(hex, 5 * g + d + 1, 1)) - 1)
                     << (4 * (4 - d))))::BIGINT) AS v,
                  min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM h)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM v""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as legacy archives, converted to WARC, the WARC archives read back."""
    base = scratch(spark, "op1")
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("key"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    warc.write_arc(pages, f"{base}/arc")
    warc.convert(spark, f"{base}/arc", f"{base}/warc")
    return warc.read_warc(spark, f"{base}/warc", with_payload=False).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)


@register("op4_exact_dedup", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"), located=True) \
        .select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@register("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


@register("op10_language_id")
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


_REACH = """sides AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     reach(id, root) AS (SELECT id, id FROM n UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.id),
     c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1)"""


@register("op3_minhash", rf"""
WITH RECURSIVE w AS (
       SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
              ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
     n AS (SELECT id, len(s) AS n FROM s),
     e AS (SELECT id, unnest(s) AS x FROM s),
     p AS (SELECT a.id AS a, b.id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
     {_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM n JOIN c USING (id)""")
def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components_of(table(spark, sf_dir, "documents"), k=4)


@register("op9_embedding_dedup", f"""
WITH RECURSIVE n AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
     ok AS (SELECT * FROM n WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(v, lambda x: x <> 0)) > 0),
     l AS (SELECT a.id AS a, b.id AS b FROM ok a JOIN ok b ON a.id < b.id AND len(a.v) = len(b.v)
           WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.9),
     {_REACH},
     d AS (SELECT a AS id, count(*) AS n_links FROM sides GROUP BY 1)
SELECT id AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, id = component_id AS kept
FROM n JOIN c USING (id) LEFT JOIN d USING (id)""")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"))


@register("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def _values(rows: list[tuple], columns: str) -> str:
    text = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return f"(VALUES {text}) AS x({columns})"


_PLACES = ", ".join(
    f"list_transform(list_filter(range(0, len(w) - {len(p.split()) - 1}), lambda i: w[i + 1:i + {len(p.split())}] = {p.split()!r}), "
    f"lambda i: {{'pos': i, 'label': '{label}'}})" for p, label in license_scan.PHRASES.items())


@register("op6_license_scan", rf"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, list_filter(string_split_regex(
              translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), '{license_scan.SEPARATORS}'),
              lambda x: x <> '') AS w FROM documents),
     b AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS words, flatten([{_PLACES}]) AS base FROM d),
     f AS (SELECT word, count(*) AS n FROM (SELECT place, unnest(list_distinct(w)) AS word FROM d) GROUP BY 1),
     t AS (SELECT x.template, x.position, x.word,
                  ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(f.n, 0))) + 1 AS weight
           FROM {_values([(t, i, w) for t, (_, _, text) in enumerate(license_scan.TEMPLATES) for i, w in enumerate(text.split())],
                         "template, position, word")} LEFT JOIN f USING (word)),
     r AS (SELECT *, sum(weight) OVER (PARTITION BY template) AS total FROM (
             SELECT *, avg(weight) OVER (PARTITION BY template) AS mean FROM t) WHERE weight >= mean - 1e-9),
     k AS (SELECT * FROM {_values([(t, label, f" {p} ", len(keys)) for t, (label, keys, _) in enumerate(license_scan.TEMPLATES) for p in keys],
                                  "template, label, phrase, needed")}),
     v AS (SELECT place, template, label FROM b JOIN k ON contains(b.words, k.phrase)
           GROUP BY place, template, label, needed HAVING count(*) = needed),
     u AS (SELECT place, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word FROM b
           WHERE place IN (SELECT place FROM v)),
     h AS (SELECT place, template, sum(weight) / first(total) AS share FROM u JOIN r USING (word) GROUP BY place, template, pos - position),
     g AS (SELECT place, template, max(share) AS share FROM h GROUP BY 1, 2 HAVING max(share) >= {license_scan.SHARE}),
     m AS (SELECT place, list(DISTINCT label) AS found, max(share) AS share FROM g JOIN v USING (place, template) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, len(base)::BIGINT AS n_base,
       list_min(list_transform(base, lambda x: x.pos))::BIGINT AS first_word,
       list_max(list_transform(base, lambda x: x.pos))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda x: x.label), coalesce(found, [])))), ',') AS labels,
       round(least(1.0, coalesce(share, 0.0)), 6) AS score
FROM b LEFT JOIN m USING (place)""")
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("score", F.round("score", 6))


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"""


@register("op11_prefix_trie", f"""
WITH t AS (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
                  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
     o AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, k) AS own, ({_CRC32} % 6)::BIGINT AS h FROM t GROUP BY conv_id),
     c AS (SELECT a.conv_id, list_concat(coalesce(b.own[:a.h], []), a.own[a.h + 1:]) AS turns
           FROM o a LEFT JOIN o b ON b.conv_id = a.conv_id - a.conv_id % 100),
     m AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM c),
     n AS (SELECT turns[:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
           FROM m GROUP BY 1, 2),
     k AS (SELECT n.*, p.conv_id AS parent_conv_id,
                  (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.path[:n.depth] = n.path) AS n_children
           FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
     u AS (SELECT path, n_children, (n_convs - 1) * coalesce(length(path[-1].text), 0) AS saved, unnest(range(0, depth + 1)) AS d FROM k),
     s AS (SELECT path[:d] AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
           FROM u GROUP BY 1, 2)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM k JOIN s USING (path, depth)""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_tree(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


_WORDS = f"""list_filter(string_split_regex(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
              '{license_scan.SEPARATORS}'), lambda x: x <> '')"""


@register("op12_decontamination", rf"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, {_WORDS} AS w FROM documents),
     i AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
     v AS (SELECT DISTINCT item_id, size, array_to_string(w[k + 1:k + size], ' ') AS x
           FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS k FROM (SELECT *, least({decontaminate.WINDOW}, len(w)) AS size FROM i)
                 WHERE size > 0)),
     s AS (SELECT DISTINCT size FROM v),
     p AS (SELECT place, size, k, array_to_string(w[k + 1:k + size], ' ') AS x
           FROM (SELECT *, unnest(range(0, len(w) - size + 1)) AS k FROM d, s WHERE len(w) >= size)),
     o AS (SELECT place, item_id, size, k FROM p JOIN v USING (size, x)),
     h AS (SELECT place, count(DISTINCT k + j)::BIGINT AS n_hit, count(DISTINCT item_id) AS n_items,
                  string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
           FROM (SELECT *, unnest(range(0, size)) AS j FROM o) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (place)""")
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_hard_negatives", """
WITH v AS (SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CASE WHEN isfinite(x) THEN floor(256 * x::DOUBLE) END) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
     ok AS (SELECT * FROM v WHERE len(list_filter(q, lambda x: x IS NULL)) = 0),
     s AS (SELECT a.place AS a, a.vec_id AS anchor_id, b.vec_id AS other_id, b.place AS b, a.label = b.label AS same,
                  list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
           FROM ok a JOIN ok b ON a.place <> b.place AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
     p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) AS k FROM s WHERE same QUALIFY k <= 5),
     n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.other_id)::INT AS rank
           FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
           QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved to the next one, every fiftieth vector is an anchor."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)
