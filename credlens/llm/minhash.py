"""Near-duplicate documents by min-max hashing.

A document's set are its distinct word shingles.  Each of ``PERMUTATIONS``
hash functions gives two signature values, its minimum and its maximum over
the set, so a signature of 160 values costs 80 evaluations.  Bands of five
values are buckets; two sets of similarity 0.8 share none of the 32 bands with
probability 3e-6.

Documents with equal sets are one class first.  In every bucket of more than
one class, each class is compared with the bucket's pivot, which is linear in
the bucket; confirmed links give components.  In a bucket whose classes are not
yet in one component, the pairs between different components are open.  They
are settled as matrix products: members are dealt over pairs of blocks of at
most about ``BLOCK``, a task counts all intersections of its block pair at
once, and returns only the links that join components.  So no pair that shares
a bucket is left open, and no list of pairs is ever made.  Every link is
confirmed on the full sets of words, read from the texts.

Defined results: null, empty and white-space texts have no shingles and link
with nothing; fewer words than a shingle count as one sequence; rows with the
same doc_id are one document for the components, and each keeps its own
count; rows without doc_id take no part (component null, kept); an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, drop_places, join_groups, numbered_files, place_of, placed, scratch, shuffle_partitions
from .pretokens import text_blocks

PERMUTATIONS, BAND_ROWS = 80, 5
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
TEXT_BYTES = 2 << 20
#: Members of a pivot that are compared in one portion.
PORTION = 64
#: Members in a block of an open bucket, and shingles in one matrix product.
BLOCK, COLUMNS = 512, 4096
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


A, C = _odd(PERMUTATIONS, 1), _odd(16, 2)
B = _odd(PERMUTATIONS, 3)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    word = ~_SPACE[raw]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = ends[:-1][ends[:-1] < len(raw)]
    start[first] |= word[first]
    at = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(at, ends))
    if not len(at):
        return np.zeros(0, np.uint64), counts
    letters = _LOWER[raw[word]]
    offsets = np.append((np.cumsum(word) - word)[at], len(letters)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters.tobytes())])
    coded = words.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    return known[coded.indices.to_numpy()], counts


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled += mix(words[j:j + len(rolled)] + C[j]) * C[j]
    rolled = mix(rolled)
    at = 0
    for m in counts.tolist():
        if m >= k:
            yield np.unique(rolled[at:at + m - k + 1])
        elif m:
            own = mix(words[at:at + m] + C[:m]) * C[:m]
            yield mix(own.sum(dtype=np.uint64, keepdims=True) + C[k + m])
        else:
            yield np.zeros(0, np.uint64)
        at += m


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under every permutation, in turn."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(shingles), 4096):
        h = np.multiply.outer(A, shingles[k:k + 4096]) + B[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets by their signatures."""
    return float(np.mean(a == b))


def band_keys(values: np.ndarray) -> np.ndarray:
    v = values.reshape(BANDS, BAND_ROWS)
    keys = np.full(BANDS, 0, np.uint64)
    for j in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + v[:, j])
    return mix(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


SKETCH = "doc_id long, text_hash long, n_shingles long, set_key string, bands array<long>"


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """Per row: size and digest of its set, and its band keys."""
    def run(batches):
        for t in text_blocks(batches, TEXT_BYTES):
            sizes, keys, bands = [], [], []
            for s in shingle_sets(t.column(1).combine_chunks(), k):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=20).hexdigest())
                bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [t.column(0).combine_chunks(), t.column(2).combine_chunks(), pa.array(sizes, pa.int64()),
                 pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "set_key", "bands"])
    return _texts(docs).select("doc_id", "text", "text_hash").mapInArrow(run, SKETCH)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("text_hash"))


def word_set(text: str | None, k: int) -> set[tuple[bytes, ...]]:
    """A text's set itself, of words."""
    w = (text or "").encode().lower().split()
    if len(w) < k:
        return {tuple(w)} if w else set()
    return set(zip(*(w[j:] for j in range(k)), strict=False))


def confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (a, a_hash, pivot, pivot_hash, n) whose texts' sets are
    similar enough, as edges (a, b).  ``n`` says how many pairs a pivot may
    have; beyond ``PORTION`` its text goes to several portions."""
    n = shuffle_partitions(docs.sparkSession)
    portions = F.ceil(F.col("n") / PORTION)
    pairs = pairs.withColumn("portion", F.pmod(F.xxhash64("a"), portions).cast("int"))
    place = ["pivot", "pivot_hash", "portion"]
    members = pairs.select(*place, F.lit(1).alias("kind"), F.col("a").alias("doc_id"), F.col("a_hash").alias("text_hash"))
    pivots = pairs.select(*place).distinct().select(
        *place, F.lit(0).alias("kind"), F.col("pivot").alias("doc_id"), F.col("pivot_hash").alias("text_hash"))
    asked = members.unionByName(pivots).join(_texts(docs), ["doc_id", "text_hash"])

    def run(batches):
        here, pivot, words = None, None, set()
        for b in batches:
            a, c = [], []
            for r in range(0, b.num_rows, 256):
                for x in b.slice(r, 256).to_pylist():
                    place = (x["pivot"], x["pivot_hash"], x["portion"])
                    if x["kind"] == 0:
                        if place != here:
                            here, pivot, words = place, x["doc_id"], word_set(x["text"], k)
                        continue
                    if place != here:
                        raise ValueError("a pivot's text is missing")
                    own = word_set(x["text"], k)
                    if 100 * min(len(own), len(words)) < percent * max(len(own), len(words)):
                        continue
                    both = len(own & words)
                    if 100 * both >= percent * (len(own) + len(words) - both):
                        a.append(x["doc_id"])
                        c.append(pivot)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return asked.repartition(n, *place).sortWithinPartitions(*place, "kind").mapInArrow(run, "a long, b long").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        here = np.zeros((len(sets), COLUMNS), np.float32)
        here[owner[a:b], column[a:b] - lo] = 1
        out += here @ here.T
    return out + np.diag([len(x) for x in sets] - np.diag(out))


def _joining(linked: np.ndarray, component: np.ndarray, texts: list[str | None], k: int, percent: int) -> list[tuple[int, int]]:
    """Links that join components, each confirmed on the words, as few as connect all."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x
    out = []
    a, b = np.nonzero(np.triu(linked))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(int(component[i])), find(int(component[j]))
        if x == y:
            continue
        u, v = word_set(texts[i], k), word_set(texts[j], k)
        both = len(u & v)
        if 100 * both >= percent * (len(u) + len(v) - both):
            parent[x] = y
            out.append((i, j))
    return out


def _open_links(docs: DataFrame, open_: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Edges (a, b) between different components of the classes of each open
    bucket; ``open_`` = (bucket, rep, rep_hash, component, m)."""
    n = shuffle_partitions(docs.sparkSession)
    place = ["bucket", "i", "j"]
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", "bucket"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("blocks", blocks).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") > F.col("other")).cast("int").alias("side"), "component",
                F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash"))
    rows = dealt.join(_texts(docs), ["doc_id", "text_hash"]).repartition(n, *place).sortWithinPartitions(*place) \
        .select(*place, "side", "component", "doc_id", "text")
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def settle(members: list[dict]) -> pa.RecordBatch | None:
        component, side = (np.array([r[c] for r in members], np.int64) for c in ("component", "side"))
        if (component == component[0]).all():
            return None
        texts = [r["text"] for r in members]
        sets = list(shingle_sets(pa.array(texts, pa.string()), k))
        sizes = np.array([len(x) for x in sets])
        both = common_counts(sets)
        linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
        linked &= component[:, None] != component[None, :]
        if members[0]["i"] != members[0]["j"]:
            linked &= side[:, None] != side[None, :]
        pairs = _joining(linked, component, texts, k, percent)
        ids = [r["doc_id"] for r in members]
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in pairs], pa.int64()),
                                           pa.array([ids[j] for _, j in pairs], pa.int64())], schema=edge) if pairs else None

    def run(batches):
        here, members = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for r in batch.slice(lo, 256).to_pylist():
                    at = (r["bucket"], r["i"], r["j"])
                    if at != here:
                        if len(members) > 1 and (out := settle(members)) is not None:
                            yield out
                        here, members = at, []
                    members.append(r)
        if len(members) > 1 and (out := settle(members)) is not None:
            yield out

    return rows.mapInArrow(run, "a long, b long").distinct()


def components_of(docs: DataFrame, k: int = 5, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``."""
    spark = docs.sparkSession
    base = scratch(spark, "minhash")
    sketch(docs, k).write.parquet(f"{base}/sketch")
    rows = spark.read.parquet(f"{base}/sketch")
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")

    # classes of equal sets, each by its smallest document
    place = F.min(F.struct("doc_id", "text_hash")).alias("first")
    some.groupBy("set_key").agg(F.count("*").alias("n"), place) \
        .select("set_key", "n", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("rep_hash")) \
        .write.parquet(f"{base}/classes")
    classes = spark.read.parquet(f"{base}/classes")
    reps = some.select(F.col("doc_id").alias("rep"), F.col("text_hash").alias("rep_hash"), "set_key", "n_shingles", "bands") \
        .join(classes.select("rep", "rep_hash", "set_key"), ["rep", "rep_hash", "set_key"], "left_semi") \
        .dropDuplicates(["rep", "rep_hash"])
    reps.select("rep", "rep_hash", "n_shingles", F.explode("bands").alias("bucket")).write.parquet(f"{base}/members")
    members = spark.read.parquet(f"{base}/members")

    # buckets of several classes; buckets that share classes tend to share the pivot
    pivot = F.min(F.struct(F.xxhash64("rep"), F.col("rep"), F.col("rep_hash"))).alias("p")
    members.groupBy("bucket").agg(F.count("*").alias("n"), pivot).filter("n > 1") \
        .select("bucket", "n", F.col("p.rep").alias("pivot"), F.col("p.rep_hash").alias("pivot_hash")) \
        .write.parquet(f"{base}/buckets")
    buckets = spark.read.parquet(f"{base}/buckets")
    join_groups(members, buckets, ["bucket"], "n").write.parquet(f"{base}/shared")
    shared = spark.read.parquet(f"{base}/shared")

    key = ["a", "a_hash", "pivot", "pivot_hash"]
    stars = shared.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("rep_hash").alias("a_hash"),
                                                "pivot", "pivot_hash", "n")
    links = materialize(confirm(docs, stars.groupBy(*key).agg(F.max("n").alias("n")), k, percent))
    first = components(links)

    # what the pivots left open: buckets with several components
    known = shared.filter("rep <> pivot").join(first.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("bucket", "rep", "rep_hash", F.coalesce("component", "rep").alias("component"))
    mixed = known.groupBy("bucket").agg(F.count("*").alias("m"), F.min("component").alias("lo"),
                                        F.max("component").alias("hi")).filter("lo <> hi").select("bucket", "m")
    known.write.parquet(f"{base}/known")
    mixed.write.parquet(f"{base}/mixed")
    open_ = join_groups(spark.read.parquet(f"{base}/known"), spark.read.parquet(f"{base}/mixed"), ["bucket"], "m")
    more = materialize(_open_links(docs, open_, k, percent, block))
    if not more.isEmpty():
        first = components(links.unionByName(more))

    found = classes.join(first.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("set_key", "n", F.coalesce("component", "rep").alias("component_id"))
    found.write.parquet(f"{base}/found")
    done = join_groups(some.select("doc_id", "n_shingles", "set_key"), spark.read.parquet(f"{base}/found"),
                       ["set_key"], "n").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0 OR doc_id IS NULL") \
        .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row of each component.

    Every row is a document of its own here, told by its place, so rows that
    share their doc_id or have none take part; the smallest doc_id stays, a
    null doc_id after all others, the first place among equals."""
    spark = docs.sparkSession
    docs = placed(docs)
    base = scratch(spark, "near")
    files = numbered_files(docs)
    # file number and row as one number: no row is shuffled for it
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"),
                       *place_of(docs)) \
        .join(F.broadcast(files), "file").withColumn("place", F.shiftleft("number", 40) + F.col("row"))
    found = components_of(rows.select(F.col("place").alias("doc_id"), "text"), k, percent) \
        .select(F.col("doc_id").alias("place"), "component_id")
    found.join(rows.select("place", "id"), "place").write.parquet(f"{base}/found")
    found = spark.read.parquet(f"{base}/found")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "place")).alias("first")
    found.groupBy("component_id").agg(F.count("*").alias("n"), first).filter("n > 1") \
        .select("component_id", "n", F.col("first.place").alias("stays")).write.parquet(f"{base}/stays")
    gone = join_groups(found, spark.read.parquet(f"{base}/stays"), ["component_id"], "n").filter("place <> stays") \
        .select(F.shiftright("place", 40).alias("number"), F.col("place").bitwiseAND(F.lit((1 << 40) - 1)).alias("row")) \
        .join(F.broadcast(files), "number")
    return drop_places(docs, gone)
