"""Near-duplicate vectors by p-stable hashing for the Euclidean distance.

Vectors are normalised, so a cosine is a distance.  Each of several tables
buckets a vector by ``k`` random Gaussian projections, shifted and quantised
in steps of ``WIDTH``.  ``k`` follows the number of vectors, so that about
``OCCUPANCY`` unrelated ones share a bucket whatever the size, and the number
of tables follows ``k``, so that a pair just at the threshold is missed by all
tables with probability ``MISS``.  The projections are integer arithmetic on
fixed-point vectors, hence the same wherever they are computed.

Vectors that are equal are one class.  In a bucket all cosines are computed
exactly, as matrix products in blocks of at most about ``BLOCK`` members; a
larger bucket is dealt over pairs of blocks.  A linked pair counts in the
first table that brings it together.  A block returns one sum per member and
the star edges of its components, never its pairs.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components link with nothing, and neither do vectors of different
lengths; repeated rows are vectors of their own; rows without vec_id take no
part; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, join_groups, scratch, shuffle_partitions

THRESHOLD = 0.9
WIDTH, OCCUPANCY, MISS, BLOCK = 2.0, 512, 1e-5, 1024
#: Bits of the fixed-point vectors and projections.
VECTOR_BITS, PROJECTION_BITS = 24, 12


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection is the same at a distance."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def parameters(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(projections of a table, number of tables) for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(2, round(math.log(max(n, OCCUPANCY) / OCCUPANCY) / -math.log(far)))
    return k, math.ceil(math.log(MISS) / math.log(1 - near ** k))


@lru_cache(maxsize=4)
def _projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, int]:
    rng = np.random.default_rng([dim, k, tables])
    a = np.round(rng.normal(size=(dim, tables * k)) * (1 << PROJECTION_BITS)).astype(np.int64)
    step = int(WIDTH * (1 << (VECTOR_BITS + PROJECTION_BITS)))
    return a, rng.integers(0, step, tables * k), step


def table_keys(unit: np.ndarray, k: int, tables: int, first: int | None = None) -> np.ndarray:
    """(vectors, tables): the bucket of every vector in the (first) tables."""
    count = tables if first is None else first
    a, shift, step = _projections(unit.shape[1], k, tables)
    fixed = np.round(unit * (1 << VECTOR_BITS)).astype(np.int64)
    cells = (fixed @ a[:, :count * k] + shift[:count * k]) // step
    h = np.full((len(unit), count), unit.shape[1], np.uint64)
    for j in range(k):
        h = (h ^ cells[:, j::k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h + np.arange(count, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


VALID = "vec_id long, class string, unit binary"


def _valid(vectors: DataFrame) -> DataFrame:
    """Vectors that can link: normalised, in doubles, with the digest of their components."""
    def run(batches):
        for b in batches:
            ids, keys, units = [], [], []
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                for vec_id, v in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if vec_id is None or not v.is_valid or len(v) == 0 or v.values.null_count:
                        continue
                    x = v.values.to_numpy().astype(np.float64) + 0.0
                    size = np.abs(x).max()
                    if not np.isfinite(x).all() or size == 0:
                        continue
                    scaled = x / size
                    ids.append(vec_id)
                    keys.append(hashlib.blake2b(x.tobytes(), digest_size=20).hexdigest())
                    units.append((scaled / math.sqrt(float(scaled @ scaled))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()),
                                              pa.array(units, pa.binary())], ["vec_id", "class", "unit"])
    source = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return source.mapInArrow(run, VALID)


def _buckets(k: int, tables: int):
    """(rep, n, unit) -> a row for every table."""
    def run(batches):
        for b in batches:
            units = b.column(2).to_pylist()
            for dim in sorted({len(u) for u in units}):
                at = [i for i, u in enumerate(units) if len(u) == dim]
                x = np.frombuffer(b"".join(units[i] for i in at)).reshape(len(at), -1)
                for lo in range(0, len(at), 256):
                    rows = pa.array(at[lo:lo + 256]).take(pa.array(np.repeat(np.arange(len(at[lo:lo + 256])), tables)))
                    keys = table_keys(x[lo:lo + 256], k, tables)
                    numbers = np.tile(np.arange(tables, dtype=np.int32), len(keys))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(numbers), b.column(0).take(rows)],
                        ["bucket", "number", "rep"])
    return run


def _stars(linked: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component in a link matrix."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(k: int, tables: int, threshold: float):
    """Rows sorted by block pair -> (a, b, links): sums of a member, star edges."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def block(rows):
        x = np.frombuffer(b"".join(r["unit"] for r in rows)).reshape(len(rows), -1)
        rep, n = (np.array([r[c] for r in rows], np.int64) for c in ("rep", "n"))
        side = np.array([r["side"] for r in rows])
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if rows[0]["i"] != rows[0]["j"]:
            linked &= side[:, None] != side[None, :]
        if not linked.any():
            return None
        label = _stars(linked)
        edge = np.flatnonzero(label != np.arange(len(rows)))
        a, b = np.nonzero(np.triu(linked))
        number = rows[0]["number"]
        if number:
            used = np.unique(np.concatenate([a, b]))
            keys = np.zeros((len(rows), number), np.int64)
            keys[used] = table_keys(x[used], k, tables, number)
            new = np.ones(len(a), bool)
            for lo in range(0, len(a), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                new[part] = ~(keys[a[part]] == keys[b[part]]).any(axis=1)
            a, b = a[new], b[new]
        sums = np.bincount(a, n[b], len(rows)) + np.bincount(b, n[a], len(rows))
        some = np.flatnonzero(sums)
        out_a = np.concatenate([rep[edge], rep[some]])
        out_b = np.concatenate([rep[label[edge]], rep[some]])
        links = np.concatenate([np.zeros(len(edge), np.int64), sums[some].astype(np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(out_a), pa.array(out_b), pa.array(links)], schema=schema)

    def run(batches):
        here, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                place = (r["bucket"], r["i"], r["j"])
                if place != here:
                    if len(rows) > 1 and (out := block(rows)) is not None:
                        yield out
                    here, rows = place, []
                rows.append(r)
        if len(rows) > 1 and (out := block(rows)) is not None:
            yield out
    return run


def near_copies(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    base = scratch(spark, "embeddings")
    _valid(vectors).write.parquet(f"{base}/valid")
    valid = spark.read.parquet(f"{base}/valid")
    # a class goes by a number of its own: one id may be in several classes
    valid.groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")) \
        .withColumn("rep", F.monotonically_increasing_id()).write.parquet(f"{base}/classes")
    classes = spark.read.parquet(f"{base}/classes")
    reps = valid.join(classes, (valid["class"] == classes["class"]) & (valid["vec_id"] == classes["id"])) \
        .select("rep", "n", "unit").dropDuplicates(["rep"])
    reps.write.parquet(f"{base}/reps")
    reps = spark.read.parquet(f"{base}/reps")
    k, tables = parameters(reps.count(), threshold)

    reps.mapInArrow(_buckets(k, tables), "bucket long, number int, rep long").write.parquet(f"{base}/members")
    members = spark.read.parquet(f"{base}/members")
    members.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1").write.parquet(f"{base}/sizes")
    shared = join_groups(members, spark.read.parquet(f"{base}/sizes"), ["bucket"], "m")
    # a bucket of more than a block's members is dealt over pairs of blocks
    blocks = F.ceil(F.col("m") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", "number"), F.col("blocks")).cast("int")
    dealt = shared.withColumn("blocks", blocks).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("rep", "bucket", "number", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") > F.col("other")).cast("int").alias("side"))
    place = ["bucket", "i", "j"]
    found = dealt.join(reps, "rep").repartition(shuffle_partitions(spark), *place).sortWithinPartitions(*place) \
        .select("bucket", "i", "j", "side", "number", "rep", "n", "unit") \
        .mapInArrow(_links(k, tables, threshold), "a long, b long, links long")
    found = materialize(found.groupBy("a", "b").agg(F.sum("links").alias("links")))
    parts = components(found.filter("a <> b").select("a", "b"))
    sums = found.filter("a = b").select(F.col("a").alias("rep"), "links")
    result = classes.join(sums, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(
        "class", "n", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"))
    result.write.parquet(f"{base}/numbered")
    result = spark.read.parquet(f"{base}/numbered")
    result.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("m")).write.parquet(f"{base}/components")
    join_groups(result, spark.read.parquet(f"{base}/components"), ["component"], "m") \
        .select("class", "n", "n_links", "component_id").write.parquet(f"{base}/result")
    done = join_groups(valid.select("vec_id", "class"), spark.read.parquet(f"{base}/result"), ["class"], "n") \
        .select("vec_id", "n_links", "component_id")
    # rows that cannot link: as many of each id as are not among the valid ones
    every = vectors.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.count("*").alias("rows"))
    linkable = valid.groupBy("vec_id").agg(F.count("*").alias("linkable"))
    lone = every.join(linkable, every["vec_id"].eqNullSafe(linkable["vec_id"]), "left") \
        .select(every["vec_id"], (F.col("rows") - F.coalesce("linkable", F.lit(0))).cast("int").alias("lone")) \
        .filter("lone > 0") \
        .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                F.explode(F.sequence(F.lit(1), F.col("lone"))).alias("_")).drop("_")
    return done.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
