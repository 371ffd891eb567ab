"""Hard negatives by zone maps over blocks of vectors in Hilbert order.

Vectors are made integers, sorted along a Hilbert curve and stored as blocks,
one Parquet row each, with the smallest and largest value of every dimension
(the zone map) in columns of their own, so that maps are read without blocks.
A search asks for the first ``k`` rows of an anchor that have its label, or
another, and an inner product in a window.  Interval arithmetic over a zone
map bounds the products that a block can hold; only blocks whose bounds meet
the window, and can still beat the ``k`` rows found in the anchor's own block,
are read.  Bounds and products are exact, so no row is missed.

Anchors are the stated query set: they are searched in batches of at most
``BATCH`` anchors and ``BATCH_BYTES``, two searches each: positives, then the
windows that the positives' scores open.  A task keeps ``k`` rows a search.

Defined results: rows with null vec_id, label or vector, or with a null or
non-finite component take no part; vectors of different lengths are not
compared; repeated rows are rows of their own, and equal ones may stand for
each other; an anchor without positives, and a positive without negatives,
has no rows; an empty table gives none; a score beyond a long raises; further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, shuffle_partitions

SCALE = 256
#: Rows of a block, and its bytes at most; bits of a dimension and bytes of a Hilbert key.
BLOCK, BLOCK_BYTES, BITS, KEY_BYTES = 512, 1 << 20, 4, 64
BATCH, BATCH_BYTES = 8192, 16 << 20
LARGEST = np.iinfo(np.int64).max
LEAST = -LARGEST
#: Products of doubles are exact below this.
EXACT = float(1 << 53)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(rows, bytes): places on the Hilbert curve through cells of ``bits`` bits a
    dimension (Skilling's transform of the axes), most significant bits first."""
    x = cells.astype(np.uint32)
    n, dims = x.shape
    if not dims:
        return np.zeros((n, 0), np.uint8)
    q = 1 << (bits - 1)
    while q > 1:
        low = np.uint32(q - 1)
        for d in range(dims):
            flip = (x[:, d] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, d]) & low).astype(np.uint32)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(n, np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, -1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= turn[:, None]
    planes = [(x >> np.uint32(b)) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)[:, :KEY_BYTES]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows."""
    if a.size and b.size and a.shape[1] * np.abs(a).max() * np.abs(b).max() >= EXACT:
        exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
        if exact.size and max(exact.max(), -exact.min()) >= LARGEST:
            raise OverflowError("a score does not fit a long")
        return exact.astype(np.int64)
    return np.rint(a @ b.T).astype(np.int64)


def score_bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) product that each row of ``a`` can have with a vector
    between each row of ``low`` and of ``high``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    if a.size and low.size:
        size = a.shape[1] * np.abs(a).max() * max(np.abs(low).max(), np.abs(high).max())
        if size >= EXACT:
            least, most = least - size * 1e-12, most + size * 1e-12
    return least, most


# --------------------------------------------------------------- blocks

ROWS = "vec_id long, label string, anchor boolean, dims int, vector binary"


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v = b.column(0), b.column(3)
            keep, dims, vectors = [], [], []
            for k in range(b.num_rows):
                x = v[k].values
                if x is None or x.null_count:
                    continue
                x = np.floor(x.to_numpy(zero_copy_only=False).astype(np.float64) * scale) + 0.0
                if not np.isfinite(x).all():
                    continue
                keep.append(k)
                dims.append(len(x))
                vectors.append(x.tobytes())
            keep = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(keep), b.column(1).take(keep), b.column(2).take(keep), pa.array(dims, pa.int32()),
                 pa.array(vectors, pa.binary())], ["vec_id", "label", "anchor", "dims", "vector"])
    return run


def _extent(batches):
    """The smallest and largest component of all vectors seen."""
    low, high = np.inf, -np.inf
    for b in batches:
        for v in b.column(0).to_pylist():
            if v:
                x = np.frombuffer(v)
                low, high = min(low, x.min()), max(high, x.max())
    yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([high])], ["low", "high"])


def _keyed(low: float, high: float):
    """Rows with their Hilbert keys: components in equal cells between the extremes."""
    def run(batches):
        for b in batches:
            dims = b.column(3).to_numpy()
            vectors = b.column(4).to_pylist()
            keys = [b""] * b.num_rows
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(vectors[k] for k in at)).reshape(len(at), d)
                cells = np.clip((x - low) / max(high - low, 1.0) * (1 << BITS), 0, (1 << BITS) - 1)
                for k, key in zip(at.tolist(), hilbert_keys(cells)):
                    keys[k] = key.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, "key"])
    return run


BLOCKS = ("block long, dims int, n int, low binary, high binary, least_id long, names array<string>, anchors array<int>, "
          "ids binary, labels array<string>, kind string, vectors binary")


def _packed(block: int):
    """Sorted rows -> blocks; the rows of a block stand by vec_id."""
    def pack(rows: pa.Table, number: int) -> pa.RecordBatch:
        rows = rows.sort_by("vec_id")
        d = rows.column("dims")[0].as_py()
        x = np.frombuffer(b"".join(rows.column("vector").to_pylist())).reshape(rows.num_rows, d)
        low, high = x.min(axis=0), x.max(axis=0)
        size = np.abs(x).max() if x.size else 0
        kind = "i2" if size < 1 << 15 else "i4" if size < 1 << 31 else "f8"
        ids = rows.column("vec_id").to_numpy()
        labels = rows.column("label").to_pylist()
        anchors = np.flatnonzero(rows.column("anchor").to_numpy(zero_copy_only=False))
        values = [number, d, len(ids), low.tobytes(), high.tobytes(), int(ids.min()), sorted(set(labels)),
                  anchors.tolist(), ids.tobytes(), labels, kind, x.astype(kind).tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.string()),
                 pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.string(), pa.binary()]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held, n, dims = [], 0, None
        for b in batches:
            d = b.column(3).to_numpy()
            at = 0
            for k in range(b.num_rows):
                most = max(1, min(block, BLOCK_BYTES // max(8, 8 * int(d[k]))))
                if n and (d[k] != dims or n >= most):
                    held.append(b.slice(at, k - at))
                    yield pack(pa.Table.from_batches(held), number)
                    number, held, n, at = number + 1, [], 0, k
                dims, n = d[k], n + 1
            held.append(b.slice(at))
        if n:
            yield pack(pa.Table.from_batches(held), number)
    return run


def write_blocks(vectors: DataFrame, path: str, anchor: Column, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """The blocks of ``vectors`` (vec_id, embedding, label) in Hilbert order, stored
    at ``path``; their ids increase along the curve.  ``anchor`` marks anchors."""
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                            F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("v")) \
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    source.mapInArrow(_integers(scale), ROWS).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    low, high = rows.select("vector").mapInArrow(_extent, "low double, high double").agg(F.min("low"), F.max("high")).first() or (0, 0)
    finite = low is not None and np.isfinite([low, high]).all()
    rows.mapInArrow(_keyed(low if finite else 0.0, high if finite else 0.0), f"{ROWS}, key binary").write.parquet(f"{path}/keyed")
    order = ["dims", "key", "vec_id"]
    spark.read.parquet(f"{path}/keyed").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order) \
        .drop("key").mapInArrow(_packed(block), BLOCKS).write.parquet(f"{path}/blocks")
    return spark.read.parquet(f"{path}/blocks")


# --------------------------------------------------------------- searches

class Batch:
    """Anchors of one length, and searches: for each the anchor's number, whether
    rows of its label or of others are sought, a window of scores, how many
    rows, and the ``k``-th row known so far (score and id)."""

    def __init__(self, anchors: list):
        self.vectors = np.stack([np.frombuffer(a.vector) for a in anchors])
        self.labels = [a.label for a in anchors]
        self.home = np.array([a.block for a in anchors])
        self.slot = np.array([a.slot for a in anchors])

    def searches(self, anchor: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> "Batch":
        self.anchor, self.same, self.low, self.high, self.k = anchor, same, low, high, k
        self.floor, self.floor_id = np.full(len(anchor), LEAST), np.full(len(anchor), LARGEST)
        return self

    def know(self, found: list) -> None:
        """Take the last of ``k`` rows found for a search as what others must beat."""
        by: dict[int, list] = {}
        for r in found:
            by.setdefault(r.search, []).append((-r.score, r.vec_id))
        for search, rows in by.items():
            if len(rows) == self.k:
                score, self.floor_id[search] = max(rows)
                self.floor[search] = -score


NEEDED = "block long, searches array<int>"
FOUND = "search int, score long, vec_id long"


def _needed(shared):
    """Zone maps -> the searches that must read each block, their own block aside."""
    def run(batches):
        q = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            d = q.vectors.shape[1]
            low, high = (np.frombuffer(b"".join(b.column(c).to_pylist())).reshape(b.num_rows, d) for c in (1, 2))
            least, most = score_bounds(q.vectors, low, high)
            ids, number, names = b.column(3).to_numpy(), b.column(0).to_numpy(), b.column(4).to_pylist()
            out = []
            for k in range(b.num_rows):
                here = set(names[k])
                fits = np.array([x in here if q.same else len(here) > (x in here) for x in q.labels])
                fits &= q.home != number[k]
                up, down = most[q.anchor, k], least[q.anchor, k]
                beats = (up > q.floor) | ((up == q.floor) & (ids[k] < q.floor_id))
                out.append(np.flatnonzero(fits[q.anchor] & beats & (up >= q.low) & (down <= q.high)).astype(np.int32))
            some = [k for k, x in enumerate(out) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.array([out[k] for k in some], pa.list_(pa.int32()))],
                                             ["block", "searches"])
    return run


def _scored(shared):
    """Blocks with the searches that read them -> the first ``k`` rows of every search."""
    def best(scores, ids, k):
        order = np.lexsort((ids, -scores), axis=-1)[:, :k]
        return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)

    def run(batches):
        q = shared.value
        top = np.full((len(q.anchor), q.k), LEAST)
        top_id = np.full((len(q.anchor), q.k), LARGEST)
        for b in batches:
            for k in range(b.num_rows):
                number, d, n, kind = (b.column(c)[k].as_py() for c in (0, 1, 2, 5))
                ids = np.frombuffer(b.column(3)[k].as_py(), np.int64)
                labels = np.array(b.column(4)[k].as_py(), object)
                x = np.frombuffer(b.column(6)[k].as_py(), kind).astype(np.float64).reshape(n, d)
                searches = b.column(7)[k].values.to_numpy()
                for at in range(0, len(searches), 1024):
                    s = searches[at:at + 1024]
                    mine, back = np.unique(q.anchor[s], return_inverse=True)
                    score = products(q.vectors[mine], x)
                    fits = np.stack([labels == q.labels[a] for a in mine]) == q.same
                    own = q.home[mine] == number
                    fits[np.flatnonzero(own), q.slot[mine[own]]] = False
                    score, fits = score[back], fits[back]
                    fits &= (score >= q.low[s, None]) & (score <= q.high[s, None])
                    score = np.where(fits, score, LEAST)
                    here, here_id = np.full((len(s), q.k), LEAST), np.full((len(s), q.k), LARGEST)
                    every = np.arange(len(s))
                    for j in range(q.k):      # the first largest has the smallest id
                        place = score.argmax(axis=1)
                        here[:, j] = score[every, place]
                        here_id[:, j] = np.where(here[:, j] > LEAST, ids[place], LARGEST)
                        score[every, place] = LEAST
                    top[s], top_id[s] = best(np.hstack([top[s], here]), np.hstack([top_id[s], here_id]), q.k)
        search, place = np.nonzero(top > LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(search.astype(np.int32)), pa.array(top[search, place]),
                                          pa.array(top_id[search, place])], ["search", "score", "vec_id"])
    return run


def _read(blocks: DataFrame, needed: DataFrame, shared) -> DataFrame:
    payload = blocks.select("block", "dims", "n", "ids", "labels", "kind", "vectors")
    return payload.join(needed, "block").select("block", "dims", "n", "ids", "labels", "kind", "vectors", "searches") \
        .mapInArrow(_scored(shared), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("search").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(blocks: DataFrame, batch: Batch) -> DataFrame:
    """search, score, vec_id, rank: the first rows of every search of ``batch``."""
    spark = blocks.sparkSession
    context = spark.sparkContext
    home: dict[int, list[int]] = {}
    for s, a in enumerate(batch.anchor.tolist()):
        home.setdefault(int(batch.home[a]), []).append(s)
    at_home = spark.createDataFrame(list(home.items()), NEEDED)
    shared = context.broadcast(batch)
    base = scratch(spark, "search")
    # blocks of a batch are neighbours on the curve
    near = blocks.filter(F.col("block").between(int(batch.home.min()), int(batch.home.max())))
    _first(_read(near, F.broadcast(at_home), shared), batch.k).drop("rank").write.parquet(f"{base}/home")
    known = spark.read.parquet(f"{base}/home")
    batch.know(known.collect())
    shared = context.broadcast(batch)
    blocks.filter(F.col("dims") == batch.vectors.shape[1]).select("block", "low", "high", "least_id", "names") \
        .mapInArrow(_needed(shared), NEEDED).write.parquet(f"{base}/needed")
    far = _read(blocks, spark.read.parquet(f"{base}/needed"), shared)
    _first(far.unionByName(known), batch.k).write.parquet(f"{base}/found")
    return spark.read.parquet(f"{base}/found")


def _anchors(batches):
    for b in batches:
        out = []
        for k in range(b.num_rows):
            number, d, n, kind = (b.column(c)[k].as_py() for c in (0, 1, 2, 5))
            slots = b.column(7)[k].as_py()
            x = np.frombuffer(b.column(6)[k].as_py(), kind).astype(np.float64).reshape(n, d)
            ids = np.frombuffer(b.column(3)[k].as_py(), np.int64)
            labels = b.column(4)[k].as_py()
            out += [(number, s, d, int(ids[s]), labels[s], x[s].tobytes()) for s in slots]
        names = ["block", "slot", "dims", "vec_id", "label", "vector"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(6)], names)


def anchor_batches(blocks: DataFrame, path: str, most: int = BATCH) -> Iterator[list]:
    """The anchors in batches of one length each, in the order of the curve."""
    spark = blocks.sparkSession
    blocks.filter("size(anchors) > 0").select("block", "dims", "n", "ids", "labels", "kind", "vectors", "anchors") \
        .mapInArrow(_anchors, "block long, slot int, dims int, vec_id long, label string, vector binary") \
        .write.parquet(f"{path}/anchors")
    held, size = [], 0
    for a in spark.read.parquet(f"{path}/anchors").orderBy("dims", "block", "slot").toLocalIterator():
        if held and (len(held) >= most or size >= BATCH_BYTES or held[0].dims != a.dims):
            yield held
            held, size = [], 0
        held.append(a)
        size += len(a.vector)
    if held:
        yield held


RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = SCALE, block: int = BLOCK, batch: int = BATCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for each anchor and each of its first ``positives`` rows of the same label, the
    first ``negatives`` rows of other labels that score ``low`` to ``high`` percent
    of the positive.  ``vectors`` has vec_id, embedding, label."""
    spark = vectors.sparkSession
    base = scratch(spark, "negatives")
    blocks = write_blocks(vectors, base, anchor, block, scale)
    done = []
    for number, rows in enumerate(anchor_batches(blocks, base, batch)):
        q, n = Batch(rows), len(rows)
        found = search(blocks, q.searches(np.arange(n), True, np.full(n, LEAST), np.full(n, LARGEST), positives))
        # as many rows as the batch has positives
        near = found.orderBy("search", "rank").collect()
        near = [(s, r.score, r.vec_id, *w) for s, r in ((r.search, r) for r in near)
                if (w := (-(-low * r.score // 100), high * r.score // 100))[0] <= w[1]]
        if not near:
            continue
        windows = [np.array([x[c] for x in near], np.int64) for c in (0, 3, 4)]
        found = search(blocks, q.searches(windows[0], False, windows[1], windows[2], negatives))
        names = spark.createDataFrame([(k, rows[s].vec_id, i, score) for k, (s, score, i, *_) in enumerate(near)],
                                      "search int, anchor_id long, positive_id long, positive_score long")
        found.join(F.broadcast(names), "search").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{base}/result/{number}")
        done.append(f"{base}/result/{number}")
    return spark.read.parquet(*done) if done else spark.createDataFrame([], RESULT)
