"""Prefix tree of conversations in double arrays.

A node is a distinct sequence of first turns.  Every turn (role, text) is
named by a 128-bit digest.  Conversations are cut into segments of ``SEGMENT``
turns, each hung below the node that the turns before it lead to (its top).
Equal segments under one top are one sequence with a count.  The sequences in
lexicographic order are dealt by range, so that every shard holds neighbouring
prefixes, however many conversations begin alike.  A shard's turns get dense
ids, its trie is packed into BASE and CHECK arrays, and a walk of all its
sequences through the arrays gives the nodes.

Only nodes on the path of a shard's first or last sequence, and those above
a segment's end that goes on, can lie in other shards too: they are merged by
their key (the digest chained over their turns).  What hangs below them is
summed by doubling: each round adds the sums at twice the distance, so a path
of n shared nodes takes log2(n) rounds.  The digest of the conversations that
end at a node is a stream over sorted pieces of ids.

Defined results: turns are ordered by turn (null first), then by the digest of
role and text; null role or text is empty; rows without conv_id take no part;
repeated rows are turns of their own; a conversation without turns belongs to
the root; an empty table has no nodes, not even a root; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_groups, scratch, shuffle_partitions

#: Turns of a segment; sequences and turns of a shard; ids in a piece of an end list.
SEGMENT, SEQUENCES, TURNS, IDS = 64, 4096, 1 << 17, 4096
#: Bytes of a turn in a path: digest and number of code points.
DIGEST, ENTRY = 16, 20
ROOT = bytes(DIGEST)
NONE = hashlib.sha256(b"").hexdigest()
#: Places tried for the children of a state.
TRIES = 64
#: CHECK of a free slot and of a root.
FREE, TOP = -1, -2
LAST = np.iinfo(np.int64).max


# --------------------------------------------------------------- double array

class DoubleArray:
    """A trie over dense codes (1 up): the child of state ``s`` by code ``c``
    is slot ``BASE[s] + c`` if ``CHECK`` there is ``s``."""

    def __init__(self, roots: int):
        self.base = np.zeros(roots, np.int64)
        self.check = np.full(roots, TOP)
        self.random = np.random.default_rng(1)

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check) // 2)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, FREE))

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``states`` by ``codes``, ``FREE`` where there is none."""
        to = self.base[states] + codes
        inside = (to >= 0) & (to < len(self.check))
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states), to, FREE)

    def add(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Add all children of some states (rows sorted by state) and return their slots.
        States of several children look for a base where every slot is free, the
        largest first; those of one child then fill the holes."""
        first = np.flatnonzero(np.append(True, states[1:] != states[:-1]))
        count = np.diff(np.append(first, len(states)))
        several = np.flatnonzero(count > 1)
        for k in several[np.argsort(-count[several], kind="stable")]:
            self._place(states[first[k]], codes[first[k]:first[k] + count[k]])
        lone = first[count == 1]
        free = np.flatnonzero(self.check == FREE)
        if len(free) < len(lone):
            at = len(self.check)
            self._grow(at + len(lone) - len(free))
            free = np.append(free, np.arange(at, len(self.check)))
        slots = free[:len(lone)]
        self.base[states[lone]] = slots - codes[lone]
        self.check[slots] = states[lone]
        return self.base[states] + codes

    def _place(self, state: int, codes: np.ndarray) -> None:
        """Some places all over the array are tried at once; only if none of them is
        free the array grows, and then it offers the next states more free places."""
        low = codes - codes.min()
        room = len(self.check) - int(low.max())
        fits = np.zeros(0, int)
        if room > 0:
            at = self.random.integers(0, room, TRIES)
            fits = np.arange(TRIES)
            for x in low.tolist():
                fits = fits[self.check[at[fits] + x] == FREE]
                if not len(fits):
                    break
        if len(fits):
            slots = at[fits[0]] + low
        else:
            slots = len(self.check) + low
            self._grow(int(slots.max()) + 1)
        self.base[state] = slots[0] - codes[0]
        self.check[slots] = state


def chain(key: bytes, digest: bytes) -> bytes:
    return hashlib.blake2b(key + digest, digest_size=DIGEST).digest()


NODES = ("open boolean, block long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, "
         "n_convs long, points long, n_children long, n_leaves long, saved_tokens long, end_key binary")
_NODE_TYPES = pa.schema([("open", pa.bool_()), ("block", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()),
                         *[(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "points",
                                                     "n_children", "n_leaves", "saved_tokens")],
                         ("end_key", pa.binary())])


def shard_nodes(block: pa.Table, number: int, segment: int) -> pa.RecordBatch:
    """The nodes of neighbouring sequences (layer, top, path, n, conv_id, more,
    end_key; sorted).  An open node holds what this shard knows of it: its
    conversations here, its closed children and the sums of their subtrees."""
    layer, n, conv = (block.column(c).to_numpy() for c in ("layer", "n", "conv_id"))
    more = block.column("more").to_numpy(zero_copy_only=False)
    tops, paths, ends = (block.column(c).to_pylist() for c in ("top", "path", "end_key"))
    sizes = np.array([len(p) for p in paths]) // ENTRY
    starts = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"".join(paths), np.dtype([("digest", f"S{DIGEST}"), ("points", ">u4")]))
    # codes by level, then by row: the children of a state that are new there have codes in a
    # row, so that they lie close together in the arrays
    level = np.arange(len(raw)) - np.repeat(starts, sizes)
    by_level = np.argsort(level, kind="stable")
    turns, seen, codes = np.unique(raw["digest"][by_level], return_index=True, return_inverse=True)
    order = np.argsort(seen)
    rank = np.empty(len(turns), np.int64)
    rank[order] = np.arange(1, len(turns) + 1)
    turns, unsorted = turns[order], codes
    codes = np.empty(len(raw), np.int64)
    codes[by_level] = rank[unsorted]

    new_root = np.array([True] + [a != b for a, b in zip(tops[1:], tops[:-1])])
    roots = np.cumsum(new_root) - 1
    first = np.flatnonzero(new_root)
    trie = DoubleArray(len(first))

    # build, a level at a time: equal prefixes stand together
    at, levels = roots.copy(), []
    for d in range(int(sizes.max())):
        here = np.flatnonzero(sizes > d)
        s, c = at[here], codes[starts[here] + d]
        new = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
        levels.append(trie.add(s[new], c[new]))
        at[here] = trie.step(s, c)

    # walk all sequences through the arrays
    size = len(trie.check)
    count, points, depth, parent = (np.zeros(size, np.int64) for _ in range(4))
    least = np.full(size, LAST)
    end_of = np.full(size, -1)
    top_layer = layer[first] == 0
    np.add.at(count, roots[layer == 0], n[layer == 0])
    np.minimum.at(least, roots[layer == 0], conv[layer == 0])
    depth[:len(first)] = layer[first] * segment
    parent[:len(first)] = FREE
    at, code_of = roots.copy(), np.zeros(size, np.int64)
    wide = np.zeros(size, bool)
    wide[:len(first)] = True
    edge = np.zeros(len(sizes), bool)
    edge[[0, -1]] = True
    for d in range(len(levels)):
        here = np.flatnonzero(sizes > d)
        s, c = at[here], codes[starts[here] + d]
        to = trie.step(s, c)
        at[here] = to
        np.add.at(count, to, n[here])
        np.minimum.at(least, to, conv[here])
        parent[to], depth[to], code_of[to] = s, depth[s] + 1, c
        points[to] = raw["points"][starts[here] + d]
        wide[to[edge[here]]] = True
        ended = here[sizes[here] == d + 1]
        wide[at[ended][more[ended]]] = True
        end_of[at[ended]] = ended

    # upwards: children, open nodes, sums of closed subtrees
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    for to in reversed(levels):
        np.logical_or.at(wide, parent[to], wide[to])
        closed = to[~wide[to]]
        leaves[closed] += children[closed] == 0
        saved[closed] += (count[closed] - 1) * points[closed]
        for total, x in ((children, 1), (leaves, leaves[closed]), (saved, saved[closed])):
            np.add.at(total, parent[closed], x)

    keys = np.full(size, None, object)
    keys[:len(first)] = [tops[k] for k in first]
    for to in levels:
        for t in to[wide[to]].tolist():
            keys[t] = chain(keys[parent[t]], turns[code_of[t] - 1].ljust(DIGEST, b"\0"))
    nodes = np.concatenate([np.arange(len(first)), *levels])
    top = nodes < len(first)
    up = np.where(top, 0, parent[nodes])
    low = least[nodes]
    end = [ends[k] if k >= 0 else None for k in end_of[nodes].tolist()]
    open_ = wide[nodes]
    open_up = wide[up] & ~top
    return pa.RecordBatch.from_arrays([
        pa.array(open_), pa.array(np.full(len(nodes), number)),
        pa.array(keys[nodes].tolist(), pa.binary()),
        pa.array([keys[p] if o else None for p, o in zip(up.tolist(), open_up.tolist())], pa.binary()),
        pa.array(depth[nodes]), pa.array(low, mask=low == LAST),
        pa.array(least[up], mask=top | open_up), pa.array(count[nodes]), pa.array(points[nodes]),
        pa.array(children[nodes]), pa.array(leaves[nodes]), pa.array(saved[nodes]),
        pa.array(end, pa.binary())], schema=_NODE_TYPES)


def _shards(segment: int, sequences: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, rows, size = [], 0, 0
        for b in batches:
            lengths = np.array([len(p) // ENTRY for p in b.column(2).to_pylist()])
            at = 0
            for k, x in enumerate(lengths.tolist()):
                rows, size = rows + 1, size + x
                if rows >= sequences or size >= TURNS:
                    held.append(b.slice(at, k + 1 - at))
                    yield shard_nodes(pa.Table.from_batches(held), number, segment)
                    number, held, rows, size, at = number + 1, [], 0, 0, k + 1
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield shard_nodes(pa.Table.from_batches(held), number, segment)
    return run


# --------------------------------------------------------------- turns in order

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, entry) -> their partition and number there within conv_id."""
    part, conv, n = TaskContext.get().partitionId(), None, 0
    for b in batches:
        ids = b.column(0).to_numpy()
        if not len(ids):
            continue
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        number = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids)))) + 1
        if ids[0] == conv:
            run = first[1] if len(first) > 1 else len(ids)
            number[:run] += n
        conv, n = ids[-1], int(number[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), b.column(0), pa.array(number),
                                          b.column(1)], ["part", "conv_id", "number", "entry"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (1 up), entry (hex of a turn's digest and code points).

    Rows are dealt by ranges of (conv_id, turn), so one long conversation
    spreads over tasks; a task's first and last conversations get the number
    of their rows in the tasks before."""
    spark = conversations.sparkSession
    base = scratch(spark, "turns")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(F.char_length(text)), 8, "0")).alias("entry")) \
        .filter("conv_id IS NOT NULL").write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    place = ["conv_id", F.col("turn").asc_nulls_first(), "entry"]
    rows.repartitionByRange(shuffle_partitions(spark), *place).sortWithinPartitions(*place) \
        .select("conv_id", "entry") \
        .mapInArrow(_numbered, "part int, conv_id long, number long, entry string").write.parquet(f"{base}/numbered")
    numbered = spark.read.parquet(f"{base}/numbered")
    # at most two conversations of a task lie in others, too
    ends = numbered.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")) \
        .select("part", F.explode(F.array_distinct(F.array("a", "b"))).alias("conv_id"))
    sizes = numbered.join(F.broadcast(ends), ["part", "conv_id"]).groupBy("part", "conv_id").agg(F.max("number").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.select("part", "conv_id", F.sum("n").over(before).alias("before")).filter("before > 0"))
    return numbered.join(F.broadcast(offsets), ["part", "conv_id"], "left") \
        .select("conv_id", (F.col("number") + F.coalesce("before", F.lit(0))).alias("position"), "entry")


def rebuilt(conversations: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, total, depth, entry; conversations: conv_id, total), rebuilt:
    conversation c takes the first h turns of conversation c - c % group, then
    its own after its first h; h = crc32(c) % (most + 1)."""
    spark = conversations.sparkSession
    base = scratch(spark, "rebuilt")
    ordered_turns(conversations).write.parquet(f"{base}/own")
    own = spark.read.parquet(f"{base}/own")
    heads = own.filter(f"conv_id % {group} = 0 AND position <= {most}").groupBy(F.col("conv_id").alias("first")) \
        .agg(F.array_sort(F.collect_list(F.struct("position", "entry"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")) \
        .select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("first")) \
        .join(heads, "first", "left").select("conv_id", "n", "h", F.slice(F.coalesce("head", F.expr(
            "cast(array() as array<struct<position:bigint,entry:string>>)")), F.lit(1), F.col("h")).alias("head")) \
        .withColumn("given", F.size("head").cast("long")) \
        .withColumn("total", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs.write.parquet(f"{base}/convs")
    convs = spark.read.parquet(f"{base}/convs")
    tails = join_groups(own, convs.select("conv_id", "n", "h", "given", "total"), ["conv_id"], "n") \
        .filter("position > h").select("conv_id", "total", (F.col("position") - F.col("h") + F.col("given")).alias("depth"), "entry")
    shared = convs.filter("given > 0").select("conv_id", "total", F.explode("head").alias("x")) \
        .select("conv_id", "total", F.col("x.position").alias("depth"), F.col("x.entry").alias("entry"))
    return tails.unionByName(shared), convs.select("conv_id", "total")


# --------------------------------------------------------------- the tree

def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted segments (conv_id, layer, path) -> the key of the node above each."""
    conv, key = None, ROOT
    for b in batches:
        out = []
        for c, path in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if c != conv:
                conv, key = c, ROOT
            out.append(key)
            for k in range(0, len(path), ENTRY):
                key = chain(key, path[k:k + DIGEST])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["conv_id", "layer", "top"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (end_key, conv_id) -> lists of at most ``IDS`` ids as text."""
    key, ids = None, []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([ids[0]]),
                                           pa.array([",".join(map(str, ids))])], ["end_key", "conv_id", "ids"])
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if ids and (k != key or len(ids) >= IDS):
                yield out()
                ids = []
            key = k
            ids.append(c)
    if ids:
        yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> the digest of each key's whole list, one piece in memory."""
    key, state = None, None
    for b in batches:
        keys, digests = [], []
        for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["end_key", "sha"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["end_key", "sha"])


def end_digests(ends: DataFrame) -> DataFrame:
    """end_key, sha: of the sorted, comma-joined conv_ids of every key (``ends`` is a stored table)."""
    parts = shuffle_partitions(ends.sparkSession)
    order = ["end_key", "conv_id"]
    pieces = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*order) \
        .mapInArrow(_pieces, "end_key binary, conv_id long, ids string")
    return pieces.repartition(parts, "end_key").sortWithinPartitions(*order).select(*order, "ids") \
        .mapInArrow(_hashed, "end_key binary, sha string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """key, n_leaves, saved_tokens over subtrees, from (key, parent_key, n_leaves,
    saved_tokens) of the nodes alone.  In round i a node holds the sums of its
    descendants nearer than 2**i and its ancestor at that distance."""
    spark = nodes.sparkSession
    base = scratch(spark, "sums")
    now = nodes.select("key", F.col("parent_key").alias("up"), "n_leaves", "saved_tokens")
    k = 0
    while True:
        now.write.parquet(f"{base}/{k}")
        now = spark.read.parquet(f"{base}/{k}")
        if now.filter("up IS NOT NULL").isEmpty():
            return now.drop("up")
        now.filter("up IS NOT NULL").groupBy("up").agg(
            F.count("*").alias("m"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")) \
            .withColumnRenamed("up", "key").write.parquet(f"{base}/{k}-below")
        below = spark.read.parquet(f"{base}/{k}-below")
        summed = now.join(below, "key", "left").select(
            "key", "up", (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"))
        # the ancestors' ancestors; the root's and those of what hangs at it are none
        below.join(now.select("key", F.col("up").alias("next")), "key").select(F.col("key").alias("up"), "m", "next") \
            .write.parquet(f"{base}/{k}-next")
        summed.write.parquet(f"{base}/{k}-summed")
        summed = spark.read.parquet(f"{base}/{k}-summed")
        ups = spark.read.parquet(f"{base}/{k}-next")
        far = join_groups(summed.filter("up IS NOT NULL"), ups, ["up"], "m") \
            .select("key", F.col("next").alias("up"), "n_leaves", "saved_tokens")
        now = far.unionByName(summed.filter("up IS NULL"))
        k += 1


def prefix_tree(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, sequences: int = SEQUENCES) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  ``turns`` has conv_id,
    total, depth (1 up), entry; ``convs`` conv_id, total (``rebuilt``)."""
    spark = turns.sparkSession
    base = scratch(spark, "trie")
    parts = shuffle_partitions(spark)
    layer = F.expr(f"(depth - 1) div {segment}").alias("layer")
    path = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "entry"))),
                                            lambda x: x["entry"]), ""))
    turns.groupBy("conv_id", "total", layer).agg(path.alias("path")).write.parquet(f"{base}/segments")
    segments = spark.read.parquet(f"{base}/segments")
    order = ["conv_id", "layer"]
    tops = segments.filter(f"total > {segment}").select(*order, "path").repartition(parts, "conv_id") \
        .sortWithinPartitions(*order).mapInArrow(_tops, "conv_id long, layer long, top binary")
    hung = segments.filter("layer = 0").withColumn("top", F.lit(ROOT)) \
        .unionByName(segments.filter("layer > 0").join(tops, order))
    end_key = F.unhex(F.substring(F.sha2(F.concat("top", "path"), 256), 1, 2 * DIGEST))
    hung.withColumn("last", F.expr(f"(layer + 1) * {segment} >= total")).withColumn("end_key", F.when(F.col("last"), end_key)) \
        .write.parquet(f"{base}/hung")
    hung = spark.read.parquet(f"{base}/hung")

    hung.groupBy("layer", "top", "path").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), (~F.every("last")).alias("more"),
        F.min("end_key").alias("end_key")).write.parquet(f"{base}/sequences")
    lex = ["layer", "top", "path"]
    spark.read.parquet(f"{base}/sequences").repartitionByRange(parts, *lex).sortWithinPartitions(*lex) \
        .select(*lex, "n", "conv_id", "more", "end_key") \
        .mapInArrow(_shards(segment, sequences), NODES).write.parquet(f"{base}/nodes")
    nodes = spark.read.parquet(f"{base}/nodes")

    # nodes that several shards may share
    bare = convs.filter("total = 0").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")) \
        .filter("n_convs > 0").select(
            F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("long").alias("depth"),
            "conv_id", "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("points", "n_children", "n_leaves", "saved_tokens")],
            F.lit(ROOT).alias("end_key"))
    merged = nodes.filter("open").select(*bare.columns).unionByName(bare).groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.max("points").alias("points"), F.sum("n_children").alias("closed"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("end_key").alias("end_key"))
    merged.write.parquet(f"{base}/merged")
    merged = spark.read.parquet(f"{base}/merged")
    below = merged.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("opened"))
    merged.join(below, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0))) \
        .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long")) \
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("points")) \
        .drop("closed").write.parquet(f"{base}/shared")
    shared = spark.read.parquet(f"{base}/shared")
    sums = subtree_sums(shared.select("key", "parent_key", "n_leaves", "saved_tokens"))
    parents = shared.filter("opened > 0").select(F.col("key").alias("parent_key"), "opened", F.col("conv_id").alias("parent_conv_id"))
    known = join_groups(shared.filter("parent_key IS NOT NULL").drop("opened", "n_leaves", "saved_tokens"),
                        parents, ["parent_key"], "opened").drop("opened") \
        .unionByName(shared.filter("parent_key IS NULL").drop("opened", "n_leaves", "saved_tokens")
                     .withColumn("parent_conv_id", F.lit(None).cast("long"))).join(sums, "key")

    # closed nodes whose parent is shared: looked up once a shard
    closed = nodes.filter("NOT open")
    wanted = closed.filter("parent_key IS NOT NULL").select("block", "parent_key").distinct() \
        .join(shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up")), "parent_key")
    edge = closed.filter("parent_key IS NOT NULL").join(wanted, ["block", "parent_key"]) \
        .withColumn("parent_conv_id", F.col("up")).drop("up")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key"]
    every = known.select(*out).unionByName(edge.select(*out)).unionByName(closed.filter("parent_key IS NULL").select(*out))

    hung.filter("last").select("end_key", "conv_id") \
        .unionByName(convs.filter("total = 0").select(F.lit(ROOT).alias("end_key"), "conv_id")).write.parquet(f"{base}/ends")
    ends = end_digests(spark.read.parquet(f"{base}/ends"))
    every.write.parquet(f"{base}/every")
    every = spark.read.parquet(f"{base}/every")
    ended = every.filter("end_key IS NOT NULL").join(ends, "end_key").withColumnRenamed("sha", "ends_sha256")
    return ended.drop("end_key").unionByName(
        every.filter("end_key IS NULL").drop("end_key").withColumn("ends_sha256", F.lit(NONE)))
