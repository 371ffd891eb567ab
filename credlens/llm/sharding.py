"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 65,536 cells; a row lies in the cell of its key's hash, and every
shard has virtual nodes at hashed cells.  A row goes clockwise to the first
node; a shard takes no more rows than its capacity, nearest rows first, and
what it cannot take goes on clockwise to the next node.  Capacities add up to
the number of rows and differ by one at most, so row counts do too, and a
change of the number of shards moves few rows.

Only row counts per cell reach the driver (a fixed bound), where the walk
round the ring gives each shard ranges of ranks in cells; a row finds its
range by its cell and its rank there.  Ranks come from a range sort, so a key
that holds most of the rows is spread over tasks like any other rows.

Documents are keyed by their texts: equal texts lie next to each other, and
such a group is cut only where a shard is full.

Defined results: null text has no bytes and is placed as an empty one; a null
key lies in one fixed cell; rows with the same key lie next to each other, by
their other columns; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

CELLS = 1 << 16
VIRTUAL_NODES = 64


def cell_of(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 48).cast("int")


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    def place(s: int, v: int) -> int:
        return int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:2], "big")
    return sorted((place(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def capacities(demand: list[int]) -> list[int]:
    """Near-equal capacities that add up to the demand; the spare rows go to
    the shards most in demand."""
    q, spare = divmod(sum(demand), len(demand))
    first = sorted(range(len(demand)), key=lambda s: (-demand[s], s))[:spare]
    return [q + (s in set(first)) for s in range(len(demand))]


def walk(counts: dict[int, int], shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, first slot): the rows of each cell by
    shard.  A shard fills up once, so cells are split ``shards`` times at most."""
    nodes = ring(shards, virtual_nodes)
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
    node = len(nodes) - 1
    for cell in sorted(counts, reverse=True):  # nearest to the node first
        while node >= 0 and nodes[node][0] >= cell:
            node -= 1
        waiting[(node + 1) % len(nodes)].append((cell, 0, counts[cell]))
    demand = [0] * shards
    for (_, s), w in zip(nodes, waiting, strict=True):
        demand[s] += sum(c[2] for c in w)
    room, slot, out = capacities(demand), [0] * shards, []
    while any(waiting):
        onward: list[list[tuple[int, int, int]]] = [[] for _ in nodes]
        for k, (_, s) in enumerate(nodes):
            for cell, lo, hi in waiting[k]:
                take = min(hi - lo, room[s])
                if take:
                    out.append((cell, lo, lo + take, s, slot[s]))
                    room[s] -= take
                    slot[s] += take
                if take < hi - lo:
                    onward[(k + 1) % len(nodes)].append((cell, lo + take, hi))
        waiting = onward
    return out


RANGES = "cell int, from_rank long, to_rank long, shard int, first_slot long"


def assign(rows: DataFrame, key: str, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``rows`` with their shard and their slot in it (gapless from 0)."""
    spark: SparkSession = rows.sparkSession
    # one stored copy: counts and ranks must see the same rows
    path = scratch(spark, "sharding")
    others = [c for c in rows.columns if c != key]
    order = ["_hash", key, *others, "_tie"]   # the tie spreads fully repeated rows
    hashed = rows.withColumn("_hash", F.xxhash64(key)).withColumn("_cell", cell_of(F.col(key))).withColumn("_tie", F.rand(7))
    hashed.repartitionByRange("_cell", *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.parquet(path)
    # CELLS rows, and one more at most where a cell is cut by the end of a part
    parts = materialize(stored.groupBy("_part", "_cell").agg(F.count("*").alias("_n")))
    counts = {r["_cell"]: r["n"] for r in parts.groupBy("_cell").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("_cell").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("_part", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranges = spark.createDataFrame(walk(counts, shards, virtual_nodes) if counts else [], RANGES)
    rank = F.row_number().over(Window.partitionBy("_part", "_cell").orderBy(*order)) - 1
    ranked = stored.withColumn("_rank", rank.cast("long")).join(F.broadcast(before), ["_part", "_cell"]) \
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
    here = (F.col("_cell") == F.col("cell")) & (F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank"))
    # at most CELLS + shards ranges
    return ranked.join(F.broadcast(ranges), here).select(
        *rows.columns, "shard", (F.col("first_slot") + F.col("_rank") - F.col("from_rank")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
                        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"))
    return assign(light, "group", shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
