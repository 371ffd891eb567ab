"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

#: A group is hot when it holds more than 1 / HOT_SHARE of all rows, so there
#: are fewer than HOT_SHARE hot groups whatever the size of the input.
HOT_SHARE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table, in the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def place_of(docs: DataFrame) -> tuple[Column, Column]:
    """(file, row) of the rows of ``docs`` (``placed``), whatever its columns are called."""
    at = docs.metadataColumn("_metadata")
    return at["file_path"].alias("file"), at["row_index"].alias("row")


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from all ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with a place for every row: the Parquet file and the row in it.
    A table read from Parquet has them; any other is stored first.  Rows made
    from one row of a file (by explode or a join) have to be stored by the caller."""
    try:
        docs.select(*place_of(docs)).schema
        return docs
    except AnalysisException:
        path = scratch(docs.sparkSession, "placed")
        docs.write.parquet(path)
        return docs.sparkSession.read.parquet(path)


def drop_places(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``placed``) whose (file, row) is not in ``gone``."""
    names = [free_name(docs.columns, n) for n in ("place_file", "place_row")]
    here = docs.select("*", *[c.alias(n) for c, n in zip(place_of(docs), names)])
    gone = gone.select(F.col("file").alias(names[0]), F.col("row").alias(names[1]))
    return here.join(gone, names, "left_anti").select(*docs.columns)


def numbered_files(docs: DataFrame) -> DataFrame:
    """(file, number) of the files of ``docs`` (``placed``): as many rows as files."""
    files = docs.select(place_of(docs)[0]).distinct()
    return materialize(files.withColumn("number", F.row_number().over(Window.orderBy("file")).cast("long")))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: Sequence[str], size: str) -> DataFrame:
    """Give every row the columns of its group (inner join on ``key``).

    ``groups`` has one row per key with the number of its rows in ``size``.
    A hot group would put all its rows into one task; the hot groups are fewer
    than ``HOT_SHARE``, which bounds their broadcast, and the others are
    joined by a shuffle in which no key holds more than that share.  Both
    inputs are read twice, so they should be stored tables.
    """
    key = list(key)
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    mine = [c for c in groups.columns if c not in key]
    by_hot = rows.join(F.broadcast(hot), key)
    by_cold = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    cols = [*rows.columns, *mine]
    return by_hot.select(*cols).unionByName(by_cold.select(*cols))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per
    node that has an edge, ``component`` being the smallest node reachable.

    Every round gives each node the smallest label among its neighbours and
    itself, then follows labels once more (label of the label), so paths
    shrink by doubling; sums of labels tell when nothing changed.  Only
    counts reach the driver; each round's labels are a reliable checkpoint.
    The joins have the node tables, with unique keys, on one side.
    """
    both = edges.filter("a <> b").selectExpr("a AS node", "b AS other") \
        .unionByName(edges.filter("a <> b").selectExpr("b AS node", "a AS other")).distinct()
    both = materialize(both)
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        reach = both.join(labels.selectExpr("node AS other", "component AS c"), "other") \
            .groupBy("node").agg(F.min("c").alias("c"))
        near = labels.join(reach, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        step = near.join(labels.selectExpr("node AS component", "component AS c2"), "component", "left") \
            .select("node", "old", F.least("component", F.coalesce("c2", "component")).alias("component"))
        step = materialize(step)
        changed = step.filter("old <> component").limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels
