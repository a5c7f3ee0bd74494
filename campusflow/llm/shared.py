"""Helpers of the operators: checkpoints in the shared folder, a let-binding, connected components."""

from __future__ import annotations

import gc
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.session import checkpoint_dir

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Spark's setting to remove the shuffle files of an action that has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Edges that a task contracts before the rounds of connected_components.
SHARE = 1 << 19


def persisted(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder; survives the loss of executors.

    The shuffle files of the computation go when it ends, not when the driver's JVM happens to collect.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame takes the setting when it is made
    finally:
        spark.conf.set(CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files and checkpoints that nothing refers to any more: it learns of
    them when the driver's JVM collects, which a driver with little to do otherwise puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name = "_" + name
    return name


def running_sums(values: Column) -> Column:
    """array<bigint>: inclusive running sums of an array, in blocks of about its root so that long ones stay cheap."""
    def scan(a):
        empty = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(a, empty, lambda acc, x: F.struct(
            (acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"] + x)).alias("out")),
            lambda acc: acc["out"])

    def blocked(a):
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int")),
                             lambda b: scan(F.slice(a, b * width + 1, width)))
        return let(blocks, lambda bs: let(scan(F.transform(bs, lambda b: F.element_at(b, -1))), lambda ends: F.flatten(
            F.transform(bs, lambda b, i: F.transform(b, lambda x: x + F.when(
                i == 0, F.lit(0).cast("long")).otherwise(F.get(ends, i - 1)))))))

    return let(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(blocked(a)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): distributed union-find over undirected edges by alternating large and
    small stars; the component is its smallest node.  Only nodes with an edge to another are returned.

    First each share of at most about SHARE edges is contracted by itself, which is all there is to do for few edges.
    Each round then is two aggregations with map-side combine and two joins whose inputs are both plain
    shuffles, so that AQE splits the rows of a hub.  The edge list is checkpointed each round, and one row
    of counts tells whether every node already points at a root.
    """
    e = persisted(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                  .filter("u is not null and v is not null and u != v").distinct())
    shares = math.ceil(e.count() / SHARE)
    if shares:
        e = persisted(e.repartition(shares).mapInArrow(_stars, e.schema))
    while shares > 1 and not _is_star_forest(e):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = persisted(sym.groupBy("u").agg(F.min("v").alias("m"))
                           .select(F.col("u").alias("c"), F.least("u", "m").alias("m")))
        large = persisted(sym.join(lowest, F.col("u") == F.col("c")).filter("v > u")
                          .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = persisted(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"))
        small = (large.join(lowest, F.col("u") == F.col("c")).filter("v != m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = persisted(small.unionByName(lowest.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(batches):
    """(u, v): the edges of a partition with each node at the smallest of its component."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    ends = pa.concat_arrays([c for name in ("u", "v") for c in edges.column(name).chunks])
    code, nodes = pd.factorize(ends.to_numpy(zero_copy_only=False), sort=True)
    a, b, root = code[: len(edges)], code[len(edges):], np.arange(len(nodes))
    while True:
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        if (high == low).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    kind = edges.schema.field("u").type
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], kind), pa.array(nodes[root[moved]], kind)], ["u", "v"])


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u of another edge; edges go from larger to smaller nodes."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("points"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("points"), F.lit(1).alias("root")))
    each = ends.groupBy("x").agg(F.sum("points").alias("points"), F.max("root").alias("root"))
    return not each.filter((F.col("points") > 1) | ((F.col("points") > 0) & (F.col("root") > 0))).limit(1).count()
