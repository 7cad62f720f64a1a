"""Connected components of an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local master, whose executors share its disk, may go without that setting: a temporary folder is used.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: its lineage ends, executors may be lost.

    A table, unlike a checkpoint, tells the planner its size; a checkpoint keeps the size that
    was guessed for the plan it replaces, and guesses over guesses grow without bound.
    """
    path = f"{folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides over tasks and sends neither whole to the driver.

    The planner judges a side by its files, whose columns are packed, and takes no account of rows
    that are copied to cells or salts: a table of 10 MB may be gigabytes where it is built for a broadcast.
    """
    return df.hint("merge")


#: Parts that the edges of one node are dealt over where they meet its least neighbour.
SALTS = 8


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour m of u; a hub's edges lie in several tasks."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(dealt(salted), ["u", "salt"]).drop("salt")


def followed(batches):
    """node and label (the least node of its component) of the edges (u, v) of all batches."""
    import pyarrow as pa

    parent, kind = {}, None

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        kind = batch.schema.types[0]
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = find(parent.setdefault(u, u)), find(parent.setdefault(v, v))
            parent[max(p, q)] = min(p, q)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), kind), pa.array([find(x) for x in parent], kind)], names=["node", "label"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """node and label (the least node of its component) of every node of an edge.

    Large-star and small-star contractions in turn until a round changes nothing
    (Kiveris et al., 2014); each round is checkpointed. A hub's edges meet only in
    partial aggregates and in salted joins. Up to ``few`` edges, of numbers or texts, are
    followed by one task in place of some ten small jobs a round.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    kind = now.schema["u"].dataType.simpleString()
    if kind in ("int", "bigint", "string") and now.count() <= few:
        return cut(now.repartition(1).mapInArrow(followed, f"node {kind}, label {kind}"))
    state = None
    while True:
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(around, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        now = cut(small.distinct())
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    labels = now.groupBy("u").agg(F.min("v").alias("label"))
    roots = now.select("v").distinct().join(dealt(labels.select(F.col("u").alias("v"))), "v", "left_anti")
    return labels.select(F.col("u").alias("node"), "label").unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("label")))
