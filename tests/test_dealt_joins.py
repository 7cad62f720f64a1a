"""Joins of rows that are copied to cells or salts send neither side whole to the driver, however small the files are."""

from pyspark.sql import functions as F

from emberline.operators import clusters, graph, spatial


def plan(df):
    """The plan that was run, not the one that was first made."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_copied_rows_are_not_broadcast(spark):
    places = graph.cut(spark.range(300).select(F.col("id").alias("i"), (20 + F.col("id") * 0.003).alias("lat"), F.lit(75.0).alias("lon")))
    side = lambda p: places.select(F.col("i").alias(f"{p}i"), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    pairs = spatial.within(side("l"), side("r"), 3.0)
    assert "BroadcastHashJoin" not in plan(pairs) and pairs.count() == sum(abs(a - b) * 0.003 * 111.195 <= 3.0 for a in range(300) for b in range(300))
    edges = graph.cut(spark.range(200).select((F.col("id") + 1).alias("u"), F.col("id").alias("v")))
    assert "BroadcastHashJoin" not in plan(graph.with_least(edges, edges.groupBy("u").agg(F.min("v").alias("m"))))


def test_members_of_clusters_are_not_broadcast(spark):
    rows = graph.cut(spark.range(400).select(F.col("id").alias("ord"), (20 + F.floor(F.col("id") / 2) * 0.1).alias("latitude"), F.lit(75.0).alias("longitude"), F.lit("2024-01-01").cast("date").alias("acq_date")))
    found = clusters.cluster(rows)
    assert "BroadcastHashJoin" not in plan(found) and {r.ord: r.cluster_root for r in found.collect()} == {i: i // 2 * 2 for i in range(400)}
