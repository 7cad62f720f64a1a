"""Positions, ranks and exact quantiles over whole tables, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def before(df: DataFrame, order: list[Column], out: str, weight: Column | None = None) -> DataFrame:
    """``df`` with the number of rows (or the sum of ``weight``) that come before each row in ``order``.

    Rows are dealt to ranges of ``order``; each range is summed, and a row's position is what
    the ranges before hold and what its own range holds before it. One row a range is
    all that meets in one place. Rows of equal order get positions in no order.
    """
    weight = F.lit(1).cast("long") if weight is None else weight
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumn("_w", weight))
    sizes = parts.groupBy("_part").agg(F.sum("_w").alias("_sum"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_offset"))  # a row a partition
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn(out, F.coalesce(F.sum("_w").over(inside), F.lit(0))).join(F.broadcast(offsets), "_part").withColumn(out, F.col(out) + F.col("_offset")).drop("_part", "_w", "_offset")


def distinct_values(df: DataFrame, value: str | Column, out: str = "_v") -> DataFrame:
    """Distinct non-null values, how many rows hold each (_n), and how many rows hold smaller ones (_below)."""
    col = F.col(value) if isinstance(value, str) else value
    table = df.select(col.alias(out)).where(F.col(out).isNotNull()).groupBy(out).agg(F.count("*").alias("_n"))
    return before(table, [F.col(out)], "_below", F.col("_n"))


def average_rank(df: DataFrame, value: str, out: str, table: DataFrame | None = None) -> DataFrame:
    """Average rank of ``value`` over the number of rows that have one; null where it is null. ``table``: :func:`distinct_values`, if it is known."""
    table = distinct_values(df, value) if table is None else table
    total = table.agg(F.sum("_n").alias("_total"))
    ranks = cut(table.crossJoin(F.broadcast(total)).select("_v", ((F.col("_below") + (F.col("_n") + 1) / 2) / F.col("_total")).alias(out)))
    return df.join(ranks, df[value] == ranks["_v"], "left").drop("_v")


def between(low: Column, high: Column, share: Column) -> Column:
    """``low * (1 - share) + high * share``, whose first product is not rounded before the sum: what the SQL engine's quantiles give to the last digit.

    A quantile that is off by its last digit passes a threshold, or does not, where the SQL has it the other way.
    """
    weight, add = 1 - share, high * share
    product = low * weight
    split = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # noqa: E731 (the upper half of the digits)
    a, b = split(low), split(weight)
    lost = ((a * b - product) + a * (weight - b) + (low - a) * b) + (low - a) * (weight - b)
    total = product + add
    rest = total - product
    return F.when(F.abs(total) < 1e290, total + (((product - (total - rest)) + (add - rest)) + lost)).otherwise(total)


def quantiles(df: DataFrame, value: str | Column, points: dict[str, float], table: DataFrame | None = None) -> DataFrame:
    """One row of exact quantiles, linear between neighbours, a column each; nulls for an empty table."""
    table = distinct_values(df, value) if table is None else table
    total = table.agg(F.sum("_n").alias("_total"))
    met = table.crossJoin(F.broadcast(total))
    out = []
    for name, p in points.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))
        low, high = (F.max(F.when(holds(k), F.col("_v"))) for k in (F.floor(at), F.ceil(at)))
        share = F.max(at - F.floor(at))
        out.append(between(low, high, share).alias(name))
    return met.agg(*out)


def group_quantiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """Of each group its exact quantiles, least and greatest value, distinct values and rows: group, low, high, distinct, rows and the points."""
    table = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = before(table, [F.col("_g"), F.col("_v")], "_below", F.col("_n"))
    sizes = placed.groupBy("_g").agg(F.min("_below").alias("_start"), F.sum("_n").alias("_total"))
    met = placed.join(F.broadcast(sizes), "_g").withColumn("_below", F.col("_below") - F.col("_start"))  # groups are columns or classes, which are few
    out = [F.min("_v").alias("low"), F.max("_v").alias("high"), F.count("*").alias("distinct"), F.max("_total").alias("rows")]
    for name, p in points.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))
        low, high = (F.max(F.when(holds(k), F.col("_v"))) for k in (F.floor(at), F.ceil(at)))
        out.append(between(low, high, F.max(at - F.floor(at))).alias(name))
    return met.groupBy(F.col("_g").alias(group)).agg(*out)


def quantile_of_groups(df: DataFrame, keys: list[str], value: str, p: float, out: str) -> DataFrame:
    """Of each group (null keys are one too) an exact quantile of ``value``: keys and ``out``. A task holds a group's distinct values, not its rows."""
    table = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    met = table.withColumns({"_below": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_at": F.lit(float(p)) * (F.sum("_n").over(group) - 1)})
    holds = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))
    ends = met.groupBy(*keys).agg(*[F.max(F.when(holds(k), F.col("_v"))).alias(n) for n, k in (("_low", F.floor("_at")), ("_high", F.ceil("_at")))], F.max(F.col("_at") - F.floor("_at")).alias("_share"))
    return ends.select(*keys, between(F.col("_low"), F.col("_high"), F.col("_share")).alias(out))
