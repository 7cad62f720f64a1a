"""Quantiles to the last digit, as the SQL of the queries gives them."""

import random
from fractions import Fraction

import duckdb
import numpy as np
from pyspark.sql import functions as F

from emberline.operators import detections as D
from emberline.operators import ranks


def test_background_is_that_of_the_sql(spark):
    rng = random.Random(4)
    rows = [(i, 20.0 + i % 60, 75.0 if i % 7 else None, rng.choice("DN"), round(285 + rng.randrange(80) / 10, 1) if i % 11 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "ord long, latitude double, longitude double, daynight string, bt5 double").repartition(4)
    got = {r.ord: r.bg5 for r in D.background(df).select("ord", "bg5").collect()}
    con = duckdb.connect()
    con.register("t", df.toPandas())
    sql = "SELECT ord, quantile_cont(CASE WHEN isnan(bt5) THEN NULL ELSE bt5 END, 0.25) OVER (PARTITION BY round_even(latitude, 0), CASE WHEN isnan(longitude) THEN NULL ELSE longitude END, daynight) FROM t"
    want = dict(con.execute(sql).fetchall())
    assert got == want


def test_interpolation_rounds_the_sum_once(spark):
    rng = np.random.default_rng(6)
    rows = [(float(a), float(b), float(s)) for a, b, s in zip(rng.uniform(-400, 400, 500), rng.uniform(-1, 400, 500), rng.choice([0, 0.25, 0.5, 0.75, 0.01, 0.99, 1 / 3], 500))]
    got = spark.createDataFrame(rows, "a double, b double, s double").select("a", "b", "s", ranks.between(F.col("a"), F.col("b"), F.col("s")).alias("x")).collect()
    assert all(r.x == float(Fraction(r.a) * Fraction(1 - r.s) + Fraction(r.b * r.s)) for r in got)
    odd = spark.createDataFrame([(float("inf"), float("inf"), 0.25), (1e300, 1e300, 0.5), (None, 1.0, 0.5)], "a double, b double, s double")
    assert [r[0] for r in odd.select(ranks.between(F.col("a"), F.col("b"), F.col("s"))).collect()] == [float("inf"), 1e300, None]
