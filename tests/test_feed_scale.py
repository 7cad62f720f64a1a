"""Stages of the feed that were slow on large tables."""

import math
import random

from pyspark.sql import functions as F

from emberline import config as C
from emberline.operators import detections as D


def test_bisection_of_whole_batches_is_that_of_one_row(spark):
    rng = random.Random(6)
    rows = [(i % 4 == 0, 310 + rng.random() * 57, 285 + rng.random() * 20, 280 + rng.random() * 15, 279 + rng.random() * 12) for i in range(200)]
    names = ("_modis", "bt4", "bt5", "bg4", "bg5")
    got = {tuple(r)[:5]: r._t for r in D.solutions(spark.createDataFrame(rows, "_modis boolean, bt4 double, bt5 double, bg4 double, bg5 double").select(*names)).collect()}
    radiance = lambda w, t: 2 * C.PLANCK_H * C.LIGHT_C**2 / (w * 1e-6) ** 5 / math.expm1(C.PLANCK_H * C.LIGHT_C / C.BOLTZMANN_K / (w * 1e-6 * t)) * 1e-6
    solved = 0
    for modis, bt4, bt5, bg4, bg5 in rows:
        w4, w5 = C.WAVELENGTHS["MODIS" if modis else "VIIRS"]

        def balance(t):
            near = radiance(w4, t) - radiance(w4, bg4)
            p = (radiance(w4, bt4) - radiance(w4, bg4)) / near if near > 0 else -1
            return p * (radiance(w5, t) - radiance(w5, bg5)) - (radiance(w5, bt5) - radiance(w5, bg5)) if 0 < p <= 1 else None

        lo, hi = max(C.SOLVER_LOW_K, bt4 + 0.5), C.SOLVER_HIGH_K
        a, b = balance(lo), balance(hi)
        found = got.get((modis, bt4, bt5, bg4, bg5))
        if bt4 - bg4 < C.MIN_EXCESS[0] or bt5 - bg5 < C.MIN_EXCESS[1] or a is None or b is None or a * b > 0:
            assert found is None
            continue
        for _ in range(C.SOLVER_STEPS):
            mid = (lo + hi) / 2
            f = balance(mid)
            lo, hi, a = (lo, mid, a) if a * f <= 0 else (mid, hi, f)
        assert abs(found - (lo + hi) / 2) < 1e-6
        solved += 1
    assert solved > 20


def test_small_statistics_go_to_the_rows(spark):
    rows = [(i, 20 + i % 7 / 100, 75 + i % 5 / 100, float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, latitude double, longitude double, frp double")
    plan = D.robust_baseline(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # four joins sorted the rows before
    assert D.robust_baseline(df).agg(F.count("frp_robust_z")).first()[0] == 300


def test_methods_of_the_feed_are_short_enough_to_be_compiled(spark):
    from emberline.operators import scoring

    rows = [(i, 20 + i % 7 / 100, 75 + i % 5 / 100, i % 31, 300 + i % 60, 285.0 + i % 9, "VIIRS" if i % 3 else "MODIS", "DN"[i % 2], 0.4, float(i % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, latitude double, longitude double, n int, bt4 double, bt5 double, instrument string, daynight string, scan double, frp double".replace("bt4 double", "k int"))
    df = df.withColumns({"acq_date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")), "bt4": F.col("k").cast("double"), "track": F.col("scan")}).drop("n", "k")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = scoring.thermal(df)._jdf.queryExecution().executedPlan()
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        found = debug.codegenStringSeq(plan)
        sizes = [found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) <= 8000  # the JVM interprets longer ones, row by row
