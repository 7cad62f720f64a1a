"""Stages over detections: cleaning, physics, temporal signature, baseline, season."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from .graph import cut
from .ranks import average_rank, before, distinct_values, quantile_of_groups, quantiles  # noqa: F401


def best_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def archive_first(df: DataFrame, keys: list[str], archive: Column, ordinal: str) -> DataFrame:
    """Archived rows beat near-real-time ones of the same key; then the earlier row."""
    return best_per_key(df, keys, [archive.desc(), F.col(ordinal)])


def confident(df: DataFrame) -> DataFrame:
    return df.where(X.confidence_kept("confidence"))


def best_of_cell_day(df: DataFrame, ordinal: str = "ord") -> DataFrame:
    keys = [X.half_even("latitude", 2), X.half_even("longitude", 2), F.col("acq_date")]
    return best_per_key(df, keys, [X.confidence_rank("confidence").desc(), F.col("frp").desc_nulls_last(), X.sensor_rank("source_sensor").desc(), F.col(ordinal)])


def clean(df: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Confident detections, the best of each cell and day."""
    return best_of_cell_day(confident(df), ordinal)


def same(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the statistics of its group; null keys are a group too.

    The statistics are written as a table, so the planner knows whether they are small enough to go to where the rows are.
    """
    right = cut(stats).withColumnsRenamed({k: f"_r{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys]
    return df.join(right, on, "left").drop(*[f"_r{k}" for k in keys])


def background(df: DataFrame) -> DataFrame:
    """bg5 and bg4: the lower quartile of the 11 um channel of each degree cell and time of day, else of the scene.

    Cells are summed up and joined back: a task holds a busy cell's distinct values, not its rows.
    """
    keyed = df.withColumns({"_bla": X.half_even("latitude"), "_blo": X.half_even("longitude")})
    stats = quantile_of_groups(keyed, ["_bla", "_blo", "daynight"], "bt5", 0.25, "bg5")
    scene = cut(quantiles(df, "bt5", {"_scene": 0.25}))
    out = same(keyed, stats, ["_bla", "_blo", "daynight"]).crossJoin(F.broadcast(scene)).withColumn("bg5", F.coalesce("bg5", "_scene")).drop("_scene", "_bla", "_blo")
    return out.withColumn("bg4", F.col("bg5") + F.when(F.col("daynight") == "D", C.BACKGROUND_OFFSET["D"]).otherwise(C.BACKGROUND_OFFSET["N"]))


def radiances(df: DataFrame) -> DataFrame:
    """What the two-channel method starts from: of rows with _modis, bt4, bt5, bg4 and bg5 their radiances, why there may be no solution (_early), and the bounds between which one is sought."""
    modis = F.col("_modis")
    wl4 = F.when(modis, C.WAVELENGTHS["MODIS"][0]).otherwise(C.WAVELENGTHS["VIIRS"][0])
    wl5 = F.when(modis, C.WAVELENGTHS["MODIS"][1]).otherwise(C.WAVELENGTHS["VIIRS"][1])
    df = df.withColumns({"_w4": wl4, "_w5": wl5})
    df = df.withColumns({"_l4": X.planck(F.col("_w4"), F.col("bt4")), "_g4": X.planck(F.col("_w4"), F.col("bg4")), "_l5": X.planck(F.col("_w5"), F.col("bt5")), "_g5": X.planck(F.col("_w5"), F.col("bg5"))})
    df = df.withColumn("_lo", F.greatest(F.lit(C.SOLVER_LOW_K), F.col("bt4") + 0.5))
    early = (
        F.when(F.col("bt4").isNull() | F.col("bt5").isNull() | F.col("bg4").isNull() | F.col("bg5").isNull(), "no_data")
        .when(F.col("bt4") - F.col("bg4") < C.MIN_EXCESS[0], "below_background")
        .when(F.col("bt5") - F.col("bg5") < C.MIN_EXCESS[1], "weak_11um")
        .when(F.col("_lo") >= C.SOLVER_HIGH_K, "unconstrained")
    )
    return df.withColumn("_early", early)


INPUTS = ("_modis", "bt4", "bt5", "bg4", "bg5")


def solutions(inputs: DataFrame) -> DataFrame:
    """Distinct inputs of the two-channel method that have a solution, and it (_t), by bisection."""
    # written before they are solved: else what is asked of the radiances goes down to the rows and their joins, in methods too long for the JVM to compile
    df = cut(radiances(cut(inputs.select(*INPUTS).distinct()))).where("_early IS NULL")
    (top4, m4), (top5, m5) = X.planck_terms(F.col("_w4")), X.planck_terms(F.col("_w5"))
    df = df.withColumns({"_top4": top4, "_m4": m4, "_top5": top5, "_m5": m5, "_x4": F.col("_l4") - F.col("_g4"), "_x5": F.col("_l5") - F.col("_g5")})

    def residual(t: Column) -> Column:
        near, far = X.radiance(F.col("_top4"), F.col("_m4"), t) - F.col("_g4"), X.radiance(F.col("_top5"), F.col("_m5"), t) - F.col("_g5")
        p = F.col("_x4") / near
        return F.when((near > 0) & (p > 0) & (p <= 1), p * far - F.col("_x5"))

    df = df.withColumns({"_flo": residual(F.col("_lo")), "_fhi": residual(F.lit(C.SOLVER_HIGH_K))})
    bracketed = F.col("_flo").isNotNull() & F.col("_fhi").isNotNull() & (F.col("_flo") * F.col("_fhi") <= 0)
    df = df.where(bracketed).select(*INPUTS, "_lo", "_flo", "_top4", "_m4", "_top5", "_m5", "_g4", "_g5", "_x4", "_x5")
    return df.mapInArrow(bisected, "_modis boolean, bt4 double, bt5 double, bg4 double, bg5 double, _t double")


def bisected(batches):
    """The inputs of each batch and the temperature (_t) between whose bounds the balance changes sign, all rows halved at once; null where it is not told on the way."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lo, flo, top4, m4, top5, m5, g4, g5, x4, x5 = (batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names[len(INPUTS) :])
        hi, ok = np.full(len(lo), C.SOLVER_HIGH_K), np.ones(len(lo), dtype=bool)
        with np.errstate(all="ignore"):
            for _ in range(C.SOLVER_STEPS):
                mid = (lo + hi) / 2
                near, far = (top / np.expm1(X.PLANCK_RATIO / (m * mid)) * 1e-6 - g for top, m, g in ((top4, m4, g4), (top5, m5, g5)))
                p = x4 / near
                ok &= (near > 0) & (p > 0) & (p <= 1)
                f = p * far - x5
                left = flo * f <= 0
                lo, hi, flo = np.where(left, lo, mid), np.where(left, mid, hi), np.where(left, flo, f)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in INPUTS), pa.array((lo + hi) / 2, mask=~ok)], names=[*INPUTS, "_t"])


def subpixel(df: DataFrame, inputs: DataFrame | None = None) -> DataFrame:
    """Temperature, fraction and area of the fire by the two-channel method; equal inputs are solved once.

    ``inputs``: a frame with the instruments, temperatures and backgrounds of ``df`` that costs less to make, if there is one.
    """
    modis = F.coalesce(F.col("instrument").startswith("MODIS"), F.lit(False))
    df = radiances(df.withColumn("_modis", modis))
    found = cut(solutions(df if inputs is None else inputs.withColumn("_modis", modis))).withColumnsRenamed({c: f"_r{c}" for c in INPUTS})
    df = df.join(found, [F.col(c) == F.col(f"_r{c}") for c in INPUTS], "left").drop(*[f"_r{c}" for c in INPUTS])
    df = df.withColumn("_over", X.planck(F.col("_w4"), F.col("_t")) - F.col("_g4"))
    df = df.withColumn("_p", F.when(F.col("_over") > 0, (F.col("_l4") - F.col("_g4")) / F.col("_over")))
    status = (
        F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("_t").isNull(), "no_bracket").when(F.col("_t") >= C.SOLVER_EDGE_K, "unconstrained")
        .when(F.col("_p").isNull() | (F.col("_p") <= 0) | (F.col("_p") > 1), "no_solution").otherwise("ok")
    )
    df = df.withColumn("_status", status)
    ok = F.col("_status") == "ok"
    area = F.coalesce("scan", F.lit(C.DEFAULT_PIXEL_KM)) * F.coalesce("track", F.lit(C.DEFAULT_PIXEL_KM)) * 1e6
    saturated = F.coalesce(F.col("instrument").startswith("VIIRS") & (F.col("bt4") >= C.I4_SATURATION_K), F.lit(False))
    df = df.withColumns({
        "est_temp_k": F.when(ok, X.half_even("_t", 1)), "hot_fraction": F.when(ok, F.col("_p")), "pixel_area_m2": X.half_even(area, 1),
        "est_area_m2": F.when(ok, X.half_even(F.col("_p") * area, 1)), "i4_saturated": saturated, "temp_is_lower_bound": saturated & ok,
        "retrieval_status": F.when(saturated, "saturated_lower_bound").otherwise(F.col("_status")),
    })
    return df.withColumn("temp_class", X.temperature_class("est_temp_k")).drop("_modis", "_w4", "_w5", "_l4", "_g4", "_l5", "_g5", "_lo", "_early", "_t", "_over", "_p", "_status")


def with_grid(df: DataFrame) -> DataFrame:
    return df.withColumns({"grid_lat": X.half_even("latitude", 2), "grid_lon": X.half_even("longitude", 2)})


def tail(window: Column, rule: tuple[float, int]) -> Column:
    return F.greatest(F.lit(rule[1]), F.rint(window * rule[0]).cast("int"))


def temporal_cells(df: DataFrame) -> DataFrame:
    """One row per grid cell: its signature over the days it was seen, and life-cycle flags."""
    grid = with_grid(df)
    span = df.agg(F.min("acq_date").alias("d0"), (F.datediff(F.max("acq_date"), F.min("acq_date")) + 1).alias("window"))
    keys = ["grid_lat", "grid_lon"]
    days = grid.crossJoin(F.broadcast(span)).groupBy(*keys, "window", F.datediff("acq_date", "d0").alias("day"))
    days = days.agg(F.avg("frp").alias("frp"), F.count("*").alias("n"), F.sum((F.upper("daynight") == "N").cast("int")).alias("nights"))
    w = Window.partitionBy(*keys).orderBy("day")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(*keys)
    days = days.withColumns({
        "gap": F.col("day") - F.lag("day").over(w), "k": F.row_number().over(w), "left": F.sum("frp").over(upto), "total": F.sum("frp").over(all_), "m": F.count("*").over(all_), "sd": F.stddev_pop("frp").over(all_),
    })
    shift = F.when(F.col("k") < F.col("m"), F.abs((F.col("total") - F.col("left")) / F.nullif(F.col("m") - F.col("k"), F.lit(0)) - F.col("left") / F.col("k")) / F.nullif("sd", F.lit(0.0)))
    cells = days.withColumn("shift", shift).groupBy(*keys, "window").agg(
        F.count("*").alias("recurrence_days"), F.sum("n").alias("detections_in_cell"), F.sum("nights").alias("nights"), F.min("day").alias("first"), F.max("day").alias("last"),
        F.avg("gap").alias("mu"), F.stddev_pop("gap").alias("sigma"), F.max("gap").alias("gap"), F.max("shift").alias("shift"),
    )
    n, last_day = F.col("window"), F.col("window") - 1
    return cells.select(
        *keys, F.col("recurrence_days").cast("int").alias("recurrence_days"), F.col("detections_in_cell").cast("int").alias("detections_in_cell"),
        (F.col("nights") / F.col("detections_in_cell")).alias("night_fraction"), (F.col("recurrence_days") / n).alias("duty_cycle"),
        F.when(F.col("recurrence_days") >= 3, X.clip(1 - F.col("sigma") / F.col("mu"), 0.0, 1.0)).alias("regularity"),
        F.when(F.col("recurrence_days") >= 4, F.least(F.coalesce("shift", F.lit(0.0)), F.lit(4.0)) / 4).otherwise(0.0).alias("frp_shift"),
        F.coalesce(F.col("gap") - 1, F.lit(0)).cast("int").alias("longest_gap"), (F.col("last") - F.col("first") + 1).cast("int").alias("active_span"),
        (F.col("first") >= last_day - (tail(n, C.TAILS["new"]) - 1)).alias("new_source"),
        ((F.col("last") <= last_day - tail(n, C.TAILS["ceased"])) & (F.col("recurrence_days") >= 2)).alias("ceased_source"),
        ((F.coalesce(F.col("gap") - 1, F.lit(0)) >= tail(n, C.TAILS["reactivated"])) & (F.col("recurrence_days") >= 2)).alias("reactivated_source"),
        X.clip(F.col("recurrence_days") / F.least(n, F.lit(C.PERSISTENCE_FULL_DAYS)), 0.0, 1.0).alias("persistence_norm"), n.alias("observation_window_days"),
    )


def temporal(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Detections with their cells' signatures. ``rows``: the same detections without what was joined to them, if they cost less to make."""
    return with_grid(df).join(cut(temporal_cells(df if rows is None else rows)), ["grid_lat", "grid_lon"])


def spread(df: DataFrame, keys: list[str], mid: str, size: str, mad: str) -> DataFrame:
    """Of each group of ``df`` the median of frp, the rows and the scaled median absolute deviation."""
    middle = cut(df.groupBy(*keys).agg(F.median("frp").alias(mid), F.count("*").alias(size)))
    off = same(df.select(*keys, "frp"), middle, keys).groupBy(*keys).agg((F.median(F.abs(F.col("frp") - F.col(mid))) * C.MAD_TO_SIGMA).alias(mad))
    return same(middle, off, keys)


def robust_baseline(df: DataFrame, powers: DataFrame | None = None) -> DataFrame:
    """Robust z of frp against its cell, else region, else scene. ``powers``: the distinct values of frp, if they are known."""
    powers = distinct_values(df, "frp") if powers is None else powers
    df = with_grid(df).withColumns({"_rla": X.half_even("latitude", 1), "_rlo": X.half_even("longitude", 1)})
    for keys, names in ((["grid_lat", "grid_lon"], ("_mc", "_nc", "_sc")), (["_rla", "_rlo"], ("_mr", "_nr", "_sr"))):
        df = same(df, spread(df.select("grid_lat", "grid_lon", "_rla", "_rlo", "frp"), keys, *names), keys)
    mid = quantiles(df, "frp", {"_ms": 0.5}, powers)
    off = powers.crossJoin(F.broadcast(mid)).groupBy(F.abs(F.col("_v") - F.col("_ms")).alias("_v")).agg(F.sum("_n").alias("_n"))
    scene = quantiles(df, "_off", {"_ss": 0.5}, before(off, [F.col("_v")], "_below", F.col("_n"))).withColumn("_ss", F.col("_ss") * C.MAD_TO_SIGMA)
    df = df.crossJoin(F.broadcast(mid)).crossJoin(F.broadcast(scene))
    level = F.when(F.col("_nc") >= C.MIN_SAMPLES, "cell").when(F.col("_nr") >= C.MIN_SAMPLES, "region").otherwise("scene")
    pick = lambda c, r, s: F.when(F.col("baseline_level") == "cell", F.col(c)).when(F.col("baseline_level") == "region", F.col(r)).otherwise(F.col(s))
    df = df.withColumn("baseline_level", level)
    df = df.withColumns({"baseline_frp": pick("_mc", "_mr", "_ms"), "_sd": pick("_sc", "_sr", "_ss")})
    sigma = F.greatest(F.coalesce(F.nullif("_sd", F.lit(0.0)), "_ss", F.lit(0.0)), F.lit(C.SIGMA_FLOOR))
    df = df.withColumn("frp_robust_z", X.clip((F.col("frp") - F.col("baseline_frp")) / sigma, *C.Z_RANGE))
    df = df.withColumn("abnormality", X.clip(F.col("frp_robust_z") / C.ABNORMAL_SIGMAS, 0.0, 1.0))
    return df.drop("_rla", "_rlo", "_mc", "_mr", "_nc", "_nr", "_sc", "_sr", "_ms", "_ss", "_sd")


def season(df: DataFrame, day: str = "acq_date") -> DataFrame:
    """Whether a detection lies in a burning region in its months, and the first such region."""
    name = None
    for region, lat, lon, months in C.SEASONS:
        hit = F.col("latitude").between(*lat) & F.col("longitude").between(*lon) & F.month(day).isin(*months)
        name = F.when(hit, region) if name is None else name.when(hit, region)
    return df.withColumn("agri_season_region", name).withColumn("agri_season_context", F.col("agri_season_region").isNotNull())
