"""The older scoring profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .spatial import nearest


def legacy_scores(cells: DataFrame, facilities: DataFrame) -> DataFrame:
    """Label by distance and days, risk from persistence and scaled power, and its band."""
    sites = facilities.select(F.lit("all").alias("grp"), F.concat_ws(":", "source", "source_id").alias("ord"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.struct("name").alias("site"))
    near = nearest(cells.select(F.col("latitude").alias("plat"), F.col("longitude").alias("plon")), sites)
    scene = cells.agg(F.min("frp").alias("_a"), F.max("frp").alias("_b"))
    df = cells.join(near, (cells["latitude"] == near["plat"]) & (cells["longitude"] == near["plon"]), "left").crossJoin(F.broadcast(scene))
    risk = 0.6 * F.col("persistence_norm") + 0.4 * (F.col("frp") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))
    band = F.when(risk >= 0.65, "Critical").when(risk >= 0.45, "High").when(risk >= 0.25, "Moderate").otherwise("Low")
    return df.select("ord", ((F.col("km") < 2) & (F.col("recurrence_days") >= 2)).cast("int").alias("label"), X.half_even(risk, 6).alias("risk"), band.alias("band"))


def mean_ratio(df: DataFrame) -> DataFrame:
    """Power over the mean of its grid cell, and how far above it, up to three times, on a scale of 0 to 1."""
    from .detections import same, with_grid

    keys = ["grid_lat", "grid_lon"]
    rows = with_grid(df)
    out = same(rows, rows.groupBy(*keys).agg(F.avg("frp").alias("_mean")), keys)
    ratio = F.coalesce(F.col("frp") / F.nullif("_mean", F.lit(0.0)), F.lit(1.0))
    return out.withColumn("ratio", ratio).withColumn("abnormality", X.clip((F.col("ratio") - 1) / 2, 0.0, 1.0)).drop("_mean")


def fusion(df: DataFrame, facilities: DataFrame) -> DataFrame:
    """The older profile whole: components, fusion, its three ways to a label, evidence, both risks and the viewer's tier. ``df``: with recurrence_days and thermal_score."""
    sites = facilities.select(F.lit("all").alias("grp"), F.concat_ws(":", "source", "source_id").alias("ord"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.struct("name").alias("site"))
    near = nearest(df.select(F.col("latitude").alias("plat"), F.col("longitude").alias("plon")), sites).select("plat", "plon", "km")
    df = mean_ratio(df)
    scene = df.agg(F.min("frp").alias("_a"), F.max("frp").alias("_b"))
    df = df.join(near, (df["latitude"] == near["plat"]) & (df["longitude"] == near["plon"]), "left").crossJoin(F.broadcast(scene))
    # The older profile's steps and weights.
    near_ = F.when(F.col("km") < 2, 0.35).when(F.col("km") < 5, 0.15).otherwise(0.0)
    days = F.when(F.col("recurrence_days") >= 3, 0.30).when(F.col("recurrence_days") == 2, 0.20).otherwise(0.0)
    df = df.withColumns({"_f": near_, "_p": days, "_t": F.col("thermal_score") * 0.35})
    df = df.withColumns({"fusion_score": X.clip(F.col("_f") + F.col("_p") + F.col("_t"), 0.0, 1.0), "evidence": X.clip((F.col("_f") + F.col("_t")) / 0.7, 0.0, 1.0)})
    first = F.when(F.col("fusion_score") >= 0.6, "industrial").when(F.col("fusion_score") >= 0.3, "possible_industrial").otherwise("unknown_other")
    none = F.col("_f") == 0
    scaled = (F.col("frp") - F.col("_a")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0.0))
    tier = F.when(F.col("fusion_score") >= 0.9, "critical").when(F.col("fusion_score") >= 0.7, "high").when(F.col("fusion_score") >= 0.4, "medium").otherwise("low")
    return df.withColumns({
        "first_label": first, "corrected_label": F.when(none, "unknown_other").otherwise(first),
        "final_label": F.when(none, "insufficient_evidence").when(F.col("recurrence_days") >= 3, "persistent_industrial_source").otherwise("industrial_fire"),
        "evidence_level": F.when(~none, F.when(F.col("evidence") >= 0.7, "High").when(F.col("evidence") >= 0.4, "Moderate").otherwise("Low")),
        "risk_v1": X.clip(0.4 * F.col("fusion_score") + 0.35 * scaled + 0.25 * F.col("recurrence_days") / 5.0, 0.0, 1.0),
        "risk_v2": X.clip(0.6 * F.col("abnormality") + 0.4 * X.clip(F.col("recurrence_days") / 5.0, 0.0, 1.0), 0.0, 1.0), "tier": tier,
    }).drop("_a", "_b", "_f", "_p", "_t", "plat", "plon")
