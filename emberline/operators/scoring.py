"""Registry corroboration, evidence, fusion, classes and explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from .spatial import nearest, nearest_places, within

#: What a site tells of itself.
SITE = {
    "facility_uid": "string", "name": "string", "ftype": "string", "lat": "double", "lon": "double", "sources_present": "string", "source_agreement": "int",
    "status": "string", "capacity_value": "double", "capacity_unit": "string", "subnational": "string",
}
# What a detection's surroundings are called, by distance to the nearest site.
CONTEXTS = ("On a registered industrial site", "Within the site's immediate surroundings", "Near industrial activity", "No registered industrial site nearby")
UNNAMED = "Unnamed industrial feature"
# Classes and their captions.
CLASSES = {
    "persistent_industrial_source": "Persistent industrial source",
    "industrial_fire": "Industrial fire",
    "flare_signature": "Flare signature",
    "agricultural_burning": "Agricultural burning",
    "insufficient_evidence": "Insufficient evidence",
}
INDUSTRIAL = ("persistent_industrial_source", "industrial_fire", "flare_signature")


def with_ordinal(facilities: DataFrame) -> DataFrame:
    """Records with ord: their registry's place in SOURCES, then their id."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, C.SOURCES)), F.col("source")), F.lit(9))
    return facilities.withColumn("ord", F.concat_ws(":", place.cast("string"), F.lpad("source_id", 12, "0")))


def sites_of(facilities: DataFrame) -> DataFrame:
    """The site table of facility records."""
    from .clusters import assign_sites, site_groups

    return site_groups(assign_sites(with_ordinal(facilities)))


def registry_distances(df: DataFrame, facilities: DataFrame, groups: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Distance to the nearest record of each registry, and the records within reach, for each detection; and if ``groups`` are given, its nearest site (_km, _site). One search for all.

    ``rows``: the same detections, if they cost less to make than ``df``; places are read from them.
    """
    placed = facilities.where("lat IS NOT NULL AND lon IS NOT NULL")
    nothing = F.struct(*[F.lit(None).cast(t).alias(c) for c, t in SITE.items()])
    targets = placed.select(F.col("source").alias("grp"), F.concat_ws(":", "source", "source_id").alias("ord"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), nothing.alias("site"))
    if groups is not None:
        own = F.struct(*[(F.col(c).cast(t) if c in groups.columns else F.lit(None).cast(t)).alias(c) for c, t in SITE.items()])
        targets = targets.unionByName(groups.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.lit("site").alias("grp"), F.col("facility_uid").alias("ord"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), own.alias("site")))
    points = (df if rows is None else rows).select(F.col("latitude").alias("plat"), F.col("longitude").alias("plon")).distinct()
    found, told = nearest_places(points, targets)
    to = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    near = found.groupBy("plat", "plon").agg(*[to(s, "km").alias(f"_d_{s}") for s in C.SOURCES], to("site", "km").alias("_km"), to("site", "n").alias("n"))
    near = near.join(told.withColumnRenamed("site", "_site"), "n", "left").drop("n")
    # records of one place are counted before they meet the points
    held = placed.groupBy(F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).agg(*[F.count_if(F.col("source") == s).alias(f"_h_{s}") for s in C.SOURCES])
    pairs = within(points.select(F.col("plat").alias("llat"), F.col("plon").alias("llon")), held, C.CORROBORATION_KM)
    counts = pairs.groupBy(F.col("llat").alias("plat"), F.col("llon").alias("plon")).agg(*[F.sum(f"_h_{s}").alias(f"_n_{s}") for s in C.SOURCES])
    both = near.join(counts, ["plat", "plon"], "left")
    out = df.join(both, (df["latitude"] == both["plat"]) & (df["longitude"] == both["plon"]), "left").drop("plat", "plon")
    out = out.withColumns({f"count_{s}_3km": F.coalesce(f"_n_{s}", F.lit(0)).cast("int") for s in C.SOURCES}).drop(*[f"_n_{s}" for s in C.SOURCES])
    return out if groups is not None else out.drop("_km", "_site")


def corroborate(df: DataFrame, facilities: DataFrame, groups: DataFrame | None = None, sources: tuple[str, ...] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Votes of the registries, and the nearest site with what it tells of itself.

    ``groups``: the site table; by default :func:`sites_of` the records. ``sources``: only
    these registries, and sites that any of them lists. ``rows``: of :func:`registry_distances`.
    """
    from .clusters import assign_sites, of_sources, site_groups
    from .graph import cut

    if groups is None or sources is not None:
        records = cut(assign_sites(with_ordinal(facilities)))
        groups = cut(site_groups(records)) if groups is None else groups
        if sources is not None:
            facilities, groups = of_sources(records, groups, list(sources))
    have = facilities.where("lat IS NOT NULL AND lon IS NOT NULL").agg(*[F.coalesce(F.bool_or(F.col("source") == s), F.lit(False)).alias(s) for s in C.SOURCES])
    loaded = have.select(F.array_compact(F.array(*[F.when(F.col(s), s) for s in C.SOURCES])).alias("_loaded")).crossJoin(groups.agg(F.count("*").alias("registry_sites")))
    df = registry_distances(df, facilities, groups, rows).crossJoin(F.broadcast(loaded))
    vote = lambda d: F.when(d <= C.ONSITE_KM, 1.0).when(d <= C.CORROBORATION_KM, 0.6).otherwise(0.0)
    total = sum((vote(F.col(f"_d_{s}")) for s in C.SOURCES), F.lit(0.0))
    names = F.array_compact(F.array(*[F.when(F.col(f"_d_{s}") <= C.CORROBORATION_KM, s) for s in C.SOURCES]))
    df = df.withColumns({
        "corroboration_score": X.half_even(X.clip(total / F.greatest(F.size("_loaded"), F.lit(1)), 0.0, 1.0), 4), "sources_loaded": F.array_join("_loaded", "|"), "_many": F.size("_loaded"),
        "sources_confirming": F.array_join(names, "|"), "confirming_count": F.size(names),
    })
    df = df.withColumns({f"dist_{s}_km": X.half_even(f"_d_{s}", 3) for s in C.SOURCES}).drop("_loaded", *[f"_d_{s}" for s in C.SOURCES])
    told = lambda c, blank=None: F.coalesce(F.col(f"_site.{c}"), F.lit(blank)) if blank is not None else F.col(f"_site.{c}")
    d = F.coalesce(X.half_even("_km", 3), F.lit(float("inf")))
    return df.withColumns({
        "dist_to_industrial_km": d, "facility_uid": told("facility_uid", ""), "facility_name": F.coalesce(F.when(F.trim("_site.name") != "", F.col("_site.name")), F.lit(UNNAMED)),
        "facility_type": told("ftype", ""), "facility_lat": told("lat"), "facility_lon": told("lon"), "facility_sources": told("sources_present", ""), "facility_source_agreement": told("source_agreement", 0),
        "facility_status": told("status", ""), "facility_capacity_value": told("capacity_value"), "facility_capacity_unit": told("capacity_unit", ""), "facility_subnational": told("subnational", ""),
        "industrial_context": F.when(d <= C.ONSITE_KM, CONTEXTS[0]).when(d <= C.CORROBORATION_KM, CONTEXTS[1]).when(d <= C.FAR_KM, CONTEXTS[2]).otherwise(CONTEXTS[3]),
    }).withColumnRenamed("_many", "loaded_count").drop("_km", "_site")


def evidence(df: DataFrame) -> DataFrame:
    """Weighted evidence; in season, cool and little corroborated fires are discounted."""
    w = C.EVIDENCE_WEIGHTS
    df = df.withColumn("physics_score", F.coalesce(X.half_even(X.clip((F.col("est_temp_k") - 800) / 700, 0.0, 1.0), 4), F.lit(0.25)))
    score = w["corroboration"] * F.col("corroboration_score") + w["physics"] * F.col("physics_score") + w["persistence"] * F.col("persistence_norm") + w["nocturnal"] * F.col("nocturnal_score") + w["intensity"] * F.col("frp_intensity_norm")
    penal = F.col("agri_season_context") & F.col("temp_class").isin("biomass_like", "smouldering", "unknown") & (F.col("corroboration_score") < 0.3)
    df = df.withColumn("agri_penalty", F.coalesce(penal, F.lit(False)))
    return df.withColumn("evidence_score", X.half_even(X.clip(F.when(F.col("agri_penalty"), score * C.SEASON_FACTOR).otherwise(score), 0.0, 1.0), 4))


def fuse(df: DataFrame, ml: str = "ml_probability", unsupervised: str = "unsupervised_score") -> DataFrame:
    """Weighted mean of the scores that exist; the weight of a column without any value goes to the others."""
    w = C.FUSION_WEIGHTS
    have = df.agg((F.count(ml) > 0).cast("double").alias("_m"), (F.count(unsupervised) > 0).cast("double").alias("_u"))
    df = df.crossJoin(F.broadcast(have))
    parts = w["evidence"] * F.col("evidence_score") + w["ml"] * F.col("_m") * F.coalesce(ml, "evidence_score") + w["unsupervised"] * F.col("_u") * F.coalesce(unsupervised, F.lit(0.5))
    df = df.withColumn("fusion_score", X.half_even(X.clip(parts / (w["evidence"] + w["ml"] * F.col("_m") + w["unsupervised"] * F.col("_u")), 0.0, 1.0), 4)).drop("_m", "_u")
    p = C.PRIORITY_WEIGHTS
    risk = p["probability"] * F.col("fusion_score") + p["abnormality"] * F.col("abnormality") + p["persistence"] * F.col("persistence_norm") + p["intensity"] * F.col("frp_intensity_norm") + p["new"] * F.col("new_source").cast("double")
    return df.withColumn("risk_score", X.half_even(X.clip(risk, 0.0, 1.0), 4)).withColumn("priority", X.priority_band("risk_score"))


def classify(df: DataFrame) -> DataFrame:
    """Ordered rules; the first that holds names the class."""
    corroborated = F.col("confirming_count") > 0
    far = ~corroborated & (F.col("dist_to_industrial_km") > C.FAR_KM)
    label = (
        F.when(far & F.col("agri_season_context"), "agricultural_burning").when(far, "insufficient_evidence").when(F.col("agri_penalty"), "agricultural_burning")
        .when((F.col("temp_class") == "flare_like") & (F.col("recurrence_days") >= 2) & corroborated, "flare_signature")
        .when((F.col("fusion_score") >= C.PERSISTENT_AT) & (F.col("recurrence_days") >= 3), "persistent_industrial_source")
        .when(F.col("fusion_score") >= C.INDUSTRIAL_AT, "industrial_fire").otherwise("insufficient_evidence")
    )
    caption = F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])
    df = df.withColumn("label", label).withColumn("label_display", caption[F.col("label")])
    return df.withColumn("evidence_level", F.when(F.col("label") != "insufficient_evidence", X.evidence_band("evidence_score")))


def weak_labels(df: DataFrame) -> DataFrame:
    on_site = (F.col("dist_to_industrial_km") <= C.ONSITE_KM) & (F.col("confirming_count") >= 2) & ~F.col("agri_season_context")
    none = (F.col("dist_to_industrial_km") > C.FAR_KM) & (F.col("confirming_count") == 0)
    return df.withColumn("weak_label", F.when(on_site, 1).when(none, 0))


PART = "key string, label string, value double, weight double, contribution double, detail string"


def explain(df: DataFrame) -> DataFrame:
    """contributions: JSON array of what made the evidence score, the largest first."""
    w = C.EVIDENCE_WEIGHTS
    number = lambda c, n=0: F.coalesce(F.format_string(f"%.{n}f", X.half_even(c, n)), F.lit("nan"))
    retrieved = F.concat(F.lit("retrieved "), number(F.col("est_temp_k")), F.lit(" K ("), F.replace(F.col("temp_class"), F.lit("_"), F.lit(" ")), F.lit(")"))
    # Captions of the parts and the form of their details.
    details = {
        "corroboration": ("corroboration_score", "Registry corroboration", F.format_string("%d of %d registries place infrastructure within 3 km", "confirming_count", "loaded_count")),
        "physics": ("physics_score", "Combustion temperature", F.when(F.col("est_temp_k").isNotNull(), retrieved).otherwise("temperature retrieval unavailable")),
        "persistence": ("persistence_norm", "Repeat detections", F.format_string("seen on %d separate days", "recurrence_days")),
        "nocturnal": ("nocturnal_score", "Burns at night", F.concat(number(F.col("night_fraction") * 100), F.lit("% of detections at night"))),
        "intensity": ("frp_intensity_norm", "Thermal intensity", F.concat(F.lit("FRP "), number(F.col("frp"), 1), F.lit(" MW, "), number(F.col("frp_intensity_norm") * 100), F.lit("th percentile"))),
    }

    def part(key, label, value, weight, contribution, detail):
        return F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), value.alias("value"), F.lit(weight).alias("weight"), contribution.alias("contribution"), detail.alias("detail"))

    parts = [part(k, label, X.half_even(c, 3), w[k], X.half_even(F.col(c) * w[k], 4), text) for k, (c, label, text) in details.items()]
    season = F.concat(F.lit("inside "), F.coalesce("agri_season_region", F.lit("")), F.lit(" during its burning window"))
    penalty = part("agri_penalty", "Crop-burning season", F.lit(1.0), -0.45, X.half_even(F.col("evidence_score") * -0.45, 4), season)
    every = F.concat(F.array(*parts), F.when(F.col("agri_penalty"), F.array(penalty)).otherwise(F.array().cast(f"array<struct<{PART.replace(', ', ',').replace(' ', ':')}>>")))
    numbered = F.transform(every, lambda x, i: F.struct((-F.abs(x["contribution"])).alias("by"), i.alias("i"), x.alias("x")))
    return df.withColumn("contributions", F.to_json(F.transform(F.array_sort(numbered), lambda s: s["x"])))


def score_all(df: DataFrame, facilities: DataFrame, ordinal: str = "ord", boundary: DataFrame | None = None, sources: tuple[str, ...] | None = None, models=None) -> DataFrame:
    """Every stage from raw detections to explained classes.

    ``boundary``: edges that detections must lie inside, before the best of a cell and day
    is taken; without it there is no clip. ``models`` adds ml_probability and unsupervised_score to the frame;
    without it both are null, and the evidence takes their weight.
    """
    from . import detections as D
    from .graph import cut
    from .spatial import inside_polygon

    df = D.confident(df)
    rows = cut(D.best_of_cell_day(df if boundary is None else inside_polygon(df, boundary), ordinal))
    # the stages so far are cut once; what follows reads them twice
    out = cut(evidence(corroborate(thermal(rows), facilities, sources=sources, rows=rows)))
    out = out.withColumns({"ml_probability": F.lit(None).cast("double"), "unsupervised_score": F.lit(None).cast("double")}) if models is None else models(out)
    return explain(classify(fuse(out)))


def thermal(rows: DataFrame) -> DataFrame:
    """The stages that no registry takes part in: background, physics, recurrence, baseline, season and power rank."""
    from . import detections as D
    from .graph import cut

    powers = D.distinct_values(rows, "frp")
    lit = D.background(rows)
    # statistics are taken of the rows as they came, not of what was joined to them; written, as the stages in one would be a method too long for the JVM to compile
    out = cut(D.season(D.average_rank(D.robust_baseline(lit, powers), "frp", "frp_intensity_norm", powers)))
    return D.subpixel(D.temporal(out, rows), out).withColumn("nocturnal_score", X.clip("night_fraction", 0.0, 1.0))


def ablation(rows: DataFrame, facilities: DataFrame, subsets: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Of each subset of the registries what the feed would be with it alone: one row each. ``rows``: of :func:`thermal`.

    Distances to every registry and to every subset's sites come from one search; subsets are
    rows of a small table that each detection meets, so scoring runs once for all.
    """
    from .clusters import assign_sites, site_groups
    from .graph import cut
    from .ranks import group_quantiles

    records = cut(assign_sites(with_ordinal(facilities)))
    groups = site_groups(records).where("lat IS NOT NULL AND lon IS NOT NULL")
    named = rows.sparkSession.createDataFrame([(i, "+".join(s), list(s)) for i, s in enumerate(subsets)], "i int, subset string, s array<string>")
    place = [F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.struct(F.lit(1).alias("x")).alias("site")]
    own = records.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("source").alias("grp"), "ord", *place)
    of_subset = groups.crossJoin(F.broadcast(named)).where(F.arrays_overlap(F.split("sources_present", "[|]"), "s")).select(F.concat(F.lit("subset "), "i").alias("grp"), F.col("facility_uid").alias("ord"), *place)
    near = nearest(rows.select(F.col("latitude").alias("plat"), F.col("longitude").alias("plon")).distinct(), own.unionByName(of_subset))
    to = lambda g: F.max(F.when(F.col("grp") == g, F.col("km")))
    near = near.groupBy("plat", "plon").agg(*[to(s).alias(f"_d_{s}") for s in C.SOURCES], F.array(*[to(f"subset {i}") for i in range(len(subsets))]).alias("_sites"))
    have = facilities.where("lat IS NOT NULL AND lon IS NOT NULL").agg(*[F.coalesce(F.bool_or(F.col("source") == s), F.lit(False)).alias(f"_have_{s}") for s in C.SOURCES])
    df = rows.join(near, (rows["latitude"] == near["plat"]) & (rows["longitude"] == near["plon"]), "left").crossJoin(F.broadcast(have)).crossJoin(F.broadcast(named))
    d = {s: F.when(F.array_contains("s", s), F.col(f"_d_{s}")) for s in C.SOURCES}
    loaded = sum(((F.array_contains("s", s) & F.col(f"_have_{s}")).cast("int") for s in C.SOURCES), F.lit(0))
    votes = sum((F.when(v <= C.ONSITE_KM, 1.0).when(v <= C.CORROBORATION_KM, 0.6).otherwise(0.0) for v in d.values()), F.lit(0.0))
    df = df.withColumns({
        "corroboration_score": X.half_even(X.clip(votes / F.greatest(loaded, F.lit(1)), 0.0, 1.0), 4), "confirming_count": sum((F.coalesce((v <= C.CORROBORATION_KM).cast("int"), F.lit(0)) for v in d.values()), F.lit(0)),
        "dist_to_industrial_km": F.coalesce(X.half_even(F.get("_sites", F.col("i")), 3), F.lit(float("inf"))), "ml_probability": F.lit(None).cast("double"), "unsupervised_score": F.lit(None).cast("double"),
    })
    out = cut(classify(fuse(evidence(df))).select("subset", "confirming_count", "label", "dist_to_industrial_km"))
    counts = out.groupBy("subset").agg(
        F.count_if(F.col("confirming_count") >= 1).alias("corroborated"), F.count_if(F.col("confirming_count") >= 2).alias("multi_confirmed"), F.count_if(F.col("label").isin(*INDUSTRIAL)).alias("industrial_total"),
        F.count_if(F.col("label") == INDUSTRIAL[0]).alias("persistent"), F.count_if(F.col("label") == "insufficient_evidence").alias("insufficient"),
    )
    middle = group_quantiles(out.withColumn("x", X.finite("dist_to_industrial_km")), "subset", "x", {"mid": 0.5})
    return counts.join(middle.select("subset", X.half_even("mid", 3).alias("median_distance_km")), "subset", "left")


#: Columns of the published table that the feed holds under another name.
PUBLISHED = {
    "temp_class": "temp_class", "abnormality": "thermal_abnormality", "regularity": "inter_arrival_regularity", "ceased_source": "ceased", "reactivated_source": "reactivated", "active_span": "active_span_days", "confirming_count": "sources_confirming_count",
    "facility_name": "nearest_facility_name", "facility_type": "nearest_facility_type", "facility_lat": "nearest_facility_lat", "facility_lon": "nearest_facility_lon", "agri_penalty": "agri_penalty_applied", "ml_probability": "ml_industrial_prob",
    "unsupervised_score": "unsupervised_anomaly", "priority": "risk_level", "label": "final_label", "label_display": "final_label_display",
}
# The published table, in order: column, type, section and what it holds.
OUTPUT = (
    ("detection_id", "string", "Identity", "id that follows from place, day and time"),
    ("latitude", "double", "Identity", "middle of the pixel, degrees"),
    ("longitude", "double", "Identity", "middle of the pixel, degrees"),
    ("acq_date", "date", "Identity", "day of the overpass, UTC"),
    ("acq_time", "int", "Identity", "time of the overpass, HHMM UTC"),
    ("daynight", "string", "Identity", "D by day, N by night"),
    ("satellite", "string", "Identity", "platform"),
    ("instrument", "string", "Identity", "VIIRS or MODIS"),
    ("source_sensor", "string", "Identity", "product and whether archived (SP) or near real time (NRT)"),
    ("confidence", "string", "Identity", "l, n, h, or 0 to 100"),
    ("scan", "double", "Identity", "pixel along the scan, km"),
    ("track", "double", "Identity", "pixel along the track, km"),
    ("grid_lat", "double", "Identity", "latitude of the grid cell"),
    ("grid_lon", "double", "Identity", "longitude of the grid cell"),
    ("frp", "double", "Radiometry", "fire radiative power, MW"),
    ("bright_ti4", "double", "Radiometry", "VIIRS brightness temperature at 3.74 um, K"),
    ("bright_ti5", "double", "Radiometry", "VIIRS brightness temperature at 11.45 um, K"),
    ("brightness", "double", "Radiometry", "MODIS brightness temperature at 3.96 um, K"),
    ("bright_t31", "double", "Radiometry", "MODIS brightness temperature at 11.03 um, K"),
    ("est_temp_k", "double", "Sub-pixel physics", "temperature of the fire, K, where the two channels give one"),
    ("hot_fraction", "double", "Sub-pixel physics", "share of the pixel that is hot"),
    ("est_area_m2", "double", "Sub-pixel physics", "hot area"),
    ("pixel_area_m2", "double", "Sub-pixel physics", "area of the pixel"),
    ("temp_class", "string", "Sub-pixel physics", "band of the temperature"),
    ("i4_saturated", "boolean", "Sub-pixel physics", "the short channel is at its ceiling"),
    ("temp_is_lower_bound", "boolean", "Sub-pixel physics", "the temperature is a floor, as the channel is saturated"),
    ("retrieval_status", "string", "Sub-pixel physics", "why there is a temperature or none"),
    ("baseline_frp", "double", "Baseline and abnormality", "median power of the group compared with"),
    ("baseline_level", "string", "Baseline and abnormality", "cell, region or scene"),
    ("frp_robust_z", "double", "Baseline and abnormality", "deviation from the median in scaled median deviations"),
    ("thermal_abnormality", "double", "Baseline and abnormality", "that deviation from 0 to 1, full at three"),
    ("frp_intensity_norm", "double", "Baseline and abnormality", "mean rank of the power among all rows"),
    ("recurrence_days", "int", "Temporal behaviour", "days on which the cell was seen"),
    ("detections_in_cell", "int", "Temporal behaviour", "detections of the cell"),
    ("night_fraction", "double", "Temporal behaviour", "share of them by night"),
    ("duty_cycle", "double", "Temporal behaviour", "share of the window's days with the cell alight"),
    ("inter_arrival_regularity", "double", "Temporal behaviour", "1 for even gaps between days"),
    ("frp_shift", "double", "Temporal behaviour", "largest step of the cell's daily power"),
    ("persistence_norm", "double", "Temporal behaviour", "days seen, full at fifteen"),
    ("nocturnal_score", "double", "Temporal behaviour", "share by night, from 0 to 1"),
    ("new_source", "boolean", "Temporal behaviour", "first seen at the end of the window"),
    ("ceased", "boolean", "Temporal behaviour", "dark at the end of the window"),
    ("reactivated", "boolean", "Temporal behaviour", "back after a long pause"),
    ("active_span_days", "int", "Temporal behaviour", "days from first to last sight"),
    ("observation_window_days", "int", "Temporal behaviour", "days of the window"),
    ("dist_to_industrial_km", "double", "Facility registry", "distance to the nearest site"),
    ("dist_osm_km", "double", "Facility registry", "distance to the nearest record of this registry"),
    ("dist_wri_km", "double", "Facility registry", "distance to the nearest record of this registry"),
    ("dist_gem_km", "double", "Facility registry", "distance to the nearest record of this registry"),
    ("dist_eog_km", "double", "Facility registry", "distance to the nearest record of this registry"),
    ("count_osm_3km", "int", "Facility registry", "records of this registry within 3 km"),
    ("count_wri_3km", "int", "Facility registry", "records of this registry within 3 km"),
    ("count_gem_3km", "int", "Facility registry", "records of this registry within 3 km"),
    ("count_eog_3km", "int", "Facility registry", "records of this registry within 3 km"),
    ("sources_loaded", "string", "Facility registry", "registries that take part"),
    ("sources_confirming", "string", "Facility registry", "registries with a record within 3 km"),
    ("sources_confirming_count", "int", "Facility registry", "how many those are"),
    ("corroboration_score", "double", "Facility registry", "votes of the registries over those that take part"),
    ("facility_uid", "string", "Facility registry", "nearest site"),
    ("nearest_facility_name", "string", "Facility registry", "its name"),
    ("nearest_facility_type", "string", "Facility registry", "its class"),
    ("nearest_facility_lat", "double", "Facility registry", "its latitude"),
    ("nearest_facility_lon", "double", "Facility registry", "its longitude"),
    ("facility_sources", "string", "Facility registry", "registries that list it"),
    ("facility_source_agreement", "int", "Facility registry", "how many those are"),
    ("facility_status", "string", "Facility registry", "its status"),
    ("facility_capacity_value", "double", "Facility registry", "its capacity"),
    ("facility_capacity_unit", "string", "Facility registry", "unit of the capacity"),
    ("facility_subnational", "string", "Facility registry", "its state or province"),
    ("industrial_context", "string", "Facility registry", "surroundings in words"),
    ("agri_season_context", "boolean", "Seasonal context", "in a burning belt in its season"),
    ("agri_season_region", "string", "Seasonal context", "which belt"),
    ("agri_penalty_applied", "boolean", "Seasonal context", "the evidence was discounted for it"),
    ("corroboration_component", "double", "Scores", "registries' part of the evidence"),
    ("physics_score", "double", "Scores", "temperature's part"),
    ("persistence_component", "double", "Scores", "recurrence's part"),
    ("nocturnal_component", "double", "Scores", "night's part"),
    ("intensity_component", "double", "Scores", "power's part"),
    ("evidence_score", "double", "Scores", "weighted evidence"),
    ("industrial_evidence_score", "double", "Scores", "the same, under its older name"),
    ("ml_industrial_prob", "double", "Scores", "calibrated probability of the classifier"),
    ("unsupervised_anomaly", "double", "Scores", "mean rank of two outlier scores"),
    ("anomaly_probability", "double", "Scores", "blend of the three scores"),
    ("fusion_score", "double", "Scores", "the same, as the viewer reads it"),
    ("risk_score", "double", "Scores", "priority of a look"),
    ("risk_level", "string", "Scores", "band of the priority"),
    ("final_label", "string", "Classification", "class"),
    ("final_label_display", "string", "Classification", "its caption"),
    ("evidence_level", "string", "Classification", "band of the evidence, none without a claim"),
    ("contributions", "string", "Classification", "what made the evidence, as JSON"),
    ("method_version", "string", "Classification", "version of the method"),
    ("cluster_id", "string", "Classification", "spatio-temporal cluster"),
)


def published(df: DataFrame, version: str) -> DataFrame:
    """The feed as the published table: every column of OUTPUT, in order, null where the feed has none."""
    from .reports import select_output

    modis = F.col("instrument").startswith("MODIS")
    same_ = {"corroboration_component": "corroboration_score", "persistence_component": "persistence_norm", "nocturnal_component": "nocturnal_score", "intensity_component": "frp_intensity_norm", "industrial_evidence_score": "evidence_score", "anomaly_probability": "fusion_score"}
    df = df.withColumns({c: F.col(x) for c, x in same_.items()})
    df = df.withColumns({"bright_ti4": F.when(~modis, F.col("bt4")), "bright_ti5": F.when(~modis, F.col("bt5")), "brightness": F.when(modis, F.col("bt4")), "bright_t31": F.when(modis, F.col("bt5")), "method_version": F.lit(version)})
    return select_output(df.withColumnsRenamed(PUBLISHED), [(c, t) for c, t, _, _ in OUTPUT])
