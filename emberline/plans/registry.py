"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..operators.graph import cut
from ..operators import clusters, detections as D, outliers, reports, scoring, spatial
from . import oracles as O
from . import views

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = O.sql(sql)
        return f

    return add


def r6(c):
    return X.half_even(c, 6)


def six(*names: str) -> str:
    return ", ".join(f"{O.he(n, 6)} AS {n}" for n in names)


def rounded(*names: str):
    return [r6(n).alias(n) for n in names]


def clean(spark, d):
    return D.clean(views.detections(spark, d))


def cleaned(spark, d):
    """As :func:`clean`, cut for stages that read it several times."""
    return cut(clean(spark, d))


@query("SELECT ord, latitude, longitude, acq_date, frp FROM clean")
def dedup_best_per_cell_day(spark, d):
    return clean(spark, d).select("ord", "latitude", "longitude", "acq_date", "frp")


@query(f"SELECT ord, ({O.KEPT}) AS kept, ({O.CRANK}) AS conf_rank, ({O.SRANK}) AS sensor_rank FROM det")
def confidence_filter(spark, d):
    return views.detections(spark, d).select("ord", X.confidence_kept("confidence").alias("kept"), X.confidence_rank("confidence").alias("conf_rank"), X.sensor_rank("source_sensor").alias("sensor_rank"))


@query("SELECT ord, user_id, acq_date, source_sensor FROM det QUALIFY row_number() OVER (PARTITION BY user_id, acq_date ORDER BY (source_sensor LIKE '%_SP') DESC, ord) = 1")
def archive_beats_nrt(spark, d):
    return D.archive_first(views.detections(spark, d), ["user_id", "acq_date"], F.col("source_sensor").endswith("_SP"), "ord").select("ord", "user_id", "acq_date", "source_sensor")


@query("SELECT ord, label, risk_score FROM classed WHERE label IN ('industrial_fire', 'persistent_industrial_source') AND acq_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND longitude BETWEEN 74.0 AND 77.0 AND latitude BETWEEN 19.0 AND 22.0 AND risk_score >= 0.2 AND (contains('|' || sources_confirming || '|', '|osm|') OR contains('|' || sources_confirming || '|', '|gem|')) AND contains(lower(facility_name), 'e')")
def api_detections(spark, d):
    q = reports.DetectionQuery.parse({"label": "industrial_fire, persistent_industrial_source", "from": "2024-01-05", "to": "2024-01-20", "bbox": "74,19,77,22", "min_score": "0.2", "min_fusion": "x", "sources": "osm,gem,zzz", "q": "E"})
    return q.apply(interface.known(spark, d)).select("ord", "label", "risk_score")


def scored(spark, d, **options):
    return scoring.score_all(views.detections(spark, d), views.facilities(spark, d), **options)


POLYGON = [[[(75.0, 20.0), (77.0, 20.0), (77.0, 22.5), (76.0, 21.0), (75.0, 22.5)], [(75.5, 20.5), (75.8, 20.5), (75.8, 20.8), (75.5, 20.8)]]]
EDGES = spatial.polygon_edges(POLYGON)


@query(f"""SELECT d.ord FROM det d, (VALUES {', '.join(str(e) for e in EDGES)}) e(x1, y1, x2, y2) GROUP BY d.ord, d.latitude, d.longitude
HAVING sum(((y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / nullif(y2 - y1, 0) + x1)::INT) % 2 = 1
 AND NOT bool_or((x2 - x1) * (latitude - y1) - (y2 - y1) * (longitude - x1) = 0 AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2) AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2))""")
def point_in_polygon(spark, d):
    edges = spark.createDataFrame(EDGES, "x1 double, y1 double, x2 double, y2 double")
    return spatial.inside_polygon(views.detections(spark, d), edges).select("ord")


@query(f"SELECT ord, {', '.join(O.he(f'd_{s}', 3) + f' AS dist_{s}_km, n_{s} AS count_{s}_3km' for s in C.SOURCES)} FROM clean JOIN near USING (latitude, longitude)")
def nearest_facility(spark, d):
    out = scoring.registry_distances(cleaned(spark, d), views.facilities(spark, d))
    return out.select("ord", *[c for s in C.SOURCES for c in (X.half_even(f"_d_{s}", 3).alias(f"dist_{s}_km"), F.col(f"count_{s}_3km"))])


@query(f"SELECT ord, corroboration_score, coalesce(sc, '') AS sources_confirming, confirming_count, di AS dist_to_industrial_km, site.uid AS facility_uid, industrial_context FROM clean JOIN reg USING (latitude, longitude)")
def corroboration_score(spark, d):
    return scoring.corroborate(cleaned(spark, d), views.facilities(spark, d)).select("ord", "corroboration_score", "sources_confirming", "confirming_count", "dist_to_industrial_km", "facility_uid", "industrial_context")


@query(f"SELECT a, b, {O.he('km', 6)} AS km FROM pairs")
def spatiotemporal_pairs(spark, d):
    return clusters.spacetime_pairs(clean(spark, d)).select("a", "b", r6("km").alias("km"))


@query(f"""SELECT 'C' || row_number() OVER (ORDER BY size DESC, cluster_root) AS cluster_id, * FROM (SELECT cluster_root, count(*)::INT AS size, {O.he('sum(latitude::DECIMAL(18,9))::DOUBLE / count(latitude)', 5)} AS centroid_lat, {O.he('sum(longitude::DECIMAL(18,9))::DOUBLE / count(longitude)', 5)} AS centroid_lon, min(acq_date) AS first_seen, max(acq_date) AS last_seen, count(DISTINCT acq_date)::INT AS active_days,
 {O.he('max(frp)', 2)} AS max_frp, {O.he('avg(frp)', 2)} AS mean_frp, CASE WHEN count(*) FILTER (instrument = 'MODIS') >= count(*) FILTER (instrument = 'VIIRS') THEN 'MODIS' ELSE 'VIIRS' END AS main_instrument, bool_or(daynight = 'N') AS any_night, arg_max(ord, struct_pack(f := frp, o := -ord)) AS lead_ord,
 string_agg(DISTINCT source_sensor, '|' ORDER BY source_sensor) AS sensors FROM clean JOIN members USING (ord) GROUP BY cluster_root)""")
def cluster_summary(spark, d):
    rows = cleaned(spark, d)
    return clusters.cluster_summary(rows, clusters.cluster(rows))


def records(spark, d):
    return scoring.with_ordinal(views.facilities(spark, d))


SITE = "sources_present, source_agreement, status, capacity_unit, record_count, ftype, name, subnational"


@query(f"SELECT uid AS facility_uid, {six('lat', 'lon')}, {O.he('capacity_value', 2)} AS capacity_value, {SITE} FROM site")
def site_groups(spark, d):
    out = clusters.site_groups(clusters.assign_sites(records(spark, d)))
    return out.select("facility_uid", *rounded("lat", "lon"), X.half_even("capacity_value", 2).alias("capacity_value"), *SITE.split(", "))


def grid_sites(spark, d):
    return records(spark, d).withColumn("facility_uid", F.concat_ws(",", X.half_even("lat", 1), X.half_even("lon", 1)))


GRID = f"SELECT *, CASE source WHEN 'osm' THEN '0' WHEN 'wri' THEN '1' ELSE '2' END || ':' || lpad(source_id, 12, '0') AS o, round_even(lat * 10, 0) AS ka, round_even(lon * 10, 0) AS kb FROM fac"


@query(f"""SELECT ka / 10 AS key_lat, kb / 10 AS key_lon, {O.he('avg(lat)', 6)} AS lat, {O.he('avg(lon)', 6)} AS lon, string_agg(DISTINCT source, '|' ORDER BY source) AS sources_present, count(DISTINCT source)::INT AS source_agreement,
 CASE WHEN bool_or(status = 'operating') THEN 'operating' ELSE arg_min(status, o) END AS status, {O.he("coalesce(sum(capacity_value) FILTER (capacity_unit = 'MW'), max(capacity_value) FILTER (capacity_unit = 'ttpa'))", 2)} AS capacity_value,
 CASE WHEN sum(capacity_value) FILTER (capacity_unit = 'MW') IS NOT NULL THEN 'MW' WHEN max(capacity_value) FILTER (capacity_unit = 'ttpa') IS NOT NULL THEN 'ttpa' ELSE '' END AS capacity_unit, count(*)::INT AS record_count,
 arg_min(ftype, struct_pack(r := list_position({list(X.FTYPE_RANK)}, ftype), o := o)) AS ftype, coalesce(arg_min(name, struct_pack(s := source = 'osm', o := o)) FILTER (trim(name) <> ''), '') AS name FROM ({GRID}) GROUP BY ka, kb""")
def site_collapse(spark, d):
    out = clusters.site_groups(grid_sites(spark, d))
    key = F.split("facility_uid", ",")
    return out.select(key[0].cast("double").alias("key_lat"), key[1].cast("double").alias("key_lon"), *rounded("lat", "lon"), "sources_present", "source_agreement", "status", X.half_even("capacity_value", 2).alias("capacity_value"), "capacity_unit", "record_count", "ftype", "name")


@query(f"WITH g AS ({GRID}), k AS (SELECT ka, kb, count(DISTINCT source) AS k FROM g GROUP BY ALL) SELECT source, count(*) AS records, count(DISTINCT (ka, kb)) AS sites, count(DISTINCT (ka, kb)) FILTER (k > 1) AS confirmed_by_other FROM g JOIN k USING (ka, kb) GROUP BY source".replace("WITH g", "SELECT * FROM (WITH g") + ")")
def registry_overlap(spark, d):
    return clusters.overlap(grid_sites(spark, d))


@query(f"SELECT ord, {six('bg5', 'bg4')} FROM bg")
def background_quartile(spark, d):
    return D.background(clean(spark, d)).select("ord", *rounded("bg5", "bg4"))


@query(f"SELECT ord, est_temp_k, {O.he('hot_fraction', 5)} AS hot_fraction, pixel_area_m2, {O.he('est_area_m2', 0)} AS est_area_m2, i4_saturated, retrieval_status, temp_class FROM phys")
def subpixel_temperature(spark, d):
    return D.subpixel(D.background(clean(spark, d))).select("ord", "est_temp_k", X.half_even("hot_fraction", 5).alias("hot_fraction"), "pixel_area_m2", X.half_even("est_area_m2").alias("est_area_m2"), "i4_saturated", "retrieval_status", "temp_class")


@query("SELECT temp_class, count(*) AS n, " + O.he("count(*) / sum(count(*)) OVER ()", 6) + " AS share FROM phys GROUP BY temp_class")
def temp_class_counts(spark, d):
    n = D.subpixel(D.background(clean(spark, d))).groupBy("temp_class").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("temp_class", "n", r6(F.col("n") / F.col("t")).alias("share"))


@query(f"SELECT ord, baseline_level, {six('baseline_frp', 'frp_robust_z', 'abnormality')} FROM base")
def robust_baseline(spark, d):
    return D.robust_baseline(clean(spark, d)).select("ord", "baseline_level", *rounded("baseline_frp", "frp_robust_z", "abnormality"))


@query(f"SELECT ord, {six('frp_intensity_norm')} FROM inten")
def avg_rank_pct(spark, d):
    return D.average_rank(clean(spark, d), "frp", "frp_intensity_norm").where("frp IS NOT NULL").select("ord", *rounded("frp_intensity_norm"))


CELL = ("night_fraction", "duty_cycle", "regularity", "frp_shift", "persistence_norm")


@query(f"SELECT grid_lat, grid_lon, recurrence_days, detections_in_cell, {six(*CELL)}, longest_gap, active_span FROM cells")
def temporal_signature(spark, d):
    return D.temporal_cells(clean(spark, d)).select("grid_lat", "grid_lon", "recurrence_days", "detections_in_cell", *rounded(*CELL), "longest_gap", "active_span")


@query("SELECT grid_lat, grid_lon, new_source, ceased_source, reactivated_source FROM cells")
def lifecycle_flags(spark, d):
    return D.temporal_cells(clean(spark, d)).select("grid_lat", "grid_lon", "new_source", "ceased_source", "reactivated_source")


SHIFTED = "SELECT ord, latitude + 6 AS latitude, longitude, (acq_date + CAST(30 * (user_id % 12) AS INT)) AS day FROM det"


@query(f"SELECT ord, agri_season_region, agri_season_region IS NOT NULL AS agri_season_context FROM (SELECT *, {O.season('day')} AS agri_season_region FROM ({SHIFTED}))")
def season_context(spark, d):
    moved = views.detections(spark, d).select("ord", (F.col("latitude") + 6).alias("latitude"), "longitude", F.date_add("acq_date", (30 * (F.col("user_id") % 12)).cast("int")).alias("day"))
    return D.season(moved, "day").select("ord", "agri_season_region", "agri_season_context")


@query("SELECT ord, physics_score, agri_penalty, evidence_score FROM evid")
def evidence_score(spark, d):
    return scored(spark, d).select("ord", "physics_score", "agri_penalty", "evidence_score")


@query("SELECT ord, fusion_score, risk_score, priority FROM fused")
def fusion_priority(spark, d):
    return scored(spark, d).select("ord", "fusion_score", "risk_score", "priority")


@query("SELECT ord, label, evidence_level, facility_name FROM classed")
def classify(spark, d):
    return scored(spark, d).select("ord", "label", "evidence_level", "facility_name")


PARTS = (
    ("corroboration", "Registry corroboration", "corroboration_score", 0.30, "printf('%d of %d registries place infrastructure within 3 km', confirming_count, (SELECT count(DISTINCT source) FROM fac))"),
    ("physics", "Combustion temperature", "physics_score", 0.25, "CASE WHEN est_temp_k IS NULL THEN 'temperature retrieval unavailable' ELSE printf('retrieved %.0f K (%s)', round_even(est_temp_k, 0), replace(temp_class, '_', ' ')) END"),
    ("persistence", "Repeat detections", "persistence_norm", 0.20, "printf('seen on %d separate days', recurrence_days)"),
    ("nocturnal", "Burns at night", "nocturnal_score", 0.10, "printf('%.0f%% of detections at night', round_even(night_fraction * 100, 0))"),
    ("intensity", "Thermal intensity", "frp_intensity_norm", 0.15, f"printf('FRP %.1f MW, %.0fth percentile', {O.he('frp', 1)}, round_even(frp_intensity_norm * 100, 0))"),
)
EXPLAINED = " UNION ALL ".join(f"SELECT ord, {n} AS i, '{k}' AS key, '{label}' AS label, {O.he(c, 3)} AS value, {w}::DOUBLE AS weight, {O.he(f'{c} * {w}', 4)} AS contribution, {text} AS detail FROM classed" for n, (k, label, c, w, text) in enumerate(PARTS))
EXPLAINED += f" UNION ALL SELECT ord, 5, 'agri_penalty', 'Crop-burning season', 1.0, -0.45, {O.he('evidence_score * -0.45', 4)}, 'inside ' || agri_season_region || ' during its burning window' FROM classed WHERE agri_penalty"


@query(f"SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY abs(contribution) DESC, i) AS place, key, label, value, weight, contribution, detail FROM ({EXPLAINED})")
def explanations(spark, d):
    parts = F.posexplode(F.from_json("contributions", f"array<struct<{scoring.PART.replace(', ', ',').replace(' ', ':')}>>")).alias("place", "part")
    return interface.known(spark, d).select("ord", parts).select("ord", (F.col("place") + 1).cast("long").alias("place"), "part.*")


@query("SELECT ord, CASE WHEN dist_to_industrial_km <= 1 AND confirming_count >= 2 AND agri_season_region IS NULL THEN 1 WHEN dist_to_industrial_km > 10 AND confirming_count = 0 THEN 0 END AS weak_label FROM classed")
def weak_labels(spark, d):
    return scoring.weak_labels(interface.known(spark, d)).select("ord", "weak_label")


@query(f"""SELECT {O.he('(sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)', 6)} AS auc, count(*) FILTER (s >= 0.5 AND y = 1) AS tp, count(*) FILTER (s >= 0.5 AND y = 0) AS fp, count(*) FILTER (s < 0.5 AND y = 0) AS tn, count(*) FILTER (s < 0.5 AND y = 1) AS fn
FROM (SELECT y, s, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM (SELECT evidence_score AS s, CASE WHEN dist_to_industrial_km <= 1 AND confirming_count >= 2 AND agri_season_region IS NULL THEN 1 WHEN dist_to_industrial_km > 10 AND confirming_count = 0 THEN 0 END AS y FROM classed) WHERE y IS NOT NULL)""")
def auc_from_scores(spark, d):
    return reports.auc(scoring.weak_labels(interface.known(spark, d)), "evidence_score", "weak_label")


@query("SELECT acq_date, count(*) FILTER (daynight = 'D') AS \"D\", count(*) FILTER (daynight = 'N') AS \"N\" FROM (SELECT unnest(generate_series(min(acq_date), max(acq_date), INTERVAL 1 DAY))::DATE AS acq_date FROM clean) LEFT JOIN clean USING (acq_date) GROUP BY acq_date")
def daily_by_class(spark, d):
    return reports.daily_by_class(clean(spark, d), "daynight", ["D", "N"])


@query(f"SELECT floor(latitude / 0.5) * 0.5 + 0.25 AS lat, floor(longitude / 0.5) * 0.5 + 0.25 AS lon, count(*) AS n, {O.he('avg((frp > 20)::INT)', 3)} AS share FROM clean GROUP BY ALL")
def footprint(spark, d):
    return reports.footprint(clean(spark, d), F.col("frp") > 20)


@query("SELECT substr(source_sensor, 1, 40) AS value, count(*) AS n FROM clean GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
def top_sensors(spark, d):
    return reports.top_values(clean(spark, d), "source_sensor")


@query(f"SELECT user_id, count(*) AS detections, count(DISTINCT acq_date) AS days, min(acq_date) AS first_seen, max(acq_date) AS last_seen, {O.he('max(frp)', 4)} AS max_frp, {O.he('sum(frp::DECIMAL(18,9))::DOUBLE / count(frp)', 4)} AS mean_frp FROM clean GROUP BY user_id")
def site_summary(spark, d):
    return clean(spark, d).groupBy("user_id").agg(F.count("*").alias("detections"), F.count_distinct("acq_date").alias("days"), F.min("acq_date").alias("first_seen"), F.max("acq_date").alias("last_seen"), X.half_even(F.max("frp"), 4).alias("max_frp"), X.half_even(clusters.exact_mean("frp"), 4).alias("mean_frp"))


@query(f"SELECT acq_date, count(ord) AS n, {O.he('coalesce(max(frp), 0)', 6)} AS max_frp FROM (SELECT unnest(generate_series(min(acq_date), max(acq_date), INTERVAL 1 DAY))::DATE AS acq_date FROM clean) LEFT JOIN (SELECT * FROM clean WHERE user_id = 3) USING (acq_date) GROUP BY acq_date")
def site_daily_log(spark, d):
    rows = clean(spark, d)
    return reports.day_spine(rows).join(rows.where("user_id = 3"), "acq_date", "left").groupBy("acq_date").agg(F.count("ord").alias("n"), r6(F.coalesce(F.max("frp"), F.lit(0.0))).alias("max_frp"))


@query("SELECT ord, acq_date, acq_time FROM clean WHERE user_id = 3 ORDER BY acq_date DESC, acq_time DESC, ord LIMIT 200")
def latest_at_site(spark, d):
    return clean(spark, d).where("user_id = 3").orderBy(F.desc("acq_date"), F.desc("acq_time"), "ord").limit(200).select("ord", "acq_date", "acq_time")


@query("SELECT facility_uid AS site, arg_max(ord, struct_pack(r := risk_score, o := -ord)) AS lead_ord, max(risk_score) AS risk_score, count(*) AS detections, count(DISTINCT acq_date) AS days FROM classed GROUP BY 1")
def group_by_site(spark, d):
    return reports.group_by_site(interface.known(spark, d))


@query("SELECT ord, frp FROM clean ORDER BY frp DESC NULLS LAST, ord LIMIT 400")
def feed_topk(spark, d):
    return reports.feed(clean(spark, d), "frp").select("ord", "frp")


@query("SELECT least(399, floor((longitude - 67.5) / 31 * 400))::BIGINT AS gx, least(399, floor((latitude - 6.5) / 31 * 400))::BIGINT AS gy, count(*) AS n FROM clean GROUP BY ALL")
def density_grid(spark, d):
    at = lambda c, low: F.least(F.lit(399), F.floor((F.col(c) - low) / 31 * 400))
    return clean(spark, d).groupBy(at("longitude", 67.5).alias("gx"), at("latitude", 6.5).alias("gy")).agg(F.count("*").alias("n"))


@query("SELECT h::INT AS hour, count(ord) AS n FROM (SELECT unnest(range(24)) AS h) LEFT JOIN clean ON acq_time // 100 = h GROUP BY h")
def hourly_histogram(spark, d):
    hours = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(clean(spark, d).select(F.expr("acq_time div 100").cast("int").alias("hour"), "ord"), "hour", "left").groupBy("hour").agg(F.count("ord").alias("n"))


STATS = ("mean", "std", "low", "q1", "mid", "q3", "high")


@query(f"SELECT source_sensor, n, {six(*STATS)} FROM (SELECT source_sensor, count(frp) AS n, avg(frp) AS mean, stddev_samp(frp) AS std, min(frp) AS low, quantile_cont(frp, 0.25) AS q1, median(frp) AS mid, quantile_cont(frp, 0.75) AS q3, max(frp) AS high FROM clean GROUP BY 1)")
def describe_by_label(spark, d):
    out = clean(spark, d).groupBy("source_sensor").agg(F.count("frp").alias("n"), F.avg("frp").alias("mean"), F.stddev_samp("frp").alias("std"), F.min("frp").alias("low"), F.percentile("frp", F.lit(0.25)).alias("q1"), F.median("frp").alias("mid"), F.percentile("frp", F.lit(0.75)).alias("q3"), F.max("frp").alias("high"))
    return out.select("source_sensor", "n", *rounded(*STATS))


@query(f"SELECT d::INT AS d, sum(m)::BIGINT AS shown, {O.he('sum(0.8 * m * (1 - (d - e) / 7))', 6)} AS weight FROM (SELECT DISTINCT date_diff('day', DATE '2024-01-01', acq_date) AS d FROM clean) a JOIN (SELECT date_diff('day', DATE '2024-01-01', acq_date) AS e, count(*) AS m FROM clean GROUP BY 1) b ON e BETWEEN d - 6 AND d GROUP BY d")
def playback_trail(spark, d):
    return reports.playback(clean(spark, d)).select("d", "shown", r6("weight").alias("weight"))


@query("SELECT count(*) AS total, count(*) FILTER (confirming_count >= 2) AS multi_source, count(*) FILTER (est_temp_k IS NOT NULL) AS retrieved, count(*) FILTER (label = 'industrial_fire') AS industrial, count(*) FILTER (label = 'persistent_industrial_source') AS persistent, count(*) FILTER (label = 'flare_signature') AS flares, count(*) FILTER (label = 'agricultural_burning') AS agricultural, count(*) FILTER (label = 'insufficient_evidence') AS insufficient FROM classed")
def stats(spark, d):
    is_ = lambda v: F.count_if(F.col("label") == v)
    return interface.known(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("confirming_count") >= 2).alias("multi_source"), F.count_if(F.col("est_temp_k").isNotNull()).alias("retrieved"), is_("industrial_fire").alias("industrial"), is_("persistent_industrial_source").alias("persistent"), is_("flare_signature").alias("flares"), is_("agricultural_burning").alias("agricultural"), is_("insufficient_evidence").alias("insufficient"))


@query("SELECT s AS source, count(*) AS confirmed FROM (SELECT unnest(string_split(sc, '|')) AS s FROM clean JOIN reg USING (latitude, longitude) WHERE confirming_count > 0) GROUP BY s")
def source_status(spark, d):
    c = scoring.corroborate(cleaned(spark, d), views.facilities(spark, d))
    return c.where("confirming_count > 0").select(F.explode(F.split("sources_confirming", "[|]")).alias("source")).groupBy("source").agg(F.count("*").alias("confirmed"))


@query("SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(p_name, 'none')), '[^a-z0-9 ]+', ' ', 'g'), '\\b(" + "|".join(X.NAME_NOISE) + ")\\b', ' ', 'g'), ' +', ' ', 'g')) AS name FROM part")
def name_normalise(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), X.normal_name("p_name").alias("name"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT ord, substr(md5(printf('%.5f', latitude) || ':' || printf('%.5f', longitude) || ':' || acq_date::VARCHAR || ':' || acq_time::VARCHAR), 1, 12) AS detection_id FROM det")
def detection_ids(spark, d):
    return views.detections(spark, d).select("ord", X.detection_id().alias("detection_id"))


VEC = "(SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query(f"SELECT vec_id, i::INT AS i, {O.he('(x - m) / nullif(s, 0)', 4)} AS z FROM {VEC} JOIN (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM {VEC} GROUP BY i) USING (i)")
def scaled_features(spark, d):
    long = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).withColumn("i", F.col("i") + 1)
    s = long.groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.join(F.broadcast(s), "i").select("vec_id", "i", X.half_even((F.col("x") - F.col("m")) / F.nullif("s", F.lit(0.0)), 4).alias("z"))


@query(None)
def lof_scores(spark, d):
    return outliers.local_outlier_factor(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")


@query(None)
def isolation_scores(spark, d):
    return outliers.isolation_forest(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")


LEGACY = f"SELECT *, (frp - min(frp) OVER ()) / (max(frp) OVER () - min(frp) OVER ()) AS frp_norm, recurrence_days AS days FROM clean JOIN cells ON {O.he('latitude', 2)} = grid_lat AND {O.he('longitude', 2)} = grid_lon JOIN (SELECT latitude AS la, longitude AS lo, d FROM near) ON latitude = la AND longitude = lo"


@query(f"SELECT ord, (d < 2 AND days >= 2)::INT AS label, {O.he('0.6 * persistence_norm + 0.4 * frp_norm', 6)} AS risk, CASE WHEN 0.6 * persistence_norm + 0.4 * frp_norm >= 0.65 THEN 'Critical' WHEN 0.6 * persistence_norm + 0.4 * frp_norm >= 0.45 THEN 'High' WHEN 0.6 * persistence_norm + 0.4 * frp_norm >= 0.25 THEN 'Moderate' ELSE 'Low' END AS band FROM ({LEGACY})")
def legacy_v2_scores(spark, d):
    from ..operators.legacy import legacy_scores

    return legacy_scores(cut(D.temporal(clean(spark, d))), views.facilities(spark, d))


@query("SELECT count(*) AS rows, count(*) FILTER (frp IS NULL) AS no_frp, " + O.he("min(frp)", 6) + " AS least, " + O.he("max(frp)", 6) + " AS most, count(*) FILTER (frp < 0) AS violations FROM det")
def integrity(spark, d):
    return views.detections(spark, d).agg(F.count("*").alias("rows"), F.count_if(F.col("frp").isNull()).alias("no_frp"), r6(F.min("frp")).alias("least"), r6(F.max("frp")).alias("most"), F.count_if(F.col("frp") < 0).alias("violations"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored, classified and explained feed."""
    return reports.feed(scored(spark, sf_dir), "risk_score").select("ord", "latitude", "longitude", "acq_date", "label", "priority", "risk_score", "evidence_score", "est_temp_k", "facility_name", "contributions")


from . import interface  # noqa: E402, F401 (registers its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
