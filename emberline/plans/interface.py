"""Registered queries of the read interface, its exports and reports, the sources, the models and the streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from ..operators import clusters, detections as D, models, reports, scoring, spatial
from ..operators.graph import cut, folder
from ..sinks import files, snapshots
from ..sources import boundaries, detections as S, inventories, registry as R, tables
from ..streaming import detections as T
from . import oracles as O
from . import views
from .registry import EDGES, POLYGON, clean, cleaned, grid_sites, query, r6, records, rounded, scored, six

LIST = ", ".join(f"'{c}'" for c in scoring.CLASSES)
CLASSES = ("persistent_industrial_source", "industrial_fire", "flare_signature", "agricultural_burning", "insufficient_evidence")
ID = "substr(md5(printf('%.5f', latitude) || ':' || printf('%.5f', longitude) || ':' || acq_date::VARCHAR || ':' || acq_time::VARCHAR), 1, 12)"


def known(spark, d):
    """The scored feed with its ids, as reports read it: its joined stages are written once for a session and state of the events.

    What follows from one row (classes, contributions) is worked out as it is read, so a report pays for the columns that it names.
    """
    cache = FEEDS.get(spark.sparkContext.applicationId)
    if cache is None:
        FEEDS.clear()
        cache = FEEDS[spark.sparkContext.applicationId] = snapshots.SnapshotCache(spark)
    return cache.get(f"{d}/events.parquet", "feed", lambda _: scored(spark, d).withColumn("detection_id", X.detection_id()))


#: Feeds by session.
FEEDS: dict[str, snapshots.SnapshotCache] = {}


# --- facilities, detections and sites by id ----------------------------------------------


FACILITY = "facility_uid, ftype, name, sources_present, source_agreement, status, record_count"


@query(f"SELECT uid AS facility_uid, ftype, name, sources_present, source_agreement, status, record_count FROM site WHERE list_contains(string_split(sources_present, '|'), 'gem') AND lat BETWEEN 20 AND 22 AND lon BETWEEN 75 AND 76.5 ORDER BY uid LIMIT 4000")
def api_facilities(spark, d):
    return reports.facilities(scoring.sites_of(views.facilities(spark, d)), "gem", (75.0, 20.0, 76.5, 22.0)).select(*FACILITY.split(", "))


@query(f"SELECT {ID} AS detection_id, ord, label, CASE WHEN agri_penalty THEN 6 ELSE 5 END AS parts FROM classed WHERE ord = (SELECT min(ord) FROM classed)")
def api_detection(spark, d):
    rows = known(spark, d)
    wanted = rows.agg(F.min_by("detection_id", "ord")).first()[0]
    return reports.detection(rows, wanted or "").select("detection_id", "ord", "label", F.size("contributions").alias("parts"))


UID = "(SELECT min(site.uid) FROM classed)"


def one_site(rows) -> str:
    return rows.agg(F.min("facility_uid")).first()[0] or ""


@query(f"""SELECT facility_uid, count(*) AS detections, count(DISTINCT acq_date) AS days_active, min(acq_date) AS first_seen, max(acq_date) AS last_seen, {O.he('max(frp)', 2)} AS max_frp, {O.he('max(risk_score)', 3)} AS max_risk, {O.he('max(est_temp_k)', 1)} AS max_temp_k,
 {O.he("avg((daynight = 'N')::INT)", 3)} AS night_fraction, (SELECT date_diff('day', min(acq_date), max(acq_date)) + 1 FROM classed)::INT AS window_days FROM classed WHERE facility_uid = {UID} GROUP BY facility_uid""")
def api_site_summary(spark, d):
    rows = known(spark, d)
    return reports.site_summary(rows, one_site(rows))


@query(f"""SELECT acq_date, count(ord) AS detections, count(ord) FILTER (daynight = 'N') AS night, coalesce({O.he('max(frp)', 2)}, 0) AS max_frp, coalesce({O.he('max(risk_score)', 3)}, 0) AS max_risk, {O.he('max(est_temp_k)', 1)} AS max_temp_k
 FROM (SELECT unnest(generate_series(min(acq_date), max(acq_date), INTERVAL 1 DAY))::DATE AS acq_date FROM classed) LEFT JOIN (SELECT * FROM classed WHERE facility_uid = {UID}) USING (acq_date) GROUP BY acq_date""")
def api_site_days(spark, d):
    rows = known(spark, d)
    return reports.site_days(rows, one_site(rows))


@query(f"SELECT label, count(*) AS n FROM classed WHERE facility_uid = {UID} GROUP BY label")
def api_site_labels(spark, d):
    rows = known(spark, d)
    return rows.where(F.col("facility_uid") == one_site(rows)).groupBy("label").agg(F.count("*").alias("n"))


CELL = "floor(latitude * 100 + 0.5) / 100 = (SELECT floor(arg_min(latitude, ord) * 100 + 0.5) / 100 FROM clean) AND floor(longitude * 100 + 0.5) / 100 = (SELECT floor(arg_min(longitude, ord) * 100 + 0.5) / 100 FROM clean)"


@query(f"SELECT acq_date, coalesce(max(frp), 0) AS value, count(ord) AS count FROM (SELECT unnest(generate_series(min(acq_date), max(acq_date), INTERVAL 1 DAY))::DATE AS acq_date FROM clean) LEFT JOIN (SELECT * FROM clean WHERE {CELL}) USING (acq_date) GROUP BY acq_date")
def cell_daily_log(spark, d):
    rows = cleaned(spark, d)
    at = rows.agg(F.min_by("latitude", "ord").alias("a"), F.min_by("longitude", "ord").alias("b")).first()
    return reports.cell_days(rows, at.a if at.a is not None else 0.0, at.b if at.b is not None else 0.0)


CLUSTERED = "FROM classed JOIN members USING (ord)"


@query(f"""SELECT 'C' || row_number() OVER (ORDER BY count DESC, cluster_root) AS cluster_id, * EXCLUDE (t), t.c AS industrial_context, t.n AS nearest_facility_name, t.f AS nearest_facility_type, t.u AS facility_uid, {O.he('t.d', 2)} AS dist_to_industrial_km,
 CASE WHEN sources_confirming = '' THEN 0 ELSE len(string_split(sources_confirming, '|')) END::INT AS sources_confirming_count FROM (
 SELECT cluster_root, count(*)::INT AS count, min(acq_date) AS first_date, max(acq_date) AS last_date, (date_diff('day', min(acq_date), max(acq_date)) + 1)::INT AS persistence_days, {O.he('max(frp)', 2)} AS max_frp, {O.he('sum(frp::DECIMAL(18,9))::DOUBLE / count(frp)', 2)} AS avg_frp,
  {O.he('max(risk_score)', 3)} AS max_priority, {O.he('max(fusion_score)', 3)} AS max_fusion, {O.he('max(est_temp_k)', 1)} AS max_est_temp_k, bool_or(new_source) AS new_source,
  arg_max(struct_pack(c := industrial_context, n := facility_name, f := facility_type, u := facility_uid, d := dist_to_industrial_km), struct_pack(r := risk_score, o := -ord)) AS t {CLUSTERED} GROUP BY cluster_root)
 JOIN (SELECT cluster_root, arg_max(label, struct_pack(n := n, l := -rank)) AS dominant_label FROM (SELECT *, row_number() OVER (PARTITION BY cluster_root ORDER BY label) AS rank FROM (SELECT cluster_root, label, count(*) AS n {CLUSTERED} GROUP BY ALL)) GROUP BY cluster_root) USING (cluster_root)
 JOIN (SELECT cluster_root, arg_max(temp_class, struct_pack(n := n, l := -rank)) AS dominant_temp_class FROM (SELECT *, row_number() OVER (PARTITION BY cluster_root ORDER BY temp_class) AS rank FROM (SELECT cluster_root, temp_class, count(*) AS n {CLUSTERED} GROUP BY ALL)) GROUP BY cluster_root) USING (cluster_root)
 JOIN (SELECT cluster_root, coalesce(string_agg(DISTINCT s, '|' ORDER BY s) FILTER (s <> ''), '') AS sources_confirming FROM (SELECT cluster_root, unnest(string_split(sources_confirming, '|')) AS s {CLUSTERED}) GROUP BY cluster_root) USING (cluster_root)""")
def api_clusters(spark, d):
    rows = known(spark, d)
    return clusters.cluster_report(rows, clusters.cluster(rows.select("ord", "latitude", "longitude", "acq_date")))


# --- map ------------------------------------------------------------------------------------


def code_sql(c: str, stage: str) -> str:
    return f"(SELECT count(*) FROM (SELECT min(ord) AS o FROM {stage} GROUP BY {c}::VARCHAR) q WHERE q.o < f_{c}.o)::INT AS {c}"


FIRSTS = " ".join(f"JOIN (SELECT {c}::VARCHAR AS v, min(ord) AS o FROM classed GROUP BY 1) f_{c} ON f_{c}.v = c.{c}::VARCHAR" for c in reports.MAP_CODES)
PLAIN = ", ".join(f"{O.he(f'c.{c}', n)} AS {c}" for c, n in reports.MAP_ROUNDING.items())


@query(f"SELECT c.ord, {ID} AS detection_id, {PLAIN}, c.recurrence_days, {', '.join(code_sql(c, 'classed') for c in reports.MAP_CODES)} FROM classed c {FIRSTS}".replace("WHERE q.o < f_", "WHERE q.o < f_"))
def map_payload(spark, d):
    return reports.map_payload(known(spark, d))[0]


@query(f"SELECT ord, {ID} AS detection_id, {', '.join(f'{c}::VARCHAR AS {c}' for c in reports.MAP_CODES)} FROM classed")
def map_payload_roundtrip(spark, d):
    return reports.decoded(*reports.map_payload(known(spark, d))).select("ord", "detection_id", *reports.MAP_CODES)


MERCATOR = "floor((longitude + 180.0) / 360.0 * 256 * pow(2.0, z) / 48)::BIGINT AS tx, floor(256 * (0.5 - ln((1 + sin(radians(latitude))) / (1 - sin(radians(latitude)))) / (4 * 3.141592653589793)) * pow(2.0, z) / 48)::BIGINT AS ty"


@query(f"SELECT z, {MERCATOR}, count(*) AS n, {', '.join(f'''count(*) FILTER (label = '{c}') AS k{i}''' for i, c in enumerate(CLASSES))} FROM classed, (SELECT unnest(range(3, 18))::INT AS z) GROUP BY ALL")
def tile_clusters(spark, d):
    return reports.tiles(known(spark, d), classes=CLASSES)


@query("SELECT ord, greatest(3.4, least(11.0, 3.4 + sqrt(frp) * 1.5))::DECIMAL(18,6)::DOUBLE AS radius, least(1.0, frp / 20)::DECIMAL(18,6)::DOUBLE AS heat FROM clean")
def marker_sizes(spark, d):
    return clean(spark, d).select("ord", *[r6(c).alias(n) for n, c in reports.marks().items()])


@query("""SELECT ord, latitude, longitude, risk_score, place FROM (SELECT *, row_number() OVER (PARTITION BY latitude, longitude ORDER BY risk_score DESC, ord) AS place FROM (
 SELECT *, count(*) OVER (PARTITION BY latitude, longitude) AS n, row_number() OVER (PARTITION BY latitude, longitude ORDER BY ord) AS i FROM classed) WHERE n > 1 AND i <= 60) WHERE place <= 12""")
def stacked_detections(spark, d):
    return reports.stacked(known(spark, d)).select("ord", "latitude", "longitude", "risk_score", "place")


@query("""SELECT ord, acq_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' AS in_window FROM classed WHERE label IN ('industrial_fire', 'flare_signature', 'persistent_industrial_source') AND risk_score >= 0.1
 AND (contains('|' || sources_confirming || '|', '|wri|') OR contains('|' || sources_confirming || '|', '|gem|')) AND facility_uid IN (SELECT uid FROM site WHERE source_agreement > 1) AND contains(lower(facility_name), 'a')""")
def client_view(spark, d):
    watch = scoring.sites_of(views.facilities(spark, d)).where("source_agreement > 1").select("facility_uid")
    rows = reports.viewed(known(spark, d), scoring.INDUSTRIAL, 0.1, ("wri", "gem"), "A", watch, "2024-01-08", "2024-01-14")
    return rows.select("ord", "in_window")


# --- exports ---------------------------------------------------------------------------------


EXPORT = "ord, label, risk_score, latitude, longitude, acq_date"


def scratch(spark) -> str:
    """A new folder where checkpoints go, which all executors share."""
    return f"{folder(spark)}/export-{uuid.uuid4().hex}"


@query(f"SELECT {EXPORT} FROM classed WHERE acq_date >= DATE '2024-01-10' AND risk_score >= 0.15")
def export_detections_csv(spark, d):
    """Written as packed CSV and read back."""
    wanted = reports.DetectionQuery.parse({"from": "2024-01-10", "min_score": "0.15"}).apply(known(spark, d)).select(*EXPORT.split(", "))
    to = scratch(spark)
    files.write_csv(wanted, to)
    return spark.read.schema(wanted.schema).csv(to, header=True)


@query("SELECT ord, 'Feature' AS type, 'Point' AS kind, longitude AS lon, latitude AS lat, label, risk_score FROM classed WHERE acq_date >= DATE '2024-01-10' AND risk_score >= 0.15")
def export_detections_geojson(spark, d):
    """Features as text, and what a reader finds in them: the rows of the CSV export."""
    rows = reports.DetectionQuery.parse({"from": "2024-01-10", "min_score": "0.15"}).apply(known(spark, d))
    text = reports.geojson(rows, ["label", "risk_score"])
    shape = "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:struct<label:string,risk_score:double>>"
    f = text.select("ord", F.from_json("feature", shape).alias("f"))
    return f.select("ord", "f.type", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.label", "f.properties.risk_score")


@query("SELECT ord, frp, daynight, longitude AS lon, latitude AS lat FROM clean")
def geojson_features(spark, d):
    shape = "struct<geometry:struct<coordinates:array<double>>,properties:struct<ord:bigint,frp:double,daynight:string>>"
    f = reports.geojson(clean(spark, d), ["ord", "frp", "daynight"]).select(F.from_json("feature", shape).alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query("SELECT uid AS facility_uid, name, ftype, source_agreement FROM site WHERE list_contains(string_split(sources_present, '|'), 'wri')")
def export_facilities_csv(spark, d):
    groups = scoring.sites_of(views.facilities(spark, d))
    wanted = reports.facilities(groups, "wri", limit=1 << 30).select("facility_uid", "name", "ftype", "source_agreement")
    to = scratch(spark)
    files.write_csv(wanted, to)
    return spark.read.schema(wanted.schema).csv(to, header=True).na.fill("", ["name"])


@query(f"""SELECT lpad(lower(printf('%x', sum(('0x' || substr(md5({ID} || ':' || CASE WHEN risk_score = 0 THEN '0.0' WHEN risk_score = 1 THEN '1.0' ELSE rtrim(printf('%.4f', risk_score), '0') END), 1, 8))::BIGINT) % 4294967296)), 8, '0') AS content, count(*) AS total_detections, min(acq_date) AS first_day, max(acq_date) AS last_day, '3.0' AS method_version,
 {O.he('avg((est_temp_k IS NOT NULL)::INT)', 4)} AS retrieval_success_rate FROM classed""".replace("lpad(lower(printf('%x', sum(", "lpad(lower(printf('%x', (sum(").replace("% 4294967296)), 8", "% 4294967296)::BIGINT)), 8"))
def snapshot(spark, d):
    rows = known(spark, d)
    out = snapshots.snapshot(rows.withColumn("_risk", F.when(F.col("risk_score") == 0, "0.0").when(F.col("risk_score") == 1, "1.0").otherwise(F.rtrim(F.format_string("%.4f", "risk_score"), F.lit("0")))))
    digest = rows.withColumn("_risk", F.when(F.col("risk_score") == 0, "0.0").when(F.col("risk_score") == 1, "1.0").otherwise(F.rtrim(F.format_string("%.4f", "risk_score"), F.lit("0")))).agg(snapshots.content_id("detection_id", "_risk").alias("content"))
    return digest.crossJoin(out.drop("snapshot_id"))


OUTPUT = {  # columns of the published table that can be told from one row of the feed, and their SQL
    "detection_id": ID, "latitude": "latitude", "longitude": "longitude", "acq_date": "acq_date", "acq_time": "acq_time", "daynight": "daynight", "satellite": "NULL::VARCHAR", "instrument": "instrument", "source_sensor": "source_sensor",
    "confidence": "confidence", "scan": "scan", "track": "track", "grid_lat": O.he("latitude", 2), "grid_lon": O.he("longitude", 2), "frp": "frp", "bright_ti4": "CASE WHEN instrument <> 'MODIS' THEN bt4 END",
    "bright_ti5": "CASE WHEN instrument <> 'MODIS' THEN bt5 END", "brightness": "CASE WHEN instrument = 'MODIS' THEN bt4 END", "bright_t31": "CASE WHEN instrument = 'MODIS' THEN bt5 END", "est_temp_k": "est_temp_k", "hot_fraction": O.he("hot_fraction", 5),
    "est_area_m2": O.he("est_area_m2", 0), "pixel_area_m2": "pixel_area_m2", "temp_class": "temp_class", "i4_saturated": "i4_saturated", "temp_is_lower_bound": "i4_saturated AND est_temp_k IS NOT NULL", "retrieval_status": "retrieval_status",
    "baseline_frp": O.he("b_frp", 6), "baseline_level": "baseline_level", "frp_robust_z": O.he("frp_robust_z", 5), "thermal_abnormality": O.he("abnormality", 5), "frp_intensity_norm": O.he("frp_intensity_norm", 6), "recurrence_days": "recurrence_days",
    "detections_in_cell": "detections_in_cell", "night_fraction": O.he("night_fraction", 6), "duty_cycle": O.he("duty_cycle", 6), "inter_arrival_regularity": O.he("regularity", 6), "frp_shift": O.he("frp_shift", 6), "persistence_norm": O.he("persistence_norm", 6),
    "nocturnal_score": O.he("night_fraction", 6), "new_source": "new_source", "ceased": "ceased_source", "reactivated": "reactivated_source", "active_span_days": "active_span", "observation_window_days": "(SELECT w FROM win)::INT",
    "dist_to_industrial_km": "dist_to_industrial_km", **{f"dist_{s}_km": O.he(f"d_{s}", 3) for s in C.SOURCES}, **{f"count_{s}_3km": f"n_{s}" for s in C.SOURCES}, "sources_loaded": "'osm|wri|gem'", "sources_confirming": "sources_confirming",
    "sources_confirming_count": "confirming_count", "corroboration_score": "corroboration_score", "facility_uid": "facility_uid", "nearest_facility_name": "facility_name", "nearest_facility_type": "facility_type", "nearest_facility_lat": O.he("site.lat", 6),
    "nearest_facility_lon": O.he("site.lon", 6), "facility_sources": "site.sources_present", "facility_source_agreement": "site.source_agreement", "facility_status": "site.status", "facility_capacity_value": O.he("site.capacity_value", 2),
    "facility_capacity_unit": "site.capacity_unit", "facility_subnational": "site.subnational", "industrial_context": "industrial_context", "agri_season_context": "agri_season_region IS NOT NULL", "agri_season_region": "agri_season_region",
    "agri_penalty_applied": "agri_penalty", "corroboration_component": "corroboration_score", "physics_score": "physics_score", "persistence_component": O.he("persistence_norm", 6), "nocturnal_component": O.he("night_fraction", 6),
    "intensity_component": O.he("frp_intensity_norm", 6), "evidence_score": "evidence_score", "industrial_evidence_score": "evidence_score", "ml_industrial_prob": "NULL::DOUBLE", "unsupervised_anomaly": "NULL::DOUBLE", "anomaly_probability": "fusion_score",
    "fusion_score": "fusion_score", "risk_score": "risk_score", "risk_level": "priority", "final_label": "label", "final_label_display": "upper(label[1]) || replace(label[2:], '_', ' ')", "evidence_level": "evidence_level", "method_version": "'3.0'",
}
ROUNDED = {"hot_fraction": 5, "est_area_m2": 0, "baseline_frp": 6, "frp_robust_z": 5, "thermal_abnormality": 5, "nearest_facility_lat": 6, "nearest_facility_lon": 6, "facility_capacity_value": 2}
ROUNDED |= dict.fromkeys(("frp_intensity_norm", "night_fraction", "duty_cycle", "inter_arrival_regularity", "frp_shift", "persistence_norm", "nocturnal_score", "persistence_component", "nocturnal_component", "intensity_component"), 6)


@query("SELECT " + ", ".join(f"{sql} AS {c}" for c, sql in OUTPUT.items()) + " FROM classed")
def scored_output(spark, d):
    """The published table without its two texts that other queries show (contributions, cluster_id)."""
    out = scoring.published(known(spark, d), snapshots.METHOD_VERSION)
    return out.drop("contributions", "cluster_id").withColumns({c: X.half_even(c, n) for c, n in ROUNDED.items()})


# --- profiles and reports ---------------------------------------------------------------------


TABLE = {
    "ord": "n", "user_id": "n", "latitude": "n", "longitude": "n", "acq_date": "d", "acq_time": "n", "daynight": "s", "instrument": "s", "source_sensor": "s", "confidence": "s", "frp": "n", "bt4": "n", "bt5": "n", "scan": "n", "track": "n",
}
LONG = " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS x FROM clean" for c, k in TABLE.items() if k == "n")
WORDS = " UNION ALL ".join(f"SELECT '{c}' AS name, {str(k == 'n').lower()} AS num, " + (f"CASE WHEN trim({c}) <> '' THEN {c} END" if k == "s" else f"{c}::VARCHAR") + " AS x FROM clean" for c, k in TABLE.items())


@query(f"""SELECT name, {six('fill', 'low', 'mid', 'high')}, bin, count(*) AS n FROM (SELECT *, CASE WHEN p99 > p1 THEN least(greatest(floor((x - p1) / ((p99 - p1) / 18)), 0), 17)::INT ELSE 9 END AS bin FROM ({LONG}) JOIN (
 SELECT name, avg((x IS NOT NULL)::INT) AS fill, min(x) AS low, median(x) AS mid, max(x) AS high, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99 FROM ({LONG}) GROUP BY name HAVING count(DISTINCT x) > 6) USING (name) WHERE x IS NOT NULL) GROUP BY name, fill, low, mid, high, bin""")
def column_profile(spark, d):
    return reports.column_profile(cleaned(spark, d)).select("name", *rounded("fill", "low", "mid", "high"), "bin", "n")


@query(f"""SELECT name, {six('fill')}, n_distinct, place, value, n FROM (SELECT name, avg((x IS NOT NULL)::INT) AS fill, count(DISTINCT x) AS n_distinct FROM ({WORDS}) GROUP BY name HAVING NOT bool_or(num) OR count(DISTINCT x) <= 6)
 LEFT JOIN (SELECT name, substr(x, 1, 40) AS value, n, row_number() OVER (PARTITION BY name ORDER BY n DESC, x)::INT AS place FROM (SELECT name, x, count(*) AS n FROM ({WORDS}) WHERE x IS NOT NULL GROUP BY ALL) QUALIFY place <= 5) USING (name)""")
def column_values(spark, d):
    return reports.column_values(cleaned(spark, d)).select("name", *rounded("fill"), F.col("distinct").alias("n_distinct"), "place", "value", "n")


STATISTICS = ("mean", "std", "low", "q1", "mid", "q3", "high", "whisker_low", "whisker_high", "reach")
BY_CLASS = " UNION ALL ".join(f"SELECT '{c}' AS name, k.class, {c}::DOUBLE AS x FROM classed, LATERAL (SELECT unnest(['all', label]) AS class) k" for c in ("frp", "est_temp_k", "risk_score"))


@query(f"""SELECT name, class, n, nulls, outliers, {six(*STATISTICS)} FROM (SELECT name, class, count(x) AS n, count(*) FILTER (x IS NULL) AS nulls, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS low, quantile_cont(x, 0.25) AS q1, median(x) AS mid, quantile_cont(x, 0.75) AS q3, max(x) AS high,
 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS reach FROM ({BY_CLASS}) GROUP BY ALL) LEFT JOIN (SELECT name, class, min(x) FILTER (x >= a) AS whisker_low, max(x) FILTER (x <= b) AS whisker_high, count(*) FILTER (x < a OR x > b) AS outliers FROM ({BY_CLASS})
 JOIN (SELECT name, class, quantile_cont(x, 0.25) - 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS a, quantile_cont(x, 0.75) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) AS b FROM ({BY_CLASS}) GROUP BY ALL HAVING count(x) > 0) USING (name, class) GROUP BY ALL) USING (name, class)""")
def describe_scores(spark, d):
    out = reports.described(known(spark, d), ["frp", "est_temp_k", "risk_score"], "label")
    return out.select("name", "class", "n", "nulls", "outliers", *rounded(*STATISTICS))


REGIMES = ("flare_like", "furnace_like", "mixed", "biomass_like", "smouldering", "unknown")


@query(f"SELECT place::INT AS place, value, count(ord) AS n, {O.he('count(ord) / (SELECT count(*) FROM phys)', 6)} AS share FROM (VALUES {', '.join(f'''({i}, '{v}')''' for i, v in enumerate(REGIMES))}) v(place, value) LEFT JOIN phys ON temp_class = value GROUP BY ALL")
def temp_class_shares(spark, d):
    return reports.counts_in_order(cut(D.subpixel(D.background(cleaned(spark, d)))), "temp_class", list(REGIMES))


@query("SELECT least(floor(log10(frp / 0.1) / log10((SELECT max(frp) FROM clean) / 0.1) * 40), 39)::INT AS bin, count(*) AS n FROM clean WHERE frp >= 0.1 GROUP BY 1")
def power_histogram(spark, d):
    return reports.log_histogram(cleaned(spark, d), "frp")


@query("SELECT recurrence_days, count(*) AS cells FROM cells GROUP BY recurrence_days")
def recurrence_histogram(spark, d):
    return D.temporal_cells(cleaned(spark, d)).groupBy("recurrence_days").agg(F.count("*").alias("cells"))


_blur = "(SELECT k, exp(-0.5 * pow(k / 8.0, 2)) / sum(exp(-0.5 * pow(k / 8.0, 2))) OVER () AS w FROM (SELECT unnest(range(-32, 33)) AS k))"
_mirror = lambda x: f"CASE WHEN (({x}) % 800 + 800) % 800 >= 400 THEN 799 - (({x}) % 800 + 800) % 800 ELSE (({x}) % 800 + 800) % 800 END"
_grid = "(SELECT least(399, floor((longitude - 67.5) / 31 * 400))::BIGINT AS gx, least(399, floor((latitude - 6.5) / 31 * 400))::BIGINT AS gy, count(*) AS n FROM clean WHERE longitude BETWEEN 67.5 AND 98.5 AND latitude BETWEEN 6.5 AND 37.5 GROUP BY ALL)"


@query(f"SELECT gx::BIGINT AS gx, gy::BIGINT AS gy, {O.he('sum(v * w)', 6)} AS v FROM (SELECT gx, {_mirror('gy + k')} AS gy, v, w FROM (SELECT {_mirror('gx + k')} AS gx, gy, sum(n * w) AS v FROM {_grid}, {_blur} GROUP BY ALL), {_blur}) GROUP BY ALL HAVING sum(v * w) > 0.001")
def density_blur(spark, d):
    return reports.blurred(reports.density(cleaned(spark, d))).where("v > 0.001").select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), r6("v").alias("v"))


@query(f"""SELECT gx::INT AS gx, gy::INT AS gy, {O.he('sum(exp(-(dx * dx + dy * dy) / (2 * 0.0144)))', 6)} AS v FROM (SELECT gx, gy, 68 + (gx + 0.5) * 0.1 - longitude AS dx, 6 + (gy + 0.5) * 0.1 - latitude AS dy FROM clean, (SELECT unnest(range(300)) AS gx), (SELECT unnest(range(300)) AS gy)
 WHERE abs(68 + (gx + 0.5) * 0.1 - longitude) <= 0.48 AND abs(6 + (gy + 0.5) * 0.1 - latitude) <= 0.48) WHERE dx * dx + dy * dy <= 0.2304 GROUP BY ALL""")
def kernel_density(spark, d):
    out = reports.kernel_density(cleaned(spark, d), 0.12, 68.0, 6.0, 0.1, 300)
    return out.select("gx", "gy", r6("v").alias("v"))


@query(f"SELECT count(*) AS total, count(*) FILTER (label IN ('industrial_fire', 'flare_signature')) AS actionable, {O.he('''1 - count(*) FILTER (label IN ('industrial_fire', 'flare_signature')) / count(*)''', 6)} AS reduction FROM classed")
def triage_reduction(spark, d):
    return reports.triage(known(spark, d), ("industrial_fire", "flare_signature"))


@query(f"SELECT {', '.join(f'''count(*) FILTER (label = '{c}') AS {c}''' for c in CLASSES)}, count(*) FILTER (confirming_count >= 2) AS multi_source, count(*) FILTER (est_temp_k IS NOT NULL) AS temperature FROM classed WHERE acq_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'")
def period_metrics(spark, d):
    return reports.metrics(known(spark, d), CLASSES, "2024-01-08", "2024-01-14")


SUBSETS = (("osm",), ("wri",), ("gem",), ("eog",), ("osm", "wri"), ("osm", "gem"), ("wri", "gem"), ("osm", "wri", "gem"), C.SOURCES)


def _ablated() -> str:
    out = []
    for s in SUBSETS:
        real = [x for x in s if x != "eog"]
        votes = " + ".join(["0.0::DOUBLE", *(f"CASE WHEN d_{x} <= 1.0 THEN 1.0::DOUBLE WHEN d_{x} <= 3.0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END" for x in real)])
        k = " + ".join(["0", *(f"coalesce((d_{x} <= 3.0)::INT, 0)" for x in real)])
        names = ", ".join(f"'{x}'" for x in s)
        out.append(f"""SELECT '{'+'.join(s)}' AS subset, e.*, {k} AS kk, {O.he(f'least(1.0, ({votes}) / {max(1, len(real))})', 4)} AS cc, {O.he('t.ds', 3)} AS dd FROM evid e LEFT JOIN (
          SELECT latitude, longitude, min({O.km('latitude', 'longitude', 'lat', 'lon')}) AS ds FROM places, (SELECT site.lat, site.lon FROM site WHERE uid IN (SELECT uid FROM rec JOIN recsite USING (o) WHERE source IN ({names}))) GROUP BY ALL) t ON t.latitude = e.latitude AND t.longitude = e.longitude""")
    return " UNION ALL ".join(out)


ABLATED = f"""SELECT subset, count(*) FILTER (kk >= 1) AS corroborated, count(*) FILTER (kk >= 2) AS multi_confirmed, count(*) FILTER (l IN ('industrial_fire', 'persistent_industrial_source', 'flare_signature')) AS industrial_total, count(*) FILTER (l = 'persistent_industrial_source') AS persistent,
 count(*) FILTER (l = 'insufficient_evidence') AS insufficient, {O.he('median(dd)', 3)} AS median_distance_km FROM (
 SELECT *, CASE WHEN kk = 0 AND coalesce(dd, 'inf'::DOUBLE) > 10 AND agri_season_region IS NOT NULL THEN 'agricultural_burning' WHEN kk = 0 AND coalesce(dd, 'inf'::DOUBLE) > 10 THEN 'insufficient_evidence' WHEN pen THEN 'agricultural_burning'
  WHEN temp_class = 'flare_like' AND recurrence_days >= 2 AND kk > 0 THEN 'flare_signature' WHEN fus >= 0.62 AND recurrence_days >= 3 THEN 'persistent_industrial_source' WHEN fus >= 0.42 THEN 'industrial_fire' ELSE 'insufficient_evidence' END AS l FROM (
 SELECT *, {O.he(O.clip(f"(0.55 * {O.he(O.clip('CASE WHEN pen THEN raw2 * 0.55 ELSE raw2 END'), 4)}) / 0.55"), 4)} AS fus FROM (
 SELECT *, coalesce(agri_season_region IS NOT NULL AND temp_class IN ('biomass_like', 'smouldering', 'unknown') AND cc < 0.3, false) AS pen, 0.3 * cc + 0.25 * physics_score + 0.2 * persistence_norm + 0.1 * nocturnal_score + 0.15 * frp_intensity_norm AS raw2 FROM ({_ablated()})))) GROUP BY subset"""


@query(ABLATED)
def ablation(spark, d):
    """Every subset of the registries, joined, scored and classified again; the stages that hang on no registry are shared."""
    rows = cut(scoring.thermal(cut(clean(spark, d))))
    return scoring.ablation(rows, views.facilities(spark, d), SUBSETS)


@query("SELECT a || '+' || b AS pair, (SELECT count(*) FROM (SELECT uid FROM rec JOIN recsite USING (o) WHERE source = a INTERSECT SELECT uid FROM rec JOIN recsite USING (o) WHERE source = b)) AS sites FROM (VALUES ('osm', 'wri'), ('osm', 'gem'), ('osm', 'eog'), ('wri', 'gem'), ('wri', 'eog'), ('gem', 'eog')) v(a, b)")
def registry_pairs(spark, d):
    return clusters.shared_pairs(clusters.assign_sites(records(spark, d)))


@query("SELECT (SELECT count(*) FROM rec) AS total_records, count(*) AS total_sites, count(*) FILTER (source_agreement > 1) AS multi_source_sites FROM site")
def registry_totals(spark, d):
    return clusters.totals(clusters.assign_sites(records(spark, d)))


@query("SELECT count(*) AS shared, 0::BIGINT AS only_records, 0::BIGINT AS only_sites FROM site")
def site_sets(spark, d):
    """Ids of records and of sites as sets: what both hold, and what one has alone."""
    rows = cut(clusters.assign_sites(records(spark, d)))
    a, b = rows.select("facility_uid").distinct(), clusters.site_groups(rows).select("facility_uid")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(a.intersect(b), "shared").crossJoin(n(a.exceptAll(b), "only_records")).crossJoin(n(b.exceptAll(a), "only_sites"))


@query(f"SELECT ord, {O.he('frp / avg(frp) OVER w', 5)} AS ratio, {O.he(O.clip('(frp / avg(frp) OVER w - 1) / 2'), 5)} AS abnormality FROM (SELECT *, {O.he('latitude', 2)} AS a, {O.he('longitude', 2)} AS b FROM clean) WINDOW w AS (PARTITION BY a, b)")
def cell_mean_ratio(spark, d):
    from ..operators.legacy import mean_ratio

    out = mean_ratio(cleaned(spark, d))
    return out.select("ord", X.half_even("ratio", 5).alias("ratio"), X.half_even("abnormality", 5).alias("abnormality"))


LEGACY_FUSION = f"""SELECT *, least(1.0, f + p + 0.35 * s) AS fusion FROM (SELECT c.ord, CASE WHEN d < 2 THEN 0.35 WHEN d < 5 THEN 0.15 ELSE 0 END AS f, CASE WHEN recurrence_days >= 3 THEN 0.3 WHEN recurrence_days = 2 THEN 0.2 ELSE 0 END AS p, (c.ord % 101) / 100.0::DOUBLE AS s, d, recurrence_days,
 frp, (frp - min(frp) OVER ()) / (max(frp) OVER () - min(frp) OVER ()) AS frp_norm, frp / avg(frp) OVER (PARTITION BY grid_lat, grid_lon) AS ratio FROM clean c JOIN cells ON {O.he('latitude', 2)} = grid_lat AND {O.he('longitude', 2)} = grid_lon JOIN (SELECT latitude AS la, longitude AS lo, d FROM near) ON latitude = la AND longitude = lo)"""


@query(f"""SELECT ord, {O.he('fusion', 6)} AS fusion_score, CASE WHEN fusion >= 0.6 THEN 'industrial' WHEN fusion >= 0.3 THEN 'possible_industrial' ELSE 'unknown_other' END AS first_label, CASE WHEN f = 0 THEN 'unknown_other' WHEN fusion >= 0.6 THEN 'industrial' WHEN fusion >= 0.3 THEN 'possible_industrial' ELSE 'unknown_other' END AS corrected_label,
 CASE WHEN f = 0 THEN 'insufficient_evidence' WHEN recurrence_days >= 3 THEN 'persistent_industrial_source' ELSE 'industrial_fire' END AS final_label, {O.he('least(1.0, (f + 0.35 * s) / 0.7)', 6)} AS evidence,
 CASE WHEN f = 0 THEN NULL WHEN least(1.0, (f + 0.35 * s) / 0.7) >= 0.7 THEN 'High' WHEN least(1.0, (f + 0.35 * s) / 0.7) >= 0.4 THEN 'Moderate' ELSE 'Low' END AS evidence_level,
 {O.he(O.clip('0.4 * fusion + 0.35 * frp_norm + 0.25 * recurrence_days / 5.0'), 6)} AS risk_v1, {O.he(O.clip(f"0.6 * {O.clip('(ratio - 1) / 2')} + 0.4 * {O.clip('recurrence_days / 5.0')}"), 6)} AS risk_v2, CASE WHEN fusion >= 0.9 THEN 'critical' WHEN fusion >= 0.7 THEN 'high' WHEN fusion >= 0.4 THEN 'medium' ELSE 'low' END AS tier FROM ({LEGACY_FUSION})""")
def legacy_fusion(spark, d):
    from ..operators.legacy import fusion

    rows = D.temporal(cleaned(spark, d)).withColumn("thermal_score", (F.col("ord") % 101) / 100.0)
    out = fusion(cut(rows), views.facilities(spark, d))
    return out.select("ord", X.half_even("fusion_score", 6).alias("fusion_score"), "first_label", "corrected_label", "final_label", X.half_even("evidence", 6).alias("evidence"), "evidence_level", r6("risk_v1").alias("risk_v1"), r6("risk_v2").alias("risk_v2"), "tier")


BANDS = ((0.0, 1.0), (2.0, 3.0), (4.0, 5.0))


@query(f"""SELECT label, count(*) AS n, count(*) FILTER (isinf(dist_to_industrial_km)) AS no_site, count(*) FILTER (facility_name = 'Unnamed industrial feature') AS unnamed, {O.he('min(dist_to_industrial_km)', 3)} AS least_km, {O.he('max(dist_to_industrial_km)', 3)} AS most_km,
 min(risk_score) AS least_risk, max(risk_score) AS most_risk, count(*) FILTER (corroboration_score > 0 AND dist_to_industrial_km > 1000) AS far_votes, count(*) FILTER (NOT (evidence_score BETWEEN 0 AND 1 AND risk_score BETWEEN 0 AND 1 AND fusion_score BETWEEN 0 AND 1)) AS out_of_range FROM classed GROUP BY label""")
def score_integrity(spark, d):
    """Of each class what is missing, its ranges, and rows that must not be."""
    bad = ~(F.col("evidence_score").between(0, 1) & F.col("risk_score").between(0, 1) & F.col("fusion_score").between(0, 1))
    return known(spark, d).groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("dist_to_industrial_km") == float("inf")).alias("no_site"), F.count_if(F.col("facility_name") == scoring.UNNAMED).alias("unnamed"), F.min("dist_to_industrial_km").alias("least_km"),
        F.max("dist_to_industrial_km").alias("most_km"), F.min("risk_score").alias("least_risk"), F.max("risk_score").alias("most_risk"), F.count_if((F.col("corroboration_score") > 0) & (F.col("dist_to_industrial_km") > 1000)).alias("far_votes"), F.count_if(bad).alias("out_of_range"),
    )


@query(" UNION ALL ".join(f"SELECT '{a:g}-{b:g} km' AS band, count(*) AS n, arg_min(ord, struct_pack(d := dist_to_industrial_km, o := ord)) AS sample, min(dist_to_industrial_km) AS km FROM classed WHERE evidence_score < 0.6 AND dist_to_industrial_km >= {a} AND dist_to_industrial_km < {b} HAVING count(*) > 0" for a, b in BANDS))
def banded_samples(spark, d):
    """Of each band of distance the nearest row whose evidence is under 0.6."""
    km = F.col("dist_to_industrial_km")
    band = F.coalesce(*[F.when((km >= a) & (km < b), f"{a:g}-{b:g} km") for a, b in BANDS])
    rows = known(spark, d).where(F.col("evidence_score") < 0.6).withColumn("band", band).where("band IS NOT NULL")
    return rows.groupBy("band").agg(F.count("*").alias("n"), F.min_by("ord", F.struct("dist_to_industrial_km", "ord")).alias("sample"), F.min("dist_to_industrial_km").alias("km"))


@query("SELECT 'detections' AS what, count(*) AS n FROM classed UNION ALL SELECT 'facilities', count(*) FROM site UNION ALL SELECT 'columns', 92")
def api_docs(spark, d):
    rows = [known(spark, d).agg(F.lit("detections").alias("what"), F.count("*").alias("n")), scoring.sites_of(views.facilities(spark, d)).agg(F.lit("facilities").alias("what"), F.count("*").alias("n"))]
    return rows[0].unionByName(rows[1]).unionByName(spark.createDataFrame([("columns", len(scoring.OUTPUT))], "what string, n long"))


@query(None)
def data_dictionary(spark, d):
    """Sections and columns of the published table, with their types and what they mean."""
    return spark.createDataFrame([(i, section, c, t, text) for i, (c, t, section, text) in enumerate(scoring.OUTPUT)], "place int, section string, name string, type string, meaning string")


# --- sources ----------------------------------------------------------------------------------


@query("SELECT x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM (VALUES " + ", ".join(str(e) for e in EDGES) + ") e(x1, y1, x2, y2)")
def boundary_edges(spark, d):
    import json

    text = json.dumps({"type": "MultiPolygon", "coordinates": [[[list(p) for p in [*ring, ring[0]]] for ring in polygon] for polygon in POLYGON]})
    return boundaries.edges_of(spark.createDataFrame([(text,)], "geometry string"))


CLIPPED = f"""SELECT d.ord FROM (SELECT * FROM det WHERE {O.KEPT}) d, (VALUES {', '.join(str(e) for e in EDGES)}) e(x1, y1, x2, y2) GROUP BY d.ord, d.latitude, d.longitude
HAVING sum(((y1 > latitude) <> (y2 > latitude) AND longitude < (x2 - x1) * (latitude - y1) / nullif(y2 - y1, 0) + x1)::INT) % 2 = 1
 AND NOT bool_or((x2 - x1) * (latitude - y1) - (y2 - y1) * (longitude - x1) = 0 AND longitude BETWEEN least(x1, x2) AND greatest(x1, x2) AND latitude BETWEEN least(y1, y2) AND greatest(y1, y2))"""


@query(f"SELECT ord FROM det WHERE ord IN ({CLIPPED}) QUALIFY row_number() OVER (PARTITION BY {O.he('latitude', 2)}, {O.he('longitude', 2)}, acq_date ORDER BY {O.CRANK} DESC, frp DESC NULLS LAST, {O.SRANK} DESC, ord) = 1")
def clipped_feed(spark, d):
    """Confident, inside the boundary, then the best of a cell and day: the order of the cleaning."""
    edges = spark.createDataFrame(EDGES, "x1 double, y1 double, x2 double, y2 double")
    return scored(spark, d, boundary=edges).select("ord")


ELEMENT_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'node' ELSE 'way' END AS type, CASE WHEN c_custkey % 2 = 0 THEN 10 + c_custkey % 40 END AS lat, CASE WHEN c_custkey % 2 = 0 THEN 70 + c_custkey % 31 END AS lon,
 CASE WHEN c_custkey % 2 = 1 AND c_custkey % 7 > 0 THEN 12 + c_custkey % 30 END AS clat, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 7 > 0 THEN 72 + c_custkey % 20 END AS clon,
 CASE c_custkey % 9 WHEN 0 THEN 'Flare stack' WHEN 1 THEN 'Tata Ispat' WHEN 2 THEN 'Cement' WHEN 3 THEN 'Aluminium Smelter' ELSE c_name END AS name, CASE c_custkey % 4 WHEN 0 THEN 'works' WHEN 1 THEN 'flare' END AS man_made, CASE c_custkey % 5 WHEN 0 THEN 'plant' END AS power,
 CASE c_custkey % 6 WHEN 0 THEN 'refinery' WHEN 1 THEN 'factory' END AS industrial, CASE c_custkey % 3 WHEN 0 THEN 'industrial' END AS landuse, c_mktsegment AS state FROM customer"""


@query(f"""SELECT 'osm' AS source, type || '/' || id AS source_id, name, CASE WHEN coalesce(man_made, '') = 'flare' OR contains(w, 'flare') THEN 'flare' WHEN contains(w, 'refinery') THEN 'refinery' WHEN contains(w, 'steel') OR contains(w, 'ispat') OR contains(w, 'foundry') THEN 'steel'
 WHEN contains(w, 'cement') OR contains(w, 'clinker') THEN 'cement' WHEN contains(w, 'smelter') OR contains(w, 'aluminium') OR contains(w, 'aluminum') THEN 'smelter' WHEN power = 'plant' THEN 'power_plant' WHEN man_made = 'works' THEN 'works' WHEN landuse = 'industrial' THEN 'industrial_area' ELSE 'other' END AS ftype,
 coalesce(lat, clat)::DOUBLE AS lat, coalesce(lon, clon)::DOUBLE AS lon, state AS subnational, 'unknown' AS status FROM (SELECT *, lower(coalesce(industrial, '') || ' ' || name) AS w FROM ({ELEMENT_SQL})) WHERE coalesce(lat, clat) BETWEEN 6 AND 38 AND coalesce(lon, clon) BETWEEN 66 AND 98""")
def source_elements(spark, d):
    """Map elements as a server sends them: documents of elements, exploded and classed."""
    e = views.view(spark, d, ELEMENT_SQL, "customer")
    tags = F.map_filter(F.create_map(*[x for k in ("name", "man_made", "power", "industrial", "landuse") for x in (F.lit(k), F.col(k))], F.lit("addr:state"), F.col("state")), lambda _, v: v.isNotNull())
    center = F.when(F.col("clat").isNotNull(), F.struct(F.col("clat").cast("double").alias("lat"), F.col("clon").cast("double").alias("lon")))
    one = e.select(F.to_json(F.struct(F.array(F.struct("type", "id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), center.alias("center"), tags.alias("tags"))).alias("elements"))).alias("document"))
    elements = one.select(F.explode(F.from_json("document", f"elements array<{inventories.ELEMENT}>")["elements"]).alias("e")).select("e.*")
    return inventories.element_records(elements).select("source", "source_id", "name", "ftype", "lat", "lon", "subnational", "status")


TRACKED = """SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'China' ELSE ' India ' END AS country, CASE WHEN s_suppkey % 3 = 0 THEN 'gem_steel_plant_tracker.xlsx' ELSE 'gem_coal_plant_tracker.xlsx' END AS file,
 CAST(10 + s_suppkey % 25 AS STRING) AS lat, CAST(70 + s_suppkey % 33 AS STRING) AS lon, CASE s_suppkey % 4 WHEN 0 THEN 'Operating' WHEN 1 THEN 'shelved' WHEN 2 THEN 'mothballed' ELSE 'what' END AS st, CAST(s_nationkey AS STRING) AS cap, s_name AS name FROM supplier"""


@query(f"""SELECT source_id, name, ftype, lat::DOUBLE AS lat, lon::DOUBLE AS lon, cap::DOUBLE AS capacity_value, CASE WHEN ftype = 'power_plant' AND cap <> '0' THEN 'MW' ELSE 'ttpa' END AS capacity_unit, CASE lower(st) WHEN 'operating' THEN 'operating' WHEN 'shelved' THEN 'announced' WHEN 'mothballed' THEN 'retired' ELSE 'unknown' END AS status, subnational
 FROM (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 'steel' ELSE 'power_plant' END AS ftype, CASE WHEN s_suppkey % 7 = 0 THEN file || ':' || name || ':' ELSE 'G' || s_suppkey END AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Odisha' ELSE '' END AS subnational FROM ({TRACKED})) WHERE trim(country) = 'India' AND lat::DOUBLE BETWEEN 6 AND 38 AND lon::DOUBLE BETWEEN 66 AND 98 AND NOT (s_suppkey % 3 = 0 AND s_suppkey % 11 = 0)""")
def source_trackers(spark, d):
    """Unit trackers with the names of two releases; the steel one has both coordinates in one cell, and some that are none."""
    t = views.view(spark, d, TRACKED, "supplier")
    steel, key = F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")
    cells = {
        "Country/Area": F.when(~steel, F.col("country")), "Country": F.when(steel, F.col("country")), "Latitude": F.when(~steel, F.col("lat")), "Longitude": F.when(~steel, F.col("lon")),
        "Coordinates": F.when(steel & (key % 11 == 0), F.lit("unknown")).when(steel, F.concat("lat", F.lit(", "), "lon")), "Status": F.when(~steel, F.col("st")), "Capacity operating status": F.when(steel, F.col("st")), "Plant name": F.when(~steel, F.col("name")),
        "Plant name (English)": F.when(steel, F.col("name")), "Capacity (MW)": F.when(~steel, F.col("cap")), "Nominal crude steel capacity (ttpa)": F.when(steel, F.col("cap")), "GEM unit ID": F.when(~steel & (key % 7 > 0), F.concat(F.lit("G"), key.cast("string"))),
        "Plant ID": F.when(steel & (key % 7 > 0), F.concat(F.lit("G"), key.cast("string"))), "State/Province": F.when(key % 2 == 0, F.lit("Odisha")),
    }
    rows = tables.as_cells(t.select(F.concat(F.lit("x:/raw/"), "file").alias("path"), *[c.alias(n) for n, c in cells.items()]), "path")
    return inventories.tracker_records(rows).select("source_id", "name", "ftype", "lat", "lon", "capacity_value", "capacity_unit", "status", "subnational")


FLARES = "SELECT p_partkey, CAST(8 + p_partkey % 35 AS STRING) AS lat, CAST(66 + p_partkey % 40 AS STRING) AS lon, CASE p_partkey % 4 WHEN 0 THEN 'IND' WHEN 1 THEN ' india' WHEN 2 THEN 'USA' END AS country, p_type AS kind, CAST(p_size AS STRING) AS bcm FROM part"


@query(f"SELECT CASE WHEN p_partkey % 3 = 0 THEN 'f' || p_partkey ELSE 'eog-' || p_partkey END AS source_id, kind AS name, 'flare' AS ftype, lat::DOUBLE AS lat, lon::DOUBLE AS lon, bcm::DOUBLE AS capacity_value, 'bcm_yr' AS capacity_unit, 'operating' AS status FROM ({FLARES}) WHERE coalesce(upper(trim(country)), 'IN') IN ('IND', 'INDIA', 'IN') AND lat::DOUBLE <= 38 AND lon::DOUBLE <= 98")
def source_flares(spark, d):
    f = views.view(spark, d, FLARES, "part")
    even = F.col("p_partkey") % 2 == 0
    cells = {
        "latitude": F.when(even, F.col("lat")), "flare_lat": F.when(~even, F.col("lat")), "Longitude": F.col("lon"), "id_key": F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("f"), F.col("p_partkey").cast("string"))), "iso": F.col("country"),
        "flare_type": F.col("kind"), "bcm_2021": F.when(even, F.col("bcm")), "bcm": F.when(~even, F.col("bcm")),
    }
    rows = tables.as_cells(f.select(F.col("p_partkey").alias("n"), *[c.alias(n) for n, c in cells.items()]), "n")
    return inventories.flare_records(rows).select("source_id", "name", "ftype", "lat", "lon", "capacity_value", "capacity_unit", "status")


@query("SELECT source, ftype, count(*) AS n FROM rec GROUP BY ALL")
def registry_build(spark, d):
    """The union of the sources, each with its own columns, cross-referenced and counted."""
    every = views.facilities(spark, d)
    parts = [every.where(F.col("source") == s).drop(*(["capacity_value"] if s == "osm" else [])) for s in ("osm", "wri", "gem")]
    rows, _ = R.cross_reference(R.union(parts))
    return rows.groupBy("source", "ftype").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, (10 + s_suppkey % 20)::DOUBLE AS lat, CASE WHEN s_suppkey % 4 > 0 THEN 70.5::DOUBLE END AS lon, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, 'none') AS first_name FROM (SELECT * FROM supplier) WHERE s_suppkey % 4 > 0 UNION ALL SELECT s_suppkey, NULL::DOUBLE, NULL::DOUBLE, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, 'none') FROM supplier WHERE s_suppkey % 4 = 0")
def parsed_places(spark, d):
    t = spark.read.parquet(f"{d}/supplier.parquet")
    text = F.when(F.col("s_suppkey") % 4 == 0, F.lit("20.5, x")).otherwise(F.concat((10 + F.col("s_suppkey") % 20).cast("string"), F.lit(", 70.5")))
    lat, lon = tables.split_place(text)
    cells = F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")))
    named = t.withColumn("cells", cells)
    return named.select("s_suppkey", lat.alias("lat"), lon.alias("lon"), F.coalesce(tables.first("a", "b", "c"), F.lit("none")).alias("first_name"))


@query("SELECT ord, CASE WHEN ord % 3 > 0 THEN frp END AS finite, round_even(longitude * 100, 0) / 100 AS rounded, " + O.clip("frp / 20") + f" AS clipped, {O.he(O.km('latitude', 'longitude', '20', '75'), 6)} AS km FROM det")
def sql_functions(spark, d):
    """The functions that SQL users get."""
    X.register(spark)
    rows = views.detections(spark, d).withColumn("odd", F.when(F.col("ord") % 3 == 0, F.when(F.col("ord") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("frp")))
    return rows.select("ord", X.finite("odd").alias("finite"), F.expr("half_even(longitude, 2)").alias("rounded"), F.expr("clip01(frp / 20)").alias("clipped"), r6(F.expr("haversine_km(latitude, longitude, 20D, 75D)")).alias("km"))


# --- models -----------------------------------------------------------------------------------


FEATURED = f"""SELECT ord, frp, frp_robust_z, coalesce(est_temp_k, (SELECT median(est_temp_k) FROM classed)) AS est_temp_k_filled, log10(greatest(coalesce(hot_fraction, 0), 0) + 1e-6) AS hot_fraction_log, recurrence_days::DOUBLE AS recurrence_days, night_fraction, duty_cycle, frp_shift,
 log10(greatest(CASE WHEN isinf(dist_to_industrial_km) THEN 999 ELSE dist_to_industrial_km END, 0.01)) AS dist_log_km, corroboration_score FROM classed"""


@query("SELECT ord, " + ", ".join(f"{O.he(c, 4)} AS {c}" for c in models.UNLABELLED) + f" FROM ({FEATURED})")
def model_features(spark, d):
    return models.prepared(known(spark, d)).select("ord", *[X.half_even(c, 4).alias(c) for c in models.UNLABELLED])


ML, UNS = "CASE WHEN ord % 7 > 0 THEN (ord % 101) / 100.0::DOUBLE END", "CASE WHEN ord % 5 > 0 THEN (ord % 97) / 96.0::DOUBLE END"
FUSED = O.he(O.clip(f"0.55 * evidence_score + 0.3 * coalesce({ML}, evidence_score) + 0.15 * coalesce({UNS}, 0.5)"), 4)


@query(f"SELECT ord, fusion, {O.he(O.clip('0.45 * fusion + 0.25 * abnormality + 0.2 * persistence_norm + 0.1 * frp_intensity_norm + 0.05 * new_source::INT'), 4)} AS risk_score FROM (SELECT *, {FUSED} AS fusion FROM evid)")
def fusion_of_three(spark, d):
    """Evidence blended with two given scores, some of them missing."""
    give = lambda df: df.withColumns({"ml_probability": F.when(F.col("ord") % 7 > 0, (F.col("ord") % 101) / 100.0), "unsupervised_score": F.when(F.col("ord") % 5 > 0, (F.col("ord") % 97) / 96.0)})
    return scored(spark, d, models=give).select("ord", F.col("fusion_score").alias("fusion"), "risk_score")


@query(None)
def modelled_feed(spark, d):
    """The feed with both model scores: calibrated forests over grid-cell folds, and the mean rank of two outlier scores."""
    out = scored(spark, d, models=models.both_scores(trees=40))
    return out.select("ord", "ml_probability", "unsupervised_score", "fusion_score", "risk_score", "label")


@query(None)
def model_report(spark, d):
    """Out-of-fold quality of the classifier; no row if too little is labelled."""
    fitted = models.fit(known(spark, d), trees=40)
    if fitted["oof"] is None:
        return spark.createDataFrame([], "auc double, tp long, fp long, tn long, fn long, average_precision double, precision double, recall double, f1 double, importance string")
    import json

    oof = fitted["oof"]
    return reports.auc(oof, "oof", "weak_label").crossJoin(models.precision_report(oof, "oof", "weak_label")).withColumn("importance", F.lit(json.dumps(fitted["report"]["feature_importance"])))


@query(None)
def unsupervised_ranks(spark, d):
    return models.unsupervised(known(spark, d)).select("ord", "unsupervised_score")


@query(None)
def legacy_model(spark, d):
    rows = cleaned(spark, d).withColumn("label", (F.col("bt4") > 340).cast("int"))
    return models.legacy_forest(rows)


WEAK = "CASE WHEN dist_to_industrial_km <= 1 AND confirming_count >= 2 AND agri_season_region IS NULL THEN 1 WHEN dist_to_industrial_km > 10 AND confirming_count = 0 THEN 0 END"
SCORED = f"SELECT evidence_score AS s, {WEAK} AS y FROM classed WHERE {WEAK} IS NOT NULL"


@query(f"""SELECT {O.he('sum(p / t * cp / cn)', 6)} AS average_precision, {O.he('coalesce(max(tp) / nullif(max(fl), 0), 0)', 6)} AS precision, {O.he('coalesce(max(tp) / nullif(max(t), 0), 0)', 6)} AS recall, {O.he('coalesce(2 * max(tp) / nullif(max(fl) + max(t), 0), 0)', 6)} AS f1
 FROM (SELECT *, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER () AS t, sum(p) FILTER (s >= 0.5) OVER () AS tp, sum(n) FILTER (s >= 0.5) OVER () AS fl FROM (SELECT s, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM ({SCORED}) GROUP BY s))""")
def precision_of_evidence(spark, d):
    return models.precision_report(scoring.weak_labels(known(spark, d)), "evidence_score", "weak_label")


@query(f"SELECT cells, k FROM (SELECT count(DISTINCT ({O.he('latitude', 2)}, {O.he('longitude', 2)})) AS cells FROM classed WHERE {WEAK} IS NOT NULL), (SELECT greatest(2, least(5, count(DISTINCT CASE WHEN y = 1 THEN c END), count(DISTINCT CASE WHEN y = 0 THEN c END)))::INT AS k FROM (SELECT {WEAK} AS y, {O.he('latitude', 2)} || ':' || {O.he('longitude', 2)} AS c FROM classed))")
def model_folds(spark, d):
    """Cells that are dealt, and folds; a cell that lay in two folds would be counted twice."""
    labelled = scoring.weak_labels(known(spark, d)).where("weak_label IS NOT NULL")
    rows, k = models.folds(labelled)
    return rows.select(models.cell_of().alias("c"), "fold").distinct().agg(F.count("*").alias("cells")).withColumn("k", F.lit(k))


# --- streams ------------------------------------------------------------------------------------


def arriving(spark, d):
    """The detection view over a stream of the events table."""
    from pyspark.sql import types

    schema = types._parse_datatype_string("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    spark.readStream.schema(schema).parquet(f"{d}/events.parquet*").createOrReplaceTempView("arriving_events")
    return spark.sql(views.DETECTIONS.replace("FROM events", "FROM arriving_events").replace("event_id AS ord, user_id,", "event_id AS ord, user_id, ts AS at, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_at,"))


@query("SELECT user_id, acq_date, ord, source_sensor FROM det QUALIFY row_number() OVER (PARTITION BY user_id, acq_date ORDER BY (source_sensor LIKE '%_SP') DESC, ord) = 1")
def stream_corrections(spark, d):
    rows = arriving(spark, d).select("at", "user_id", "acq_date", "ord", "source_sensor")
    return T.run(T.corrected(rows, ("user_id", "acq_date")).select("user_id", "acq_date", "ord", "source_sensor"))


@query(f"SELECT acq_date AS day, {O.he('latitude', 2)} AS grid_lat, {O.he('longitude', 2)} AS grid_lon, count(*) AS n, max(frp) AS max_frp FROM det GROUP BY ALL")
def stream_daily_cells(spark, d):
    return T.run(T.daily_cells(arriving(spark, d)))


@query(f"""SELECT grid_lat, grid_lon, min(acq_date) AS first_day, max(acq_date) AS last_day, count(*) AS n FROM (SELECT *, sum((gap > 3 OR gap IS NULL)::INT) OVER (PARTITION BY grid_lat, grid_lon ORDER BY acq_date, ord) AS e FROM (
 SELECT *, date_diff('day', lag(acq_date) OVER (PARTITION BY grid_lat, grid_lon ORDER BY acq_date, ord), acq_date) AS gap FROM (SELECT *, {O.he('latitude', 2)} AS grid_lat, {O.he('longitude', 2)} AS grid_lon FROM det))) GROUP BY grid_lat, grid_lon, e""")
def stream_episodes(spark, d):
    return T.run(T.episodes(arriving(spark, d)))


@query(f"""SELECT grid_lat, grid_lon, first_day, last_day, days, longest_gap, CASE WHEN days > 1 AND longest_gap >= 4 THEN 'reactivated' WHEN date_diff('day', first_day, last_day) < 2 THEN 'new' ELSE 'active' END AS state FROM (
 SELECT grid_lat, grid_lon, min(d) AS first_day, max(d) AS last_day, count(*)::INT AS days, coalesce(max(gap) - 1, 0)::INT AS longest_gap FROM (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY grid_lat, grid_lon ORDER BY d), d) AS gap FROM (SELECT DISTINCT {O.he('latitude', 2)} AS grid_lat, {O.he('longitude', 2)} AS grid_lon, acq_date AS d FROM det)) GROUP BY ALL)""")
def stream_lifecycle(spark, d):
    out = T.run(T.lifecycle(arriving(spark, d)), "update")
    # a cell that came in several batches has a row for each; the last holds all its days
    best = F.max_by(F.struct("first_day", "last_day", "days", "longest_gap", "state"), "days")
    return out.groupBy("grid_lat", "grid_lon").agg(best.alias("b")).select("grid_lat", "grid_lon", "b.*")
