"""DuckDB SQL of the registered queries, built from a chain of named stages."""

from __future__ import annotations

from .. import config as C
from . import views

R = 2 * C.EARTH_KM
C2 = C.PLANCK_H * C.LIGHT_C / C.BOLTZMANN_K
C1 = 2 * C.PLANCK_H * C.LIGHT_C**2


def he(x: str, n: int = 0) -> str:
    return f"(round_even(({x}) * 1e{n}, 0) / 1e{n})"


def km(a: str, b: str, c: str, d: str) -> str:
    return f"({R!r} * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"


def planck(w: str, t: str) -> str:
    return f"({C1!r} / pow(({w}) * 1e-6, 5) / (exp({C2!r} / (({w}) * 1e-6 * ({t}))) - 1) * 1e-6)"


def clip(x: str, a: float = 0.0, b: float = 1.0) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {a!r}::DOUBLE), {b!r}::DOUBLE) END)"


CONF = "lower(trim(confidence))"
KEPT = f"CASE WHEN {CONF} = 'l' THEN false WHEN {CONF} IN ('n','h') THEN true ELSE coalesce(try_cast({CONF} AS DOUBLE) >= 50, true) END"
CRANK = f"CASE WHEN {CONF} = 'h' THEN 3 WHEN {CONF} = 'n' THEN 2 WHEN {CONF} = 'l' THEN 1 WHEN try_cast({CONF} AS DOUBLE) IS NULL THEN 0 WHEN try_cast({CONF} AS DOUBLE) >= 80 THEN 3 WHEN try_cast({CONF} AS DOUBLE) >= 50 THEN 2 ELSE 1 END"
SRANK = "CASE regexp_replace(source_sensor, '_[^_]*$', '') WHEN 'VIIRS_NOAA21' THEN 4 WHEN 'VIIRS_NOAA20' THEN 3 WHEN 'VIIRS_SNPP' THEN 2 WHEN 'MODIS' THEN 1 ELSE 0 END"
TCLASS = "CASE WHEN est_temp_k IS NULL THEN 'unknown' WHEN est_temp_k >= 1400 THEN 'flare_like' WHEN est_temp_k >= 1100 THEN 'furnace_like' WHEN est_temp_k >= 800 THEN 'mixed' WHEN est_temp_k >= 500 THEN 'biomass_like' WHEN est_temp_k >= 0 THEN 'smouldering' ELSE 'unknown' END"


def residual(t: str) -> str:
    over = f"({planck('w4', t)} - g4)"
    p = f"((l4 - g4) / {over})"
    return f"(CASE WHEN {over} > 0 AND {p} > 0 AND {p} <= 1 THEN {p} * ({planck('w5', t)} - g5) - (l5 - g5) END)"


def tail(rule: tuple[float, int]) -> str:
    return f"greatest({rule[1]}, round_even(w * {rule[0]}, 0)::INT)"


def season(day: str, of: str = "") -> str:
    out = "CASE "
    for name, lat, lon, months in C.SEASONS:
        out += f"WHEN {of}latitude BETWEEN {lat[0]} AND {lat[1]} AND {of}longitude BETWEEN {lon[0]} AND {lon[1]} AND month({day}) IN {months} THEN '{name}' "
    return out + "END"


def nearest_cols() -> str:
    return ", ".join(f"min(CASE WHEN source = '{s}' THEN d END) AS d_{s}, count(*) FILTER (source = '{s}' AND d <= 3.0)::INT AS n_{s}" for s in C.SOURCES)


VOTES = " + ".join(f"CASE WHEN d_{s} <= 1.0 THEN 1.0::DOUBLE WHEN d_{s} <= 3.0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END" for s in C.SOURCES)
NAMES = ", ".join(f"CASE WHEN d_{s} <= 3.0 THEN '{s}' END" for s in C.SOURCES)
W, P = C.EVIDENCE_WEIGHTS, C.PRIORITY_WEIGHTS

#: Each stage may use the ones before it.
STAGES: dict[str, str] = {
    "det": views.DETECTIONS,
    "fac": views.FACILITIES,
    "clean": f"SELECT * EXCLUDE (n_) FROM (SELECT *, row_number() OVER (PARTITION BY {he('latitude', 2)}, {he('longitude', 2)}, acq_date ORDER BY {CRANK} DESC, frp DESC NULLS LAST, {SRANK} DESC, ord) AS n_ FROM det WHERE {KEPT}) WHERE n_ = 1",
    "bg": f"""SELECT *, bg5 + CASE WHEN daynight = 'D' THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END AS bg4 FROM (
        SELECT *, quantile_cont(bt5, 0.25) OVER (PARTITION BY {he('latitude')}, {he('longitude')}, daynight) AS bg5 FROM clean)""",
    "start": f"""SELECT *, CASE WHEN bt4 IS NULL OR bt5 IS NULL OR bg4 IS NULL OR bg5 IS NULL THEN 'no_data' WHEN bt4 - bg4 < 3 THEN 'below_background' WHEN bt5 - bg5 < 1 THEN 'weak_11um' WHEN lo0 >= 2500 THEN 'unconstrained' END AS early FROM (
        SELECT *, {planck('w4', 'bt4')} AS l4, {planck('w4', 'bg4')} AS g4, {planck('w5', 'bt5')} AS l5, {planck('w5', 'bg5')} AS g5, greatest(400.0::DOUBLE, bt4 + 0.5::DOUBLE) AS lo0 FROM (
        SELECT *, CASE WHEN instrument LIKE 'MODIS%' THEN 3.96::DOUBLE ELSE 3.74::DOUBLE END AS w4, CASE WHEN instrument LIKE 'MODIS%' THEN 11.03::DOUBLE ELSE 11.45::DOUBLE END AS w5 FROM bg))""",
    "bisect": f"""SELECT ord, w4, w5, l4, g4, l5, g5, 0 AS i, lo0 AS lo, 2500.0::DOUBLE AS hi, {residual('lo0')} AS flo, {residual('2500.0::DOUBLE')} AS fhi, true AS ok FROM start WHERE early IS NULL
      UNION ALL SELECT ord, w4, w5, l4, g4, l5, g5, i + 1, CASE WHEN flo * f <= 0 THEN lo ELSE mid END, CASE WHEN flo * f <= 0 THEN mid ELSE hi END, CASE WHEN flo * f <= 0 THEN flo ELSE f END, fhi, ok AND f IS NOT NULL
      FROM (SELECT *, {residual('mid')} AS f FROM (SELECT *, (lo + hi) / 2 AS mid FROM bisect WHERE i < 60 AND flo IS NOT NULL AND fhi IS NOT NULL AND (i > 0 OR flo * fhi <= 0)))""",
    "solved": "SELECT ord, (lo + hi) / 2 AS t FROM bisect WHERE i = 60 AND ok",
    "phys": f"""SELECT *, {TCLASS} AS temp_class FROM (
      SELECT *, CASE WHEN st = 'ok' THEN {he('t', 1)} END AS est_temp_k, CASE WHEN st = 'ok' THEN p END AS hot_fraction, {he('area', 1)} AS pixel_area_m2, CASE WHEN st = 'ok' THEN {he('p * area', 1)} END AS est_area_m2,
        coalesce(instrument LIKE 'VIIRS%' AND bt4 >= 367, false) AS i4_saturated, CASE WHEN coalesce(instrument LIKE 'VIIRS%' AND bt4 >= 367, false) THEN 'saturated_lower_bound' ELSE st END AS retrieval_status FROM (
      SELECT *, CASE WHEN early IS NOT NULL THEN early WHEN t IS NULL THEN 'no_bracket' WHEN t >= 2479 THEN 'unconstrained' WHEN p IS NULL OR p <= 0 OR p > 1 THEN 'no_solution' ELSE 'ok' END AS st,
        coalesce(scan, 0.375) * coalesce(track, 0.375) * 1e6 AS area FROM (
      SELECT s.*, t, CASE WHEN {planck('w4', 't')} - g4 > 0 THEN (l4 - g4) / ({planck('w4', 't')} - g4) END AS p FROM start s LEFT JOIN solved USING (ord))))""",
    "win": "SELECT min(acq_date) AS d0, date_diff('day', min(acq_date), max(acq_date)) + 1 AS w FROM clean",
    "days": f"""SELECT {he('latitude', 2)} AS grid_lat, {he('longitude', 2)} AS grid_lon, w, date_diff('day', d0, acq_date) AS day, avg(frp) AS frp, count(*) AS n, count(*) FILTER (daynight = 'N') AS nights FROM clean, win GROUP BY ALL""",
    "steps": """SELECT *, day - lag(day) OVER c AS gap, row_number() OVER c AS k, sum(frp) OVER (PARTITION BY grid_lat, grid_lon ORDER BY day ROWS UNBOUNDED PRECEDING) AS lsum, sum(frp) OVER a AS total, count(*) OVER a AS m, stddev_pop(frp) OVER a AS sd
        FROM days WINDOW c AS (PARTITION BY grid_lat, grid_lon ORDER BY day), a AS (PARTITION BY grid_lat, grid_lon)""",
    "cellagg": """SELECT grid_lat, grid_lon, w, count(*) AS rec, sum(n) AS n, sum(nights) AS nights, min(day) AS first_, max(day) AS last_, avg(gap) AS mu, stddev_pop(gap) AS sg, max(gap) AS gap,
        max(CASE WHEN k < m THEN abs((total - lsum) / nullif(m - k, 0) - lsum / k) / nullif(sd, 0) END) AS shift FROM steps GROUP BY ALL""",
    "cells": f"""SELECT grid_lat, grid_lon, rec::INT AS recurrence_days, n::INT AS detections_in_cell, nights / n AS night_fraction, rec / w AS duty_cycle, CASE WHEN rec >= 3 THEN {clip('1 - sg / mu')} END AS regularity,
        CASE WHEN rec >= 4 THEN least(coalesce(shift, 0), 4.0::DOUBLE) / 4 ELSE 0.0::DOUBLE END AS frp_shift, coalesce(gap - 1, 0)::INT AS longest_gap, (last_ - first_ + 1)::INT AS active_span,
        first_ >= w - 1 - ({tail(C.TAILS['new'])} - 1) AS new_source, last_ <= w - 1 - {tail(C.TAILS['ceased'])} AND rec >= 2 AS ceased_source, coalesce(gap - 1, 0) >= {tail(C.TAILS['reactivated'])} AND rec >= 2 AS reactivated_source,
        {clip('rec / least(w, 15)')} AS persistence_norm FROM cellagg""",
    "base0": f"""SELECT *, {he('latitude', 2)} AS grid_lat, {he('longitude', 2)} AS grid_lon, {he('latitude', 1)} AS rla, {he('longitude', 1)} AS rlo FROM clean""",
    "base1": """SELECT *, median(frp) OVER c AS mc, median(frp) OVER r AS mr, count(*) OVER c AS nc, count(*) OVER r AS nr, (SELECT median(frp) FROM clean) AS ms FROM base0 WINDOW c AS (PARTITION BY grid_lat, grid_lon), r AS (PARTITION BY rla, rlo)""",
    "base2": """SELECT *, 1.4826::DOUBLE * median(abs(frp - mc)) OVER c AS sc, 1.4826::DOUBLE * median(abs(frp - mr)) OVER r AS sr, (SELECT 1.4826::DOUBLE * median(abs(frp - ms)) FROM base1) AS ss FROM base1 WINDOW c AS (PARTITION BY grid_lat, grid_lon), r AS (PARTITION BY rla, rlo)""",
    "base": f"""SELECT ord, frp, baseline_level, baseline_frp, z AS frp_robust_z, {clip('z / 3')} AS abnormality FROM (SELECT *, {clip('(frp - baseline_frp) / greatest(coalesce(nullif(sd, 0), ss, 0), 0.5::DOUBLE)', -10.0, 25.0)} AS z FROM (
        SELECT *, CASE WHEN nc >= 4 THEN 'cell' WHEN nr >= 4 THEN 'region' ELSE 'scene' END AS baseline_level, CASE WHEN nc >= 4 THEN mc WHEN nr >= 4 THEN mr ELSE ms END AS baseline_frp, CASE WHEN nc >= 4 THEN sc WHEN nr >= 4 THEN sr ELSE ss END AS sd FROM base2))""",
    "inten": "SELECT ord, (rank() OVER (ORDER BY frp) + (count(*) OVER (PARTITION BY frp) - 1) / 2) / count(frp) OVER () AS frp_intensity_norm FROM clean WHERE frp IS NOT NULL",
    "places": "SELECT DISTINCT latitude, longitude FROM clean",
    "rec": """SELECT *, CASE source WHEN 'osm' THEN '1' WHEN 'wri' THEN '2' WHEN 'gem' THEN '3' ELSE '4' END || ':' || lpad(source_id, 12, '0') AS o,
        trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 ]+', ' ', 'g'), '\\b(power|thermal|plant|station|ltd|limited|pvt|private|company|co|corp|corporation|the|of|india|indian|unit|phase|works|steel|refinery|project)\\b', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM fac""",
    "recpairs": f"""SELECT x, y FROM (SELECT a.o AS x, b.o AS y, a.plain AS p, b.plain AS q, {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM rec a JOIN rec b ON a.o < b.o AND abs(a.lat - b.lat) < 0.05 AND abs(a.lon - b.lon) < 0.06
        WHERE a.ftype = b.ftype OR a.ftype IN ('industrial_area', 'works', 'other') OR b.ftype IN ('industrial_area', 'works', 'other')) WHERE d <= 1.5 OR d <= 5.0 AND p <> '' AND p = q""",
    "reclinks": "SELECT x, y FROM recpairs UNION ALL SELECT y, x FROM recpairs",
    "recreach": "SELECT o AS node, o AS root FROM rec UNION SELECT l.y, r.root FROM recreach r JOIN reclinks l ON l.x = r.node AND r.root < l.y",
    "recsite": "SELECT o, 'F' || lpad((dense_rank() OVER (ORDER BY root) - 1)::VARCHAR, 5, '0') AS uid FROM (SELECT node AS o, min(root) AS root FROM recreach GROUP BY node)",
    "site": """SELECT uid, avg(lat) AS lat, avg(lon) AS lon, string_agg(DISTINCT source, '|' ORDER BY source) AS sources_present, count(DISTINCT source)::INT AS source_agreement, count(*)::INT AS record_count,
        CASE WHEN bool_or(status = 'operating') THEN 'operating' ELSE arg_min(status, o) END AS status, coalesce(sum(capacity_value) FILTER (capacity_unit = 'MW'), max(capacity_value) FILTER (capacity_unit = 'ttpa')) AS capacity_value,
        CASE WHEN count(capacity_value) FILTER (capacity_unit = 'MW') > 0 THEN 'MW' WHEN count(capacity_value) FILTER (capacity_unit = 'ttpa') > 0 THEN 'ttpa' ELSE '' END AS capacity_unit,
        arg_min(ftype, struct_pack(r := CASE ftype WHEN 'flare' THEN 0 WHEN 'refinery' THEN 1 WHEN 'steel' THEN 2 WHEN 'smelter' THEN 3 WHEN 'cement' THEN 4 WHEN 'power_plant' THEN 5 WHEN 'works' THEN 6 WHEN 'industrial_area' THEN 7 WHEN 'other' THEN 8 ELSE 9 END, o := o)) AS ftype,
        coalesce(arg_min(name, struct_pack(s := source = 'osm', o := o)) FILTER (trim(name) <> ''), '') AS name, coalesce(arg_min(subnational, o) FILTER (trim(subnational) <> ''), '') AS subnational FROM rec JOIN recsite USING (o) GROUP BY uid""",
    "dist": f"SELECT latitude, longitude, source, {km('latitude', 'longitude', 'lat', 'lon')} AS d FROM places, fac",
    "near": f"SELECT latitude, longitude, {nearest_cols()}, min(d) AS d FROM dist GROUP BY ALL",
    "nearsite": f"SELECT latitude, longitude, min(d) AS ds, arg_min(s, struct_pack(d := d, uid := s.uid)) AS site FROM (SELECT latitude, longitude, site AS s, {km('latitude', 'longitude', 'site.lat', 'site.lon')} AS d FROM places, site) GROUP BY ALL",
    "reg": f"""SELECT *, list_aggregate(names, 'string_agg', '|') AS sc, len(names)::INT AS confirming_count, CASE WHEN di <= 1 THEN 'On a registered industrial site' WHEN di <= 3 THEN 'Within the site''s immediate surroundings' WHEN di <= 10 THEN 'Near industrial activity' ELSE 'No registered industrial site nearby' END AS industrial_context FROM (
        SELECT *, {he('least(1.0, (' + VOTES + ') / (SELECT count(DISTINCT source) FROM fac))', 4)} AS corroboration_score, list_filter([{NAMES}], lambda x: x IS NOT NULL) AS names, {he('ds', 3)} AS di FROM near JOIN nearsite USING (latitude, longitude))""",
    "evid": f"""SELECT *, {he(clip('CASE WHEN agri_penalty THEN raw * 0.55 ELSE raw END'), 4)} AS evidence_score FROM (
      SELECT *, {W['corroboration']} * corroboration_score + {W['physics']} * physics_score + {W['persistence']} * persistence_norm + {W['nocturnal']} * nocturnal_score + {W['intensity']} * frp_intensity_norm AS raw,
        coalesce(agri_season_region IS NOT NULL AND temp_class IN ('biomass_like', 'smouldering', 'unknown') AND corroboration_score < 0.3, false) AS agri_penalty FROM (
      SELECT p.*, c.* EXCLUDE (grid_lat, grid_lon), b.abnormality, b.frp_robust_z, b.baseline_frp AS b_frp, b.baseline_level, i.frp_intensity_norm, c.night_fraction AS nocturnal_score, r.corroboration_score, coalesce(r.sc, '') AS sources_confirming, r.confirming_count, r.di AS dist_to_industrial_km, r.industrial_context, r.site.uid AS facility_uid,
        coalesce(CASE WHEN trim(r.site.name) <> '' THEN r.site.name END, 'Unnamed industrial feature') AS facility_name, r.site.ftype AS facility_type, r.site AS site, r.n_osm, r.n_wri, r.n_gem, r.n_eog, r.d_osm, r.d_wri, r.d_gem, r.d_eog, {season('p.acq_date', 'p.')} AS agri_season_region, coalesce({he(clip('(p.est_temp_k - 800) / 700'), 4)}, 0.25) AS physics_score
      FROM phys p JOIN cells c ON {he('p.latitude', 2)} = c.grid_lat AND {he('p.longitude', 2)} = c.grid_lon JOIN base b USING (ord) LEFT JOIN inten i USING (ord) JOIN reg r ON p.latitude = r.latitude AND p.longitude = r.longitude))""",
    "fused": f"""SELECT *, CASE WHEN risk_score <= 0.35 THEN 'Low' WHEN risk_score <= 0.55 THEN 'Moderate' WHEN risk_score <= 0.75 THEN 'High' ELSE 'Critical' END AS priority FROM (
      SELECT *, {he(clip(f"{P['probability']} * fusion_score + {P['abnormality']} * abnormality + {P['persistence']} * persistence_norm + {P['intensity']} * frp_intensity_norm + {P['new']} * new_source::INT"), 4)} AS risk_score FROM (
      SELECT *, {he(clip('(0.55 * evidence_score) / 0.55'), 4)} AS fusion_score FROM evid))""",
    "classed": """SELECT *, CASE WHEN label = 'insufficient_evidence' THEN NULL WHEN evidence_score <= 0.4 THEN 'Low' WHEN evidence_score <= 0.7 THEN 'Moderate' ELSE 'High' END AS evidence_level FROM (
      SELECT *, CASE WHEN confirming_count = 0 AND dist_to_industrial_km > 10 AND agri_season_region IS NOT NULL THEN 'agricultural_burning' WHEN confirming_count = 0 AND dist_to_industrial_km > 10 THEN 'insufficient_evidence' WHEN agri_penalty THEN 'agricultural_burning'
        WHEN temp_class = 'flare_like' AND recurrence_days >= 2 AND confirming_count > 0 THEN 'flare_signature' WHEN fusion_score >= 0.62 AND recurrence_days >= 3 THEN 'persistent_industrial_source' WHEN fusion_score >= 0.42 THEN 'industrial_fire' ELSE 'insufficient_evidence' END AS label FROM fused)""",
    "pairs": f"SELECT a.ord AS a, b.ord AS b, {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS km FROM clean a JOIN clean b ON a.ord < b.ord AND abs(date_diff('day', a.acq_date, b.acq_date)) <= 5 AND abs(a.latitude - b.latitude) < 0.03 AND abs(a.longitude - b.longitude) < 0.035 WHERE {km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 3.0",
    "links": "SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs",
    "reach": "SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node AND r.root < l.b",
    "members": "SELECT node AS ord, min(root) AS cluster_root FROM reach GROUP BY node",
}


def needs(names: list[str], body: str) -> list[str]:
    import re

    found: set[str] = set()

    def visit(text: str) -> None:
        for n in STAGES:
            if n not in found and re.search(rf"\b{n}\b", text):
                found.add(n)
                visit(STAGES[n])

    visit(body)
    return [n for n in STAGES if n in found]


def sql(body: str) -> str:
    """``body`` with the stages it uses in front."""
    used = needs(list(STAGES), body)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({STAGES[n]})" for n in used) + " " + body if used else body
