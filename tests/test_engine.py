"""Stages on tiny frames, against what they should say; SQL oracles at the smallest scale."""

import datetime
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from emberline.functions import exprs as X
from emberline.operators import clusters, detections as D, graph, reports, spatial
from emberline.plans import registry

SF = "/root/testdata/sf0.001"
DAY = datetime.date(2026, 6, 1)


def cell(spark, rows):
    """(latitude, longitude, day, daynight, frp)"""
    return spark.createDataFrame([(i, a, b, DAY + datetime.timedelta(days=d), n, f) for i, (a, b, d, n, f) in enumerate(rows)], "ord long, latitude double, longitude double, acq_date date, daynight string, frp double")


def test_lone_spike_is_abnormal(spark):
    rows = [(22.0, 80.0, d, "N", f) for d, f in enumerate((2.0, 2.1, 1.9, 2.0, 2.2, 40.0))]
    got = {r.ord: r for r in D.robust_baseline(cell(spark, rows)).collect()}
    assert got[5].abnormality == 1.0 and all(got[i].abnormality < 0.2 for i in range(5)) and got[0].baseline_level == "cell"


def test_thin_cells_fall_back(spark):
    got = D.robust_baseline(cell(spark, [(22 + 0.01 * i, 80.0, i, "N", 3.0 + i) for i in range(6)])).collect()
    assert {r.baseline_level for r in got} <= {"region", "scene"}


def test_temporal_signature(spark):
    got = D.temporal_cells(cell(spark, [(22.0, 80.0, d, "N", 5.0) for d in range(5)])).first()
    assert (got.recurrence_days, got.night_fraction, got.duty_cycle, got.regularity) == (5, 1.0, 1.0, 1.0)


def test_new_and_ceased(spark):
    got = {r.grid_lat: r for r in D.temporal_cells(cell(spark, [(22.0, 80.0, 0, "D", 1.0), (22.0, 80.0, 1, "D", 1.0), (25.0, 80.0, 4, "D", 1.0)])).collect()}
    assert got[25.0].new_source and not got[22.0].new_source and got[22.0].ceased_source


def planck(w, t):
    m, h, c, k = w * 1e-6, 6.62607015e-34, 2.99792458e8, 1.380649e-23
    return 2 * h * c * c / m**5 / math.expm1(h * c / (m * k * t)) * 1e-6


def brightness(w, radiance):
    m, h, c, k = w * 1e-6, 6.62607015e-34, 2.99792458e8, 1.380649e-23
    return h * c / (m * k) / math.log1p(2 * h * c * c / m**5 / (radiance * 1e6))


def test_subpixel_recovers_fires(spark):
    cases = [(1800, 0.0004), (1500, 0.0008), (1200, 0.002), (750, 0.01), (600, 0.04)]
    rows = [(i, "VIIRS", brightness(3.74, p * planck(3.74, t) + (1 - p) * planck(3.74, 300)), brightness(11.45, p * planck(11.45, t) + (1 - p) * planck(11.45, 300)), 300.0, 300.0, None, None) for i, (t, p) in enumerate(cases)]
    rows += [(5, "VIIRS", 300.5, 300.0, 300.0, 300.0, None, None), (6, "VIIRS", 340.0, 300.2, 300.0, 300.0, None, None), (7, "VIIRS", None, 300.0, 300.0, 300.0, None, None)]
    df = spark.createDataFrame(rows, "ord long, instrument string, bt4 double, bt5 double, bg4 double, bg5 double, scan double, track double")
    got = {r.ord: r for r in D.subpixel(df).collect()}
    for i, (t, p) in enumerate(cases):
        assert abs(got[i].est_temp_k - t) < 0.02 * t and abs(got[i].hot_fraction - p) < 0.05 * p
    assert [got[i].retrieval_status for i in (5, 6, 7)] == ["below_background", "weak_11um", "no_data"] and got[5].est_temp_k is None


def test_bands_and_confidence(spark):
    one = spark.createDataFrame([(v,) for v in ("l", "n", "h", "L", " n ", "49", "50", "79", "80", "abc", None)], "confidence string")
    got = [tuple(r) for r in one.select(X.confidence_kept("confidence"), X.confidence_rank("confidence")).collect()]
    assert got == [(False, 1), (True, 2), (True, 3), (False, 1), (True, 2), (False, 1), (True, 2), (True, 2), (True, 3), (True, 0), (True, 0)]
    t = spark.createDataFrame([(v,) for v in (0.35, 0.351, 0.55, 0.75, 0.76, None)], "x double").select(X.priority_band("x")).collect()
    assert [r[0] for r in t] == ["Low", "Moderate", "Moderate", "High", "Critical", None]


def test_components_are_those_of_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}


def test_nearest_is_brute_force(spark):
    rng = random.Random(1)
    points = [(rng.uniform(8, 36), rng.uniform(68, 97)) for _ in range(60)]
    sites = [("g", f"{i:03}", rng.uniform(8, 36), rng.uniform(68, 97)) for i in range(40)] + [("h", "000", 10.0, 70.0)]
    got = spatial.nearest(spark.createDataFrame(points, "plat double, plon double"), spark.createDataFrame(sites, "grp string, ord string, slat double, slon double").withColumn("site", F.struct("ord"))).collect()

    def km(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    assert len(got) == 120
    for r in got:
        assert abs(r.km - min(km(r.plat, r.plon, s[2], s[3]) for s in sites if s[0] == r.grp)) < 1e-6


def test_bridge_merges_incompatible_classes(spark):
    rec = [("0", "osm", "1", "Alpha Steel", "steel", 20.0, 75.0, None, "", "unknown"), ("1", "osm", "2", "", "industrial_area", 20.01, 75.0, None, "", "unknown"), ("2", "gem", "3", "Beta", "flare", 20.02, 75.0, 5.0, "MW", "operating"), ("3", "gem", "4", "Far", "steel", 21.0, 75.0, None, "", "x")]
    df = spark.createDataFrame(rec, "ord string, source string, source_id string, name string, ftype string, lat double, lon double, capacity_value double, capacity_unit string, status string")
    sites = {r.facility_uid: r for r in clusters.site_groups(clusters.assign_sites(df)).collect()}
    assert set(sites) == {"F00000", "F00001"}
    one = sites["F00000"]
    assert (one.ftype, one.name, one.status, one.capacity_value, one.record_count, one.sources_present) == ("flare", "Beta", "operating", 5.0, 3, "gem|osm")


def test_query_ignores_what_it_cannot_read(spark):
    q = reports.DetectionQuery.parse({"bbox": "1,2", "min_score": "x", "sources": "zzz"})
    assert q.bbox is None and q.min_score is None and not q.sources


def test_expressions_stay_in_the_engine(spark):
    plan = D.subpixel(D.background(registry.clean(spark, SF)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["dedup_best_per_cell_day", "subpixel_temperature", "robust_baseline", "temporal_signature", "corroboration_score", "playback_trail", "site_collapse"])
def test_oracle(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    clean = lambda rows: sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)
    assert clean(got.select(*columns).collect()) == clean(want)
