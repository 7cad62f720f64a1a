"""Readers and sinks on small files of their own."""

import datetime
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from emberline.operators import reports, scoring
from emberline.sinks import files, snapshots
from emberline.sources import boundaries, detections as S, http, inventories, registry, tables


def workbook(sheets):
    """An xlsx file of rows of text, numbers and None."""
    out = io.BytesIO()
    strings = []
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    letter = lambda n: (chr(64 + n // 26) if n >= 26 else "") + chr(65 + n % 26)
    with zipfile.ZipFile(out, "w") as z:
        for n, rows in enumerate(sheets.values(), 1):
            xml = ""
            for r, row in enumerate(rows, 1):
                cells = ""
                for c, v in enumerate(row):
                    if isinstance(v, str):
                        strings.append(v)
                        cells += f'<c r="{letter(c)}{r}" t="s"><v>{len(strings) - 1}</v></c>'
                    elif v is not None:
                        cells += f'<c r="{letter(c)}{r}"><v>{v}</v></c>'
                xml += f'<row r="{r}">{cells}</row>'
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {main}><sheetData>{xml}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s.replace('&', '&amp;')}</t></si>" for s in strings) + "</sst>")
        names = "".join(f'<sheet name="{s.replace("&", "&amp;")}" sheetId="{n}" r:id="rId{n}"/>' for n, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{n}" Type="x" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{targets}</Relationships>')
    return out.getvalue()


COAL = {
    "About": [["nothing"]],
    "Units": [
        ["GEM unit ID", "Country/Area", "Plant name", "Unit name", "Capacity (MW)", "Status", "Latitude", "Longitude", "Coal type", "State/Province", "Start year"],
        ["G1", "India", "Alpha & Co", "1", 500, "Operating", 21.5, 83.5, "bituminous", "Odisha", 1999], ["G2", "China", "Beta", "1", 100, "operating", 30, 110, None, None, None], [None, "India ", "Gamma", "2", None, "Shelved", 22, 84, None, None, None],
    ],
}
STEEL = {"Steel Plants": [["Plant ID", "Country", "Plant name (English)", "Capacity operating status", "Coordinates", "Nominal crude steel capacity (ttpa)"], ["S1", "India", "Delta Steel", "mothballed", "22.8, 86.2", 3000], ["S2", "India", "Nowhere", "operating", "here", 1]]}


def folder_of(tmp_path):
    (tmp_path / "gem_coal_plant_tracker.xlsx").write_bytes(workbook(COAL))
    (tmp_path / "gem_steel_plant_tracker.xlsx").write_bytes(workbook(STEEL))
    (tmp_path / "eog_flares.csv").write_text("id_key,flare_lat,Longitude,iso,avg_bcm,type\n7,26.1,71.2,IND,0.5,upstream\n8,29.0,48.0,KWT,1.5,upstream\n,20.0,72.0,,bad,\n")
    elements = [
        {"type": "way", "id": 5, "center": {"lat": 22.8, "lon": 86.2}, "tags": {"industrial": "factory", "name": "Tata Steel", "addr:state": "Jharkhand", "building": "yes"}},
        {"type": "node", "id": 6, "lat": 19.0, "lon": 73.0, "tags": {"man_made": "flare"}}, {"type": "way", "id": 7, "tags": {"landuse": "industrial"}}, {"type": "node", "id": 8, "lat": 51.5, "lon": 0.1, "tags": {"power": "plant"}},
    ]
    (tmp_path / "osm_industrial.json").write_text(json.dumps({"elements": elements}))
    return str(tmp_path)


def test_trackers(spark, tmp_path):
    folder = folder_of(tmp_path)
    got = {r.source_id: r for r in inventories.tracker_records(inventories.read_trackers(spark, folder)).collect()}
    assert set(got) == {"G1", "gem_coal_plant_tracker.xlsx:Gamma:2", "S1"}
    a, s = got["G1"], got["S1"]
    assert (a.name, a.ftype, a.lat, a.capacity_value, a.capacity_unit, a.status, a.subnational) == ("Alpha & Co", "power_plant", 21.5, 500.0, "MW", "operating", "Odisha")
    assert (s.ftype, s.lat, s.lon, s.capacity_value, s.capacity_unit, s.status) == ("steel", 22.8, 86.2, 3000.0, "ttpa", "retired")
    assert json.loads(a.attrs)["fuel"] == "bituminous" and json.loads(a.attrs)["tracker"] == "coal_plant_tracker" and "bf_capacity_ttpa" in json.loads(s.attrs)
    assert got["gem_coal_plant_tracker.xlsx:Gamma:2"].status == "announced" and got["gem_coal_plant_tracker.xlsx:Gamma:2"].capacity_unit == "ttpa"


def test_flares_and_elements(spark, tmp_path):
    folder = folder_of(tmp_path)
    flares = {r.source_id: r for r in inventories.flare_records(inventories.read_flares(spark, f"{folder}/eog_flares.csv")).collect()}
    assert set(flares) == {"7", "eog-2"} and flares["7"].capacity_value == 0.5 and flares["eog-2"].name == "Gas flare" and flares["eog-2"].capacity_value is None
    found = {r.source_id: r for r in inventories.element_records(inventories.read_elements(spark, f"{folder}/osm_industrial.json")).collect()}
    assert set(found) == {"way/5", "node/6"}
    way = found["way/5"]
    assert (way.ftype, way.lat, way.name, way.subnational, way.attrs) == ("steel", 22.8, "Tata Steel", "Jharkhand", '{"industrial":"factory"}') and found["node/6"].ftype == "flare" and found["node/6"].name == ""


def test_registry_is_built_and_loaded(spark, tmp_path):
    folder = folder_of(tmp_path)
    told = registry.build(spark, folder, str(tmp_path / "out"))
    records, groups, manifest = registry.load(spark, str(tmp_path / "out"))
    assert manifest["sources"].keys() == {"osm", "wri", "gem", "eog"} and manifest["sources"]["wri"]["status"] == "skipped" and manifest["sources"]["gem"]["records"] == 3
    assert told["total_records"] == records.count() == 7 and told["total_sites"] == groups.count() == 6 and told["multi_source_sites"] == 1
    both = groups.where("source_agreement = 2").first()
    assert (both.sources_present, both.ftype, both.name, both.status, both.subnational, both.capacity_value) == ("gem|osm", "steel", "Delta Steel", "unknown" if both.status == "unknown" else both.status, "Jharkhand", 3000.0)
    assert {r[0] for r in records.select("facility_uid").collect()} == {r[0] for r in groups.select("facility_uid").collect()}
    nothing = registry.build(spark, str(tmp_path / "none"), str(tmp_path / "empty"))
    assert nothing["total_records"] == nothing["total_sites"] == 0 and registry.load(spark, str(tmp_path / "empty"))[1].count() == 0
    assert [a.source for a in registry.ADAPTERS] == list(scoring.C.SOURCES)


def test_fetching(tmp_path):
    asked = []

    def post(query):
        asked.append(query)
        if len(asked) == 2:
            raise TimeoutError
        return {"elements": [{"type": "node", "id": len(asked)}]}

    got = registry.fetch_elements(str(tmp_path), post=post, pause=0)
    assert got["status"] == "ok" and len(asked) == 8 and got["failed_regions"] == ["chennai_ennore: TimeoutError"] and asked[0].count("22.5,85.5,24.5,87.0") == 8
    assert registry.fetch_elements(str(tmp_path), post=post)["status"] == "cached" and len(asked) == 8
    (tmp_path / "a").write_bytes(b"x" * 200_000)
    to = tmp_path / "deep" / "b"
    assert http.download((tmp_path / "a").as_uri(), to) == {"status": "ok", "path": str(to), "bytes": 200_000}
    assert http.download("file:///nowhere", to)["status"] == "cached" and http.download("file:///nowhere", to, force=True)["status"] == "unavailable" and to.stat().st_size == 200_000
    assert os.listdir(tmp_path / "deep") == ["b"]
    fetch = registry.fetch_files({"a": (tmp_path / "a").as_uri(), "c": "file:///nowhere"})
    assert fetch(str(tmp_path / "deep"))["status"] == "partial"


def test_detection_tables(spark, tmp_path):
    path = str(tmp_path / "d.csv")
    with open(path, "w") as f:
        f.write("latitude,longitude,brightness,acq_date,acq_time,instrument,confidence,frp,daynight,extra\n20.5,75.25,330.1,2024-01-05,0130,MODIS,80,12.5,N,z\nbad,75,,2024-13-01,x,VIIRS,n,,D,\n")
    got = S.with_channels(S.read_csv(spark, path)).orderBy(F.col("latitude").isNull()).collect()
    assert (got[0].latitude, got[0].acq_date, got[0].acq_time, got[0].confidence, got[0].bt4, got[0].bt5) == (20.5, datetime.date(2024, 1, 5), 130, "80", 330.1, None)
    assert got[1].latitude is None and got[1].acq_date is None and got[1].frp is None
    files.write_csv(S.read_csv(spark, path), str(tmp_path / "packed"), parts=1)
    assert [n for n in os.listdir(tmp_path / "packed") if n.endswith(".csv.gz")] and S.read_csv(spark, str(tmp_path / "packed")).count() == 2
    files.write_table(S.read_csv(spark, path), str(tmp_path / "table"))
    assert any(n.startswith("acq_date=2024-01-05") for n in os.listdir(tmp_path / "table"))


def test_live_feeds(spark, tmp_path):
    (tmp_path / "MODIS_NRT.csv").write_text("latitude,longitude,brightness,bright_t31,acq_date,acq_time,instrument,confidence,frp,daynight\n20,75,330,290,2024-01-05,130,MODIS,80,12.5,N\n")
    (tmp_path / "VIIRS_SNPP_NRT.csv").write_text("Invalid key.\n")
    got = S.read_live(spark, service=tmp_path.as_uri()).collect()  # two feeds are not there
    assert [(r.source_sensor, r.latitude, r.brightness, r.acq_time) for r in got] == [("MODIS_NRT", 20.0, 330.0, 130)]


def test_boundaries(spark, tmp_path):
    states = {"features": [{"geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[[[1, 0], [2, 0], [2, 1], [1, 1], [1, 0]]]]}}]}
    feature = boundaries.build_boundary(states)
    boundaries.write_boundary(feature, str(tmp_path / "b.json"))
    edges = boundaries.read_boundary(spark, str(tmp_path / "b.json")).collect()
    assert abs(sum(e.x1 * e.y2 - e.x2 * e.y1 for e in edges)) / 2 == pytest.approx(2.0)
    assert boundaries.read_boundary(spark, str(tmp_path / "none.json")) is None
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", **states}))
    assert boundaries.read_boundary(spark, str(tmp_path / "c.json")).count() == 8


def test_cells_and_places(spark):
    df = spark.createDataFrame([(1, "", "b"), (2, None, None)], "n int, x string, y string")
    assert [r.v for r in tables.as_cells(df, "n").select(tables.first("x", "y").alias("v")).collect()] == ["b", None]
    texts = spark.createDataFrame([("20.5, 75",), ("20.5",), ("a, b",), ("1,2,3",), (None,)], "t string")
    lat, lon = tables.split_place(F.col("t"))
    assert [tuple(r) for r in texts.select(lat, lon).collect()] == [(20.5, 75.0)] + [(None, None)] * 4


def test_documents_snapshots_and_their_cache(spark, tmp_path):
    path = str(tmp_path / "r.json")
    files.write_document(spark, {"a": float("inf"), "b": [1, {"c": None}], "d": datetime.date(2024, 1, 1)}, path)
    assert files.read_document(spark, path) == {"a": None, "b": [1, {"c": None}], "d": "2024-01-01"} and files.read_document(spark, str(tmp_path / "x"), 7) == 7
    assert files.export_name("clusters", None, "csv") == "clusters_unknown.csv"
    rows = [("a", 0.5, 900.0, datetime.date(2024, 1, 2)), ("b", 0.25, None, datetime.date(2024, 1, 1))]
    make = lambda r: spark.createDataFrame(r, "detection_id string, risk_score double, est_temp_k double, acq_date date")
    one, other = snapshots.snapshot(make(rows)).first(), snapshots.snapshot(make(rows[::-1])).first()
    assert one == other and one.retrieval_success_rate == 0.5 and snapshots.snapshot(make(rows[:1])).first().snapshot_id != one.snapshot_id
    table, cache, calls = str(tmp_path / "t"), snapshots.SnapshotCache(spark), []
    make(rows).coalesce(1).write.parquet(table)
    count = lambda df: calls.append(1) or df.count()
    assert cache.get(table, "n", count) == cache.get(table, "n", count) == 2 and len(calls) == 1 and cache.get(str(tmp_path / "none")) is None
    os.utime(table, (1, 1))
    assert cache.get(table, "n", count) == 2 and len(calls) == 2


def test_features_and_output(spark, tmp_path):
    df = spark.createDataFrame([(1, 20.0, 75.0, "x"), (2, None, 75.0, "y")], "ord long, latitude double, longitude double, label string")
    files.write_features(reports.geojson(df, ["ord", "label"]), str(tmp_path / "g"))
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "g")).collect()]
    assert json.loads(line) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [75.0, 20.0]}, "properties": {"ord": 1, "label": "x"}}
    out = reports.select_output(df, [("label", "string"), ("missing", "double")])
    assert out.columns == ["label", "missing"] and out.first().missing is None
    assert [json.loads(r.document)["ord"] for r in files.documents(df).collect()] == [1, 2]
