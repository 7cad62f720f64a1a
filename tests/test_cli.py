"""The command line over small files, end to end."""

import datetime
import json
import random

from emberline import cli
from emberline.operators import scoring


def test_registry_and_analysis(spark, tmp_path, capsys):
    raw, rng = tmp_path / "raw", random.Random(3)
    raw.mkdir()
    (raw / "eog_flares.csv").write_text("latitude,longitude,id\n20.0,75.0,1\n21.0,75.5,2\n")
    (raw / "osm_industrial.json").write_text(json.dumps({"elements": [{"type": "node", "id": 6, "lat": 20.001, "lon": 75.0, "tags": {"landuse": "industrial", "name": "Estate"}}]}))
    told = cli.main(["registry", str(raw), str(tmp_path / "registry"), "--no-fetch"], spark)
    assert told["total_records"] == 3 and told["total_sites"] == 2 and told["multi_source_sites"] == 1
    lines = ["latitude,longitude,bright_ti4,bright_ti5,scan,track,acq_date,acq_time,satellite,instrument,confidence,frp,daynight,source_sensor"]
    for k in range(60):
        at = rng.choice(((20.0, 75.0), (21.0, 75.5), (25.0, 80.0)))
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(20))
        lines.append(f"{at[0]},{at[1]},{rng.uniform(320, 366):.1f},{rng.uniform(290, 300):.1f},0.4,0.4,{day},{rng.randrange(24) * 100},N,VIIRS,n,{rng.uniform(1, 40):.1f},N,VIIRS_NOAA20_SP")
    (tmp_path / "d.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"type": "Polygon", "coordinates": [[[74, 19], [77, 19], [77, 22], [74, 22], [74, 19]]]}))
    told = cli.main(["analyse", str(tmp_path / "out"), "--registry", str(tmp_path / "registry"), "--input", str(tmp_path / "d.csv"), "--boundary", str(tmp_path / "b.json"), "--evaluate"], spark)
    out = spark.read.parquet(str(tmp_path / "out" / "detections.parquet"))
    assert set(out.columns) == {c for c, _, _, _ in scoring.OUTPUT} and told["total_detections"] == out.count() > 10
    assert {r[0] for r in out.select("latitude").distinct().collect()} == {20.0, 21.0}  # the rest lies outside
    assert set(told["label_counts"]) <= set(scoring.CLASSES) and sum(told["label_counts"].values()) == out.count()
    assert [r["subset"] for r in sorted(told["ablation"], key=lambda r: r["subset"])] == ["eog", "gem", "osm", "osm+wri+gem+eog", "wri"]
    report = json.loads((tmp_path / "out" / "report.json").read_text())
    assert report["snapshot_id"] == told["snapshot_id"] and spark.read.csv(str(tmp_path / "out" / "clusters"), header=True).count() == 2
    assert out.where("cluster_id IS NULL").count() == 0
