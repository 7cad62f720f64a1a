"""Readers on small files written here."""

import json
import zipfile

import pytest

from emberline.sources import archives, facilities

HEAD = "latitude,longitude,brightness,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_t31,frp,daynight,type\n"


def test_archive_beats_the_same_row_in_near_real_time(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "DL_FIRE_SV-C2_123.zip", "w") as z:
        z.writestr("fire_nrt_SV-C2_123.csv", HEAD + "20.1,75.2,330.5,0.4,0.4,2026-06-01,812,N,VIIRS,n,2.0NRT,290.1,5.5,D,\n21.0,76.0,x,0.4,0.4,2026-06-02,1300,N,VIIRS,h,2.0NRT,291.0,7.0,D,\n")
        z.writestr("fire_archive_SV-C2_123.csv", HEAD + "20.1,75.2,331.5,0.4,0.4,2026-06-01,812,N,VIIRS,n,2,290.2,5.6,D,2\n")
        z.writestr("Readme.txt", "none")
    with zipfile.ZipFile(tmp_path / "DL_FIRE_M-C61_7.zip", "w") as z:
        z.writestr("fire_archive_M-C61_7.csv", HEAD + "20.1,75.2,320.0,1,1,2026-06-01,812,Terra,MODIS,80,6.1,300.0,9.0,D,0\n")
    got = {(r.source_sensor, r.acq_time): r for r in archives.read_archives(spark, str(tmp_path)).collect()}
    assert set(got) == {("VIIRS_SNPP_SP", 812), ("VIIRS_SNPP_NRT", 1300), ("MODIS_SP", 812)}
    viirs, modis, unread = got["VIIRS_SNPP_SP", 812], got["MODIS_SP", 812], got["VIIRS_SNPP_NRT", 1300]
    assert (viirs.bright_ti4, viirs.bright_ti5, viirs.brightness, viirs.firms_type) == (331.5, 290.2, None, 2)
    assert (modis.brightness, modis.bright_t31, modis.bright_ti4) == (320.0, 300.0, None)
    assert unread.bright_ti4 is None and unread.firms_type is None


def test_other_names_are_refused():
    with pytest.raises(ValueError):
        archives.sensor_of("/data/DL_FIRE_XX_1.zip")


def test_plants(spark, tmp_path):
    (tmp_path / "p.csv").write_text('country,gppd_idnr,name,latitude,longitude,capacity_mw,primary_fuel,owner\nIND,I1,"A, ""B""",20.5,75.5,100,Coal,\nIND,I2,,20.5,bad,5,Solar,x\nGBR,G1,L,51,0,1,Gas,\nIND,I3,,21,76,none,Solar,x\n')
    got = {r.source_id: r for r in facilities.read_plants(spark, str(tmp_path / "p.csv")).collect()}
    assert set(got) == {"I1", "I3"} and got["I1"].name == 'A, "B"' and got["I3"].name == "" and got["I3"].capacity_value is None
    assert json.loads(got["I1"].attrs)["thermal_fuel"] is True and json.loads(got["I3"].attrs)["thermal_fuel"] is False


def test_finalize(spark):
    rows = spark.createDataFrame([("osm", "1", "20.0", "75.0", {"power": "plant"}, 1), ("osm", "2", "51.5", "0.1", None, 2)], "source string, source_id string, lat string, lon string, attrs map<string,string>, extra int")
    got = facilities.finalize(rows).collect()
    assert len(got) == 1 and got[0].asDict().keys() == set(facilities.TYPES) and json.loads(got[0].attrs) == {"power": "plant"} and got[0].status == ""
    assert facilities.finalize(facilities.empty(spark)).count() == 0
