"""The two-channel method solves equal inputs once."""

from pyspark.sql import functions as F

from emberline.operators import detections as D


def test_equal_inputs_are_solved_once_and_rows_without_inputs_stay(spark):
    kinds = [("VIIRS", 340.0, 300.0, 298.0, 290.0), ("MODIS", 340.0, 300.0, 298.0, 290.0), (None, 340.0, 300.0, 298.0, 290.0), ("VIIRS", 299.0, 300.0, 298.0, 290.0), ("VIIRS", None, 300.0, 298.0, 290.0), ("VIIRS", 340.0, float("nan"), 298.0, 290.0)]
    rows = [(i, *kinds[i % len(kinds)], 0.4, 0.4) for i in range(600)]
    df = spark.createDataFrame(rows, "ord long, instrument string, bt4 double, bt5 double, bg4 double, bg5 double, scan double, track double")
    inputs = df.withColumn("_modis", F.coalesce(F.col("instrument").startswith("MODIS"), F.lit(False)))
    assert D.solutions(inputs).count() <= 3  # of 600 rows; one without an instrument is solved as VIIRS
    got = {r.ord: r for r in D.subpixel(df).collect()}
    assert len(got) == 600
    for k in range(len(kinds)):
        assert len({(got[i].retrieval_status, got[i].est_temp_k, got[i].est_area_m2) for i in range(k, 600, len(kinds))}) == 1
    assert got[0].retrieval_status == got[1].retrieval_status == got[2].retrieval_status == "ok"
    assert got[0].est_temp_k == got[2].est_temp_k != got[1].est_temp_k
    assert got[3].retrieval_status == "below_background" and got[4].retrieval_status == "no_data"
