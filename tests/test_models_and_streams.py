"""Models on made-up detections, and streams against their batch operators."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import detections as D, models, outliers, scoring
from emberline.sources import detections as S
from emberline.streaming import detections as T

DAY = datetime.date(2024, 1, 1)
COLUMNS = (
    "ord long, latitude double, longitude double, frp double, frp_robust_z double, est_temp_k double, hot_fraction double, recurrence_days int, night_fraction double, duty_cycle double, frp_shift double, "
    "dist_to_industrial_km double, confirming_count int, corroboration_score double, agri_season_context boolean, evidence_score double"
)


def scored(spark, n=240, positive=0.5):
    rng, rows = random.Random(4), []
    for i in range(n):
        y = rng.random() < positive
        cell = rng.randrange(20) + (0 if y else 20)
        rows.append((i, 20 + cell * 0.02, 75.0, rng.gauss(30 if y else 5, 4), rng.gauss(2 * y, 1), 1200.0 + rng.gauss(0, 50) if y else None, 0.001 if y else None, 9 if y else 1, 0.8 if y else 0.1, 0.5 if y else 0.05, 0.1, 0.5 if y else float("inf"), 2 if y else 0, 0.6 if y else 0.0, False, 0.7 if y else 0.2))
    return spark.createDataFrame(rows, COLUMNS)


def test_classifier_learns_and_folds_keep_cells_whole(spark):
    df = scored(spark)
    labelled = scoring.weak_labels(df).where("weak_label IS NOT NULL")
    rows, k = models.folds(labelled)
    assert k == 5 and rows.count() == labelled.count()
    assert rows.groupBy(models.cell_of()).agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert rows.groupBy("fold").agg(F.count_distinct("weak_label").alias("n")).where("n = 2").count() == k
    fitted = models.fit(df, trees=5)
    assert fitted["report"]["trained"] and fitted["report"]["cv_folds"] == 5 and abs(sum(fitted["report"]["feature_importance"].values()) - 1) < 0.01
    out = {r.ord: r.ml_probability for r in models.add_probability(df, fitted).collect()}
    truth = {r.ord: r.weak_label for r in labelled.collect()}
    assert len(out) == 240 and all((out[i] > 0.5) == (y == 1) for i, y in truth.items()) and fitted["oof"].count() == len(truth)


def test_too_few_labels_and_rows(spark):
    few = scored(spark, 30, 0.1)
    fitted = models.fit(few, trees=2)
    assert not fitted["report"]["trained"] and fitted["report"]["reason"]
    assert models.add_probability(few, fitted).where("ml_probability IS NOT NULL").count() == 0
    assert models.unsupervised(few.limit(19)).where("unsupervised_score IS NOT NULL").count() == 0


def test_models_are_saved_and_loaded(spark, tmp_path):
    df = scored(spark, 120)
    fitted = models.fit(df, trees=3)
    models.save(fitted, str(tmp_path))
    again = models.load(str(tmp_path), len(fitted["models"]))
    assert sorted(models.add_probability(df, fitted).select("ord", "ml_probability").collect()) == sorted(models.add_probability(df, again).select("ord", "ml_probability").collect())


def test_an_outlier_ranks_first(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 4)))] + [(999, [9.0, -9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "ord long, v array<double>")
    for scores, name in ((outliers.isolation_forest(df, "ord", "v", 50), "isolation"), (outliers.local_outlier_factor(df, "ord", "v"), "lof")):
        assert scores.orderBy(F.col(name).desc()).first().ord == 999


def test_local_outlier_factor_is_brute_force(spark):
    rng, k = np.random.default_rng(5), 6
    x = rng.normal(size=(60, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    radius = np.take_along_axis(d, near[:, -1:], 1)[:, 0]
    reach = np.maximum(radius[near], np.take_along_axis(d, near, 1))
    density = 1 / (reach.mean(1) + 1e-10)
    want = density[near].mean(1) / density
    got = outliers.local_outlier_factor(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "ord long, v array<double>"), "ord", "v", k)
    assert np.allclose([r.lof for r in got.orderBy("ord").collect()], want)


def test_precision_report(spark):
    rng = random.Random(1)
    rows = [(round(rng.random(), 1), rng.randrange(2)) for _ in range(80)] + [(0.9, None)]
    got = models.precision_report(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    known = [r for r in rows if r[1] is not None]
    total, ap = sum(y for _, y in known), 0.0
    for t in sorted({s for s, _ in known}, reverse=True):
        hits = [y for s, y in known if s >= t]
        ap += sum(y for s, y in known if s == t) / total * sum(hits) / len(hits)
    flagged = [y for s, y in known if s >= 0.5]
    p, r = sum(flagged) / len(flagged), sum(flagged) / total
    assert [got.average_precision, got.precision, got.recall, got.f1] == pytest.approx([ap, p, r, 2 * p * r / (p + r)], abs=1e-6)


def drops(spark, tmp_path):
    """Three files of detections that come one after the other; the last corrects rows of the first."""
    rng, rows = random.Random(9), []
    for i in range(90):
        day = DAY + datetime.timedelta(days=rng.choice((0, 1, 2, 3, 9, 10)))
        rows.append((20 + rng.randrange(3) * 0.5, 75.0, day, rng.randrange(4) * 100, "N", rng.choice(("VIIRS_SNPP_SP", "VIIRS_SNPP_NRT")), float(i)))
    folder = tmp_path / "drops"
    folder.mkdir()
    for k in range(3):
        lines = [f"{a},{b},{d},{t},{s},{p},{f}" for a, b, d, t, s, p, f in rows[30 * k : 30 * k + 30]]
        (folder / f"{k}.csv").write_text("latitude,longitude,acq_date,acq_time,satellite,source_sensor,frp\n" + "\n".join(lines) + "\n")
    return str(folder)


def read(frame):
    return frame.withColumns({"at": T.moment(), "ord": F.col("frp").cast("long"), "day_at": F.to_timestamp("acq_date")})


def streamed(spark, folder):
    names = "latitude double, longitude double, acq_date date, acq_time int, satellite string, source_sensor string, frp double"
    return read(spark.readStream.schema(names).option("header", True).option("maxFilesPerTrigger", 1).csv(folder)), read(spark.read.schema(names).csv(folder, header=True))


def test_streams_give_what_batches_give(spark, tmp_path):
    folder = drops(spark, tmp_path)
    stream, batch = streamed(spark, folder)
    got = T.run(T.corrected(stream))
    want = D.archive_first(batch, list(T.KEY), F.col("source_sensor").endswith("_SP"), "ord")
    assert sorted(r.ord for r in got.select("ord").collect()) == sorted(r.ord for r in want.select("ord").collect())
    daily = {(r.day, r.grid_lat): (r.n, r.max_frp) for r in T.run(T.daily_cells(streamed(spark, folder)[0])).collect()}
    assert daily == {(r.acq_date, r.latitude): (r.n, r.m) for r in batch.groupBy("acq_date", "latitude").agg(F.count("*").alias("n"), F.max("frp").alias("m")).collect()}
    week = T.run(T.daily_cells(streamed(spark, folder)[0], length="7 days", slide="1 day"))
    assert week.agg(F.sum("n")).first()[0] == 7 * 90
    assert T.run(T.episodes(streamed(spark, folder)[0])).groupBy("grid_lat").count().agg(F.max("count")).first()[0] == 2


def test_lifecycle_follows_every_file(spark, tmp_path):
    folder = drops(spark, tmp_path)
    stream, batch = streamed(spark, folder)
    rows = T.run(T.lifecycle(stream), "update").collect()
    last = {}
    for r in rows:
        if r.grid_lat not in last or r.days > last[r.grid_lat].days:
            last[r.grid_lat] = r
    for r in batch.groupBy("latitude").agg(F.sort_array(F.collect_set("acq_date")).alias("d")).collect():
        got = last[r.latitude]
        gap = max([(b - a).days - 1 for a, b in zip(r.d, r.d[1:])], default=0)
        assert (got.first_day, got.last_day, got.days, got.longest_gap) == (r.d[0], r.d[-1], len(r.d), gap) and got.state == "reactivated"
    assert len(rows) > len(last)  # cells were told of in several batches


def test_drops_are_read_by_schema(spark, tmp_path):
    folder = drops(spark, tmp_path)
    assert T.read_drops(spark, folder).schema == spark.createDataFrame([], S.SCHEMA).schema
