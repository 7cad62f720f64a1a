"""Supervised and label-free scores of detections."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from .graph import cut
from .outliers import isolation_forest, local_outlier_factor
from .ranks import average_rank, before, quantiles

# Features of the classifier, and what the label-free scores see besides.
FEATURES = ("frp", "frp_robust_z", "est_temp_k_filled", "hot_fraction_log", "recurrence_days", "night_fraction", "duty_cycle", "frp_shift")
UNLABELLED = (*FEATURES, "dist_log_km", "corroboration_score")
RAW = ("frp", "bt4", "bt5", "scan", "track")
LEAST_LABELLED, LEAST_ROWS = 10, 20
TREES, LEAF, SEED, FOLDS, DEPTH = 300, 3, 42, 5, 10


def prepared(df: DataFrame) -> DataFrame:
    """``df`` with finite features: a missing temperature is the median one, a missing distance is far, other nulls are 0."""
    middle = quantiles(df, "est_temp_k", {"_mid": 0.5})
    df = df.crossJoin(F.broadcast(middle))
    df = df.withColumns({
        "est_temp_k_filled": F.coalesce("est_temp_k", "_mid", F.lit(800.0)),
        "hot_fraction_log": F.log10(F.greatest(F.coalesce("hot_fraction", F.lit(0.0)), F.lit(0.0)) + 1e-6),
        "dist_log_km": F.log10(F.greatest(F.coalesce(X.finite("dist_to_industrial_km"), F.lit(999.0)), F.lit(0.01))),
    }).drop("_mid")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in UNLABELLED})


def standardised(df: DataFrame, columns: tuple[str, ...], out: str = "vector") -> DataFrame:
    """``df`` with its columns as one array, scaled to mean 0 and population deviation 1; a constant column is 0."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    df = df.crossJoin(F.broadcast(stats))
    scaled = [F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(f"_s_{c}", F.lit(0.0)), F.lit(0.0)) for c in columns]
    return df.withColumn(out, F.array(*scaled)).drop(*stats.columns)


def cell_of(lat: str = "latitude", lon: str = "longitude") -> Column:
    return F.concat_ws(":", X.half_even(lat, 2).cast("string"), X.half_even(lon, 2).cast("string"))


def folds(labelled: DataFrame, label: str = "weak_label", most: int = FOLDS, seed: int = SEED) -> tuple[DataFrame, int]:
    """Rows with the fold of their grid cell, and the number of folds (2 to ``most``, by the cells of the rarer class).

    Cells, not rows, are dealt, those with a positive row apart from the others, so
    no cell lies on both sides and every fold has both kinds where there are enough.
    """
    cells = labelled.select(cell_of().alias("_cell"), label).groupBy("_cell").agg(F.max(label).alias("_y"), F.min(label).alias("_low"))
    n = cells.agg(F.count_if(F.col("_y") == 1).alias("p"), F.count_if(F.col("_low") == 0).alias("q")).first()
    k = max(2, min(most, n.p, n.q))
    dealt = before(cells, [F.col("_y"), F.xxhash64("_cell", F.lit(seed)), F.col("_cell")], "_n").select("_cell", F.pmod("_n", F.lit(k)).cast("int").alias("fold"))
    return labelled.withColumn("_cell", cell_of()).join(dealt, "_cell").drop("_cell"), k


def assembled(df: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def forest(train: DataFrame, label: str, trees: int = TREES, seed: int = SEED, depth: int = DEPTH):
    """A random forest with balanced classes; splits are those of Spark's binned search."""
    n = {int(r[label]): r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}  # two classes
    total = sum(n.values())
    weight = F.when(F.col(label) == 1, total / (2.0 * max(1, n.get(1, 0)))).otherwise(total / (2.0 * max(1, n.get(0, 0))))
    rows = train.withColumn("_w", weight).withColumn(label, F.col(label).cast("double"))
    return RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="_w", numTrees=trees, minInstancesPerNode=LEAF, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows)


def chance(model, df: DataFrame, out: str) -> DataFrame:
    """``df`` with the model's probability of class 1."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def fit(scored: DataFrame, trees: int = TREES, label: str = "weak_label") -> dict:
    """Forests and calibrations of all folds, the out-of-fold rows (label, oof), and a report.

    With fewer than LEAST_LABELLED rows of a class nothing is trained, and the report says why.
    """
    from .scoring import weak_labels

    labelled = cut(prepared(weak_labels(scored)).where(F.col(label).isNotNull()))
    n = labelled.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q")).first()
    report = {"trained": False, "n_positive": n.p, "n_negative": n.q}
    if min(n.p, n.q) < LEAST_LABELLED:
        return {"report": report | {"reason": "not enough confidently-labelled rows to train"}, "models": [], "oof": None}
    rows, k = folds(labelled, label)
    rows = cut(rows)
    rows = assembled(rows)
    models, held = [], None
    for i in range(k):
        model = forest(rows.where(F.col("fold") != i), label, trees)
        out = cut(chance(model, rows.where(F.col("fold") == i), "oof").select("ord", "fold", F.col(label).cast("double").alias(label), "oof"))
        scale = IsotonicRegression(featuresCol="oof", labelCol=label).fit(out)
        models.append((model, scale))
        held = out if held is None else held.unionByName(out)
    whole = forest(rows, label, trees)
    importance = dict(zip(FEATURES, np.round(whole.featureImportances.toArray(), 4).tolist()))
    return {"report": report | {"trained": True, "cv_folds": k, "cv_grouping": "grid_cell", "feature_importance": importance}, "models": models, "oof": held, "whole": whole}


def add_probability(scored: DataFrame, fitted: dict, out: str = "ml_probability") -> DataFrame:
    """``scored`` with the mean of the folds' calibrated probabilities; null where nothing was trained."""
    if not fitted["models"]:
        return scored.withColumn(out, F.lit(None).cast("double"))
    rows = assembled(prepared(scored).select("ord", *FEATURES))
    for i, (model, scale) in enumerate(fitted["models"]):
        rows = scale.transform(chance(model, rows, "oof")).withColumnRenamed("prediction", f"_p{i}").drop("oof")
    mean = sum((F.col(f"_p{i}") for i in range(len(fitted["models"]))), F.lit(0.0)) / len(fitted["models"])
    return scored.drop(out).join(rows.select("ord", X.half_even(mean, 4).alias(out)), "ord", "left")


def save(fitted: dict, path: str) -> None:
    """Every model beside the others."""
    for i, (model, scale) in enumerate(fitted["models"]):
        model.write().overwrite().save(f"{path}/forest_{i}")
        scale.write().overwrite().save(f"{path}/scale_{i}")


def load(path: str, n: int) -> dict:
    from pyspark.ml.classification import RandomForestClassificationModel
    from pyspark.ml.regression import IsotonicRegressionModel

    return {"models": [(RandomForestClassificationModel.load(f"{path}/forest_{i}"), IsotonicRegressionModel.load(f"{path}/scale_{i}")) for i in range(n)]}


def unsupervised(scored: DataFrame, out: str = "unsupervised_score", trees: int = TREES) -> DataFrame:
    """``scored`` with the mean rank of the isolation forest and the local outlier factor over the scaled features; null below LEAST_ROWS rows."""
    n = scored.count()
    if n < LEAST_ROWS:
        return scored.withColumn(out, F.lit(None).cast("double"))
    rows = cut(standardised(prepared(scored), UNLABELLED).select("ord", "vector"))
    alone = isolation_forest(rows, "ord", "vector", trees)
    local = local_outlier_factor(rows, "ord", "vector", min(20, max(5, n // 10)))
    both = cut(alone.join(local, "ord"))
    ranked = average_rank(average_rank(both, "isolation", "_a"), "lof", "_b")
    return scored.drop(out).join(ranked.select("ord", X.half_even((F.col("_a") + F.col("_b")) / 2, 4).alias(out)), "ord", "left")


def both_scores(trees: int = TREES):
    """What :func:`scoring.score_all` takes as ``models``."""

    def add(scored: DataFrame) -> DataFrame:
        scored = cut(add_probability(scored, fit(scored, trees)))
        return cut(unsupervised(scored, trees=trees))

    return add


def legacy_forest(df: DataFrame, label: str = "label", trees: int = 100, seed: int = SEED) -> DataFrame:
    """The older model: raw channels, four fifths of each class to train on; every row with its probability and whether it was held out."""
    rows = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in RAW}).withColumn("held_out", F.pmod(F.xxhash64("ord", F.lit(seed)), F.lit(5)) == 0)
    rows = cut(rows.select("ord", label, "held_out", *RAW))
    model = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, seed=seed).fit(assembled(rows.where("NOT held_out").withColumn(label, F.col(label).cast("double")), RAW))
    return chance(model, assembled(rows, RAW), "probability_1").select("ord", label, "held_out", F.col("probability_1").alias("score"))


def precision_report(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: average precision, precision, recall and F1 at 0.5. Rows of one score are one step of the curve."""
    known = df.where(F.col(label).isNotNull()).groupBy((-F.col(score)).alias("s")).agg(F.sum(label).cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    ranked = before(before(known, [F.col("s")], "_p", F.col("p")), [F.col("s")], "_n", F.col("n"))
    total = known.agg(F.sum("p").alias("_all"))
    step = F.col("p") / F.nullif("_all", F.lit(0.0)) * (F.col("_p") + F.col("p")) / (F.col("_n") + F.col("n"))
    hit = lambda c: F.sum(F.when(F.col("s") <= -0.5, F.col(c)).otherwise(0.0))
    out = ranked.crossJoin(F.broadcast(total)).agg(F.sum(step).alias("ap"), hit("p").alias("tp"), hit("n").alias("flagged"), F.max("_all").alias("positive"))
    precision, recall = F.coalesce(F.col("tp") / F.nullif("flagged", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.col("tp") / F.nullif("positive", F.lit(0.0)), F.lit(0.0))
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return out.select(X.half_even("ap", 6).alias("average_precision"), X.half_even(precision, 6).alias("precision"), X.half_even(recall, 6).alias("recall"), X.half_even(f1, 6).alias("f1"))
