"""Command line: build the registry, run the analysis over detections, or both.

    python -m emberline.cli registry RAW OUT [--no-fetch] [--force]
    python -m emberline.cli analyse OUT --registry DIR (--input CSV | --from-archive DIR | --live) [--boundary GEOJSON] [--models] [--evaluate]

``analyse`` writes the scored table, clusters, the snapshot and a report to OUT.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import clusters, models, reports, scoring
from .operators.graph import cut
from .operators.ranks import before
from .sinks import files, snapshots
from .sources import archives, boundaries, detections as S, registry


def with_order(df: DataFrame) -> DataFrame:
    """Detections with ord: their place by day, time, coordinates and product."""
    order = [F.col(c) for c in ("acq_date", "acq_time", "latitude", "longitude", "source_sensor")]
    return before(df, order, "ord")


def analyse(spark: SparkSession, detections: DataFrame, records: DataFrame, out: str, boundary: DataFrame | None = None, use_models: bool = False, evaluate: bool = False) -> dict:
    """Everything from raw detections to files; gives the report."""
    rows = with_order(S.with_channels(detections))
    scored = cut(scoring.score_all(rows, records, boundary=boundary, models=models.both_scores() if use_models else None).withColumn("detection_id", X.detection_id()))
    members = cut(clusters.cluster(scored.select("ord", "latitude", "longitude", "acq_date")))
    report = cut(clusters.cluster_report(scored, members))
    named = scored.join(members.join(report.select("cluster_root", "cluster_id"), "cluster_root").select("ord", "cluster_id"), "ord", "left")
    files.write_table(scoring.published(named, snapshots.METHOD_VERSION), f"{out}/detections.parquet")
    files.write_csv(report, f"{out}/clusters")
    told = snapshots.snapshot(scored).first().asDict()
    told["label_counts"] = {r.label: r.n for r in scored.groupBy("label").agg(F.count("*").alias("n")).collect()}  # five classes
    if evaluate:
        told["ablation"] = [r.asDict() for r in scoring.ablation(cut(scoring.thermal(cut(rows.join(scored.select("ord"), "ord", "left_semi")))), records, tuple((s,) for s in scoring.C.SOURCES) + (scoring.C.SOURCES,)).collect()]
        told["evidence_quality"] = models.precision_report(scoring.weak_labels(scored), "evidence_score", "weak_label").crossJoin(reports.auc(scoring.weak_labels(scored), "evidence_score", "weak_label")).first().asDict()
    files.write_document(spark, told, f"{out}/report.json")
    return told


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="emberline")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("registry", help="read the sources and cross-reference them")
    build.add_argument("raw")
    build.add_argument("out")
    build.add_argument("--no-fetch", action="store_true", help="read what is there only")
    build.add_argument("--force", action="store_true", help="get every file again")
    run = commands.add_parser("analyse", help="clean, score and classify detections")
    run.add_argument("out")
    run.add_argument("--registry", required=True)
    given = run.add_mutually_exclusive_group(required=True)
    given.add_argument("--input", help="a detection table in CSV")
    given.add_argument("--from-archive", help="a folder of downloads")
    given.add_argument("--live", action="store_true", help="the feed of the last days")
    run.add_argument("--boundary", help="keep detections inside this GeoJSON")
    run.add_argument("--models", action="store_true", help="train and blend the model scores")
    run.add_argument("--evaluate", action="store_true", help="ablation and quality of the evidence")
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "registry":
        told = registry.build(spark, a.raw, a.out, fetch=not a.no_fetch, force=a.force)
    else:
        found = S.read_csv(spark, a.input) if a.input else S.read_live(spark) if a.live else archives.read_archives(spark, a.from_archive)
        edges = boundaries.read_boundary(spark, a.boundary) if a.boundary else None
        if a.boundary and edges is None:
            print(f"{a.boundary} is not there: nothing is clipped", file=sys.stderr)
        told = analyse(spark, found, registry.load(spark, a.registry)[0], a.out, edges, a.models, a.evaluate)
    print(json.dumps(files.plain(told), indent=2, ensure_ascii=False))
    return told


if __name__ == "__main__":
    main()
