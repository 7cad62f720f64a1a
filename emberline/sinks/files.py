"""Tables and reports as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, packed: bool = True, parts: int | None = None) -> None:
    """CSV with a header, gzipped unless told otherwise; ``parts``: files, by default as many as the plan has."""
    out = df if parts is None else df.coalesce(parts)
    out.write.mode("overwrite").option("header", True).option("compression", "gzip" if packed else "none").csv(path)


def write_table(df: DataFrame, path: str, day: str = "acq_date") -> None:
    """Parquet by day, the form that date filters prune."""
    df.write.mode("overwrite").partitionBy(day).parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON text sequence: a feature a line, however many. ``features``: feature."""
    features.select("feature").write.mode("overwrite").text(path)


def export_name(kind: str, snapshot_id: str | None, ending: str) -> str:
    """File name of an export: what it holds and of which snapshot."""
    return f"{kind}_{snapshot_id or 'unknown'}.{ending}"


def plain(value):
    """A value as JSON has it: rows become objects, what is no number null."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and (value != value or abs(value) == float("inf")):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A JSON document on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        stream.write(bytearray(json.dumps(plain(document), indent=2, ensure_ascii=False).encode()))
    finally:
        stream.close()


def read_document(spark: SparkSession, path: str, default=None):
    """A JSON document, or ``default`` if it is not there."""
    from ..sources.registry import exists

    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else default


def documents(df: DataFrame) -> DataFrame:
    """Each row as one JSON text (document)."""
    return df.select(F.to_json(F.struct("*")).alias("document"))
