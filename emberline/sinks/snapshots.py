"""Snapshots: what a table holds, in one row, and a cache of what is read and derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

METHOD_VERSION = "3.0"


def content_id(*columns: str):
    """Eight hex digits that follow from the rows, in whatever order they lie: the sum of digests of the rows."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return F.lower(F.lpad(F.hex(F.pmod(F.sum(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")), F.lit(1 << 32))), 8, "0"))


def snapshot(df: DataFrame, method: str = METHOD_VERSION) -> DataFrame:
    """One row: id, rows, days, method and retrieval rate of a scored table."""
    return df.agg(
        content_id("detection_id").alias("snapshot_id"), F.count("*").alias("total_detections"), F.min("acq_date").alias("first_day"), F.max("acq_date").alias("last_day"),
        F.lit(method).alias("method_version"), X.half_even(F.avg(F.col("est_temp_k").isNotNull().cast("double")), 4).alias("retrieval_success_rate"),
    )


class SnapshotCache:
    """Tables by path and what is derived from them, each made again only when the file has changed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def stamp(self, path: str) -> int:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return system.getFileStatus(where).getModificationTime() if system.exists(where) else -1

    def there(self, made) -> bool:
        """Whether the first file that a derived table reads is still there: tables that it was cut by may be cleared."""
        files = made.inputFiles()[:1] if isinstance(made, DataFrame) else []
        return all(self.stamp(f) >= 0 for f in files)

    def get(self, path: str, key: str = "", compute: Callable[[DataFrame], object] | None = None):
        """The table at ``path`` (cached by Spark), or what ``compute`` makes of it under ``key``; None if there is no such file."""
        now = self.stamp(path)
        if now < 0:
            return None
        old = self.held.get((path, key))
        if old is None or old[0] != now or not self.there(old[1]):
            if old is not None and isinstance(old[1], DataFrame):
                old[1].unpersist()
            made = compute(self.spark.read.parquet(path)) if key else self.spark.read.parquet(path).cache()
            self.held[(path, key)] = old = (now, made)
        return old[1]

    def warm(self, path: str, derived: dict[str, Callable[[DataFrame], object]]) -> None:
        for key, compute in derived.items():
            self.get(path, key, compute)
