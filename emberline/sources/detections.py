"""Detections from CSV, plain or packed, and from the live service."""

from __future__ import annotations

import csv
import io
import os
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import TYPES

#: Columns of a detection table; ``confidence`` is text, as it mixes letters and numbers.
SCHEMA = (
    "latitude double, longitude double, brightness double, bright_t31 double, bright_ti4 double, bright_ti5 double, scan double, track double, acq_date date, acq_time int, satellite string, "
    "instrument string, confidence string, version string, frp double, daynight string, firms_type int, source_sensor string"
)
# Feeds of the live service, its box (west, south, east, north) and days.
FEEDS = ("VIIRS_SNPP_NRT", "VIIRS_NOAA20_NRT", "VIIRS_NOAA21_NRT", "MODIS_NRT")
LIVE_BOX, LIVE_DAYS = "68,8,90,32", 5
SERVICE = "https://firms.modaps.eosdis.nasa.gov/api/area/csv"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A detection table in CSV (.gz too): columns by name, missing ones null, values that are not of their type null."""
    raw = spark.read.csv(path, header=True, multiLine=False)
    kinds = [c.split(" ") for c in SCHEMA.split(", ")]
    return raw.select(*[(F.col(c).try_cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in kinds])


def channels(modis: Column) -> dict[str, Column]:
    """The two temperatures that the physics reads, whichever instrument gave them."""
    return {"bt4": F.when(modis, F.col("brightness")).otherwise(F.col("bright_ti4")), "bt5": F.when(modis, F.col("bright_t31")).otherwise(F.col("bright_ti5"))}


def with_channels(df: DataFrame) -> DataFrame:
    return df.withColumns(channels(F.col("instrument").startswith("MODIS")))


def feed_rows(text: str, feed: str) -> Iterator[tuple]:
    """Rows of a live answer as text, with their feed; what is no table gives none."""
    reader = csv.DictReader(io.StringIO(text))
    if reader.fieldnames and "latitude" in reader.fieldnames:
        names = [*TYPES, "bright_ti4", "bright_ti5"]
        for r in reader:
            yield (*[r.get(c) or None for c in names], feed)


class Feed(InputPartition):
    def __init__(self, name: str, url: str):
        super().__init__(name)
        self.name, self.url = name, url


class LiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        o = self.options
        base, box, days = o.get("service", SERVICE), o.get("box", LIVE_BOX), o.get("days", str(LIVE_DAYS))
        feeds = o.get("feeds", ",".join(FEEDS)).split(",")
        if base.startswith("file:"):
            return [Feed(f, f"{base}/{f}.csv") for f in feeds]
        key = os.environ.get("FIRMS_MAP_KEY", "")
        if not key:
            raise ValueError("FIRMS_MAP_KEY must hold the key of the live service")
        return [Feed(f, f"{base}/{key}/{f}/{box}/{days}") for f in feeds]

    def read(self, partition):
        try:
            with urllib.request.urlopen(partition.url, timeout=60) as answer:
                text = answer.read().decode("utf-8-sig")
        except OSError:  # a feed that fails gives no rows; the others do
            return
        yield from feed_rows(text, partition.name)


class LiveDetections(DataSource):
    """``spark.read.format("live_detections")``: one partition a feed; options service, feeds, box and days."""

    @classmethod
    def name(cls):
        return "live_detections"

    def schema(self):
        return ", ".join(f"`{c}` string" for c in [*TYPES, "bright_ti4", "bright_ti5", "source_sensor"])

    def reader(self, schema):
        return LiveReader(self.options)


def read_live(spark: SparkSession, **options: str) -> DataFrame:
    """Detections of the last days, typed."""
    spark.dataSource.register(LiveDetections)
    raw = spark.read.format("live_detections").options(**options).load().withColumnRenamed("type", "firms_type")
    kinds = [c.split(" ") for c in SCHEMA.split(", ")]
    return raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in kinds])
