"""Detection archives: zip files of CSV members, one file per sensor.

Zips are unpacked on the executors, a file a row of Spark's binary source (which holds
files of up to 2 GB); values stay text there and are typed by Spark. A file whose name
is not that of a download fails the read. Empty members give no rows; values that are
not of their column's type become null.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detections import archive_first

# Products in the names of downloads, and the sensors they stand for.
PRODUCTS = {"J2V-C2": "VIIRS_NOAA21", "J1V-C2": "VIIRS_NOAA20", "SV-C2": "VIIRS_SNPP", "M-C61": "MODIS"}
NAME = re.compile(r"DL_FIRE_(.+?)_\d+\.zip$")
KEY = ("latitude", "longitude", "acq_date", "acq_time", "satellite")
TYPES = {
    "latitude": "double", "longitude": "double", "brightness": "double", "bright_t31": "double", "scan": "double", "track": "double", "acq_date": "date", "acq_time": "int",
    "satellite": "string", "instrument": "string", "confidence": "string", "version": "string", "frp": "double", "daynight": "string", "type": "int",
}
BATCH = 20_000


def sensor_of(path: str) -> str:
    """The sensor that a download's name stands for."""
    found = NAME.search(path)
    if found is None or found[1] not in PRODUCTS:
        raise ValueError(f"not the name of a detection archive: {path}")
    return PRODUCTS[found[1]]


def unpack(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of all CSV members, as text, with their path, sensor and line."""
    names = [*TYPES, "path", "source_sensor", "line"]
    for batch in files:
        for path, content in zip(batch["path"], batch["content"]):
            sensor, line = sensor_of(path), 0
            with zipfile.ZipFile(io.BytesIO(content)) as packed:
                for member in (m for m in packed.namelist() if m.endswith(".csv")):
                    tag = "SP" if member.startswith("fire_archive") else "NRT"
                    rows: list[tuple] = []
                    with packed.open(member) as raw:
                        for record in csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline="")):
                            rows.append((*[record.get(c) or None for c in TYPES], path, f"{sensor}_{tag}", line))
                            line += 1
                            if len(rows) == BATCH:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)


def read_archives(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Detections of the zips under ``path``; of rows alike in KEY within a file the archived one stays, else the first.

    The two brightness channels of VIIRS get their own columns, bright_ti4 and bright_ti5.
    """
    schema = ", ".join([*(f"`{c}` string" for c in TYPES), "path string", "source_sensor string", "line bigint"])
    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, schema)
    typed = raw.select(*[F.col(c).try_cast(t).alias(c) for c, t in TYPES.items()], "path", "source_sensor", "line")
    kept = archive_first(typed, [*KEY, "path"], F.col("source_sensor").endswith("_SP"), "line")
    viirs = F.startswith("source_sensor", F.lit("VIIRS"))
    split = kept.withColumns({"bright_ti4": F.when(viirs, F.col("brightness")), "bright_ti5": F.when(viirs, F.col("bright_t31"))})
    split = split.withColumns({"brightness": F.when(~viirs, F.col("brightness")), "bright_t31": F.when(~viirs, F.col("bright_t31"))})
    return split.withColumnRenamed("type", "firms_type").drop("path", "line")
