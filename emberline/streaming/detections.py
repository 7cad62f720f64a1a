"""Streams of detections. Each gives what the batch operator of the same name gives of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exprs as X
from ..operators.graph import folder
from ..sources.detections import SCHEMA

KEY = ("latitude", "longitude", "acq_date", "acq_time", "satellite")
LATE = "30 days"


def read_drops(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files as they are dropped into a folder."""
    return spark.readStream.schema(SCHEMA).option("header", True).csv(folder)


def moment(day: str = "acq_date", time: str = "acq_time") -> Column:
    """The time of a detection, from its day and HHMM."""
    return F.to_timestamp(day) + F.make_dt_interval(F.lit(0), F.expr(f"{time} div 100"), F.col(time) % 100, F.lit(0).cast("decimal(18,6)"))


def corrected(stream: DataFrame, keys: tuple[str, ...] = KEY, order: str = "ord", late: str = LATE) -> DataFrame:
    """One row of each key, archived ones before near-real-time ones, then the first: a correction that comes late replaces what stood.

    The best row is state of its key and day; a day that the watermark has passed is final.
    """
    whole = F.struct(*[F.col(c) for c in stream.columns if c != "at"])
    best = F.struct(F.col("source_sensor").endswith("_SP").alias("archived"), (-F.col(order)).alias("o"))
    marked = stream.withWatermark("at", late)
    return marked.groupBy(F.window("at", "1 day"), *keys).agg(F.max_by(whole, best).alias("row")).select("row.*")


def daily_cells(stream: DataFrame, late: str = LATE, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Detections of each grid cell by day, or by a sliding period (7, 30 or 90 days)."""
    at = F.window("at", length, slide) if slide else F.window("at", length)
    rows = stream.withWatermark("at", late).withColumns({"grid_lat": X.half_even("latitude", 2), "grid_lon": X.half_even("longitude", 2)})
    out = rows.groupBy(at.alias("w"), "grid_lat", "grid_lon").agg(F.count("*").alias("n"), F.max("frp").alias("max_frp"))
    return out.select(F.col("w.start").cast("date").alias("day"), "grid_lat", "grid_lon", "n", "max_frp")


def episodes(stream: DataFrame, gap_days: int = 3, late: str = LATE) -> DataFrame:
    """Activity of a cell without a dark gap of ``gap_days`` days."""
    rows = stream.withWatermark("day_at", late).withColumns({"grid_lat": X.half_even("latitude", 2), "grid_lon": X.half_even("longitude", 2)})
    out = rows.groupBy(F.session_window("day_at", f"{gap_days} days").alias("w"), "grid_lat", "grid_lon").agg(F.count("*").alias("n"), F.min("day_at").alias("a"), F.max("day_at").alias("b"))
    return out.select("grid_lat", "grid_lon", F.col("a").cast("date").alias("first_day"), F.col("b").cast("date").alias("last_day"), "n")


LIFE = "grid_lat double, grid_lon double, first_day date, last_day date, days int, longest_gap int, state string"
HELD = "days string"


def life(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, quiet: int, pause: int) -> Iterator[pd.DataFrame]:
    """Days of one cell so far, and what it is: new, active, or back after a pause of ``pause`` days."""
    known = set(map(int, state.get[0].split(","))) if state.exists else set()
    known.update(int(d) for f in frames for d in f["day"])
    state.update((",".join(map(str, sorted(known))),))
    days = sorted(known)
    gap = max([b - a - 1 for a, b in zip(days, days[1:])], default=0)
    what = "reactivated" if len(days) > 1 and gap >= pause else "new" if days[-1] - days[0] < quiet else "active"
    as_date = lambda d: (pd.Timestamp("1970-01-01") + pd.Timedelta(days=d)).date()
    yield pd.DataFrame([(key[0], key[1], as_date(days[0]), as_date(days[-1]), len(days), gap, what)], columns=[c.split(" ")[0] for c in LIFE.split(", ")])


def lifecycle(stream: DataFrame, quiet: int = 2, pause: int = 4) -> DataFrame:
    """A row whenever a cell is seen again: its days so far, longest gap and state. State is the set of days of a cell, bounded by the calendar."""
    rows = stream.select(X.half_even("latitude", 2).alias("grid_lat"), X.half_even("longitude", 2).alias("grid_lon"), F.unix_date("acq_date").alias("day"))
    return rows.groupBy("grid_lat", "grid_lon").applyInPandasWithState(lambda k, f, s: life(k, f, s, quiet, pause), LIFE, HELD, "update", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream gives of all that is there now, written to the shared folder of checkpoints and read back."""
    spark = stream.sparkSession
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/rows")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    from ..sources.registry import exists

    return spark.read.schema(schema).parquet(f"{at}/rows") if exists(spark, f"{at}/rows") else spark.createDataFrame([], schema)
