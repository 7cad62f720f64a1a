"""Facility inventories: one schema for records of every source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C

TYPES = dict(pair.split(" ") for pair in C.FACILITY_COLUMNS.split(", "))
# Fuels of thermal plants in the plant inventory.
THERMAL = ("Coal", "Gas", "Oil", "Petcoke", "Cogeneration", "Biomass", "Waste")


def empty(spark: SparkSession) -> DataFrame:
    """No records, with their schema: what a missing source gives."""
    return spark.createDataFrame([], C.FACILITY_COLUMNS)


def finalize(df: DataFrame, box: tuple[float, float, float, float] = C.COUNTRY_BOX) -> DataFrame:
    """Records in the schema: numbers that cannot be read become null, missing columns are filled, nulls of text are empty.

    Rows outside ``box`` (south, north, west, east; edges inside) or without coordinates go;
    a map or struct in attrs becomes JSON. Other columns are ignored.
    """
    has = {f.name: f.dataType for f in df.schema}

    def column(name: str, kind: str):
        blank = F.lit("{}" if name == "attrs" else "")
        if kind == "double":
            c = F.col(name).try_cast("double") if name in has else F.lit(None).cast("double")
        elif name not in has:
            c = blank
        elif isinstance(has[name], (T.MapType, T.StructType)):
            c = F.coalesce(F.to_json(name), blank)
        else:
            c = F.coalesce(F.col(name).cast("string"), blank)
        return c.alias(name)

    south, north, west, east = box
    return df.select(*[column(*t) for t in TYPES.items()]).where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def read_plants(spark: SparkSession, path: str, country: str = "IND", box: tuple[float, float, float, float] = C.COUNTRY_BOX) -> DataFrame:
    """Power plants of a country from a plant inventory in CSV."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    wanted = ("country", "gppd_idnr", "name", "latitude", "longitude", "capacity_mw", "primary_fuel", "owner", "commissioning_year", "url")
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted]).where(F.col("country") == country)
    fuel = F.trim(text("primary_fuel"))
    attrs = F.struct(fuel.alias("primary_fuel"), fuel.isin(*THERMAL).alias("thermal_fuel"), *[text(c).alias(c) for c in ("owner", "commissioning_year", "url")])
    return finalize(
        rows.select(
            F.lit("wri").alias("source"), F.col("gppd_idnr").alias("source_id"), "name", F.lit("power_plant").alias("ftype"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
            F.col("capacity_mw").alias("capacity_value"), F.lit("MW").alias("capacity_unit"), F.lit("operating").alias("status"), attrs.alias("attrs"),
        ),
        box,
    )
