"""Facility records of map elements, unit trackers and flare inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from .facilities import finalize
from .tables import first, read_cells, split_place

ELEMENT = "struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>"
# Tags that are kept of a map element.
KEPT_TAGS = ("landuse", "man_made", "power", "industrial", "product", "operator", "plant:source", "plant:output:electricity")
# The industrial belts (south, west, north, east) and tags that map elements are asked for.
BELTS = {
    "bokaro_jamshedpur": "22.5,85.5,24.5,87.0",
    "chennai_ennore": "12.5,79.5,14.0,80.5",
    "mumbai_industrial": "18.5,72.5,19.5,73.5",
    "odisha_mining": "20.5,84.0,22.5,86.5",
    "chhattisgarh_steel": "20.5,81.0,22.5,83.5",
    "ncr_delhi": "27.5,76.5,29.0,78.0",
    "gujarat_refineries": "21.0,68.5,23.5,73.0",
    "vizag_paradip": "17.0,81.5,21.0,87.0",
}
WANTED = (
    'way["landuse"="industrial"]', 'way["man_made"="works"]', 'node["man_made"="works"]', 'way["power"="plant"]',
    'way["man_made"="petroleum_well"]', 'node["man_made"="flare"]', 'way["industrial"="refinery"]', 'way["industrial"="factory"]',
)
# File, sheet and facility class of each tracker.
TRACKERS = {
    "gem_coal_plant_tracker.xlsx": ("Units", "power_plant"),
    "gem_oil_gas_plant_tracker.xlsx": ("Gas & Oil Units", "power_plant"),
    "gem_steel_plant_tracker.xlsx": ("Steel Plants", "steel"),
}
# Names that flare inventories have had for a column, by release.
FLARE_NAMES = {
    "lat": ("latitude", "lat", "flare_lat", "Latitude", "Lat"),
    "lon": ("longitude", "lon", "flare_lon", "Longitude", "Lon"),
    "id": ("id_key", "flare_id", "id", "catalog_id", "ID"),
    "bcm": ("bcm", "bcm_2021", "bcm_2022", "bcm_2023", "flared_volume_bcm", "Flared volume (bcm)", "avg_bcm"),
    "temp": ("avg_temp_k", "temp_k", "avg_temp", "Temperature (K)"),
    "detections": ("clear_obs", "detection_freq", "n_detections", "count"),
    "rh": ("rh", "avg_rh_mw", "radiant_heat", "rhi"),
    "type": ("type", "flare_type", "industry", "Sector"),
    "country": ("country", "iso", "Country", "cnty"),
}


# --- map elements -----------------------------------------------------------------


def element_query(box: str) -> str:
    """What a map server is asked for one belt."""
    return "[out:json][timeout:90];(" + "".join(f"{w}({box});" for w in WANTED) + ");out center;"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements (type, id, lat, lon, center, tags) of the documents at ``path``."""
    return spark.read.schema(f"elements array<{ELEMENT}>").json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")


def element_records(elements: DataFrame, box: tuple[float, float, float, float] = C.COUNTRY_BOX) -> DataFrame:
    """Records of map elements; ways lie at their centre, elements without a place are left out."""
    tag = lambda k: F.col("tags")[k]
    return finalize(
        elements.select(
            F.lit("osm").alias("source"), F.concat_ws("/", "type", F.col("id").cast("string")).alias("source_id"), tag("name").alias("name"), X.osm_ftype(tag).alias("ftype"),
            F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), F.lit("").alias("capacity_unit"), F.lit("unknown").alias("status"), tag("addr:state").alias("subnational"),
            F.map_filter("tags", lambda k, _: k.isin(*KEPT_TAGS)).alias("attrs"),
        ),
        box,
    )


# --- unit trackers ------------------------------------------------------------------


def read_trackers(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the workbooks in ``folder`` (path, n, cells)."""
    return read_cells(spark, f"{folder}/gem_*.xlsx", {name: sheet for name, (sheet, _) in TRACKERS.items()})


def tracker_records(rows: DataFrame, country: str = "India", box: tuple[float, float, float, float] = C.COUNTRY_BOX) -> DataFrame:
    """Records of trackers' units in ``country``. ``rows``: path, cells."""
    file = F.regexp_extract("path", "([^/]*)$", 1)
    kind = F.create_map(*[F.lit(x) for name, (_, ftype) in TRACKERS.items() for x in (name, ftype)])
    rows = rows.withColumn("_file", file).withColumn("_type", F.coalesce(F.try_element_at(kind, F.col("_file")), F.lit("power_plant")))
    rows = rows.where(F.trim(first("Country/Area", "Country")) == country)
    told = lambda *names: F.coalesce(first(*names), F.lit(""))
    name, unit = told("Plant name", "Plant name (English)", "Unit name"), told("Unit name")
    both = split_place(first("Coordinates"))
    own = F.col("cells")["Latitude"].isNotNull()
    raw = F.lower(F.trim(F.coalesce(first("Status", "Capacity operating status"), F.lit("unknown"))))
    megawatt = F.coalesce(F.col("cells")["Capacity (MW)"].try_cast("double") != 0, F.col("cells")["Capacity (MW)"].isNotNull())
    tracker = F.regexp_replace(F.regexp_replace("_file", "gem_", ""), "[.]xlsx", "")
    common = [tracker.alias("tracker"), unit.alias("unit"), told("Owner", "Owner(s)").alias("owner"), told("Parent", "Parent(s)").alias("parent"), told("Start year", "Start date").alias("start_year"), raw.alias("raw_status")]
    steel = F.struct(
        *common, told("Nominal BF capacity (ttpa)").alias("bf_capacity_ttpa"), told("Nominal DRI capacity (ttpa)").alias("dri_capacity_ttpa"),
        told("Coking plant capacity (ttpa)").alias("coking_capacity_ttpa"), told("Sinter plant capacity (ttpa)").alias("sinter_capacity_ttpa"),
    )
    plant = F.struct(
        *common, told("Fuel", "Coal type").alias("fuel"), told("Combustion technology", "Turbine/Engine Technology").alias("technology"), told("Annual CO2 (million tonnes / annum)").alias("annual_co2_mt"),
    )
    return finalize(
        rows.select(
            F.lit("gem").alias("source"),
            F.coalesce(first("GEM unit ID", "GEM unit/phase ID", "Plant ID", "GEM location ID"), F.concat_ws(":", "_file", name, unit)).alias("source_id"), name.alias("name"), F.col("_type").alias("ftype"),
            F.when(own, first("Latitude")).otherwise(both[0].cast("string")).alias("lat"), F.when(own, first("Longitude")).otherwise(both[1].cast("string")).alias("lon"),
            first("Capacity (MW)", "Nominal crude steel capacity (ttpa)", "Nominal iron capacity (ttpa)").alias("capacity_value"), F.when(megawatt, "MW").otherwise("ttpa").alias("capacity_unit"),
            X.gem_status(raw).alias("status"), told("Subnational unit (province, state)", "Subnational unit (province/state)", "State/Province").alias("subnational"),
            F.when(F.col("_type") == "steel", F.to_json(steel)).otherwise(F.to_json(plant)).alias("attrs"),
        ),
        box,
    )


# --- flare inventories ---------------------------------------------------------------


def read_flares(spark: SparkSession, path: str) -> DataFrame:
    """Records of a flare inventory in CSV or xlsx (path, n, cells)."""
    return read_cells(spark, path)


def flare_records(rows: DataFrame, box: tuple[float, float, float, float] = C.COUNTRY_BOX) -> DataFrame:
    """Records of flares; rows of another country go, rows of an inventory without that column stay. ``rows``: n, cells."""
    pick = lambda k: first(*FLARE_NAMES[k])
    ours = F.coalesce(F.upper(F.trim(pick("country"))).isin("IND", "INDIA", "IN"), F.lit(True))
    attrs = F.struct(pick("temp").alias("avg_temp_k"), pick("detections").alias("detections"), pick("rh").alias("radiant_heat_mw"), pick("type").alias("flare_type"))
    return finalize(
        rows.where(ours).select(
            F.lit("eog").alias("source"), F.coalesce(pick("id"), F.concat(F.lit("eog-"), F.col("n").cast("string"))).alias("source_id"), F.coalesce(pick("type"), F.lit("Gas flare")).alias("name"),
            F.lit("flare").alias("ftype"), pick("lat").alias("lat"), pick("lon").alias("lon"), pick("bcm").alias("capacity_value"), F.lit("bcm_yr").alias("capacity_unit"), F.lit("operating").alias("status"), attrs.alias("attrs"),
        ),
        box,
    )
