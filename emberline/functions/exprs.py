"""Column builders; all stay inside Spark's code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .. import config as C

# Words that facility names are compared without.
NAME_NOISE = (
    "power", "thermal", "plant", "station", "ltd", "limited", "pvt", "private", "company", "co", "corp", "corporation",
    "the", "of", "india", "indian", "unit", "phase", "works", "steel", "refinery", "project",
)
# Facility classes, the most specific first, with what names them.
FTYPE_RANK = ("flare", "refinery", "steel", "smelter", "cement", "power_plant", "works", "industrial_area", "other")
GENERIC_FTYPES = ("industrial_area", "works", "other")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_even(x: Column | str, digits: int = 0) -> Column:
    """Rounding to even, as arrays round: scale, ``rint``, scale back."""
    return F.rint(col(x) * 10.0**digits) / 10.0**digits


def clip(x: Column | str, low: float, high: float) -> Column:
    """Bounded value; null stays null."""
    return F.when(col(x).isNotNull(), F.least(F.greatest(col(x), F.lit(low)), F.lit(high)))


def haversine_km(lat1, lon1, lat2, lon2, radius: float = C.EARTH_KM) -> Column:
    """Great-circle distance of points in degrees."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def planck_terms(wavelength_um: Column) -> tuple[Column, Column]:
    """What of the radiance hangs on the wavelength only: the first radiation term and the wavelength in metres."""
    m = wavelength_um * 1e-6
    return 2 * C.PLANCK_H * C.LIGHT_C**2 / F.pow(m, 5), m


#: The second radiation term, m K.
PLANCK_RATIO = C.PLANCK_H * C.LIGHT_C / C.BOLTZMANN_K


def radiance(top: Column, m: Column, temperature: Column) -> Column:
    return top / F.expm1(F.lit(PLANCK_RATIO) / (m * temperature)) * 1e-6


def planck(wavelength_um: Column, temperature: Column) -> Column:
    """Spectral radiance, W m-2 sr-1 um-1."""
    return radiance(*planck_terms(wavelength_um), temperature)


def detection_id(lat: str = "latitude", lon: str = "longitude", day: str = "acq_date", time: str = "acq_time") -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.format_string("%.5f", lat), F.format_string("%.5f", lon), F.col(day).cast("string"), F.col(time).cast("string"))), 1, 12)


def confidence_kept(c: Column | str) -> Column:
    """Letters: all but low; numbers: 50 and over; what is neither is kept."""
    v = F.lower(F.trim(col(c)))
    return F.when(v == "l", False).when(v.isin("n", "h"), True).otherwise(F.coalesce(v.try_cast("double") >= 50, F.lit(True)))


def confidence_rank(c: Column | str) -> Column:
    v = F.lower(F.trim(col(c)))
    n = v.try_cast("double")
    return F.when(v == "h", 3).when(v == "n", 2).when(v == "l", 1).when(n.isNull(), 0).when(n >= 80, 3).when(n >= 50, 2).otherwise(1)


def sensor_rank(s: Column | str) -> Column:
    base = F.regexp_replace(col(s), "_[^_]*$", "")
    return F.when(base == "VIIRS_NOAA21", 4).when(base == "VIIRS_NOAA20", 3).when(base == "VIIRS_SNPP", 2).when(base == "MODIS", 1).otherwise(0)


def temperature_class(t: Column | str) -> Column:
    out = F.when(col(t).isNull(), "unknown")
    for low, name in C.TEMPERATURE_BANDS:
        out = out.when(col(t) >= low, name)
    return out.otherwise("unknown")


def banded(x: Column | str, edges: tuple, names: tuple) -> Column:
    """Right-closed bands: the first edge that is not passed names the band."""
    out = F.when(col(x).isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, names):
        out = out.when(col(x) <= edge, name)
    return out.otherwise(names[-1])


def priority_band(x: Column | str) -> Column:
    return banded(x, (0.35, 0.55, 0.75), ("Low", "Moderate", "High", "Critical"))


def evidence_band(x: Column | str) -> Column:
    return banded(x, (0.4, 0.7), ("Low", "Moderate", "High"))


def normal_name(x: Column | str) -> Column:
    """Lower case, letters and digits only, without noise words."""
    n = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit("none"))), "[^a-z0-9 ]+", " ")
    n = F.regexp_replace(n, rf"\b({'|'.join(NAME_NOISE)})\b", " ")
    return F.trim(F.regexp_replace(n, " +", " "))


def compatible(a: Column, b: Column) -> Column:
    """Whether two facility classes may be one site."""
    return (a == b) | a.isin(*GENERIC_FTYPES) | b.isin(*GENERIC_FTYPES)


def osm_ftype(tag) -> Column:
    """Facility class from OSM tags; ``tag`` gives the column of a key."""
    # The words and tags of each class.
    words = F.lower(F.concat_ws(" ", *[F.coalesce(tag(k), F.lit("")) for k in ("product", "works", "industrial", "industry", "craft", "name")]))

    def has(*names: str) -> Column:
        return _any(words, names)

    return (
        F.when((tag("man_made") == "flare") | has("flare"), "flare")
        .when(has("refinery"), "refinery")
        .when(has("steel", "ispat", "foundry"), "steel")
        .when(has("cement", "clinker"), "cement")
        .when(has("smelter", "aluminium", "aluminum"), "smelter")
        .when(tag("power") == "plant", "power_plant")
        .when(tag("man_made") == "works", "works")
        .when(tag("landuse") == "industrial", "industrial_area")
        .otherwise("other")
    )


def _any(words: Column, names: tuple[str, ...]) -> Column:
    out = words.contains(names[0])
    for n in names[1:]:
        out = out | words.contains(n)
    return out


def gem_status(x: Column | str) -> Column:
    v = F.lower(F.trim(col(x)))
    # The trackers' words for a status.
    return (
        F.when(v.isin("operating", "operating pre-retirement"), "operating").when(v == "construction", "construction")
        .when(v.isin("permitted", "pre-permit", "announced", "proposed", "shelved"), "announced")
        .when(v.isin("mothballed", "retired"), "retired").when(v == "cancelled", "cancelled").otherwise("unknown")
    )


def finite(x: Column | str) -> Column:
    """Null for NaN and infinities."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def web_mercator(lat: Column | str, lon: Column | str, size: float = 256.0) -> tuple[Column, Column]:
    """Pixel at zoom 0."""
    x = (col(lon) + 180.0) / 360.0 * size
    s = F.sin(F.radians(col(lat)))
    y = size * (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * 3.141592653589793))
    return x, y


def register(spark: SparkSession) -> None:
    """SQL functions haversine_km, half_even, temp_class and clip01 for the session."""
    r = 2 * C.EARTH_KM
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN
        {r}D * asin(sqrt(least(1D, pow(sin((radians(c) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin((radians(d) - radians(b)) / 2), 2))))""")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION half_even(x DOUBLE, n INT) RETURNS DOUBLE RETURN rint(x * pow(10, n)) / pow(10, n)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clip01(x DOUBLE) RETURNS DOUBLE RETURN CASE WHEN x IS NOT NULL THEN least(greatest(x, 0D), 1D) END")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION temp_class(t DOUBLE) RETURNS STRING RETURN CASE WHEN t IS NULL THEN 'unknown' WHEN t >= 1400 THEN 'flare_like'
        WHEN t >= 1100 THEN 'furnace_like' WHEN t >= 800 THEN 'mixed' WHEN t >= 500 THEN 'biomass_like' WHEN t >= 0 THEN 'smouldering' ELSE 'unknown' END""")
