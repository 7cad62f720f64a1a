"""Aggregates and reads behind the reports and the query interface."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from .ranks import before, group_quantiles


@dataclass
class DetectionQuery:
    """Filters of the read interface as one conjunction; what cannot be read is ignored."""

    labels: list[str] = field(default_factory=list)
    priorities: list[str] = field(default_factory=list)
    temp_classes: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    min_score: float | None = None
    min_fusion: float | None = None
    date_from: str | None = None
    date_to: str | None = None
    bbox: tuple[float, float, float, float] | None = None
    q: str | None = None
    uids: DataFrame | None = None

    @classmethod
    def parse(cls, args: dict[str, str]) -> DetectionQuery:
        """From query-string values."""
        listed = lambda k: [v.strip() for v in args.get(k, "").split(",") if v.strip()]

        def number(k):
            try:
                return float(args[k])
            except (KeyError, ValueError):
                return None

        try:
            box = tuple(map(float, args["bbox"].split(",")))
        except (KeyError, ValueError):
            box = None
        return cls(listed("label"), listed("risk"), listed("temp_class"), [s for s in listed("sources") if s in C.SOURCES], number("min_score"), number("min_fusion"), args.get("from") or None, args.get("to") or None, box if box and len(box) == 4 else None, args.get("q") or None)

    def apply(self, df: DataFrame) -> DataFrame:
        tests: list[Column] = []
        for values, column in ((self.labels, "label"), (self.priorities, "priority"), (self.temp_classes, "temp_class")):
            if values:
                tests.append(F.col(column).isin(*values))
        if self.sources:
            tests.append(F.arrays_overlap(F.split("sources_confirming", "[|]"), F.array(*map(F.lit, self.sources))))
        if self.min_score is not None:
            tests.append(F.col("risk_score") >= self.min_score)
        if self.min_fusion is not None:
            tests.append(F.col("fusion_score") >= self.min_fusion)
        if self.date_from:
            tests.append(F.col("acq_date") >= F.lit(self.date_from).cast("date"))
        if self.date_to:
            tests.append(F.col("acq_date") <= F.lit(self.date_to).cast("date"))
        if self.bbox:
            w, s, e, n = self.bbox
            tests += [F.col("longitude").between(w, e), F.col("latitude").between(s, n)]
        if self.q:
            tests.append(F.contains(F.lower("facility_name"), F.lit(self.q.lower())))
        for t in tests:
            df = df.where(t)
        return df.join(self.uids, "facility_uid", "left_semi") if self.uids is not None else df


def day_spine(df: DataFrame, day: str = "acq_date") -> DataFrame:
    """Every day from the first to the last."""
    return df.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b")).alias(day))


def daily_by_class(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """Counts of each class on each day, zeros included."""
    table = df.groupBy("acq_date").pivot(label, values).count()
    return day_spine(df).join(table, "acq_date", "left").na.fill(0, values).select("acq_date", *[F.col(v).cast("long").alias(v) for v in values])


def footprint(df: DataFrame, flag: Column, step: float = 0.5) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / step) * step + step / 2
    return df.groupBy(at("latitude").alias("lat"), at("longitude").alias("lon")).agg(F.count("*").alias("n"), X.half_even(F.avg(flag.cast("double")), 3).alias("share"))


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def present(df: DataFrame, column: str) -> Column:
    """Whether a value is there; blank text isn't."""
    c = F.col(column)
    return c.isNotNull() & (F.trim(c) != "") if dict(df.dtypes)[column] == "string" else c.isNotNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMBERS]


def column_profile(df: DataFrame, bins: int = 18, few: int = 6) -> DataFrame:
    """Of each numeric column of more than ``few`` values: fill rate, least, middle and greatest value, and counts in ``bins`` bins between its 1st and 99th percentile, what lies beyond in the outer ones."""
    columns = numeric_columns(df)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    rows = long.groupBy("name").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("fill"))
    finite = long.where(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    stats = group_quantiles(finite, "name", "x", {"mid": 0.5, "p1": 0.01, "p99": 0.99}).where(F.col("distinct") > few).join(rows, "name")
    width = (F.col("p99") - F.col("p1")) / bins
    bin_ = F.when(width > 0, F.least(F.greatest(F.floor((F.col("x") - F.col("p1")) / width), F.lit(0)), F.lit(bins - 1))).otherwise(bins // 2).cast("int")
    return finite.join(F.broadcast(stats), "name").groupBy("name", "fill", "low", "mid", "high", bin_.alias("bin")).agg(F.count("*").alias("n"))


def column_values(df: DataFrame, few: int = 6, k: int = 5) -> DataFrame:
    """Of each other column: fill rate, distinct values, and its ``k`` commonest ones, cut to 40 signs; ties go to the smaller."""
    texts = [F.struct(F.lit(c).alias("name"), F.when(present(df, c), F.col(c).cast("string")).alias("x"), F.lit(c in numeric_columns(df)).alias("numeric")) for c in df.columns]
    long = df.select(F.explode(F.array(*texts)).alias("e")).select("e.*")
    counts = long.groupBy("name", "numeric", "x").agg(F.count("*").alias("n"))
    stats = counts.groupBy("name", "numeric").agg((F.sum(F.when(F.col("x").isNotNull(), F.col("n"))) / F.sum("n")).alias("fill"), F.count("x").alias("distinct")).where(~F.col("numeric") | (F.col("distinct") <= few))
    # of each column the commonest values meet; the window keeps k rows of each while it sorts
    w = Window.partitionBy("name").orderBy(F.col("n").desc(), "x")
    top = counts.where("x IS NOT NULL").join(F.broadcast(stats.select("name")), "name", "left_semi").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return stats.join(top.select("name", "place", F.substring("x", 1, 40).alias("value"), "n"), "name", "left").select("name", F.coalesce("fill", F.lit(0.0)).alias("fill"), "distinct", "place", "value", "n")


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    counts = df.groupBy(F.substring(F.col(column).cast("string"), 1, 40).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "value").limit(k)


def group_by_site(df: DataFrame) -> DataFrame:
    """One row per site (or loose cell): its riskiest detection, rows and days."""
    key = F.coalesce(F.col("facility_uid"), F.concat(F.lit("loose:"), X.half_even("latitude", 2), F.lit(","), X.half_even("longitude", 2)))
    return df.groupBy(key.alias("site")).agg(F.max_by("ord", F.struct("risk_score", -F.col("ord"))).alias("lead_ord"), F.max("risk_score").alias("risk_score"), F.count("*").alias("detections"), F.count_distinct("acq_date").alias("days"))


def feed(df: DataFrame, by: str, k: int = 400) -> DataFrame:
    """The top of the list; an operator that is a limit by nature."""
    return df.orderBy(F.col(by).desc_nulls_last(), "ord").limit(k)


def playback(df: DataFrame, trail: int = 6) -> DataFrame:
    """Of each day: detections in its trailing frame and their faded weight. From daily counts, by a range window."""
    days = df.groupBy(F.datediff("acq_date", F.lit("2024-01-01")).alias("d")).agg(F.count("*").alias("n"))
    w = Window.orderBy("d").rangeBetween(-trail, 0)
    return days.select("d", F.sum("n").over(w).alias("shown"), (0.8 * (F.sum("n").over(w) - (F.col("d") * F.sum("n").over(w) - F.sum(F.col("d") * F.col("n")).over(w)) / (trail + 1))).alias("weight"))


def tiles(df: DataFrame, zooms: tuple[int, ...] = tuple(range(3, 18)), classes: tuple[str, ...] = (), cell: int = 48) -> DataFrame:
    """Counts, in all and of each class (k0, k1, ... in their order; others count as the last), on a grid of ``cell`` pixels at each zoom."""
    x, y = X.web_mercator("latitude", "longitude")
    at = df.withColumn("z", F.explode(F.array(*map(F.lit, zooms)))).withColumns({"tx": F.floor(x * F.pow(F.lit(2.0), F.col("z")) / cell), "ty": F.floor(y * F.pow(F.lit(2.0), F.col("z")) / cell)})
    known = F.col("label").isin(*classes[:-1]) if classes else None
    of_class = [F.count_if(F.col("label") == c if i < len(classes) - 1 else ~known | F.col("label").isNull()).alias(f"k{i}") for i, c in enumerate(classes)]
    return at.groupBy("z", "tx", "ty").agg(F.count("*").alias("n"), *of_class)


def dictionary(df: DataFrame, column: str, ordinal: str = "ord") -> DataFrame:
    """Codes of a column's values in order of first sight; a missing value is an empty one."""
    first = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.min(ordinal).alias("_o"))
    return before(first, [F.col("_o")], "code").select("value", F.col("code").cast("int").alias("code"))


#: Fields of the map, how they are rounded, and which travel as codes.
MAP_FIELDS = (
    "detection_id", "latitude", "longitude", "acq_date", "frp", "label", "risk_score", "evidence_score", "corroboration_score", "est_temp_k", "recurrence_days", "dist_to_industrial_km", "facility_name", "facility_uid", "sources_confirming",
)
MAP_ROUNDING = {"latitude": 5, "longitude": 5, "frp": 2, "risk_score": 3, "evidence_score": 3, "corroboration_score": 3, "est_temp_k": 0, "dist_to_industrial_km": 2}
MAP_CODES = ("acq_date", "label", "facility_name", "facility_uid", "sources_confirming")


def map_payload(df: DataFrame, fields: tuple[str, ...] = MAP_FIELDS, rounding: dict[str, int] | None = None, coded: tuple[str, ...] = MAP_CODES, ordinal: str = "ord") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows of the fields, rounded, with codes in place of the coded ones; and the dictionaries. What is no number is null."""
    rounding = MAP_ROUNDING if rounding is None else rounding
    books = {c: dictionary(df, c, ordinal) for c in coded if c in fields}
    rows = df.select(ordinal, *[X.finite(X.half_even(c, rounding[c])).alias(c) if c in rounding else F.col(c) for c in fields])
    for c, book in books.items():
        rows = rows.withColumn("_k", F.coalesce(F.col(c).cast("string"), F.lit(""))).join(book.select(F.col("value").alias("_k"), F.col("code").alias("_code")), "_k", "left").withColumn(c, F.col("_code")).drop("_k", "_code")
    return rows, books


def decoded(rows: DataFrame, books: dict[str, DataFrame]) -> DataFrame:
    """Rows of :func:`map_payload` with their values again."""
    for c, book in books.items():
        rows = rows.join(book.select(F.col("code").alias(c), F.col("value").alias("_v")), c, "left").withColumn(c, F.col("_v")).drop("_v")
    return rows


def geojson(df: DataFrame, properties: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A Feature for each row with a place."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select("ord", F.to_json(feature).alias("feature"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums, and the confusion at 0.5."""
    from .detections import average_rank

    known = df.where(F.col(label).isNotNull()).select(F.col(score).alias("s"), F.col(label).alias("y"))
    n = F.count("*")
    ranked = average_rank(known, "s", "pct")
    pos = F.sum("y")
    rank_sum = F.sum(F.when(F.col("y") == 1, F.col("pct"))) * n
    return ranked.agg(
        X.half_even((rank_sum - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0)), 6).alias("auc"),
        F.count_if((F.col("s") >= 0.5) & (F.col("y") == 1)).alias("tp"), F.count_if((F.col("s") >= 0.5) & (F.col("y") == 0)).alias("fp"),
        F.count_if((F.col("s") < 0.5) & (F.col("y") == 0)).alias("tn"), F.count_if((F.col("s") < 0.5) & (F.col("y") == 1)).alias("fn"),
    )


def select_output(df: DataFrame, contract: list[tuple[str, str]]) -> DataFrame:
    """The contract's columns in order; missing ones as nulls."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in contract])


def facilities(groups: DataFrame, source: str | None = None, bbox: tuple[float, float, float, float] | None = None, limit: int = 4000) -> DataFrame:
    """Sites that a registry lists, in a box (west, south, east, north), by their ids; a limit by nature."""
    if source:
        groups = groups.where(F.array_contains(F.split("sources_present", "[|]"), source))
    if bbox:
        w, s, e, n = bbox
        groups = groups.where(F.col("lat").between(s, n) & F.col("lon").between(w, e))
    return groups.orderBy("facility_uid").limit(limit)


def detection(df: DataFrame, detection_id: str) -> DataFrame:
    """One detection, its contributions as structs; no row if there is none."""
    from .scoring import PART

    parts = f"array<struct<{PART.replace(', ', ',').replace(' ', ':')}>>"
    return df.where(F.col("detection_id") == detection_id).withColumn("contributions", F.coalesce(F.from_json("contributions", parts), F.array().cast(parts)))


def is_night() -> Column:
    return F.upper("daynight") == "N"


def site_summary(df: DataFrame, uid: str) -> DataFrame:
    """What was seen at a site, in one row (none if nothing was), over the days of the whole table."""
    window = df.agg((F.datediff(F.max("acq_date"), F.min("acq_date")) + 1).alias("window_days"))
    own = df.where(F.col("facility_uid") == uid).groupBy("facility_uid").agg(
        F.count("*").alias("detections"), F.count_distinct("acq_date").alias("days_active"), F.min("acq_date").alias("first_seen"), F.max("acq_date").alias("last_seen"), X.half_even(F.max("frp"), 2).alias("max_frp"),
        X.half_even(F.max("risk_score"), 3).alias("max_risk"), X.half_even(F.max("est_temp_k"), 1).alias("max_temp_k"), X.half_even(F.avg(is_night().cast("double")), 3).alias("night_fraction"),
    )
    return own.crossJoin(F.broadcast(window))


def site_days(df: DataFrame, uid: str) -> DataFrame:
    """Every day of the table at a site, quiet days included."""
    own = df.where(F.col("facility_uid") == uid).groupBy("acq_date").agg(
        F.count("*").alias("detections"), X.half_even(F.max("frp"), 2).alias("max_frp"), X.half_even(F.max("risk_score"), 3).alias("max_risk"), X.half_even(F.max("est_temp_k"), 1).alias("max_temp_k"), F.count_if(is_night()).alias("night"),
    )
    return day_spine(df).join(own, "acq_date", "left").na.fill(0, ["detections", "night"]).na.fill(0.0, ["max_frp", "max_risk"])


def cell_days(df: DataFrame, lat: float, lon: float) -> DataFrame:
    """Every day of the table in the grid cell of a place: greatest power and detections. Keys round halves up, as the viewer's do."""
    up = lambda c: F.floor(F.col(c) * 100 + 0.5) / 100
    own = df.where((up("latitude") == F.floor(F.lit(lat) * 100 + 0.5) / 100) & (up("longitude") == F.floor(F.lit(lon) * 100 + 0.5) / 100))
    return day_spine(df).join(own.groupBy("acq_date").agg(F.max("frp").alias("value"), F.count("*").alias("count")), "acq_date", "left").na.fill(0, ["count"]).na.fill(0.0, ["value"])


def counts_in_order(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts and shares of the given values, in their order, those that never come included."""
    wanted = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], "place int, value string")
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("t"))
    out = wanted.join(n, "value", "left").crossJoin(F.broadcast(total))
    return out.select("place", "value", F.coalesce("n", F.lit(0)).alias("n"), X.half_even(F.coalesce(F.col("n") / F.nullif("t", F.lit(0)), F.lit(0.0)), 6).alias("share"))


def described(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Of each column, over all rows and by class: rows with and without a value, mean, deviation, quartiles, and whiskers at 1.5 quartile ranges."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")
    classes = F.explode(F.array(F.lit("all"), F.col(by))).alias("class")
    long = df.select(classes, *[c for c in columns]).select("class", each).select("class", "e.*").withColumn("_key", F.concat_ws("\0", "name", "class"))
    q = group_quantiles(long, "_key", "x", {"q1": 0.25, "mid": 0.5, "q3": 0.75})
    moments = long.groupBy("_key", "name", "class").agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    met = moments.join(q.drop("rows", "distinct"), "_key", "left")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = long.join(F.broadcast(q.select("_key", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_a"), (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_b"))), "_key")
    ends = ends.groupBy("_key").agg(F.min(F.when(F.col("x") >= F.col("_a"), F.col("x"))).alias("whisker_low"), F.max(F.when(F.col("x") <= F.col("_b"), F.col("x"))).alias("whisker_high"), F.count_if((F.col("x") < F.col("_a")) | (F.col("x") > F.col("_b"))).alias("outliers"))
    return met.join(ends, "_key", "left").drop("_key").withColumn("reach", reach)


def log_histogram(df: DataFrame, column: str, low: float = 0.1, bins: int = 40) -> DataFrame:
    """Counts in ``bins`` bins that are equal on a logarithmic scale from ``low`` to the greatest value; smaller values are in none."""
    top = df.agg(F.max(column).alias("_top"))
    rows = df.where(F.col(column) >= low).crossJoin(F.broadcast(top))
    at = F.floor(F.log10(F.col(column) / low) / F.log10(F.col("_top") / low) * bins)
    return rows.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def density(df: DataFrame, west: float = 67.5, south: float = 6.5, side: float = 31.0, cells: int = 400) -> DataFrame:
    """Counts on a square grid of ``cells`` cells a side; what lies outside is left out."""
    at = lambda c, low: F.least(F.lit(cells - 1), F.floor((F.col(c) - low) / side * cells))
    inside = F.col("longitude").between(west, west + side) & F.col("latitude").between(south, south + side)
    return df.where(inside).groupBy(at("longitude", west).alias("gx"), at("latitude", south).alias("gy")).agg(F.count("*").alias("n"))


def blurred(grid: DataFrame, sigma: float = 8.0, cells: int = 400, reach: float = 4.0) -> DataFrame:
    """The grid under a Gaussian of ``sigma`` cells, one axis after the other, mirrored at its edges; cells that get nothing are left out."""
    import math

    r = int(reach * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    kernel = grid.sparkSession.createDataFrame([(k, w / sum(weights)) for k, w in zip(range(-r, r + 1), weights)], "k int, w double")
    out = grid.withColumn("v", F.col("n").cast("double"))
    for axis, other in (("gx", "gy"), ("gy", "gx")):
        at = F.pmod(F.col(axis) + F.col("k"), F.lit(2 * cells))
        at = F.when(at >= cells, 2 * cells - 1 - at).otherwise(at)
        out = out.crossJoin(F.broadcast(kernel)).groupBy(at.alias(axis), other).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.select("gx", "gy", "v")


def kernel_density(df: DataFrame, bandwidth: float, west: float, south: float, step: float, cells: int, reach: float = 4.0) -> DataFrame:
    """Sum of Gaussians of ``bandwidth`` degrees at the cells' middles, from detections within ``reach`` bandwidths."""
    far = int(reach * bandwidth / step) + 1
    x, y = (F.floor((F.col(c) - low) / step).cast("int") for c, low in (("longitude", west), ("latitude", south)))
    spots = df.groupBy("latitude", "longitude").agg(F.count("*").alias("m")).withColumns({"cx": x, "cy": y})
    near = spots.withColumn("gx", F.explode(F.expr(f"sequence(cx - {far}, cx + {far})"))).withColumn("gy", F.explode(F.expr(f"sequence(cy - {far}, cy + {far})")))
    dx, dy = west + (F.col("gx") + 0.5) * step - F.col("longitude"), south + (F.col("gy") + 0.5) * step - F.col("latitude")
    inside = F.col("gx").between(0, cells - 1) & F.col("gy").between(0, cells - 1) & (dx * dx + dy * dy <= (reach * bandwidth) ** 2)
    return near.where(inside).groupBy("gx", "gy").agg(F.sum(F.col("m") * F.exp(-(dx * dx + dy * dy) / (2 * bandwidth**2))).alias("v"))


def triage(df: DataFrame, actionable: tuple[str, ...]) -> DataFrame:
    """How much of the list need not be looked at: one row."""
    n = F.count_if(F.col("label").isin(*actionable))
    return df.agg(F.count("*").alias("total"), n.alias("actionable"), X.half_even(1 - n / F.nullif(F.count("*"), F.lit(0)), 6).alias("reduction"))


def metrics(df: DataFrame, classes: tuple[str, ...], first: str | None = None, last: str | None = None) -> DataFrame:
    """Counters of a period: each class, two sources and more, and temperatures."""
    if first:
        df = df.where(F.col("acq_date") >= F.lit(first).cast("date"))
    if last:
        df = df.where(F.col("acq_date") <= F.lit(last).cast("date"))
    return df.agg(*[F.count_if(F.col("label") == c).alias(c) for c in classes], F.count_if(F.col("confirming_count") >= 2).alias("multi_source"), F.count_if(F.col("est_temp_k").isNotNull()).alias("temperature"))


def stacked(df: DataFrame, most: int = 60, shown: int = 12) -> DataFrame:
    """Of each spot with several detections the ``shown`` riskiest of its first ``most``."""
    own = Window.partitionBy("latitude", "longitude")
    rows = df.withColumns({"_n": F.count("*").over(own), "_i": F.row_number().over(own.orderBy("ord"))}).where(f"_n > 1 AND _i <= {most}")
    return rows.withColumn("place", F.row_number().over(own.orderBy(F.col("risk_score").desc(), "ord"))).where(F.col("place") <= shown).drop("_n", "_i")


def marks() -> dict[str, Column]:
    """Size of a marker, weight on the heat map."""
    return {"radius": F.greatest(F.lit(3.4), F.least(F.lit(11.0), 3.4 + F.sqrt(F.coalesce("frp", F.lit(0.0))) * 1.5)), "heat": F.least(F.lit(1.0), F.col("frp") / 20)}


def viewed(df: DataFrame, classes: tuple[str, ...], min_score: float = 0.0, sources: tuple[str, ...] = (), search: str = "", watch: DataFrame | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """What a viewer keeps: rows that pass every filter but the days, and whether they lie in the period (in_window)."""
    df = df.where(F.col("label").isin(*classes) & (F.coalesce("risk_score", F.lit(0.0)) >= min_score))
    if sources:
        df = df.where(F.arrays_overlap(F.split("sources_confirming", "[|]"), F.array(*map(F.lit, sources))))
    if search:
        df = df.where(F.contains(F.lower("facility_name"), F.lit(search.lower())))
    if watch is not None:
        df = df.join(watch, "facility_uid", "left_semi")
    low = F.col("acq_date") >= F.lit(first).cast("date") if first else F.lit(True)
    high = F.col("acq_date") <= F.lit(last).cast("date") if last else F.lit(True)
    return df.withColumn("in_window", low & high)
