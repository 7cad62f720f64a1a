"""Spatio-temporal clusters of detections, and sites of facility records."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import exprs as X
from .graph import components, cut, dealt
from .ranks import before
from .spatial import KM_PER_DEGREE, within


#: Links between packs of places that one task follows; more are followed by joins.
FEW_LINKS = 300_000


def day_number(day: str = "acq_date") -> Column:
    return F.datediff(day, F.lit("1970-01-01"))


def spacetime_pairs(df: DataFrame, ordinal: str = "ord", km: float = C.CLUSTER_KM, days: int = C.CLUSTER_DAYS) -> DataFrame:
    """Pairs a < b of detections at most ``km`` and ``days`` apart: all of them, as a list. Days are bucketed too, so a busy place is dealt over time."""
    day = day_number()
    block = F.floor(day / (days + 1)).cast("int")
    left = df.select(F.col(ordinal).alias("a"), F.col("latitude").alias("llat"), F.col("longitude").alias("llon"), day.alias("lday"), block.alias("t"))
    right = df.select(F.col(ordinal).alias("b"), F.col("latitude").alias("rlat"), F.col("longitude").alias("rlon"), day.alias("rday"), F.explode(F.array(block - 1, block, block + 1)).alias("t"))
    met = within(left, right, km, ("t",))
    return met.where((F.col("a") < F.col("b")) & (F.abs(F.col("lday") - F.col("rday")) <= days)).select("a", "b", "km")


def pack_cell(lat: str, lon: str, km: float) -> tuple[Column, Column]:
    """Row and column of a cell whose diagonal is at most ``km``."""
    side = km / math.sqrt(2) * (1 - 1e-5)
    row = F.floor(F.col(lat) * (KM_PER_DEGREE / side))
    nearest_equator = F.radians(F.least(F.abs(row), F.abs(row + 1)) * (side / KM_PER_DEGREE))
    return row, F.floor(F.col(lon) * (KM_PER_DEGREE / side) * F.cos(nearest_equator))


def packed(df: DataFrame, ordinal: str, km: float, days: int) -> DataFrame:
    """Rows with ``head``, the least ordinal of their pack: a cell whose diagonal is at most ``km``, and a block of days, so that all rows of a pack are linked."""
    row, column = pack_cell("latitude", "longitude", km)
    rows = df.select(F.col(ordinal).alias("o"), "latitude", "longitude", F.col("acq_date"), day_number().alias("day"), row.alias("py"), column.alias("px"), F.floor(day_number() / (days + 1)).alias("pt"))
    heads = rows.where("latitude IS NOT NULL AND longitude IS NOT NULL AND day IS NOT NULL").groupBy("py", "px", "pt").agg(F.min("o").alias("head"))
    return rows.join(dealt(heads), ["py", "px", "pt"]).drop("py", "px", "pt")


def cluster(df: DataFrame, ordinal: str = "ord", km: float = C.CLUSTER_KM, days: int = C.CLUSTER_DAYS) -> DataFrame:
    """ord and cluster_root (least ord) of the detections of clusters of two and more.

    No list of all pairs is made: rows of one pack are linked as they are, packs are linked
    where their heads are near, and only packs that are still apart and may touch
    have their rows compared.
    """
    rows = cut(packed(df, ordinal, km, days))
    packs = cut(rows.groupBy("head").agg(
        F.count("*").alias("n"), F.min("latitude").alias("s"), F.max("latitude").alias("e_n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"), F.min("day").alias("d0"), F.max("day").alias("d1"),
        F.min_by(F.struct("latitude", "longitude", "acq_date"), "o").alias("at"),
    ))
    heads = packs.select(F.col("head").alias("o"), "at.*")
    label = lambda edges: packs.select("head").join(dealt(components(edges).withColumnRenamed("node", "head")), "head", "left").select("head", F.coalesce("label", "head").alias("label"))
    near = cut(spacetime_pairs(heads, "o", km, days).select("a", "b"))
    known = cut(packs.join(dealt(label(near)), "head"))
    # packs that hold a link have heads within three times its length, and boxes that nearly touch
    box = [F.col(c) for c in ("head", "label", "s", "e_n", "w", "e", "d0", "d1")]
    block = F.floor(F.col("d0") / (days + 1)).cast("int")
    left = known.select(*[c.alias(f"l_{n}") for c, n in zip(box, ("head", "label", "s", "n", "w", "e", "d0", "d1"))], F.col("at.latitude").alias("llat"), F.col("at.longitude").alias("llon"), block.alias("t"))
    right = known.select(*[c.alias(f"r_{n}") for c, n in zip(box, ("head", "label", "s", "n", "w", "e", "d0", "d1"))], F.col("at.latitude").alias("rlat"), F.col("at.longitude").alias("rlon"), F.explode(F.array(block - 1, block, block + 1)).alias("t"))
    gap = lambda a, b, c, d: F.greatest(F.col(c) - F.col(b), F.col(a) - F.col(d), F.lit(0.0))
    touch = (gap("l_s", "l_n", "r_s", "r_n") * KM_PER_DEGREE <= km * 1.001) & (gap("l_d0", "l_d1", "r_d0", "r_d1") <= days)
    apart = within(left, right, 3.01 * km, ("t",)).where((F.col("l_label") < F.col("r_label")) & touch).select("l_head", "l_label", "r_head", "r_label").distinct()
    side = lambda p: rows.select(F.col("head").alias(f"{p}_head"), F.col("latitude").alias(f"{p}lat"), F.col("longitude").alias(f"{p}lon"), F.col("day").alias(f"{p}day"))
    met = cut(apart).join(dealt(side("l")), "l_head").join(dealt(side("r")), "r_head").where(F.abs(F.col("lday") - F.col("rday")) <= days)
    late = cut(met.where(X.haversine_km("llat", "llon", "rlat", "rlon") <= km).select(F.col("l_label").alias("a"), F.col("r_label").alias("b")).distinct())
    final = known.select("head", "n", "label").join(dealt(components(late).select(F.col("node").alias("label"), F.col("label").alias("root"))), "label", "left").select("head", "n", F.coalesce("root", "label").alias("cluster_root"))
    large = final.groupBy("cluster_root").agg(F.sum("n").alias("size")).where("size > 1").select("cluster_root")
    return rows.select(F.col("o").alias(ordinal), "head").join(dealt(final.join(dealt(large), "cluster_root").select("head", "cluster_root")), "head").drop("head")


def exact_mean(x: str):
    """Mean that does not hang on the order of rows: sums of doubles do, and published places lie on ties of rounding."""
    return F.sum(F.col(x).cast("decimal(18,9)")).cast("double") / F.count(x)


def cluster_summary(df: DataFrame, members: DataFrame, ordinal: str = "ord") -> DataFrame:
    """One row per cluster, numbered by size, then least member."""
    rows = df.join(members, ordinal)
    out = rows.groupBy("cluster_root").agg(
        F.count("*").cast("int").alias("size"), X.half_even(exact_mean("latitude"), 5).alias("centroid_lat"), X.half_even(exact_mean("longitude"), 5).alias("centroid_lon"),
        F.min("acq_date").alias("first_seen"), F.max("acq_date").alias("last_seen"), F.count_distinct("acq_date").cast("int").alias("active_days"), X.half_even(F.max("frp"), 2).alias("max_frp"),
        X.half_even(F.avg("frp"), 2).alias("mean_frp"), F.mode("instrument", True).alias("main_instrument"), F.bool_or(F.col("daynight") == "N").alias("any_night"),
        F.max_by(F.col(ordinal), F.struct("frp", -F.col(ordinal))).alias("lead_ord"), F.array_join(F.array_sort(F.collect_set("source_sensor")), "|").alias("sensors"),
    )
    return before(out, [F.col("size").desc(), F.col("cluster_root")], "_n").withColumn("cluster_id", F.concat(F.lit("C"), F.col("_n") + 1)).drop("_n")


def cluster_report(scored: DataFrame, members: DataFrame, ordinal: str = "ord") -> DataFrame:
    """The published cluster table, the highest priority first: what :func:`cluster_summary` has of scored detections, and the place of the riskiest."""
    rows = scored.join(dealt(members), ordinal)
    top = F.max_by(F.struct("industrial_context", "facility_name", "facility_type", "facility_uid", "dist_to_industrial_km"), F.struct("risk_score", -F.col(ordinal)))
    out = rows.groupBy("cluster_root").agg(
        F.count("*").cast("int").alias("count"), F.min("acq_date").alias("first_date"), F.max("acq_date").alias("last_date"), X.half_even(F.max("frp"), 2).alias("max_frp"), X.half_even(exact_mean("frp"), 2).alias("avg_frp"),
        X.half_even(F.max("risk_score"), 3).alias("max_priority"), X.half_even(F.max("fusion_score"), 3).alias("max_fusion"), F.mode("label", True).alias("dominant_label"), F.mode("temp_class", True).alias("dominant_temp_class"),
        X.half_even(F.max("est_temp_k"), 1).alias("max_est_temp_k"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_remove(F.split("sources_confirming", "[|]"), ""))))), "|").alias("sources_confirming"),
        F.bool_or("new_source").alias("new_source"), top.alias("top"),
    )
    out = out.withColumns({"persistence_days": F.datediff("last_date", "first_date") + 1, "sources_confirming_count": F.when(F.col("sources_confirming") == "", 0).otherwise(F.size(F.split("sources_confirming", "[|]")))})
    numbered = before(out, [F.col("count").desc(), F.col("cluster_root")], "_n").withColumn("cluster_id", F.concat(F.lit("C"), F.col("_n") + 1))
    return numbered.withColumns({"nearest_facility_name": F.col("top.facility_name"), "nearest_facility_type": F.col("top.facility_type"), "facility_uid": F.col("top.facility_uid"), "industrial_context": F.col("top.industrial_context"), "dist_to_industrial_km": X.half_even("top.dist_to_industrial_km", 2)}).drop("_n", "top").orderBy(F.col("max_priority").desc(), "cluster_root")


def name_ratio(a: str, b: str):
    """Ratcliff-Obershelp similarity of two columns, which no expression states."""

    @F.pandas_udf("double")
    def ratio(x, y):
        from difflib import SequenceMatcher

        return x.combine(y, lambda s, t: SequenceMatcher(None, s, t).ratio())

    return ratio(a, b)


def alike(names: DataFrame) -> DataFrame:
    """Those of the distinct pairs (lname, rname) whose names are like enough; the order of the two counts."""
    same_ = F.col("lname") == F.col("rname")
    a, b = F.length("lname"), F.length("rname")
    near = ~same_ & (2 * F.least(a, b) / (a + b) >= C.NAME_SIMILARITY)  # no more can match than the shorter name holds
    return names.where(same_).unionByName(names.where(near).where(name_ratio("lname", "rname") >= C.NAME_SIMILARITY))


def site_labels(records: DataFrame, ordinal: str = "ord") -> DataFrame:
    """ord and label (least ord of the site) of the records that have a place.

    Records are of one site if they are near and of compatible classes, or a little farther with like
    names, and by chains of such. No list of all pairs is made: records of one class in a cell whose diagonal is the merging distance
    are a pack, packs are linked where their first places are near, and only packs that are still apart have
    their distinct places and names compared; likeness is told once of two names.
    """
    row, column = pack_cell("lat", "lon", C.MERGE_KM)
    placed = records.where("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)").select(F.col(ordinal).alias("o"), "lat", "lon", "ftype", X.normal_name("name").alias("name"))
    # records without a class are like no other without one
    own = F.coalesce(F.concat(F.lit("="), "ftype"), F.concat(F.lit("?"), "o"))
    rows = cut(placed.withColumn("pack", F.concat_ws(",", row, column, own)))
    packs = cut(rows.groupBy("pack").agg(F.min("o").alias("head"), F.min(F.struct("lat", "lon")).alias("at"), F.first("ftype").alias("ftype")).select("pack", "head", "at.lat", "at.lon", "ftype"))
    # an ord that several rows hold is one record
    shared = rows.groupBy("o").agg(F.min("pack").alias("a"), F.max("pack").alias("z")).where("a <> z").drop("z").join(rows.select("o", F.col("pack").alias("b")), "o").where("a <> b").select("a", "b")
    side = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    compatible = X.compatible(F.col("lftype"), F.col("rftype"))
    near = within(side(packs, "l"), side(packs, "r"), C.MERGE_KM).where((F.col("lpack") < F.col("rpack")) & compatible).select(F.col("lpack").alias("a"), F.col("rpack").alias("b"))
    named = components(near.unionByName(shared), few=FEW_LINKS).withColumnRenamed("node", "pack")
    known = cut(packs.join(named, "pack", "left").withColumn("label", F.coalesce("label", "pack")))
    # a record is at most the merging distance away from its pack's first place
    apart = within(side(known.drop("head"), "l"), side(known.drop("head"), "r"), (C.NAME_MERGE_KM + 2 * C.MERGE_KM) * 1.001).where((F.col("llabel") != F.col("rlabel")) & compatible)
    apart = cut(apart.select("lpack", "llabel", "rpack", "rlabel", "km"))
    places = rows.select("pack", "lat", "lon").distinct()
    touch = apart.where((F.col("km") <= 3.001 * C.MERGE_KM) & (F.col("lpack") < F.col("rpack"))).drop("km").join(side(places, "l"), "lpack").join(side(places, "r"), "rpack")
    touch = touch.where(X.haversine_km("llat", "llon", "rlat", "rlon") <= C.MERGE_KM).select(F.col("llabel").alias("a"), F.col("rlabel").alias("b"))
    # of the records of one name and place, a pair in the order of ords exists if the least comes before the greatest
    held = cut(rows.where("name <> ''").join(apart.select(F.col("lpack").alias("pack")).distinct(), "pack", "left_semi").groupBy("pack", "name", "lat", "lon").agg(F.min("o").alias("lo"), F.max("o").alias("hi")))
    names = held.select("pack", "name").distinct()
    met = cut(apart.drop("km").join(side(names, "l"), "lpack").join(side(names, "r"), "rpack"))
    like = met.join(alike(met.select("lname", "rname").distinct()), ["lname", "rname"])
    far = like.join(side(held, "l"), ["lpack", "lname"]).join(side(held, "r"), ["rpack", "rname"]).where((F.col("llo") < F.col("rhi")) & (X.haversine_km("llat", "llon", "rlat", "rlon") <= C.NAME_MERGE_KM))
    late = components(touch.unionByName(far.select(F.col("llabel").alias("a"), F.col("rlabel").alias("b"))).distinct(), few=FEW_LINKS)
    final = cut(known.select("pack", "head", "label").join(late.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left").select("pack", "head", F.coalesce("root", "label").alias("root")))
    least = final.groupBy("root").agg(F.min("head").alias("label"))
    return rows.select("o", "pack").join(final.select("pack", "root").join(least, "root"), "pack").select(F.col("o").alias(ordinal), "label").distinct()


def assign_sites(records: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Records with facility_uid: F and the rank of the component's least record."""
    named = cut(site_labels(records, ordinal))
    labelled = lambda df: df.join(named, ordinal, "left").withColumn("label", F.coalesce("label", ordinal))
    out = labelled(records.drop("facility_uid"))
    ranks = before(labelled(records.select(ordinal)).select("label").distinct(), [F.col("label")], "_n").select("label", F.format_string("F%05d", "_n").alias("facility_uid"))
    return out.join(ranks, "label").drop("label")


def site_groups(records: DataFrame, key: str = "facility_uid", ordinal: str = "ord") -> DataFrame:
    """One row per site: the most specific class, a curated name if any, operating if any record is."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, X.FTYPE_RANK)), F.col("ftype")), F.lit(99))
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    mw = F.when(F.col("capacity_unit") == "MW", F.col("capacity_value"))
    tt = F.when(F.col("capacity_unit") == "ttpa", F.col("capacity_value"))
    place = F.coalesce("subnational", F.lit("")) if "subnational" in records.columns else F.lit("")
    place = F.when(F.trim(place) != "", place).otherwise("")
    out = records.withColumns({"_rank": rank, "_named": named, "_place": place}).groupBy(key).agg(
        F.min_by("ftype", F.struct("_rank", ordinal)).alias("ftype"), F.min_by(F.when(F.col("_named"), F.col("name")), F.when(F.col("_named"), F.struct((F.col("source") == "osm").alias("o"), F.col(ordinal).alias("i")))).alias("name"),
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources_present"), F.count_distinct("source").cast("int").alias("source_agreement"),
        F.when(F.bool_or(F.col("status") == "operating"), "operating").otherwise(F.min_by("status", ordinal)).alias("status"), F.sum(mw).alias("_mw"), F.max(tt).alias("_tt"), F.count("*").cast("int").alias("record_count"),
        F.coalesce(F.min_by(F.when(F.col("_place") != "", F.col("_place")), F.when(F.col("_place") != "", F.col(ordinal))), F.lit("")).alias("subnational"),
    )
    return out.withColumns({
        "name": F.coalesce("name", F.lit("")), "capacity_value": F.coalesce("_mw", "_tt"), "capacity_unit": F.when(F.col("_mw").isNotNull(), "MW").when(F.col("_tt").isNotNull(), "ttpa").otherwise(""),
    }).drop("_mw", "_tt")


def overlap(records: DataFrame, key: str = "facility_uid") -> DataFrame:
    """Of each registry: records, sites, and sites that another registry confirms."""
    agree = records.groupBy(key).agg(F.count_distinct("source").alias("k"))
    return records.join(agree, key).groupBy("source").agg(F.count("*").cast("long").alias("records"), F.count_distinct(key).cast("long").alias("sites"), F.count_distinct(F.when(F.col("k") > 1, F.col(key))).cast("long").alias("confirmed_by_other"))


def shared_pairs(records: DataFrame, key: str = "facility_uid") -> DataFrame:
    """Of each two registries: sites that both list."""
    held = records.select(key, F.col("source").alias("a")).distinct()
    each = source_pairs(records)
    met = held.join(held.select(key, F.col("a").alias("b")), key).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("sites"))
    return each.join(met, ["a", "b"], "left").select(F.concat("a", F.lit("+"), "b").alias("pair"), F.coalesce("sites", F.lit(0)).cast("long").alias("sites"))


def source_pairs(df: DataFrame) -> DataFrame:
    rows = [(a, b) for i, a in enumerate(C.SOURCES) for b in C.SOURCES[i + 1 :]]
    return df.sparkSession.createDataFrame(rows, "a string, b string")


def totals(records: DataFrame, key: str = "facility_uid") -> DataFrame:
    """total_records, total_sites and multi_source_sites."""
    sites = records.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("source").alias("k"))
    return sites.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.count("*").alias("total_sites"), F.count_if(F.col("k") > 1).alias("multi_source_sites"))


def of_sources(records: DataFrame, groups: DataFrame, sources: list[str], key: str = "facility_uid") -> tuple[DataFrame, DataFrame]:
    """Records of the named registries, and the sites that hold any."""
    kept = records.where(F.col("source").isin(*sources))
    return kept, groups.join(kept.select(key).distinct(), key, "left_semi")
