"""Detection and facility views over the driver's tables; the SQL is the same in Spark and DuckDB.

Names of facilities are digests, so that two of them are either equal or far from alike: the
rule that merges records of like names can then be told in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DETECTIONS = """
SELECT event_id AS ord, user_id,
 CAST(2000000 + CAST((user_id % 15 - user_id % 3) / 3 AS BIGINT) * 60000 + (user_id % 3) * 1900 + (event_id % 5) * 100 AS DOUBLE) / 100000 AS latitude,
 CAST(7500000 + CAST((user_id - user_id % 15) / 15 AS BIGINT) * 30000 + (event_id % 7) * 50 AS DOUBLE) / 100000 AS longitude,
 CAST(ts AS DATE) AS acq_date,
 CAST(hour(ts) * 100 + minute(ts) AS INT) AS acq_time,
 CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'D' ELSE 'N' END AS daynight,
 CASE WHEN event_id % 10 = 0 THEN 'MODIS' ELSE 'VIIRS' END AS instrument,
 CASE WHEN event_id % 10 = 0 THEN 'MODIS_NRT' WHEN event_id % 3 = 0 THEN 'VIIRS_SNPP_SP'
      WHEN event_id % 3 = 1 THEN 'VIIRS_NOAA20_SP' ELSE 'VIIRS_NOAA21_NRT' END AS source_sensor,
 CASE WHEN event_id % 10 = 0 THEN CAST(event_id * 7 % 101 AS STRING) WHEN event_id % 8 = 1 THEN 'l'
      WHEN event_id % 3 = 1 THEN 'h' ELSE 'n' END AS confidence,
 value / 10 AS frp,
 CAST(3100 + event_id * 31 % 570 AS DOUBLE) / 10 AS bt4,
 CAST(2850 + event_id * 17 % 200 AS DOUBLE) / 10 AS bt5,
 CAST(375 + (event_id % 5) * 100 AS DOUBLE) / 1000 AS scan,
 CAST(375 + (event_id % 3) * 100 AS DOUBLE) / 1000 AS track
FROM events
"""

FACILITIES = """
SELECT 'gem' AS source, CAST(s_suppkey AS STRING) AS source_id, CONCAT('Gem ', substr(md5(CAST(s_suppkey % 9 AS STRING)), 1, 16)) AS name,
 CASE WHEN s_nationkey % 2 = 0 THEN 'steel' ELSE 'power_plant' END AS ftype,
 CAST(2000000 + (s_suppkey % 5) * 60000 + (s_suppkey % 4) * 700 AS DOUBLE) / 100000 AS lat,
 CAST(7500000 + CAST((s_suppkey - s_suppkey % 5) / 5 AS BIGINT) % 10 * 30000 + (s_suppkey % 6) * 400 AS DOUBLE) / 100000 AS lon,
 s_acctbal AS capacity_value, CASE WHEN s_suppkey % 2 = 0 THEN 'MW' ELSE 'ttpa' END AS capacity_unit,
 CASE WHEN s_suppkey % 3 = 0 THEN 'operating' ELSE 'announced' END AS status, CASE WHEN s_suppkey % 4 = 0 THEN 'Odisha' ELSE '' END AS subnational FROM supplier WHERE s_suppkey % 5 < 3
UNION ALL SELECT 'wri', CAST(p_partkey AS STRING), CONCAT('Wri ', substr(md5(CAST(p_partkey % 31 AS STRING)), 3, 16)), 'power_plant',
 CAST(2000000 + p_partkey % 11 * 30000 + p_partkey % 13 * 300 AS DOUBLE) / 100000,
 CAST(7500000 + p_partkey % 17 * 15000 + p_partkey % 7 * 250 AS DOUBLE) / 100000,
 p_retailprice, 'MW', 'operating', '' FROM part WHERE p_partkey % 11 < 6 AND p_partkey % 4 = 0
UNION ALL SELECT 'osm', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CONCAT('Osm ', substr(md5(CAST(c_custkey % 23 AS STRING)), 5, 16)) END,
 CASE WHEN c_custkey % 5 = 0 THEN 'works' ELSE 'industrial_area' END,
 CAST(2000000 + c_custkey % 23 * 15000 + c_custkey % 9 * 500 AS DOUBLE) / 100000,
 CAST(7500000 + c_custkey % 29 * 15000 + c_custkey % 8 * 350 AS DOUBLE) / 100000,
 CAST(NULL AS DOUBLE), '', 'unknown', CASE WHEN c_custkey % 3 = 0 THEN 'Bihar' ELSE ' ' END FROM customer WHERE c_custkey % 23 < 12
"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """``sql`` over the named tables of ``sf_dir``."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **frames)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DETECTIONS, "events")


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FACILITIES, "supplier", "part", "customer")
