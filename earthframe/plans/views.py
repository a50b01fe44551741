"""The driver tables seen as Earth-observation data.

Each view exists twice: as a DataFrame here and as SQL for the checks. Views are plain
projections of one table (plus the aggregation a unique pixel key needs), so their size and
their skew are those of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earthframe.functions import bands as B
from earthframe.plans.registry import sql_view, table

sql_view("pixels", """
SELECT l_suppkey AS scene_id, l_orderkey AS "row", l_partkey * 8 + l_linenumber AS col,
       l_quantity AS green, round(l_discount * 100) AS nir, round(l_tax * 100) AS red,
       CAST(l_linenumber AS DOUBLE) AS swir16, l_quantity <> 1.0 AS green_valid,
       CASE WHEN l_returnflag <> 'R' THEN CAST(l_partkey % 13 AS INTEGER) END AS scl
FROM lineitem
""")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Optical pixels, one per line item; green declares nodata 1, returned lines no class."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"),
        F.col("l_orderkey").alias("row"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("col"),
        F.col("l_quantity").alias("green"),
        F.round(F.col("l_discount") * 100).alias("nir"),
        F.round(F.col("l_tax") * 100).alias("red"),
        F.col("l_linenumber").cast("double").alias("swir16"),
        B.band_valid(F.col("l_quantity"), F.lit(1.0)).alias("green_valid"),
        F.when(F.col("l_returnflag") != "R", (F.col("l_partkey") % 13).cast("int")).alias("scl"),
    )


# DuckDB text of the index of a pair, NULL where undefined.
def sql_index(high: str, low: str, valid: str = "TRUE") -> str:
    return (f"CASE WHEN {valid} AND {high} + {low} <> 0 "
            f"THEN ({high} - {low}) / ({high} + {low}) END")


SQL_NDWI = sql_index("green", "nir", "green_valid")
SQL_NDVI = sql_index("nir", "red")
SQL_NDBI = sql_index("swir16", "nir")
SQL_CATEGORY = """
CASE WHEN NOT (green_valid AND green + nir <> 0) OR scl IS NULL OR scl = 0 THEN 'nodata'
     WHEN scl = 1 THEN 'saturated_or_defective' WHEN scl IN (8, 9, 10) THEN 'cloud'
     WHEN scl = 3 THEN 'cloud_shadow' WHEN scl = 11 THEN 'snow'
     WHEN scl IN (2, 7) THEN 'other_masked' WHEN scl IN (4, 5, 6) THEN 'usable'
     ELSE 'unknown_class' END
"""
sql_view("graded", f"""
SELECT scene_id, "row", col, category,
       CASE WHEN category = 'usable' THEN v END AS ndwi
FROM (SELECT *, {SQL_CATEGORY} AS category, {SQL_NDWI} AS v FROM pixels)
""")

sql_view("fine_cells", """
SELECT scene_id, "row", col // 8 AS col, min(green) AS green, min(nir) AS nir
FROM pixels GROUP BY ALL
""")


def fine_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels on a unique (scene, row, col) key, as joins between grids need."""
    return (
        pixels(spark, sf)
        .groupBy("scene_id", "row", F.floor(F.col("col") / 8).cast("bigint").alias("col"))
        .agg(F.min("green").alias("green"), F.min("nir").alias("nir"))
    )


sql_view("coarse_cells", """
SELECT l_suppkey AS scene_id, l_orderkey // 2 AS "row", l_partkey // 2 AS col,
       min(CAST(l_linenumber AS DOUBLE)) AS swir16, CAST(min(l_partkey % 13) AS INTEGER) AS scl,
       max(l_quantity) > 2 AS valid
FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL
""")


def coarse_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A raster at half the resolution that covers only the finished lines."""
    return (
        table(spark, sf, "lineitem").where(F.col("l_linestatus") == "F")
        .groupBy(
            F.col("l_suppkey").alias("scene_id"),
            F.floor(F.col("l_orderkey") / 2).cast("bigint").alias("row"),
            F.floor(F.col("l_partkey") / 2).cast("bigint").alias("col"),
        )
        .agg(F.min(F.col("l_linenumber").cast("double")).alias("swir16"),
             F.min(F.col("l_partkey") % 13).cast("int").alias("scl"),
             (F.max("l_quantity") > 2).alias("valid"))
    )


sql_view("pixels_sar", """
SELECT l_suppkey AS scene_id, l_orderkey AS "row", l_partkey * 8 + l_linenumber AS col,
       l_discount AS vv, l_tax - 0.01 AS vh, l_returnflag <> 'R' AS vv_valid,
       l_linenumber <> 1 AS vh_valid
FROM lineitem
""")


def pixels_sar(spark: SparkSession, sf: str) -> DataFrame:
    """Radar pixels in linear power; zeros and negatives occur and must be excluded."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"), F.col("l_orderkey").alias("row"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("col"),
        F.col("l_discount").alias("vv"), (F.col("l_tax") - 0.01).alias("vh"),
        (F.col("l_returnflag") != "R").alias("vv_valid"),
        (F.col("l_linenumber") != 1).alias("vh_valid"),
    )


sql_view("dated_cells", f"""
SELECT scene_id, "row", col, late, {SQL_NDWI} AS ndwi FROM (
  SELECT l_suppkey AS scene_id, l_partkey AS "row", l_linenumber AS col,
         l_shipdate >= TIMESTAMP '1998-07-01' AS late,
         min(l_quantity) AS green, min(round(l_discount * 100)) AS nir,
         min(l_quantity) <> 1.0 AS green_valid
  FROM lineitem GROUP BY ALL)
""")


def dated_cells(spark: SparkSession, sf: str) -> DataFrame:
    """One index value per cell and half of the archive (``late`` false / true)."""
    from earthframe.operators.pixels import with_index

    cells = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_suppkey").alias("scene_id"), F.col("l_partkey").alias("row"),
            F.col("l_linenumber").alias("col"),
            (F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).alias("late"),
        )
        .agg(F.min("l_quantity").alias("green"),
             F.min(F.round(F.col("l_discount") * 100)).alias("nir"))
        .withColumn("green_valid", B.band_valid(F.col("green"), F.lit(1.0)))
    )
    return with_index(cells, "ndwi").select("scene_id", "row", "col", "late", "ndwi")


sql_view("grid_pairs", """
SELECT case_id, CASE WHEN k = 1 THEN NULL ELSE 'EPSG:32644' END AS crs1,
       CASE WHEN k = 2 THEN 'EPSG:32645' WHEN k = 3 THEN ' epsg:32644 ' ELSE 'EPSG:32644' END AS crs2,
       ratio * 10.0 AS a1, 10.0 AS a2, CASE WHEN k = 4 THEN 0.5 ELSE 0.0 END AS b1,
       399960.0 + CASE WHEN k = 5 THEN 5.0 WHEN k = 6 THEN 0.000001 WHEN k = 7 THEN 10.0
                       WHEN k = 8 THEN 9000000.0 ELSE 0.0 END AS c1,
       399960.0 AS c2, CASE WHEN k = 9 THEN 10.0 * ratio WHEN k = 10 THEN -15.0 ELSE -10.0 * ratio END AS e1,
       -10.0 AS e2, 1500000.0 AS f1, 1500000.0 + CASE WHEN k = 11 THEN 20.0 ELSE 0.0 END AS f2,
       100 + size AS width1, 100 AS height1, 100 + size AS width2,
       CASE WHEN k = 12 THEN 101 ELSE 100 END AS height2
FROM (SELECT p_partkey AS case_id, p_partkey % 17 AS k, p_size AS size,
             CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 2.0 ELSE 1.0 END AS ratio FROM part)
""")


def grid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of grids, most of them broken in one known way, from the parts table."""
    k, n = F.col("k"), F.lit
    base = table(spark, sf, "part").select(
        F.col("p_partkey").alias("case_id"), (F.col("p_partkey") % 17).alias("k"),
        F.col("p_size").alias("size"),
        F.when(F.col("p_type").isin("ECONOMY", "PROMO"), 2.0).otherwise(1.0).alias("ratio"),
    )
    shift = F.when(k == 5, 5.0).when(k == 6, 0.000001).when(k == 7, 10.0).when(
        k == 8, 9000000.0).otherwise(0.0)
    step = F.when(k == 9, 10.0 * F.col("ratio")).when(k == 10, -15.0).otherwise(
        -10.0 * F.col("ratio"))
    first = F.struct(
        F.when(k != 1, "EPSG:32644").alias("crs"), (F.col("ratio") * 10.0).alias("a"),
        F.when(k == 4, 0.5).otherwise(0.0).alias("b"), (n(399960.0) + shift).alias("c"),
        n(0.0).alias("d"), step.alias("e"), n(1500000.0).alias("f"),
        (F.col("size") + 100).alias("width"), n(100).alias("height"),
    )
    second = F.struct(
        F.when(k == 2, "EPSG:32645").when(k == 3, " epsg:32644 ").otherwise("EPSG:32644")
        .alias("crs"),
        n(10.0).alias("a"), n(0.0).alias("b"), n(399960.0).alias("c"), n(0.0).alias("d"),
        n(-10.0).alias("e"), (n(1500000.0) + F.when(k == 11, 20.0).otherwise(0.0)).alias("f"),
        (F.col("size") + 100).alias("width"),
        F.when(k == 12, 101).otherwise(100).alias("height"),
    )
    return base.select("case_id", first.alias("g1"), second.alias("g2"))


# --------------------------------------------------------------------------- #
# Catalog
# --------------------------------------------------------------------------- #

sql_view("scenes", """
SELECT 'scene-' || o_orderkey AS id, o_orderkey AS num,
       CASE WHEN o_orderkey % 37 <> 0 THEN
         strftime(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)), '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Z' END END AS datetime,
       CASE WHEN o_orderkey % 37 <> 0 THEN CAST(o_orderdate AS DATE) END AS acquired_date,
       CASE WHEN o_orderstatus = 'P' THEN 'sentinel-1-rtc' ELSE 'sentinel-2-l2a' END AS collection,
       CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice % 100) END AS cloud_cover,
       CASE WHEN o_orderkey % 17 <> 0 THEN -171.0e0 + c_nationkey * 13 + CAST(o_orderkey % 120 AS DOUBLE) / 10 END AS west,
       CASE WHEN o_orderkey % 17 <> 0 THEN -60.0e0 + c_nationkey * 4 + CAST(o_orderkey % 7 AS DOUBLE) / 10 END AS south,
       CASE WHEN o_orderkey % 17 <> 0 THEN -170.0e0 + c_nationkey * 13 + CAST(o_orderkey % 120 AS DOUBLE) / 10 END AS east,
       CASE WHEN o_orderkey % 17 <> 0 THEN -58.0e0 + c_nationkey * 4 + CAST(o_orderkey % 7 AS DOUBLE) / 10 END AS north,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'RTC' ELSE 'L2A' END AS processing_level
FROM orders JOIN customer ON o_custkey = c_custkey
""")


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog scenes, one per order; times, cloud and footprints are sometimes unknown."""
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
        F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    moment = F.timestamp_add("HOUR", (key % 24).cast("int"), F.col("o_orderdate"))
    text = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(key % 13 == 0, "").otherwise("Z"))

    def edge(base: float, step: int, spread: int) -> object:
        return F.when(key % 17 != 0, F.lit(base) + F.col("c_nationkey") * step
                      + (key % spread).cast("double") / 10)

    return o.select(
        F.concat(F.lit("scene-"), key.cast("string")).alias("id"), key.alias("num"),
        F.when(key % 37 != 0, text).alias("datetime"),
        F.when(key % 37 != 0, F.col("o_orderdate").cast("date")).alias("acquired_date"),
        F.when(F.col("o_orderstatus") == "P", "sentinel-1-rtc").otherwise("sentinel-2-l2a")
        .alias("collection"),
        F.when(key % 11 != 0, F.floor(F.col("o_totalprice") % 100).cast("double"))
        .alias("cloud_cover"),
        edge(-171.0, 13, 120).alias("west"), edge(-60.0, 4, 7).alias("south"),
        edge(-170.0, 13, 120).alias("east"), edge(-58.0, 4, 7).alias("north"),
        F.when(key % 19 == 0, None).when(F.col("o_orderstatus") == "P", "RTC").otherwise("L2A")
        .alias("processing_level"),
    )


sql_view("requests", """
SELECT c_custkey AS request_id, 'Place ' || c_nationkey AS location,
       CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'single'
            WHEN c_mktsegment = 'MACHINERY' THEN 'compare' ELSE 'timeseries' END AS mode,
       CASE c_custkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'optical' ELSE 'sar' END AS families,
       DATE '1995-01-01' + CAST(c_custkey * 37 % 2200 AS INTEGER) AS base,
       -171.0e0 + c_nationkey * 13 + c_custkey % 12 AS aoi_west, -59.5e0 + c_nationkey * 4 AS aoi_south,
       -170.0e0 + c_nationkey * 13 + c_custkey % 12 AS aoi_east, -58.5e0 + c_nationkey * 4 AS aoi_north
FROM customer
""")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis requests, one per customer: area, mode, modalities and time windows."""
    c = table(spark, sf, "customer")
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    mode = F.when(seg.isin("BUILDING", "FURNITURE"), "single").when(
        seg == "MACHINERY", "compare").otherwise("timeseries")
    base = F.date_add(F.lit("1995-01-01").cast("date"), (key * 37 % 2200).cast("int"))

    def window(days: int) -> object:
        return F.struct(F.date_add(base, days).alias("start_date"),
                        F.date_add(base, days + 29).alias("end_date"))

    windows = (
        F.when(mode == "single", F.array(window(0)))
        .when((mode == "compare") & (key % 2 == 0), F.array(window(60), window(0)))
        .when(mode == "compare", F.array(window(0), window(60)))
        .otherwise(F.array(window(0), window(60), window(120)))
    )
    both = F.array(F.lit("sentinel-2-optical"), F.lit("sentinel-1-sar"))
    modalities = F.when(key % 3 == 0, both).when(key % 3 == 1, F.slice(both, 1, 1)).otherwise(
        F.slice(both, 2, 1))
    west = F.lit(-171.0) + F.col("c_nationkey") * 13 + key % 12
    return c.select(
        key.alias("request_id"),
        F.concat(F.lit("Place "), F.col("c_nationkey").cast("string")).alias("location"),
        mode.alias("mode"), modalities.alias("modalities"), windows.alias("windows"),
        west.alias("aoi_west"), (F.lit(-59.5) + F.col("c_nationkey") * 4).alias("aoi_south"),
        (F.lit(-170.0) + F.col("c_nationkey") * 13 + key % 12).alias("aoi_east"),
        (F.lit(-58.5) + F.col("c_nationkey") * 4).alias("aoi_north"),
    )


sql_view("windows", """
SELECT request_id, location, aoi_west, aoi_south, aoi_east, aoi_north, modality,
       CASE WHEN mode = 'single' THEN 'single' WHEN mode = 'compare' AND i = 0 THEN 'baseline'
            WHEN mode = 'compare' THEN 'target' ELSE 'series[' || i || ']' END AS label,
       base + offset_days AS start_date, base + offset_days + 29 AS end_date,
       CASE WHEN families = 'both' AND modality = 'sentinel-1-sar' THEN 24 ELSE 0 END + i AS pos
FROM (SELECT r.*, i, modality,
        CASE WHEN mode = 'compare' AND request_id % 2 = 0 THEN 60 - 60 * i ELSE 60 * i END AS offset_days
      FROM requests r, (VALUES (0), (1), (2)) v(i), (VALUES ('sentinel-2-optical'), ('sentinel-1-sar')) m(modality)
      WHERE i < CASE mode WHEN 'single' THEN 1 WHEN 'compare' THEN 2 ELSE 3 END
        AND (families = 'both' OR (families = 'optical') = (modality = 'sentinel-2-optical')))
""")


def windows(spark: SparkSession, sf: str) -> DataFrame:
    from earthframe.operators.catalog import expand_windows

    return expand_windows(requests(spark, sf))


sql_view("discovered", """
SELECT w.*, s.id, s.datetime, s.acquired_date, s.cloud_cover, s.collection, s.processing_level, s.west, s.south, s.east, s.north
FROM windows w JOIN scenes s
  ON s.collection = CASE w.modality WHEN 'sentinel-2-optical' THEN 'sentinel-2-l2a' ELSE 'sentinel-1-rtc' END
 AND s.acquired_date BETWEEN w.start_date AND w.end_date
 AND (s.west IS NULL OR NOT (aoi_east < west OR aoi_west > east OR aoi_north < south OR aoi_south > north))
""")

sql_view("paged", """
SELECT * FROM discovered
QUALIFY row_number() OVER (PARTITION BY request_id, modality, label ORDER BY id) <= 10
""")

sql_view("chosen", """
SELECT * FROM paged
QUALIFY row_number() OVER (PARTITION BY request_id, modality, label ORDER BY
  CASE WHEN modality = 'sentinel-2-optical' THEN cloud_cover END ASC NULLS LAST,
  datetime ASC NULLS LAST, id) = 1
""")

sql_view("executed", """
SELECT w.*, coalesce(m.n, 0) AS scenes_matched, coalesce(p.n, 0) AS scene_count, c.id AS selected_scene_id,
       c.id, c.datetime, c.cloud_cover, c.collection, c.processing_level, c.west, c.south, c.east, c.north,
       CASE WHEN c.id IS NOT NULL AND w.request_id % 7 <> 0 THEN c.id END AS imagery_scene_id,
       CASE WHEN c.id IS NOT NULL AND w.request_id % 7 = 0 THEN 'read timed out' END AS imagery_error,
       CASE WHEN c.id IS NULL AND w.request_id % 2 = 0 THEN 'catalog did not answer' END AS error,
       CASE WHEN c.id IS NULL AND w.request_id % 2 = 0 THEN NULL
            WHEN w.modality = 'sentinel-2-optical' THEN 'earth-search' ELSE 'planetary-computer' END AS catalog
FROM windows w
LEFT JOIN (SELECT request_id, modality, label, count(*) AS n FROM discovered GROUP BY ALL) m USING (request_id, modality, label)
LEFT JOIN (SELECT request_id, modality, label, count(*) AS n FROM paged GROUP BY ALL) p USING (request_id, modality, label)
LEFT JOIN chosen c USING (request_id, modality, label)
""")


def executed(spark: SparkSession, sf: str) -> DataFrame:
    """Executed windows; some without a scene count as failed, some images as unreadable."""
    from earthframe.operators.catalog import execute

    run = execute(windows(spark, sf), scenes(spark, sf))
    found, rid = F.col("selected_scene_id").isNotNull(), F.col("request_id")
    failed = ~found & (rid % 2 == 0)
    return (
        run.withColumn("imagery_scene_id", F.when(found & (rid % 7 != 0), F.col("selected_scene_id")))
        .withColumn("imagery_error", F.when(found & (rid % 7 == 0), "read timed out"))
        .withColumn("error", F.when(failed, "catalog did not answer"))
        .withColumn("catalog", F.when(failed, None).when(
            F.col("modality") == "sentinel-2-optical", "earth-search").otherwise("planetary-computer"))
    )
