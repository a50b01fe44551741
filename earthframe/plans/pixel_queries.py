"""Registered queries over optical, radar and dated pixels and their grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from earthframe.functions import bands as B
from earthframe.functions import grids as G
from earthframe.operators import pixels as P
from earthframe.operators import sar as S
from earthframe.plans import views as V
from earthframe.plans.registry import query
from earthframe.plans.views import SQL_NDBI, SQL_NDVI, SQL_NDWI

KEY = ["scene_id", "row", "col"]


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _metrics_sql(source: str, parts: list[tuple[str, str, str]]) -> str:
    """UNION of one row per (expression, name, unit) over a per-scene aggregate."""
    return "\nUNION ALL\n".join(
        f"SELECT scene_id, '{name}' AS name, round(CAST({expr} AS DOUBLE), 6) AS value, "
        f"'{unit}' AS unit FROM {source} WHERE ({expr}) IS NOT NULL"
        for expr, name, unit in parts
    )


def _index_parts(key: str) -> list[tuple[str, str, str]]:
    return [
        (f"{key}_n", f"{key}_valid_pixel_count", "pixels"), (f"{key}_avg", f"{key}_mean", "index"),
        (f"{key}_lo", f"{key}_min", "index"), (f"{key}_hi", f"{key}_max", "index"),
    ]


def _index_aggs(key: str) -> str:
    return (f"count({key}) AS {key}_n, avg({key}) AS {key}_avg, "
            f"min({key}) AS {key}_lo, max({key}) AS {key}_hi")


_ABOVE = ("ndwi_above * 100.0 / nullif(ndwi_n, 0)",
          "ndwi_percent_above_index_threshold_0.3", "%")


@query("masked_index_statistics", f"""
WITH agg AS (SELECT scene_id, {_index_aggs('ndwi')},
             count(*) FILTER (WHERE ndwi > 0.3) AS ndwi_above FROM graded GROUP BY scene_id)
{_metrics_sql('agg', [*_index_parts('ndwi'), _ABOVE])}
""")
def masked_index_statistics(spark, sf):
    """Slice 0: quality mask, NDWI, statistics and share above the threshold per scene."""
    masked = P.mask_with_scl(V.pixels(spark, sf), "ndwi")
    return rounded(P.index_statistics(masked, ["scene_id"], ["ndwi"]), "value")


@query("a1_a2_index_statistics", f"""
WITH idx AS (SELECT scene_id, {SQL_NDWI} AS ndwi, {SQL_NDVI} AS ndvi, {SQL_NDBI} AS ndbi FROM pixels),
agg AS (SELECT scene_id, {_index_aggs('ndwi')}, {_index_aggs('ndvi')}, {_index_aggs('ndbi')},
        count(*) FILTER (WHERE ndwi > 0.3) AS ndwi_above FROM idx GROUP BY scene_id)
{_metrics_sql('agg', [*_index_parts('ndwi'), _ABOVE, *_index_parts('ndvi'), *_index_parts('ndbi')])}
""")
def index_statistics(spark, sf):
    keys = ["ndwi", "ndvi", "ndbi"]
    px = V.pixels(spark, sf).select(
        "scene_id", *B.bands_for(keys), "green_valid"
    )
    for key in keys:
        px = P.with_index(px, key)
    return rounded(P.index_statistics(px, ["scene_id"], keys), "value")


@query("p1_p2_pair_validity", """
SELECT scene_id, count(*) AS pixels, count(*) FILTER (WHERE green_valid) AS green_valid_pixels,
       count(*) FILTER (WHERE nir + red <> 0) AS pair_valid_pixels,
       count(*) FILTER (WHERE nir = red AND nir + red <> 0) AS zero_numerator_pixels
FROM pixels GROUP BY scene_id
""")
def pair_validity(spark, sf):
    px = V.pixels(spark, sf)
    ok = B.pair_valid(F.col("nir"), F.col("red"), B.band_valid(F.col("nir")),
                      B.band_valid(F.col("red")))
    return px.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if("green_valid").alias("green_valid_pixels"),
        F.count_if(ok).alias("pair_valid_pixels"),
        F.count_if(ok & (F.col("nir") == F.col("red"))).alias("zero_numerator_pixels"),
    )


@query("p3_normalized_difference", f"""
SELECT scene_id, "row", col, round({SQL_NDVI}, 6) AS ndvi, round({SQL_NDBI}, 6) AS ndbi FROM pixels
""")
def normalized_difference(spark, sf):
    px = P.with_index(P.with_index(V.pixels(spark, sf), "ndvi"), "ndbi")
    return rounded(px.select(*KEY, "ndvi", "ndbi"), "ndvi", "ndbi")


@query("p4_multi_index_bands", """
SELECT scene_id, sum(nir) AS nir_sum, sum(red) AS red_sum, sum(swir16) AS swir16_sum
FROM pixels GROUP BY scene_id
""")
def multi_index_bands(spark, sf):
    """Only the distinct bands of the asked indices leave the scan."""
    bands = B.bands_for(["ndvi", "ndbi"])
    px = V.pixels(spark, sf).select("scene_id", *bands)
    return px.groupBy("scene_id").agg(*[F.sum(b).alias(f"{b}_sum") for b in bands])


@query("p5_a3_threshold_statistics", """
SELECT scene_id, count(*) FILTER (WHERE ndwi >= 0.5) AS matching_pixel_count,
       count(ndwi) AS valid_pixel_count,
       round(count(*) FILTER (WHERE ndwi >= 0.5) * 100.0 / count(ndwi), 6) AS percentage
FROM graded GROUP BY scene_id HAVING count(ndwi) > 0
""")
def threshold_statistics(spark, sf):
    masked = P.mask_with_scl(V.pixels(spark, sf), "ndwi")
    return rounded(
        P.threshold_statistics(masked, ["scene_id"], "ndwi", "gte", 0.5), "percentage")


_COMPARE_SQL = "\nUNION ALL\n".join(
    f"SELECT scene_id, '{op}' AS operator, count(*) FILTER (WHERE ndvi {sym} 0.25) AS matching, "
    f"count(ndvi) AS valid FROM (SELECT scene_id, {SQL_NDVI} AS ndvi FROM pixels) "
    "GROUP BY scene_id"
    for op, sym in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<="))
)


@query("p5_exact_comparison", _COMPARE_SQL)
def exact_comparison(spark, sf):
    px = P.with_index(V.pixels(spark, sf).select("scene_id", "nir", "red"), "ndvi")
    ops = ("gt", "gte", "lt", "lte")
    wide = px.groupBy("scene_id").agg(
        F.count("ndvi").alias("valid"),
        *[F.count_if(B.compare(F.col("ndvi"), op, 0.25)).alias(op) for op in ops],
    )
    return wide.unpivot(["scene_id", "valid"], list(ops), "operator", "matching")


@query("p9_p10_quality_mask", """
SELECT scene_id, "row", col, category, round(ndwi, 6) AS ndwi FROM graded
""")
def quality_mask(spark, sf):
    masked = P.mask_with_scl(V.pixels(spark, sf), "ndwi")
    return rounded(masked.select(*KEY, "category", "ndwi"), "ndwi")


_QUALITY_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE category = '{c}') AS {c}_pixels" for c in B.QUALITY_ORDER)


@query("a6_pixel_quality", f"""
SELECT *, total_pixels - valid_pixels AS masked_pixels,
       round(valid_pixels / CAST(total_pixels AS DOUBLE), 6) AS valid_fraction,
       round((total_pixels - valid_pixels) / CAST(total_pixels AS DOUBLE), 6) AS contamination_fraction
FROM (SELECT scene_id, count(*) AS total_pixels,
             count(*) FILTER (WHERE category = 'usable') AS valid_pixels, {_QUALITY_COUNTS}
      FROM graded GROUP BY scene_id)
""")
def pixel_quality(spark, sf):
    graded = P.with_quality(V.pixels(spark, sf), "ndwi")
    return rounded(P.pixel_quality(graded, ["scene_id"]), "valid_fraction",
                   "contamination_fraction")


@query("a6_quality_imbalance", """
SELECT CAST(0 AS BIGINT) AS scene_id, CAST(0 AS BIGINT) AS total_pixels FROM graded WHERE category IS NULL
""")
def quality_imbalance(spark, sf):
    """Accounting invariants as a query: no scene may appear here."""
    graded = P.with_quality(V.pixels(spark, sf), "ndwi")
    return P.balanced(P.pixel_quality(graded, ["scene_id"])).select("scene_id", "total_pixels")


@query("a7_class_histogram", """
SELECT scene_id, scl AS scl_class, count(*) AS pixels, scl BETWEEN 0 AND 11 AS documented
FROM pixels WHERE scl IS NOT NULL GROUP BY scene_id, scl
""")
def class_histogram(spark, sf):
    return P.class_histogram(V.pixels(spark, sf), ["scene_id"])


@query("a7_class_counts", """
SELECT scene_id, string_agg(scl || '=' || n, ',' ORDER BY CAST(scl AS VARCHAR)) AS class_counts,
       string_agg(CASE WHEN scl > 11 THEN CAST(scl AS VARCHAR) END, ',' ORDER BY scl) AS unknown_values
FROM (SELECT scene_id, scl, count(*) AS n FROM pixels WHERE scl IS NOT NULL GROUP BY ALL)
GROUP BY scene_id
""")
def class_counts(spark, sf):
    c = P.class_counts(V.pixels(spark, sf), ["scene_id"])
    text = F.transform(F.map_entries("scl_class_counts"),
                       lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    unknown = F.array_join(F.transform("unknown_scl_values", lambda v: v.cast("string")), ",")
    return c.select("scene_id", F.array_join(text, ",").alias("class_counts"),
                    F.when(unknown != "", unknown).alias("unknown_values"))


@query("j1_band_pair", """
SELECT scene_id, "row", col, min(green) AS green, min(nir) AS nir, bool_or(green_valid) AS green_valid, TRUE AS nir_valid FROM pixels GROUP BY ALL
""")
def band_pair(spark, sf):
    """Long pixels (one row per band) folded into pairs by one shuffle on the pixel key; invalid ones keep their mark."""
    px = V.pixels(spark, sf).groupBy(*KEY).agg(
        F.min("green").alias("green"), F.min("nir").alias("nir"), F.min("red").alias("red"), F.bool_or("green_valid").alias("ok"))
    long = px.unpivot([*KEY, "ok"], ["green", "nir", "red"], "asset", "value").withColumn(
        "valid", B.band_valid(F.col("value")) & (F.col("ok") | (F.col("asset") != "green")))
    return P.pair_bands(long, KEY, "green", "nir").select(*KEY, "green", "nir", "green_valid", "nir_valid")


@query("j2_coregister", """
SELECT f.scene_id, f."row", f.col, c.swir16, coalesce(c.valid, FALSE) AS swir16_valid
FROM fine_cells f LEFT JOIN coarse_cells c
  ON c.scene_id = f.scene_id AND c."row" = f."row" // 2 AND c.col = f.col // 2
""")
def coregister(spark, sf):
    fine = V.fine_cells(spark, sf).select(*KEY)
    return P.coregister(fine, V.coarse_cells(spark, sf), ["scene_id"], "swir16")


@query("j3_align_scl", """
SELECT f.scene_id, f."row", f.col, CASE WHEN c.valid THEN c.scl END AS scl,
       coalesce(c.valid, FALSE) AS has_class
FROM fine_cells f LEFT JOIN coarse_cells c
  ON c.scene_id = f.scene_id AND c."row" = f."row" // 2 AND c.col = f.col // 2
""")
def align_scl(spark, sf):
    fine = V.fine_cells(spark, sf).select(*KEY)
    return P.align_scl(fine, V.coarse_cells(spark, sf), ["scene_id"])


@query("s6_window_clamp", """
WITH w AS (SELECT s_suppkey AS scene_id, greatest(floor(s_acctbal / 7 - 100.5), 0) AS row0,
       greatest(floor(s_suppkey * 3.25 - 40), 0) AS col0,
       least(ceil(s_acctbal / 7 + 1899.5), 1e9) AS row1,
       least(ceil(s_suppkey * 3.25 + 7960), 20000) AS col1 FROM supplier)
SELECT p.scene_id, count(*) AS pixels, sum(green) AS green_sum FROM pixels p JOIN w USING (scene_id)
WHERE "row" >= row0 AND "row" < row1 AND col >= col0 AND col < col1
  AND row1 > row0 AND col1 > col0 GROUP BY p.scene_id
""")
def window_clamp(spark, sf):
    grids = V.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("scene_id"),
        (F.col("s_acctbal") / 7 - 100.5).alias("row_off"), F.lit(2000.0).alias("win_h"),
        (F.col("s_suppkey") * 3.25 - 40).alias("col_off"), F.lit(8000.0).alias("win_w"),
        F.lit(20000).cast("double").alias("width"), F.lit(1e9).alias("height"))
    clipped = P.clip_pixels(V.pixels(spark, sf), P.clip_window(grids), ["scene_id"])
    return clipped.groupBy("scene_id").agg(F.count(F.lit(1)).alias("pixels"),
                                           F.sum("green").alias("green_sum"))


@query("s5_pixel_source", """
SELECT scene_id, count(*) AS pixels, min("row") AS row_min, max("row") AS row_max,
       count(*) FILTER (WHERE green_valid) AS valid_pixels
FROM pixels WHERE "row" BETWEEN 100 AND 999 GROUP BY scene_id
""")
def pixel_source(spark, sf):
    """A bounded window straight off the scan: the row range reaches the parquet reader."""
    px = V.pixels(spark, sf).where(F.col("row").between(100, 999))
    return px.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.min("row").alias("row_min"),
        F.max("row").alias("row_max"), F.count_if("green_valid").alias("valid_pixels"))


def _ramp_sql(value: str) -> str:
    return f"least(greatest(({value} + 1.0) / 2.0, 0.0), 1.0)"


@query("p38_index_rgba", f"""
SELECT scene_id, "row", col, CAST(trunc((1.0 - t) * 214) AS INTEGER) AS r,
       CAST(trunc(60 + (1.0 - t) * 120) AS INTEGER) AS g, CAST(trunc(40 + t * 215) AS INTEGER) AS b,
       CASE WHEN ok THEN 200 ELSE 0 END AS a
FROM (SELECT *, {_ramp_sql('v')} AS t FROM (
  SELECT scene_id, "row", col, coalesce({SQL_NDWI}, 0.0) AS v, ({SQL_NDWI}) IS NOT NULL AS ok FROM pixels))
""")
def index_rgba(spark, sf):
    px = P.with_index(V.pixels(spark, sf), "ndwi")
    return px.select(
        *KEY, B.index_rgba(F.coalesce("ndwi", F.lit(0.0)), F.col("ndwi_valid")).alias("c")
    ).select(*KEY, "c.*")


@query("p39_change_rgba", f"""
SELECT scene_id, "row", col, CAST(trunc(215 - t * 175) AS INTEGER) AS r,
       CAST(trunc(120 - abs(t - 0.5) * 120) AS INTEGER) AS g, CAST(trunc(40 + t * 175) AS INTEGER) AS b,
       200 AS a
FROM (SELECT x.scene_id, x."row", x.col, {_ramp_sql('y.ndwi - x.ndwi')} AS t
      FROM dated_cells x JOIN dated_cells y ON x.scene_id = y.scene_id AND x."row" = y."row"
       AND x.col = y.col AND NOT x.late AND y.late WHERE x.ndwi IS NOT NULL AND y.ndwi IS NOT NULL)
""")
def change_rgba(spark, sf):
    pairs = _date_pairs(spark, sf)
    return pairs.select(
        *KEY, B.change_rgba(F.col("change"), F.lit(True)).alias("c")).select(*KEY, "c.*")


def _date_pairs(spark, sf):
    cells = V.dated_cells(spark, sf)
    return P.pair_dates(cells.where(~F.col("late")), cells.where("late"), KEY, "ndwi")


@query("j4_temporal_pixel_pair", """
SELECT x.scene_id, x."row", x.col, round(x.ndwi, 6) AS first_value, round(y.ndwi, 6) AS second_value,
       round(y.ndwi - x.ndwi, 6) AS change
FROM dated_cells x JOIN dated_cells y ON x.scene_id = y.scene_id AND x."row" = y."row"
 AND x.col = y.col AND NOT x.late AND y.late WHERE x.ndwi IS NOT NULL AND y.ndwi IS NOT NULL
""")
def temporal_pixel_pair(spark, sf):
    return rounded(_date_pairs(spark, sf), "first_value", "second_value", "change")


@query("a4_temporal_change", """
SELECT x.scene_id, count(*) AS paired_valid_pixel_count, round(avg(y.ndwi - x.ndwi), 6) AS change_mean,
       round(min(y.ndwi - x.ndwi), 6) AS change_min, round(max(y.ndwi - x.ndwi), 6) AS change_max
FROM dated_cells x JOIN dated_cells y ON x.scene_id = y.scene_id AND x."row" = y."row"
 AND x.col = y.col AND NOT x.late AND y.late WHERE x.ndwi IS NOT NULL AND y.ndwi IS NOT NULL
GROUP BY x.scene_id
""")
def temporal_change(spark, sf):
    return rounded(P.temporal_change(_date_pairs(spark, sf), ["scene_id"]),
                   "change_mean", "change_min", "change_max")


_STRETCH_VIEW = """
src AS (SELECT l_suppkey AS scene_id, l_orderkey AS "row", l_partkey * 8 + l_linenumber AS col,
               l_extendedprice AS v, l_returnflag <> 'R' AS ok FROM lineitem),
lg AS (SELECT scene_id, min(v) > 0 AS use_log FROM src WHERE ok GROUP BY scene_id),
shown AS (SELECT src.*, CASE WHEN ok THEN CASE WHEN use_log THEN 10 * log10(v) ELSE v END END AS s
          FROM src JOIN lg USING (scene_id)),
bounds AS (SELECT scene_id, quantile_cont(s, 0.02) AS p02, quantile_cont(s, 0.98) AS p98
           FROM shown WHERE s IS NOT NULL GROUP BY scene_id)
"""


def _display_source(spark, sf):
    return V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("scene_id"), F.col("l_orderkey").alias("row"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("col"),
        F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") != "R").alias("ok"))


@query("p40_display_stretch", f"""
WITH {_STRETCH_VIEW}
SELECT scene_id, level, count(*) AS pixels FROM (
 SELECT scene_id, CAST(CASE WHEN NOT ok THEN 0 WHEN p98 <= p02 THEN 128
   ELSE round_even((least(greatest(s, p02), p98) - p02) / (p98 - p02) * 255.0, 0) END AS INTEGER) AS level
 FROM shown JOIN bounds USING (scene_id)) GROUP BY ALL
""")
def display_stretch(spark, sf):
    shown = P.display_stretch(_display_source(spark, sf), ["scene_id"], "v", "ok")
    return shown.groupBy("scene_id", "level").agg(F.count(F.lit(1)).alias("pixels"))


@query("a10_stretch_bounds", f"""
WITH {_STRETCH_VIEW}
SELECT scene_id, round(quantile_cont(v, 0.02), 6) AS p02, round(quantile_cont(v, 0.98), 6) AS p98
FROM src WHERE ok GROUP BY scene_id
""")
def stretch_bounds(spark, sf):
    px = _display_source(spark, sf).where("ok")
    return rounded(P.stretch_bounds(px, ["scene_id"], "v"), "p02", "p98")


@query("p11_p12_decibels", """
SELECT scene_id, "row", col, round(10 * log10(vv), 6) AS vv_db
FROM pixels_sar WHERE vv_valid AND vv > 0
""")
def decibels(spark, sf):
    px = V.pixels_sar(spark, sf)
    ok = px.where(B.valid_power(F.col("vv"), F.col("vv_valid")))
    return rounded(ok.select(*KEY, B.to_db(F.col("vv")).alias("vv_db")), "vv_db")


_SAR_AGG = """
agg AS (SELECT scene_id, count(*) AS window_n,
  count(*) FILTER (WHERE vv_valid AND vv > 0) AS vv_n, count(*) FILTER (WHERE vh_valid AND vh > 0) AS vh_n,
  count(*) FILTER (WHERE vv_valid AND vv <= 0) AS vv_np, count(*) FILTER (WHERE vh_valid AND vh <= 0) AS vh_np,
  10 * log10(avg(vv) FILTER (WHERE vv_valid AND vv > 0)) AS vv_mean,
  10 * log10(min(vv) FILTER (WHERE vv_valid AND vv > 0)) AS vv_min,
  10 * log10(max(vv) FILTER (WHERE vv_valid AND vv > 0)) AS vv_max,
  10 * log10(avg(vh) FILTER (WHERE vh_valid AND vh > 0)) AS vh_mean,
  10 * log10(min(vh) FILTER (WHERE vh_valid AND vh > 0)) AS vh_min,
  10 * log10(max(vh) FILTER (WHERE vh_valid AND vh > 0)) AS vh_max,
  count(*) FILTER (WHERE vv_valid AND vv > 0 AND vh_valid AND vh > 0) AS both_n,
  10 * log10(avg(vv) FILTER (WHERE vv_valid AND vv > 0 AND vh_valid AND vh > 0)) AS both_vv,
  10 * log10(avg(vh) FILTER (WHERE vv_valid AND vv > 0 AND vh_valid AND vh > 0)) AS both_vh
 FROM pixels_sar GROUP BY scene_id)
"""


@query("a8_backscatter_statistics", f"WITH {_SAR_AGG}" + _metrics_sql("agg", [
    (f"{p}_{e}", f"{p}_{n}", u) for p in ("vv", "vh") for e, n, u in (
        ("n", "valid_pixel_count", "pixels"), ("mean", "mean_db", "dB"),
        ("min", "min_db", "dB"), ("max", "max_db", "dB"))
] + [("both_vv - both_vh", "vv_minus_vh_mean_db", "dB")]))
def backscatter_statistics(spark, sf):
    return rounded(S.backscatter_stats(V.pixels_sar(spark, sf), ["scene_id"]), "value")


@query("a9_j5_polarization_difference", f"""
WITH {_SAR_AGG} SELECT scene_id, both_n AS paired_valid_pixel_count, round(both_vv, 6) AS vv_mean_db,
round(both_vh, 6) AS vh_mean_db, round(both_vv - both_vh, 6) AS vv_minus_vh_mean_db FROM agg WHERE both_n > 0
""")
def polarization_difference(spark, sf):
    return rounded(S.polarization_difference(V.pixels_sar(spark, sf), ["scene_id"]),
                   "vv_mean_db", "vh_mean_db", "vv_minus_vh_mean_db")


@query("j5_polarization_pair", """
SELECT scene_id, "row", col, vv, round(vh, 6) AS vh FROM pixels_sar
WHERE vv_valid AND vh_valid AND vv > 0 AND vh > 0
""")
def polarization_pair(spark, sf):
    px = S.pair_polarizations(V.pixels_sar(spark, sf))
    return rounded(px.select(*KEY, "vv", "vh"), "vh")


@query("p45_sar_warnings", f"""
WITH {_SAR_AGG}, w AS (
 SELECT scene_id, 1 AS o, 'VV produced no statistics: no finite, strictly positive sample.' AS warning FROM agg WHERE vv_n = 0
 UNION ALL SELECT scene_id, 2, vv_np || ' VV sample(s) were zero or negative and were excluded.' FROM agg WHERE vv_n > 0 AND vv_np > 0
 UNION ALL SELECT scene_id, 3, 'VV statistics cover ' || vv_n || ' of the ' || window_n || ' pixel(s); ' || (window_n - vv_n) || ' carried no usable sample.' FROM agg WHERE vv_n > 0 AND window_n > vv_n
 UNION ALL SELECT scene_id, 4, 'VH produced no statistics: no finite, strictly positive sample.' FROM agg WHERE vh_n = 0
 UNION ALL SELECT scene_id, 5, vh_np || ' VH sample(s) were zero or negative and were excluded.' FROM agg WHERE vh_n > 0 AND vh_np > 0
 UNION ALL SELECT scene_id, 6, 'VH statistics cover ' || vh_n || ' of the ' || window_n || ' pixel(s); ' || (window_n - vh_n) || ' carried no usable sample.' FROM agg WHERE vh_n > 0 AND window_n > vh_n
 UNION ALL SELECT scene_id, 7, 'VV and VH were not compared: no pixel is positive in both.' FROM agg WHERE both_n = 0)
SELECT scene_id, CAST(row_number() OVER (PARTITION BY scene_id ORDER BY o) - 1 AS INTEGER) AS pos, warning FROM w
""")
def sar_warnings(spark, sf):
    return S.sar_warnings(S.polarization_stats(V.pixels_sar(spark, sf), ["scene_id"]),
                          ["scene_id"])


@query("a15_coverage_percent", """
SELECT scene_id, count(*) AS window_pixels, count(ndwi) AS valid_pixels,
       round(count(ndwi) * 100.0 / count(*), 6) AS coverage_percent FROM graded GROUP BY scene_id
""")
def coverage_percent(spark, sf):
    masked = P.mask_with_scl(V.pixels(spark, sf), "ndwi")
    stats = masked.groupBy("scene_id").agg(F.count(F.lit(1)).alias("window_pixels"),
                                           F.count("ndwi").alias("valid_pixels"))
    return rounded(stats.withColumn(
        "coverage_percent", P.coverage_percent(stats, "valid_pixels", "window_pixels")),
        "coverage_percent")


_CRS_SQL = """
 WHEN crs1 IS NULL OR crs2 IS NULL THEN 'grid_crs_unknown'
 WHEN upper(trim(crs1)) <> upper(trim(crs2)) THEN 'grid_crs_mismatch'
 WHEN b1 <> 0 OR NOT (a1 > 0 AND e1 < 0) THEN 'grid_orientation_unsupported'
"""


@query("p17_same_grid", f"""
SELECT case_id, CASE {_CRS_SQL}
 WHEN width1 <> width2 OR height1 <> height2 THEN 'grid_shape_mismatch'
 WHEN abs(a1 - a2) > 1e-6 * a1 OR abs(e1 - e2) > 1e-6 * abs(e1) THEN 'grid_resolution_mismatch'
 WHEN abs(c1 - c2) > 1e-6 * a1 OR abs(f1 - f2) > 1e-6 * abs(e1) THEN 'grid_misaligned' END AS code
FROM grid_pairs
""")
def same_grid(spark, sf):
    return V.grid_pairs(spark, sf).select(
        "case_id", G.same_grid_problem(F.col("g1"), F.col("g2")).alias("code"))


@query("p18_nesting", f"""
WITH n AS (SELECT *, a1 / a2 AS rx, e1 / e2 AS ry, (c1 - c2) / a2 AS ox, (f2 - f1) / -e2 AS oy FROM grid_pairs),
coded AS (SELECT *, CASE {_CRS_SQL}
 WHEN abs(rx - round(rx)) > 1e-6 OR abs(ry - round(ry)) > 1e-6 OR rx < 0.5 OR ry < 0.5 THEN 'grid_ratio_invalid'
 WHEN abs(ox - round(ox)) > 1e-6 OR abs(oy - round(oy)) > 1e-6 THEN 'grid_misaligned'
 WHEN least(c1 + width1 * a1, c2 + width2 * a2) <= greatest(c1, c2)
   OR least(f1, f2) <= greatest(f1 + height1 * e1, f2 + height2 * e2) THEN 'grid_no_overlap' END AS code FROM n)
SELECT case_id, code, CASE WHEN code IS NULL THEN CAST(round(rx) AS BIGINT) END AS ratio_x,
 CASE WHEN code IS NULL THEN CAST(round(ry) AS BIGINT) END AS ratio_y,
 CASE WHEN code IS NULL THEN CAST(round(ox) AS BIGINT) END AS offset_x,
 CASE WHEN code IS NULL THEN CAST(round(oy) AS BIGINT) END AS offset_y FROM coded
""")
def nesting(spark, sf):
    return V.grid_pairs(spark, sf).select(
        "case_id", G.nesting(F.col("g1"), F.col("g2")).alias("n")).select("case_id", "n.*")


@query("p20_grid_id", """
SELECT case_id, coalesce(crs1, 'None') || '|' || printf('%g', a1) || ',' || printf('%g', b1) || ','
 || printf('%.6f', c1) || ',0,' || printf('%g', e1) || ',' || printf('%.6f', f1) || '|' || width1 || 'x' || height1 AS grid_id
FROM grid_pairs
""")
def grid_id(spark, sf):
    return V.grid_pairs(spark, sf).select("case_id", G.grid_id(F.col("g1")).alias("grid_id"))


@query("f29_window_corners", """
SELECT case_id, CASE WHEN ok THEN c1 END AS nw_x, CASE WHEN ok THEN f1 END AS nw_y,
 CASE WHEN ok THEN c1 + width1 * a1 END AS se_x, CASE WHEN ok THEN f1 + height1 * e1 END AS se_y
FROM (SELECT *, crs1 IS NOT NULL AND b1 = 0 AND a1 > 0 AND e1 < 0 AS ok FROM grid_pairs)
""")
def window_corners(spark, sf):
    corners = V.grid_pairs(spark, sf).select(
        "case_id", G.window_corners(F.col("g1")).alias("q"))
    nw, se = F.get("q", 0), F.get("q", 2)
    return corners.select("case_id", nw["x"].alias("nw_x"), nw["y"].alias("nw_y"),
                          se["x"].alias("se_x"), se["y"].alias("se_y"))


@query("f30_window_affine", """
SELECT case_id, a1 * 2.0 AS a, b1 * 4.0 AS b, c1 + a1 * 3 + b1 * 5 AS c, 0.0 AS d, e1 * 4.0 AS e,
       f1 + e1 * 5 AS f FROM grid_pairs
""")
def window_affine(spark, sf):
    affine = G.window_affine(F.col("g1"), F.lit(3), F.lit(5), F.lit(2.0), F.lit(4.0))
    return V.grid_pairs(spark, sf).select("case_id", affine.alias("w")).select("case_id", "w.*")
