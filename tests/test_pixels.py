from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earthframe.functions import bands as B
from earthframe.functions import footprints as FP
from earthframe.functions import grids as G
from earthframe.functions.claims import display_value
from earthframe.operators import pixels as P
from earthframe.operators import sar as S


def test_index_statistics_skip_nodata_nan_and_zero_denominators(spark):
    rows = [("s", 3.0, 1.0), ("s", 2.0, 2.0), ("s", 0.0, 5.0), ("s", 1.0, -1.0),
            ("s", float("nan"), 1.0), ("s", 4.0, float("inf")), ("e", 0.0, 1.0)]
    px = spark.createDataFrame(rows, "scene string, green double, nir double").withColumn(
        "green_valid", B.band_valid(F.col("green"), F.lit(0.0)))
    out = P.index_statistics(P.with_index(px, "ndwi"), ["scene"], ["ndwi"])
    got = {(r.scene, r.name): r.value for r in out.collect()}
    assert got[("s", "ndwi_valid_pixel_count")] == 2.0  # (3,1) and the zero numerator (2,2)
    assert got[("s", "ndwi_mean")] == pytest.approx(0.25)
    assert got[("s", "ndwi_percent_above_index_threshold_0.3")] == 50.0
    assert {k for k in got if k[0] == "e"} == {("e", "ndwi_valid_pixel_count")}


def test_common_scale_cancels_and_offset_does_not(spark):
    px = spark.createDataFrame([(3.0, 1.0), (7.0, 2.0)], "a double, b double")
    base, scaled, moved = (
        [r[0] for r in px.select(B.normalized_difference(x, y)).collect()]
        for x, y in ((F.col("a"), F.col("b")), (F.col("a") * 4, F.col("b") * 4),
                     (F.col("a") + 1, F.col("b") + 1)))
    assert base == scaled and base != moved


def test_every_scl_value_has_one_category_and_sums_balance(spark):
    px = spark.createDataFrame([("s", 2.0, 1.0, v) for v in [*range(13), 99, 255, None]],
                               "scene string, green double, nir double, scl int")
    q = P.pixel_quality(P.with_quality(px, "ndwi"), ["scene"])
    row = q.first()
    assert (row.valid_pixels, row.nodata_pixels, row.cloud_pixels, row.unknown_class_pixels) == (3, 2, 3, 3)
    assert P.balanced(q).count() == 0


def test_mean_is_taken_in_power_then_converted(spark):
    px = spark.createDataFrame([("s", 1.0, 0.1), ("s", 0.01, 0.1), ("s", 0.0, -1.0)],
                               "scene string, vv double, vh double")
    got = {r.name: r.value for r in S.backscatter_stats(px, ["scene"]).collect()}
    assert got["vv_mean_db"] == pytest.approx(10 * math.log10(0.505))
    assert got["vv_mean_db"] != pytest.approx(-10.0)
    assert got["vv_minus_vh_mean_db"] == pytest.approx(10 * math.log10(0.505) + 10)


def test_each_coarse_cell_repeats_ratio_squared_times(spark):
    fine = spark.range(8).crossJoin(spark.range(8).withColumnRenamed("id", "c")).select(
        F.lit("s").alias("scene"), F.col("id").alias("row"), F.col("c").alias("col"))
    coarse = spark.range(4).crossJoin(spark.range(3).withColumnRenamed("id", "c")).select(
        F.lit("s").alias("scene"), F.col("id").alias("row"), F.col("c").alias("col"),
        (F.col("id") * 10 + F.col("c")).alias("v"), F.lit(True).alias("valid"))
    out = P.coregister(fine, coarse, ["scene"], "v")
    counts = {r.v: r["count"] for r in out.where("v_valid").groupBy("v").count().collect()}
    assert len(counts) == 12 and set(counts.values()) == {4}
    assert out.where(~F.col("v_valid")).count() == 16  # the uncovered column is never filled


@pytest.mark.parametrize("skewed", [False, True])
def test_percentiles_match_numpy(spark, skewed):
    rng = np.random.default_rng(3)
    values = np.exp(rng.normal(size=4000)) if skewed else np.round(rng.normal(size=4000), 1)
    df = spark.createDataFrame([("hot", float(v)) for v in values] + [("one", 5.0)],
                               "g string, v double")
    got = {r.g: (r.p02, r.p98) for r in P.value_percentiles(df, ["g"], "v", (0.02, 0.98)).collect()}
    assert got["hot"] == pytest.approx(tuple(np.percentile(values, [2, 98])))
    assert got["one"] == (5.0, 5.0)


def test_grid_rules(spark):
    def grid(crs="EPSG:32644", a=10.0, c=0.0, f=100.0, w=10, h=10, b=0.0):
        return (crs, a, b, c, 0.0, -a, f, w, h)

    t = "struct<crs:string,a:double,b:double,c:double,d:double,e:double,f:double,width:int,height:int>"
    cases = [
        (grid(), grid(), None, None), (grid(c=9e-6), grid(), None, None),
        (grid(c=5.0), grid(), "grid_misaligned", "grid_misaligned"),
        (grid(c=10.0), grid(), "grid_misaligned", None),
        (grid(a=20.0, w=5, h=5), grid(), "grid_shape_mismatch", None),
        (grid(a=15.0), grid(), "grid_resolution_mismatch", "grid_ratio_invalid"),
        (grid(crs=None), grid(), "grid_crs_unknown", "grid_crs_unknown"),
        (grid(crs=" epsg:32644"), grid(), None, None),
        (grid(b=0.1), grid(), "grid_orientation_unsupported", "grid_orientation_unsupported"),
        (grid(c=1000.0), grid(), "grid_misaligned", "grid_no_overlap"),
    ]
    df = spark.createDataFrame([(i, x, y) for i, (x, y, *_) in enumerate(cases)], f"i int, x {t}, y {t}")
    got = df.select("i", G.same_grid_problem(F.col("x"), F.col("y")).alias("same"),
                    G.nesting(F.col("x"), F.col("y")).alias("n")).orderBy("i").collect()
    assert [(r.same, r.n.code) for r in got] == [(s, n) for *_, s, n in cases]
    assert (got[4].n.ratio_x, got[4].n.offset_x) == (2, 0)


def test_coverage_of_polygons_with_holes(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square, hole = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2))
    triangle, far = ring((0, 0), (8, 0), (0, 8)), ring((50, 50), (51, 50), (51, 51))
    df = spark.createDataFrame(
        [(0, [[square]]), (1, [[square, hole]]), (2, [[triangle]]), (3, [[far]]), (4, [[square], [far]]),
         (5, None)], "i int, p array<array<array<struct<x:double,y:double>>>>")
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in
                     (("west", 0), ("south", 0), ("east", 4), ("north", 4))])
    got = [r.f for r in df.select("i", FP.coverage_fraction(F.col("p"), box).alias("f")).orderBy("i").collect()]
    assert got[:5] == pytest.approx([1.0, 15 / 16, 1.0, 0.0, 1.0]) and got[5] is None


def test_display_value_matches_python(spark):
    def expected(v):
        if v == int(v):
            return str(int(v))
        places = 3 - math.floor(math.log10(abs(v)))
        return str(int(round(v))) if places <= 0 else f"{round(v, places):.{places}f}".rstrip("0").rstrip(".")

    values = [0.1463908465206975, -12.395, 0.00027945, 0.0040975, 2.675, 123456.5, 7.0, -0.5, 1e-7 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(display_value(F.col("v"))).collect()] == [expected(v) for v in values]
