"""Raster grids as structs ``{crs,a,b,c,d,e,f,width,height}`` and the rules between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earthframe.functions.rules import first_failure, let

# Fixed value: largest difference, in pixels of the grid, that counts as float noise.
TOLERANCE_PIXELS = 1e-6


def _same_crs(a: Column, b: Column) -> Column:
    return F.upper(F.trim(a)) == F.upper(F.trim(b))


def res_x(g: Column) -> Column:
    return g["a"]


def res_y(g: Column) -> Column:
    return -g["e"]


def _not_north_up(g: Column) -> Column:
    return (g["b"] != 0.0) | (g["d"] != 0.0) | ~((g["a"] > 0.0) & (g["e"] < 0.0))


def _close(a: Column, b: Column, pixel: Column) -> Column:
    return F.abs(a - b) <= F.lit(TOLERANCE_PIXELS) * F.abs(pixel)


def _whole(value: Column) -> Column:
    """The integer ``value`` is, within tolerance; NULL when it is not one."""
    nearest = F.rint(value)
    return F.when(F.abs(value - nearest) <= TOLERANCE_PIXELS, nearest.cast("bigint"))


def _crs_rules(g1: Column, g2: Column) -> list[tuple[Column, str]]:
    return [
        (g1["crs"].isNull() | g2["crs"].isNull(), "grid_crs_unknown"),
        (~_same_crs(g1["crs"], g2["crs"]), "grid_crs_mismatch"),
        (_not_north_up(g1) | _not_north_up(g2), "grid_orientation_unsupported"),
    ]


def same_grid_problem(g1: Column, g2: Column) -> Column:
    """Code of the first reason two grids are not the same ground, or NULL."""
    return first_failure([
        *_crs_rules(g1, g2),
        ((g1["width"] != g2["width"]) | (g1["height"] != g2["height"]), "grid_shape_mismatch"),
        (~(_close(res_x(g1), res_x(g2), res_x(g1)) & _close(res_y(g1), res_y(g2), res_y(g1))),
         "grid_resolution_mismatch"),
        (~(_close(g1["c"], g2["c"], res_x(g1)) & _close(g1["f"], g2["f"], res_y(g1))),
         "grid_misaligned"),
    ])


# What each geometry code says to a reader.
GRID_REASONS: dict[str, str] = {
    "grid_crs_unknown": "the CRS of at least one grid could not be established",
    "grid_crs_mismatch": "they are in different coordinate reference systems",
    "grid_orientation_unsupported": "only north-up grids are supported",
    "grid_shape_mismatch": "they cover different pixel dimensions",
    "grid_resolution_mismatch": "their resolutions differ",
    "grid_misaligned": "their origins do not fall on the same pixel edges",
    "grid_ratio_invalid": "the coarser resolution is not a whole multiple of the finer one",
    "grid_no_overlap": "the two grids do not overlap",
}


def _overlap(g1: Column, g2: Column) -> Column:
    def bounds(g: Column) -> tuple[Column, Column, Column, Column]:
        return (g["c"], g["f"] - g["height"] * res_y(g), g["c"] + g["width"] * res_x(g), g["f"])

    ax0, ay0, ax1, ay1 = bounds(g1)
    bx0, by0, bx1, by1 = bounds(g2)
    return (F.least(ax1, bx1) > F.greatest(ax0, bx0)) & (
        F.least(ay1, by1) > F.greatest(ay0, by0)
    )


def nesting(coarse: Column, fine: Column) -> Column:
    """How whole coarse cells sit on fine pixels, or the code of why they do not.

    Struct ``{code, ratio_x, ratio_y, offset_x, offset_y}``; offsets in fine pixels.
    """
    measured = F.struct(
        _whole(F.try_divide(res_x(coarse), res_x(fine))).alias("ratio_x"),
        _whole(F.try_divide(res_y(coarse), res_y(fine))).alias("ratio_y"),
        _whole(F.try_divide(coarse["c"] - fine["c"], res_x(fine))).alias("offset_x"),
        _whole(F.try_divide(fine["f"] - coarse["f"], res_y(fine))).alias("offset_y"),
    )

    def judged(n: Column) -> Column:
        code = first_failure([
            *_crs_rules(coarse, fine),
            (n["ratio_x"].isNull() | n["ratio_y"].isNull() | (n["ratio_x"] < 1)
             | (n["ratio_y"] < 1), "grid_ratio_invalid"),
            (n["offset_x"].isNull() | n["offset_y"].isNull(), "grid_misaligned"),
            (~_overlap(coarse, fine), "grid_no_overlap"),
        ])
        return let(code, lambda c: F.struct(
            c.alias("code"), *[F.when(c.isNull(), n[k]).alias(k)
                               for k in ("ratio_x", "ratio_y", "offset_x", "offset_y")]))

    return let(measured, judged)


def general(value: Column) -> Column:
    """A number at six significant digits without trailing zeros (C ``%g``)."""
    def written(scientific: Column) -> Column:
        power = F.regexp_extract(scientific, r"e([-+]\d+)$", 1)
        digits = F.regexp_replace(F.regexp_extract(scientific, r"^(-?[0-9.]+)e", 1), r"\.?0+$", "")

        def plain(places: Column) -> Column:
            text = F.printf(F.concat(F.lit("%."), F.greatest(places, F.lit(0)).cast("string"), F.lit("f")), value)
            return F.when(places > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)

        return let(F.when(power != "", power.cast("int")), lambda exponent: F.when(
            (exponent < -4) | (exponent >= 6), F.concat(digits, F.lit("e"), power)).otherwise(plain(F.lit(5) - exponent)))

    # whole numbers of six digits at most, the common case, are written as they are
    return F.when(value == 0.0, F.when(value.cast("string").startswith("-"), "-0").otherwise("0")).when(
        (F.abs(value) < 1e6) & (value == F.rint(value)), value.cast("bigint").cast("string")).when(
        F.isnan(value) | (F.abs(value) == float("inf")),
        F.replace(F.lower(value.cast("string")), F.lit("infinity"), F.lit("inf"))).otherwise(
        let(F.format_string("%.5e", value), written))


def grid_id(g: Column) -> Column:
    """Deterministic name of exactly this grid."""
    affine = F.concat_ws(
        ",", general(g["a"]), general(g["b"]), F.format_string("%.6f", g["c"]),
        general(g["d"]), general(g["e"]), F.format_string("%.6f", g["f"]),
    )
    size = F.concat_ws("x", g["width"].cast("string"), g["height"].cast("string"))
    return F.concat_ws("|", F.coalesce(g["crs"], F.lit("None")), affine, size)


def window_affine(g: Column, col_off: Column, row_off: Column,
                  scale_x: Column, scale_y: Column) -> Column:
    """Affine of a window read at an offset, decimated by the given factors."""
    a, b, c, d, e, f = (g[k] for k in "abcdef")
    return F.struct(
        (a * scale_x).alias("a"), (b * scale_y).alias("b"),
        (c + a * col_off + b * row_off).alias("c"),
        (d * scale_x).alias("d"), (e * scale_y).alias("e"),
        (f + d * col_off + e * row_off).alias("f"),
    )


def window_corners(g: Column) -> Column:
    """NW, NE, SE, SW corners in the native CRS; NULL for a grid that cannot be placed."""
    w, h = g["width"].cast("double"), g["height"].cast("double")

    def corner(x: Column, y: Column) -> Column:
        return F.struct(
            (g["c"] + x * g["a"] + y * g["b"]).alias("x"),
            (g["f"] + x * g["d"] + y * g["e"]).alias("y"),
        )

    zero = F.lit(0.0)
    placeable = (
        (g["width"] > 0) & (g["height"] > 0) & ~_not_north_up(g)
        & g["crs"].isNotNull() & (F.trim(g["crs"]) != "")
    )
    return F.when(
        placeable, F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h))
    )


def source_grid(transform: Column, shape: Column, epsg: Column) -> Column:
    """Grid struct of a source raster from its published ``proj:*`` values, or NULL."""
    known = (F.size(transform) >= 6) & (F.size(shape) == 2)
    return F.when(known, F.struct(
        F.when(epsg.isNotNull(), F.concat(F.lit("EPSG:"), epsg.cast("string"))).alias("crs"),
        *[F.get(transform, i).cast("double").alias(k) for i, k in enumerate("abcdef")],
        F.get(shape, 1).cast("int").alias("width"), F.get(shape, 0).cast("int").alias("height"),
    ))


def summary_line(label: Column, g: Column, placements: Column) -> Column:
    """One citable line for a valid analysis grid."""
    return F.format_string(
        "%s grid: valid - %s, %s x %s m, %dx%d px; %s.", label, g["crs"],
        general(res_x(g)), general(res_y(g)), g["width"], g["height"], placements,
    )
