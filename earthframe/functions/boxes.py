"""Bounding boxes as structs ``{west,south,east,north}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earthframe.functions.bands import finite


def bbox(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(west.alias("west"), south.alias("south"),
                    east.alias("east"), north.alias("north"))


def valid_bbox(b: Column) -> Column:
    """In range and in order; a box needs area. NULL in, false out."""
    ok = (
        finite(b["west"]) & finite(b["south"]) & finite(b["east"]) & finite(b["north"])
        & b["west"].between(-180, 180) & b["east"].between(-180, 180)
        & b["south"].between(-90, 90) & b["north"].between(-90, 90)
        & (b["west"] < b["east"]) & (b["south"] < b["north"])
    )
    return F.coalesce(ok, F.lit(False))


def bbox_center(b: Column) -> Column:
    return F.struct(((b["west"] + b["east"]) / 2).alias("lon"),
                    ((b["south"] + b["north"]) / 2).alias("lat"))


def bbox_intersects(a: Column, b: Column) -> Column:
    """Closed intersection: touching edges count, an unknown footprint is not excluded."""
    apart = (
        (a["east"] < b["west"]) | (a["west"] > b["east"])
        | (a["north"] < b["south"]) | (a["south"] > b["north"])
    )
    return F.coalesce(~apart, F.lit(True))


def bbox_relation(a: Column, b: Column) -> Column:
    """unknown / none (no shared area) / full (one contains the other) / partial."""
    def contains(o: Column, i: Column) -> Column:
        return (
            (o["west"] <= i["west"]) & (o["east"] >= i["east"])
            & (o["south"] <= i["south"]) & (o["north"] >= i["north"])
        )

    no_area = (
        (F.greatest(a["west"], b["west"]) >= F.least(a["east"], b["east"]))
        | (F.greatest(a["south"], b["south"]) >= F.least(a["north"], b["north"]))
    )
    return (
        F.when(a.isNull() | b.isNull(), "unknown").when(no_area, "none")
        .when(contains(a, b) | contains(b, a), "full").otherwise("partial")
    )


# WGS84 ellipsoid and the lower-bound factor of a native window.
WGS84_A = 6_378_137.0
WGS84_E2 = (1 / 298.257223563) * (2 - 1 / 298.257223563)
WINDOW_LOWER_BOUND = 0.99
SIMPSON_PANELS = 16


def aoi_extent_m(b: Column) -> Column:
    """Ground width (widest parallel) and height (meridian arc) in metres."""
    south, north = b["south"], b["north"]
    widest = (
        F.when((south <= 0) & (north >= 0), F.lit(0.0))
        .when(F.abs(south) < F.abs(north), south).otherwise(north)
    )
    s = F.sin(F.radians(widest))
    radius = F.lit(WGS84_A) * F.cos(F.radians(widest)) / F.sqrt(1.0 - WGS84_E2 * s * s)
    width = F.radians(b["east"] - b["west"]) * radius

    step = (north - south) / SIMPSON_PANELS

    def meridian(lat: Column) -> Column:
        sl = F.sin(F.radians(lat))
        return F.lit(WGS84_A * (1.0 - WGS84_E2)) / F.pow(1.0 - WGS84_E2 * sl * sl, F.lit(1.5))

    inner = F.aggregate(
        F.sequence(F.lit(1), F.lit(SIMPSON_PANELS - 1)), F.lit(0.0),
        lambda acc, i: acc + F.when(i % 2 == 1, 4.0).otherwise(2.0) * meridian(south + i * step),
    )
    height = F.radians(step) * (meridian(south) + meridian(north) + inner) / 3.0
    return F.struct(width.alias("width_m"), height.alias("height_m"))


def aoi_too_large(extent: Column, spacing: float = 10.0, max_dim: int = 2048,
                  max_px: int = 50_000_000) -> Column:
    """Whether a native-resolution window over the area would exceed the read limits."""
    cols = extent["width_m"] * WINDOW_LOWER_BOUND / spacing
    rows = extent["height_m"] * WINDOW_LOWER_BOUND / spacing
    return (F.greatest(cols, rows) > max_dim) | (cols * rows > max_px)
