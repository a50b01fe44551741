"""Radar backscatter: statistics are taken in linear power and converted once, at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.functions import bands as B
from earthframe.functions.rules import notes
from earthframe.operators.pixels import unpivot_metrics

POLARIZATIONS = ("vv", "vh")


def _valid(pixels: DataFrame, pol: str) -> Column:
    name = f"{pol}_valid"
    return F.col(name) if name in pixels.columns else B.finite(F.col(pol))


def polarization_stats(pixels: DataFrame, by: Sequence[str],
                       polarizations: Sequence[str] = POLARIZATIONS) -> DataFrame:
    """Wide per-group statistics of each polarization and of the pixels valid in both.

    One pass: counts, linear means and extremes; decibels are derived from the aggregates
    (mean of power first, logarithm after - the other order is wrong by several dB).
    """
    aggs = [F.count(F.lit(1)).alias("window_pixel_count")]
    for pol in polarizations:
        ok = B.valid_power(F.col(pol), _valid(pixels, pol))
        power = F.when(ok, F.col(pol).cast("double"))
        below = _valid(pixels, pol) & B.finite(F.col(pol)) & ~ok
        aggs += [
            F.count(power).alias(f"{pol}_valid_pixel_count"),
            F.count_if(below).alias(f"{pol}_nonpositive_pixel_count"),
            F.avg(power).alias(f"{pol}_mean_power"),
            F.min(power).alias(f"{pol}_min_power"),
            F.max(power).alias(f"{pol}_max_power"),
        ]
    if set(POLARIZATIONS) <= set(polarizations):
        both = (
            B.valid_power(F.col("vv"), _valid(pixels, "vv"))
            & B.valid_power(F.col("vh"), _valid(pixels, "vh"))
        )
        aggs += [
            F.count_if(both).alias("paired_valid_pixel_count"),
            F.avg(F.when(both, F.col("vv").cast("double"))).alias("paired_vv_power"),
            F.avg(F.when(both, F.col("vh").cast("double"))).alias("paired_vh_power"),
        ]
    return pixels.groupBy(*by).agg(*aggs)


def backscatter_stats(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long metrics per polarization; without a valid pixel only the count is a row."""
    stats = polarization_stats(pixels, by)
    metrics = []
    for pol in POLARIZATIONS:
        metrics += [
            (F.col(f"{pol}_valid_pixel_count"), f"{pol}_valid_pixel_count", "pixels"),
            (B.to_db(F.col(f"{pol}_mean_power")), f"{pol}_mean_db", "dB"),
            (B.to_db(F.col(f"{pol}_min_power")), f"{pol}_min_db", "dB"),
            (B.to_db(F.col(f"{pol}_max_power")), f"{pol}_max_db", "dB"),
        ]
    metrics.append((_difference(), "vv_minus_vh_mean_db", "dB"))
    return unpivot_metrics(stats, by, metrics)


def _difference() -> Column:
    return B.to_db(F.col("paired_vv_power")) - B.to_db(F.col("paired_vh_power"))


def pair_polarizations(pixels: DataFrame) -> DataFrame:
    """Pixels with a usable sample in both polarizations."""
    return pixels.where(
        B.valid_power(F.col("vv"), _valid(pixels, "vv"))
        & B.valid_power(F.col("vh"), _valid(pixels, "vh"))
    )


def polarization_difference(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """VV minus VH over the pixels valid in both; groups without such a pixel are absent."""
    return (
        polarization_stats(pixels, by).where(F.col("paired_valid_pixel_count") > 0)
        .select(
            *by, "paired_valid_pixel_count",
            B.to_db(F.col("paired_vv_power")).alias("vv_mean_db"),
            B.to_db(F.col("paired_vh_power")).alias("vh_mean_db"),
            _difference().alias("vv_minus_vh_mean_db"),
        )
    )


def sar_warnings(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exclusions per polarization in a fixed order, one row per statement.

    Takes :func:`polarization_stats` output. A polarization without statistics states
    only that; otherwise non-positive samples come before uncovered pixels.
    """
    per_pol = []
    for pol in POLARIZATIONS:
        name = pol.upper()
        n = F.col(f"{pol}_valid_pixel_count")
        below = F.col(f"{pol}_nonpositive_pixel_count")
        total = F.col("window_pixel_count")
        per_pol.append(notes([
            (n == 0, f"{name} produced no statistics: no finite, strictly positive sample."),
            ((n > 0) & (below > 0), F.format_string(
                "%d " + name + " sample(s) were zero or negative and were excluded.", below)),
            ((n > 0) & (total > n), F.format_string(
                name + " statistics cover %d of the %d pixel(s); %d carried no usable sample.",
                n, total, total - n)),
        ]))
    per_pol.append(notes([(
        F.col("paired_valid_pixel_count") == 0,
        "VV and VH were not compared: no pixel is positive in both.",
    )]))
    return stats.select(
        *by, F.posexplode(F.concat(*per_pol)).alias("pos", "warning")
    )
