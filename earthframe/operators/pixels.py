"""Optical pixel operators over wide pixel frames (one row per pixel, one column per band).

Every statistic is one aggregation pass with map-side partial aggregation, so a scene
that holds a third of all pixels costs no more per task than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.functions import bands as B


def wide_bands(pixels: DataFrame, keys: Sequence[str], assets: Sequence[str]) -> DataFrame:
    """Long pixels (key columns, asset, value, valid) -> one column pair per listed asset.

    One shuffle on the pixel key serves every band; unlisted assets never leave the scan.
    """
    wanted = pixels.where(F.col("asset").isin(*assets))
    cols = []
    for asset in assets:
        here = F.col("asset") == asset
        cols += [
            F.max(F.when(here, F.col("value"))).alias(asset),
            F.coalesce(F.max(F.when(here, F.col("valid"))), F.lit(False)).alias(f"{asset}_valid"),
        ]
    return wanted.groupBy(*keys).agg(*cols)


def pair_bands(pixels: DataFrame, keys: Sequence[str], high: str, low: str) -> DataFrame:
    """Same pixel of two bands on one grid; a pixel missing either band is dropped."""
    wide = wide_bands(pixels, keys, [high, low])
    return wide.where(F.col(high).isNotNull() & F.col(low).isNotNull())


def with_index(pixels: DataFrame, index: str, usable: Column | None = None) -> DataFrame:
    """Add ``<index>`` (NULL where undefined) and ``<index>_valid``.

    ``usable`` is an extra mask (pixel quality); values outside it are left untouched
    in the bands and simply do not contribute an index.
    """
    high, low = B.INDICES[index]
    valid = B.pair_valid(
        F.col(high), F.col(low), _validity(pixels, high), _validity(pixels, low)
    )
    if usable is not None:
        valid = valid & F.coalesce(usable, F.lit(False))
    return pixels.withColumn(f"{index}_valid", valid).withColumn(
        index,
        F.when(F.col(f"{index}_valid"), B.normalized_difference(F.col(high), F.col(low))),
    )


def _validity(pixels: DataFrame, band: str) -> Column:
    name = f"{band}_valid"
    return F.col(name) if name in pixels.columns else B.band_valid(F.col(band))


def with_quality(pixels: DataFrame, index: str, scl: str = "scl") -> DataFrame:
    """Add ``category``: the one quality category each pixel of the index pair falls in."""
    high, low = B.INDICES[index]
    ok = B.pair_valid(F.col(high), F.col(low), _validity(pixels, high), _validity(pixels, low))
    return pixels.withColumn("category", B.scl_category(F.col(scl), ok))


def mask_with_scl(pixels: DataFrame, index: str, scl: str = "scl") -> DataFrame:
    """Index restricted to clear-surface pixels, plus the category of every pixel."""
    return with_index(
        with_quality(pixels, index, scl), index, usable=F.col("category") == "usable"
    )


def unpivot_metrics(
    stats: DataFrame, by: Sequence[str], metrics: Sequence[tuple[Column, str, str]]
) -> DataFrame:
    """(value, name, unit) columns -> long metric rows; a NULL value is no row at all."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"),
                 F.lit(unit).alias("unit"))
        for value, name, unit in metrics
    ])
    return (
        stats.select(*by, F.explode(rows).alias("m"))
        .select(*by, "m.name", "m.value", "m.unit")
        .where(F.col("value").isNotNull())
    )


def index_statistics(pixels: DataFrame, by: Sequence[str], indices: Sequence[str]) -> DataFrame:
    """Count, mean, min, max per index in one pass; the count row is always present.

    NDWI also reports the share strictly above its fixed index threshold.
    """
    aggs, metrics = [], []
    for key in indices:
        v = F.col(key)
        aggs += [
            F.count(v).alias(f"{key}_n"), F.avg(v).alias(f"{key}_avg"),
            F.min(v).alias(f"{key}_lo"), F.max(v).alias(f"{key}_hi"),
        ]
        n = F.col(f"{key}_n")
        metrics += [
            (n, f"{key}_valid_pixel_count", "pixels"),
            (F.col(f"{key}_avg"), f"{key}_mean", "index"),
            (F.col(f"{key}_lo"), f"{key}_min", "index"),
            (F.col(f"{key}_hi"), f"{key}_max", "index"),
        ]
        if key == "ndwi":
            aggs.append(F.count_if(v > B.NDWI_INDEX_THRESHOLD).alias("ndwi_above"))
            metrics.append((
                F.try_divide(F.col("ndwi_above").cast("double"), n) * 100.0,
                f"ndwi_percent_above_index_threshold_{B.NDWI_INDEX_THRESHOLD}", "%",
            ))
    return unpivot_metrics(pixels.groupBy(*by).agg(*aggs), by, metrics)


def threshold_statistics(
    pixels: DataFrame, by: Sequence[str], index: str, operator: str, threshold: float
) -> DataFrame:
    """Matching and valid pixels with their percentage; no row without a valid pixel."""
    hit = B.compare(F.col(index), operator, threshold)
    return (
        pixels.groupBy(*by)
        .agg(F.count_if(hit).alias("matching_pixel_count"),
             F.count(index).alias("valid_pixel_count"))
        .where(F.col("valid_pixel_count") > 0)
        .withColumn("percentage",
                    F.col("matching_pixel_count") / F.col("valid_pixel_count") * 100.0)
    )


def pixel_quality(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seven category counts, totals and fractions per group, in one pass.

    Needs ``category`` (see :func:`with_quality`). Fractions are NULL without pixels.
    """
    counts = [
        F.count_if(F.col("category") == c).alias(f"{c}_pixels") for c in B.QUALITY_ORDER
    ]
    return (
        pixels.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("total_pixels"),
             F.count_if(F.col("category") == "usable").alias("valid_pixels"), *counts)
        .withColumn("masked_pixels", F.col("total_pixels") - F.col("valid_pixels"))
        .withColumn("valid_fraction", F.try_divide("valid_pixels", "total_pixels"))
        .withColumn("contamination_fraction", F.try_divide("masked_pixels", "total_pixels"))
    )


def class_histogram(pixels: DataFrame, by: Sequence[str], scl: str = "scl") -> DataFrame:
    """Class value -> pixel count where a class exists, flagging undocumented values."""
    return (
        pixels.where(F.col(scl).isNotNull())
        .groupBy(*by, F.col(scl).cast("int").alias("scl_class"))
        .agg(F.count(F.lit(1)).alias("pixels"))
        .withColumn("documented", F.col("scl_class").between(0, 11))
    )


def class_counts(pixels: DataFrame, by: Sequence[str], scl: str = "scl") -> DataFrame:
    """The histogram folded to one row per group: class map and undocumented values."""
    entry = F.struct(F.col("scl_class").cast("string").alias("key"), F.col("pixels"))
    return class_histogram(pixels, by, scl).groupBy(*by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("scl_class_counts"),
        F.array_sort(
            F.collect_list(F.when(~F.col("documented"), F.col("scl_class")))
        ).alias("unknown_scl_values"),
    )


def balanced(quality: DataFrame) -> DataFrame:
    """Quality rows that break an accounting invariant; always empty for our own output."""
    parts = sum((F.col(f"{c}_pixels") for c in B.QUALITY_ORDER), F.lit(0))
    return quality.where(
        (F.col("valid_pixels") + F.col("masked_pixels") != F.col("total_pixels"))
        | (parts != F.col("masked_pixels"))
    )


def coregister(
    fine: DataFrame, coarse: DataFrame, by: Sequence[str], value: str,
    ratio: tuple[int | Column, int | Column] = (2, 2),
    offset: tuple[int | Column, int | Column] = (0, 0),
) -> DataFrame:
    """Give each fine pixel the coarse cell containing its centre; no parent -> not valid.

    ``offset`` is the coarse origin in fine pixels. The parent key is an integer
    expression, so this stays an equi-join; nothing is averaged or filled.
    """
    def as_col(v: int | Column) -> Column:
        return v if isinstance(v, Column) else F.lit(v)

    parent_row = F.floor((F.col("row") - as_col(offset[1])) / as_col(ratio[1])).cast("bigint")
    parent_col = F.floor((F.col("col") - as_col(offset[0])) / as_col(ratio[0])).cast("bigint")
    parents = coarse.select(
        *by, F.col("row").alias("_prow"), F.col("col").alias("_pcol"),
        F.col(value), F.col("valid").alias(f"{value}_valid"),
    )
    return (
        fine.withColumn("_prow", parent_row).withColumn("_pcol", parent_col)
        .join(parents, [*by, "_prow", "_pcol"], "left")
        .withColumn(f"{value}_valid", F.coalesce(f"{value}_valid", F.lit(False)))
        .drop("_prow", "_pcol")
    )


def align_scl(fine: DataFrame, scl: DataFrame, by: Sequence[str],
              ratio: tuple[int, int] = (2, 2), offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """Class map onto the analysis grid: labels copied whole, no cell -> no class."""
    kind = dict(scl.dtypes)["scl"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"a class map must be integer-valued, not {kind}")
    joined = coregister(fine, scl, by, "scl", ratio, offset)
    return joined.withColumn("scl", F.when(F.col("scl_valid"), F.col("scl"))).withColumnRenamed(
        "scl_valid", "has_class"
    )


def clip_window(grids: DataFrame) -> DataFrame:
    """Clamp a fractional window (col_off, row_off, w, h) to whole source pixels.

    Adds col0, row0, col1, row1 (half-open); windows that miss the source are dropped.
    """
    left = F.greatest(F.floor("col_off"), F.lit(0))
    top = F.greatest(F.floor("row_off"), F.lit(0))
    right = F.least(F.ceil(F.col("col_off") + F.col("win_w")), F.col("width"))
    bottom = F.least(F.ceil(F.col("row_off") + F.col("win_h")), F.col("height"))
    return (
        grids.withColumn("col0", left.cast("bigint")).withColumn("row0", top.cast("bigint"))
        .withColumn("col1", right.cast("bigint")).withColumn("row1", bottom.cast("bigint"))
        .where((F.col("col1") > F.col("col0")) & (F.col("row1") > F.col("row0")))
    )


def clip_pixels(pixels: DataFrame, windows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pixels inside their scene's clamped window; equi-join on scene, range as a filter."""
    w = windows.select(*by, "row0", "row1", "col0", "col1")
    return pixels.join(w, list(by)).where(
        (F.col("row") >= F.col("row0")) & (F.col("row") < F.col("row1"))
        & (F.col("col") >= F.col("col0")) & (F.col("col") < F.col("col1"))
    ).drop("row0", "row1", "col0", "col1")


def coverage_percent(stats: DataFrame, valid: str, total: str) -> Column:
    """Valid share of a window's pixels; NULL when either side is unknown or empty."""
    return F.when(F.col(total) > 0, F.col(valid) / F.col(total) * 100.0)


def pair_dates(first: DataFrame, second: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Same pixel on two dates, valid in both; ``change`` is later minus earlier.

    Callers establish that the two grids are identical first (see ``geometry``).
    """
    a = first.where(F.col(index).isNotNull()).select(*keys, F.col(index).alias("first_value"))
    b = second.where(F.col(index).isNotNull()).select(*keys, F.col(index).alias("second_value"))
    return a.join(b, list(keys)).withColumn(
        "change", F.col("second_value") - F.col("first_value")
    )


def temporal_change(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, min, max and count of paired change; no row where nothing paired."""
    return pairs.groupBy(*by).agg(
        F.count("change").alias("paired_valid_pixel_count"),
        F.avg("change").alias("change_mean"),
        F.min("change").alias("change_min"),
        F.max("change").alias("change_max"),
    )


def value_percentiles(
    pixels: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float],
    buckets: int = 1024,
) -> DataFrame:
    """Exact linear-interpolation percentiles per group without sorting a whole group.

    Values are counted, counts are binned into ``buckets`` ranges of the group, and only
    the bins that hold a wanted rank are sorted. A hot group is spread over its bins.
    """
    by = list(by)
    counted = (
        pixels.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    span = counted.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_total")
    )
    share = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    binned = counted.join(span, by).withColumn(
        "_bin",
        F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int"),
    )
    from pyspark.sql import Window

    sizes = binned.groupBy(*by, "_bin", "_total").agg(F.sum("_n").alias("_bin_n"))
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("pos"))
        for i, p in enumerate(fractions)
    ])
    ends = F.explode(F.array(
        F.struct(F.lit(0).alias("hi"), F.floor("r.pos").cast("bigint").alias("rank")),
        F.struct(F.lit(1).alias("hi"), F.ceil("r.pos").cast("bigint").alias("rank")),
    ))
    wanted = (
        sizes.withColumn("_after", F.sum("_bin_n").over(upto))
        .withColumn("_before", F.col("_after") - F.col("_bin_n"))
        .withColumn("r", F.explode(ranks))
        .select(*by, "_bin", "_before", "_after", "r", ends.alias("e"))
        .where((F.col("e.rank") >= F.col("_before")) & (F.col("e.rank") < F.col("_after")))
        .select(*by, "_bin", "_before", F.col("r.i").alias("_i"), F.col("r.pos").alias("_pos"),
                F.col("e.hi").alias("_end"), F.col("e.rank").alias("_rank"))
    )
    within = Window.partitionBy(*by, "_bin").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    chosen = wanted.select(*by, "_bin").distinct()
    placed = (
        binned.select(*by, "_bin", "_v", "_n").join(chosen, [*by, "_bin"], "left_semi")
        .withColumn("_upto", F.sum("_n").over(within))
    )
    hits = placed.join(wanted, [*by, "_bin"]).where(
        (F.col("_rank") < F.col("_before") + F.col("_upto"))
        & (F.col("_rank") >= F.col("_before") + F.col("_upto") - F.col("_n"))
    )
    aggs = []
    for i, p in enumerate(fractions):
        low = F.max(F.when((F.col("_i") == i) & (F.col("_end") == 0), F.col("_v")))
        high = F.max(F.when((F.col("_i") == i) & (F.col("_end") == 1), F.col("_v")))
        pos = F.max(F.when(F.col("_i") == i, F.col("_pos")))
        name = f"p{round(p * 100):02d}"
        aggs.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return hits.groupBy(*by).agg(*aggs)


#: Pixels of a task where whole pictures are stretched, on average.
TASK_PIXELS = 1 << 17


def stretch_bounds(pixels: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """2nd and 98th percentiles (p02, p98) of the displayed values per group."""
    return value_percentiles(pixels, by, value, (0.02, 0.98))


def display_stretch(pixels: DataFrame, by: Sequence[str], value: str, valid: str) -> DataFrame:
    """Grey level 0..255 per pixel, in decibels where all valid samples are positive.

    Clipped to p02..p98, rounded half to even; a constant picture is 128, an invalid
    pixel is 0, and a group without a valid pixel is left out altogether.
    """
    by = list(by)
    ok = F.coalesce(F.col(valid), F.lit(False))
    scale = (
        pixels.where(ok).groupBy(*by).agg((F.min(value) > 0).alias("_log"))
    )
    shown = F.when(ok, F.when(F.col("_log"), F.lit(10.0) * F.log10(
        F.when(F.col(value) > 0, F.col(value)))).otherwise(F.col(value).cast("double")))
    # every later step keeps this dealing by group, so a task holds as many pixels whatever the input's size
    tasks = max(1, -(-pixels.count() // TASK_PIXELS))
    ready = pixels.repartition(tasks, *by).join(scale.repartition(tasks, *by), by).withColumn("_shown", shown)
    bounds = stretch_bounds(ready, by, "_shown")
    clipped = F.least(F.greatest(F.col("_shown"), F.col("p02")), F.col("p98"))
    level = F.when(~ok, F.lit(0)).when(F.col("p98") <= F.col("p02"), F.lit(128)).otherwise(
        F.rint(F.try_divide(clipped - F.col("p02"), F.col("p98") - F.col("p02")) * 255.0)
    )
    return (
        ready.join(bounds, by).withColumn("level", level.cast("int"))
        .drop("_log", "_shown", "p02", "p98")
    )
