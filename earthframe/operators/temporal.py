"""Pairs of acquisitions: what they share, what they do not, and one aggregate difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earthframe.functions.boxes import bbox_relation
from earthframe.functions.rules import first_failure, notes
from earthframe.functions.times import instant_micros, separation_days, zone_aware

# Fixed value: relative tolerance under which two resolutions are the same.
RESOLUTION_REL_TOL = 1e-6
# Fixed value: scene cloud cover above which statistics carry a warning.
HIGH_CLOUD_COVER = 30.0

# Statements of what a compatibility report does not establish.
LIMITS = {
    "metadata_only": (
        "This report is derived from metadata only: no raster was opened, no pixel grid was "
        "inspected, and no co-registration was performed."),
    "not_evaluated": (
        "co_registration_status is 'not_evaluated': matching CRS, resolution, footprint or "
        "modality do not establish co-registration, which requires pixel-grid alignment that "
        "this phase does not perform."),
    "cross_modal": (
        "co_registration_status is 'not_supported_cross_modal': Sentinel-1 and Sentinel-2 "
        "observations are not geometrically comparable without SAR terrain correction, which "
        "this system does not perform."),
    "crs_unknown": (
        "CRS could not be determined: a Scene carries no CRS, and bounded imagery was not "
        "retrieved for both observations."),
    "crs_known": (
        "CRS was compared lexically between the strings reported by retrieved display imagery; "
        "that is not a geometric equivalence proof, and the value describes the display asset "
        "actually retrieved rather than any band a later analysis would read."),
    "resolution_unknown": (
        "Resolution could not be determined: a Scene carries no ground sample distance, and "
        "bounded imagery was not retrieved for both observations."),
    "resolution_known": (
        "Resolution describes the display asset actually retrieved, not any band a later "
        "analysis would read, and is the source ground sample distance rather than the "
        "delivered pixel size."),
    "processing_known": (
        "processing_level may be derived from the STAC collection name rather than read from "
        "the item, so it does not describe the processing baseline; scenes built from "
        "different baselines can report the same level."),
    "processing_unknown": "processing_level was unavailable for at least one observation.",
    "temporal_unknown": (
        "At least one acquisition time is absent or unparseable, so the temporal separation "
        "was not computed."),
    "temporal_mixed": (
        "The acquisition times mix time zone-aware and naive values, so the temporal "
        "separation was not computed rather than assume a time zone."),
    "bbox_unknown": (
        "At least one scene footprint is absent, so bounding-box overlap could not be "
        "determined."),
    "bbox_known": (
        "Bounding-box overlap is a coarse WGS84 relation between whole-scene footprints, not "
        "the analysed AOI, and is not an area measurement."),
}


def pair_observations(obs: DataFrame, by: tuple[str, ...] = ("request_id", "modality")
                      ) -> tuple[DataFrame, DataFrame]:
    """(pairs, failures): each observation with the next one acquired.

    Order: known times first, time (a naive one counts as UTC for order only), label, scene.
    Groups are the windows of one request (at most 24), so the window stays small whatever
    the number of requests. Groups of one are reported, not dropped.
    """
    fields = [c for c in obs.columns if c not in by]
    micros = instant_micros(F.col("datetime"))
    group = Window.partitionBy(*by)
    ordered = group.orderBy(micros.isNull(), micros, "label", "id")
    me = obs.select(*by, F.struct(*fields).alias("first"),
                    F.lead(F.struct(*fields)).over(ordered).alias("second"),
                    F.count(F.lit(1)).over(group).alias("_n"))
    pairs = me.where(F.col("second").isNotNull()).drop("_n")
    failures = me.where(F.col("_n") < 2).select(*by, F.format_string(
        "Only 1 %s observation is available; at least two are needed to form a pair.",
        F.col("modality")).alias("reason"))
    return pairs, failures


def match_text(a: Column, b: Column) -> Column:
    """same / different / unknown after trimming and case folding; blank is unknown."""
    left, right = F.lower(F.trim(a)), F.lower(F.trim(b))
    known = (left != "") & (right != "")
    return F.when(known & (left == right), "same").when(known, "different").otherwise("unknown")


def match_resolution(a: Column, b: Column) -> Column:
    inf = F.lit(float("inf"))
    known = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < inf) & (F.abs(b) < inf)
    close = F.abs(a - b) <= RESOLUTION_REL_TOL * F.greatest(F.abs(a), F.abs(b))
    return F.when(known & close, "same").when(known, "different").otherwise("unknown")


def compatibility(pairs: DataFrame) -> DataFrame:
    """Add what each pair (structs ``first``/``second``) demonstrably shares.

    Symmetric in its match fields. Structs carry modality, datetime, bbox, crs, resolution
    and processing_level; crs and resolution are NULL where no imagery was retrieved.
    """
    a, b = F.col("first"), F.col("second")
    same = a["modality"] == b["modality"]
    mixed = zone_aware(a["datetime"]) != zone_aware(b["datetime"])
    return (
        pairs.withColumn("same_modality", same)
        .withColumn("co_registration_status", F.when(same, "not_evaluated")
                    .otherwise("not_supported_cross_modal"))
        .withColumn("separation_days", separation_days(a["datetime"], b["datetime"]))
        .withColumn("mixed_zones", F.coalesce(mixed, F.lit(False)))
        .withColumn("bbox_overlap", bbox_relation(a["bbox"], b["bbox"]))
        .withColumn("crs_match", match_text(a["crs"], b["crs"]))
        .withColumn("resolution_match", match_resolution(a["resolution"], b["resolution"]))
        .withColumn("processing_level_match",
                    match_text(a["processing_level"], b["processing_level"]))
    )


def limitations() -> Column:
    """Fixed-order statements chosen by the fields of a compatibility row."""
    unknown = {n: F.col(c) == "unknown" for n, c in (
        ("crs", "crs_match"), ("resolution", "resolution_match"),
        ("processing", "processing_level_match"), ("bbox", "bbox_overlap"))}
    return notes([
        (F.lit(True), LIMITS["metadata_only"]),
        (F.col("same_modality"), LIMITS["not_evaluated"]),
        (~F.col("same_modality"), LIMITS["cross_modal"]),
        (unknown["crs"], LIMITS["crs_unknown"]), (~unknown["crs"], LIMITS["crs_known"]),
        (unknown["resolution"], LIMITS["resolution_unknown"]),
        (~unknown["resolution"], LIMITS["resolution_known"]),
        (unknown["processing"], LIMITS["processing_unknown"]),
        (~unknown["processing"], LIMITS["processing_known"]),
        (F.col("mixed_zones"), LIMITS["temporal_mixed"]),
        (~F.col("mixed_zones") & F.col("separation_days").isNull(), LIMITS["temporal_unknown"]),
        (unknown["bbox"], LIMITS["bbox_unknown"]), (~unknown["bbox"], LIMITS["bbox_known"]),
    ])


def difference_suppressed() -> Column:
    """The one reason a mean difference is withheld, checked in a fixed order."""
    a, b = F.col("first"), F.col("second")
    return first_failure([
        (a["mean"].isNull() | b["mean"].isNull(), "no_mean"),
        (F.col("bbox_overlap") == "none", "no_overlap"),
        (a["id"] == b["id"], "same_scene"),
    ])


def mean_difference(pairs: DataFrame) -> DataFrame:
    """Later mean minus earlier mean, or NULL with the reason it was suppressed."""
    return pairs.withColumn("suppressed", difference_suppressed()).withColumn(
        "mean_ndwi_difference",
        F.when(F.col("suppressed").isNull(), F.col("second.mean") - F.col("first.mean")))


# Caveats of the aggregate comparison.
WARN_AGGREGATE = (
    "mean_ndwi_difference is the difference between two independently computed aggregate "
    "statistics, each summarising its own set of pixels. This value compares no pixel with "
    "another; it describes the two statistics only.")
WARN_SUPPRESSED = {
    "no_mean": ("At least one observation has no valid pixels and therefore no mean NDWI, so "
                "no difference was computed."),
    "no_overlap": ("The two scene footprints do not overlap, so the two sets of statistics "
                   "describe separate areas and no difference was computed."),
}
WARN_PARTIAL = ("The two scene footprints overlap only partially, so the two sets of statistics "
                "summarise different sets of pixels.")


def temporal_warnings() -> Column:
    """Ordered warnings of a pair: aggregate, suppression, overlap, coverage, grid, cloud, sample.

    Needs ``suppressed`` and ``bbox_overlap``; sides carry label, id, mean, valid_pixels,
    window_pixels, crs, resolution and cloud_cover.
    """
    a, b = F.col("first"), F.col("second")

    def quoted(side: Column) -> Column:
        return F.concat(F.lit("'"), side["label"], F.lit("'"))

    def coverage(side: Column) -> Column:
        return F.format_string(
            "%s analysed %d valid of %d AOI pixels (%.1f%%)", quoted(side), side["valid_pixels"],
            side["window_pixels"],
            side["valid_pixels"] / F.nullif(side["window_pixels"], F.lit(0)) * 100.0)

    measured = (
        (a["window_pixels"] > 0) & (b["window_pixels"] > 0)
        & a["valid_pixels"].isNotNull() & b["valid_pixels"].isNotNull())
    grids_known = a["crs"].isNotNull() & b["crs"].isNotNull()
    same_grid = (a["crs"] == b["crs"]) & a["resolution"].eqNullSafe(b["resolution"])

    def cloud(side: Column) -> list[tuple[Column, Column]]:
        return [
            (side["cloud_cover"].isNull(), F.format_string(
                "Observation %s reports no scene cloud cover metadata, so its scene-level cloud "
                "cover is unknown; its usable pixels are stated by the scene classification mask "
                "alone.", quoted(side))),
            (side["cloud_cover"] > HIGH_CLOUD_COVER, F.concat(
                F.lit("Observation "), quoted(side), F.lit(" reports "),
                side["cloud_cover"].cast("string"),
                F.lit("% scene cloud cover. Pixels the scene classification marks as cloud, cloud "
                      "shadow or snow were excluded, but that classification is not perfect, so "
                      "residual cloud may remain in the statistics."))),
        ]

    def sample(side: Column) -> tuple[Column, Column]:
        return (side["valid_pixels"] == 1, F.format_string(
            "Observation %s has only %d valid pixel(s), so its statistics are not meaningful.",
            quoted(side), side["valid_pixels"]))

    return notes([
        (F.lit(True), WARN_AGGREGATE),
        (F.col("suppressed") == "no_mean", WARN_SUPPRESSED["no_mean"]),
        (F.col("suppressed") == "no_overlap", WARN_SUPPRESSED["no_overlap"]),
        (F.col("suppressed") == "same_scene", F.format_string(
            "Both observations resolved to the same scene '%s', so a difference would be "
            "trivially zero and none was computed.", a["id"])),
        (F.col("bbox_overlap") == "partial", WARN_PARTIAL),
        (measured, F.concat(
            F.lit("Equal AOI coverage is NOT established: "), coverage(a), F.lit("; "), coverage(b),
            F.lit(". Scene footprint overlap does not establish equal coverage, and the two means "
                  "summarise different samples."))),
        (grids_known & same_grid, F.concat(
            F.lit("Both observations were read in "), a["crs"], F.lit(" at "),
            a["resolution"].cast("string"), F.lit(" m/px."))),
        (grids_known & ~same_grid, F.concat(
            F.lit("The two observations were read on different grids ("), a["crs"], F.lit(" at "),
            a["resolution"].cast("string"), F.lit(" m/px versus "), b["crs"], F.lit(" at "),
            b["resolution"].cast("string"),
            F.lit(" m/px); nothing was reprojected or aligned, so each statistic summarises its "
                  "own grid."))),
        *cloud(a), *cloud(b), sample(a), sample(b),
    ])


# What each quality category is called in a note.
QUALITY_LABELS = {
    "nodata": "no data", "saturated_or_defective": "saturated or defective", "cloud": "cloud",
    "cloud_shadow": "cloud shadow", "snow": "snow or ice",
    "unknown_class": "undocumented SCL class",
    "other_masked": "other (cast shadow or unclassified)",
}


def quality_notes() -> Column:
    """Fixed-order statements of a pixel-quality row (see ``pixels.pixel_quality``).

    Also reads unknown_scl_values, unclassified_pixels and metadata_status.
    """
    total, valid = F.col("total_pixels"), F.col("valid_pixels")
    masked = total - valid
    parts = F.array_join(notes([
        (F.col(f"{c}_pixels") > 0, F.concat(F.lit(f"{label} "), F.col(f"{c}_pixels").cast("string")))
        for c, label in QUALITY_LABELS.items()]), ", ")
    unknown = F.array_join(F.transform("unknown_scl_values", lambda v: v.cast("string")), ", ")
    some = total > 0
    return notes([
        (~some, "The analysis grid has no pixels, so no fraction is reported."),
        (some & (valid == 0), F.format_string(
            "No pixel was usable: all %d pixels of the analysis grid were masked, so no index "
            "statistic was computed.", total)),
        (some & (masked > 0), F.format_string(
            "%d of %d pixels were excluded before any statistic was computed (%s).",
            masked, total, parts)),
        (some & (F.col("unclassified_pixels") > 0), F.format_string(
            "%d pixels had no value in the scene classification layer and were excluded as no "
            "data.", F.col("unclassified_pixels"))),
        (some & (F.size("unknown_scl_values") > 0), F.format_string(
            "The scene classification layer contains values outside the documented SCL classes "
            "0-11 (%s); those %d pixels were excluded, never treated as clear.",
            unknown, F.col("unknown_class_pixels"))),
        (some & (F.col("metadata_status") == "unknown"),
         "The catalog publishes no raster metadata for the SCL asset, so its encoding was taken "
         "from the documented SCL classes rather than confirmed from the scene."),
        (some & (F.col("metadata_status") == "not_validated"),
         "The SCL asset was not validated against its catalog item, so its encoding was taken "
         "from the documented SCL classes."),
    ])
