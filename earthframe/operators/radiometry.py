"""Whether the numbers of a scene's bands may be used as they are, from metadata alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.functions.rules import notes

# Fixed value: first processing baseline whose pixels carry an additive offset.
OFFSET_INTRODUCED_BASELINE = (4, 0)
# Unit spellings.
DECIBEL_UNITS = ("db", "decibel", "decibels")
LINEAR_POWER_UNITS = ("1", "linear", "power")
CATEGORICAL_ASSETS = ("scl",)
ENCODING_FIELDS = ("data_type", "scale", "offset", "unit")

_BASELINE = r"^(\d{2})\.(\d{2})$"


def parse_baseline(text: Column) -> Column:
    """``"05.11"`` -> struct(5, 11); anything else NULL."""
    t = F.trim(text)
    return F.when(t.rlike(_BASELINE), F.struct(
        F.regexp_extract(t, _BASELINE, 1).cast("int").alias("major"),
        F.regexp_extract(t, _BASELINE, 2).cast("int").alias("minor")))


def offset_state(baseline: Column, flag: Column) -> Column:
    """State of the additive offset from the baseline text and the flag as published."""
    parsed = parse_baseline(baseline)
    first = F.struct(F.lit(OFFSET_INTRODUCED_BASELINE[0]).alias("major"),
                     F.lit(OFFSET_INTRODUCED_BASELINE[1]).alias("minor"))
    carries = F.coalesce(parsed >= first, F.lit(False))
    return (
        F.when((flag == "true") & carries, "removed_by_provider")
        .when(flag == "true", "contradictory").when(~carries, "not_introduced")
        .when(flag == "false", "not_removed").when(flag == "absent", "not_published")
        .otherwise("unparseable")
    )


def offset_undetermined(baseline: Column, flag: Column, nonzero_offset: Column) -> Column:
    """Why the values are not established offset-free, or NULL when they are."""
    state = offset_state(baseline, flag)
    return (
        F.when(parse_baseline(baseline).isNull(), "baseline_unreadable")
        .when(state == "removed_by_provider", None)
        .when((state == "not_introduced") & nonzero_offset, "offset_declared_before_introduction")
        .when(state == "not_introduced", None).otherwise(state)
    )


def sar_encoding_problem(key: Column, unit: Column, scale: Column, offset: Column) -> Column:
    """Reasons an asset is not linear power as read; empty when nothing speaks against it."""
    u = F.lower(F.trim(unit))
    relative = F.abs(scale - 1.0) <= 1e-9 * F.greatest(F.abs(scale), F.lit(1.0))
    return notes([
        (u.isin(*DECIBEL_UNITS), F.concat(key, F.lit(": declared in decibels"))),
        (~u.isin(*DECIBEL_UNITS, *LINEAR_POWER_UNITS),
         F.concat(key, F.lit(": unit is not linear power"))),
        (~relative, F.concat(key, F.lit(": scale is not 1"))),
        (offset != 0.0, F.concat(key, F.lit(": offset is not 0"))),
    ])


def assess_radiometry(assets: DataFrame) -> DataFrame:
    """One state per (scene_id, analysis) over the assets it would read.

    Input: scene_id, analysis, modality, baseline, flag, pos, key and the declared encoding
    (data_type, scale, offset, unit), NULL where undeclared. A declared field disagrees when
    its minimum differs from its maximum, so no distinct set is built. incompatible beats
    undetermined beats verified_with_unknown_metadata beats verified.
    """
    radiometric = assets.where(~F.col("key").isin(*CATEGORICAL_ASSETS))
    unknown = notes([
        (F.col(f).isNull(), F.concat(F.col("key"), F.lit(f".{f}"))) for f in ENCODING_FIELDS])
    sar = F.col("modality") == "sentinel-1-sar"
    per = radiometric.groupBy("scene_id", "analysis", "modality", "baseline", "flag").agg(
        F.min("scale").alias("scale_min"), F.max("scale").alias("scale_max"),
        F.min("unit").alias("unit_min"), F.max("unit").alias("unit_max"),
        F.coalesce(F.bool_or(F.col("offset") != 0.0), F.lit(False)).alias("nonzero_offset"),
        F.array_sort(F.collect_list(F.struct("pos", unknown.alias("u")))).alias("_unknown"),
        F.array_sort(F.collect_list(F.struct("pos", F.when(sar, sar_encoding_problem(
            F.col("key"), F.col("unit"), F.col("scale"), F.col("offset"))).alias("p"))))
        .alias("_sar"),
    )
    sar_reasons = F.flatten(F.array_compact(F.transform("_sar", lambda s: s["p"])))
    optical_reasons = notes([
        (F.col("scale_min") != F.col("scale_max"), "the bands declare different scales"),
        (F.col("unit_min") != F.col("unit_max"), "the bands declare different units"),
    ])
    out = per.select(
        "scene_id", "analysis", "modality", "baseline", "flag", "scale_min", "scale_max",
        "unit_min", "unit_max", "nonzero_offset",
        F.flatten(F.transform("_unknown", lambda s: s["u"])).alias("unknown_fields"),
        F.when(sar, sar_reasons).otherwise(optical_reasons).alias("incompatible"),
        F.when(sar, "not_applicable").otherwise(
            offset_state(F.col("baseline"), F.col("flag"))).alias("offset_state"),
        F.when(~sar, offset_undetermined(
            F.col("baseline"), F.col("flag"), F.col("nonzero_offset"))).alias("undetermined"),
    )
    conflict = ~sar & (F.col("offset_state") == "removed_by_provider") & F.col("nonzero_offset")
    status = (
        F.when(F.size("incompatible") > 0, "incompatible")
        .when(F.col("undetermined").isNotNull(), "undetermined")
        .when((F.size("unknown_fields") > 0) | conflict, "verified_with_unknown_metadata")
        .otherwise("verified")
    )
    usable = F.col("status").isin("verified", "verified_with_unknown_metadata")
    return out.withColumn("status", status).withColumn("representation", F.when(
        usable, F.when(sar, "linear power, read as-is").otherwise(
            "digital numbers proportional to reflectance, no additive offset")))


def radiometric_pair_problem(a: Column, b: Column) -> Column:
    """Why two assessments (structs of :func:`assess_radiometry`) may not be compared."""
    def differ(field: str) -> Column:
        return F.least(a[f"{field}_min"], b[f"{field}_min"]) != F.greatest(
            a[f"{field}_max"], b[f"{field}_max"])

    return F.coalesce(
        F.when(a["representation"].isNull() | b["representation"].isNull(), "not_established"),
        F.when(a["representation"] != b["representation"], "different_representations"),
        F.when(differ("scale"), "different_scales"), F.when(differ("unit"), "different_units"),
    )


def shared_scale_problem(a: Column, b: Column) -> Column:
    """Whether two declared scales break a ratio; an undeclared scale is not different."""
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), "scales_differ")


def summary_line(label: Column, state: Sequence[str] | None = None) -> Column:
    """One citable line of an assessment row."""
    return F.concat(
        label, F.lit(" radiometric state: "), F.col("status"), F.lit(" - "),
        F.coalesce("representation", F.lit("none")), F.lit(". Processing baseline "),
        F.coalesce("baseline", F.lit("not published")), F.lit("; reflectance offset "),
        F.translate("offset_state", "_", " "), F.lit("; declared scale "),
        F.coalesce(F.col("scale_min").cast("string"), F.lit("not declared")), F.lit("; unit "),
        F.coalesce("unit_min", F.lit("not declared")), F.lit("; source: the catalog item."),
    )
