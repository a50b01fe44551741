"""Pixel arithmetic: validity, indices, comparisons, colour ramps, decibels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Index registry, (numerator band, other band).
INDICES: dict[str, tuple[str, str]] = {
    "ndwi": ("green", "nir"),
    "ndvi": ("nir", "red"),
    "ndbi": ("swir16", "nir"),
}

# Fixed value: the "percent above" cut-off reported for NDWI.
NDWI_INDEX_THRESHOLD = 0.3


def finite(value: Column) -> Column:
    v = value.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def band_valid(value: Column, nodata: Column | None = None) -> Column:
    """Finite and not the declared nodata; an undeclared or non-finite nodata masks nothing."""
    ok = finite(value)
    if nodata is None:
        return ok
    return ok & (~finite(nodata) | (value.cast("double") != nodata.cast("double")))


def pair_valid(a: Column, b: Column, a_valid: Column, b_valid: Column) -> Column:
    """Pixels where ``(a-b)/(a+b)`` is defined. A zero numerator is data."""
    total = a.cast("double") + b.cast("double")
    return F.coalesce(
        a_valid & b_valid & finite(a) & finite(b) & finite(total) & (total != 0.0), F.lit(False)
    )


def normalized_difference(high: Column, low: Column) -> Column:
    hi, lo = high.cast("double"), low.cast("double")
    return F.try_divide(hi - lo, hi + lo)


def bands_for(keys: list[str]) -> list[str]:
    """Distinct bands of several indices in first-seen order; unknown index refused."""
    seen: dict[str, None] = {}
    for key in keys:
        if key not in INDICES:
            raise ValueError(f"unknown index {key!r}")
        for band in INDICES[key]:
            seen.setdefault(band)
    return list(seen)


def compare(value: Column, operator: str, threshold: float) -> Column:
    """Exact comparison; NaN matches nothing. The threshold lies in [-1, 1]."""
    if not -1.0 <= threshold <= 1.0:
        raise ValueError("threshold must lie in [-1, 1]")
    t = F.lit(float(threshold))
    if operator == "gt":
        hit = value > t
    elif operator == "gte":
        hit = value >= t
    elif operator == "lt":
        hit = value < t
    elif operator == "lte":
        hit = value <= t
    else:
        raise ValueError(f"unknown comparison {operator!r}")
    return hit & ~F.isnan(value)


# Scene-classification class -> quality category (usable = 4, 5, 6).
SCL_CATEGORIES: dict[str, tuple[int, ...]] = {
    "saturated_or_defective": (1,),
    "cloud": (8, 9, 10),
    "cloud_shadow": (3,),
    "snow": (11,),
    "other_masked": (2, 7),
}
USABLE_SCL = (4, 5, 6)
QUALITY_ORDER = (
    "nodata", "saturated_or_defective", "cloud", "cloud_shadow", "snow",
    "unknown_class", "other_masked",
)


def scl_category(scl: Column, band_ok: Column, has_class: Column | None = None) -> Column:
    """One category per pixel. ``usable`` marks a clear surface; nodata wins over all."""
    known = scl.isNotNull() if has_class is None else (has_class & scl.isNotNull())
    chain = F.when(~F.coalesce(band_ok & known, F.lit(False)) | (scl == 0), F.lit("nodata"))
    for category, classes in SCL_CATEGORIES.items():
        chain = chain.when(scl.isin(*classes), F.lit(category))
    return chain.when(scl.isin(*USABLE_SCL), F.lit("usable")).otherwise(F.lit("unknown_class"))


def valid_power(value: Column, valid: Column) -> Column:
    """Strictly positive finite samples: the only ones with a decibel value."""
    return F.coalesce(valid & finite(value) & (value.cast("double") > 0.0), F.lit(False))


def to_db(power: Column) -> Column:
    """``10*log10``; NULL for anything not strictly positive, never clamped."""
    return F.when(power > 0.0, F.lit(10.0) * F.log10(power))


def _ramp(value: Column) -> Column:
    return F.least(F.greatest((value + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0))


def index_rgba(value: Column, valid: Column) -> Column:
    """Fixed linear ramp over [-1, 1]; truncated to bytes, alpha 200 or 0."""
    t = _ramp(value)
    return F.struct(
        ((F.lit(1.0) - t) * 214).cast("int").alias("r"),
        (F.lit(60) + (F.lit(1.0) - t) * 120).cast("int").alias("g"),
        (F.lit(40) + t * 215).cast("int").alias("b"),
        F.when(valid, 200).otherwise(0).alias("a"),
    )


def change_rgba(change: Column, paired: Column) -> Column:
    """Diverging ramp centred on no change; unpaired pixels are transparent."""
    t = _ramp(change)
    return F.struct(
        (F.lit(215) - t * 175).cast("int").alias("r"),
        (F.lit(120) - F.abs(t - 0.5) * 120).cast("int").alias("g"),
        (F.lit(40) + t * 175).cast("int").alias("b"),
        F.when(paired, 200).otherwise(0).alias("a"),
    )
