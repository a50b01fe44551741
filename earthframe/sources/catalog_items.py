"""Raw catalog items (JSON text) -> normalised scenes, keeping unknown apart from wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.functions.boxes import valid_bbox
from earthframe.functions.rules import lookup

# Curated assets and thumbnail preference, in order.
ASSET_KEYS = ("thumbnail", "overview", "visual", "granule_metadata", "tileinfo_metadata",
              "vv", "vh", "hh", "hv")
THUMBNAIL_KEYS = ("thumbnail", "overview", "rendered_preview", "preview")

# Processing level implied by the collection.
LEVEL_OF_COLLECTION = {
    "sentinel-1-rtc": "RTC (provider terrain-corrected gamma naught)",
    "sentinel-1-grd": "GRD (uncalibrated radar geometry)",
    "sentinel-2-l2a": "L2A",
    "sentinel-2-l1c": "L1C",
}


def parse_items(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Add ``item``: the JSON as VARIANT, NULL when it is not JSON."""
    return raw.withColumn("item", F.try_parse_json(text))


def path(*parts: str | int) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in parts)


def kind(item: Column, *parts: str | int) -> Column:
    """Type name of the value at a path (STRING, BIGINT, OBJECT...), NULL when absent."""
    return F.schema_of_variant(F.try_variant_get(item, path(*parts), "variant"))


def text_at(item: Column, *parts: str | int) -> Column:
    """A non-empty string at a path, else NULL; numbers are not turned into text."""
    value = F.when(kind(item, *parts) == "STRING",
                   F.try_variant_get(item, path(*parts), "string"))
    return F.when(value != "", value)


def number_at(item: Column, *parts: str | int) -> Column:
    """A finite JSON number at a path, else NULL; strings and booleans are not numbers."""
    is_number = kind(item, *parts).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(is_number, F.try_variant_get(item, path(*parts), "double"))


def flag_at(item: Column, *parts: str | int) -> Column:
    """true / false / absent / unparseable for a published boolean."""
    k = kind(item, *parts)
    value = F.try_variant_get(item, path(*parts), "string")
    return (
        F.when(k.isNull(), "absent").when((k == "BOOLEAN") & (value == "true"), "true")
        .when(k == "BOOLEAN", "false").otherwise("unparseable")
    )


def texts_at(item: Column, *parts: str | int) -> Column:
    """A non-empty array of strings at a path, else NULL."""
    value = F.when(kind(item, *parts) == "ARRAY<STRING>",
                   F.try_variant_get(item, path(*parts), "array<string>"))
    return F.when(F.size(value) > 0, value)


def processing_level(level: Column, collection: Column) -> Column:
    """The stated processing level, else the one the collection implies, else NULL."""
    stated = F.when(level != "", level)
    return F.coalesce(stated, lookup(LEVEL_OF_COLLECTION, collection))


def with_processing_level(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "processing_level", processing_level(F.col("processing_level"), F.col("collection")))


def _bbox(item: Column) -> Column:
    w, s, e, n = (number_at(item, "bbox", i) for i in range(4))
    box = F.struct(w.alias("west"), s.alias("south"), e.alias("east"), n.alias("north"))
    return F.when(valid_bbox(box), box)


def _asset(item: Column, key: str) -> Column:
    href = text_at(item, "assets", key, "href")
    return F.when(href.isNotNull(), F.struct(
        F.lit(key).alias("key"), href.alias("href"),
        text_at(item, "assets", key, "type").alias("type"),
        text_at(item, "assets", key, "title").alias("title"),
        texts_at(item, "assets", key, "roles").alias("roles"),
    ))


def normalize_scenes(raw: DataFrame, text: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(scenes, rejects). Only an unusable id rejects an item; any other field turns NULL."""
    parsed = parse_items(raw, text).withColumn("id", text_at(F.col("item"), "id"))
    item = F.col("item")
    good = parsed.where(F.col("id").isNotNull())
    collection = text_at(item, "collection")
    # A JSON boolean counts as a number for cloud cover (true is 1), as it does upstream.
    cloud_kind = kind(item, "properties", "eo:cloud_cover")
    cloud = F.coalesce(
        number_at(item, "properties", "eo:cloud_cover"),
        F.when(cloud_kind == "BOOLEAN", F.try_variant_get(
            item, path("properties", "eo:cloud_cover"), "boolean").cast("int").cast("double")),
    )
    thumbnail = F.coalesce(*[text_at(item, "assets", k, "href") for k in THUMBNAIL_KEYS])
    scenes = good.select(
        "id", text_at(item, "properties", "datetime").alias("datetime"),
        collection.alias("collection"), _bbox(item).alias("bbox"),
        F.when(kind(item, "geometry").startswith("OBJECT"),
               F.to_json(F.try_variant_get(item, path("geometry"), "variant"))).alias("geometry"),
        cloud.alias("cloud_cover"), text_at(item, "properties", "platform").alias("platform"),
        processing_level(text_at(item, "properties", "processing:level"), collection)
        .alias("processing_level"),
        thumbnail.alias("thumbnail_url"),
        F.array_compact(F.array(*[_asset(item, k) for k in ASSET_KEYS])).alias("assets"),
        texts_at(item, "properties", "sar:polarizations").alias("sar_polarizations"),
        text_at(item, "properties", "sar:instrument_mode").alias("sar_instrument_mode"),
        text_at(item, "properties", "sat:orbit_state").alias("orbit_state"),
    )
    rejects = parsed.where(F.col("id").isNull()).withColumn(
        "reason", F.when(item.isNull() | ~kind(item).startswith("OBJECT"), "malformed scene")
        .otherwise("scene without an id")).drop("item", "id")
    return scenes, rejects
