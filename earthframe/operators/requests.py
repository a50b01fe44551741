"""Validation of analysis requests in bulk: first failing rule per request, fixed order."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.functions import boxes as X
from earthframe.functions.rules import first_failure, let, lookup
from earthframe.functions.urls import valid_identifier
from earthframe.sources.catalog_items import kind, number_at, path

# Recognised operations, the family each reads, and which have an engine.
OPERATION_FAMILY = {
    "ndvi": "sentinel-2-optical", "ndwi": "sentinel-2-optical", "ndbi": "sentinel-2-optical",
    "sar_backscatter": "sentinel-1-sar", "temporal_ndwi": "sentinel-2-optical",
    "temporal_ndvi": "sentinel-2-optical", "temporal_ndbi": "sentinel-2-optical",
}
NOT_IMPLEMENTED = ("temporal_ndvi", "temporal_ndbi")
TEMPORAL = ("temporal_ndwi", "temporal_ndvi", "temporal_ndbi")
# Served collections and their family; the one each family is measured from.
DATASET_FAMILY = {
    "sentinel-2-l2a": "sentinel-2-optical", "sentinel-1-grd": "sentinel-1-sar",
    "sentinel-1-rtc": "sentinel-1-sar",
}
MEASURED_FROM = {"sentinel-2-optical": "sentinel-2-l2a", "sentinel-1-sar": "sentinel-1-rtc"}
# Accepted spellings of the one CRS, GeoJSON types, field names.
WGS84_NAMES = ("EPSG:4326", "OGC:CRS84", "urn:ogc:def:crs:OGC:1.3:CRS84",
               "urn:ogc:def:crs:EPSG::4326")
GEOJSON_TYPES = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon",
                 "MultiPolygon", "GeometryCollection")
REQUEST_KEYS = ("operation", "dataset", "aoi", "time_window", "date1", "date2", "parameters")
AOI_KEYS = ("bbox", "geometry", "crs")
OBSERVATION_KEYS = ("start_date", "end_date", "scene_id")
PARAMETER_KEYS = ("resolution", "resampling", "polarizations", "max_cloud_cover")
# First day any observation exists; grace for a start date ahead of today.
EARLIEST_OBSERVATION = date(2014, 10, 3)
FUTURE_GRACE_DAYS = 1

BOX_TYPE = "struct<west:double,south:double,east:double,north:double>"


def _present(item: Column, *parts: str | int) -> Column:
    return ~F.coalesce(kind(item, *parts), F.lit("VOID")).eqNullSafe("VOID")


def _is(item: Column, prefix: str, *parts: str | int) -> Column:
    return F.coalesce(kind(item, *parts).startswith(prefix), F.lit(False))


def _text(item: Column, *parts: str | int) -> Column:
    return F.when(kind(item, *parts) == "STRING",
                  F.try_variant_get(item, path(*parts), "string"))


def _unknown_keys(item: Column, allowed: tuple[str, ...], *parts: str | int) -> Column:
    keys = F.map_keys(F.try_variant_get(item, path(*parts), "map<string,variant>"))
    return F.coalesce(
        F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) > 0, F.lit(False))


def box_problem(item: Column, *parts: str) -> Column:
    """Code for a ``[west, south, east, north]`` value, NULL when it is a usable box."""
    size = F.size(F.try_variant_get(item, path(*parts), "array<variant>"))

    def judged(v: Column) -> Column:
        w, s, e, n = v["west"], v["south"], v["east"], v["north"]
        in_range = (
            w.between(-180, 180) & e.between(-180, 180)
            & s.between(-90, 90) & n.between(-90, 90))
        return first_failure([
            (w.isNull() | s.isNull() | e.isNull() | n.isNull() | ~in_range, "aoi_invalid"),
            ((w == e) | (s == n), "aoi_empty"),
            ((w > e) | (s > n), "aoi_invalid"),
        ])

    return first_failure([
        (~_is(item, "ARRAY", *parts) | ~F.coalesce(size == 4, F.lit(False)), "aoi_invalid"),
        let(X.bbox(*[number_at(item, *parts, i) for i in range(4)]), judged),
    ])


def rectangle(ring: Column) -> Column:
    """Struct ``{code, box}`` of one polygon ring (array<array<double>>).

    Accepted only when it is exactly an axis-aligned rectangle; never enveloped or repaired.
    """
    def x_of(p: Column) -> Column:
        return F.get(p, F.lit(0))

    def y_of(p: Column) -> Column:
        return F.get(p, F.lit(1))

    def measured(r: Column) -> Column:
        vertices = F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))
        return let(vertices, lambda v: F.struct(
            v.alias("v"), F.size(r).alias("n"),
            (F.get(r, F.lit(0)) == F.element_at(r, -1)).alias("closed"),
            F.forall(r, lambda p: (F.size(p) == 2) & x_of(p).between(-180, 180)
                     & y_of(p).between(-90, 90)).alias("positions_ok"),
            F.array_sort(F.array_distinct(F.transform(v, x_of))).alias("xs"),
            F.array_sort(F.array_distinct(F.transform(v, y_of))).alias("ys"),
            F.transform(v, lambda p, i: F.struct(
                p.alias("p"), F.get(v, F.pmod(i + 1, F.size(v))).alias("q"))).alias("edges"),
        ))

    def judged(m: Column) -> Column:
        corner_set = (
            (F.size(m["v"]) == 4) & (F.size(m["xs"]) == 2) & (F.size(m["ys"]) == 2)
            & (F.size(F.array_distinct(m["v"])) == 4))
        axis_aligned = F.forall(m["edges"], lambda e: (
            (x_of(e["p"]) == x_of(e["q"])) != (y_of(e["p"]) == y_of(e["q"]))))
        area = F.aggregate(m["edges"], F.lit(0.0), lambda acc, e: acc + (
            x_of(e["p"]) * y_of(e["q"]) - x_of(e["q"]) * y_of(e["p"])))
        code = first_failure([
            (~F.coalesce(m["positions_ok"], F.lit(False)) | (m["n"] < 4) | ~m["closed"],
             "aoi_invalid"),
            (corner_set & ~axis_aligned, "aoi_invalid"),
            (~corner_set & (area == 0.0), "aoi_empty"),
            (~corner_set, "aoi_geometry_unsupported"),
        ])
        box = X.bbox(F.get(m["xs"], F.lit(0)), F.get(m["ys"], F.lit(0)),
                     F.get(m["xs"], F.lit(1)), F.get(m["ys"], F.lit(1)))
        return let(code, lambda c: F.struct(
            c.alias("code"), F.when(c.isNull(), box).alias("box")))

    empty = F.struct(F.lit("aoi_empty").alias("code"), F.lit(None).cast(BOX_TYPE).alias("box"))
    return F.when(F.size(ring) == 0, empty).otherwise(let(let(ring, measured), judged))


def aoi_from_polygon(item: Column, *parts: str) -> Column:
    """Struct ``{code, box}`` of a GeoJSON polygon value inside ``item``."""
    coords = (*parts, "coordinates")
    rings = F.size(F.try_variant_get(item, path(*coords), "array<variant>"))
    typed = kind(item, *coords, 0)
    shape = first_failure([
        (~_is(item, "ARRAY", *coords), "aoi_invalid"),
        (rings == 0, "aoi_empty"),
        (rings > 1, "aoi_geometry_unsupported"),
        (~typed.startswith("ARRAY"), "aoi_invalid"),
        # An empty ring has no element type; any other ring must be positions of numbers.
        ((typed != "ARRAY<VOID>")
         & ~typed.rlike(r"^ARRAY<ARRAY<(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))>>$"),
         "aoi_invalid"),
    ])
    ring = rectangle(F.try_variant_get(item, path(*coords, 0), "array<array<double>>"))
    return let(shape, lambda c: F.when(c.isNotNull(), F.struct(
        c.alias("code"), F.lit(None).cast(BOX_TYPE).alias("box"))).otherwise(ring))


def _aoi(item: Column) -> Column:
    """Struct ``{code, box}`` of the whole ``aoi`` value."""
    kind_of = _text(item, "aoi", "geometry", "type")
    crs = _text(item, "aoi", "crs")
    has_box, has_geometry = _present(item, "aoi", "bbox"), _present(item, "aoi", "geometry")
    polygon = F.when(has_geometry & (kind_of == "Polygon"),
                     aoi_from_polygon(item, "aoi", "geometry"))
    own = X.bbox(*[number_at(item, "aoi", "bbox", i) for i in range(4)])

    def judged(p: Column) -> Column:
        code = first_failure([
            (~_present(item, "aoi"), "aoi_missing"),
            (~_is(item, "OBJECT", "aoi"), "aoi_invalid"),
            (_unknown_keys(item, AOI_KEYS, "aoi"), "field_unknown"),
            (_present(item, "aoi", "crs")
             & ~F.coalesce(F.trim(crs).isin(*WGS84_NAMES), F.lit(False)), "aoi_crs_unsupported"),
            (~has_box & ~has_geometry, "aoi_missing"),
            (has_box & has_geometry, "aoi_invalid"),
            F.when(has_box, box_problem(item, "aoi", "bbox")),
            (has_geometry & (kind_of.isNull() | ~kind_of.isin(*GEOJSON_TYPES)), "aoi_invalid"),
            (has_geometry & (kind_of != "Polygon"), "aoi_geometry_unsupported"),
            p["code"],
        ])
        return let(code, lambda c: F.struct(c.alias("code"), F.when(
            c.isNull(), F.when(has_box, own).otherwise(p["box"])).alias("box")))

    return let(polygon, judged)


def date_value(text: Column) -> Column:
    """A real calendar date written exactly YYYY-MM-DD, else NULL."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t.try_cast("date"))


def date_problem(start: Column, end: Column, today: date) -> Column:
    """Code for a closed date interval given as text, NULL when observations can exist."""
    return let(F.struct(date_value(start).alias("first"), date_value(end).alias("last")),
               lambda d: first_failure([
        (start.isNull(), "date_missing"), (d["first"].isNull(), "date_invalid"),
        (end.isNull(), "date_missing"), (d["last"].isNull(), "date_invalid"),
        (d["last"] < d["first"], "date_order_invalid"),
        ((d["last"] < F.lit(EARLIEST_OBSERVATION))
         | (F.datediff(d["first"], F.lit(today)) > FUTURE_GRACE_DAYS), "date_out_of_range"),
    ]))


def _observation_problem(item: Column, field: str, today: date) -> Column:
    start, end = _text(item, field, "start_date"), _text(item, field, "end_date")
    scene = _text(item, field, "scene_id")
    wrong_start = _present(item, field, "start_date") & start.isNull()
    wrong_end = _present(item, field, "end_date") & end.isNull()
    return first_failure([
        (~_present(item, field), "date_missing"),
        (~_is(item, "OBJECT", field), "date_invalid"),
        (_unknown_keys(item, OBSERVATION_KEYS, field), "field_unknown"),
        (wrong_start, "date_invalid"),
        (wrong_end & date_value(start).isNotNull(), "date_invalid"),
        date_problem(start, end, today),
        (_present(item, field, "scene_id") & ~valid_identifier(scene), "scene_invalid"),
    ])


def pair_order_problem(a: Column, b: Column) -> Column:
    """Date 1 must lie entirely before date 2; structs {start_date, end_date, scene_id}."""
    return first_failure([
        (a["start_date"] > b["end_date"], "date_order_invalid"),
        (~(a["end_date"] < b["start_date"]), "temporal_windows_overlap"),
        (a["scene_id"] == b["scene_id"], "scene_invalid"),
    ])


def _parameter_problem(item: Column, family: Column) -> Column:
    sar = family == "sentinel-1-sar"
    pol_kind = kind(item, "parameters", "polarizations")
    names = F.transform(
        F.try_variant_get(item, path("parameters", "polarizations"), "array<string>"),
        lambda p: F.lower(F.trim(p)))
    has_pol = _present(item, "parameters", "polarizations")
    wrong_pol = ~F.coalesce(
        (pol_kind == "ARRAY<STRING>") & (F.size(names) == 2)
        & F.array_contains(names, "vv") & F.array_contains(names, "vh"), F.lit(False))
    has_cloud = _present(item, "parameters", "max_cloud_cover")
    cloud = number_at(item, "parameters", "max_cloud_cover")
    return first_failure([
        (_present(item, "parameters") & ~_is(item, "OBJECT", "parameters"),
         "parameter_unsupported"),
        (_unknown_keys(item, PARAMETER_KEYS, "parameters"), "parameter_unsupported"),
        (_present(item, "parameters", "resolution")
         & ~F.coalesce(_text(item, "parameters", "resolution") == "native", F.lit(False)),
         "parameter_unsupported"),
        (_present(item, "parameters", "resampling"), "parameter_unsupported"),
        (sar & has_pol & wrong_pol, "parameter_unsupported"),
        (~sar & has_pol, "parameter_not_applicable"),
        (sar & has_cloud, "parameter_not_applicable"),
        (has_cloud & ~F.coalesce(cloud.between(0, 100), F.lit(False)), "parameter_unsupported"),
    ])


def validate_requests(requests: DataFrame, today: date, payload: str = "payload",
                      spacing: float = 10.0, max_dim: int = 2048,
                      max_px: int = 50_000_000) -> DataFrame:
    """Add ``code``: NULL for a valid request, else the first failing rule.

    Order: unknown field, operation, dataset, area, area size, dates, parameters. Purely
    per-row expressions over a parsed VARIANT, so a batch of any size is one narrow stage.
    """
    parsed = requests.withColumn("_item", F.try_parse_json(payload))
    item = F.col("_item")
    parsed = parsed.withColumn("_op", F.lower(F.trim(_text(item, "operation")))).withColumn(
        "_family", lookup(OPERATION_FAMILY, F.col("_op"))).withColumn(
        "_aoi", _aoi(item)).withColumn("_extent", X.aoi_extent_m(F.col("_aoi.box")))
    op, family = F.col("_op"), F.col("_family")
    dataset = _text(item, "dataset")
    has_dataset = _present(item, "dataset")
    known = lookup(DATASET_FAMILY, dataset)
    temporal = op.isin(*TEMPORAL)

    def side(field: str) -> Column:
        return F.struct(date_value(_text(item, field, "start_date")).alias("start_date"),
                        date_value(_text(item, field, "end_date")).alias("end_date"),
                        _text(item, field, "scene_id").alias("scene_id"))

    parsed = (
        parsed.withColumn("_single", _observation_problem(item, "time_window", today))
        .withColumn("_date1", _observation_problem(item, "date1", today))
        .withColumn("_date2", _observation_problem(item, "date2", today))
        .withColumn("_order", pair_order_problem(side("date1"), side("date2")))
        .withColumn("_parameters", _parameter_problem(item, family))
    )
    code = first_failure([
        (~_is(item, "OBJECT"), "field_unknown"),
        (_unknown_keys(item, REQUEST_KEYS), "field_unknown"),
        (~_present(item, "operation"), "analysis_missing"),
        (family.isNull(), "analysis_unknown"),
        (op.isin(*NOT_IMPLEMENTED), "analysis_not_implemented"),
        (has_dataset & known.isNull(), "dataset_unknown"),
        (has_dataset & (known != family), "dataset_incompatible"),
        (has_dataset & (dataset != lookup(MEASURED_FROM, family)), "dataset_incompatible"),
        F.col("_aoi.code"),
        (X.aoi_too_large(F.col("_extent"), spacing, max_dim, max_px), "aoi_too_large"),
        (temporal & _present(item, "time_window"), "temporal_structure_invalid"),
        F.when(temporal, F.col("_date1")),
        F.when(temporal, F.col("_date2")),
        F.when(temporal, F.col("_order")),
        (~temporal & (_present(item, "date1") | _present(item, "date2")),
         "temporal_structure_invalid"),
        F.when(~temporal, F.col("_single")),
        F.col("_parameters"),
    ])
    return parsed.withColumn("code", code).drop(
        "_item", "_op", "_family", "_aoi", "_extent", "_single", "_date1", "_date2", "_order",
        "_parameters")


def dataset_gate(windows: DataFrame) -> DataFrame:
    """Windows whose selected scene comes from an unknown or foreign collection."""
    family = lookup(DATASET_FAMILY, F.col("collection"))
    code = first_failure([
        (family.isNull(), "dataset_unknown"),
        (family != F.col("modality"), "dataset_incompatible"),
    ])
    read = windows.where(F.col("selected_scene_id").isNotNull()
                         & (F.coalesce("collection", F.lit("")) != ""))
    return read.withColumn("code", code).where(F.col("code").isNotNull())


# Fixed value: the window labels this system produces.
CANONICAL_LABEL = r"^(single|baseline|target|series\[\d+\])$"


def audit_executions(windows: DataFrame, intended: DataFrame, requests: DataFrame) -> DataFrame:
    """First violated relation per request, in window order then rule order.

    ``windows``: request_id, modality, label, start_date, end_date, pos, scene_count,
    scene_ids, selected_scene_id, imagery_scene_id, error. ``intended`` is the expansion of
    each request (request_id, modality, label, start_date, end_date); ``requests`` has
    request_id, modalities, executed_modalities. Three small keyed joins, no cross products.
    """
    period = ["start_date", "end_date"]
    first_pos = windows.groupBy("request_id", "modality", "label").agg(
        F.min("pos").alias("_first"))
    periods = intended.select("request_id", *period).distinct().withColumn("_known", F.lit(True))
    meant = intended.groupBy("request_id", "label").agg(
        F.first("start_date").alias("_start"), F.first("end_date").alias("_end"))
    rows = (
        windows.join(requests.select("request_id", "modalities"), "request_id")
        .join(first_pos, ["request_id", "modality", "label"])
        .join(periods, ["request_id", *period], "left")
        .join(meant, ["request_id", "label"], "left")
    )
    selected = F.col("selected_scene_id")
    ids = F.col("scene_ids")
    code = first_failure([
        (~F.array_contains("modalities", F.col("modality")), "modality_not_requested"),
        (F.col("pos") > F.col("_first"), "window_repeated"),
        (~F.col("label").rlike(CANONICAL_LABEL), "label_unknown"),
        (F.col("_known").isNull(), "period_not_requested"),
        ((F.col("start_date") != F.col("_start")) | (F.col("end_date") != F.col("_end")),
         "period_not_of_label"),
        (F.col("scene_count") < F.size(ids), "scene_count_too_small"),
        (selected.isNotNull() & ~F.array_contains(ids, selected), "selected_not_returned"),
        (F.col("imagery_scene_id").isNotNull() & selected.isNull(), "imagery_without_selection"),
        (F.col("imagery_scene_id") != selected, "imagery_of_other_scene"),
        (F.col("error").isNotNull() & ((F.size(ids) > 0) | selected.isNotNull()),
         "failed_window_not_empty"),
    ])
    per_window = (
        rows.withColumn("code", code).where(F.col("code").isNotNull())
        .select("request_id", F.col("pos").cast("bigint").alias("pos"), "code")
    )
    extra = requests.where(
        F.size(F.array_except("executed_modalities", "modalities")) > 0
    ).select("request_id", F.lit(1 << 40).alias("pos"), F.lit("executed_not_requested").alias("code"))
    return per_window.unionByName(extra).groupBy("request_id").agg(
        F.min_by("code", "pos").alias("code"))
