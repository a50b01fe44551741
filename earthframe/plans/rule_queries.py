"""Registered queries over rule cascades: items, radiometry, requests, hrefs, executions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from earthframe.functions import boxes as X
from earthframe.functions import footprints as FP
from earthframe.functions import grids as G
from earthframe.functions import urls as U
from earthframe.functions.rules import let
from earthframe.operators import radiometry as R
from earthframe.operators import requests as Q
from earthframe.operators import scene_rules as S
from earthframe.plans import views as V
from earthframe.plans.registry import query, sql_view, table
from earthframe.sources import catalog_items as I

TODAY = date(2024, 12, 31)

sql_view("items", """
SELECT o_orderkey AS k, o_orderkey % 31 AS m, o_orderstatus = 'P' AS sar,
 'S-' || o_orderkey AS scene_id, 80.0e0 + CAST(o_orderkey % 7 AS DOUBLE) / 8 AS g_west,
 80.25e0 + CAST(o_orderkey % 3 AS DOUBLE) / 2 AS aoi_west,
 CASE WHEN o_orderkey % 31 = 4 THEN NULL WHEN o_orderkey % 11 IN (0, 1) THEN 'bbox' ELSE 'geometry' END AS basis,
 CASE WHEN o_orderstatus = 'P' THEN 'vv' ELSE 'green' END AS first_key,
 CASE WHEN o_orderstatus = 'P' THEN 'vh' ELSE 'nir' END AS second_key,
 CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 31 = 7 THEN NULL WHEN o_orderkey % 31 = 8 THEN '5.1'
      WHEN o_orderkey % 31 IN (20, 21) THEN '03.01' ELSE '05.11' END AS baseline,
 CASE WHEN o_orderkey % 31 IN (17, 20) THEN 'false' WHEN o_orderkey % 31 = 18 THEN 'absent'
      WHEN o_orderkey % 31 = 19 THEN 'unparseable' ELSE 'true' END AS flag,
 CASE WHEN o_orderkey % 31 = 15 OR o_orderkey % 31 = 9 THEN NULL WHEN o_orderkey % 31 = 22 THEN 0.5e0
      WHEN o_orderstatus = 'P' THEN 1.0e0 ELSE 0.0001e0 END AS scale1,
 CASE WHEN o_orderstatus = 'P' THEN 1.0e0 ELSE 0.0001e0 END AS scale2,
 CASE WHEN o_orderkey % 31 IN (15, 9) THEN NULL WHEN o_orderkey % 31 = 24 OR o_orderstatus = 'P' THEN 0.0e0 ELSE -0.125e0 END AS offset1,
 CASE WHEN o_orderstatus = 'P' THEN 0.0e0 ELSE -0.125e0 END AS offset2,
 CASE WHEN o_orderkey % 31 IN (15, 9, 23) THEN NULL WHEN o_orderkey % 31 = 26 THEN 'dB' ELSE '1' END AS unit1
FROM orders
""")


def items(spark, sf):
    """Catalog items as JSON text with one known defect per residue of the order key."""
    k = F.col("o_orderkey")
    m, sar = k % 31, F.col("o_orderstatus") == "P"
    lit = F.lit

    def cat(*parts):
        return F.concat(*[lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    def pick(otherwise, *cases):
        out = None
        for value, text in cases:
            hit = m.isin(*value) if isinstance(value, tuple) else m == value
            out = F.when(hit, text) if out is None else out.when(hit, text)
        return out.otherwise(otherwise)

    west = lit(80.0) + (k % 7).cast("double") / 8
    east, mid = west + 0.75, west + 0.25

    def ring(a, b):
        return cat("[[", a, ",12.75],[", b, ",12.75],[", b, ",13.5],[", a, ",13.5],[", a, ",12.75]]")

    shape = (
        F.when((m == 4) | (k % 11 == 0), lit(""))
        .when(k % 11 == 1, lit('"geometry":{"type":"Point","coordinates":[80,13]},'))
        .when(k % 11 == 2, cat('"geometry":{"type":"MultiPolygon","coordinates":[[', ring(west, mid),
                               "],[", ring(mid, east), "]]},"))
        .otherwise(cat('"geometry":{"type":"Polygon","coordinates":[', ring(west, east), "]},"))
    )
    box = F.when(m == 4, lit("")).otherwise(cat('"bbox":[', west, ",12.75,", east, ",13.5],"))
    constellation = F.when(sar, lit("sentinel-1")).otherwise(lit("sentinel-2"))
    who = pick(cat('"constellation":"', constellation, '"'), (3, lit('"constellation":"landsat-8"')),
               (25, cat('"platform":"', constellation, 'b"')))
    baseline = F.when(sar, lit("")).otherwise(pick(
        lit(',"s2:processing_baseline":"05.11"'), (7, lit("")),
        (8, lit(',"s2:processing_baseline":"5.1"')),
        ((20, 21), lit(',"s2:processing_baseline":"03.01"'))))
    flag = pick(lit(',"earthsearch:boa_offset_applied":true'),
                ((17, 20), lit(',"earthsearch:boa_offset_applied":false')), (18, lit("")),
                (19, lit(',"earthsearch:boa_offset_applied":"yes"')))
    dtype = F.when(sar, lit("float32")).otherwise(lit("uint16"))
    scale = F.when(sar, lit("1")).otherwise(lit("0.0001"))
    offset = F.when(sar, lit("0")).otherwise(lit("-0.125"))
    grid10 = '"proj:transform":[10,0,399960,0,-10,1500000],"proj:shape":[10980,10980]'

    def band(kind_of, scale_of, offset_of, unit):
        return cat('"raster:bands":[{"data_type":"', kind_of, '","nodata":0,"scale":', scale_of,
                   ',"offset":', offset_of, unit, '}],')

    first = cat(
        '{"href":"', pick(lit("https://data.example.com/a.tif"), (10, lit("")),
                          (14, lit("ftp://data.example.com/a.tif"))),
        '","type":"', pick(lit("image/tiff; application=geotiff; profile=cloud-optimized"),
                           (11, lit("image/png"))),
        '","roles":["', pick(lit("data"), (12, lit("overview"))), '"],',
        pick(band(pick(dtype, (13, lit("int8"))), pick(scale, (22, lit("0.5"))),
                  pick(offset, (24, lit("0"))),
                  pick(lit(',"unit":"1"'), (23, lit("")), (26, lit(',"unit":"dB"')))), (15, lit(""))),
        lit(grid10), "}")
    second = cat('{"href":"https://data.example.com/b.tif","type":"image/tiff; application=geotiff",',
                 band(dtype, scale, offset, lit(',"unit":"1"')), '"title":"b"}')
    scl = cat(
        '{"href":"https://data.example.com/c.tif","type":"image/tiff; application=geotiff",',
        '"raster:bands":[{"data_type":"uint8","nodata":0}],',
        pick(lit('"proj:transform":[20,0,399960,0,-20,1500000],"proj:shape":[5490,5490]'),
             (27, lit('"proj:transform":[20,0,399965,0,-20,1500000],"proj:shape":[5490,5490]')),
             (28, lit('"proj:transform":[25,0,399960,0,-20,1500000],"proj:shape":[5490,5490]'))), "}")
    keys = F.when(sar, lit("vv")).otherwise(lit("green")), F.when(sar, lit("vh")).otherwise(lit("nir"))
    assets = F.concat(
        F.when(m == 9, lit("")).otherwise(cat('"', keys[0], '":', first, ",")),
        cat('"', keys[1], '":', second, ',"scl":', scl))
    asked = pick(F.when(sar, lit("sentinel-1-rtc")).otherwise(lit("sentinel-2-l2a")),
                 (16, lit("sentinel-9-x")))
    scene_id = cat("S-", k)
    raw = F.concat(
        cat('{"id":"', pick(scene_id, (1, lit("S-other"))), '","collection":"',
            pick(asked, (2, lit("other"))), '",'), box, shape,
        cat('"properties":{', who, baseline, flag, ',"proj:epsg":32644,', lit(grid10),
            '},"assets":{', assets, "}}"))
    optical, radar = lit("sentinel-2-optical"), lit("sentinel-1-sar")
    modality = F.when(sar == (m != 30), radar).otherwise(optical)
    aoi_west = lit(80.25) + (k % 3).cast("double") / 2
    return table(spark, sf, "orders").select(
        k.alias("k"), scene_id.alias("scene_id"), asked.alias("collection"),
        modality.alias("modality"), aoi_west.alias("aoi_west"), raw.alias("raw"), sar.alias("sar"))


AOI = F.struct
ASSETS = {"sentinel-2-optical": ["green", "nir", "scl"], "sentinel-1-sar": ["vv", "vh"]}

SQL_FRACTION = """CASE WHEN m <> 4 THEN
 greatest(0.0e0, least(g_west + 0.75e0, aoi_west + 0.5e0) - greatest(g_west, aoi_west)) / 0.5e0 END"""
SQL_SCENE_CODE = f"""CASE WHEN m IN (16, 30) THEN 'incompatible_collection' WHEN m = 1 THEN 'scene_not_found'
 WHEN m = 2 THEN 'incompatible_collection' WHEN m = 3 THEN 'incompatible_sensor'
 WHEN m = 4 THEN 'scene_coverage_unknown' WHEN ({SQL_FRACTION}) <= 0 THEN 'scene_does_not_cover_aoi'
 WHEN ({SQL_FRACTION}) < 0.3 THEN 'insufficient_aoi_coverage'
 WHEN NOT sar AND m IN (7, 8) THEN 'unknown_processing_baseline' WHEN m IN (9, 10) THEN 'required_asset_missing'
 WHEN m IN (11, 12, 14) THEN 'unsupported_asset_type' WHEN m = 13 THEN 'unsupported_asset_encoding' END"""


def _aoi_box():
    return X.bbox(F.col("aoi_west"), F.lit(13.0), F.col("aoi_west") + 0.5, F.lit(13.25))


def _parsed(spark, sf):
    return I.parse_items(items(spark, sf))


@query("p21_scene_rule_cascade", f"SELECT scene_id, {SQL_SCENE_CODE} AS code FROM items")
def scene_rule_cascade(spark, sf):
    return S.validate_scenes(_parsed(spark, sf), _aoi_box(), ASSETS, min_coverage=0.3).select(
        "scene_id", "code")


@query("p21_partial_assets", f"""
SELECT scene_id, CASE WHEN code IN ('required_asset_missing', 'unsupported_asset_type', 'unsupported_asset_encoding')
  THEN NULL ELSE code END AS code,
 CASE WHEN m = 9 OR m = 10 THEN first_key || '=required_asset_missing' WHEN m IN (11, 12, 14) THEN first_key || '=unsupported_asset_type'
  WHEN m = 30 THEN CASE WHEN NOT sar THEN 'vv=required_asset_missing,vh=required_asset_missing' ELSE 'green=required_asset_missing,nir=required_asset_missing' END
  WHEN m = 13 THEN first_key || '=unsupported_asset_encoding' END AS unavailable
FROM (SELECT *, {SQL_SCENE_CODE} AS code FROM items)
""")
def partial_assets(spark, sf):
    """Tolerant mode: a bad asset is recorded and the scene stands if another one is good."""
    out = S.validate_scenes(_parsed(spark, sf), _aoi_box(), ASSETS, require_all=False, min_coverage=0.3)
    entries = F.array_join(F.transform(
        F.map_entries("unavailable"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("scene_id", "code", F.when(entries != "", entries).alias("unavailable"))


@query("j16_p22_aoi_coverage", f"""
SELECT scene_id, basis, round({SQL_FRACTION}, 6) AS fraction, CASE WHEN m = 4 THEN 'scene_coverage_unknown'
 WHEN ({SQL_FRACTION}) <= 0 THEN 'scene_does_not_cover_aoi' WHEN ({SQL_FRACTION}) < 0.3 THEN 'insufficient_aoi_coverage' END AS code,
 CASE WHEN ({SQL_FRACTION}) >= 1 THEN 'full' WHEN ({SQL_FRACTION}) > 0 THEN 'partial' END AS coverage FROM items
""")
def aoi_coverage(spark, sf):
    c = S.with_coverage(_parsed(spark, sf), _aoi_box())
    return c.select("scene_id", "basis", F.round("fraction", 6).alias("fraction"),
                    S.coverage_problem(F.col("fraction"), 0.3).alias("code"),
                    S.coverage_status(F.col("fraction")).alias("coverage"))


@query("j16_scene_area_pairs", """
SELECT s.id, a.request_id, round(greatest(0, least(east, aoi_east) - greatest(west, aoi_west))
 * greatest(0, least(north, aoi_north) - greatest(south, aoi_south)) / ((aoi_east - aoi_west) * (aoi_north - aoi_south)), 6) AS fraction
FROM scenes s JOIN requests a ON NOT (east < aoi_west OR west > aoi_east OR north < aoi_south OR south > aoi_north)
""")
def scene_area_pairs(spark, sf):
    """Footprints against request areas, boxes before clipping; a scene without a box touches none."""
    box = X.bbox(*[F.col(e) for e in ("west", "south", "east", "north")])
    scenes = V.scenes(spark, sf).select("id", "west", "south", "east", "north",
             FP.box_polygons(box).alias("polygons"))
    areas = V.requests(spark, sf).select(
        "request_id", *[f"aoi_{e}" for e in ("west", "south", "east", "north")])
    return S.aoi_coverage(scenes, areas).select(
        "id", "request_id", F.round("fraction", 6).alias("fraction"))


@query("f33_asset_encoding", """
SELECT scene_id, CASE WHEN m IN (9, 15) THEN 'unknown' ELSE 'known' END AS metadata_status,
 CASE WHEN m IN (9, 15) THEN NULL WHEN m = 13 THEN 'int8' WHEN sar THEN 'float32' ELSE 'uint16' END AS data_type,
 scale1 AS scale, offset1 AS "offset", unit1 AS unit FROM items
""")
def asset_encoding(spark, sf):
    p = _parsed(spark, sf)
    e = F.when(F.col("sar"), S.asset_encoding(F.col("item"), "vv").dropFields("key")).otherwise(
        S.asset_encoding(F.col("item"), "green").dropFields("key"))
    return p.select("scene_id", e.alias("e")).select(
        "scene_id", "e.metadata_status", "e.data_type", "e.scale", "e.offset", "e.unit")


@query("p24_projection_pick", """
SELECT scene_id, 32644 AS epsg, CASE m WHEN 27 THEN 399965.0e0 ELSE 399960.0e0 END AS scl_x,
 CASE m WHEN 28 THEN 25.0e0 ELSE 20.0e0 END AS scl_res, 10.0e0 AS second_res, 10980 AS second_height FROM items
""")
def projection_pick(spark, sf):
    p = _parsed(spark, sf)
    scl = S.pick_proj(F.col("item"), "scl")
    second = F.when(F.col("sar"), S.pick_proj(F.col("item"), "vh")).otherwise(
        S.pick_proj(F.col("item"), "nir"))
    return p.select("scene_id", scl.alias("a"), second.alias("b")).select(
        "scene_id", "a.epsg", F.get("a.transform", 2).alias("scl_x"),
        F.get("a.transform", 0).alias("scl_res"), F.get("b.transform", 0).alias("second_res"),
        F.get("b.shape", 0).alias("second_height"))


@query("p19_source_grid", """
SELECT scene_id, CASE m WHEN 27 THEN 'grid_misaligned' WHEN 28 THEN 'grid_ratio_invalid' END AS code,
 CASE WHEN m IN (27, 28) THEN 'scl' END AS key, CASE WHEN m = 9 AND FALSE THEN 'x' ELSE '' END AS missing FROM items
""")
def source_grid(spark, sf):
    item = F.col("item")

    def row(pos, key, scientific):
        grid = let(S.pick_proj(item, key), lambda p: G.source_grid(p["transform"], p["shape"], p["epsg"]))
        return F.struct(F.lit(pos).alias("pos"), F.lit(key).alias("key"),
                        F.lit(scientific).alias("scientific"), grid.alias("grid"))

    rows = F.when(F.col("sar"), F.array(row(0, "vv", True), row(1, "vh", True), row(2, "scl", False))
                  ).otherwise(F.array(row(0, "green", True), row(1, "nir", True), row(2, "scl", False)))
    flat = _parsed(spark, sf).select("scene_id", F.explode(rows).alias("r")).select("scene_id", "r.*")
    return S.source_grid_problem(flat).select(
        "scene_id", "code", "key", F.array_join("missing", ",").alias("missing"))


def _assets(spark, sf):
    item = F.col("item")
    facts = S.processing_facts(item)

    def rows(keys):
        return F.array(*[
            F.struct(F.lit(i).alias("pos"), S.asset_encoding(item, k).alias("e"))
            for i, k in enumerate(keys)])

    picked = F.when(F.col("sar"), rows(("vv", "vh"))).otherwise(rows(("green", "nir")))
    return (
        _parsed(spark, sf)
        .select("k", "scene_id", F.when(F.col("sar"), "sentinel-1-sar")
                .otherwise("sentinel-2-optical").alias("modality"), facts.alias("f"),
                F.explode(picked).alias("r"))
        .select("k", "scene_id", F.lit("bands").alias("analysis"), "modality",
                F.col("f.baseline").alias("baseline"), F.col("f.flag").alias("flag"),
                "r.pos", "r.e.key", "r.e.data_type", "r.e.scale", "r.e.offset", "r.e.unit")
    )


@query("p13_sar_encoding_gate", """
SELECT scene_id, 'vv' AS key, CASE WHEN m = 26 THEN 'vv: declared in decibels' WHEN m = 22 THEN 'vv: scale is not 1' ELSE '' END AS problems
FROM items WHERE sar UNION ALL SELECT scene_id, 'vh', '' FROM items WHERE sar
""")
def sar_encoding_gate(spark, sf):
    a = _assets(spark, sf).where(F.col("modality") == "sentinel-1-sar")
    reasons = R.sar_encoding_problem(F.col("key"), F.col("unit"), F.col("scale"), F.col("offset"))
    return a.select("scene_id", "key", F.array_join(reasons, "; ").alias("problems"))


@query("p14_offset_state", """
SELECT scene_id, CASE WHEN baseline = '05.11' THEN CASE flag WHEN 'true' THEN 'removed_by_provider' WHEN 'false' THEN 'not_removed'
  WHEN 'absent' THEN 'not_published' ELSE 'unparseable' END
  WHEN flag = 'true' THEN 'contradictory' ELSE 'not_introduced' END AS offset_state
FROM items WHERE NOT sar
""")
def offset_state(spark, sf):
    p = _parsed(spark, sf).where(~F.col("sar")).withColumn("f", S.processing_facts(F.col("item")))
    return p.select("scene_id", R.offset_state(F.col("f.baseline"), F.col("f.flag"))
                    .alias("offset_state"))


sql_view("assessed", """
SELECT *, CASE WHEN incompatible THEN 'incompatible' WHEN undetermined THEN 'undetermined'
  WHEN unknown <> '' OR conflict THEN 'verified_with_unknown_metadata' ELSE 'verified' END AS status FROM (
 SELECT k, scene_id, m, sar, baseline, flag,
  CASE WHEN sar THEN m IN (22, 26) ELSE (m = 22 OR m = 26) END AS incompatible,
  NOT sar AND (baseline IS NULL OR baseline = '5.1' OR (baseline = '05.11' AND flag <> 'true') OR baseline = '03.01') AS undetermined,
  NOT sar AND baseline = '05.11' AND flag = 'true' AS conflict,
  CASE WHEN m IN (9, 15) THEN first_key || '.data_type,' || first_key || '.scale,' || first_key || '.offset,' || first_key || '.unit'
       WHEN m = 23 THEN first_key || '.unit' ELSE '' END AS unknown FROM items)
""")


@query("p15_radiometric_status", "SELECT scene_id, status, unknown AS unknown_fields FROM assessed")
def radiometric_status(spark, sf):
    return R.assess_radiometry(_assets(spark, sf)).select(
        "scene_id", "status", F.array_join("unknown_fields", ",").alias("unknown_fields"))


@query("p16_radiometric_pair", """
SELECT a.scene_id AS first_id, b.scene_id AS second_id, CASE
 WHEN a.status IN ('incompatible', 'undetermined') OR b.status IN ('incompatible', 'undetermined') THEN 'not_established'
 WHEN a.sar <> b.sar THEN 'different_representations' END AS problem
FROM assessed a JOIN assessed b ON b.k = a.k + 1
""")
def radiometric_pair(spark, sf):
    state = R.assess_radiometry(_assets(spark, sf)).withColumn(
        "k", F.substring_index("scene_id", "-", -1).cast("bigint"))
    packed = state.select("k", F.struct("scene_id", "representation", "scale_min", "scale_max",
                                        "unit_min", "unit_max").alias("s"))
    first, second = packed.select("k", F.col("s").alias("a")), packed.select(
        (F.col("k") - 1).alias("k"), F.col("s").alias("b"))
    return first.join(second, "k").select(
        F.col("a.scene_id").alias("first_id"), F.col("b.scene_id").alias("second_id"),
        R.radiometric_pair_problem(F.col("a"), F.col("b")).alias("problem"))


@query("p23_shared_scale", """
SELECT scene_id, CASE WHEN scale1 IS NOT NULL AND scale1 <> scale2 THEN 'scales_differ' END AS problem FROM items
""")
def shared_scale(spark, sf):
    item = F.col("item")

    def pair(a, b):
        return R.shared_scale_problem(S.asset_encoding(item, a)["scale"],
                                      S.asset_encoding(item, b)["scale"])

    return _parsed(spark, sf).select("scene_id", F.when(
        F.col("sar"), pair("vv", "vh")).otherwise(pair("green", "nir")).alias("problem"))


@query("f34_summary_lines", """
SELECT scene_id, scene_id || ' radiometric state: ' || status || ' - ' || CASE WHEN status IN ('incompatible', 'undetermined') THEN 'none'
  WHEN sar THEN 'linear power, read as-is' ELSE 'digital numbers proportional to reflectance, no additive offset' END
 || '. Processing baseline ' || coalesce(baseline, 'not published') || '; reflectance offset '
 || CASE WHEN sar THEN 'not applicable' WHEN baseline = '05.11' THEN CASE flag WHEN 'true' THEN 'removed by provider' WHEN 'false' THEN 'not removed'
   WHEN 'absent' THEN 'not published' ELSE 'unparseable' END WHEN flag = 'true' THEN 'contradictory' ELSE 'not introduced' END
 || '; unit 1; source: the catalog item.' AS line,
 'Scene grid: valid - EPSG:32644, 10 x 10 m, 10980x10980 px; scl nested 2:1.' AS grid_line
FROM assessed WHERE m NOT IN (26)
""")
def summary_lines(spark, sf):
    state = R.assess_radiometry(_assets(spark, sf)).where(F.col("unit_min") == F.col("unit_max"))
    line = F.regexp_replace(R.summary_line(F.col("scene_id")), r"; declared scale [^;]*", "")
    g = F.struct(F.lit("EPSG:32644").alias("crs"), F.lit(10.0).alias("a"), F.lit(-10.0).alias("e"),
                 F.lit(10980).alias("width"), F.lit(10980).alias("height"))
    return state.select("scene_id", line.alias("line"), G.summary_line(
        F.lit("Scene"), g, F.lit("scl nested 2:1")).alias("grid_line"))


@query("p30_scene_pair", """
WITH s AS (SELECT *, num % 29 = 0 AS open_offset FROM scenes)
SELECT a.id AS first_id, b.id AS second_id, CASE WHEN a.collection <> b.collection THEN 'different_collections'
 WHEN a.datetime IS NULL OR b.datetime IS NULL OR right(a.datetime, 1) <> 'Z' OR right(b.datetime, 1) <> 'Z' THEN 'acquisition_time_unknown'
 WHEN a.datetime >= b.datetime THEN 'not_in_order'
 WHEN a.collection = 'sentinel-2-l2a' AND (a.open_offset OR b.open_offset) THEN 'offset_not_established' END AS code
FROM s a JOIN s b ON b.num = a.num + 1
""")
def scene_pair(spark, sf):
    side = V.scenes(spark, sf).select("num", F.struct(
        F.col("id").alias("scene_id"), "collection",
        F.when(F.col("collection") == "sentinel-2-l2a", "sentinel-2-optical")
        .otherwise("sentinel-1-sar").alias("modality"), F.col("datetime").alias("acquired"),
        F.when(F.col("num") % 29 == 0, "not_published").alias("offset_problem")).alias("s"))
    a = side.withColumnRenamed("s", "a")
    b = side.select((F.col("num") - 1).alias("num"), F.col("s").alias("b"))
    return a.join(b, "num").select(
        F.col("a.scene_id").alias("first_id"), F.col("b.scene_id").alias("second_id"),
        S.scene_pair_problem(F.col("a"), F.col("b")).alias("code"))


@query("p33_identifier_allowlist", """
SELECT page_id, regexp_full_match(s, '[A-Za-z0-9._-]{1,200}') AND s NOT IN ('.', '..') AS ok
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '..' ELSE replace(replace(replace(replace(replace(url, '/', '_'), ':', '-'), '?', '.'), '=', '-'), '&', '.') END AS s FROM pages)
""")
def identifier_allowlist(spark, sf):
    k, url = F.col("page_id"), F.col("url")
    text = F.when(k % 5 == 0, url).when(k % 5 == 1, "..").otherwise(
        F.translate(url, "/:?=&", "_-.-."))
    return table(spark, sf, "pages").select("page_id", U.valid_identifier(text).alias("ok"))


_BAD_URLS = [
    ("s3://bucket/key.tif", "unreadable_scheme"), ("http://127.0.0.1/x.tif", "non_public_address"),
    ("https://100.64.0.1/x.tif", "non_public_address"), ("http://224.0.0.1/", "non_public_address"),
    ("http://[::1]:8080/x", "non_public_address"), ("https:///x.tif", "no_host"),
    ("no scheme at all", "unreadable_scheme"), ("https://8.8.8.8/x.tif", "host_not_trusted"),
    ("HTTPS://user@data.example.com:443/x.tif", None), ("https://[2606:4700::1111]/x", "host_not_trusted"),
]
_URL_CASE = " ".join(f"WHEN {i} THEN '{u}'" for i, (u, _) in enumerate(_BAD_URLS))
_CODE_CASE = " ".join(
    f"WHEN {i} THEN {repr(c) if c else 'NULL'}" for i, (_, c) in enumerate(_BAD_URLS))


@query("p34_href_policy", f"""
SELECT page_id, CASE page_id % 24 {_CODE_CASE} WHEN 10 THEN 'control_character'
 ELSE CASE WHEN regexp_matches(url, '^https?://([^/]*\\.)?(example\\.com|example\\.org)([/?#:]|$)') THEN NULL ELSE 'host_not_trusted' END END AS code
FROM pages
""")
def href_policy(spark, sf):
    k = F.col("page_id") % 24
    url = F.when(k == 10, F.concat(F.col("url"), F.lit("\n")))
    for i, (bad, _) in enumerate(_BAD_URLS):
        url = url.when(k == i, bad)
    url = url.otherwise(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", U.href_problem(url, ["*.example.com", "example.org"]).alias("code"))


# --------------------------------------------------------------------------- #
# Requests
# --------------------------------------------------------------------------- #

_RINGS = {
    "rectangle": "[[80,13],[80.1,13],[80.1,13.1],[80,13.1],[80,13]]",
    "bow_tie": "[[80,13],[80.1,13.1],[80.1,13],[80,13.1],[80,13]]",
    "triangle": "[[80,13],[80.1,13],[80.1,13.1],[80,13]]",
    "line": "[[80,13],[80.1,13],[80.2,13],[80,13]]",
    "open": "[[80,13],[80.1,13],[80.1,13.1],[80,13.1]]",
    "short": "[[80,13],[80.1,13],[80,13]]",
    "empty": "[]",
    "outside": "[[80,13],[80.1,13],[80.1,93.1],[80,93.1],[80,13]]",
}


def _polygon(ring: str, extra: str = "") -> str:
    return f'"geometry":{{"type":"Polygon","coordinates":[{ring}{extra}]}}'


_AOI_OK = '"bbox":[80.25,13,80.3,13.05]'
_AOIS: dict[int, str | None] = {
    9: None, 10: '"here"', 11: "{" + _AOI_OK + ',"name":"x"}', 12: "{" + _AOI_OK + ',"crs":"EPSG:3857"}',
    13: "{}", 14: "{" + _AOI_OK + "," + _polygon(_RINGS["rectangle"]) + "}", 15: '{"bbox":[80,13,81]}',
    16: '{"bbox":["80","13","81","14"]}', 17: '{"bbox":[80,13,81,95]}', 18: '{"bbox":[80,13,80,14]}',
    19: '{"bbox":[81,13,80,14]}', 20: '{"geometry":{"type":"Circle","coordinates":[]}}',
    21: '{"geometry":{"type":"Point","coordinates":[80,13]}}', 22: "{" + _polygon(_RINGS["rectangle"]) + "}",
    23: "{" + _polygon(_RINGS["bow_tie"]) + "}", 24: "{" + _polygon(_RINGS["triangle"]) + "}",
    25: "{" + _polygon(_RINGS["line"]) + "}", 26: "{" + _polygon(_RINGS["open"]) + "}",
    27: "{" + _polygon(_RINGS["rectangle"], "," + _RINGS["triangle"]) + "}", 28: '{"bbox":[80,13,85,14]}',
    0: "{" + _AOI_OK + ',"crs":"OGC:CRS84"}',
}
_FIRST_SIDE: dict[int, str] = {
    29: '{"end_date":"2024-02-10"}', 30: '{"start_date":"2024-2-3","end_date":"2024-02-10"}',
    31: '{"start_date":"2024-02-30","end_date":"2024-03-10"}',
    32: '{"start_date":"2024-02-10","end_date":"2024-02-01"}',
    33: '{"start_date":"2013-01-01","end_date":"2013-02-01"}',
    34: '{"start_date":"2025-06-01","end_date":"2025-06-10"}',
    35: '{"start_date":"2024-01-01","end_date":"2024-01-10","scene_id":"a/b"}',
    44: '{"start_date":"2024-01-01","end_date":"2024-01-10","scene_id":"S2A"}',
}
_SIDE1 = '{"start_date":"2024-01-01","end_date":"2024-01-10"}'
_SIDE2: dict[int, str] = {
    41: '{"start_date":"2024-01-10","end_date":"2024-02-10"}',
    43: '{"start_date":"2023-01-10","end_date":"2023-02-10"}',
    44: '{"start_date":"2024-03-01","end_date":"2024-03-10","scene_id":"S2A"}',
}
_SIDE2_OK = '{"start_date":"2024-03-01","end_date":"2024-03-10"}'
_PARAMETERS = {36: '{"resolution":"10m"}', 37: '{"resampling":"cubic"}', 38: '{"polarizations":["vv"]}',
               39: '{"max_cloud_cover":120}', 40: '{"speed":1}', 0: '{"resolution":"native"}'}


def payloads(spark, sf):
    """Request bodies as JSON text; the residue of the order key picks the defect."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    m = k % 47

    def choose(table_of, otherwise):
        out = None
        for value, text in table_of.items():
            text = F.lit(text) if isinstance(text, str) else text
            out = F.when(m == value, text) if out is None else out.when(m == value, text)
        return out.otherwise(otherwise if not isinstance(otherwise, str) else F.lit(otherwise))

    own = F.when(status == "O", "ndvi").when(status == "F", " Temporal_NDWI ").otherwise("sar_backscatter")
    op = choose({2: "", 3: '"operation":"evi",', 4: '"operation":5,', 5: '"operation":"temporal_ndvi",'},
                F.concat(F.lit('"operation":"'), own, F.lit('",')))
    other = F.when(status == "P", "sentinel-2-l2a").otherwise("sentinel-1-rtc")
    dataset = choose({6: '"dataset":"landsat",', 7: F.concat(F.lit('"dataset":"'), other, F.lit('",')),
                      8: '"dataset":"sentinel-1-grd",'}, "")
    aoi = choose({v: "" if t is None else f'"aoi":{t},' for v, t in _AOIS.items()},
                 '"aoi":{' + _AOI_OK + "},")
    side1, side2 = choose(_FIRST_SIDE, _SIDE1), choose(_SIDE2, _SIDE2_OK)
    temporal = status == "F"
    times = F.when(temporal, F.concat(
        F.lit('"date1":'), side1, F.lit(',"date2":'), side2,
        F.when(m == 42, F.concat(F.lit(',"time_window":'), side1)).otherwise(F.lit("")))
    ).otherwise(F.concat(F.lit('"time_window":'), side1, F.when(
        m == 41, F.concat(F.lit(',"date1":'), side2)).otherwise(F.lit(""))))
    parameters = choose({v: f',"parameters":{t}' for v, t in _PARAMETERS.items()}, "")
    body = F.concat(F.lit("{"), op, dataset, aoi, times, parameters,
                    F.when(m == 1, F.lit(',"foo":1')).otherwise(F.lit("")), F.lit("}"))
    payload = F.when(m == 45, "not json").when(m == 46, "[1]").otherwise(body)
    return table(spark, sf, "orders").select(k.alias("request_id"), payload.alias("payload"))


@query("p25_request_cascade", """
SELECT o_orderkey AS request_id, CASE o_orderkey % 47 WHEN 1 THEN 'field_unknown' WHEN 2 THEN 'analysis_missing'
 WHEN 3 THEN 'analysis_unknown' WHEN 4 THEN 'analysis_unknown' WHEN 5 THEN 'analysis_not_implemented'
 WHEN 6 THEN 'dataset_unknown' WHEN 7 THEN 'dataset_incompatible' WHEN 8 THEN 'dataset_incompatible'
 WHEN 9 THEN 'aoi_missing' WHEN 10 THEN 'aoi_invalid' WHEN 11 THEN 'field_unknown' WHEN 12 THEN 'aoi_crs_unsupported'
 WHEN 13 THEN 'aoi_missing' WHEN 14 THEN 'aoi_invalid' WHEN 15 THEN 'aoi_invalid' WHEN 16 THEN 'aoi_invalid'
 WHEN 17 THEN 'aoi_invalid' WHEN 18 THEN 'aoi_empty' WHEN 19 THEN 'aoi_invalid' WHEN 20 THEN 'aoi_invalid'
 WHEN 21 THEN 'aoi_geometry_unsupported' WHEN 23 THEN 'aoi_invalid' WHEN 24 THEN 'aoi_geometry_unsupported'
 WHEN 25 THEN 'aoi_empty' WHEN 26 THEN 'aoi_invalid' WHEN 27 THEN 'aoi_geometry_unsupported' WHEN 28 THEN 'aoi_too_large'
 WHEN 29 THEN 'date_missing' WHEN 30 THEN 'date_invalid' WHEN 31 THEN 'date_invalid' WHEN 32 THEN 'date_order_invalid'
 WHEN 33 THEN 'date_out_of_range' WHEN 34 THEN 'date_out_of_range' WHEN 35 THEN 'scene_invalid'
 WHEN 36 THEN 'parameter_unsupported' WHEN 37 THEN 'parameter_unsupported' WHEN 40 THEN 'parameter_unsupported'
 WHEN 38 THEN CASE WHEN o_orderstatus = 'P' THEN 'parameter_unsupported' ELSE 'parameter_not_applicable' END
 WHEN 39 THEN CASE WHEN o_orderstatus = 'P' THEN 'parameter_not_applicable' ELSE 'parameter_unsupported' END
 WHEN 41 THEN CASE WHEN o_orderstatus = 'F' THEN 'temporal_windows_overlap' ELSE 'temporal_structure_invalid' END
 WHEN 42 THEN CASE WHEN o_orderstatus = 'F' THEN 'temporal_structure_invalid' END
 WHEN 43 THEN CASE WHEN o_orderstatus = 'F' THEN 'date_order_invalid' END
 WHEN 44 THEN CASE WHEN o_orderstatus = 'F' THEN 'scene_invalid' END
 WHEN 45 THEN 'field_unknown' WHEN 46 THEN 'field_unknown' END AS code FROM orders
""")
def request_cascade(spark, sf):
    return Q.validate_requests(payloads(spark, sf), TODAY).select("request_id", "code")


@query("p26_rectangle_area", """
SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 1 THEN 'aoi_invalid' WHEN 2 THEN 'aoi_geometry_unsupported' WHEN 3 THEN 'aoi_empty'
 WHEN 4 THEN 'aoi_invalid' WHEN 5 THEN 'aoi_invalid' WHEN 6 THEN 'aoi_empty' WHEN 7 THEN 'aoi_invalid' END AS code,
 CASE WHEN o_orderkey % 8 = 0 THEN 80.1e0 END AS east FROM orders
""")
def rectangle_area(spark, sf):
    k = F.col("o_orderkey")
    text = None
    for i, ring in enumerate(_RINGS.values()):
        body = "{" + _polygon(ring) + "}"
        text = F.when(k % 8 == i, body) if text is None else text.when(k % 8 == i, body)
    rows = table(spark, sf, "orders").select(k.alias("id"), F.parse_json(text).alias("item"))
    parsed = rows.select("id", Q.aoi_from_polygon(F.col("item"), "geometry").alias("a"))
    return parsed.select("id", "a.code", F.col("a.box.east").alias("east"))


_E2 = "0.0066943799901413165e0"
_MER = f"(6378137.0e0 * (1 - {_E2}) / pow(1 - {_E2} * pow(sin(radians(%s)), 2), 1.5e0))"
_SIMPSON = " + ".join(
    f"{4 if i % 2 else 2} * " + _MER % f"(s + {i} * (n - s) / 16)" for i in range(1, 16))


@query("p27_area_extent", f"""
SELECT request_id, round(radians(e - w) * 6378137.0e0 * cos(radians(widest)) / sqrt(1 - {_E2} * pow(sin(radians(widest)), 2)), 3) AS width_m,
 round(radians((n - s) / 16) * ({_MER % 's'} + {_MER % 'n'} + {_SIMPSON}) / 3, 3) AS height_m, TRUE AS too_large
FROM (SELECT request_id, aoi_west AS w, aoi_south AS s, aoi_east AS e, aoi_north AS n,
 CASE WHEN aoi_south <= 0 AND aoi_north >= 0 THEN 0.0e0 WHEN abs(aoi_south) < abs(aoi_north) THEN aoi_south ELSE aoi_north END AS widest FROM requests)
""")
def area_extent(spark, sf):
    box = X.bbox(*[F.col(f"aoi_{e}") for e in ("west", "south", "east", "north")])
    r = V.requests(spark, sf).withColumn("x", X.aoi_extent_m(box))
    return r.select("request_id", F.round("x.width_m", 3).alias("width_m"),
                    F.round("x.height_m", 3).alias("height_m"),
                    X.aoi_too_large(F.col("x")).alias("too_large"))


@query("p28_date_checks", """
SELECT id, CASE WHEN s IS NULL THEN 'date_missing' WHEN try_cast(s AS DATE) IS NULL OR NOT regexp_full_match(s, '\\d{4}-\\d{2}-\\d{2}') THEN 'date_invalid'
 WHEN e < CAST(s AS DATE) THEN 'date_order_invalid'
 WHEN e < DATE '2014-10-03' OR CAST(s AS DATE) - DATE '2024-12-31' > 1 THEN 'date_out_of_range' END AS code
FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + 7000 AS e,
 CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN '2023-02-30'
  WHEN 3 THEN strftime(o_orderdate + INTERVAL 7001 DAY, '%Y-%m-%d') WHEN 4 THEN '2025-01-02' ELSE strftime(o_orderdate + INTERVAL 6990 DAY, '%Y-%m-%d') END AS s FROM orders)
""")
def date_checks(spark, sf):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    start = (
        F.when(k % 7 == 0, None).when(k % 7 == 1, F.date_format(d, "yyyy-MM"))
        .when(k % 7 == 2, "2023-02-30").when(k % 7 == 3, F.date_add(d, 7001).cast("string"))
        .when(k % 7 == 4, "2025-01-02").otherwise(F.date_add(d, 6990).cast("string")))
    return table(spark, sf, "orders").select(k.alias("id"), Q.date_problem(
        start, F.date_add(d, 7000).cast("string"), TODAY).alias("code"))


@query("p29_temporal_order", """
SELECT a.request_id, CASE WHEN a.start_date > b.end_date THEN 'date_order_invalid' WHEN a.end_date >= b.start_date THEN 'temporal_windows_overlap' END AS code
FROM windows a JOIN windows b ON a.request_id = b.request_id AND a.modality = b.modality AND b.pos = a.pos + 1
""")
def temporal_order(spark, sf):
    w = V.windows(spark, sf).select("request_id", "modality", "pos", F.struct(
        "start_date", "end_date", F.lit(None).cast("string").alias("scene_id")).alias("s"))
    a = w.withColumnRenamed("s", "a")
    b = w.select("request_id", "modality", (F.col("pos") - 1).alias("pos"), F.col("s").alias("b"))
    return a.join(b, ["request_id", "modality", "pos"]).select(
        "request_id", Q.pair_order_problem(F.col("a"), F.col("b")).alias("code"))


def _submitted(spark, sf):
    """Windows as a client might send them back, one relation broken per request residue."""
    w = V.windows(spark, sf)
    m = F.col("request_id") % 29
    own = F.concat(F.lit("s"), F.col("pos").cast("string"))
    swapped = F.when(F.col("label") == "baseline", "target").when(
        F.col("label") == "target", "baseline").otherwise(F.col("label"))
    sent = w.select(
        "request_id", "pos", F.when(m == 1, "lidar").otherwise(F.col("modality")).alias("modality"),
        F.when(m == 2, F.concat(F.lit("window "), "label")).when(m == 4, swapped)
        .otherwise(F.col("label")).alias("label"),
        F.when(m == 3, F.date_add("start_date", 1)).otherwise(F.col("start_date")).alias("start_date"),
        "end_date", F.when(m == 5, 1).otherwise(2).alias("scene_count"),
        F.array(own, F.lit("t")).alias("scene_ids"),
        F.when(m == 6, "zzz").when(m == 7, None).otherwise(own).alias("selected_scene_id"),
        F.when(m == 7, own).when(m == 8, "other").alias("imagery_scene_id"),
        F.when(m == 9, "timeout").alias("error"),
    )
    twice = sent.where(m == 10).withColumn("pos", F.col("pos") + 100)
    return sent.unionByName(twice)


@query("p36_execution_audit", """
SELECT request_id, code FROM (SELECT request_id, CASE request_id % 29 WHEN 1 THEN 'modality_not_requested' WHEN 2 THEN 'label_unknown' WHEN 3 THEN 'period_not_requested'
 WHEN 4 THEN CASE WHEN mode = 'compare' THEN 'period_not_of_label' END WHEN 5 THEN 'scene_count_too_small' WHEN 6 THEN 'selected_not_returned'
 WHEN 7 THEN 'imagery_without_selection' WHEN 8 THEN 'imagery_of_other_scene' WHEN 9 THEN 'failed_window_not_empty'
 WHEN 10 THEN 'window_repeated' WHEN 11 THEN 'executed_not_requested' END AS code FROM requests) WHERE code IS NOT NULL
""")
def execution_audit(spark, sf):
    requests = V.requests(spark, sf).select(
        "request_id", "modalities",
        F.when(F.col("request_id") % 29 == 11, F.array_append("modalities", "lidar"))
        .otherwise(F.col("modalities")).alias("executed_modalities"))
    return Q.audit_executions(_submitted(spark, sf), V.windows(spark, sf), requests)


@query("p37_dataset_gate", """
SELECT request_id, modality, label, CASE WHEN request_id % 5 = 0 THEN 'dataset_unknown' ELSE 'dataset_incompatible' END AS code
FROM executed WHERE id IS NOT NULL AND (request_id % 5 = 0 OR (request_id % 3 = 0 AND modality = 'sentinel-2-optical'))
""")
def dataset_gate(spark, sf):
    r = F.col("request_id")
    w = V.executed(spark, sf).withColumn("collection", F.when(r % 5 == 0, "landsat-c2")
                                         .when(r % 3 == 0, "sentinel-1-rtc")
                                         .otherwise(F.col("scene.collection")))
    return Q.dataset_gate(w).select("request_id", "modality", "label", "code")
