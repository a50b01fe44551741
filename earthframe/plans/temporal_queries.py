"""Registered queries over paired observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from earthframe.functions.times import separation_days
from earthframe.operators import catalog as C
from earthframe.operators import pixels as P
from earthframe.operators import temporal as T
from earthframe.plans import views as V
from earthframe.plans.registry import query, sql_view

sql_view("obs", """
SELECT request_id, modality, label, id, datetime, cloud_cover, processing_level, west, south, east, north,
 CAST(substr(id, 7) AS BIGINT) AS num,
 CASE WHEN CAST(substr(id, 7) AS BIGINT) % 4 <> 0 THEN 'EPSG:326' || (40 + CAST(substr(id, 7) AS BIGINT) % 3) END AS crs,
 CASE WHEN CAST(substr(id, 7) AS BIGINT) % 4 <> 0 THEN CASE WHEN CAST(substr(id, 7) AS BIGINT) % 5 = 0 THEN 20.0e0 ELSE 10.0e0 END END AS resolution,
 CASE WHEN CAST(substr(id, 7) AS BIGINT) % 10 <> 0 THEN CAST(CAST(substr(id, 7) AS BIGINT) % 200 - 100 AS DOUBLE) / 100 END AS mean,
 1000 + CAST(substr(id, 7) AS BIGINT) % 100 AS window_pixels,
 CASE WHEN CAST(substr(id, 7) AS BIGINT) % 6 = 0 THEN 1 ELSE 300 + CAST(substr(id, 7) AS BIGINT) % 50 END AS valid_pixels
FROM executed WHERE id IS NOT NULL
""")

_ORDER = "datetime IS NULL, replace(datetime, 'Z', ''), label, id"
_LEAD = ", ".join(
    f"lead({c}) OVER (PARTITION BY request_id, modality ORDER BY {_ORDER}) AS {c}2"
    for c in ("id", "label", "datetime", "crs", "resolution", "processing_level", "mean",
              "window_pixels", "valid_pixels", "cloud_cover", "west", "south", "east", "north"))
sql_view("obs_pairs", f"""
SELECT *, CASE WHEN west IS NULL OR west2 IS NULL THEN 'unknown'
  WHEN greatest(west, west2) >= least(east, east2) OR greatest(south, south2) >= least(north, north2) THEN 'none'
  WHEN (west <= west2 AND east >= east2 AND south <= south2 AND north >= north2)
    OR (west >= west2 AND east <= east2 AND south >= south2 AND north <= north2) THEN 'full' ELSE 'partial' END AS bbox_overlap,
 right(datetime, 1) <> right(datetime2, 1) AND (right(datetime, 1) = 'Z' OR right(datetime2, 1) = 'Z') AS mixed,
 CASE WHEN mean IS NULL OR mean2 IS NULL THEN 'no_mean' WHEN greatest(west, west2) >= least(east, east2)
   OR greatest(south, south2) >= least(north, north2) THEN CASE WHEN west IS NOT NULL AND west2 IS NOT NULL THEN 'no_overlap' WHEN id = id2 THEN 'same_scene' END
   WHEN id = id2 THEN 'same_scene' END AS suppressed
FROM (SELECT *, {_LEAD} FROM obs) WHERE id2 IS NOT NULL
""")
sql_view("obs_compat", """
SELECT *, CASE WHEN mixed OR datetime IS NULL OR datetime2 IS NULL THEN NULL ELSE abs(epoch_us(CAST(replace(replace(datetime, 'Z', ''), 'T', ' ') AS TIMESTAMP))
   - epoch_us(CAST(replace(replace(datetime2, 'Z', ''), 'T', ' ') AS TIMESTAMP))) / 86400000000.0 END AS days,
 CASE WHEN crs IS NULL OR crs2 IS NULL THEN 'unknown' WHEN crs = crs2 THEN 'same' ELSE 'different' END AS crs_match,
 CASE WHEN resolution IS NULL OR resolution2 IS NULL THEN 'unknown' WHEN resolution = resolution2 THEN 'same' ELSE 'different' END AS resolution_match,
 CASE WHEN processing_level IS NULL OR processing_level2 IS NULL THEN 'unknown' WHEN processing_level = processing_level2 THEN 'same' ELSE 'different' END AS processing_level_match
FROM obs_pairs
""")


def obs(spark, sf):
    o = C.observations(V.executed(spark, sf))
    num = F.substring_index("id", "-", -1).cast("bigint")
    box = F.when(F.col("west").isNotNull(), F.struct("west", "south", "east", "north"))
    has_image = num % 4 != 0
    return o.select(
        *C.WINDOW_KEY, "id", "datetime", "cloud_cover", "processing_level", box.alias("bbox"),
        F.when(has_image, F.concat(F.lit("EPSG:326"), (40 + num % 3).cast("string"))).alias("crs"),
        F.when(has_image, F.when(num % 5 == 0, 20.0).otherwise(10.0)).alias("resolution"),
        F.when(num % 10 != 0, (num % 200 - 100).cast("double") / 100).alias("mean"),
        (1000 + num % 100).alias("window_pixels"),
        F.when(num % 6 == 0, 1).otherwise(300 + num % 50).alias("valid_pixels"))


def pairs(spark, sf):
    return T.pair_observations(obs(spark, sf))[0]


def reports(spark, sf):
    p = pairs(spark, sf)
    with_modality = p.withColumn("first", F.col("first").withField("modality", F.col("modality"))
                                 ).withColumn("second", F.col("second").withField(
                                     "modality", F.col("modality")))
    return T.mean_difference(T.compatibility(with_modality))


@query("w3_consecutive_pairs", """
SELECT request_id, modality, id AS first_id, label AS first_label, id2 AS second_id, label2 AS second_label FROM obs_pairs
""")
def consecutive_pairs(spark, sf):
    return pairs(spark, sf).select(
        "request_id", "modality", F.col("first.id").alias("first_id"),
        F.col("first.label").alias("first_label"), F.col("second.id").alias("second_id"),
        F.col("second.label").alias("second_label"))


@query("w3_pairing_failures", """
SELECT request_id, modality, 'Only 1 ' || modality || ' observation is available; at least two are needed to form a pair.' AS reason
FROM obs GROUP BY request_id, modality HAVING count(*) < 2
""")
def pairing_failures(spark, sf):
    return T.pair_observations(obs(spark, sf))[1]


@query("p31_compatibility", """
SELECT request_id, id AS first_id, id2 AS second_id, TRUE AS same_modality, round(days, 6) AS separation_days, bbox_overlap,
 crs_match, resolution_match, processing_level_match FROM obs_compat
""")
def compatibility(spark, sf):
    return reports(spark, sf).select(
        "request_id", F.col("first.id").alias("first_id"), F.col("second.id").alias("second_id"),
        "same_modality", F.round("separation_days", 6).alias("separation_days"), "bbox_overlap",
        "crs_match", "resolution_match", "processing_level_match")


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("p32_limitations", f"""
SELECT request_id, id AS first_id, id2 AS second_id, concat_ws('|', {_lit(T.LIMITS['metadata_only'])}, {_lit(T.LIMITS['not_evaluated'])},
 CASE WHEN crs_match = 'unknown' THEN {_lit(T.LIMITS['crs_unknown'])} ELSE {_lit(T.LIMITS['crs_known'])} END,
 CASE WHEN resolution_match = 'unknown' THEN {_lit(T.LIMITS['resolution_unknown'])} ELSE {_lit(T.LIMITS['resolution_known'])} END,
 CASE WHEN processing_level_match = 'unknown' THEN {_lit(T.LIMITS['processing_unknown'])} ELSE {_lit(T.LIMITS['processing_known'])} END,
 CASE WHEN coalesce(mixed, FALSE) THEN {_lit(T.LIMITS['temporal_mixed'])} WHEN days IS NULL THEN {_lit(T.LIMITS['temporal_unknown'])} END,
 CASE WHEN bbox_overlap = 'unknown' THEN {_lit(T.LIMITS['bbox_unknown'])} ELSE {_lit(T.LIMITS['bbox_known'])} END) AS limitations FROM obs_compat
""")
def limitation_notes(spark, sf):
    return reports(spark, sf).select(
        "request_id", F.col("first.id").alias("first_id"), F.col("second.id").alias("second_id"),
        F.array_join(T.limitations(), "|").alias("limitations"))


@query("a5_mean_difference", """
SELECT request_id, id AS first_id, id2 AS second_id, suppressed,
 CASE WHEN suppressed IS NULL THEN round(mean2 - mean, 6) END AS mean_ndwi_difference FROM obs_pairs
""")
def mean_difference(spark, sf):
    return reports(spark, sf).select(
        "request_id", F.col("first.id").alias("first_id"), F.col("second.id").alias("second_id"),
        "suppressed", F.round("mean_ndwi_difference", 6).alias("mean_ndwi_difference"))


def _side_sql(s: str) -> dict[str, str]:
    q = f"'''' || label{s} || ''''"
    return {
        "cover": f"{q} || ' analysed ' || valid_pixels{s} || ' valid of ' || window_pixels{s} || ' AOI pixels (' || printf('%.1f', valid_pixels{s} * 100.0 / window_pixels{s}) || '%)'",
        "cloud": f"""CASE WHEN cloud_cover{s} IS NULL THEN 'Observation ' || {q} || ' reports no scene cloud cover metadata, so its scene-level cloud cover is unknown; its usable pixels are stated by the scene classification mask alone.'
 WHEN cloud_cover{s} > 30 THEN 'Observation ' || {q} || ' reports ' || printf('%.1f', cloud_cover{s}) || '% scene cloud cover. Pixels the scene classification marks as cloud, cloud shadow or snow were excluded, but that classification is not perfect, so residual cloud may remain in the statistics.' END""",
        "sample": f"CASE WHEN valid_pixels{s} = 1 THEN 'Observation ' || {q} || ' has only 1 valid pixel(s), so its statistics are not meaningful.' END",
    }


_A, _B = _side_sql(""), _side_sql("2")


@query("p44_temporal_warnings", f"""
SELECT request_id, id AS first_id, id2 AS second_id, concat_ws('|', {_lit(T.WARN_AGGREGATE)},
 CASE suppressed WHEN 'no_mean' THEN {_lit(T.WARN_SUPPRESSED['no_mean'])} WHEN 'no_overlap' THEN {_lit(T.WARN_SUPPRESSED['no_overlap'])}
  WHEN 'same_scene' THEN 'Both observations resolved to the same scene ''' || id || ''', so a difference would be trivially zero and none was computed.' END,
 CASE WHEN bbox_overlap = 'partial' THEN {_lit(T.WARN_PARTIAL)} END,
 'Equal AOI coverage is NOT established: ' || {_A['cover']} || '; ' || {_B['cover']} || '. Scene footprint overlap does not establish equal coverage, and the two means summarise different samples.',
 CASE WHEN crs IS NULL OR crs2 IS NULL THEN NULL WHEN crs = crs2 AND resolution = resolution2 THEN 'Both observations were read in ' || crs || ' at ' || printf('%.1f', resolution) || ' m/px.'
  ELSE 'The two observations were read on different grids (' || crs || ' at ' || printf('%.1f', resolution) || ' m/px versus ' || crs2 || ' at ' || printf('%.1f', resolution2)
   || ' m/px); nothing was reprojected or aligned, so each statistic summarises its own grid.' END,
 {_A['cloud']}, {_B['cloud']}, {_A['sample']}, {_B['sample']}) AS warnings FROM obs_pairs
""")
def temporal_warnings(spark, sf):
    return reports(spark, sf).select(
        "request_id", F.col("first.id").alias("first_id"), F.col("second.id").alias("second_id"),
        F.array_join(T.temporal_warnings(), "|").alias("warnings"))


@query("f31_temporal_separation", """
SELECT a.num, CASE WHEN a.datetime IS NULL OR b.datetime IS NULL OR (right(a.datetime, 1) = 'Z') <> (right(b.datetime, 1) = 'Z') THEN NULL
 ELSE round(abs(epoch_us(CAST(replace(replace(a.datetime, 'Z', ''), 'T', ' ') AS TIMESTAMP)) - epoch_us(CAST(replace(replace(b.datetime, 'Z', ''), 'T', ' ') AS TIMESTAMP))) / 86400000000.0, 6) END AS days
FROM scenes a JOIN scenes b ON b.num = a.num + 1
""")
def temporal_separation(spark, sf):
    s = V.scenes(spark, sf).select("num", "datetime")
    nxt = s.select((F.col("num") - 1).alias("num"), F.col("datetime").alias("next"))
    return s.join(nxt, "num").select("num", F.round(
        separation_days(F.col("datetime"), F.col("next")), 6).alias("days"))


_NOTE_PARTS = ", ".join(
    f"CASE WHEN {c} > 0 THEN '{label} ' || {c} END" for c, label in T.QUALITY_LABELS.items())


@query("f35_quality_notes", f"""
WITH q AS (SELECT g.scene_id, count(*) AS total, count(*) FILTER (WHERE category = 'usable') AS valid,
 {', '.join(f"count(*) FILTER (WHERE category = '{c}') AS {c}" for c in T.QUALITY_LABELS)},
 count(*) FILTER (WHERE scl IS NULL AND green_valid) AS unclassified, max(scl) FILTER (WHERE scl > 11) AS odd
 FROM graded g JOIN pixels p ON g.scene_id = p.scene_id AND g."row" = p."row" AND g.col = p.col GROUP BY g.scene_id)
SELECT scene_id, concat_ws('|', CASE WHEN valid = 0 THEN 'No pixel was usable: all ' || total || ' pixels of the analysis grid were masked, so no index statistic was computed.' END,
 CASE WHEN total > valid THEN (total - valid) || ' of ' || total || ' pixels were excluded before any statistic was computed (' || concat_ws(', ', {_NOTE_PARTS}) || ').' END,
 CASE WHEN unclassified > 0 THEN unclassified || ' pixels had no value in the scene classification layer and were excluded as no data.' END,
 CASE WHEN odd IS NOT NULL THEN 'The scene classification layer contains values outside the documented SCL classes 0-11 (' || odd || '); those ' || unknown_class || ' pixels were excluded, never treated as clear.' END) AS notes
FROM q
""")
def quality_notes(spark, sf):
    graded = P.with_quality(V.pixels(spark, sf), "ndwi")
    counts = P.pixel_quality(graded, ["scene_id"])
    classes = P.class_counts(graded, ["scene_id"]).select("scene_id", "unknown_scl_values")
    bare = graded.groupBy("scene_id").agg(F.count_if(
        F.col("scl").isNull() & F.col("green_valid")).alias("unclassified_pixels"))
    q = counts.join(classes, "scene_id", "left").join(bare, "scene_id").withColumn(
        "metadata_status", F.lit("known"))
    return q.select("scene_id", F.array_join(T.quality_notes(), "|").alias("notes"))
