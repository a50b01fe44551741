"""Inputs beyond every limit that an operator once had."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from earthframe.functions import claims, grids, questions
from earthframe.operators import catalog, evidence, gazetteer, similarity
from earthframe.operators.questions import mentioned_place


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_six_significant_digits_like_percent_g(spark):
    values = [8.983e-05, 0.012345678, 1234567.0, 123456.0, 123400.0, 0.0001, 1e-5, 10.0, -10.0, 0.5, 1e6, 999999.5, 0.0, 1e300]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", grids.general(F.col("v")).alias("text")).collect()
    assert {r.v: r.text for r in rows} == {v: "%g" % v for v in values}


def test_tiny_values_are_displayed(spark):
    values = [1e-19, 1.5e-22, -2.25e-30]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", claims.display_value(F.col("v")).alias("text")).collect()
    assert all(abs(float(r.text) - r.v) <= 1e-3 * abs(r.v) for r in rows)


def test_order_of_mentions_in_a_long_part(spark):
    part = "ndvi " + "x" * 150_000
    assert list(_one(spark, questions.analyses(F.array(F.lit(part), F.lit("water"))))) == ["ndvi", "ndwi"]


def test_long_place_names_are_found(spark):
    names = spark.createDataFrame([("Lake of the Ozarks State Park",), ("Lake",)], "name string")
    asked = spark.createDataFrame([(1, "Is there water in Lake of the Ozarks State Park?")], "question_id long, text string")
    row = mentioned_place(asked, names).first()
    assert (row.place, row.status) == ("Lake of the Ozarks State Park", "found")


def test_nested_unions_of_evidence_keep_their_order(spark):
    def part(*ids):
        return spark.createDataFrame([(1, i, x, "s") for i, x in enumerate(ids)], "run_id long, pos long, id string, source string")

    inner, _ = evidence.union_evidence(part("a", "b"), part("c"))
    outer, twice = evidence.union_evidence(part("first"), inner, part("last"))
    assert [r.id for r in outer.orderBy("pos").collect()] == ["first", "a", "b", "c", "last"]
    assert outer.select("pos").distinct().count() == 5 and twice.count() == 0


def test_a_long_chain_settles(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = similarity.connected_components(edges)
    assert roots.count() == 301 and roots.where("root <> 0").count() == 0


def test_broken_requests_come_back_and_stop_nobody(spark):
    day = dt.date(2020, 1, 1)
    sound = [(day, day + dt.timedelta(9))]
    rows = [(1, sound, 0.0), (2, sound * 25, 0.0), (3, [(day, day - dt.timedelta(400))], 0.0), (4, sound, 5.0), (5, [], 0.0)]
    requests = spark.createDataFrame(
        [(i, "single", ["sentinel-2-optical"], w, west, 0.0, 1.0, 1.0) for i, w, west in rows],
        "request_id long, mode string, modalities array<string>, windows array<struct<start_date: date, end_date: date>>, "
        "aoi_west double, aoi_south double, aoi_east double, aoi_north double")
    codes = {r.request_id: r.code for r in catalog.reject_requests(requests).collect()}
    assert codes == {2: "too_many_windows", 3: "window_inverted", 4: "area_inverted", 5: "windows_missing"}
    scenes = spark.createDataFrame([("s", "sentinel-2-l2a", day, 0.0, 0.0, 1.0, 1.0)],
                                   "id string, collection string, acquired_date date, west double, south double, east double, north double")
    found = catalog.discover(catalog.expand_windows(requests), scenes).select("request_id").collect()
    assert [r.request_id for r in found] == [1]


def test_what_an_image_of_a_place_shows_is_visual(spark):
    asked = {"What does the satellite image of Marina Beach, Chennai show in January 2025?": True,
             "What does the image of Marina Beach, Chennai contain in January 2025?": True,
             "Show the image of Marina Beach, Chennai in January 2025": False,
             "Show the scene of Marina Beach in January 2025 and show the NDWI": False}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", questions.question_flags(F.col("q"))["visual"].alias("v"))
    assert {r.q: r.v for r in rows.collect()} == asked


def test_places_that_cannot_be_analysed_are_named(spark):
    def found(query, osm_type, size):
        return (query, 1, "13.0", "80.0", ["13.0", str(13.0 + size), "80.0", str(80.0 + size)], query, "leisure", "park", osm_type, query)

    raw = spark.createDataFrame([found("park", "way", 0.01), found("stop", "node", 0.01), found("desert", "relation", 5.0)],
                                "query string, rank int, lat string, lon string, boundingbox array<string>, display_name string, "
                                "class string, type string, osm_type string, name string")
    kept, _ = gazetteer.parse_candidates(raw)
    asked = spark.createDataFrame([("park",), ("stop",), ("desert",), ("nowhere",)], "query string")
    reasons = {r.query: r.reason for r in gazetteer.location_reasons(asked, gazetteer.select_candidate(kept)).collect()}
    assert reasons == {"park": None, "stop": "location_is_point", "desert": "area_too_large", "nowhere": "location_not_found"}
