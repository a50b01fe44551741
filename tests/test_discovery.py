"""Counts, pages and choices of windows against the pairs that ``discover`` gives."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from earthframe.operators import catalog

WINDOWS = ("request_id long, modality string, label string, start_date date, end_date date, "
           "aoi_west double, aoi_south double, aoi_east double, aoi_north double")
SCENES = ("id string, collection string, datetime string, acquired_date date, cloud_cover double, processing_level string, "
          "west double, south double, east double, north double")
DAY = dt.date(2020, 1, 1)


def _scenes(spark, n: int, seed: int = 7):
    r, rows = random.Random(seed), []
    for i in range(n):
        west, south = r.uniform(-30, 30), r.uniform(-30, 30)
        box = [west, south, west + r.choice((0.0, 1.0, 25.0)), south + 2.0]
        if i % 3 == 0:
            box = [None] * 4
        elif i % 7 == 0:
            box[r.randrange(4)] = None
        day = None if i % 31 == 0 else DAY + dt.timedelta(r.randrange(120))
        rows.append((f"s{i}", r.choice(list(catalog.COLLECTION_OF.values())), r.choice((None, f"{day}T00:00:00Z")), day,
                     r.choice((None, 5.0, 50.0)), "L2A", *box))
    return spark.createDataFrame(rows, SCENES)


def _windows(spark, n: int, seed: int = 8):
    r, rows = random.Random(seed), []
    for i in range(n):
        west, south, start = r.uniform(-30, 30), r.uniform(-30, 30), DAY + dt.timedelta(r.randrange(120))
        rows.append((i // 2, r.choice(list(catalog.COLLECTION_OF)), f"w{i}", start, start + dt.timedelta(r.choice((-1, 0, 29, 70))),
                     west, south, west + r.choice((-1.0, 0.0, 1.0, 40.0)), south + r.choice((0.0, 15.0))))
    return spark.createDataFrame(rows, WINDOWS)


def test_answers_are_those_of_all_pairs(spark, monkeypatch):
    for block in (catalog.BLOCK, 7):  # once with many blocks a bucket
        monkeypatch.setattr(catalog, "BLOCK", block)
        windows, scenes = _windows(spark, 60), _scenes(spark, 300)
        pairs = {}
        for p in catalog.discover(windows, scenes).collect():
            pairs.setdefault(p.label, []).append(p)
        rows = catalog.execute(windows, scenes, 5).collect()
        assert len(rows) == 60 and 0 < len(pairs) < 60
        for row in rows:
            found = sorted(pairs.get(row.label, []), key=lambda p: p.id)
            optical = row.modality == catalog.OPTICAL
            best = min(found[:5], default=None, key=lambda p: (
                optical and p.cloud_cover is None, optical and p.cloud_cover or 0.0, p.datetime is None, p.datetime or "", p.id))
            assert (row.scenes_matched, row.scene_count) == (len(found), min(len(found), 5))
            assert (row.scene and row.scene.asDict()) == (best and {c: best[c] for c in catalog.SCENE_FIELDS})
        listed = {(r.label, r.id) for r in catalog.paged(windows, scenes, 5).collect()}
        assert listed == {(k, p.id) for k, v in pairs.items() for p in sorted(v, key=lambda p: p.id)[:5]}
        seen = {r.label: r.found for r in catalog.found_windows(windows, scenes).collect()}
        assert seen == {r.label: r.label in pairs for r in rows}


def test_execution_shuffles_no_pairs(spark):
    """600 windows by 1,500 scenes make 900,000 pairs; only pages and counts may move."""
    windows = spark.range(600).select(
        F.col("id").alias("request_id"), F.lit(catalog.OPTICAL).alias("modality"), F.lit("single").alias("label"),
        F.lit(DAY).alias("start_date"), F.lit(DAY).alias("end_date"), (F.col("id") / 1e4).alias("aoi_west"),
        F.lit(0.0).alias("aoi_south"), F.lit(1.0).alias("aoi_east"), F.lit(1.0).alias("aoi_north"))
    scenes = spark.range(1500).select(
        F.format_string("s%06d", F.col("id")).alias("id"), F.lit("sentinel-2-l2a").alias("collection"), F.lit(None).cast("string").alias("datetime"),
        F.lit(DAY).alias("acquired_date"), F.rand(3).alias("cloud_cover"), F.lit("L2A").alias("processing_level"),
        *[F.lit(v).cast("double").alias(e) for e, v in (("west", 0.5), ("south", 0.5), ("east", 2.0), ("north", 2.0))])

    def written() -> int:
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    total = catalog.execute(windows, scenes).agg(F.sum("scenes_matched")).first()[0]
    assert total == 900_000
    assert written() - before < 2_000_000


def test_broken_requests_leave_before_pairs_are_made(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["j6_discover_beside_broken"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Join Inner") < plan.index("LeftAnti")


def test_searches_take_every_hundredth_request_against_all_scenes(spark):
    """What is returned grows with the scenes times a hundredth of the requests; none of those requests loses a scene."""
    import __spark_entry__ as entry
    from earthframe.operators import catalog as C
    from earthframe.plans import views as V

    sf_dir = "/root/testdata/sf0.01"
    every = C.discover(V.windows(spark, sf_dir), V.scenes(spark, sf_dir)).select("request_id", "modality", "label", "id")
    wanted = sorted(tuple(r) for r in every.where("request_id % 100 = 0").collect())
    for name in ("j6_discover", "p6_p7_p8_boxes"):
        found = entry.queries()[name](spark, sf_dir)
        assert {r.request_id % 100 for r in found.select("request_id").distinct().collect()} == {0}
        if name == "j6_discover":
            assert wanted and sorted(tuple(r) for r in found.select("request_id", "modality", "label", "id").collect()) == wanted


def test_discovery_answers_every_request(spark, con):
    """No request is left out, whatever its id, in the queries and in their SQL alike."""
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.001"
    con.execute(f"CREATE OR REPLACE TEMP TABLE every AS SELECT DISTINCT request_id FROM ({entry.oracle_sql()['j6_discover']})")
    assert con.execute("SELECT count(DISTINCT request_id % 100) > 50 FROM every").fetchone()[0]
    for name in ("j6_discover", "p6_p7_p8_boxes", "j6_discover_beside_broken"):
        found = {r[0] for r in entry.queries()[name](spark, sf_dir).select("request_id").distinct().collect()}
        asked = {r[0] for r in con.execute("SELECT request_id FROM every" + (
            " WHERE request_id % 11 <> 0 AND request_id % 13 <> 0 AND request_id % 17 <> 0" if name.endswith("broken") else "")).fetchall()}
        assert found == asked
