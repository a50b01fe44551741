"""The pixels that a task of the display stretch holds do not grow with the input."""

from __future__ import annotations

from pyspark.sql import functions as F

from earthframe.operators import pixels as P


def test_tasks_hold_a_bounded_number_of_pixels(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_PIXELS", 50)
    px = spark.range(2000).select((F.col("id") % 97).alias("scene_id"), (F.col("id") % 31).cast("double").alias("v"), (F.col("id") % 5 > 0).alias("ok"))
    shown = P.display_stretch(px, ["scene_id"], "v", "ok")
    assert "hashpartitioning(scene_id" in (plan := shown._jdf.queryExecution().executedPlan().toString()) and ", 40), REPARTITION_BY_NUM" in plan
    assert shown.count() == 2000
