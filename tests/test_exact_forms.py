"""Forms that must not depend on the order of rows, on repeated work or on Python strings."""

from __future__ import annotations

import math
import random
import unicodedata

from pyspark.sql import functions as F

from earthframe.functions.grids import general
from earthframe.functions.text import nfkd
from earthframe.plans.evidence_queries import exact_mean, small_sample


def test_a_mean_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    rng = random.Random(5)
    values = [(round(rng.random() / 10, 2), round(rng.random() / 12, 2)) for _ in range(86)]
    rows = []
    for group in range(40):
        rng.shuffle(values)
        rows += [(group, 1, d, t) for d, t in values]
    df = spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_discount double, l_tax double")
    means = df.groupBy("l_suppkey").agg(exact_mean("l_discount").alias("m")).select("m").distinct().collect()
    assert [r.m for r in means] == [math.fsum(d for d, _ in values) / len(values)]
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert small_sample(spark, str(tmp_path)).select("second_stronger").distinct().count() == 1


def test_general_is_percent_g(spark):
    values = [0.0, -0.0, 10.0, -20.0, 999999.0, 1000000.0, 1e6 + 0.5, 0.5, -0.25, 1 / 3, 123456.7, 0.0001, 0.00001, 1e300, -399960.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", general(F.col("v")).alias("g")).collect()
    assert [r.g for r in rows] == [f"{r.v:g}" for r in rows]


def test_decomposition_is_that_of_unicode(spark):
    texts = ["plain", "Ünïcödé ﬁ ①", "", None, "ｱ가"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfkd("t").alias("n")).collect()
    assert [r.n for r in rows] == [None if r.t is None else unicodedata.normalize("NFKD", r.t) for r in rows]
