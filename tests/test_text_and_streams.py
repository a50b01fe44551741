from __future__ import annotations

from collections import deque
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from earthframe.functions import claims as T
from earthframe.functions import questions as Q
from earthframe.functions.rules import first_failure
from earthframe.functions.times import separation_days
from earthframe.operators import questions as O
from earthframe.operators import radiometry as R
from earthframe.operators import requests as V
from earthframe.streaming.admission import admit_batch, admit_stream
from earthframe.streaming.run import drain
from earthframe.streaming.stages import stage_stream


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("literal,value,ok", [
    ("0.28", 0.2777, True), ("0.27", 0.2777, False), ("1,234", 1234.0, True), ("12,34", 1234.0, False),
    ("1.5e3", 1540.0, True), ("−12.39", -12.3901, True), ("3", 2.6, True)])
def test_value_agreement(spark, literal, value, ok):
    assert one(spark, T.value_agrees(F.lit(literal), F.lit(value)))[0] is ok


def test_numbers_skip_identifiers_and_keep_units(spark):
    got = one(spark, T.extract_numbers(F.lit("S2B_44PLV_20241026 gave 0.85. Then 12km2, -3 and 1.5e10.")))[0]
    assert got == ["0.85", "12", "-3", "1.5e10"]


@pytest.mark.parametrize("text,analyses", [
    ("Show NDWI, not NDVI", ["ndwi"]), ("Do not bother with imagery, but do compute NDWI", ["ndwi"]),
    ("What is NDVI?", []), ("How leafy is it there?", ["ndvi"]), ("How NDVI is computed", []),
    ("If water rises, show radar", []), ("Is 'water' shown? Map built-up areas.", ["ndbi"]),
    ("Compute NDVI and water", ["ndvi", "ndwi"])])
def test_requested_mentions(spark, text, analyses):
    assert one(spark, Q.question_flags(F.lit(text)))[0].analyses == analyses


def test_may_needs_a_date_word_and_years_are_inherited_along_links(spark):
    d = one(spark, Q.extract_dates(F.lit("water may rise in May 2020, between June and July and August 2021")))[0]
    assert [(e.text, e.year) for e in d] == [
        ("May 2020", 2020), ("June", 2021), ("July", 2021), ("August 2021", 2021)]
    i = one(spark, Q.date_interval(F.get(Q.extract_dates(F.lit("on 30 February 2021")), F.lit(0))))[0]
    assert i.start_date is None


@pytest.mark.parametrize("baseline,flag,state", [
    ("05.11", "true", "removed_by_provider"), ("04.00", "false", "not_removed"),
    ("05.11", "absent", "not_published"), ("05.11", "unparseable", "unparseable"),
    ("03.01", "false", "not_introduced"), ("03.01", "true", "contradictory"), (None, "true", "contradictory")])
def test_offset_state(spark, baseline, flag, state):
    assert one(spark, R.offset_state(F.lit(baseline).cast("string"), F.lit(flag)))[0] == state


def test_first_failure_order_and_unknowns(spark):
    rules = [(F.lit(None).cast("boolean"), "a"), (F.lit(True), "b"), (F.lit(True), "c")]
    assert one(spark, first_failure(rules))[0] == "b"


def test_mixed_zones_have_no_separation(spark):
    a, b, c = F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-02T06:00:00+06:00"), F.lit("2024-01-03")
    assert one(spark, separation_days(a, b), separation_days(a, c))[:] == (1.0, None)


def test_first_failing_request_rule_wins(spark):
    bad = '{"operation": "ndvi", "aoi": {"bbox": [81, 13, 80, 14]}, "time_window": {}}'
    ok = ('{"operation": " NDVI ", "aoi": {"bbox": [80.25, 13, 80.3, 13.05]}, "time_window": '
          '{"start_date": "2024-01-01", "end_date": "2024-01-31"}}')
    df = spark.createDataFrame([(1, bad), (2, ok)], "id int, payload string")
    got = {r.id: r.code for r in V.validate_requests(df, date(2024, 12, 31)).collect()}
    assert got == {1: "aoi_invalid", 2: None}


def events(n=400):
    start = datetime(2024, 1, 1)
    # Client 1 holds most events, with bursts and a boundary hit exactly one window later.
    rows = [(1, i, start + timedelta(seconds=7 * i + (900 if i > 200 else 0))) for i in range(n)]
    rows += [(2, n, start), (2, n + 1, start + timedelta(seconds=1)), (2, n + 2, start + timedelta(seconds=60))]
    return rows


def expected(rows, limit, window):
    hits, out = {}, {}
    for client, event, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        q = hits.setdefault(client, deque())
        now = (ts - datetime(2024, 1, 1)).total_seconds()
        while q and q[0] <= now - window:
            q.popleft()
        if len(q) >= limit:
            out[event] = (False, round(q[0] + window - now, 3))
        else:
            q.append(now)
            out[event] = (True, None)
    return out


def verdicts(df):
    return {r.event_id: (r.admitted, None if r.retry_after is None or r.retry_after != r.retry_after
                         else round(r.retry_after, 3)) for r in df.collect()}


@pytest.mark.parametrize("limit", [1, 5])
def test_admission_counts_only_admitted_hits(spark, limit):
    rows = events()
    df = spark.createDataFrame(rows, "client long, event_id long, ts timestamp")
    assert verdicts(admit_batch(df, limit, 60.0)) == expected(rows, limit, 60.0)


def test_streams_equal_their_batch_twins(spark, tmp_path):
    rows = events(120)
    df = spark.createDataFrame(rows, "client long, event_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    assert verdicts(drain(admit_stream(stream, 5, 60.0))) == verdicts(admit_batch(df, 5, 60.0))

    log = df.select("ts", F.format_string("stage=read outcome=ok ms=%d", F.col("event_id")).alias("line"))
    log.coalesce(1).write.parquet(str(tmp_path / "log"))
    end = spark.createDataFrame([(datetime(2024, 1, 2), "stage=read outcome=ok ms=0")], log.schema)
    end.write.mode("append").parquet(str(tmp_path / "log"))
    streamed = stage_stream(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
                            .parquet(str(tmp_path / "log")))
    query = streamed.writeStream.format("memory").queryName("stages").outputMode("append").trigger(
        availableNow=True).start()
    query.awaitTermination()
    got = {(r.minute, r.n, r.total_ms) for r in spark.table("stages").collect()}
    batch = {(r.minute, r.n, r.total_ms) for r in stage_stream(log).collect()}
    assert got <= batch and len(batch - got) <= 1


def test_each_distinct_text_is_read_once(spark):
    """Rows that repeat five texts and a null: reading costs six rows, also under a filter on what is read."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def size(text):
        reads.add(1)
        return None if text is None else len(text)

    rows = spark.range(2000).select("id", F.when(F.col("id") % 6 > 0, F.repeat(F.lit("a"), (F.col("id") % 6).cast("int"))).alias("text"))
    read = O.read_once(rows, lambda texts: texts.select("text", size("text").alias("n")))
    got = {r.id: r.n for r in read.where("n IS NULL OR n > 1").collect()}
    assert got == {i: i % 6 or None for i in range(2000) if i % 6 != 1}
    assert reads.value <= 12
