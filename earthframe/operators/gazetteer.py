"""Place candidates in source order and the rules that pick one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.functions.boxes import aoi_extent_m, aoi_too_large, bbox, valid_bbox
from earthframe.functions.rules import first_failure
from earthframe.functions.text import name_tokens

# Fixed value: how many candidates one search considers.
CANDIDATE_LIMIT = 5


def cap_candidates(df: DataFrame, k: int = CANDIDATE_LIMIT) -> DataFrame:
    return df.where(F.col("rank") <= k)


def parse_candidates(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejected queries) from rows query, rank (1-based), lat, lon, boundingbox...

    ``boundingbox`` is four texts [south, north, west, east]. A query whose first candidate
    does not parse is rejected; a malformed later one is dropped and never repaired.
    """
    def edge(i: int) -> Column:
        return F.get("boundingbox", F.lit(i)).try_cast("double")

    box = bbox(edge(2), edge(0), edge(3), edge(1))

    def text(name: str) -> Column:
        clean = F.substring(F.trim(name), 1, 60)
        return F.when(clean != "", clean).alias(name)

    parsed = cap_candidates(raw).select(
        "query", "rank", F.coalesce("display_name", F.lit("")).alias("display_name"),
        F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"),
        F.when(F.size("boundingbox") == 4, box).alias("bbox"),
        text("class"), text("type"), text("osm_type"), text("name"))
    good = (F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
            & F.coalesce(valid_bbox(F.col("bbox")), F.lit(False)))
    parsed = parsed.withColumn("_ok", F.coalesce(good, F.lit(False)))
    broken = parsed.where((F.col("rank") == 1) & ~F.col("_ok")).select(
        "query", F.lit("unexpected first candidate").alias("reason"))
    kept = parsed.where("_ok").join(broken, "query", "left_anti").drop("_ok")
    return kept, broken


def point_like() -> Column:
    """A node is only a point, unless it is how a settlement is mapped."""
    return F.coalesce((F.col("osm_type") == "node") & ~F.coalesce(
        F.col("class") == "place", F.lit(False)), F.lit(False))


def with_name_match(candidates: DataFrame) -> DataFrame:
    """Add ``names_query``: every word before the query's first comma is the candidate's.

    Words of the candidate's name (or of its display name's first part), class and type count.
    """
    head = F.coalesce("name", F.substring_index("display_name", ",", 1))
    sep = F.lit(" ")
    have = F.concat(head, sep, F.coalesce("class", F.lit("")), sep,
                    F.translate(F.coalesce("type", F.lit("")), "_", " "))
    tokens = candidates.withColumn(
        "_wanted", name_tokens(F.substring_index("query", ",", 1))).withColumn(
        "_have", name_tokens(have))
    return tokens.withColumn("names_query", (F.size("_wanted") > 0) & (
        F.size(F.array_except("_wanted", "_have")) == 0)).drop("_wanted", "_have")


def select_candidate(candidates: DataFrame) -> DataFrame:
    """The first result, unless it is a point and a later extent carries the query's name."""
    marked = with_name_match(candidates).withColumn("point_like", point_like())
    fields = [c for c in marked.columns if c not in ("query", "names_query")]
    better = ~F.col("point_like") & F.col("names_query") & (F.col("rank") > 1)
    per = marked.groupBy("query").agg(
        F.min_by(F.struct(*fields), "rank").alias("first"),
        F.min_by(F.struct(*fields), F.when(better, F.col("rank"))).alias("extent"),
        F.min(F.when(better, F.col("rank"))).alias("_better"))
    chosen = F.when(F.col("first.point_like") & F.col("_better").isNotNull(),
                    F.col("extent")).otherwise(F.col("first"))
    return per.select("query", chosen.alias("c")).select("query", "c.*")


def location_reasons(queries: DataFrame, selected: DataFrame) -> DataFrame:
    """(query, reason) for places that can't be analysed: not found, only a point, or too large; else NULL.

    ``queries``: query. ``selected``: the chosen candidate of each query (``select_candidate``).
    """
    chosen = selected.select("query", "point_like", "bbox").withColumn("_found", F.lit(True))
    return queries.join(chosen, "query", "left").select("query", first_failure([
        (F.col("_found").isNull(), "location_not_found"), (F.col("point_like"), "location_is_point"),
        (aoi_too_large(aoi_extent_m(F.col("bbox"))), "area_too_large")]).alias("reason"))


def geocoder_counters(log: DataFrame) -> DataFrame:
    """Requests, throttled, cache hits, coalesced and refused per service from its log."""
    kinds = {"upstream_requests": "request", "throttled": "throttled", "cache_hits": "cache_hit",
             "coalesced": "coalesced", "refused_during_cooldown": "refused"}
    return log.groupBy("service").agg(*[
        F.count_if(F.col("event") == event).alias(name) for name, event in kinds.items()])
