"""Scene discovery and choice: windows are joined to the catalog in one distributed job."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earthframe.functions.boxes import bbox_intersects
from earthframe.functions.rules import first_failure, lookup, notes

# The collection each sensor family is discovered in.
COLLECTION_OF = {
    "sentinel-2-optical": "sentinel-2-l2a",
    "sentinel-1-sar": "sentinel-1-rtc",
}
OPTICAL, SAR = "sentinel-2-optical", "sentinel-1-sar"
# Page size bounds.
DEFAULT_LIMIT, MAX_LIMIT = 10, 100
# Fixed value: most windows one request may carry.
MAX_TIME_WINDOWS = 24

WINDOW_KEY = ["request_id", "modality", "label"]


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must lie in 1..{MAX_LIMIT}")


def search_scenes(scenes: DataFrame, aoi: tuple[float, float, float, float], start: date,
                  end: date, collection: str = COLLECTION_OF[OPTICAL],
                  max_cloud: float | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page of scenes of a collection over an area and closed date interval.

    The cloud limit applies to the optical collection alone. All predicates are plain
    column comparisons, so they reach the scan; the page is a top-k, never a full sort.
    """
    _check_limit(limit)
    if start > end:
        raise ValueError("start must not be after end")
    west, south, east, north = (F.lit(float(v)) for v in aoi)
    apart = (
        (F.col("east") < west) | (F.col("west") > east)
        | (F.col("north") < south) | (F.col("south") > north)
    )
    found = scenes.where(
        (F.col("collection") == collection)
        & F.col("acquired_date").between(F.lit(start), F.lit(end))
        & F.coalesce(~apart, F.lit(True))
    )
    if max_cloud is not None and collection == COLLECTION_OF[OPTICAL]:
        found = found.where(F.col("cloud_cover") <= max_cloud)
    return found.orderBy("id").limit(limit)


def reject_requests(requests: DataFrame) -> DataFrame:
    """(request_id, code) of the requests that can't be run, by the first rule they break.

    ``requests``: request_id, windows and, where it is known, aoi_west .. aoi_north.
    """
    inverted = F.exists("windows", lambda w: w["start_date"] > w["end_date"])
    rules = [(F.coalesce(F.size("windows"), F.lit(0)) <= 0, "windows_missing"),
             (F.size("windows") > MAX_TIME_WINDOWS, "too_many_windows"), (inverted, "window_inverted")]
    if {"aoi_west", "aoi_south", "aoi_east", "aoi_north"} <= set(requests.columns):
        rules.append(((F.col("aoi_west") > F.col("aoi_east")) | (F.col("aoi_south") > F.col("aoi_north")), "area_inverted"))
    return requests.select("request_id", first_failure(rules).alias("code")).where("code IS NOT NULL")


def expand_windows(requests: DataFrame) -> DataFrame:
    """Request -> one row per (modality, labelled window), in request order.

    Requests over MAX_TIME_WINDOWS are refused as a whole: ``reject_requests`` gives them back.
    """
    label = (
        F.when((F.col("mode") == "compare") & (F.col("_i") == 0), "baseline")
        .when(F.col("mode") == "compare", "target")
        .when(F.col("mode") == "single", "single")
        .otherwise(F.concat(F.lit("series["), F.col("_i").cast("string"), F.lit("]")))
    )
    rest = [c for c in requests.columns if c not in ("modalities", "windows", "mode")]
    return (
        requests.where(F.size("windows") <= MAX_TIME_WINDOWS)
        .select(*rest, "mode", "windows", F.posexplode("modalities").alias("_m", "modality"))
        .select(*rest, "mode", "_m", "modality", F.posexplode("windows").alias("_i", "w"))
        .where((F.col("mode") != "single") | (F.col("_i") == 0))
        .select(
            *rest, "modality", label.alias("label"), F.col("w.start_date").alias("start_date"),
            F.col("w.end_date").alias("end_date"),
            (F.col("_m") * MAX_TIME_WINDOWS + F.col("_i")).alias("pos"),
        )
    )


_NO_TILE = -9999


def _tiles(west: str, south: str, east: str, north: str, degrees: float) -> Column:
    """Every (x, y) tile a box touches, as an array of structs."""
    def at(name: str) -> Column:
        return F.floor(F.col(name) / degrees).cast("int")

    return F.flatten(F.transform(
        F.sequence(at(west), at(east)),
        lambda x: F.transform(F.sequence(at(south), at(north)),
                              lambda y: F.struct(x.alias("x"), y.alias("y"))),
    ))


def discover(windows: DataFrame, scenes: DataFrame, tile_degrees: float = 10.0) -> DataFrame:
    """Every scene that matches a window: collection, date interval, touching footprint.

    The join is an equi-join on (collection, month, tile); exact dates and boxes are then a
    filter. A pair sharing several tiles is kept once, at the lowest tile both touch. Scenes
    without a footprint are never excluded by area and meet windows on a tile of their own.
    A (month, tile) that holds very many scenes is split by AQE's skew join: both sides
    are plain shuffles and nothing per bucket is gathered.
    """
    month = F.trunc("acquired_date", "MM")
    s = (
        scenes.where(F.col("acquired_date").isNotNull())
        .withColumn("_month", month)
        .withColumn("_tile", F.explode(F.coalesce(
            _tiles("west", "south", "east", "north", tile_degrees),
            F.array(F.struct(F.lit(_NO_TILE).alias("x"), F.lit(_NO_TILE).alias("y"))),
        )))
    )
    # An inverted window or area matches nothing; ``reject_requests`` names it.
    sound = (F.col("start_date") <= F.col("end_date")) & (F.col("aoi_west") <= F.col("aoi_east")) & (
        F.col("aoi_south") <= F.col("aoi_north"))
    w = (
        windows.where(sound).withColumn("collection", lookup(COLLECTION_OF, F.col("modality")))
        .withColumn("_month", F.explode(F.sequence(
            F.trunc("start_date", "MM"), F.trunc("end_date", "MM"), F.expr("interval 1 month"))))
        .withColumn("_tile", F.explode(F.concat(
            _tiles("aoi_west", "aoi_south", "aoi_east", "aoi_north", tile_degrees),
            F.array(F.struct(F.lit(_NO_TILE).alias("x"), F.lit(_NO_TILE).alias("y"))),
        )))
    )
    box = F.struct(F.col("aoi_west").alias("west"), F.col("aoi_south").alias("south"),
                   F.col("aoi_east").alias("east"), F.col("aoi_north").alias("north"))
    footprint = F.struct("west", "south", "east", "north")

    def low(a: str, b: str) -> Column:
        return F.greatest(F.floor(F.col(a) / tile_degrees), F.floor(F.col(b) / tile_degrees))

    home = F.col("west").isNull() | (
        (F.col("_tile.x") == low("west", "aoi_west"))
        & (F.col("_tile.y") == low("south", "aoi_south"))
    )
    return (
        w.join(s, ["collection", "_month", "_tile"])
        .where(F.col("acquired_date").between(F.col("start_date"), F.col("end_date")))
        .where(bbox_intersects(box, footprint) & home)
        .drop("_month", "_tile")
    )


def page(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
         limit: int = DEFAULT_LIMIT) -> DataFrame:
    """First ``limit`` rows of each group; Spark prunes groups before the shuffle."""
    _check_limit(limit)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank")


def _known_first(column: str) -> list[Column]:
    return [F.col(column).isNull(), F.col(column)]


def scene_order(optical: Column | bool = True) -> Column:
    """Sort key of scene choice; unknown values last, cloud ignored for radar."""
    cloud: list[Column] = []
    if optical is True:
        cloud = _known_first("cloud_cover")
    elif isinstance(optical, Column):
        cloud = [F.when(optical, F.col("cloud_cover").isNull()).otherwise(F.lit(False)),
                 F.when(optical, F.col("cloud_cover"))]
    return F.struct(*[
        k.alias(f"k{i}") for i, k in enumerate([*cloud, *_known_first("datetime"), F.col("id")])
    ])


def select_scene(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Optical choice per group: clearest, then earliest text time, then id."""
    return df.groupBy(*by).agg(F.min_by("id", scene_order(True)).alias("selected_scene_id"))


def select_scene_sar(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Radar choice per group: earliest text time, then id."""
    return df.groupBy(*by).agg(F.min_by("id", scene_order(False)).alias("selected_scene_id"))


QUESTION = ["_collection", "_start", "_end", "_west", "_south", "_east", "_north"]
# Fixed value: about how many scenes, and how many questions, meet in one block.
BLOCK = 16_384
_ENTRY = "struct<id: string, datetime: string, cloud_cover: double>"


def _asked(windows: DataFrame) -> DataFrame:
    """Windows with what they ask of the catalog; equal questions are answered once."""
    return windows.withColumns({
        "_collection": lookup(COLLECTION_OF, F.col("modality")), "_start": F.col("start_date"), "_end": F.col("end_date"),
        **{f"_{e}": F.col(f"aoi_{e}").cast("double") for e in ("west", "south", "east", "north")}})


def _match_blocks(limit: int):
    """Arrow batches of blocks (scenes by id, then questions) -> matches and first scenes per question and block."""
    import numpy as np
    import pyarrow as pa

    def numbers(batch, name: str):
        column = batch.column(name)
        column = column.cast(pa.int32()) if pa.types.is_date(column.type) else column
        return column.to_numpy(zero_copy_only=False)

    facts = ("_start", "_west", "_south", "_east", "_north", "_hx", "_hy")
    shown = ("id", "datetime", "cloud_cover")

    def answered(part, scenes, entries, tile):
        q = {name: numbers(part, name) for name in (*facts, "_end")}
        counts, picked = [], []
        for at in range(0, part.num_rows, 64):
            a = {name: v[at:at + 64, None] for name, v in q.items()}
            hit = (scenes["_start"] >= a["_start"]) & (scenes["_start"] <= a["_end"])
            hit &= ~((a["_east"] < scenes["_west"]) | (a["_west"] > scenes["_east"]))
            hit &= ~((a["_north"] < scenes["_south"]) | (a["_south"] > scenes["_north"]))
            if tile != (_NO_TILE, _NO_TILE):  # a pair counts at the lowest tile both touch
                hit &= (np.maximum(a["_hx"], scenes["_hx"]) == tile[0]) & (np.maximum(a["_hy"], scenes["_hy"]) == tile[1])
            counts.append(hit.sum(axis=1))
            if limit:
                picked += [np.flatnonzero(row)[:limit] for row, n in zip(hit, counts[-1]) if n]
        n = np.concatenate(counts)
        some = np.flatnonzero(n)
        if not len(some):
            return None
        sizes = [len(p) for p in picked] if limit else [0] * len(some)
        order = pa.array(np.concatenate(picked) if picked else [], pa.int64())
        page = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
            pa.StructArray.from_arrays([e.take(order) for e in entries], list(shown)))
        kept = part.select(QUESTION).take(pa.array(some))
        return pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(n[some], pa.int64()), page], [*QUESTION, "scenes_matched", "page"])

    def run(batches):
        block, held, ready, entries = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, side = numbers(batch, "_block"), numbers(batch, "_side")
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                part = batch.slice(lo, hi - lo)
                if g[lo] != block:
                    block, held, ready = g[lo], [], None
                if side[lo] == 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        table = pa.Table.from_batches(held)
                        ready = {name: np.concatenate([numbers(p, name) for p in held])[None, :] for name in facts}
                        entries = [table.column(c).combine_chunks() for c in shown]
                        entries = [e.combine_chunks() if isinstance(e, pa.ChunkedArray) else e for e in entries]
                    tile = (part.column("_x")[0].as_py(), part.column("_y")[0].as_py())
                    out = answered(part, ready, entries, tile)
                    if out is not None:
                        yield out

    return run


def _answer(questions: DataFrame, scenes: DataFrame, on: Sequence[str], limit: int) -> DataFrame:
    """QUESTION, scenes_matched, page: exact counts and the first ``limit`` scenes by id.

    Both sides carry QUESTION's columns (a scene's dates and footprint) and the bucket ``on``. Pairs live only inside a
    task, one bucket at a time; a bucket beyond BLOCK on a side is dealt into blocks. What is shuffled grows with the
    two inputs: a question brings ``limit`` scenes at most from each block it meets, however many match.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))

    dealt = blocks(scenes, "_scenes").join(blocks(questions, "_questions"), list(on))
    row = F.xxhash64(*QUESTION)
    columns = ["_side", "id", "datetime", "cloud_cover", *QUESTION, "_hx", "_hy", "_x", "_y", "_block"]

    def side(df: DataFrame, number: int, mine: str, other: str, hashed: Column) -> DataFrame:
        met = df.join(dealt, list(on)).withColumn("_mine", F.pmod(hashed, F.col(mine))).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        pair = ("_mine", "_other") if number == 0 else ("_other", "_mine")
        return met.withColumn("_side", F.lit(number)).withColumn(
            "_block", F.concat_ws(":", "_collection", "_month", "_x", "_y", *pair)).select(*columns)

    empty = {"id": F.lit(None).cast("string"), "datetime": F.lit(None).cast("string"),
             "cloud_cover": F.lit(None).cast("double")}
    both = side(scenes, 0, "_scenes", "_questions", F.xxhash64("id", *QUESTION)).unionByName(
        side(questions.withColumns(empty), 1, "_questions", "_scenes", row))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in QUESTION) + f", scenes_matched long, page array<{_ENTRY}>"
    parts = both.repartition("_block").sortWithinPartitions("_block", "_side", "id").mapInArrow(
        _match_blocks(limit), schema)
    return parts.groupBy(*QUESTION).agg(
        F.sum("scenes_matched").alias("scenes_matched"), _first(F.flatten(F.collect_list("page")), limit).alias("page"))


def _first(entries: Column, limit: int) -> Column:
    return F.slice(F.array_sort(entries), 1, limit)


def answers(windows: DataFrame, scenes: DataFrame, limit: int = DEFAULT_LIMIT, tile_degrees: float = 10.0) -> DataFrame:
    """Windows with ``scenes_matched`` and ``page``, the first ``limit`` matching scenes by id, as :func:`discover` finds them.

    No pair of window and scene is ever shuffled or sorted. Scenes without a footprint match by collection and dates
    alone, so they meet the distinct intervals instead of the windows.
    """
    edges = ("west", "south", "east", "north")
    no_tile = F.struct(F.lit(_NO_TILE).alias("x"), F.lit(_NO_TILE).alias("y"))

    def placed(df: DataFrame, tiles: Column) -> DataFrame:
        return df.withColumn("_tile", F.explode(tiles)).withColumns({
            "_x": F.col("_tile.x"), "_y": F.col("_tile.y"), "_hx": F.floor(F.col("_west") / tile_degrees).cast("double"),
            "_hy": F.floor(F.col("_south") / tile_degrees).cast("double")}).drop("_tile")

    own = _tiles("_west", "_south", "_east", "_north", tile_degrees)
    known = [F.col(e).isNotNull() for e in edges]
    s = scenes.where(F.col("acquired_date").isNotNull()).select(
        F.col("id").cast("string").alias("id"), F.col("datetime").cast("string").alias("datetime"),
        F.col("cloud_cover").cast("double").alias("cloud_cover"), F.col("collection").alias("_collection"),
        F.col("acquired_date").alias("_start"), F.col("acquired_date").alias("_end"),
        F.trunc("acquired_date", "MM").alias("_month"), *[F.col(e).cast("double").alias(f"_{e}") for e in edges],
        (known[0] & known[1] & known[2] & known[3]).alias("_located"),
        (~known[0] & ~known[1] & ~known[2] & ~known[3]).alias("_nowhere"))
    q = _asked(windows).where(
        (F.col("_start") <= F.col("_end")) & (F.col("_west") <= F.col("_east")) & (F.col("_south") <= F.col("_north"))
    ).select(*QUESTION).distinct()
    months = F.explode(F.sequence(F.trunc("_start", "MM"), F.trunc("_end", "MM"), F.expr("interval 1 month")))

    somewhere = s.where(F.col("_located") | (F.col("_west").isNull() & ~F.col("_nowhere")))
    by_place = _answer(
        placed(q.withColumn("_month", months), F.concat(own, F.array(no_tile))),
        placed(somewhere, F.coalesce(own, F.array(no_tile))), ["_collection", "_month", "_x", "_y"], limit)

    interval = ["_collection", "_start", "_end"]
    everywhere = {f"_{e}": F.lit(v) for e, v in zip(edges, (-1e300, -1e300, 1e300, 1e300))}
    nowhere = {f"_{e}": F.lit(0.0) for e in edges}
    by_time = _answer(
        placed(q.select(*interval).distinct().withColumns(everywhere).withColumn("_month", months), F.array(no_tile)),
        placed(s.where("_nowhere").withColumns(nowhere), F.array(no_tile)), ["_collection", "_month"], limit
    ).select(*interval, F.col("scenes_matched").alias("_more"), F.col("page").alias("_rest"))

    none, zero = F.array().cast(f"array<{_ENTRY}>"), F.lit(0).cast("bigint")
    answered = q.join(by_place, QUESTION, "left").join(by_time, interval, "left").select(
        *QUESTION, (F.coalesce("scenes_matched", zero) + F.coalesce("_more", zero)).alias("scenes_matched"),
        _first(F.concat(F.coalesce("page", none), F.coalesce("_rest", none)), limit).alias("page"))
    return _asked(windows).join(answered, QUESTION, "left").withColumn(
        "scenes_matched", F.coalesce("scenes_matched", zero)).withColumn(
        "page", F.coalesce("page", none)).drop(*QUESTION)


SCENE_FIELDS = ("id", "datetime", "cloud_cover", "collection", "processing_level",
                "west", "south", "east", "north")


def execute(windows: DataFrame, scenes: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Windows with how many scenes matched, how many the page returned, and the choice.

    ``scenes_matched`` and ``scene_count`` stay different facts; the choice is made within
    the page. Windows that found nothing keep a row with zero scenes. The chosen scene's fields are
    fetched by id, time and cloud; queries that read none of them do without that join.
    """
    _check_limit(limit)
    optical = F.col("modality") == OPTICAL

    def preference(e: Column) -> Column:
        cloud = F.when(optical, e["cloud_cover"])
        return F.struct((optical & e["cloud_cover"].isNull()).alias("k0"), cloud.alias("k1"),
                        e["datetime"].isNull().alias("k2"), e["datetime"].alias("k3"), e["id"].alias("k4"), e.alias("e"))

    def pick(e: Column | None = None) -> Column:
        def at(name: str) -> Column:
            return F.col(name) if e is None else e[name]

        return F.concat_ws("\n", at("id"), F.coalesce(at("datetime"), F.lit("?")),
                           F.coalesce(at("cloud_cover").cast("double").cast("string"), F.lit("?")))

    fields = scenes.groupBy(pick().alias("_pick")).agg(F.any_value(F.struct(*SCENE_FIELDS)).alias("scene"))
    best = F.col("_best")
    return (
        answers(windows, scenes, limit)
        .withColumn("scene_count", F.size("page").cast("bigint"))
        .withColumn("_best", F.array_min(F.transform("page", preference))["e"])
        .withColumn("selected_scene_id", best["id"])
        .withColumn("_pick", F.when(best.isNotNull(), pick(best)))
        .drop("page", "_best")
        .join(fields, "_pick", "left").drop("_pick")
    )


def paged(windows: DataFrame, scenes: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """WINDOW_KEY, id, datetime, cloud_cover: the first ``limit`` scenes of each window by id."""
    _check_limit(limit)
    return answers(windows, scenes, limit).select(*WINDOW_KEY, F.inline("page"))


def found_windows(windows: DataFrame, scenes: DataFrame) -> DataFrame:
    """Windows with ``found``: whether any scene matched. Nothing is ranked or carried for it."""
    return answers(windows, scenes, 0).withColumn("found", F.col("scenes_matched") > 0).drop("scenes_matched", "page")


def observations(executed: DataFrame) -> DataFrame:
    """The scene each window actually selected; windows without one contribute nothing."""
    keep = [c for c in executed.columns if c != "scene"]
    return executed.where(F.col("scene").isNotNull()).select(*keep, "scene.*")


def selected_scene(windows: DataFrame, window_scenes: DataFrame) -> DataFrame:
    """Window -> its selected scene row, matched by id and never by position."""
    return windows.where(F.col("selected_scene_id").isNotNull()).join(
        window_scenes.withColumnRenamed("id", "selected_scene_id"),
        [*WINDOW_KEY, "selected_scene_id"],
    )


def order_by_acquisition(obs: DataFrame) -> DataFrame:
    """Known acquisition times first, then by time; ties by window and scene."""
    return obs.orderBy(F.col("acquired_micros").asc_nulls_last(), "label", "id")


def execution_metrics(windows: DataFrame) -> DataFrame:
    """One citable scene count per (modality, label)."""
    return windows.select(
        "request_id",
        F.concat_ws(".", F.lit("execution"), "modality", "label", F.lit("scene_count")).alias("id"),
        F.concat_ws("_", "modality", "label", F.lit("scene_count")).alias("name"),
        F.col("scene_count").cast("double").alias("value"), F.lit("count").alias("unit"),
    )


def execution_status(requests: DataFrame, windows: DataFrame) -> DataFrame:
    """completed / partial / failed per request; a request without windows has failed."""
    per = windows.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("windows"), F.count("error").alias("failed"))
    status = (
        F.when(F.col("windows").isNull(), "failed").when(F.col("failed") == 0, "completed")
        .when(F.col("failed") == F.col("windows"), "failed").otherwise("partial")
    )
    return requests.select("request_id").join(per, "request_id", "left").select(
        "request_id", status.alias("status"))


def catalogs(windows: DataFrame) -> DataFrame:
    """Distinct catalogs per request in the order first seen."""
    first = windows.where(F.coalesce("catalog", F.lit("")) != "").groupBy(
        "request_id", "catalog").agg(F.min("pos").alias("pos"))
    seen = F.array_sort(F.collect_list(F.struct("pos", "catalog")))
    return first.groupBy("request_id").agg(
        F.transform(seen, lambda s: s["catalog"]).alias("catalogs"))


def first_candidate(windows: DataFrame) -> DataFrame:
    """First window with a selected scene per family, and how many others are left out."""
    return (
        windows.where(F.col("selected_scene_id").isNotNull()).groupBy("request_id", "modality")
        .agg(F.min_by(F.struct("label", "selected_scene_id"), "pos").alias("f"),
             (F.count(F.lit(1)) - 1).alias("not_analysed"))
        .select("request_id", "modality", "f.label", "f.selected_scene_id", "not_analysed")
    )


def shown_window(windows: DataFrame) -> DataFrame:
    """First window with imagery, else first with a selected scene, else none."""
    eligible = windows.where(
        F.col("imagery_scene_id").isNotNull() | F.col("selected_scene_id").isNotNull())
    order = F.struct(F.col("imagery_scene_id").isNull(), "pos")
    return (
        eligible.groupBy("request_id")
        .agg(F.min_by(F.struct("modality", "label", "selected_scene_id"), order).alias("w"))
        .select("request_id", "w.*")
    )


def execution_warnings(windows: DataFrame) -> DataFrame:
    """No scene / no imagery per window, in window order, one row per warning."""
    quoted = F.concat(F.lit("'"), F.col("label"), F.lit("'"))
    lines = notes([
        (F.col("selected_scene_id").isNull(), F.format_string(
            "No scene was selected for the %s window %s; that window contributes no "
            "observation.", F.col("modality"), quoted)),
        (F.col("imagery_error").isNotNull(), F.format_string(
            "Imagery was unavailable for the %s window %s: %s",
            F.col("modality"), quoted, F.col("imagery_error"))),
    ])
    return windows.select(
        "request_id", "pos", F.posexplode(lines).alias("line", "warning"))


def run_summary_text(windows: DataFrame) -> DataFrame:
    """One templated sentence per request, built only from what was executed."""
    part = F.format_string(
        "%s %s (%s to %s) -> %s", F.col("modality"), F.col("label"),
        F.col("start_date").cast("string"), F.col("end_date").cast("string"),
        F.coalesce("selected_scene_id", F.lit("no scene")))
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))), lambda s: s["part"])
    first_catalog = F.min_by(
        F.when(F.col("catalog").isNotNull(), F.col("catalog")),
        F.struct(F.col("catalog").isNull(), "pos"))
    return windows.groupBy("request_id", "location").agg(
        F.count(F.lit(1)).alias("_n"), first_catalog.alias("_catalog"), ordered.alias("_parts"),
    ).select("request_id", F.format_string(
        "Retrieved %d window(s) for '%s' from %s: %s.", F.col("_n"), F.col("location"),
        F.coalesce("_catalog", F.lit("none")), F.array_join("_parts", "; ")).alias("answer"))


def dedupe_metrics(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """First measurement per name in emission order (``pos``)."""
    rest = [c for c in metrics.columns if c not in (*by, "name")]
    return (
        metrics.groupBy(*by, "name").agg(F.min_by(F.struct(*rest), "pos").alias("m"))
        .select(*by, "name", "m.*")
    )


def analysis_outcomes(requested: DataFrame, metrics: DataFrame, reasons: DataFrame,
                      by: Sequence[str]) -> DataFrame:
    """completed iff ``<name>_mean`` was measured, else unavailable with its own reason."""
    made = metrics.where(F.col("name").endswith("_mean")).select(
        *by, F.expr("substring(name, 1, length(name) - 5)").alias("name"),
        F.lit(True).alias("_made")).distinct()
    return (
        requested.join(made, [*by, "name"], "left").join(reasons, [*by, "name"], "left")
        .select(*by, "pos", "name",
                F.when(F.col("_made"), "completed").otherwise("unavailable").alias("status"),
                F.when(F.col("_made").isNull(), F.col("reason")).alias("reason"))
    )


def merge_outcomes(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """One outcome per analysis: completed beats unavailable, otherwise the first."""
    order = F.struct(F.col("status") != "completed", "pos")
    return (
        outcomes.groupBy(*by, "name")
        .agg(F.min_by(F.struct("status", "reason"), order).alias("o"), F.min("pos").alias("pos"))
        .select(*by, "pos", "name", "o.*")
    )


def completeness(groups: DataFrame, merged: DataFrame, by: Sequence[str]) -> DataFrame:
    """complete / partial / none, or not_requested where nothing was asked."""
    per = merged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "completed").alias("_done"))
    verdict = (
        F.when(F.col("_n").isNull(), "not_requested").when(F.col("_done") == F.col("_n"), "complete")
        .when(F.col("_done") == 0, "none").otherwise("partial")
    )
    return groups.join(per, list(by), "left").select(*by, verdict.alias("completeness"))


def requested_operations(steps: DataFrame) -> DataFrame:
    """Union of what a run's plan steps ask for, first-seen order, once each.

    Each operation keeps only its first place before anything is gathered, so the list of a
    run is as long as its distinct operations, however many steps it has.
    """
    asked = steps.select("run_id", "pos", F.posexplode("operations").alias("at", "operation"))
    first = asked.groupBy("run_id", "operation").agg(
        F.min(F.struct("pos", "at")).alias("seen"))
    ordered = F.array_sort(F.collect_list(F.struct("seen", "operation")))
    return first.groupBy("run_id").agg(
        F.transform(ordered, lambda s: s["operation"]).alias("operations"))


def not_contained(df: DataFrame, inner: str, outer: str) -> DataFrame:
    """Rows whose ``inner`` array names something ``outer`` does not, with the leftovers."""
    return df.withColumn("extra", F.array_sort(F.array_except(inner, outer))).where(
        F.size("extra") > 0)
