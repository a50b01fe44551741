"""Evidence assembly, fixed-sentence reports and the summaries read from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.functions import claims as T

# Evidence id -> sentence, in the order a report states them.
REPORT_TEMPLATES = (
    ("ndvi.ndvi_mean", "The mean NDVI was %s index."),
    ("ndwi.ndwi_mean", "The mean NDWI was %s index."),
    ("ndbi.ndbi_mean", "The mean NDBI was %s index."),
    ("sar_backscatter.vv_mean_db", "The mean VV was %s dB."),
    ("sar_backscatter.vh_mean_db", "The mean VH was %s dB."),
    ("sar_backscatter.vv_minus_vh_mean_db", "The VV minus VH difference was %s dB."),
    ("temporal_ndwi.first.ndwi_mean", "The earlier mean NDWI was %s index."),
    ("temporal_ndwi.second.ndwi_mean", "The later mean NDWI was %s index."),
    ("temporal_ndwi.difference.mean_ndwi_difference", "The mean NDWI difference was %s index."),
)
ABSTENTION = "Insufficient evidence to answer the question."


def union_evidence(*parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, duplicates): parts in order with one running ``pos`` per run.

    Each part has run_id, pos (its own order), id, source and any of name, value, unit,
    text. ``pos`` becomes the array of the part and its own position, which orders as a list does; a
    union of unions has longer arrays.
    Ids must be unique within a run; the offending ones come back as rows.
    """
    tagged = [
        p.withColumn("pos", F.concat(
            F.array(F.lit(i).cast("bigint")),
            F.col("pos") if dict(p.dtypes)["pos"].startswith("array") else F.array(F.col("pos").cast("bigint"))))
        for i, p in enumerate(parts)
    ]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    twice = merged.groupBy("run_id", "id").agg(F.count(F.lit(1)).alias("copies")).where(
        F.col("copies") > 1)
    return merged, twice


def join_evidence(*parts: Column) -> Column:
    """Evidence of one run in one array, parts in order: what :func:`union_evidence` is for rows."""
    return F.concat(*parts)


def fixed_report(evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """One fixed-sentence answer per run from its evidence, else the abstention.

    Rows: run_id, pos, id, source, value, observations. The scene sentences belong to the
    first non-temporal value stated, or to a positive scene count when nothing was measured.
    """
    order = F.lit(None).cast("int")
    sentence = F.lit(None).cast("string")
    shown = T.display_value(F.col("value"))
    for i, (ident, template) in enumerate(REPORT_TEMPLATES):
        hit = F.col("id") == ident
        order = F.when(hit, i).otherwise(order)
        sentence = F.when(hit, F.format_string(template, shown)).otherwise(sentence)
    rows = evidence.where(F.col("value").isNotNull()).select(
        "run_id", "pos", "id", "value", "observations", order.alias("o"),
        sentence.alias("s"))
    stated = F.col("o").isNotNull()
    count = F.col("id").endswith(".scene_count") & (F.col("value") > 0)
    steady = stated & ~F.col("id").startswith("temporal_ndwi.")
    where = F.struct("id", F.get("observations", F.lit(0)).alias("seen"))
    per = rows.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(stated, F.struct("o", "s", "id")))).alias("lines"),
        F.min_by(where, F.when(steady, F.col("o"))).alias("anchor"),
        F.min_by(where, F.when(count, F.col("pos"))).alias("counted"),
        F.bool_or(steady).alias("_steady"), F.bool_or(count).alias("_count"),
    )
    none_stated = F.size("lines") == 0
    chosen = F.when(F.col("_steady"), F.col("anchor")).when(
        none_stated & F.col("_count"), F.col("counted"))
    scene = F.array_compact(F.array(
        F.concat(F.lit("Scene "), chosen["seen"]["scene_id"], F.lit(" was selected.")),
        F.when(chosen["seen"]["acquired"] != "", F.concat(
            F.lit("The scene was acquired on "), chosen["seen"]["acquired"], F.lit(".")))))
    sentences = F.concat(F.transform("lines", lambda r: r["s"]), scene)
    refs = F.concat(
        F.transform("lines", lambda r: r["id"]),
        F.when(none_stated & F.col("_count"), F.array(F.col("counted.id")))
        .otherwise(F.array().cast("array<string>")))
    report = per.select("run_id", F.array_join(sentences, " ").alias("summary"), refs.alias("refs"))
    silent = F.coalesce("summary", F.lit("")) == ""
    return runs.select("run_id").join(report, "run_id", "left").select(
        "run_id", F.when(silent, ABSTENTION).otherwise(F.col("summary")).alias("summary"),
        F.when(silent, F.array().cast("array<string>")).otherwise(F.col("refs")).alias("refs"))


SUMMARY_FIELDS = {
    **{f"{k}_{s}": f"{k}.{k}_{s}" for k in ("ndvi", "ndwi", "ndbi")
       for s in ("mean", "min", "max", "valid_pixel_count")},
    "vv": "sar_backscatter.vv_mean_db", "vh": "sar_backscatter.vh_mean_db",
    "vv_minus_vh": "sar_backscatter.vv_minus_vh_mean_db",
    "vv_pixels": "sar_backscatter.vv_valid_pixel_count",
    "vh_pixels": "sar_backscatter.vh_valid_pixel_count",
    "earlier": "temporal_ndwi.first.ndwi_mean", "later": "temporal_ndwi.second.ndwi_mean",
    "difference": "temporal_ndwi.difference.mean_ndwi_difference",
    "paired_change": "temporal_ndwi.change.ndwi_change_mean",
    "paired_pixels": "temporal_ndwi.change.paired_valid_pixel_count",
}


def run_summary(evidence: DataFrame) -> DataFrame:
    """One row per run pivoted from evidence ids by one aggregation, with its kind.

    temporal beats index beats sar beats visual observation beats imagery.
    """
    cells = [F.max(F.when(F.col("id") == ident, F.col("value"))).alias(name)
             for name, ident in SUMMARY_FIELDS.items()]
    flags = [
        F.bool_or(F.col("id").startswith("temporal_ndwi.")).alias("_temporal"),
        F.bool_or(F.col("source") == "model").alias("_observed"),
    ]
    wide = evidence.groupBy("run_id").agg(*cells, *flags)
    any_index = (F.col("ndvi_mean").isNotNull() | F.col("ndwi_mean").isNotNull()
                 | F.col("ndbi_mean").isNotNull())
    kind = (
        F.when(F.col("_temporal"), "temporal").when(any_index, "index")
        .when(F.col("vv").isNotNull() | F.col("vh").isNotNull(), "sar")
        .when(F.col("_observed"), "visual").otherwise("imagery"))
    return wide.withColumn("kind", kind).drop("_temporal", "_observed")


# Indices in everyday words (signal, index name).
PLAIN = {"ndvi": ("vegetation signal", "vegetation index"),
         "ndwi": ("water signal", "water index"),
         "ndbi": ("built-up signal", "built-up index")}
SMALL_SAMPLE_PIXELS = 100


def index_reading(key: str, mean: Column) -> Column:
    """Struct ``{headline, meaning}``; the sign is that of the value as shown."""
    signal, name = PLAIN[key]
    shown = T.signed_index(mean)
    sign = T.shown_sign(shown)
    headline = (
        F.when(sign == "positive", f"The selected area shows a positive {signal}.")
        .when(sign == "negative", f"The selected area does not show a positive {signal} on average.")
        .otherwise(f"The {name} is zero on average."))
    tail = (
        F.when(sign == "positive", f"Above zero means a positive {signal}.")
        .when(sign == "negative", f"Below zero means no positive {signal} on average.")
        .otherwise("That is zero at the precision shown - neither a positive nor a negative "
                   f"{signal}."))
    meaning = F.concat(F.lit(f"The {name} was "), shown, F.lit(". "), tail)
    return F.when(mean.isNotNull(), F.struct(headline.alias("headline"), meaning.alias("meaning")))


def sar_reading(difference: Column) -> Column:
    """Which of two radar measurements was stronger, at two decimals."""
    shown = F.concat(F.format_string("%.2f", difference), F.lit(" dB"))
    sign = T.shown_sign(shown)
    return F.when(difference.isNotNull(), F.concat(
        F.lit("The difference between the two measurements was "), shown,
        F.when(sign == "positive", ": the first was the stronger of the two.")
        .when(sign == "negative", ": the second was the stronger of the two.")
        .otherwise(": they were the same at the precision shown.")))


def temporal_reading(difference: Column) -> Column:
    """Headline of a two-date comparison."""
    sign = T.shown_sign(T.signed_index(difference))
    return (
        F.when(difference.isNull(), "The difference between the two images was not reported.")
        .when(sign == "zero",
              "The two satellite images show little measured change in the water signal.")
        .when(sign == "positive", "The later satellite image shows a stronger water signal than "
              "the earlier image.")
        .otherwise("The later satellite image shows a weaker water signal than the earlier image."))


def small_sample(count: Column, subject: str = "this result") -> Column:
    """Wording for fewer than 100 contributing pixels; NULL otherwise or when unknown."""
    usable = F.concat(F.format_string("%,d", count.cast("bigint")),
                      F.when(count == 1, " usable pixel").otherwise(" usable pixels"))
    return F.when((count >= 1) & (count < SMALL_SAMPLE_PIXELS), F.concat(
        F.lit("Small sample: only "), usable,
        F.lit(f" contributed to {subject}, so interpret it cautiously.")))


def interpret_reading(summary: DataFrame) -> DataFrame:
    """Plain-language reading of each run summary row."""
    parts = [index_reading(k, F.col(f"{k}_mean")) for k in PLAIN]
    kind = F.col("kind")
    headline = (
        F.when(kind == "temporal", temporal_reading(F.col("difference")))
        .when(kind == "index", F.concat_ws(" ", *[p["headline"] for p in parts]))
        .when(kind == "sar", sar_reading(F.col("vv_minus_vh"))))
    meaning = F.when(kind == "index", F.concat_ws(" ", *[p["meaning"] for p in parts]))
    count = F.when(kind == "index", F.coalesce(
        "ndvi_valid_pixel_count", "ndwi_valid_pixel_count", "ndbi_valid_pixel_count")).when(
        kind == "sar", F.coalesce("vv_pixels", "vh_pixels"))
    return summary.select("run_id", "kind", headline.alias("headline"), meaning.alias("meaning"),
                          small_sample(count).alias("sample_note"))


# Outcome of a clarification by its reason.
CLARIFICATION_OUTCOME = {
    "location_not_found": "location_not_found", "location_is_point": "location_is_point",
    "area_too_large": "area_too_large", "analysis_unsupported": "unsupported",
    "requires_ai_model": "unsupported",
}


def classify_outcome() -> Column:
    """One of eleven outcomes from a run's flags; the order of the tests is the rule.

    Reads status, clarification_reason, analytical, visual_status, observed,
    analysis_refused, include_imagery, only_discovery and has_imagery.
    """
    from earthframe.functions.rules import lookup

    status, visual = F.col("status"), F.col("visual_status")
    return (
        F.when(status == "needs_clarification", F.coalesce(
            lookup(CLARIFICATION_OUTCOME, F.col("clarification_reason")), F.lit("clarification")))
        .when(status == "location_unavailable", "location_unavailable")
        .when(status.isin("planner_unavailable", "synthesis_unavailable", "answer_withheld"),
              "provider_failure")
        .when(F.col("analytical") | ((visual == "observed") & F.col("observed")), "success")
        .when(F.col("analysis_refused"), "analysis_refused")
        .when(visual.isin("unavailable", "failed"), "visual_unavailable")
        .when(F.col("include_imagery") & F.col("only_discovery") & F.col("has_imagery"), "success")
        .otherwise("insufficient_evidence")
    )


def evidence_report(runs: DataFrame, windows: DataFrame, evidence: DataFrame,
                    warnings: DataFrame) -> DataFrame:
    """One exportable record per run; unreadable images stay apart from failed searches.

    ``runs``: run_id, question, answer, status, checks. ``windows``: run_id, pos, modality,
    label, imagery_error, error. ``evidence``: run_id, pos, id, value, unit, text.
    ``warnings``: run_id, pos, warning. Lists are per run and kept in ``pos`` order.
    """
    def ordered(df: DataFrame, name: str, *fields: Column | str) -> DataFrame:
        entry = F.struct("pos", F.struct(*fields).alias("v"))
        return df.groupBy("run_id").agg(F.transform(
            F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias(name))

    images = ordered(windows.where(F.col("imagery_error").isNotNull()), "imagery_errors",
                     "modality", "label", F.col("imagery_error").alias("reason"))
    failures = ordered(windows.where(F.col("error").isNotNull()), "discovery_failures",
                       "modality", "label", F.col("error").alias("reason"))
    items = ordered(evidence, "evidence", "id", "value", "unit", "text")
    notes = warnings.groupBy("run_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "warning"))), lambda e: e["warning"])
        .alias("warnings"))
    out = runs.withColumn("question", F.when(F.trim("question") != "", F.trim("question")))
    for part in (items, images, failures, notes):
        out = out.join(part, "run_id", "left")
    return out
