"""Does every number and sentence of an answer trace to its own cited evidence?

A run is one answer, so what belongs to it stays in its row: run_id, summary, refs, location, scene_ids, dates and
``evidence``, an array of ``{id, source, value, unit, observations, says}``: arrays of ``{scene_id, acquired, label}``, and what
:func:`describe` tells. Runs are read row by row and meet no other run. Evidence that comes as rows is put beside its answers by :func:`pack_runs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earthframe.functions import claims as T
from earthframe.functions.rules import let

# Sources whose numbers an answer may quote.
AUTHORITIES = ("execution", "ndvi", "ndwi", "ndbi", "temporal_ndwi", "sar_backscatter",
               "compatibility")
INDEX_SOURCES = ("ndvi", "ndwi", "ndbi")
SAR_NAMES = ("vv_mean_db", "vv_min_db", "vv_max_db", "vv_valid_pixel_count", "vh_mean_db",
             "vh_min_db", "vh_max_db", "vh_valid_pixel_count", "vv_minus_vh_mean_db")
CAVEAT_ID = r"\.(?:warning|limitation)\.\d+$"
ROLES = ("first", "second", "earlier", "later", "baseline", "target")


_NO_TEXT = "array<string>"


def _citable(ident: Column, source: Column, name: Column, unit: Column, own: Column, kind: Column) -> Column:
    """Whether a claim may bind to a measurement: its metrics fit its source, and its unit its statistic."""
    fits = (
        (F.size(own) == 0) | F.array_contains(own, source)
        | ((source == "temporal_ndwi") & (F.array_join(own, ",") == "ndwi"))
        | ((source == "sar_backscatter")
           & (F.size(F.array_except(own, F.array(F.lit("vv"), F.lit("vh")))) == 0)))
    expected = (
        F.when(kind == "percent", "%").when(kind.isin("pixels", "paired_pixels"), "pixels").when(kind == "scenes", "count")
        .when(source == "sar_backscatter", "dB").otherwise("index"))
    return F.coalesce(
        source.isin(*AUTHORITIES) & ident.startswith(F.concat(source, F.lit("."))) & fits & (unit == expected)
        & ((source != "sar_backscatter") | name.isin(*SAR_NAMES)), F.lit(False))


def describe(ident: Column, source: Column, name: Column, unit: Column, text: Column) -> Column:
    """What a kind of evidence lets an answer say, whatever its value.

    ``kind``, ``metrics`` and ``citable`` (statistic, metrics, and whether a claim may bind to the value); ``quoting`` (whether
    sentences may be repeated), ``quotes``, those of its text normalised, and ``caveats``, exact ones.
    """
    name, unit, text = name.cast("string"), unit.cast("string"), text.cast("string")
    paired = (name == "paired_valid_pixel_count") & (source == "temporal_ndwi")
    sentences = F.filter(T.split_sentences(F.coalesce(text, F.lit(""))), lambda s: F.trim(s) != "")
    quoting, none = F.coalesce(source.isin(*AUTHORITIES, "model"), F.lit(False)), F.array().cast(_NO_TEXT)
    own, kind = T.metrics_in(F.replace(name, F.lit("_"), F.lit(" "))), T.stat_kind(name)
    return F.struct(
        kind.alias("kind"), F.when(paired, F.lit("ndwi")).otherwise(F.array_join(own, ",")).alias("metrics"),
        _citable(ident, source, name, unit, own, kind).alias("citable"), quoting.alias("quoting"),
        F.when(quoting, F.transform(sentences, T.words)).otherwise(none).alias("quotes"),
        F.when(quoting & (source != "model") & ident.rlike(CAVEAT_ID), F.transform(sentences, T.verbatim)).otherwise(none).alias("caveats"))


def pack_runs(answers: DataFrame, evidence: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs as this module reads them, from tables: answers (run_id, summary, refs), evidence rows (run_id, pos, id, source, name, value,
    unit, text, observations) and runs (run_id, location, scene_ids, dates)."""
    says = describe(*[F.col(c) for c in ("id", "source", "name", "unit", "text")])
    held = evidence.withColumn("says", says).groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "source", "value", "unit", "observations", "says"))).alias("evidence"))
    return answers.join(runs, "run_id").join(held, "run_id", "left")


def _cited() -> Column:
    return F.filter("evidence", lambda e: F.array_contains("refs", e["id"]))


def unresolved_refs(runs: DataFrame) -> DataFrame:
    """Cited ids that no evidence of the run carries."""
    known = F.coalesce(F.transform("evidence", lambda e: e["id"]), F.array().cast(_NO_TEXT))
    return runs.select("run_id", F.explode(F.array_except("refs", known)).alias("id"))


def split_answers(answers: DataFrame) -> DataFrame:
    """One row per clause with its sentence and both positions; blank clauses dropped."""
    sentences = answers.select(
        "run_id", F.posexplode(T.split_sentences(F.col("summary"))).alias("s_pos", "sentence"))
    return sentences.select(
        "run_id", "s_pos", "sentence",
        F.posexplode(T.split_clauses(F.col("sentence"))).alias("c_pos", "clause"),
    ).where(F.trim("clause") != "")


def _clauses(summary: Column) -> Column:
    """Clauses with their sentence and both positions; blank ones dropped."""
    return F.flatten(F.transform(T.split_sentences(summary), lambda s, i: F.filter(
        F.transform(T.split_clauses(s), lambda c, j: F.struct(i.alias("s_pos"), s.alias("sentence"), j.alias("c_pos"), c.alias("clause"))),
        lambda x: F.trim(x["clause"]) != "")))


def quotable(cited: Column) -> Column:
    """Struct of normalised sentences a citation lets an answer repeat (``quoted``) and exact caveats (``caveats``)."""
    seen = F.array_distinct(F.flatten(F.transform(F.filter(cited, lambda e: e["says"]["quoting"] & e["observations"].isNotNull()), lambda e: e["observations"])))
    facts = F.flatten(F.transform(seen, lambda o: F.array_compact(F.array(
        F.concat(F.lit("Scene "), o["scene_id"], F.lit(" was selected.")),
        F.when(o["acquired"] != "", F.concat(F.lit("The scene was acquired on "), o["acquired"], F.lit(".")))))))
    return F.struct(
        F.concat(F.flatten(F.transform(cited, lambda e: e["says"]["quotes"])), F.transform(facts, T.words)).alias("quoted"),
        F.flatten(F.transform(cited, lambda e: e["says"]["caveats"])).alias("caveats"))


def read_clauses(runs: DataFrame, *keep: str) -> DataFrame:
    """Clauses with their numbers and invented identifiers; ``exempt`` (repeats a cited caveat exactly) and ``quoted_ok`` (needs no numbers).

    A run without clauses has one row without any. ``values``: cited measurements a claim may bind to. ``keep``: further columns of ``runs``.
    """
    cited = runs.withColumn("_cited", F.coalesce(_cited(), F.filter("evidence", lambda e: F.lit(False))))
    prepared = cited.select(
        "run_id", "location", "scene_ids", "dates", *keep, F.filter("_cited", lambda e: e["says"]["citable"] & e["value"].isNotNull()).alias("values"),
        quotable(F.col("_cited")).alias("_quotes"), _clauses(F.col("summary")).alias("_clauses"))
    each = prepared.select("*", F.explode_outer("_clauses").alias("_c")).drop("_clauses")
    clause, sentence = F.col("clause"), F.col("sentence")
    # NULL where a run has no evidence: nothing may be repeated
    known = F.coalesce("_quotes.quoted", F.array().cast(_NO_TEXT))
    yes = F.regexp_extract(sentence, r"(?i)^\s*yes,\s+(.+)$", 1)
    ok = let(T.words(sentence), lambda w: (w == "") | F.array_contains(known, w) | w.isin(*T.ABSTENTIONS)) | (
        (yes != "") & F.array_contains(known, T.words(yes)))
    return (
        each.select("run_id", *keep, "location", "dates", "values", "_quotes", "_c.*",
                    F.filter("scene_ids", lambda i: F.col("_c.clause").contains(i)).alias("_ids"))
        .withColumn("_n", T.numeric_text(clause, F.col("_ids"), F.col("dates")))
        .withColumn("invented", F.col("_n.invented"))
        .withColumn("numbers", T.extract_numbers(F.col("_n.text")))
        .withColumn("exempt", F.coalesce(F.array_contains("_quotes.caveats", T.verbatim(sentence)), F.lit(False)))
        .withColumn("quoted_ok", F.coalesce(ok, F.lit(False)))
        .drop("_quotes", "dates")
    )


def _plain_words(text: Column) -> Column:
    """Whether a clause says nothing beside its number and place but the words of a measurement."""
    no_numbers = F.regexp_replace(text, T.NUMBER, " ")
    no_place = F.regexp_replace(
        no_numbers, F.concat(F.lit(r"(?i)\Q"), F.coalesce("location", F.lit("")), F.lit(r"\E")), F.lit(" "))
    vocabulary = F.array(*[F.lit(w) for w in (*T.MEASUREMENT_WORDS, "")])
    return F.size(F.array_except(F.split(T.words(no_place), " "), vocabulary)) == 0


def _scope() -> Column:
    """What a clause says about platform, place and time."""
    clause = F.col("clause")
    whole_scene = F.filter("_ids", lambda i: F.regexp_like(
        clause, F.concat(F.lit(r"(?<!\w)\Q"), i, F.lit(r"\E(?!\w)"))))
    years = F.concat(F.regexp_extract_all(clause, F.lit(T.YEAR_AFTER_WORD), 1),
                     F.regexp_extract_all(clause, F.lit(T.YEAR_BEFORE_WORD), 1))
    month_number = F.create_map(*[x for i, m in enumerate(T.MONTHS)
                                  for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])
    months = F.zip_with(
        F.regexp_extract_all(clause, F.lit(T.MONTH_YEAR), 1),
        F.regexp_extract_all(clause, F.lit(T.MONTH_YEAR), 2),
        lambda m, y: F.concat(y, F.lit("-"), F.try_element_at(month_number, F.lower(m))))
    roles = F.filter(F.array(*[F.lit(r) for r in ROLES]), lambda r: F.regexp_like(
        clause, F.concat(F.lit(r"(?i)\b"), r, F.lit(r"\b"))))
    some_role = clause.rlike(r"(?i)\b(?:" + "|".join(ROLES) + r")\b")
    return F.struct(
        F.lower(clause).rlike(r"\bsentinel-1[a-z]?(?:-[a-z]+)*\b").alias("radar"),
        F.lower(clause).rlike(r"\bsentinel-2[a-z]?(?:-[a-z]+)*\b").alias("optical"),
        whole_scene.alias("scenes"),
        F.regexp_extract_all(clause, F.lit(f"({T.ISO_DATE})"), 1).alias("dates"),
        years.alias("years"), months.alias("months"), F.when(some_role, roles).otherwise(F.array().cast(_NO_TEXT)).alias("roles"))


def read_claims(clauses: DataFrame) -> DataFrame:
    """One row per number of a clause (one row without a literal when it has none), with what it claims.

    ``claim`` is NULL where a clause cannot bind: it states several numbers, or says more than a measurement.
    """
    clause, literal = F.col("clause"), F.col("literal")
    after = F.substring("clause", F.instr(clause, literal) + F.length("literal"), F.length("clause"))
    kind = F.coalesce(T.stat_kind(clause), F.when(after.rlike(r"(?i)\bvalid\s+pixels?\b"), "pixels"))
    claim = let(T.stated_unit(clause, literal), lambda unit: F.when(~unit["rejected"], F.struct(
        unit["unit"].alias("unit"), kind.alias("kind"),
        F.array_join(T.claimed_metrics(clause, F.col("sentence")), ",").alias("metrics"), _scope().alias("scope"))))
    return clauses.withColumn("_single", F.size("numbers") == 1).select("*", F.posexplode_outer("numbers").alias("n_pos", "literal")).withColumn(
        "claim", F.when(F.col("_single") & _plain_words(F.col("_n.text")), claim)).drop("_n", "_ids", "numbers", "_single", "location")


def _scope_fits(claim: Column, item: Column) -> Column:
    """Whether everything a clause says about where and when is true of the evidence row."""
    seen = item["observations"]
    source, ident = item["source"], item["id"]

    def of(field: str) -> Column:
        return F.transform(seen, lambda o: o[field])

    def subset(inner: Column, outer: Column) -> Column:
        return F.size(F.array_except(inner, outer)) == 0

    optical_source = source.isin(*INDEX_SOURCES, "temporal_ndwi")
    platform = (
        ~(claim["radar"] & optical_source) & ~(claim["optical"] & (source == "sar_backscatter"))
        & ~((source == "execution") & claim["radar"]
            & ~ident.startswith("execution.sentinel-1-sar."))
        & ~((source == "execution") & claim["optical"]
            & ~ident.startswith("execution.sentinel-2-optical.")))
    position = F.transform(claim["roles"], lambda r: F.when(r == "earlier", "first").when(
        r == "later", "second").otherwise(r))
    roles = F.forall(position, lambda r: F.when(
        r.isin("first", "second"), ident.startswith(F.concat(F.lit("temporal_ndwi."), r, F.lit(".")))
    ).otherwise(F.array_contains(of("label"), r)))
    return (
        platform & subset(claim["scenes"], of("scene_id"))
        & subset(claim["dates"], of("acquired"))
        & subset(claim["years"], F.transform(seen, lambda o: F.substring(o["acquired"], 1, 4)))
        & F.forall(claim["months"], lambda m: F.exists(seen, lambda o: o["acquired"].startswith(m)))
        & roles
    )


def ground_claims(claims: DataFrame) -> DataFrame:
    """Claims with ``candidates`` and ``supported``: identity first, then the value.

    A claim meets the cited values of its run by statistic, metric, unit and scope; it is supported when exactly one
    fits and the literal is that value at its precision.
    """
    claim = F.col("claim")
    found = F.when(claim.isNotNull(), F.filter("values", lambda item: (
        (claim["kind"] == item["says"]["kind"])
        & ((claim["metrics"] == item["says"]["metrics"]) | ((claim["metrics"] == "") & (item["source"] != "sar_backscatter")))
        & (claim["unit"].isNull() | (claim["unit"] == item["unit"]))
        & _scope_fits(claim["scope"], item))))
    only = (F.col("candidates") == 1) & T.value_agrees(F.col("literal"), F.get("_found", F.lit(0))["value"])
    return (
        claims.withColumn("_found", found).withColumn("candidates", F.greatest(F.coalesce(F.size("_found"), F.lit(0)), F.lit(0)))
        .withColumn("supported", F.when(F.col("literal").isNotNull(), F.coalesce(only, F.lit(False))))
        .drop("_found", "values", "claim")
    )


def ungrounded(grounded: DataFrame) -> DataFrame:
    """Numbers no evidence supports and invented identifiers, outside exempt sentences."""
    number = F.when(~F.col("supported"), F.array("literal")).otherwise(F.array().cast(_NO_TEXT))
    ids = F.when(F.coalesce("n_pos", F.lit(0)) == 0, F.coalesce("invented", F.array().cast(_NO_TEXT))).otherwise(F.array().cast(_NO_TEXT))
    return grounded.where(~F.col("exempt")).select("run_id", "s_pos", "c_pos", F.explode(F.concat(number, ids)).alias("claim"))


def validate_answers(runs: DataFrame) -> DataFrame:
    """Three independent outcomes per answer, the provenance of visual claims, the verdict."""
    known = F.coalesce(F.transform("evidence", lambda e: e["id"]), F.array().cast(_NO_TEXT))
    flagged = runs.withColumns({
        "_dangling": F.coalesce(F.size(F.array_except("refs", known)) > 0, F.lit(False)),
        "_visual": F.coalesce(F.exists(_cited(), lambda e: e["source"] == "model"), F.lit(False)),
        "_forbidden": F.size(T.forbidden_phrases(F.col("summary"))) > 0})
    grounded = ground_claims(read_claims(read_clauses(flagged, "_dangling", "_visual", "_forbidden")))
    bad = ~F.col("exempt") & (
        ~F.coalesce("supported", F.lit(True)) | (F.coalesce(F.size("invented"), F.lit(0)) > 0))
    prose_ok = F.col("quoted_ok") | F.coalesce("supported", F.lit(False))
    out = grounded.groupBy("run_id").agg(
        F.bool_or(bad).alias("_ungrounded"), F.bool_and(prose_ok).alias("_prose"),
        *[F.bool_or(c).alias(c) for c in ("_dangling", "_visual", "_forbidden")])

    def outcome(failed: Column) -> Column:
        return F.when(failed, "fail").otherwise("pass")

    return out.select(
        "run_id",
        outcome(F.coalesce("_ungrounded", F.lit(False))).alias("numeric_grounding"),
        outcome(F.col("_forbidden")).alias("forbidden_terms"),
        outcome(F.col("_dangling") | ~F.coalesce("_prose", F.lit(False))).alias("evidence_refs"),
        F.when(F.col("_visual"), "attributed").otherwise("not_run").alias("visual_claims"),
    ).withColumn("accepted", (F.col("numeric_grounding") == "pass")
                 & (F.col("forbidden_terms") == "pass") & (F.col("evidence_refs") == "pass"))
