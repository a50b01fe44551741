"""Registered queries over questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from earthframe.functions import questions as Q
from earthframe.operators import questions as O
from earthframe.plans import views as V
from earthframe.plans.registry import query, sql_view, table

# template -> (text with {p} place, {y} year, {z} next year, {m} month; expectations)
_T = [
    "Show NDWI of {p} in {m} {y}",
    "Compare water in {p} between January {y} and March {z}",
    "Do not compute NDVI, compute NDWI for {p} on 15 January {y}",
    "What is NDVI?",
    "Is the vegetation around {p} lush from {y}-01-05 to {y}-02-07?",
    "Count ships in {p} in {y}",
    "Show the radar backscatter of {p}, not NDVI, in June {y}",
    "If I wanted NDWI of {p} I would ask. Show NDBI in {y}.",
    "How leafy is {p} between January and March {y}?",
    "Describe what is visible around {p} in {m} {y}",
    "Show water in {p} last summer",
    "Show \"NDVI\" and the satellite image of {p} in {m} {y}",
]
_MEASURED = ["ndwi", "ndwi", "ndwi", "", "ndvi", "", "sar_backscatter", "ndbi", "ndvi", "", "ndwi", ""]
_REASON = [None, None, None, "analysis_missing", None, "analysis_unsupported", None, None, None, None,
           "date_ambiguous", None]


def _sql_text(t: str) -> str:
    t = t.replace("'", "''")
    for key, col in (("{p}", "p_name"), ("{y}", "y"), ("{z}", "(y + 1)"), ("{m}", "mon")):
        t = t.replace(key, f"' || {col} || '")
    return f"'{t}'"


def _case(values, none="NULL") -> str:
    return "CASE t " + " ".join(
        f"WHEN {i} THEN {none if v is None else v}" for i, v in enumerate(values)) + " END"


sql_view("questions", f"""
SELECT o_orderkey AS question_id, t, p_name, y, mon, mm, {_case([_sql_text(t) for t in _T])} AS text FROM (
 SELECT o_orderkey, o_orderkey % 12 AS t, p_name, 2015 + o_orderkey % 7 AS y, o_orderkey // 12 % 12 + 1 AS mm,
  strftime(make_date(2020, CAST(o_orderkey // 12 % 12 + 1 AS INTEGER), 1), '%B') AS mon FROM orders JOIN part ON o_custkey = p_partkey)
""")


def questions(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "part").select("p_partkey", "p_name"),
                                        F.col("o_custkey") == F.col("p_partkey"))
    k = F.col("o_orderkey")
    month = F.date_format(F.add_months(F.lit("2020-01-01").cast("date"),
                                       (F.floor(k / 12) % 12).cast("int")), "MMMM")
    y = (2015 + k % 7)
    text = None
    for i, t in enumerate(_T):
        filled = F.lit(t)
        for key, col in (("{p}", F.col("p_name")), ("{y}", y.cast("string")),
                         ("{z}", (y + 1).cast("string")), ("{m}", month)):
            filled = F.replace(filled, F.lit(key), col)
        text = F.when(k % 12 == i, filled) if text is None else text.when(k % 12 == i, filled)
    return o.select(k.alias("question_id"), text.alias("text"))


def gazetteer(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()


_DATES = [
    "mon || ' ' || y", "'January ' || y || '|March ' || (y + 1)", "'15 January ' || y", "''",
    "y || '-01-05|' || y || '-02-07'", "CAST(y AS VARCHAR)", "'June ' || y", "CAST(y AS VARCHAR)",
    "'January|March ' || y", "mon || ' ' || y", "''", "mon || ' ' || y"]


@query("f18_date_expressions", f"""
SELECT question_id, {_case(_DATES)} AS dates, CASE WHEN t IN (3, 10) THEN '' WHEN t = 1 THEN y || ',' || (y + 1) WHEN t IN (4, 8) THEN y || ',' || y ELSE CAST(y AS VARCHAR) END AS years FROM questions
""")
def date_expressions(spark, sf):
    def read(texts):
        return texts.select("text", Q.extract_dates(F.col("text")).alias("d")).select(
            "text", F.array_join(F.transform("d", lambda e: e["text"]), "|").alias("dates"),
            F.array_join(F.transform("d", lambda e: e["year"].cast("string")), ",").alias("years"))

    return O.read_once(questions(spark, sf), read).drop("text")


_FIRST = ["make_date(y, mm, 1)", "make_date(y, 1, 1)", "make_date(y, 1, 15)", None, "make_date(y, 1, 5)",
          "make_date(y, 1, 1)", "make_date(y, 6, 1)", "make_date(y, 1, 1)", "make_date(y, 1, 1)",
          "make_date(y, mm, 1)", None, "make_date(y, mm, 1)"]
_LAST = ["last_day(make_date(y, mm, 1))", "make_date(y, 1, 31)", "make_date(y, 1, 15)", None,
         "make_date(y, 1, 5)", "make_date(y, 12, 31)", "make_date(y, 6, 30)", "make_date(y, 12, 31)",
         "make_date(y, 1, 31)", "last_day(make_date(y, mm, 1))", None, "last_day(make_date(y, mm, 1))"]


@query("f19_date_interval", f"""
SELECT question_id, CAST({_case(_FIRST)} AS VARCHAR) AS start_date, CAST({_case(_LAST)} AS VARCHAR) AS end_date FROM questions WHERE t NOT IN (3, 10)
""")
def date_interval(spark, sf):
    def read(texts):
        d = texts.select("text", F.get(Q.extract_dates(F.col("text")), F.lit(0)).alias("e")).where(F.col("e").isNotNull())
        return d.select("text", Q.date_interval(F.col("e")).alias("i")).select(
            "text", F.col("i.start_date").cast("string").alias("start_date"),
            F.col("i.end_date").cast("string").alias("end_date"))

    return O.read_once(questions(spark, sf), read).drop("text")


@query("f20_mentioned_place", """
SELECT question_id, CASE WHEN t <> 3 THEN p_name END AS place, CASE WHEN t = 3 THEN 'missing' ELSE 'found' END AS status FROM questions
""")
def mentioned_place(spark, sf):
    return O.read_once(questions(spark, sf), lambda texts: O.read_places(texts, gazetteer(spark, sf))).drop("text")


_UNSUPPORTED = ["NULL"] * 12
_UNSUPPORTED[5] = "'objects'"


@query("f21_f22_question_flags", f"""
SELECT question_id, {_case([f"'{m}'" for m in _MEASURED])} AS measured, {_case(_UNSUPPORTED)} AS unsupported,
 t = 1 AS comparison, t = 9 AS visual, t IN (0, 2, 3, 6, 7, 11) AS asks_to_measure, t = 11 AS imagery FROM questions
""")
def question_flags(spark, sf):
    def read(texts):
        return texts.select("text", Q.question_flags(F.col("text")).alias("f")).select(
            "text", F.array_join("f.measured", ",").alias("measured"), "f.unsupported",
            "f.comparison", "f.visual", "f.asks_to_measure",
            F.array_contains("f.analyses", "imagery").alias("imagery"))

    return O.read_once(questions(spark, sf), read).drop("text")


_MASKED = [
    "Show NDWI of PLACE in DATE", "Compare water in PLACE between DATE and DATE",
    "Do not compute NDVI, compute NDWI for PLACE on DATE", "What is NDVI?",
    "Is the vegetation around PLACE lush from DATE to DATE ?", "Count ships in PLACE in DATE",
    "Show the radar backscatter of PLACE , not NDVI, in DATE",
    "If I wanted NDWI of PLACE I would ask. Show NDBI in DATE .",
    "How leafy is PLACE between DATE and DATE ?", "Describe what is visible around PLACE in DATE",
    "Show water in PLACE last summer", "Show \"NDVI\" and the satellite image of PLACE in DATE"]


@query("f23_slot_masking", f"SELECT question_id, {_case([repr(m) for m in _MASKED])} AS masked FROM questions")
def slot_masking(spark, sf):
    def read(texts):
        return O.read_places(texts, gazetteer(spark, sf)).select("text", Q.mask_slots(F.col("text"), F.col("place")).alias("masked"))

    return O.read_once(questions(spark, sf), read).drop("text")


sql_view("routed", f"""
SELECT *, CASE question_id % 9 WHEN 0 THEN 'NDVI' WHEN 1 THEN 'NDWI' WHEN 2 THEN 'NDBI' WHEN 3 THEN 'SAR_BACKSCATTER' WHEN 4 THEN 'TEMPORAL_NDWI'
  WHEN 5 THEN 'TRUE_COLOR' WHEN 6 THEN 'CLARIFICATION' WHEN 7 THEN 'UNSUPPORTED' END AS label,
 CAST(question_id % 100 AS DOUBLE) / 100 AS confidence, {_case([f"'{m}'" for m in _MEASURED])} AS rules FROM questions
""")


@query("f24_operation_routing", """
SELECT question_id, CASE WHEN label IS NULL OR confidence < 0.3 OR t = 9 THEN 'rules' WHEN ambiguous THEN 'clarify' WHEN label = 'UNSUPPORTED' THEN CASE WHEN t = 5 THEN 'rules' ELSE 'clarify' END
  WHEN label = 'CLARIFICATION' THEN 'rules' ELSE 'intent_model' END AS source,
 CASE WHEN label IS NULL THEN 'model_unavailable' WHEN confidence < 0.3 THEN 'low_confidence' WHEN t = 9 THEN 'visual_question' WHEN ambiguous THEN 'analysis_ambiguous'
  WHEN label = 'UNSUPPORTED' THEN CASE WHEN t = 5 THEN 'model_unsupported' ELSE 'analysis_unsupported' END WHEN label = 'CLARIFICATION' THEN 'model_clarification'
  WHEN rules = '' AND NOT (label = 'TRUE_COLOR' AND t = 11) THEN 'model_added_operation' ELSE 'model_agrees_with_rules' END AS reason
FROM (SELECT *, CASE label WHEN 'UNSUPPORTED' THEN rules <> '' WHEN 'CLARIFICATION' THEN rules <> '' OR t = 11 WHEN 'TEMPORAL_NDWI' THEN rules NOT IN ('', 'ndwi')
  WHEN 'TRUE_COLOR' THEN rules <> '' ELSE rules <> '' AND rules <> lower(label) END AS ambiguous FROM routed)
""")
def operation_routing(spark, sf):
    labels = ("NDVI", "NDWI", "NDBI", "SAR_BACKSCATTER", "TEMPORAL_NDWI", "TRUE_COLOR",
              "CLARIFICATION", "UNSUPPORTED")
    k = F.col("question_id")
    label = F.get(F.array(*[F.lit(v) for v in labels]), (k % 9).cast("int"))
    r = O.read_once(questions(spark, sf), lambda texts: texts.select("text", Q.question_flags(F.col("text")).alias("flags")))
    out = Q.route_operation(label, (k % 100).cast("double") / 100, 0.3, F.col("flags"))
    return r.select("question_id", out.alias("r")).select("question_id", "r.source", "r.reason")


@query("f25_clarification", f"SELECT question_id, {_case([None if r is None else repr(r) for r in _REASON])} AS reason FROM questions")
def clarification(spark, sf):
    def read(texts):
        return O.read_texts(texts, gazetteer(spark, sf)).select("text", Q.clarify(
            F.col("text"), F.col("flags"), F.col("place"), F.col("dates"),
            F.lit("2024-12-31").cast("date")).alias("reason"))

    return O.read_once(questions(spark, sf), read).drop("text")


@query("f25_suggested_question", """
SELECT question_id, 'Show water (NDWI) around ' || p_name || ' in ' || strftime(make_date(y, mm, 1), '%B %Y') AS suggestion FROM questions WHERE t = 0
""")
def suggested_question(spark, sf):
    r = O.read_questions(questions(spark, sf).where(F.col("question_id") % 12 == 0), gazetteer(spark, sf))
    i = Q.date_interval(F.get("dates", F.lit(0)))
    return r.select("question_id", Q.suggested_question(
        F.get("flags.measured", F.lit(0)), F.col("place"),
        Q.period_phrase(i["start_date"], i["end_date"])).alias("suggestion"))


@query("f26_plan_completion", """
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'execute_query,spectral_indices:ndvi,ndwi' WHEN 1 THEN 'execute_query,ndwi' WHEN 2 THEN 'execute_query,temporal_ndwi'
 WHEN 3 THEN 'execute_query,spectral_indices:ndwi,rs_model' WHEN 4 THEN 'execute_query,ndwi,rs_model' ELSE 'ndwi' END AS steps FROM orders
""")
def plan_completion(spark, sf):
    m = F.col("o_orderkey") % 6

    def arr(*values):
        return F.array(*[F.lit(v) for v in values])

    steps = (
        F.when(m == 0, arr("execute_query", "spectral_indices:ndvi")).when(m == 1, arr("execute_query", "ndwi"))
        .when(m.isin(2, 3), arr("execute_query")).when(m == 4, arr("execute_query", "ndwi", "rs_model"))
        .otherwise(arr("ndwi")))
    wanted = F.when(m == 4, arr("ndbi")).otherwise(arr("ndwi"))
    done = Q.complete_steps(steps, wanted, F.when(m == 2, "compare").otherwise("single"), F.lit(True),
                            F.lit(True), m == 3)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.array_join(done, ",").alias("steps"))


@query("f27_place_removal", """
SELECT question_id, CASE WHEN t = 3 THEN text ELSE replace(text, p_name, 'this area') END AS text FROM questions
""")
def place_removal(spark, sf):
    full = F.concat(F.col("place"), F.lit(", "), F.col("place"))

    def read(texts):
        return O.read_places(texts, gazetteer(spark, sf)).select("text", Q.remove_place(F.col("text"), full).alias("shorter"))

    return O.read_once(questions(spark, sf), read).select("question_id", F.col("shorter").alias("text"))


@query("f28_period_formatting", """
SELECT id, CASE m WHEN 0 THEN strftime(d, '%B %Y') WHEN 1 THEN strftime(d, '%Y') WHEN 2 THEN CAST(d AS VARCHAR) ELSE CAST(d AS VARCHAR) || ' → ' || CAST(d + 45 AS VARCHAR) END AS shown,
 CASE m WHEN 0 THEN 'in ' || strftime(d, '%B %Y') WHEN 1 THEN 'in ' || strftime(d, '%Y') WHEN 2 THEN 'on ' || CAST(d AS VARCHAR) ELSE 'from ' || CAST(d AS VARCHAR) || ' to ' || CAST(d + 45 AS VARCHAR) END AS phrase
FROM (SELECT o_orderkey AS id, o_orderkey % 4 AS m, CAST(CASE o_orderkey % 4 WHEN 0 THEN date_trunc('month', o_orderdate) WHEN 1 THEN date_trunc('year', o_orderdate) ELSE o_orderdate END AS DATE) AS d FROM orders)
""")
def period_formatting(spark, sf):
    m, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("date")
    start = F.when(m == 0, F.trunc(d, "MM")).when(m == 1, F.trunc(d, "YEAR")).otherwise(d)
    end = F.when(m == 0, F.last_day(d)).when(
        m == 1, F.date_sub(F.add_months(F.trunc(d, "YEAR"), 12), 1)).when(m == 2, d).otherwise(F.date_add(d, 45))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), start.alias("s"), end.alias("e")).select(
        "id", Q.format_period(F.col("s"), F.col("e")).alias("shown"),
        Q.period_phrase(F.col("s"), F.col("e")).alias("phrase"))
