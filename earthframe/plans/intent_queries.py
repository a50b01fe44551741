"""Registered queries over labelled text: features, splits, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from earthframe.functions import ngrams as N
from earthframe.lineage import saved
from earthframe.operators import intents as M
from earthframe.operators import similarity as S
from earthframe.plans.registry import query, sql_view, table
from earthframe.plans.similarity_queries import _FAMILIES, labelled_text
from earthframe.sources.labelled import load_labelled

LABELS = ("q0t0", "q0t1", "q1t0", "q1t1")
SEED = "split-1"


@query("f14_word_ngrams", r"""
SELECT id, len(w) + greatest(len(w) - 1, 0) AS grams, w[1] AS first_word, w[len(w) - 1] || ' ' || w[len(w)] AS last_pair FROM (
 SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM benchmark)
""")
def word_ngrams(spark, sf):
    b = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), N.word_ngrams(F.col("text")).alias("g"))
    return b.select("id", F.size("g").cast("bigint").alias("grams"),
                    F.get("g", F.lit(0)).alias("first_word"), F.element_at("g", -1).alias("last_pair"))


@query("f15_char_ngrams", r"""
SELECT id, CAST(sum(CASE WHEN l >= 5 THEN (l - 1) + (l - 2) + (l - 3) + (l - 4) WHEN l = 4 THEN 3 + 2 + 1 ELSE 2 + 1 END) AS BIGINT) AS grams FROM (
 SELECT item_id AS id, length(unnest(string_split_regex(trim(lower(text)), '\s+'))) + 2 AS l FROM benchmark) GROUP BY id
""")
def char_ngrams(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), F.size(N.char_wb_ngrams(F.col("text"))).cast("bigint").alias("grams"))


sql_view("label_grams", r"""
SELECT id, 'word' AS block, gram, count(*) AS tf FROM (
 SELECT id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (
  SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM labelled_text)) GROUP BY ALL
UNION ALL
SELECT id, 'char' AS block, substr(p, i, n) AS gram, count(*) AS tf FROM (
 SELECT id, p, n, unnest(range(1, len(p) - n + 2)) AS i FROM (
  SELECT id, ' ' || w || ' ' AS p, unnest(range(2, least(5, len(w) + 2) + 1)) AS n FROM (
   SELECT id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM labelled_text) WHERE w <> '')) GROUP BY ALL
""")
sql_view("label_idf", """
SELECT block, gram, count(*) AS df, ln((1 + (SELECT count(*) FROM labelled_text)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM label_grams
GROUP BY block, gram HAVING count(*) >= CASE block WHEN 'word' THEN 1 ELSE 2 END
""")


@query("a23_document_frequency", "SELECT block, gram, df, round(idf, 6) AS idf FROM label_idf")
def document_frequency(spark, sf):
    texts = labelled_text(spark, sf)
    return M.text_idf(texts, texts.count()).withColumn("idf", F.round("idf", 6))


@query("f16_m1_tfidf_weights", """
WITH w AS (SELECT id, block, gram, (1 + ln(tf)) * idf AS w FROM label_grams JOIN label_idf USING (block, gram)),
u AS (SELECT id, block, gram, w / sqrt(sum(w * w) OVER (PARTITION BY id, block)) AS weight FROM w)
SELECT id, block, substr(gram, 1, 1) AS initial, count(*) AS grams, round(sum(weight), 5) AS total, round(max(weight), 6) AS most, min(gram) AS first_gram
FROM u GROUP BY ALL
""")
def tfidf_weights(spark, sf):
    """Weights of every gram of both blocks, summed up for each text, block and initial."""
    texts = labelled_text(spark, sf)
    return M.weight_summary(texts, texts.count()).withColumns({"total": F.round("total", 5), "most": F.round("most", 6)})


sql_view("labelled_families", f"""
SELECT t.id, t.label, t.text, f.family FROM labelled_text t JOIN ({_FAMILIES} SELECT id, family FROM fam) f ON f.id = t.id
""")


def labelled_families(spark, sf):
    """Labelled texts, masked, with their near-duplicate family."""
    t = saved(labelled_text(spark, sf))
    return saved(t.join(S.families(t), "id").select("id", "label", F.col("masked").alias("text"), "family"))


sql_view("ordered_families", f"""
SELECT family, arg_max(label, n * 1000 - ascii(label)) AS label, CAST(sum(n) AS BIGINT) AS size, min(first) AS first, sha256('{SEED}:' || min(first)) AS key
FROM (SELECT family, label, count(*) AS n, min(id) AS first FROM labelled_families GROUP BY ALL) GROUP BY family
""")


@query("t5_family_order", "SELECT family, size, first, key FROM ordered_families")
def family_order(spark, sf):
    return M.order_families(labelled_families(spark, sf), SEED).select("family", "size", "first", "key")


_SPLIT_SQL = """
split AS (SELECT family, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'validation' ELSE 'test' END AS split FROM (
 SELECT family, coalesce(sum(size) OVER (PARTITION BY label ORDER BY size DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  / CAST(sum(size) OVER (PARTITION BY label) AS DOUBLE) AS share FROM ordered_families))
"""


@query("m3_family_split", f"""
WITH {_SPLIT_SQL} SELECT q.id, q.family, split FROM labelled_families q JOIN split USING (family)
""")
def family_split(spark, sf):
    return M.split_families(labelled_families(spark, sf), SEED)


@query("j18_split_leakage", f"""
WITH {_SPLIT_SQL}, cuts AS (SELECT 'families' AS cut_by, family, split FROM labelled_families JOIN split USING (family)
 UNION ALL SELECT 'rows', family, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END FROM labelled_families)
SELECT cut_by, family, min(split) AS first, max(split) AS last, count(*) AS members FROM cuts GROUP BY cut_by, family HAVING min(split) <> max(split)
""")
def split_leakage(spark, sf):
    """Families that a split tears apart: none where families are split, some where rows are."""
    data = labelled_families(spark, sf)
    rows = data.select("family", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("split"))
    return S.split_leakage(M.split_families(data, SEED)).select(F.lit("families").alias("cut_by"), "*").unionByName(
        S.split_leakage(rows).select(F.lit("rows").alias("cut_by"), "*"))


# Predictions with known errors and confidences, one per document label.
sql_view("predictions", """
SELECT doc_id AS id, 'q' || quality || 't' || toxic AS label, CASE WHEN doc_id % 7 = 0 THEN 'q0t0' ELSE 'q' || quality || 't' || (doc_id % 11 = 0 OR toxic = 1)::INT END AS predicted,
 CAST(30 + doc_id * 37 % 71 AS DOUBLE) / 100 AS confidence, 'm' || doc_id % 2 AS model, 's' || doc_id % 3 AS "set" FROM labels
""")


def predictions(spark, sf):
    i, q, t = F.col("doc_id"), F.col("quality"), F.col("toxic")
    tox = ((i % 11 == 0) | (t == 1)).cast("int")
    return table(spark, sf, "labels").select(
        i.alias("id"), F.format_string("q%dt%d", q, t).alias("label"),
        F.when(i % 7 == 0, "q0t0").otherwise(F.format_string("q%dt%d", q, tox)).alias("predicted"),
        ((30 + i * 37 % 71).cast("double") / 100).alias("confidence"),
        F.concat(F.lit("m"), (i % 2).cast("string")).alias("model"),
        F.concat(F.lit("s"), (i % 3).cast("string")).alias("set"))


_CLASS_SQL = """
cls AS (SELECT l.label, coalesce(s.support, 0) AS support, coalesce(s.hit, 0) AS hit, coalesce(g.guessed, 0) AS guessed
 FROM (VALUES ('q0t0'), ('q0t1'), ('q1t0'), ('q1t1')) l(label)
 LEFT JOIN (SELECT label, count(*) AS support, count(*) FILTER (WHERE label = predicted) AS hit FROM predictions GROUP BY label) s ON s.label = l.label
 LEFT JOIN (SELECT predicted AS label, count(*) AS guessed FROM predictions GROUP BY predicted) g ON g.label = l.label)
"""


@query("a16_class_metrics", f"""
WITH {_CLASS_SQL} SELECT label, round(coalesce(hit / nullif(CAST(guessed AS DOUBLE), 0), 0), 6) AS precision, round(coalesce(hit / nullif(CAST(support AS DOUBLE), 0), 0), 6) AS recall,
 round(coalesce(2.0e0 * hit / nullif(guessed + support, 0), 0), 6) AS f1, support FROM cls
""")
def class_metrics(spark, sf):
    m = M.class_metrics(predictions(spark, sf), LABELS)
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("a16_classification_metrics", f"""
WITH {_CLASS_SQL}, f AS (SELECT *, coalesce(2.0e0 * hit / nullif(guessed + support, 0), 0) AS f1 FROM cls)
SELECT CAST(sum(support) AS BIGINT) AS count, round(sum(hit) / CAST(sum(support) AS DOUBLE), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
 round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f
""")
def classification_metrics(spark, sf):
    m = M.classification_metrics(predictions(spark, sf), LABELS)
    return m.select("count", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("a17_confusion", """
SELECT label, count(*) FILTER (WHERE predicted = 'q0t0') AS q0t0, count(*) FILTER (WHERE predicted = 'q0t1') AS q0t1,
 count(*) FILTER (WHERE predicted = 'q1t0') AS q1t0, count(*) FILTER (WHERE predicted = 'q1t1') AS q1t1 FROM predictions GROUP BY label
""")
def confusion(spark, sf):
    return M.confusion(predictions(spark, sf), LABELS)


_GRID = ", ".join(f"({t}e0)" for t in M.THRESHOLD_GRID)
_THRESHOLDS = f"""
SELECT t AS threshold, count(*) FILTER (WHERE confidence >= t) AS accepted, count(*) FILTER (WHERE confidence >= t AND label <> predicted) AS accepted_errors,
 count(*) AS total FROM predictions, (VALUES {_GRID}) g(t) GROUP BY t
"""


@query("a18_threshold_table", f"""
SELECT threshold, accepted, round(accepted / CAST(total AS DOUBLE), 6) AS coverage, accepted_errors,
 round(CASE WHEN accepted = 0 THEN 1.0e0 ELSE (accepted - accepted_errors) / CAST(accepted AS DOUBLE) END, 6) AS accepted_precision FROM ({_THRESHOLDS})
""")
def threshold_table(spark, sf):
    t = M.threshold_table(predictions(spark, sf))
    return t.withColumns({c: F.round(c, 6) for c in ("coverage", "accepted_precision")})


@query("a19_threshold_choice", f"""
SELECT greatest(coalesce(min(threshold) FILTER (WHERE accepted = 0 OR (accepted - accepted_errors) / CAST(accepted AS DOUBLE) >= 0.99), 0.95e0), 0.9e0) AS threshold FROM ({_THRESHOLDS})
""")
def threshold_choice(spark, sf):
    return M.choose_threshold(M.threshold_table(predictions(spark, sf)))


_SETS = """
cells AS (SELECT s."set", s.model, l.label, count(p.id) FILTER (WHERE p.label = l.label) AS support, count(p.id) FILTER (WHERE p.label = l.label AND p.predicted = l.label) AS hit,
 count(p.id) FILTER (WHERE p.predicted = l.label) AS guessed FROM (SELECT DISTINCT "set", model FROM predictions) s
 CROSS JOIN (VALUES ('q0t0'), ('q0t1'), ('q1t0'), ('q1t1')) l(label) JOIN predictions p ON p."set" = s."set" AND p.model = s.model GROUP BY ALL),
sets AS (SELECT "set", model, CAST(sum(support) AS BIGINT) AS count, sum(hit) / CAST(sum(support) AS DOUBLE) AS accuracy,
 avg(coalesce(2.0e0 * hit / nullif(guessed + support, 0), 0)) AS macro_f1, sum(support * coalesce(2.0e0 * hit / nullif(guessed + support, 0), 0)) / sum(support) AS weighted_f1
 FROM cells GROUP BY ALL)
"""


@query("m6_evaluate_sets", f"""
WITH {_SETS} SELECT model, "set", count, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM sets
""")
def evaluate_sets(spark, sf):
    return M.evaluate_sets(predictions(spark, sf), LABELS).select(
        "model", "set", "count", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("m6_before_after", f"""
WITH {_SETS}, long AS (SELECT "set", model, unnest(['count', 'accuracy', 'macro_f1', 'weighted_f1']) AS metric, unnest([CAST(count AS DOUBLE), accuracy, macro_f1, weighted_f1]) AS v FROM sets)
SELECT a."set", a.metric, round(a.v, 6) AS before, round(b.v, 6) AS after, round(b.v - a.v, 6) AS change FROM long a JOIN long b ON b."set" = a."set" AND b.metric = a.metric
WHERE a.model = 'm0' AND b.model = 'm1'
""")
def before_after(spark, sf):
    rows = M.before_after(M.evaluate_sets(predictions(spark, sf), LABELS), "m0", "m1")
    return rows.select("set", "metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "change")])


@query("a20_system_outcomes", """
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN clarified THEN CASE WHEN label IN ('CLARIFICATION', 'UNSUPPORTED') THEN 'correct' ELSE 'clarified' END
 WHEN label IN ('CLARIFICATION', 'UNSUPPORTED') THEN 'WRONG' WHEN right_op THEN 'correct' ELSE 'WRONG' END AS outcome FROM (
 SELECT CASE event_id % 5 WHEN 0 THEN 'NDWI' WHEN 1 THEN 'TEMPORAL_NDWI' WHEN 2 THEN 'UNSUPPORTED' WHEN 3 THEN 'TRUE_COLOR' ELSE 'CLARIFICATION' END AS label,
  event_type = 'error' AS clarified, user_id % 3 <> 0 AND NOT (event_id % 5 IN (0, 3) AND user_id % 7 = 0) AS right_op FROM events)) GROUP BY outcome
""")
def system_outcomes(spark, sf):
    i, u = F.col("event_id") % 5, F.col("user_id")
    label = F.when(i == 0, "NDWI").when(i == 1, "TEMPORAL_NDWI").when(i == 2, "UNSUPPORTED").when(
        i == 3, "TRUE_COLOR").otherwise("CLARIFICATION")
    own = F.when(i == 1, "temporal_ndwi").when(i == 3, "imagery").otherwise("ndwi")
    chosen = F.when(u % 3 == 0, "ndbi").otherwise(own)
    outcome = M.system_outcome(label, F.col("event_type") == "error", chosen,
                               (i == 1) | (i.isin(0, 3) & (u % 7 == 0)))
    return M.system_summary(table(spark, sf, "events").select(outcome.alias("outcome")))


@query("a21_latency_summary", """
SELECT event_type, round(avg(value), 6) AS mean_ms, count(value) AS n, round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY event_type
""")
def latency_summary(spark, sf):
    out = M.latency_summary(table(spark, sf, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_ms", "p95_ms")})


@query("t4_best_parameter", """
SELECT arg_max(c, round(score, 6) * 1000000 - c / 1000000) AS best_c FROM (
 SELECT CAST(l_linenumber AS DOUBLE) AS c, avg(round(l_discount * 10)) AS score FROM lineitem GROUP BY 1)
""")
def best_parameter(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("c")).agg(
        F.avg(F.round(F.col("l_discount") * 10)).alias("score"))
    return M.best_parameter(scores)


@query("s8_labelled_load", """
SELECT violation, count(*) AS n FROM (SELECT CASE WHEN doc_id % 13 = 0 THEN 'keys' WHEN doc_id % 13 = 1 THEN 'id_missing' WHEN doc_id % 13 = 2 THEN 'label_unknown'
 WHEN doc_id % 13 = 3 THEN 'text_blank' WHEN doc_id % 13 = 4 THEN 'keys' ELSE 'none' END AS violation FROM documents) GROUP BY violation
""")
def labelled_load(spark, sf):
    i = F.col("doc_id")
    m = i % 13
    ident = F.when(m == 1, F.lit(7).cast("string")).otherwise(F.concat(F.lit('"d'), i.cast("string"), F.lit('"')))
    text = F.when(m == 3, F.lit('"  "')).otherwise(F.to_json(F.array("text")).substr(
        F.lit(2), F.length(F.to_json(F.array("text"))) - 2))
    label = F.when(m == 2, F.lit("NDXI")).otherwise(F.lit("NDWI"))
    line = F.concat(F.lit('{"id": '), ident, F.lit(', "text": '), text, F.lit(', "intent": "'), label,
                    F.lit('"'), F.when(m == 0, F.lit(', "x": 1')).otherwise(F.lit("")), F.lit("}"))
    lines = table(spark, sf, "documents").select(F.when(m == 4, F.lit("not json")).otherwise(line).alias("value"))
    rows, bad = load_labelled(lines)
    return rows.select(F.lit("none").alias("violation")).unionByName(bad.select("violation")).groupBy(
        "violation").agg(F.count(F.lit(1)).alias("n"))


def trained(spark, sf) -> M.Training:
    data = labelled_families(spark, sf)
    return M.train_intents(data.drop("family"), data.select("id", "family"), LABELS, SEED)


@query("m2_m5_t3_score_intent")
def score_intent(spark, sf):
    """The held-out families by the model of the chosen C: label, confidence, and whether it is acted on."""
    return trained(spark, sf).scored.select(
        "split", "id", "label", "predicted", F.round("confidence", 4).alias("confidence"), "acted_on")


@query("m4_grouped_cv")
def grouped_cv(spark, sf):
    """Out-of-fold predictions of five regularisations over five folds of whole families, on the training split."""
    data = labelled_families(spark, sf)
    train = data.join(M.split_families(data, SEED).where("split = 'train'").select("id"), "id", "left_semi")
    return M.grouped_cv(saved(train), LABELS, SEED).select("c", "id", "label", "predicted", F.round("confidence", 4).alias("confidence"))


@query("m4_t4_a19_training_report")
def training_report(spark, sf):
    """Figures of one training run: score of each C, the chosen one, thresholds, and the test scored once."""
    run = trained(spark, sf)
    row = lambda part, name, value: F.struct(F.lit(part).alias("part"), name.alias("name"), value.cast("double").alias("value"))
    label = lambda name: F.col(name).cast("string")
    parts = [run.scores.select(row("cv_macro_f1", label("c"), F.round("score", 6)).alias("r")),
             run.scores.limit(1).select(F.explode(F.array(row("chosen", F.lit("c"), F.lit(run.best_c)),
                                                          row("chosen", F.lit("threshold"), F.lit(run.threshold)))).alias("r")),
             run.splits.groupBy("split").count().select(row("texts", F.col("split"), F.col("count")).alias("r"))]
    parts += [run.calibration.select(row(c, label("threshold"), F.round(c, 6)).alias("r")) for c in ("accepted", "accepted_errors", "accepted_precision")]
    metrics = M.class_metrics(run.scored.where("split = 'test'"), LABELS)
    parts += [metrics.select(row(f"test_{c}", F.col("label"), F.round(c, 6)).alias("r")) for c in ("precision", "recall", "f1", "support")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("r.part", "r.name", "r.value")


@query("f17_class_probabilities")
def class_probabilities(spark, sf):
    """Softmax over the labels for every held-out text, by a model of one C."""
    data = labelled_families(spark, sf)
    placed = saved(data.join(M.split_families(data, SEED).select("id", "split"), "id"))
    roles = placed.select("id", "label", F.when(F.col("split") == "train", 0).alias("fold"))
    p = M.part_predictions(placed, roles, LABELS, (10.0,))
    return p.select("id", *[F.round(F.get("probabilities", F.lit(i)), 6).alias(f"p_{k}") for i, k in enumerate(LABELS)], "predicted")


_SINK = f"""
WITH {_CLASS_SQL}, thresholds AS ({_THRESHOLDS})
SELECT 'metrics' AS part, label AS name, support AS n, round(coalesce(2.0e0 * hit / nullif(guessed + support, 0), 0), 6) AS value FROM cls
UNION ALL SELECT 'confusion', label || '>' || predicted, count(*), NULL FROM predictions GROUP BY label, predicted
UNION ALL SELECT 'thresholds', CAST(CAST(round(threshold * 100) AS INTEGER) AS VARCHAR), accepted, CAST(accepted_errors AS DOUBLE) FROM thresholds
UNION ALL SELECT 'misclassified', CAST(id AS VARCHAR), 1, confidence FROM predictions WHERE label <> predicted
"""


@query("s11_evaluation_sink", _SINK)
def evaluation_sink(spark, sf):
    """Metrics, confusion, thresholds and misclassified rows written twice over, then read back whole."""
    import uuid

    from earthframe.lineage import shared_folder
    from earthframe.sources.labelled import read_evaluation, write_evaluation

    folder = f"{shared_folder(spark)}/evaluation-{uuid.uuid4().hex}"
    p = predictions(spark, sf)
    reports = {"metrics": M.class_metrics(p, LABELS), "confusion": M.confusion(p, LABELS), "thresholds": M.threshold_table(p),
               "misclassified": p.where(F.col("label") != F.col("predicted"))}
    for _ in range(2):  # writing a set again leaves one copy
        write_evaluation(reports, folder, "all")
    back = read_evaluation(spark, {name: df.schema for name, df in reports.items()}, folder, "all")
    cells = back["confusion"].select("label", F.explode(F.array(*[F.struct(F.lit(k).alias("p"), F.col(k).alias("n")) for k in LABELS])).alias("c"))
    none = F.lit(None).cast("double")
    return (
        back["metrics"].select(F.lit("metrics").alias("part"), F.col("label").alias("name"), F.col("support").alias("n"), F.round("f1", 6).alias("value"))
        .unionByName(cells.where("c.n > 0").select(F.lit("confusion").alias("part"), F.concat_ws(">", "label", "c.p").alias("name"), F.col("c.n").alias("n"), none.alias("value")))
        .unionByName(back["thresholds"].select(F.lit("thresholds").alias("part"), F.round(F.col("threshold") * 100).cast("int").cast("string").alias("name"),
                                               F.col("accepted").alias("n"), F.col("accepted_errors").cast("double").alias("value")))
        .unionByName(back["misclassified"].select(F.lit("misclassified").alias("part"), F.col("id").cast("string").alias("name"),
                                                  F.lit(1).cast("bigint").alias("n"), F.col("confidence").alias("value"))))
