"""Registered queries over near-duplicate texts and place candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from earthframe.functions import ngrams as N
from earthframe.operators import gazetteer as Z
from earthframe.operators import similarity as S
from earthframe.plans.registry import query, sql_view, table

sql_view("labelled_text", """
SELECT l.doc_id AS id, 'q' || quality || 't' || toxic AS label, text,
 regexp_replace(text, '[A-Z][a-z]+', 'PLACE', 'g') AS masked FROM labels l JOIN documents d ON l.doc_id = d.doc_id
""")


def labelled_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.format_string("q%dt%d", "quality", "toxic").alias("label"), "text",
        F.regexp_replace("text", "[A-Z][a-z]+", "PLACE").alias("masked"))


def _norm(col: str) -> str:
    return f"trim(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _shingle_view(source: str, col: str) -> str:
    return f"""SELECT DISTINCT id, label, substr(p, CAST(i AS BIGINT), 4) AS gram FROM (
 SELECT id, label, ' ' || {_norm(col)} || ' ' AS p FROM {source}) s, LATERAL (SELECT unnest(range(1, greatest(length(p) - 3, 1) + 1)) AS i)"""


sql_view("distinct_text", f"""
SELECT label, nt, nm, min(id) AS id, min(text) AS text, min(masked) AS masked FROM (
 SELECT *, {_norm('text')} AS nt, {_norm('masked')} AS nm FROM labelled_text) GROUP BY label, nt, nm
""")
sql_view("raw_grams", _shingle_view("distinct_text", "text"))
sql_view("masked_grams", _shingle_view("distinct_text", "masked"))


def _pair_view(grams: str, threshold: float, same: str) -> str:
    return f"""SELECT a, b, c / CAST(na + nb - c AS DOUBLE) AS jaccard FROM (
 SELECT x.id AS a, y.id AS b, count(*) AS c FROM {grams} x JOIN {grams} y ON x.gram = y.gram AND x.id < y.id {same} GROUP BY ALL)
 JOIN (SELECT id AS a, count(*) AS na FROM {grams} GROUP BY id) USING (a) JOIN (SELECT id AS b, count(*) AS nb FROM {grams} GROUP BY id) USING (b)
 WHERE c / CAST(na + nb - c AS DOUBLE) >= {threshold}"""


sql_view("raw_pairs", _pair_view("raw_grams", 0.55, ""))
sql_view("masked_pairs", _pair_view("masked_grams", 0.75, "AND x.label = y.label"))


def distinct_text(spark, sf):
    t = labelled_text(spark, sf).withColumn("nt", N.normalise(F.col("text"))).withColumn(
        "nm", N.normalise(F.col("masked")))
    reps, _ = S.fold_copies(t, ["label", "nt", "nm"])
    return reps.select("id", "label", F.col("nt").alias("text"), F.col("nm").alias("masked"))


@query("f13_shingles", f"""
SELECT id, count(*) AS grams, min(gram) AS first_gram, max(gram) AS last_gram FROM (
 {_shingle_view('(SELECT doc_id AS id, lang AS label, text FROM documents)', 'text')}) GROUP BY id
""")
def shingles(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), N.shingles(F.col("text")).alias("g"))
    return d.select("id", F.size("g").cast("bigint").alias("grams"),
                    F.array_min("g").alias("first_gram"), F.array_max("g").alias("last_gram"))


@query("u4_jaccard", f"""
WITH g AS ({_shingle_view('(SELECT item_id AS id, 0 AS label, text FROM benchmark)', 'text')}),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id)
SELECT a.id, round(coalesce(c, 0) / CAST(a.n + b.n - coalesce(c, 0) AS DOUBLE), 6) AS jaccard FROM n a JOIN n b ON b.id = a.id + 1
LEFT JOIN (SELECT x.id, count(*) AS c FROM g x JOIN g y ON y.id = x.id + 1 AND x.gram = y.gram GROUP BY x.id) c ON c.id = a.id
""")
def jaccard(spark, sf):
    b = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), N.shingles(F.col("text")).alias("g"))
    nxt = b.select((F.col("id") - 1).alias("id"), F.col("g").alias("h"))
    return b.join(nxt, "id").select(
        "id", F.round(N.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


@query("j13_similar_pairs", "SELECT a, b FROM raw_pairs UNION SELECT a, b FROM masked_pairs")
def similar_pairs(spark, sf):
    return S.similar_pairs(distinct_text(spark, sf))


@query("j13_jaccard_pairs", "SELECT a, b, round(jaccard, 6) AS jaccard FROM raw_pairs")
def jaccard_pairs(spark, sf):
    return S.jaccard_pairs(distinct_text(spark, sf).select("id", "text"), 0.55).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_FAMILIES = f"""
WITH RECURSIVE links AS MATERIALIZED (SELECT a, b FROM raw_pairs UNION SELECT a, b FROM masked_pairs UNION SELECT b, a FROM raw_pairs UNION SELECT b, a FROM masked_pairs),
reach(id, other) AS (SELECT id, id FROM distinct_text UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
fam AS (SELECT t.id, r.root AS family FROM (SELECT *, {_norm('text')} AS nt, {_norm('masked')} AS nm FROM labelled_text) t
 JOIN distinct_text d ON t.label = d.label AND t.nt = d.nt AND t.nm = d.nm JOIN roots r ON r.id = d.id)
"""


@query("j14_families", _FAMILIES + "SELECT id, family FROM fam")
def families(spark, sf):
    return S.families(labelled_text(spark, sf))


@query("j15_nearest_training_item", f"""
WITH g AS ({_shingle_view("(SELECT doc_id AS id, source AS label, text FROM documents)", 'text')}),
s AS (SELECT id, count(*) AS n, id IN (SELECT doc_id FROM labels) AS train FROM g GROUP BY id),
c AS (SELECT x.id, y.id AS o, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram JOIN s a ON a.id = x.id AND NOT a.train JOIN s b ON b.id = y.id AND b.train GROUP BY ALL)
SELECT a.id, round(coalesce(max(c / CAST(a.n + b.n - c AS DOUBLE)), 0), 6) AS max_jaccard, coalesce(max(c / CAST(a.n + b.n - c AS DOUBLE)), 0) >= 0.75 AS near
FROM s a LEFT JOIN c ON c.id = a.id LEFT JOIN s b ON b.id = c.o WHERE NOT a.train GROUP BY a.id
""")
def nearest_training_item(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    labelled = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    out = S.nearest_similarity(docs.join(labelled, "id", "left_anti"),
                               docs.join(labelled, "id", "left_semi"))
    return out.select("id", F.round("max_jaccard", 6).alias("max_jaccard"), "near")


# --------------------------------------------------------------------------- #
# Places
# --------------------------------------------------------------------------- #

sql_view("place_rows", """
SELECT 'Lake ' || o_custkey || ', ' || o_orderpriority AS query, o_custkey AS q,
 CAST(row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS rank, o_orderkey AS k,
 CASE o_orderkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS osm_type,
 CASE o_orderkey % 4 WHEN 0 THEN 'place' ELSE 'natural' END AS class,
 CASE WHEN o_orderkey % 5 < 2 THEN 'Làke ' || o_custkey || ' Shore' ELSE 'Hill ' || o_orderkey END AS name,
 o_orderkey % 13 = 0 AS broken FROM orders
""")


def place_rows(spark, sf):
    """Search results in source order; some boxes are malformed, some names accented."""
    from pyspark.sql import Window

    k, q = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rank = F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey"))
    box = F.array(F.lit("12.5"), F.lit("12.75"), F.lit("80.25"), F.lit("80.5"))
    bad = F.array(F.lit("12.5"), F.lit("north"), F.lit("80.25"), F.lit("80.5"))
    name = F.when(k % 5 < 2, F.concat(F.lit("Làke "), q, F.lit(" Shore"))).otherwise(
        F.concat(F.lit("Hill "), k.cast("string")))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("Lake "), q, F.lit(", "), "o_orderpriority").alias("query"),
        rank.alias("rank"), k.alias("k"), F.lit("12.6").alias("lat"), F.lit("80.3").alias("lon"),
        F.when(k % 13 == 0, bad).otherwise(box).alias("boundingbox"), name.alias("display_name"),
        F.when(k % 4 == 0, "place").otherwise("natural").alias("class"), F.lit("water").alias("type"),
        F.when(k % 3 == 0, "node").when(k % 3 == 1, "way").otherwise("relation").alias("osm_type"),
        name.alias("name"))


sql_view("place_kept", """
SELECT *, osm_type = 'node' AND class <> 'place' AS point_like, k % 5 < 2 AS names_query FROM place_rows
WHERE rank <= 5 AND NOT broken AND query NOT IN (SELECT query FROM place_rows WHERE rank = 1 AND broken)
""")


@query("s7_t2_parse_candidates", "SELECT query, rank, osm_type, name, 80.25e0 AS west, 12.75e0 AS north FROM place_kept")
def parse_candidates(spark, sf):
    return Z.parse_candidates(place_rows(spark, sf))[0].select(
        "query", "rank", "osm_type", "name", F.col("bbox.west").alias("west"),
        F.col("bbox.north").alias("north"))


@query("s7_rejected_queries", "SELECT query, 'unexpected first candidate' AS reason FROM place_rows WHERE rank = 1 AND broken")
def rejected_queries(spark, sf):
    return Z.parse_candidates(place_rows(spark, sf))[1]


@query("p35_point_like", "SELECT query, rank, point_like FROM place_kept")
def point_like(spark, sf):
    return Z.parse_candidates(place_rows(spark, sf))[0].select(
        "query", "rank", Z.point_like().alias("point_like"))


@query("j11_name_containment", "SELECT query, rank, names_query FROM place_kept")
def name_containment(spark, sf):
    return Z.with_name_match(Z.parse_candidates(place_rows(spark, sf))[0]).select(
        "query", "rank", "names_query")


@query("j12_select_candidate", """
SELECT query, arg_min(rank, CASE WHEN f AND NOT point_like AND names_query AND rank > 1 THEN rank - 100 ELSE rank END) AS rank FROM (
 SELECT *, first_value(point_like) OVER (PARTITION BY query ORDER BY rank) AS f FROM place_kept) GROUP BY query
""")
def select_candidate(spark, sf):
    return Z.select_candidate(Z.parse_candidates(place_rows(spark, sf))[0]).select("query", "rank")


@query("a25_geocoder_counters", """
SELECT user_id % 10 AS service, count(*) FILTER (WHERE event_type = 'view') AS upstream_requests, count(*) FILTER (WHERE event_type = 'error') AS throttled,
 count(*) FILTER (WHERE event_type = 'click') AS cache_hits, count(*) FILTER (WHERE event_type = 'signup') AS coalesced,
 count(*) FILTER (WHERE event_type = 'purchase') AS refused_during_cooldown FROM events GROUP BY 1
""")
def geocoder_counters(spark, sf):
    names = F.create_map(*[F.lit(x) for pair in (
        ("view", "request"), ("error", "throttled"), ("click", "cache_hit"),
        ("signup", "coalesced"), ("purchase", "refused")) for x in pair])
    log = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("service"), F.element_at(names, F.col("event_type")).alias("event"))
    return Z.geocoder_counters(log)
