"""Mixing sources to target weights by hierarchical budgeting.

Leaves are sources, under a language, under a domain. A token budget goes down the tree: siblings share their parent's budget
by weight, none gets more than its subtree can give (all its tokens, ``epochs`` times), and what one can't give goes to its
siblings before it goes to those of its parent, as the parent's own limit is the sum of its children's. With siblings ordered by
limit over weight that is one window: those before a sibling give their limit, the rest share what is left, and the largest
such share per weight holds for all.

A leaf's documents come in the order of a seeded hash, anew for each epoch; it gives the prefix of this stream that
fills its budget. Tokens before a document are summed in two steps, over slices of the hash and within them, so that no
task orders a whole leaf.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earthframe.lineage import saved
from earthframe.llm.rows import row_key

WORD = r"[^\x20\x09-\x0D]+"
#: Domains of sources by the number in their name, modulo 4, and the weights of domains and languages (1 for others).
DOMAINS = ("web", "news", "forum", "reference")
DOMAIN_WEIGHTS = {"web": 40, "news": 20, "forum": 15, "reference": 25}
LANGUAGE_WEIGHTS = {"en": 50, "de": 20, "fr": 20, "es": 10}
#: Hash slices of a leaf: one for so many documents.
SLICE = 1000


def domain(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(
        F.element_at(F.array(*map(F.lit, DOMAINS)), (F.substring(F.concat(F.lit("0"), number), -2, 2).cast("int") % 4 + 1).cast("int")))


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(known[F.col(name)], F.lit(1)).cast("bigint")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``budget`` of each of ``children`` (name, weight, limit, parent_budget, with the columns of ``parent``)."""
    order = Window.partitionBy(*parent).orderBy(F.col("limit") / F.col("weight"), name)
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("parent_budget") - before).cast("double") / weights
    best = F.max("level").over(Window.partitionBy(*parent))
    return (children.withColumn("level", level).withColumn("best", best)
            .withColumn("budget", F.least("limit", F.floor(F.col("weight") * F.col("best")).cast("bigint"))).drop("level", "best"))


def budgets(leaves: DataFrame, budget: int, epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, docs) with ``budget``: the tokens that each leaf gives."""
    limited = leaves.withColumn("limit", F.col("tokens") * epochs)
    top = limited.groupBy("domain").agg(F.sum("limit").alias("limit")).withColumn("weight", _weight("domain", DOMAIN_WEIGHTS))
    top = share(top.withColumn("parent_budget", F.lit(budget)).withColumn("root", F.lit(0)), ["root"], "domain")
    middle = limited.groupBy("domain", "lang").agg(F.sum("limit").alias("limit")).withColumn("weight", _weight("lang", LANGUAGE_WEIGHTS))
    middle = share(middle.join(top.select("domain", F.col("budget").alias("parent_budget")), "domain"), ["domain"], "lang")
    low = limited.withColumn("weight", F.lit(1).cast("bigint"))
    low = low.join(middle.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"])
    return share(low, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "docs", "budget")


def mix(docs: DataFrame, part: float = 0.8, epochs: int = 2, seed: int = 1) -> DataFrame:
    """One row per chosen document and epoch: doc_id, domain, lang, source, epoch, n_tokens, start, taken.

    The budget is ``part`` of all tokens (words). ``start`` is the number of tokens before it in its leaf's stream, ``taken`` how
    many of its tokens the budget still holds. Null languages and sources count as ``unknown``, null ids as an id of their
    own, documents without words are never chosen. Repeated rows are chosen on their own, in the order of their text. An empty table gives an empty
    result.
    """
    return _select(docs, part, epochs, seed).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "start", "taken")


def _select(docs: DataFrame, part: float, epochs: int, seed: int) -> DataFrame:
    doc, tag = row_key(docs)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("lang", "source")]
    rows = docs.select(doc.alias("_doc"), tag.alias("_tag"), F.col("doc_id").cast("bigint").alias("doc_id"), *named,
                       F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("bigint").alias("n_tokens"))
    rows = saved(rows.where("n_tokens > 0").withColumn("domain", domain(F.col("source"))))
    leaf = ["domain", "lang", "source"]
    leaves = saved(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    given = saved(budgets(leaves, int(total * part), epochs).withColumn("slices", F.ceil(F.col("docs") / SLICE)))
    stream = (rows.join(given, leaf).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
              .where(F.col("epoch") * F.col("tokens") < F.col("budget"))
              .withColumn("mark", F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).cast("binary")))
              .withColumn("slice", (F.conv(F.substring("mark", 1, 8), 16, 10).cast("bigint") * F.col("slices") / 2 ** 32).cast("int")))
    stream = saved(stream)
    parts = stream.groupBy(*leaf, "epoch", "slice").agg(F.sum("n_tokens").alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy(*leaf, "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    parts = saved(parts.select(*leaf, "epoch", "slice", F.coalesce(earlier, F.lit(0)).alias("before")))
    within = Window.partitionBy(*leaf, "epoch", "slice").orderBy("mark", "_doc", "_tag").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("epoch") * F.col("tokens") + F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return (stream.join(parts, [*leaf, "epoch", "slice"]).withColumn("start", start).where(F.col("start") < F.col("budget"))
            .withColumn("taken", F.least("n_tokens", F.col("budget") - F.col("start"))))


def keep_mixed(docs: DataFrame, part: float, seed: int = 1) -> DataFrame:
    """(_doc, _tag) of the documents chosen from one epoch."""
    return _select(docs, part, 1, seed).select("_doc", "_tag")


OP4_SQL = r"""
WITH rows AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         regexp_extract(coalesce(source, 'unknown'), '([0-9]+)$', 1) AS number FROM documents),
docs AS (
  SELECT doc_id, lang, source, n_tokens, CASE WHEN number = '' THEN 'other'
    ELSE ['web', 'news', 'forum', 'reference'][right('0' || number, 2)::INT % 4 + 1] END AS domain
  FROM rows WHERE n_tokens > 0),
leaves AS (
  SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap, count(*) AS docs FROM docs GROUP BY ALL),
top1 AS (
  SELECT domain, sum(cap)::BIGINT AS cap, coalesce(map {'web': 40, 'news': 20, 'forum': 15, 'reference': 25}[domain], 1) AS weight,
         (SELECT floor(sum(tokens) * 0.8::DOUBLE)::BIGINT FROM leaves) AS parent FROM leaves GROUP BY domain),
top2 AS (
  SELECT *, (parent - coalesce(sum(cap) OVER (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM top1),
top AS (SELECT domain, least(cap, floor(weight * max(level) OVER ())::BIGINT) AS budget FROM top2),
mid1 AS (
  SELECT l.domain, lang, sum(cap)::BIGINT AS cap, coalesce(map {'en': 50, 'de': 20, 'fr': 20, 'es': 10}[lang], 1) AS weight, any_value(budget) AS parent
  FROM leaves l JOIN top USING (domain) GROUP BY l.domain, lang),
mid2 AS (
  SELECT *, (parent - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM mid1),
mid AS (SELECT domain, lang, least(cap, floor(weight * max(level) OVER (PARTITION BY domain))::BIGINT) AS budget FROM mid2),
low1 AS (SELECT l.*, mid.budget AS parent, 1 AS weight FROM leaves l JOIN mid USING (domain, lang)),
low2 AS (
  SELECT *, (parent - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM low1),
low AS (SELECT domain, lang, source, tokens, least(cap, floor(weight * max(level) OVER (PARTITION BY domain, lang))::BIGINT) AS budget FROM low2),
stream AS (
  SELECT d.*, e.epoch, low.tokens, low.budget, md5('1:' || e.epoch || ':' || d.doc_id) AS mark
  FROM docs d JOIN low USING (domain, lang, source) CROSS JOIN (SELECT unnest([0, 1]) AS epoch) e WHERE e.epoch * low.tokens < low.budget),
placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY mark, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM stream)
SELECT doc_id, domain, lang, source, epoch, n_tokens, start::BIGINT AS start, least(n_tokens, budget - start)::BIGINT AS taken FROM placed WHERE start < budget
"""
