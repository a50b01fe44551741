"""Questions as rows: places by gazetteer, then the whole reading in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earthframe.functions import questions as Q
from earthframe.lineage import cut


def read_once(rows: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``read`` gives for their text, from reading each distinct text once.

    ``read`` takes a table of distinct texts and returns one row for each, with its ``text``. Reading costs milliseconds a text, so
    the few distinct texts of a large table are dealt to all tasks by number and not by size.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = cut(rows.select("text").distinct().repartition(tasks, "text"))  # or a filter on what is read would run on all rows
    known = read(texts).withColumnRenamed("text", "_read")
    return rows.join(known, rows["text"].eqNullSafe(known["_read"])).drop("_read")


def read_places(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``texts`` with the place that each distinct text names."""
    named = mentioned_place(texts.select(F.col("text").alias("question_id"), "text"), gazetteer)
    named = named.select(F.col("question_id").alias("_named"), "place", "status")
    return texts.join(named, texts["text"].eqNullSafe(named["_named"])).drop("_named")


def mentioned_place(questions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(question_id, place, status): the known place a question names.

    Word runs of the question, as long as the longest name, meet gazetteer names on equality. A
    match inside a longer one does not count; two different places are ambiguous, none is missing.
    """
    names = gazetteer.select(F.array_join(Q.place_words(F.col("name")), " ").alias("gram"),
                             F.col("name").alias("place")).where("gram <> ''").distinct()
    longest = names.agg(F.max(F.size(F.split("gram", " ")))).first()[0] or 1
    runs = questions.select("question_id", F.explode(Q.place_ngrams(F.col("text"), longest)).alias("r")).select(
        "question_id", "r.at", "r.words", "r.gram")
    hits = runs.join(names, "gram").groupBy("question_id").agg(
        F.collect_list(F.struct("at", "words", "place")).alias("hits"))
    outer = F.filter("hits", lambda h: ~F.exists("hits", lambda o: (
        (o["words"] > h["words"]) & (o["at"] <= h["at"])
        & (o["at"] + o["words"] >= h["at"] + h["words"]))))
    places = hits.select("question_id", F.array_sort(F.array_distinct(
        F.transform(outer, lambda h: h["place"]))).alias("places"))
    return questions.select("question_id").join(places, "question_id", "left").select(
        "question_id",
        F.when(F.size("places") == 1, F.get("places", F.lit(0))).alias("place"),
        F.when(F.col("places").isNull(), "missing").when(F.size("places") > 1, "ambiguous")
        .otherwise("found").alias("status"))


def read_questions(questions: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """question_id, text, place, flags, dates and the masked text a classifier sees."""
    return read_once(questions, lambda texts: read_texts(texts, gazetteer))


def read_texts(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``texts`` (distinct) with place, status, flags, dates and the masked text."""
    return (
        read_places(texts, gazetteer).withColumn("flags", Q.question_flags(F.col("text")))
        .withColumn("dates", Q.extract_dates(F.col("text")))
        .withColumn("masked", Q.mask_slots(F.col("text"), F.col("place")))
    )
