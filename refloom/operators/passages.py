"""Corpora for linkers and retrieval: generated documents, what a passage holds, known mentions, aliases and profiles, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONTEXT, PASSAGE, context, estimated_tokens, fold, title

#: What joins the contexts of a profile. A fixed value.
BETWEEN = " \n "


def generated(sources: DataFrame, order: str, n: int) -> DataFrame:
    """``n`` documents numbered from 0; document i is the source of ordinal i modulo the number of sources.

    Sources are numbered by ``order`` within ranges whose sizes are summed up first, so no task sorts all of them.
    """
    spark = sources.sparkSession
    ranged = sources.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").agg(F.count("*").alias("size"))  # a row a partition
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    numbered = ranged.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("ordinal", F.col("inside") + F.col("before")).drop("part", "inside", "before")
    total = before.select("total").limit(1)  # one row
    ids = spark.range(n).withColumnRenamed("id", "generated_id").crossJoin(F.broadcast(total)).withColumn("ordinal", F.col("generated_id") % F.col("total")).drop("total")
    return ids.join(numbered.drop("total"), "ordinal")


def entities_in_context(spans: DataFrame, docs: DataFrame, width: int = PASSAGE) -> DataFrame:
    """(doc_id, pos, ids): entities whose mention lies wholly in the window of ``width`` around a mention, its own too.

    ``spans``: (doc_id, pos, start, end, canonical_id).
    """
    size = docs.select("doc_id", F.length("plain_text").alias("size"))
    windows = spans.join(size, "doc_id").select("doc_id", "pos", F.greatest(F.lit(0), F.col("start") - width).alias("left"), F.least("size", F.col("end") + width).alias("right"))
    inner = spans.select("doc_id", F.col("start").alias("s"), F.col("end").alias("e"), "canonical_id")
    held = windows.join(inner, "doc_id").filter("s >= left and e <= right")
    return held.groupBy("doc_id", "pos").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))


def known_mentions(mentions: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions of entities in the registry, with its label and type; mentions of unknown ones, which training refuses)."""
    entries = registry.groupBy("canonical_id").agg(F.min(F.struct("type", "label")).alias("e")).select("canonical_id", F.col("e.type").alias("entity_type"), F.col("e.label").alias("entity_label"))
    return mentions.join(entries, "canonical_id"), mentions.join(entries, "canonical_id", "left_anti")


def aliases(registry: DataFrame, mentions: DataFrame) -> DataFrame:
    """(alias, ids): folded labels, folded texts of known mentions of at least two characters, and what they stand for."""
    seen = mentions.filter(F.length(F.trim("label")) >= 2).select(fold(F.trim("label")), "canonical_id")
    both = registry.select(fold(F.trim("label")).alias("alias"), "canonical_id").union(seen)
    return both.filter("alias <> ''").groupBy("alias").agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))


def profile_parts(registry: DataFrame, mentions: DataFrame, docs: DataFrame, width: int = CONTEXT) -> DataFrame:
    """(canonical_id, text): the label and the context of each mention, a row each."""
    near = mentions.join(docs.select("doc_id", "plain_text"), "doc_id")
    labels = registry.groupBy("canonical_id").agg(F.min("label").alias("text"))
    return labels.union(near.select("canonical_id", context(F.col("plain_text"), F.col("start"), F.col("end"), width)))


def profiles(registry: DataFrame, mentions: DataFrame, docs: DataFrame, width: int = CONTEXT) -> DataFrame:
    """(canonical_id, profile): the label and the contexts of all mentions in order of (doc_id, start), joined by BETWEEN."""
    near = mentions.join(docs.select("doc_id", "plain_text"), "doc_id").select("canonical_id", "doc_id", "start", context(F.col("plain_text"), F.col("start"), F.col("end"), width).alias("context"))
    gathered = near.groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "start", "context"))).alias("all"))
    labels = registry.groupBy("canonical_id").agg(F.min("label").alias("label"))
    parts = F.concat(F.array("label"), F.coalesce(F.col("all")["context"], F.array().cast("array<string>")))
    return labels.join(gathered, "canonical_id", "left").select("canonical_id", F.array_join(parts, BETWEEN).alias("profile"))


def looked_up(surfaces: DataFrame, alias_table: DataFrame) -> DataFrame:
    """Surfaces (surface, ...) with the ids of the alias that they are, folded; null where there is none."""
    return surfaces.withColumn("alias", fold(F.trim("surface"))).join(alias_table, "alias", "left")


def scope(annotations: DataFrame) -> DataFrame:
    """One row: documents, positions, pairs of document and entity, and entities of annotations (doc_id, canonical_id)."""
    return annotations.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("positions"), F.count_distinct("doc_id", "canonical_id").alias("pairs"), F.count_distinct("canonical_id").alias("entities"))


def answers(ranking: DataFrame, questions: DataFrame, relevant: DataFrame, docs: DataFrame) -> DataFrame:
    """(question_id, answer, correct, context_words): the title of the first passage, whether that passage is relevant and the
    title is one of the entity's, and the words of all passages of the ranking. Questions without passages have no answer."""
    texts = docs.select("doc_id", title(F.col("text")).alias("title"), estimated_tokens(F.col("text")).alias("words"))
    gold = questions.select("question_id", "entity_id").join(relevant, "entity_id").select("question_id", "doc_id").distinct()
    titles = gold.join(texts, "doc_id").select("question_id", F.col("title").alias("answer")).distinct().withColumn("known", F.lit(True))
    rows = ranking.join(texts, "doc_id").join(gold.withColumn("good", F.lit(True)), ["question_id", "doc_id"], "left")
    first = F.col("rank") == 1
    each = rows.groupBy("question_id").agg(F.max(F.when(first, F.col("title"))).alias("answer"), F.max(F.when(first, F.col("good"))).alias("good"), F.sum("words").alias("context_words"))
    judged = questions.select("question_id").join(each, "question_id", "left").join(titles, ["question_id", "answer"], "left")
    return judged.select("question_id", "answer", F.coalesce(F.col("good") & F.col("known"), F.lit(False)).alias("correct"), F.coalesce("context_words", F.lit(0)).cast("long").alias("context_words"))


def failing(ranking: DataFrame, questions: DataFrame, relevant: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` questions, by entity, whose first passage is not relevant; the first ``n`` of all if none fails."""
    gold = questions.select("question_id", "entity_id").join(relevant, "entity_id").select("question_id", "doc_id").distinct()
    good = ranking.filter("rank = 1").join(gold, ["question_id", "doc_id"], "left_semi").select("question_id", F.lit(1).alias("good"))
    rows = questions.select("question_id", "entity_id").join(good, "question_id", "left").withColumn("fails", F.col("good").isNull())
    some = rows.agg(F.bool_or("fails").alias("some"))  # one row
    return rows.crossJoin(F.broadcast(some)).filter("fails or not some").orderBy("entity_id", "question_id").limit(n).select("question_id", "entity_id", "fails")
