"""Ranked retrieval: lexical, entity-filtered, inferred and hybrid routes, and their quality.

questions: (question_id, entity_id, question). Scores are sums of idf over the distinct terms that question and document
share, rounded to SCORE_DIGITS so that equal term sets score equal whatever the order of summation; ties go to the
smaller document. Question terms are joined with the postings, so only terms that are asked for travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, terms

SCORE_DIGITS, K, CANDIDATES = 9, 10, 100


def ranked(scores: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of each question, with their rank."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def question_terms(questions: DataFrame, weights: DataFrame) -> DataFrame:
    """(question_id, term, idf) of question terms that occur in the corpus."""
    return questions.select("question_id", F.explode(terms(F.col("question"))).alias("term")).join(weights.select("term", "idf"), "term")


def lexical_scores(questions: DataFrame, postings: DataFrame, weights: DataFrame) -> DataFrame:
    hits = postings.join(question_terms(questions, weights), "term")
    return hits.groupBy("question_id", "doc_id").agg(F.round(F.sum("idf"), SCORE_DIGITS).alias("score"))


def lexical(questions: DataFrame, postings: DataFrame, weights: DataFrame, k: int = K) -> DataFrame:
    """Documents with at least one of a question's terms."""
    return ranked(lexical_scores(questions, postings, weights), k)


def filtered_scores(questions: DataFrame, postings: DataFrame, weights: DataFrame, entities: DataFrame) -> DataFrame:
    """Scores of all documents of a question's entity, 0 without a shared term. The filter comes before the scoring."""
    wanted = questions.select("question_id", "entity_id").join(entities, "entity_id").select("question_id", "doc_id")
    return wanted.join(lexical_scores(questions, postings, weights), ["question_id", "doc_id"], "left").select("question_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def filtered(questions: DataFrame, postings: DataFrame, weights: DataFrame, entities: DataFrame, k: int = K) -> DataFrame:
    return ranked(filtered_scores(questions, postings, weights, entities), k)


def inference(questions: DataFrame, labels: DataFrame) -> DataFrame:
    """Questions with status unique, ambiguous or unresolved of their label, and the ids it stands for."""
    rows = questions.withColumn("folded", fold(F.col("label"))).join(labels.withColumnRenamed("label", "folded"), "folded", "left")
    n = F.coalesce(F.size("ids"), F.lit(0))
    return rows.withColumns({"status": F.when(n == 1, "unique").when(n > 1, "ambiguous").otherwise("unresolved"), "inferred": F.when(n == 1, F.col("ids")[0])}).drop("folded")


def inferred(questions: DataFrame, labels: DataFrame, postings: DataFrame, weights: DataFrame, entities: DataFrame, k: int = K) -> DataFrame:
    """Filtered by the entity that a label stands for, lexical where that is not unique."""
    known = inference(questions, labels)
    sure = known.filter("status = 'unique'").select("question_id", F.col("inferred").alias("entity_id"), "question")
    return filtered(sure, postings, weights, entities, k).unionByName(lexical(known.filter("status <> 'unique'"), postings, weights, k))


def hybrid(questions: DataFrame, postings: DataFrame, weights: DataFrame, entities: DataFrame, k: int = K, pool: int = CANDIDATES) -> DataFrame:
    """The lexical pool and all documents of the entity; these get the sum of all question weights plus one on top."""
    boost = question_terms(questions, weights).groupBy("question_id").agg(F.sum("idf").alias("all"))
    own = filtered_scores(questions, postings, weights, entities).join(boost, "question_id", "left").select("question_id", "doc_id", F.round(F.col("score") + F.coalesce("all", F.lit(0.0)) + 1.0, SCORE_DIGITS).alias("own"))
    found = lexical(questions, postings, weights, max(k, pool)).select("question_id", "doc_id", "score")
    return ranked(found.join(own, ["question_id", "doc_id"], "full_outer").select("question_id", "doc_id", F.coalesce("own", "score").alias("score")), k)


def quality(ranking: DataFrame, questions: DataFrame, relevant: DataFrame, k: int = K, digits: int = 6) -> DataFrame:
    """Hit@1, Hit@5, Hit@k, P@k and MRR@k over all questions, those without results too. relevant: (entity_id, doc_id)."""
    gold = questions.select("question_id", "entity_id").join(relevant, "entity_id").select("question_id", "doc_id", F.lit(1).alias("good"))
    rows = ranking.join(gold, ["question_id", "doc_id"], "left")
    good = F.col("good").isNotNull()
    each = rows.groupBy("question_id").agg(F.min(F.when(good, F.col("rank"))).alias("first"), F.count_if(good).alias("hits"))
    full = questions.select("question_id").join(each, "question_id", "left")
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), digits)
    hit = lambda n: share((F.col("first") <= n).cast("int"))
    return full.agg(F.count("*").alias("questions"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), hit(k).alias("hit_k"), share(F.col("hits") / k).alias("precision_k"), share(1 / F.col("first")).alias("mrr_k"))


def digest(ranking: DataFrame) -> Column:
    """Aggregate: SHA-256 over one question's documents in rank order, each as 4 bytes big-endian."""
    return F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: F.lpad(F.hex(x["doc_id"]), 8, "0")), "")), 256)


def inference_summary(known: DataFrame) -> DataFrame:
    """(questions, fallbacks, accuracy, ambiguous_labels) of ``inference``: questions answered without an entity, the share of
    unique ones whose entity is theirs, null if there is none, and the distinct folded labels that are ambiguous."""
    unique = F.col("status") == "unique"
    right = F.count_if(unique & F.col("inferred").eqNullSafe(F.col("entity_id")))
    labels = F.count_distinct(F.when(F.col("status") == "ambiguous", fold(F.col("label"))))
    return known.agg(F.count("*").alias("questions"), F.count_if(~unique).alias("fallbacks"), F.round(F.try_divide(right, F.count_if(unique)), 6).alias("accuracy"), labels.alias("ambiguous_labels"))
