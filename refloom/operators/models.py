"""Model-backed linkers end to end: known mentions train aliases and profiles, each mention gets its most similar candidate,
and the result is a recorded run.

Mentions of training are (doc_id, start, end, canonical_id). Linked mentions are (doc_id, label, start, end, type, key) with
the label as the text has it. Scores are rounded to SCORE_DIGITS, so that equal profiles tie whatever the order of summation;
ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import version

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTEXT, context, estimated_tokens, surface
from . import passages, vectors
from .linking import mentions, without_overlaps

SCORE_DIGITS = 9


def require_versions(wanted: dict[str, str]) -> None:
    """An error unless the installed libraries are exactly the versions that a model was made with."""
    wrong = {name: version(name) for name, want in wanted.items() if version(name) != want}
    if wrong:
        raise RuntimeError(f"installed are {wrong}, wanted {wanted}")


def trained(known: DataFrame, docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Training mentions with their label, the stripped text, where that has two characters; an unknown entity is an error."""
    ids = registry.select("canonical_id").distinct().withColumn("known", F.lit(True))
    unknown = F.raise_error(F.concat(F.lit("training data names an unknown entity: "), "canonical_id"))
    rows = known.select("doc_id", "start", "end", "canonical_id").join(ids, "canonical_id", "left")
    rows = rows.withColumn("canonical_id", F.when(F.col("known"), F.col("canonical_id")).otherwise(unknown)).drop("known")
    label = F.trim(F.substring("plain_text", F.col("start") + 1, F.col("end") - F.col("start")))
    return rows.join(docs.select("doc_id", "plain_text"), "doc_id").withColumn("label", label).drop("plain_text").filter(F.length("label") >= 2)


def _spots(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """(spot, ids, surface, context) of the mentions (doc_id, start, end, ids)."""
    rows = found.join(docs.select("doc_id", "plain_text"), "doc_id")
    text = F.substring("plain_text", F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.select(F.struct("doc_id", "start", "end").alias("spot"), "ids", text.alias("surface"), context(F.col("plain_text"), F.col("start"), F.col("end"), width).alias("context"))


def _linked(spots: DataFrame, scores: DataFrame, registry: DataFrame) -> DataFrame:
    """The only candidate of a mention, or the best of several by ``scores``."""
    best = vectors.best(scores.withColumn("score", F.round("score", SCORE_DIGITS)), "spot", "canonical_id")
    picked = spots.join(best, "spot", "left").withColumn("canonical_id", F.when(F.size("ids") == 1, F.col("ids")[0]).otherwise(F.col("canonical_id")))
    entries = registry.groupBy("canonical_id").agg(F.max_by(F.struct("type", "key"), "ordinal").alias("e"))
    return picked.join(entries, "canonical_id").select("spot.doc_id", F.col("surface").alias("label"), "spot.start", "spot.end", "e.type", "e.key")


def tfidf_linker(docs: DataFrame, registry: DataFrame, known: DataFrame, training: DataFrame, width: int = CONTEXT) -> DataFrame:
    """Mentions are whole-word aliases, longer ones first; candidates compare by character n-gram TF-IDF of the context.

    Profiles are counted part by part, so that the contexts of a frequent entity never meet in one row, and only mentions
    with several candidates are scored.
    """
    seen = trained(known, training, registry)
    names = passages.aliases(registry, seen).withColumnRenamed("alias", "label")
    found = without_overlaps(mentions(docs, names.select("label"))).join(names, "label")
    spots = _spots(docs, found, width)
    unsure = spots.filter(F.size("ids") > 1)
    grams = vectors.char_ngrams(passages.profile_parts(registry, seen, training, width), "canonical_id", "text")
    shares = vectors.frequencies(grams, registry.select("canonical_id").distinct())
    asked = vectors.tfidf(vectors.char_ngrams(unsure, "spot", "context"), "spot", frequencies=shares)
    pairs = unsure.select("spot", F.explode("ids").alias("canonical_id"))
    return _linked(spots, vectors.dot(pairs, asked, vectors.tfidf(grams, "canonical_id", frequencies=shares), "spot", "canonical_id"), registry)


def vector_linker(docs: DataFrame, spans: DataFrame, registry: DataFrame, known: DataFrame, training: DataFrame, embed: Callable[[DataFrame], DataFrame], width: int = CONTEXT) -> DataFrame:
    """Mentions are a recogniser's ``spans`` (doc_id, start, end) that are an alias but for a leading article; candidates
    compare by the cosine of vectors. ``embed`` maps (id, text) to (id, vector of doubles)."""
    seen = trained(known, training, registry)
    rows = spans.select("doc_id", "start", "end").join(docs.select("doc_id", "plain_text"), "doc_id")
    head = surface(F.substring("plain_text", F.col("start") + 1, F.col("end") - F.col("start")))["offset"]
    rows = rows.withColumn("start", (F.col("start") + head).cast("int")).filter(F.col("end") > F.col("start"))
    rows = rows.withColumn("surface", F.substring("plain_text", F.col("start") + 1, F.col("end") - F.col("start"))).select("doc_id", "start", "end", "surface")
    named = passages.looked_up(rows, passages.aliases(registry, seen)).filter("ids is not null").withColumnRenamed("alias", "label")
    spots = _spots(docs, without_overlaps(named.select("doc_id", "label", "start", "end")).join(named.select("doc_id", "start", "end", "ids").distinct(), ["doc_id", "start", "end"]), width)
    unsure = spots.filter(F.size("ids") > 1)
    asked = embed(unsure.select(F.col("spot").alias("id"), F.col("context").alias("text"))).toDF("spot", "a")
    profiles = passages.profiles(registry, seen, training, width)
    held = embed(profiles.select(F.col("canonical_id").alias("id"), F.col("profile").alias("text"))).toDF("canonical_id", "b")
    pairs = unsure.select("spot", F.explode("ids").alias("canonical_id")).join(asked, "spot").join(held, "canonical_id")
    return _linked(spots, vectors.cosine_scores(pairs).select("spot", "canonical_id", "score"), registry)


def costs(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """(doc_id, model_calls, estimated_tokens): the model is called once for a document with mentions."""
    called = linked.select("doc_id").distinct().withColumn("called", F.lit(1))
    calls = F.coalesce("called", F.lit(0)).cast("long").alias("model_calls")
    return docs.select("doc_id", estimated_tokens(F.col("plain_text")).cast("long").alias("estimated_tokens")).join(called, "doc_id", "left").select("doc_id", calls, "estimated_tokens")
