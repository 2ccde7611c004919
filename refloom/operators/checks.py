"""Checks of a corpus before it is used: conformance, registry, gold references, labels, splits, agreement of two versions.

Each check returns the rows that break a rule, none if all is well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grammar
from ..functions.text import fold
from .linking import plain_matches
from .registry import split_resolved, typed_keys


def conformance(cases: DataFrame) -> DataFrame:
    """(id, expected, got) of the cases (id, input, valid, result) that validation judges otherwise."""
    rows = cases.withColumn("v", grammar.validate(F.col("input")))
    same = F.col("v.valid").eqNullSafe(F.col("valid")) & F.col("v.code").eqNullSafe(F.col("result"))
    return rows.filter(~same).select("id", F.col("result").alias("expected"), F.col("v.code").alias("got"))


def registry_rules(registry: DataFrame, types: list[str]) -> DataFrame:
    """(subject, message): typed keys and ids that occur more than once, types that are not allowed, empty labels."""
    key, known = F.concat_ws(":", "type", "key"), F.col("type").isin(types)
    rules = [
        registry.groupBy(key.alias("subject")).count().filter("count > 1").select("subject", F.lit("repeated typed key").alias("message")),
        registry.groupBy(F.col("canonical_id").alias("subject")).count().filter("count > 1").select("subject", F.lit("repeated id").alias("message")),
        registry.filter(~F.coalesce(known, F.lit(False))).select(key.alias("subject"), F.lit("type is not allowed").alias("message")),
        registry.filter(F.coalesce(F.trim("label"), F.lit("")) == "").select(F.col("canonical_id").alias("subject"), F.lit("empty label").alias("message")),
    ]
    return reduce(DataFrame.unionByName, rules)


def gold_rules(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, message) of documents whose references and gold ids do not agree; repeated ids count."""
    ids = registry.select(F.col("canonical_id").alias("id")).distinct()
    unknown = docs.select("doc_id", F.explode("gold").alias("id")).join(ids, "id", "left_anti").select("doc_id").distinct()
    refs = docs.select("doc_id", F.posexplode(grammar.references(F.col("tagged_text"))).alias("pos", "r")).select("doc_id", "r.type", "r.key")
    found = refs.join(typed_keys(registry), ["type", "key"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list("canonical_id")).alias("found"))
    rows = docs.join(found, "doc_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    rules = [
        unknown.select("doc_id", F.lit("unknown gold id").alias("message")),
        split_resolved(docs, registry).filter(F.size("unresolved") > 0).select("doc_id", F.lit("a reference resolves to nothing").alias("message")),
        rows.filter(F.array_sort("gold") != F.col("found")).select("doc_id", F.lit("references and gold differ").alias("message")),
        docs.filter(F.coalesce(F.trim("plain_text"), F.lit("")) == "").select("doc_id", F.lit("empty text").alias("message")),
        docs.filter(grammar.has_leftover(F.col("tagged_text"))).select("doc_id", F.lit("broken markup").alias("message")),
    ]
    return reduce(DataFrame.unionByName, rules)


def source_rules(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, message) of what keeps source documents from being generated from: repeated ids, references that resolve to
    nothing, other sets of ids than gold, and, with a null doc_id, no documents at all."""
    empty = F.array().cast("array<string>")
    found = split_resolved(docs, registry)
    rows = docs.select("doc_id", F.array_sort(F.array_distinct("gold")).alias("gold")).join(found, "doc_id", "left")
    rules = [
        docs.groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit("repeated document").alias("message")),
        found.filter(F.size("unresolved") > 0).select("doc_id", F.lit("a reference resolves to nothing").alias("message")),
        rows.filter(~F.col("gold").eqNullSafe(F.coalesce("resolved", empty))).select("doc_id", F.lit("references and gold differ").alias("message")).distinct(),
        docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 0").select("doc_id", F.lit("no documents").alias("message")),
    ]
    return reduce(DataFrame.unionByName, rules)


def label_multisets(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(doc_id, label, found, required): how often each label occurs in a text, and how many gold ids have it."""
    found = plain_matches(docs, registry).select("doc_id", "label", F.col("occurrences").alias("found"))
    labels = registry.groupBy("canonical_id").agg(F.min(fold(F.col("label"))).alias("label"))
    gold = docs.select("doc_id", F.explode("gold").alias("canonical_id")).join(labels, "canonical_id")
    required = gold.groupBy("doc_id", "label").agg(F.count("*").cast("int").alias("required"))
    both = found.join(required, ["doc_id", "label"], "full_outer")
    return both.select("doc_id", "label", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("required", F.lit(0)).alias("required"))


def shared_by_splits(rows: DataFrame, split: str, value: str) -> DataFrame:
    """Values that occur in more than one split; disjoint splits have none. Only values and split names travel."""
    return rows.select(value, split).distinct().groupBy(value).agg(F.count("*").alias("splits")).filter("splits > 1")


def reconciled(docs: DataFrame, other: DataFrame) -> DataFrame:
    """(doc_id, message) where a second version of documents (doc_id, plain_text, gold) is not that of the first."""
    a = docs.select("doc_id", F.col("plain_text").alias("text_a"), F.array_sort("gold").alias("gold_a"), F.lit(1).alias("in_a"))
    b = other.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("plain_text").alias("text_b"), F.min(F.array_sort("gold")).alias("gold_b"))
    rows = a.join(b, "doc_id", "full_outer")
    both = F.col("in_a").isNotNull() & F.col("n").isNotNull()
    rules = [(F.col("in_a").isNull(), "unknown case"), (F.col("n").isNull(), "missing case"), (F.col("n") > 1, "repeated case"), (both & ~F.col("text_a").eqNullSafe(F.col("text_b")), "text differs"), (both & ~F.col("gold_a").eqNullSafe(F.col("gold_b")), "gold differs")]
    named = F.array(*(F.when(F.coalesce(wrong, F.lit(False)), message) for wrong, message in rules))
    return rows.select("doc_id", F.explode(F.array_compact(named)).alias("message"))
