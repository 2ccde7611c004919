"""The registry of typed entities: typed keys, labels, resolution.

A registry has type, key, label, canonical_id and an ordinal that gives the order of its entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import references
from ..functions.text import fold


def typed_keys(registry: DataFrame) -> DataFrame:
    """(type, key, canonical_id); the last of repeated keys wins."""
    return registry.groupBy("type", "key").agg(F.max_by("canonical_id", "ordinal").alias("canonical_id"))


def resolve(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """``refs`` with the canonical_id of its (type, key), null where there is none."""
    return refs.join(typed_keys(registry), ["type", "key"], "left")


def candidates(registry: DataFrame) -> DataFrame:
    """(label, candidates, n): all entries of a folded label, repeated ones too, in order."""
    entry = F.struct("ordinal", "type", "key", "canonical_id")
    return registry.groupBy(fold(F.col("label")).alias("label")).agg(F.array_sort(F.collect_list(entry)).alias("candidates"), F.count("*").alias("n"))


def label_ids(registry: DataFrame) -> DataFrame:
    """(label, ids): the distinct ids of a folded label, sorted."""
    return registry.groupBy(fold(F.col("label")).alias("label")).agg(F.array_sort(F.collect_set("canonical_id")).alias("ids"))


def exploded(docs: DataFrame, text: str = "tagged_text", key: str = "doc_id") -> DataFrame:
    """(doc_id, pos, type, key, raw, start, end): one row per reference."""
    return docs.select(key, F.posexplode(references(F.col(text))).alias("pos", "r")).select(key, "pos", "r.*")


def split_resolved(docs: DataFrame, registry: DataFrame, text: str = "tagged_text") -> DataFrame:
    """(doc_id, resolved, unresolved): distinct ids, and raw references in order that resolve to nothing."""
    rows = resolve(exploded(docs, text), registry)
    return rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("canonical_id")).alias("resolved"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("canonical_id").isNull(), F.struct("pos", "raw")))), lambda x: x["raw"]).alias("unresolved"),
        F.count("*").alias("references"),
    )
