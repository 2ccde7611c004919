"""Inverted indexes over entities and terms, their fingerprints, checksums and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import terms
from .registry import exploded, resolve

_MODULUS = "18446744073709551616BD"


def entity_postings(docs: DataFrame, registry: DataFrame, text: str = "tagged_text") -> DataFrame:
    """(entity_id, doc_id), distinct, from the references in the texts."""
    return resolve(exploded(docs, text), registry).filter("canonical_id is not null").select(F.col("canonical_id").alias("entity_id"), "doc_id").distinct()


def metadata_postings(docs: DataFrame, ids: str = "gold") -> DataFrame:
    """The same from a column of ids."""
    return docs.select(F.explode(F.array_distinct(ids)).alias("entity_id"), "doc_id")


def lists(postings: DataFrame, key: str = "entity_id") -> DataFrame:
    """(key, docs): the ascending documents of each key, for small indexes and exchange; queries use the rows."""
    return postings.groupBy(key).agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))


def fingerprint(postings: DataFrame) -> DataFrame:
    """(entity_id, n, sha256) of id, zero byte, count as 8 bytes big-endian, and 4-byte little-endian document numbers.

    A digest a key keeps the index distributed; two indexes are equal if these tables are.
    """
    word = F.expr("transform(docs, d -> concat(substring(lpad(hex(d), 8, '0'), 7, 2), substring(lpad(hex(d), 8, '0'), 5, 2), substring(lpad(hex(d), 8, '0'), 3, 2), substring(lpad(hex(d), 8, '0'), 1, 2)))")
    data = F.concat(F.hex(F.encode("entity_id", "UTF-8")), F.lit("00"), F.lpad(F.hex(F.size("docs").cast("long")), 16, "0"), F.array_join(word, ""))
    return lists(postings).select("entity_id", F.size("docs").alias("n"), F.sha2(F.unhex(data), 256).alias("sha256"))


def index_digest(prints: DataFrame) -> DataFrame:
    """(entities, postings, sha256): one digest of a whole ``fingerprint`` table.

    Keys are digested in 4,096 groups by the first three hex digits of their SHA-256, then the groups in order.
    """
    item = F.struct("entity_id", "sha256")
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(x["entity_id"], F.lit(":"), x["sha256"]))
    by_prefix = prints.groupBy(F.substring(F.sha2("entity_id", 256), 1, 3).alias("prefix")).agg(F.count("*").alias("entities"), F.sum("n").alias("postings"), F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"])
    return by_prefix.agg(F.sum("entities").alias("entities"), F.sum("postings").alias("postings"), F.sha2(F.array_join(digests, ""), 256).alias("sha256"))


#: A stored index has so many folders unless more are asked for.
BUCKETS = 64


def store(postings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write postings (entity_id, doc_id) in folders by the hash of the entity, each sorted, so that a lookup reads little."""
    bucket = F.pmod(F.xxhash64("entity_id"), F.lit(buckets))
    # rows are dealt by range, so a hot entity is spread over files
    ranged = postings.withColumn("bucket", bucket).repartitionByRange("bucket", "entity_id", "doc_id").sortWithinPartitions("bucket", "entity_id", "doc_id")
    ranged.write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark, path: str, entities: list[str], buckets: int = BUCKETS) -> DataFrame:
    """(entity_id, doc_id) of a few entities from a stored index: only their folders are listed, only their row groups read."""
    hashed = F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket")
    wanted = sorted({r["bucket"] for r in spark.createDataFrame([(e,) for e in entities], "id string").select(hashed).collect()})  # as many as asked for
    return spark.read.parquet(path).filter(F.col("bucket").isin(wanted) & F.col("entity_id").isin(list(entities))).select("entity_id", "doc_id")


def lookup_checksum(postings: DataFrame) -> DataFrame:
    """(entities, lookup, scan): sums of count + first + last, and of sum + count, modulo 2^64."""
    each = postings.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("doc_id").alias("s"))
    total = lambda e: F.expr(f"cast(sum(cast({e} as decimal(38,0))) % {_MODULUS} as decimal(20,0))")
    return each.agg(F.count("*").alias("entities"), total("n + lo + hi").cast("long").alias("lookup"), total("n + s").cast("long").alias("scan"))


def totals(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Bytes and characters of plain and tagged text, references, and document-entity pairs."""
    size = docs.agg(F.sum(F.octet_length("plain_text")).alias("plain_bytes"), F.sum(F.octet_length("tagged_text")).alias("tagged_bytes"), F.sum(F.length("tagged_text") - F.length("plain_text")).alias("added_characters"))
    refs = exploded(docs).agg(F.count("*").alias("references"))
    pairs = entity_postings(docs, registry).agg(F.count("*").alias("pairs"))
    return size.crossJoin(refs).crossJoin(pairs)  # one row each


def term_postings(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, doc_id), distinct by construction."""
    return docs.select(F.explode(terms(F.col(text))).alias("term"), "doc_id")


def idf(postings: DataFrame, documents: int | DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln((N + 1) / (df + 1)) + 1; N is given, or the rows of ``documents``, counted in the same job."""
    counts = postings.groupBy("term").agg(F.count("*").alias("df"))
    if isinstance(documents, DataFrame):
        counts = counts.crossJoin(F.broadcast(documents.agg(F.count("*").alias("total"))))  # one row
    else:
        counts = counts.withColumn("total", F.lit(documents))
    return counts.select("term", "df", (F.log((F.col("total") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
