"""Corpora derived from the plain tables: a registry, tagged order sentences, questions, malformed values."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grammar import tag


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_turn(spark: SparkSession, parts: list[Callable[[], DataFrame]]) -> DataFrame:
    """The union of small results, each computed at once and before the next: the disk that one's shuffles took is given back."""
    out = None
    for part in parts:
        df = part()
        rows, schema = df.collect(), df.schema
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffle files go when the driver's JVM finds that nothing uses them
        got = spark.createDataFrame(rows, schema)
        out = got if out is None else out.unionByName(got)
    return out


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Nations, regions, brands, customers, and parts, whose names are ambiguous."""
    def rows(df, kind, key, label, number):
        return df.select(F.lit(kind).alias("type"), F.expr(key).alias("key"), F.expr(label).alias("label"), F.expr(f"concat('{kind}-', {number})").alias("canonical_id"))

    out = rows(table(spark, d, "nation"), "nation", "n_name", "n_name", "n_nationkey")
    out = out.union(rows(table(spark, d, "region"), "region", "r_name", "r_name", "r_regionkey"))
    out = out.union(rows(table(spark, d, "part").select("p_brand").distinct(), "brand", "replace(p_brand, '#', '_')", "p_brand", "replace(p_brand, '#', '_')"))
    out = out.union(rows(table(spark, d, "part"), "part", "concat('P_', p_partkey)", "p_name", "p_partkey"))
    out = out.union(rows(table(spark, d, "customer"), "customer", "replace(c_name, '#', '_')", "c_name", "c_custkey"))
    return out.withColumn("ordinal", F.xxhash64("canonical_id"))  # keys are unique here, so any order will do


def order_docs(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, plain_text, tagged_text, gold): a sentence per order with items, about its customer, nation and first part."""
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("p_partkey"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(first, "o_orderkey").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "part"), "p_partkey")
    c, n, p, b = (F.lit(x) for x in ("customer", "nation", "part", "brand"))
    tags = tag(c, F.replace("c_name", F.lit("#"), F.lit("_"))), tag(n, F.col("n_name")), tag(p, F.concat(F.lit("P_"), "p_partkey")), tag(b, F.replace("p_brand", F.lit("#"), F.lit("_")))
    plain = F.concat("c_name", F.lit(" from "), "n_name", F.lit(" ordered "), "p_name", F.lit(" of "), "p_brand", F.lit("."))
    marked = F.concat(tags[0], F.lit(" from "), tags[1], F.lit(" ordered "), tags[2], F.lit(" of "), tags[3], F.lit("."))
    gold = F.array(F.concat(F.lit("customer-"), "c_custkey"), F.concat(F.lit("nation-"), "n_nationkey"), F.concat(F.lit("part-"), "p_partkey"), F.concat(F.lit("brand-"), F.replace("p_brand", F.lit("#"), F.lit("_"))))
    return rows.select(F.col("o_orderkey").alias("doc_id"), plain.alias("plain_text"), marked.alias("tagged_text"), gold.alias("gold"), "c_name", "n_name", "p_name", "p_brand", "p_partkey")


def malformed(docs: DataFrame) -> DataFrame:
    """(doc_id, value): one reference, whole or broken in one of six ways."""
    good = tag(F.lit("nation"), F.col("n_name"))
    k = F.pmod("doc_id", F.lit(7))
    value = F.when(k == 0, good).when(k == 1, F.substring(good, 2, F.length(good))).when(k == 2, F.substring(good, 1, F.length(good) - 1)).when(k == 3, F.replace(good, F.lit(":"), F.lit(" "))).when(k == 4, F.replace(good, F.lit("nation:"), F.lit(":"))).when(k == 5, F.lit("@@EAT nation:@@")).otherwise(F.replace(good, F.lit("nation:"), F.lit("na-tion:")))
    return docs.select("doc_id", value.alias("value"), F.concat(F.lit("See "), value, F.lit(" today.")).alias("sentence"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, label, start, end, type, key): where the four entities stand in the plain sentence."""
    c, n, p, b = (F.length(x) for x in ("c_name", "n_name", "p_name", "p_brand"))
    s = [F.lit(0), c + 6, c + 6 + n + 9, c + 6 + n + 9 + p + 4]
    under = lambda x: F.replace(x, F.lit("#"), F.lit("_"))
    rows = [(s[0], c, "c_name", "customer", under("c_name")), (s[1], n, "n_name", "nation", F.col("n_name")), (s[2], p, "p_name", "part", F.concat(F.lit("P_"), "p_partkey")), (s[3], b, "p_brand", "brand", under("p_brand"))]
    items = F.array(*(F.struct(F.col(l).alias("label"), st.alias("start"), (st + ln).alias("end"), F.lit(t).alias("type"), k.alias("key")) for st, ln, l, t, k in rows))
    return docs.select("doc_id", F.posexplode(items).alias("pos", "s")).select("doc_id", "pos", "s.*")


def cue_docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(docs, registry): supplier sentences about nation names that are markets as well, with and without a cue."""
    nations = table(spark, d, "nation")
    two = nations.select(F.lit("nation").alias("type"), F.col("n_name").alias("key"), F.col("n_name").alias("label"), F.concat(F.lit("nation-"), "n_nationkey").alias("canonical_id"), F.col("n_nationkey").cast("long").alias("ordinal"))
    two = two.union(nations.select(F.lit("market"), F.concat(F.lit("M_"), "n_name"), "n_name", F.concat(F.lit("market-"), "n_nationkey"), F.col("n_nationkey") + 1000))
    rows = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.pmod("s_suppkey", F.lit(4))
    text = F.when(k == 0, F.concat(F.lit("They mentioned "), "n_name", F.lit(" today."))).when(k == 1, F.concat(F.lit("The nation "), "n_name", F.lit(" grew."))).when(k == 2, F.concat(F.lit("The "), "n_name", F.lit(" market grew."))).otherwise(F.concat(F.lit("A nation, "), "n_name", F.lit(", market open.")))
    return rows.select(F.col("s_suppkey").alias("doc_id"), text.alias("plain_text")), two


def questions(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, entity_id, label, question): for each source, the opening of its first document."""
    docs = table(spark, d, "documents")
    rows = docs.groupBy("source").agg(F.min_by("text", "doc_id").alias("text"))
    number = F.regexp_extract("source", "([0-9]+)", 1).cast("int")
    return rows.select(F.col("source").alias("question_id"), F.col("source").alias("entity_id"), F.concat(F.lit("Group "), F.when(number < 6, F.pmod(number, F.lit(3))).otherwise(number)).alias("label"), F.substring("text", 1, 120).alias("question"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    """The registry of sources; the first six share three labels."""
    q = questions(spark, d)
    return q.select(F.lit("source").alias("type"), F.col("entity_id").alias("key"), "label", F.col("entity_id").alias("canonical_id"), F.lit(0).alias("ordinal"))


def recorded(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, mentions) of a simulated model: spans of order sentences without those whose key hashes to a multiple of 4."""
    mentions = spans(docs).filter("ascii(substring(md5(concat(doc_id, '|', pos)), 1, 1)) % 4 <> 0").withColumn("idx", F.col("pos"))
    cases = docs.select("doc_id", F.lit(1).cast("long").alias("model_calls"), F.length("plain_text").cast("long").alias("estimated_tokens"))
    return cases, mentions.select("doc_id", "idx", "label", "start", "end", "type", "key")
