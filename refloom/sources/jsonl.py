"""JSON Lines and JSON sources and sinks, strict record checks, file digests and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one object a line; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records that have exactly the fields of ``schema``; any other field set, a missing one too, is an error."""
    fields = F.array_sort(F.array(*(F.lit(c) for c in spark.createDataFrame([], schema).columns)))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    good = F.array_sort(F.json_object_keys("value")) == fields
    checked = lines.select(F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("wrong fields in "), F.substring("value", 1, 80)))).alias("value"))
    return checked.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_pinned(spark: SparkSession, path: str, sha256: str, schema: str) -> DataFrame:
    """``read_jsonl`` of a file whose digest is known; another digest is an error."""
    found = [r["sha256"] for r in file_digests(spark, path).select("sha256").take(2)]
    if found != [sha256]:
        raise ValueError(f"{path} has the digest {found}, expected {sha256}")
    return read_jsonl(spark, path, schema)


def json_lines(df: DataFrame) -> DataFrame:
    """Deterministic JSON: fields by name, no blanks, no null fields."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Lines in order over the files of ``path``, part by part; the order is by range, no single task sorts all."""
    json_lines(df.orderBy(*order)).write.mode("overwrite").text(path)


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256, records) of JSON Lines files."""
    lines = F.size(F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: F.trim(x) != ""))
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), lines.alias("records"))
