"""Candidate ranking by character n-gram TF-IDF and by cosine of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine

NGRAMS = (3, 5)


def char_ngrams(rows: DataFrame, key: str, text: str, low: int = NGRAMS[0], high: int = NGRAMS[1]) -> DataFrame:
    """(key, gram, n): counts of the n-grams of each word padded by one blank on either side; a padded word no longer than n is one gram, once."""
    words = F.expr(f"filter(split(lower({text}), '(?U)\\\\s+'), w -> w <> '')")
    grams = f"transform(w, x -> concat(' ', x, ' '))"
    each = f"flatten(transform({grams}, p -> flatten(transform(sequence({low}, {high}), n -> if(length(p) <= n, if(n = greatest({low}, length(p)), array(p), array()), transform(sequence(1, length(p) - n + 1), i -> substring(p, i, n)))))))"
    return rows.select(key, words.alias("w")).select(key, F.explode(F.expr(each)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("n"))


def frequencies(grams: DataFrame, documents: DataFrame) -> DataFrame:
    """(gram, df, documents): how many keys have a gram, and the number of rows of ``documents``."""
    total = documents.agg(F.count("*").alias("documents"))  # one row
    return grams.groupBy("gram").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))


def tfidf(grams: DataFrame, key: str, frequencies: DataFrame) -> DataFrame:
    """(key, gram, weight): (1 + ln tf) * (ln((N + 1) / (df + 1)) + 1), each key of length one; grams without a frequency do not count."""
    raw = grams.join(frequencies, "gram").withColumn("w", (1.0 + F.log(F.col("n").cast("double"))) * (F.log((F.col("documents") + 1.0) / (F.col("df") + 1.0)) + 1.0))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "gram", (F.col("w") / norm).alias("weight"))


def dot(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, score) of the candidate pairs only; pairs without a common gram score 0."""
    hits = pairs.join(left.withColumnRenamed("weight", "x"), a).join(right.withColumnRenamed("weight", "y"), [b, "gram"])
    sums = hits.groupBy(a, b).agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    return pairs.join(sums, [a, b], "left").select(a, b, F.coalesce("score", F.lit(0.0)).alias("score"))


def best(scores: DataFrame, by: str, candidate: str) -> DataFrame:
    """(by, candidate, score): the best candidate, ties to the smaller one."""
    return scores.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(candidate).alias("c"))).alias("m")).select(by, F.col("m.c").alias(candidate), (-F.col("m.s")).alias("score"))


def cosine_scores(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return pairs.withColumn("score", cosine(F.col(a), F.col(b)))
