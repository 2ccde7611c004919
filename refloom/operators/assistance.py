"""How much written references help: a deterministic order of annotations, growing shares of them, and the curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .registry import resolve
from .scoring import metrics, ratio, scored

COVERAGES = (0.0, 0.25, 0.5, 0.75, 1.0)


def hashed_order(annotations: DataFrame) -> DataFrame:
    """Annotations (doc_id, pos, start, end, type, key) with ``digest``, the SHA-256 they are ordered by."""
    return annotations.withColumn("digest", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "type", "key"), 256))


def numbered(annotations: DataFrame) -> DataFrame:
    """Hash order as ``n`` from 1, and the number of all: ranks within digest prefixes plus counts of the prefixes before.

    So no single task sorts all annotations; only the 4,096 prefix counts are summed up in one place.
    """
    rows = hashed_order(annotations).withColumn("prefix", F.substring("digest", 1, 3))
    counts = rows.groupBy("prefix").count()
    before = counts.select("prefix", (F.sum("count").over(Window.orderBy("prefix")) - F.col("count")).alias("before"), F.sum("count").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = F.row_number().over(Window.partitionBy("prefix").orderBy("digest", "doc_id", "pos"))
    return rows.withColumn("inside", inside).join(F.broadcast(before), "prefix").withColumn("n", F.col("inside") + F.col("before")).drop("prefix", "inside", "before")


def selected(annotations: DataFrame, coverages=COVERAGES) -> DataFrame:
    """The first share of the annotations for each coverage, halves rounded up: annotations with ``coverage``."""
    levels = F.explode(F.array(*(F.lit(c) for c in coverages))).alias("coverage")
    return numbered(annotations).select("*", levels).filter(F.col("n") <= F.floor(F.col("total") * F.col("coverage") + 0.5)).drop("total", "digest")


def assisted(docs: DataFrame, annotations: DataFrame, predictions: DataFrame, registry: DataFrame, coverages=COVERAGES) -> DataFrame:
    """(coverage, doc_id, predicted, gold): ids of the selected annotations and of predictions that overlap none of them."""
    levels = F.explode(F.array(*(F.lit(c) for c in coverages))).alias("coverage")
    chosen = selected(annotations, coverages)
    kept = predictions.select("*", levels).alias("p").join(chosen.alias("c"), (F.col("p.coverage") == F.col("c.coverage")) & (F.col("p.doc_id") == F.col("c.doc_id")) & (F.col("p.start") < F.col("c.end")) & (F.col("p.end") > F.col("c.start")), "left_anti")
    ids = resolve(kept.select("coverage", "doc_id", "type", "key").unionByName(chosen.select("coverage", "doc_id", "type", "key")), registry)
    found = ids.groupBy("coverage", "doc_id").agg(F.collect_set("canonical_id").alias("predicted"))
    return docs.select("doc_id", "gold", levels).join(found, ["coverage", "doc_id"], "left").withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))


def curve(docs: DataFrame, annotations: DataFrame, predictions: DataFrame, registry: DataFrame, coverages=COVERAGES) -> DataFrame:
    """The metrics at each coverage, in one job."""
    return metrics(scored(assisted(docs, annotations, predictions, registry, coverages)), "coverage")


def deltas(points: DataFrame, digits: int = 6) -> DataFrame:
    """A curve with what precision, recall, F1 and exact documents gain over its smallest coverage, from the unrounded ratios."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rows = points.select("coverage", "exact", p.alias("p"), r.alias("r"), ratio(2 * p * r, p + r).alias("f"))
    base = rows.agg(*(F.min_by(c, "coverage").alias(f"{c}_0") for c in ("p", "r", "f", "exact")))  # one row
    gain = lambda c: F.round(F.col(c) - F.col(f"{c}_0"), digits)
    return rows.crossJoin(F.broadcast(base)).select("coverage", gain("p").alias("precision_delta"), gain("r").alias("recall_delta"), gain("f").alias("f1_delta"), (F.col("exact") - F.col("exact_0")).alias("exact_delta"))
