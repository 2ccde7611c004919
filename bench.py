"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from refloom.plans import catalog, workload

HEADLINE = [
    "entity_index", "ref_offsets", "index_fingerprint", "plain_label_match", "gazetteer_link", "micro_metrics", "assist_curve",
    "idf_table", "lexical_topk", "tag_filtered_topk", "inferred_topk", "hybrid_topk", "retrieval_metrics", "vector_cosine_argmax",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # the corpora are given: they are made and held before the clock starts
    for corpus in (workload.order_docs(spark, sf_dir), workload.registry(spark, sf_dir)):
        corpus.persist().count()
    catalog.QUERIES["ref_extract"](spark, sf_dir).count()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
