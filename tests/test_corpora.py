"""Corpus checks, folding, results and generated corpora on small inline cases."""

import json

import pytest
from pyspark.sql import functions as F

from refloom.functions import text
from refloom.operators import checks, linking, passages, runs
from refloom.sources import results


def test_folding_equals_full_case_folding(spark):
    odd = ["STRASSE ß ẞ", "ΟΔΟΣ ος", "ſt ŉ ﬁ ﬀ", "İstanbul", "ılık I", "µ ϑ ΰ", "Ǆ ǅ"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in odd], "v string").select(text.fold(F.col("v"))).collect()]
    assert got == [x.casefold() for x in odd]


def test_labels_without_words_and_far_into_a_text(spark):
    registry = spark.createDataFrame([("m", "P", "++", "1", 0), ("m", "Q", "Far Away", "2", 1), ("m", "R", "z", "3", 2)], "type string, key string, label string, canonical_id string, ordinal long")
    docs = spark.createDataFrame([(1, "a ++ b"), (2, "x " * 5000 + "FAR away"), (3, ""), (4, None)], "doc_id long, plain_text string")
    got = {(r.doc_id, r.label, r.start, r.end) for r in linking.mentions(docs, linking.label_kinds(registry).select("label")).collect()}
    assert got == {(1, "++", 2, 4), (2, "far away", 10_000, 10_008)}
    assert {(r.doc_id, r.label, r.canonical_id) for r in linking.plain_matches(docs, registry).collect()} == {(1, "++", "1"), (2, "far away", "2")}


def test_checks_name_what_is_wrong(spark):
    cases = spark.createDataFrame([("a", "@@EAT x:y@@", True, "valid"), ("b", "@@EAT xy@@", False, "missing_key"), ("c", "@@EAT :y@@", True, "missing_type")], "id string, input string, valid boolean, result string")
    assert {(r.id, r.got) for r in checks.conformance(cases).collect()} == {("b", "missing_separator"), ("c", "missing_type")}
    a = spark.createDataFrame([(1, "t", ["x", "y"]), (2, "t", ["x"]), (3, "t", ["x"])], "doc_id long, plain_text string, gold array<string>")
    b = spark.createDataFrame([(1, "t", ["y", "x"]), (2, "u", ["z"]), (2, "u", ["z"]), (4, "t", ["x"])], a.schema)
    assert {(r.doc_id, r.message) for r in checks.reconciled(a, b).collect()} == {(2, "text differs"), (2, "gold differs"), (2, "repeated case"), (3, "missing case"), (4, "unknown case")}


def test_forbidden_names_are_found_escaped_and_not_in_values(spark):
    escaped = '{"runner": {"parameters": {"a": [{"gold\\u005fids": 1}]}}}'
    value = json.dumps({"runner": {"parameters": {"a": 'says "gold_ids": 1'}}})
    found = lambda raw: [r.message for r in runs.field_violations(spark.createDataFrame([(raw,)], "raw string")).collect() if "forbidden" in r.message]
    assert found(escaped) == ["forbidden field gold_ids"] and found(value) == []


def test_generated_documents_repeat_their_sources(spark):
    sources = spark.createDataFrame([(k,) for k in (30, 10, 20)], "k long").repartition(3)
    got = {r.generated_id: r.k for r in passages.generated(sources, "k", 7).collect()}
    assert got == {i: (10, 20, 30)[i % 3] for i in range(7)}


def test_results_are_written_for_people_and_programs(spark, tmp_path):
    summary = spark.createDataFrame([("a|b", 0.5)], "condition string, f1 double")
    results.write_result(str(tmp_path), "r", summary, {"dataset": "d"}, summary)
    assert json.loads((tmp_path / "r.json").read_text())["results"] == [{"condition": "a|b", "f1": 0.5}]
    assert "| a\\|b | 0.5 |" in (tmp_path / "r.md").read_text() and spark.read.parquet(str(tmp_path / "r.parquet")).count() == 1
    with pytest.raises(ValueError):
        results.write_result(str(tmp_path), "x", spark.range(results.MOST_ROWS + 1).toDF("x"), {})
