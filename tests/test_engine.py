"""Reference extraction, linking, scoring and runs on small inline cases."""

import json

import pytest
from pyspark.sql import functions as F

from refloom.functions import grammar, text
from refloom.operators import assistance, linking, registry, retrieval, runs, scoring, vectors
from refloom.sources import jsonl

REGISTRY = [("person", "Hans_Visser", "Hans Visser", "person-0001", 0), ("organisation", "Analyse", "Analyse & Advies", "org-0001", 1), ("project", "Phoenix", "Phoenix", "project-0001", 2), ("system", "Phoenix", "Phoenix", "system-0001", 3)]
SCHEMA = "type string, key string, label string, canonical_id string, ordinal long"


def entries(spark, rows=REGISTRY):
    return spark.createDataFrame(rows, SCHEMA)


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, t, []) for i, t in enumerate(texts)], "doc_id long, plain_text string, tagged_text string, gold array<string>")


def value(spark, column, v):
    return spark.createDataFrame([(v,)], "v string").select(column(F.col("v"))).first()[0]


def test_offsets_count_code_points_and_adjacent_tags_share_no_marker(spark):
    refs = value(spark, grammar.references, "é😀 @@EAT a:b@@ und @@EAT c:d_1@@!")
    assert [(r.type, r.key, r.start, r.end) for r in refs] == [("a", "b", 3, 14), ("c", "d_1", 19, 32)]
    assert len(value(spark, grammar.references, "@@EAT a:b@@EAT c:d@@")) == 1
    assert value(spark, grammar.references, "nothing") == []


@pytest.mark.parametrize("given, code", [("@@EAT a:b@@", "valid"), ("@EAT a:b@@", "incomplete_opening_marker"), ("@@EAT a:b", "missing_closing_marker"), ("@@EAT ab@@", "missing_separator"), ("@@EAT :b@@", "missing_type"), ("@@EAT a:@@", "missing_key"), ("@@EAT a:b:c@@", "invalid_identifier"), ("@@EAT a:b@@\n", "missing_closing_marker")])
def test_validation_codes(spark, given, code):
    assert value(spark, grammar.validation_code, given) == code


def test_diagnosis_accepts_references_inside_sentences(spark):
    assert value(spark, grammar.diagnosis, "See @@EAT document:X@@ for more.") == "valid"
    assert value(spark, grammar.validation_code, "See @@EAT document:X@@ for more.") == "incomplete_opening_marker"
    assert value(spark, grammar.diagnosis, "See @@EAT document:X@@") == "incomplete_opening_marker"
    assert value(spark, grammar.diagnosis, "plain") == "invalid_reference"


def test_rendering_rejects_overlaps(spark):
    rows = spark.sql("select 'ab cd' as t, array(named_struct('start', 3, 'end', 5, 'type', 'x', 'key', 'c'), named_struct('start', 0, 'end', 2, 'type', 'x', 'key', 'a')) as s")
    assert rows.select(grammar.rendered(F.col("t"), F.col("s"))).first()[0] == "@@EAT x:a@@ @@EAT x:c@@"
    bad = spark.sql("select 'ab cd' as t, array(named_struct('start', 0, 'end', 3, 'type', 'x', 'key', 'c'), named_struct('start', 2, 'end', 4, 'type', 'x', 'key', 'a')) as s")
    with pytest.raises(Exception, match="overlaps"):
        bad.select(grammar.rendered(F.col("t"), F.col("s"))).collect()


def test_text_functions(spark):
    assert value(spark, text.fold, "STRAßE") == "strasse"
    assert value(spark, text.title, "\n  \n One \nTwo") == "One"
    assert [value(spark, text.surface, s).offset for s in ("the University of Southampton", "Atlas", "  Atlas ")] == [4, 0, 2]
    assert value(spark, text.estimated_tokens, " a  b\tc ") == 3
    assert [value(spark, text.is_uri, s) for s in ("https://x.org", "https:///y", "urn:a", "x")] == [True, False, True, False]
    one = spark.sql("select array(0D, 0D) as a, array(1D, 2D) as b")
    assert one.select(text.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_last_typed_key_wins_but_labels_keep_repetitions(spark):
    r = entries(spark, [*REGISTRY, ("system", "Phoenix", "Phoenix", "system-0002", 4)])
    assert registry.typed_keys(r).filter("type = 'system'").first().canonical_id == "system-0002"
    assert registry.candidates(r).filter("label = 'phoenix'").first().n == 3


def link(spark, *texts, rows=REGISTRY):
    return sorted((r.doc_id, r.start, r.end, r.type, r.key, r.candidate_count) for r in linking.link(docs(spark, *texts), entries(spark, rows)).collect())


def test_cues_decide_and_their_absence_abstains(spark):
    got = link(spark, "They mentioned Phoenix today.", "The Phoenix project shipped.", "project Phoenix versus system Phoenix", "Hans Visser works on Phoenix.")
    assert got == [(0, 15, 22, None, None, 2), (1, 4, 11, "project", "Phoenix", 2), (2, 8, 15, "project", "Phoenix", 2), (2, 30, 37, "system", "Phoenix", 2), (3, 0, 11, "person", "Hans_Visser", 1), (3, 21, 28, None, None, 2)]


def test_whole_words_and_longest_labels(spark):
    rows = [("place", "York", "York", "1", 0), ("place", "New_York", "New York", "2", 1), ("topic", "art", "art", "3", 2), ("mark", "Q", "C++ (x)", "4", 3)]
    assert link(spark, "New York borders York.", "This article is about art.", "I like c++ (X)!", rows=rows) == [(0, 0, 8, "place", "New_York", 1), (0, 17, 21, "place", "York", 1), (1, 22, 25, "topic", "art", 1), (2, 7, 14, "mark", "Q", 1)]
    assert {r.label: r.occurrences for r in linking.plain_matches(docs(spark, "article art"), entries(spark, rows)).collect()} == {"art": 2}


def test_conditions(spark):
    assert linking.conditions()[:3] == ["plain", "linker", "tagged"]
    with pytest.raises(ValueError):
        linking.register("plain", linking.plain)
    d = docs(spark, "Hans Visser works on Phoenix.").withColumn("gold", F.array(F.lit("person-0001"), F.lit("x")))
    row = linking.linker(d, entries(spark)).first()
    assert (row.predicted, row.open, row.registry_lookups, row.label_scans) == (["person-0001"], 1, 3, 3)
    s = scoring.scored(linking.linker(d, entries(spark))).first()
    assert (s.tp, s.fp, s.fn) == (1, 0, 1)
    seen = []
    linking.external("m", lambda x: seen.append(x.columns) or x.select("doc_id", F.lit("Hans").alias("label"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("person").alias("type"), F.lit("Hans_Visser").alias("key")))(d, entries(spark)).collect()
    assert seen == [["doc_id", "plain_text"]]


def test_metrics_of_nothing_are_zero(spark):
    rows = spark.createDataFrame([("c", [], [])], "condition string, predicted array<string>, gold array<string>")
    assert scoring.metrics(scoring.scored(rows)).first().f1 == 0.0


def test_hash_order_takes_halves_up(spark):
    rows = spark.range(669).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("a").alias("type"), F.lit("b").alias("key"))
    got = {r.coverage: r["count"] for r in assistance.selected(rows).groupBy("coverage").count().collect()}
    assert got == {0.25: 167, 0.5: 335, 0.75: 502, 1.0: 669}


def test_routes(spark):
    postings = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 3)], "term string, doc_id long")
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "term string, idf double")
    q = spark.createDataFrame([("q", "e", "L", "a b")], "question_id string, entity_id string, label string, question string")
    e = spark.createDataFrame([("e", 3), ("e", 2)], "entity_id string, doc_id long")
    order = lambda df: [(r.doc_id, r.score) for r in df.orderBy("rank").collect()]
    assert order(retrieval.lexical(q, postings, weights)) == [(1, 3.0), (2, 1.0)]
    assert order(retrieval.filtered(q, postings, weights, e)) == [(2, 1.0), (3, 0.0)]
    assert order(retrieval.hybrid(q, postings, weights, e)) == [(2, 5.0), (3, 4.0), (1, 3.0)]
    labels = spark.createDataFrame([("l", ["e", "f"])], "label string, ids array<string>")
    assert order(retrieval.inferred(q, labels, postings, weights, e)) == [(1, 3.0), (2, 1.0)]
    m = retrieval.quality(retrieval.lexical(q, postings, weights), q, e).first()
    assert (m.hit_1, m.hit_5, m.precision_k, m.mrr_k) == (0.0, 1.0, 0.1, 0.5)


def test_runs(spark):
    d, r = docs(spark, "Hans Visser works"), entries(spark)
    cases = spark.createDataFrame([(0, 1, 1), (9, 1, -1)], "doc_id long, model_calls long, estimated_tokens long")
    rows = [(0, 0, "hans visser", 0, 11, "person", "Hans_Visser"), (0, 1, "x", 0, 99, "per-son", "Nobody"), (0, 2, "hans visser", 0, 11, "person", "Hans_Visser"), (0, 3, "y", 5, 5, "person", "Hans_Visser")]
    mentions = spark.createDataFrame(rows, "doc_id long, idx int, label string, start int, end int, type string, key string")
    found = {(x.location, x.message) for x in runs.violations(cases, mentions, d, r).collect()}
    c = "$.cases[0].mentions"
    assert found == {("$.cases[9]", "unknown case"), ("$.cases[9]", "estimated_tokens: expected a non-negative integer"), (f"{c}[1]", "type: invalid identifier"), (f"{c}[1]", "span exceeds plain_text"), (f"{c}[1]", "unknown typed key"), (f"{c}[2]", "duplicate mention prediction"), (f"{c}[3]", "end must be greater than start")}
    raw = json.dumps({"schema_version": "1.0", "odd": 1, "runner": {"parameters": {"a": {"Gold_IDs": []}}}, "cases": [{"id": "a", "cost": {"x": 1}, "mentions": [{"label": "a", "z": 1}]}]})
    assert {x.message for x in runs.field_violations(spark.createDataFrame([(raw,)], "raw string")).collect()} == {"unknown field odd", "unknown field x", "unknown field z", "forbidden field gold_ids"}
    header = spark.createDataFrame([("2.0", "plain_text", "d", "0" * 64, "F" * 64, "m", "1", "https:///y", "urn:x", "abc", "run")], "schema_version string, input string, dataset_name string, dataset_sha256 string, registry_sha256 string, model_name string, model_version string, model_source string, runner_source string, runner_commit string, runner_command string")
    assert {x.location for x in runs.header_violations(header, "d", "1" * 64, "0" * 64).collect()} == {"$.schema_version", "$.dataset.dataset_sha256", "$.dataset.registry_sha256", "$.model_source", "$.runner.commit"}


def test_ngrams_and_modes(spark):
    got = vectors.char_ngrams(spark.createDataFrame([("k", "Ab c")], "k string, t string"), "k", "t").collect()
    assert {(r.gram, r.n) for r in got} == {(" ab", 1), ("ab ", 1), (" ab ", 1), (" c ", 1)}
    names = spark.createDataFrame([("q", "b"), ("q", "A"), ("q", "a")], "id string, name string")
    assert scoring.modal_names(names).first().name == "A"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "plain_text": "é"}\n\n{"id": "2", "plain_text": "x", "gold": 1}\n')
    with pytest.raises(Exception, match="wrong fields"):
        jsonl.read_strict(spark, str(tmp_path / "a.jsonl"), "id string, plain_text string").collect()
    assert jsonl.manifest(spark, [str(tmp_path / "a.jsonl")]).first().records == 2
    with pytest.raises(ValueError):
        jsonl.read_pinned(spark, str(tmp_path / "a.jsonl"), "0" * 64, "id string")
    df = spark.createDataFrame([("b", None), ("a", 1)], "z string, a int")
    jsonl.write_jsonl(df, str(tmp_path / "out"), ["z"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()].count('{"a":1,"z":"a"}') == 1


def test_entry_imports():
    import __spark_entry__ as e

    assert "entity_index" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
