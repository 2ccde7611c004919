"""Model-backed linkers, run assembly, stored indexes and summaries on small inline cases."""

import json
import math
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from refloom.operators import assistance, checks, index, models, retrieval, runs

REGISTRY = [("city", "Paris", "Paris", "c1", 0), ("person", "Paris_H", "Paris", "p1", 1), ("city", "Lyon", "Lyon", "c2", 2)]
TRAINING = [(10, "The mayor of Paris opened a bridge"), (11, "The actress Paris sang a song"), (12, "City of Light is a bridge town")]
KNOWN = [(10, 13, 18, "c1"), (11, 12, 17, "p1"), (12, 0, 13, "c1")]
DOCS = [(1, "A bridge in Paris"), (2, "The song of PARIS and Lyon"), (3, "City of light"), (4, "nothing here"), (5, ""), (6, None), (7, "Parisian")]


def _tables(spark):
    registry = spark.createDataFrame(REGISTRY, "type string, key string, label string, canonical_id string, ordinal long")
    texts = "doc_id long, plain_text string"
    return spark.createDataFrame(DOCS, texts), registry, spark.createDataFrame(KNOWN, "doc_id long, start int, end int, canonical_id string"), spark.createDataFrame(TRAINING, texts)


def _grams(text):
    out = Counter()
    for word in text.lower().split():
        p = f" {word} "
        for n in (3, 4, 5):
            if len(p) > n:
                out.update(p[i : i + n] for i in range(len(p) - n + 1))
            elif n == max(3, len(p)):
                out[p] += 1
    return out


def _brute(context, ids):
    profiles = {r[3]: r[2] for r in REGISTRY}
    texts = dict(TRAINING)
    for doc, _, _, entity in KNOWN:
        profiles[entity] += " \n " + texts[doc]
    grams = {k: _grams(v) for k, v in profiles.items()}
    df = Counter(g for c in grams.values() for g in c)

    def unit(c):
        raw = {g: (1 + math.log(n)) * (math.log((len(profiles) + 1) / (df[g] + 1)) + 1) for g, n in c.items() if g in df}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {g: v / size for g, v in raw.items()}

    q = unit(_grams(context))
    return min(ids, key=lambda k: (-round(sum(q.get(g, 0) * v for g, v in unit(grams[k]).items()), 9), k))


def test_tfidf_linker_equals_brute_force(spark):
    by_id = {r[3]: r[:2] for r in REGISTRY}
    got = {(r.doc_id, r.label, r.start, r.end): (r.type, r.key) for r in models.tfidf_linker(*_tables(spark)).collect()}
    texts = dict(DOCS)
    assert got == {
        (1, "Paris", 12, 17): by_id[_brute(texts[1], ["c1", "p1"])],
        (2, "PARIS", 12, 17): by_id[_brute(texts[2], ["c1", "p1"])],
        (2, "Lyon", 22, 26): ("city", "Lyon"),
        (3, "City of light", 0, 13): ("city", "Paris"),
    }
    assert got[(1, "Paris", 12, 17)] == ("city", "Paris") and got[(2, "PARIS", 12, 17)] == ("person", "Paris_H")


def test_vector_linker_takes_spans_without_their_article(spark):
    docs, registry, known, training = _tables(spark)
    docs = docs.union(spark.createDataFrame([(8, "the Paris bridge"), (9, "the song Paris")], docs.schema))
    spans = spark.createDataFrame([(8, 0, 9), (9, 9, 14), (4, 0, 7), (8, 0, 3)], "doc_id long, start int, end int")
    embed = lambda t: t.select("id", F.array(F.col("text").contains("bridge").cast("double"), F.col("text").contains("song").cast("double")))
    got = {(r.doc_id, r.label, r.start, r.end, r.key) for r in models.vector_linker(docs, spans, registry, known, training, embed).collect()}
    assert got == {(8, "Paris", 4, 9, "Paris"), (9, "Paris", 9, 14, "Paris_H")}


def test_unknown_training_entities_are_an_error(spark):
    _, registry, known, training = _tables(spark)
    odd = known.withColumn("canonical_id", F.lit("nobody"))
    with pytest.raises(PySparkException, match="unknown entity: nobody"):
        models.trained(odd, training, registry).collect()  # in a longer plan several stages may fail at once


def test_a_run_is_assembled_and_read_back(spark, tmp_path):
    docs, registry, known, training = _tables(spark)
    linked = models.tfidf_linker(docs, registry, known, training)
    lines = runs.case_lines(models.costs(docs, linked), linked)
    header = {"schema_version": "1.0", "dataset": {}, "input": "plain_text", "model": {}, "runner": {"commit": "0123abc"}}
    path = tmp_path / "run.json"
    runs.write_run(str(path), header, lines)
    run = json.loads(path.read_text())
    assert [c["id"] for c in run["cases"]] == [str(i) for i, _ in DOCS] and run["input"] == "plain_text"
    assert run["cases"][1]["cost"] == {"estimated_tokens": 6, "model_calls": 1} and [m["start"] for m in run["cases"][1]["mentions"]] == [12, 22]
    assert run["cases"][4]["mentions"] == [] and run["cases"][4]["cost"]["model_calls"] == 0
    raw = spark.createDataFrame([(path.read_text(),), ("{",), ("[]",), (None,)], "raw string")
    wrong = runs.document_violations(raw)
    assert sorted(r.message for r in wrong.collect()) == ["expected an object", "not JSON", "not JSON"]
    assert runs.field_violations(raw.limit(1)).collect() == []
    assert runs.exit_code(wrong) == 2 and runs.exit_code(wrong.limit(0)) == 0
    for bad in (header | {"more": 1}, {k: header[k] for k in ("input", "runner")}, header | {"runner": {"commit": "xyz"}}):
        with pytest.raises(ValueError):
            runs.write_run(str(path), bad, lines)


def test_stored_index_reads_only_the_folders_asked_for(spark, tmp_path):
    postings = spark.createDataFrame([(f"e{i % 7}", i) for i in range(70)], "entity_id string, doc_id long")
    path = f"file://{tmp_path}/index"
    index.store(postings, path, 16)
    got = index.lookup(spark, path, ["e3", "none"], 16)
    assert sorted(r.doc_id for r in got.collect()) == list(range(3, 70, 7))
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_digest_of_an_index_changes_with_any_posting(spark):
    rows = [(f"e{i % 7}", i) for i in range(70)]
    digest = lambda r: index.index_digest(index.fingerprint(spark.createDataFrame(r, "entity_id string, doc_id long"))).first()
    assert digest(rows) == digest(rows[::-1]) and digest(rows)["entities"] == 7 and digest(rows)["postings"] == 70
    assert digest(rows)["sha256"] != digest(rows[:-1] + [("e6", 70)])["sha256"]


def test_sources_that_cannot_be_used_are_named(spark):
    registry = spark.createDataFrame(REGISTRY, "type string, key string, label string, canonical_id string, ordinal long")
    docs = spark.createDataFrame([(1, "@@EAT city:Lyon@@", ["c2"]), (2, "@@EAT city:Rome@@", []), (3, "none", ["c2"]), (4, "none", []), (4, "none", [])], "doc_id long, tagged_text string, gold array<string>")
    got = {(r.doc_id, r.message) for r in checks.source_rules(docs, registry).collect()}
    assert got == {(2, "a reference resolves to nothing"), (3, "references and gold differ"), (4, "repeated document")}
    assert [tuple(r) for r in checks.source_rules(docs.limit(0), registry).collect()] == [(None, "no documents")]


def test_summaries(spark):
    known = spark.createDataFrame([("q1", "a", "x", "unique", "a"), ("q2", "b", "y", "unique", "c"), ("q3", "d", "Z", "ambiguous", None), ("q4", "e", "z", "ambiguous", None), ("q5", "f", "w", "unresolved", None)], "question_id string, entity_id string, label string, status string, inferred string")
    assert retrieval.inference_summary(known).first().asDict() == {"questions": 5, "fallbacks": 3, "accuracy": 0.5, "ambiguous_labels": 1}
    assert retrieval.inference_summary(known.limit(0)).first()["accuracy"] is None
    curve = spark.createDataFrame([(0.0, 2, 0, 2, 1), (1.0, 4, 0, 0, 3)], "coverage double, tp long, fp long, fn long, exact long")
    last = [r for r in assistance.deltas(curve).collect() if r.coverage == 1.0][0]
    assert (last.precision_delta, last.recall_delta, last.f1_delta, last.exact_delta) == (0.0, 0.5, 0.333333, 2)


def test_versions_are_guarded():
    models.require_versions({})
    with pytest.raises(RuntimeError):
        models.require_versions({"numpy": "0.0"})
