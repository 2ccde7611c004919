"""Recorded predictions of a model: validation that lists every violation, and replay.

A run has a header (one row) and mentions (doc_id, idx, label, start, end, type, key) of cases (doc_id, model_calls,
estimated_tokens). A run is valid if ``violations`` has no rows.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grammar import IDENTIFIER
from ..functions.text import fold, is_commit, is_sha256, is_uri
from .registry import typed_keys

# The run format.
SCHEMA_VERSION, INPUT = "1.0", "plain_text"
FIELDS = {
    "$": ["schema_version", "dataset", "input", "model", "runner", "cases"],
    "$.dataset": ["name", "sha256", "registry_sha256"],
    "$.model": ["name", "version", "source"],
    "$.runner": ["source", "commit", "command", "parameters"],
    "$.cases[*]": ["id", "mentions", "cost"],
    "$.cases[*].cost": ["model_calls", "estimated_tokens"],
    "$.cases[*].mentions[*]": ["label", "start", "end", "type", "key"],
}
FORBIDDEN = ["eat_text", "gold_ids"]


def _rows(df: DataFrame, wrong: Column, location: Column, message: Column | str) -> DataFrame:
    return df.filter(F.coalesce(wrong, F.lit(True))).select(location.alias("location"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def header_violations(header: DataFrame, dataset: str, dataset_sha256: str, registry_sha256: str) -> DataFrame:
    """Violations of a header with columns named like schema_version, input, dataset_name, dataset_sha256, model_source, ..."""
    at = F.lit
    rules = [_rows(header, F.coalesce(F.trim(c), F.lit("")) == "", at(f"$.{c}"), "expected a non-empty string") for c in ("schema_version", "input", "dataset_name", "dataset_sha256", "registry_sha256", "model_name", "model_version", "model_source", "runner_source", "runner_commit", "runner_command")]
    rules += [
        _rows(header, F.col("schema_version") != SCHEMA_VERSION, at("$.schema_version"), f"expected {SCHEMA_VERSION}"),
        _rows(header, F.col("input") != INPUT, at("$.input"), f"expected {INPUT}"),
        _rows(header, F.col("dataset_name") != dataset, at("$.dataset.name"), f"expected {dataset}"),
        *(_rows(header, ~is_sha256(F.col(c)), at(f"$.dataset.{c}"), "expected lowercase SHA-256") for c in ("dataset_sha256", "registry_sha256")),
        *(_rows(header, is_sha256(F.col(c)) & (F.col(c) != want), at(f"$.dataset.{c}"), "hash does not match") for c, want in (("dataset_sha256", dataset_sha256), ("registry_sha256", registry_sha256))),
        *(_rows(header, ~is_uri(F.col(c)), at(f"$.{c}"), "expected an absolute URI") for c in ("model_source", "runner_source")),
        _rows(header, ~is_commit(F.col("runner_commit")), at("$.runner.commit"), "expected a 7 to 40 character commit SHA"),
    ]
    return reduce(DataFrame.unionByName, rules)


def document_violations(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """(location, message), with all columns of ``documents``, of texts that are not JSON or not an object, null ones too."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(raw)))
    message = F.when(kind.isNull(), "not JSON").when(~kind.startswith("OBJECT"), "expected an object")
    return documents.select("*", F.lit("$").alias("location"), message.alias("message")).filter("message is not null")


def exit_code(violations: DataFrame) -> int:
    """0 for a valid run and 2 for one with violations, for callers on a command line."""
    return 0 if violations.isEmpty() else 2


def case_lines(cases: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, value): the JSON object of each case (doc_id, model_calls, estimated_tokens), fields by name, with its mentions
    in order."""
    item = F.struct("end", "key", "label", "start", "type")
    listed = mentions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", F.col("end").alias("to"), item.alias("m")))).alias("all"))
    kind = "array<struct<end:int,key:string,label:string,start:int,type:string>>"
    rows = cases.join(listed, "doc_id", "left")
    found = F.coalesce(F.col("all")["m"].cast(kind), F.array().cast(kind))
    case = F.struct(F.struct("estimated_tokens", "model_calls").alias("cost"), F.col("doc_id").cast("string").alias("id"), found.alias("mentions"))
    return rows.select("doc_id", F.to_json(case).alias("value"))


def write_run(path: str, header: dict, lines: DataFrame) -> None:
    """Write a run as one JSON document: the fields of ``header`` and the cases by doc_id, which pass the driver one by one.

    The header must have every field of the format but the cases, and a full commit; else nothing is written.
    """
    missing = set(FIELDS["$"]) - {"cases"} - set(header)
    if missing or set(header) - set(FIELDS["$"]):
        raise ValueError(f"the header lacks {sorted(missing)}, or has fields that the format does not have")
    if not re.fullmatch(r"[0-9a-f]{7,40}", header["runner"]["commit"]):
        raise ValueError("the commit of the runner is 7 to 40 lower-case hex digits")
    with Path(path).open("w", encoding="utf-8") as out:
        out.write('{"cases":[')
        for i, row in enumerate(lines.orderBy("doc_id").toLocalIterator()):
            out.write((",\n" if i else "\n") + row["value"])
        out.write("\n]," + json.dumps(header, sort_keys=True, ensure_ascii=False)[1:] + "\n")


def field_violations(documents: DataFrame, raw: str = "raw") -> DataFrame:
    """Fields that the format does not have, at each level, and forbidden ones anywhere in the parameters, of JSON texts."""
    def unknown(level: str, objects: Column) -> DataFrame:
        keys = F.array_except(F.json_object_keys(F.col("o")), F.array(*(F.lit(f) for f in FIELDS[level])))
        return documents.select(F.explode(objects).alias("o")).select(F.explode(keys).alias("k")).select(F.lit(level).alias("location"), F.concat(F.lit("unknown field "), "k").alias("message"))

    one = lambda path: F.array(F.get_json_object(raw, path))
    many = lambda path: F.from_json(F.coalesce(F.get_json_object(raw, path), F.lit("[]")), "array<string>")
    cases = many("$.cases")
    nested = [unknown("$", F.array(F.col(raw))), *(unknown(p, one(p)) for p in ("$.dataset", "$.model", "$.runner")), unknown("$.cases[*]", cases)]
    nested.append(unknown("$.cases[*].cost", F.transform(cases, lambda c: F.get_json_object(c, "$.cost"))))
    inner = F.flatten(F.transform(cases, lambda c: F.from_json(F.coalesce(F.get_json_object(c, "$.mentions"), F.lit("[]")), "array<string>")))
    nested.append(unknown("$.cases[*].mentions[*]", inner))
    # written anew, a name is not escaped and stands right before its colon; inside a string value its quotes are escaped
    plain = F.lower(F.to_json(F.parse_json(F.get_json_object(raw, "$.runner.parameters"))))
    banned = documents.select(plain.alias("p")).select(F.explode(F.array(*(F.when(F.col("p").rlike(rf'(?<!\\)"{f}":'), F.lit(f)) for f in FORBIDDEN))).alias("k")).filter("k is not null")
    nested.append(banned.select(F.lit("$.runner.parameters").alias("location"), F.concat(F.lit("forbidden field "), "k").alias("message")))
    return reduce(DataFrame.unionByName, nested)


def violations(cases: DataFrame, mentions: DataFrame, docs: DataFrame, registry: DataFrame) -> DataFrame:
    """(location, message) of all rules on cases and mentions."""
    at_case = F.concat(F.lit("$.cases["), F.col("doc_id").cast("string"), F.lit("]"))
    at = F.concat(at_case, F.lit(".mentions["), F.col("idx").cast("string"), F.lit("]"))
    text = docs.select("doc_id", "plain_text")
    known = mentions.join(text.withColumn("known", F.lit(True)), "doc_id", "left").join(typed_keys(registry), ["type", "key"], "left")
    name = f"^{IDENTIFIER}\\z"
    in_text, long_enough = F.col("known").isNotNull(), F.col("end") > F.col("start")
    span = F.substring("plain_text", F.col("start") + 1, F.col("end") - F.col("start"))
    unique = ["doc_id", "start", "end", "type", "key"]
    rules = [
        _rows(cases.groupBy("doc_id").count(), F.col("count") > 1, at_case, "duplicate case"),
        _rows(cases.select("doc_id").distinct().join(text, "doc_id", "left_anti"), F.lit(True), at_case, "unknown case"),
        _rows(text.join(cases, "doc_id", "left_anti"), F.lit(True), at_case, "missing case"),
        *(_rows(cases, F.col(c) < 0, at_case, f"{c}: expected a non-negative integer") for c in ("model_calls", "estimated_tokens")),
        *(_rows(mentions, ~F.col(c).rlike(name), at, f"{c}: invalid identifier") for c in ("type", "key")),
        _rows(mentions, F.col("start") < 0, at, "start: expected a non-negative integer"),
        _rows(mentions, F.trim("label") == "", at, "label: expected a non-empty string"),
        _rows(mentions, F.col("end") <= F.col("start"), at, "end must be greater than start"),
        _rows(known, in_text & long_enough & (F.col("end") > F.length("plain_text")), at, "span exceeds plain_text"),
        _rows(known, in_text & long_enough & (F.col("end") <= F.length("plain_text")) & (fold(span) != fold(F.col("label"))), at, "label does not match the plain_text span"),
        _rows(known, F.col("canonical_id").isNull(), at, "unknown typed key"),
        _rows(mentions.groupBy(*unique).agg(F.count("*").alias("n"), F.max("idx").alias("idx")), F.col("n") > 1, at, "duplicate mention prediction"),
    ]
    return reduce(DataFrame.unionByName, rules)


def replayed(docs: DataFrame, cases: DataFrame, mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Recorded mentions as a condition, with the recorded costs."""
    ids = mentions.join(typed_keys(registry), ["type", "key"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_set("canonical_id")).alias("predicted"), F.count_if(F.col("canonical_id").isNull()).alias("open"), F.count("*").alias("found"))
    rows = docs.join(cases.select("doc_id", "model_calls", F.col("estimated_tokens").alias("tokens")), "doc_id", "left").join(ids, "doc_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select("doc_id", F.lit("recorded").alias("condition"), F.coalesce("predicted", F.array().cast("array<string>")).alias("predicted"), "gold", count("open").alias("open"), F.lit(0).cast("long").alias("label_scans"), count("found").alias("registry_lookups"), F.lit(0).cast("long").alias("references_read"), count("model_calls").alias("model_calls"), count("tokens").alias("estimated_tokens"))
