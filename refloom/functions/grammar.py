"""Column functions for typed inline references: extraction with offsets, validation, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notation.
OPENER, CLOSER, SEPARATOR = "@@EAT ", "@@", ":"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
REFERENCE = f"{OPENER}({IDENTIFIER}){SEPARATOR}({IDENTIFIER}){CLOSER}"
VERSION = "0.3.2"
# The outcome codes.
VALID = "valid"
NO_OPENER, NO_CLOSER, NO_SEPARATOR = "incomplete_opening_marker", "missing_closing_marker", "missing_separator"
NO_TYPE, NO_KEY, BAD_NAME, NO_REFERENCE = "missing_type", "missing_key", "invalid_identifier", "invalid_reference"


def references(text: Column) -> Column:
    """All references of a text: array of (type, key, raw, start, end); offsets count code points, end is exclusive."""
    all_of = [F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(g)) for g in (1, 2, 0)]
    gaps = F.transform(F.split(text, REFERENCE, -1), lambda x: F.length(x))
    rows = F.arrays_zip(all_of[0].alias("t"), all_of[1].alias("k"), all_of[2].alias("r"), F.slice(gaps, 1, F.size(all_of[0])).alias("g"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["r"])
        item = F.struct(x["t"].alias("type"), x["k"].alias("key"), x["r"].alias("raw"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    empty = F.array().cast("array<struct<type:string,key:string,raw:string,start:int,end:int>>")
    return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda acc: acc["out"])


def parsed(text: Column) -> Column:
    return F.struct(F.lit(VERSION).alias("version"), references(text).alias("references"))


def pairs(refs: Column) -> Column:
    return F.transform(refs, lambda r: F.struct(r["type"].alias("type"), r["key"].alias("key")))


def validation_code(value: Column) -> Column:
    """Why a value is not exactly one reference, or `valid`."""
    body = F.substring(value, F.lit(len(OPENER) + 1), F.length(value) - len(OPENER) - len(CLOSER))
    colon = F.instr(body, SEPARATOR)
    return (
        F.when(value.rlike(f"^{REFERENCE}\\z"), VALID)
        .when(~F.startswith(value, F.lit(OPENER)), NO_OPENER)
        .when(~F.endswith(value, F.lit(CLOSER)), NO_CLOSER)
        .when(colon == 0, NO_SEPARATOR)
        .when(colon == 1, NO_TYPE)
        .when(colon == F.length(body), NO_KEY)
        .otherwise(BAD_NAME)
    )


def validate(value: Column) -> Column:
    code = validation_code(value)
    return F.struct((code == VALID).alias("valid"), code.alias("code"))


def diagnosis(value: Column) -> Column:
    """Like validation_code for whole sentences: references inside a text make it valid."""
    return (
        F.when(F.startswith(value, F.lit(OPENER)), F.when(~F.endswith(value, F.lit(CLOSER)), NO_CLOSER).otherwise(validation_code(value)))
        .when(F.endswith(value, F.lit(CLOSER)), NO_OPENER)
        .when(value.rlike(REFERENCE), VALID)
        .otherwise(NO_REFERENCE)
    )


def has_leftover(text: Column) -> Column:
    """Whether a marker remains once all references are taken out."""
    return F.contains(F.regexp_replace(text, REFERENCE, ""), F.lit(CLOSER))


def tag(kind: Column, key: Column) -> Column:
    return F.concat(F.lit(OPENER), kind, F.lit(SEPARATOR), key, F.lit(CLOSER))


def rendered(text: Column, spans: Column) -> Column:
    """``text`` with each span (start, end, type, key) replaced by its tag; overlapping, empty or outside spans are an error."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["key"].alias("key"))))

    def add(acc: Column, s: Column) -> Column:
        good = (s["start"] >= acc["at"]) & (s["end"] > s["start"]) & (s["end"] <= F.length(text))
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        grown = F.concat(acc["out"], piece, tag(s["type"], s["key"]))
        return F.struct(s["end"].cast("int").alias("at"), F.when(good, grown).otherwise(F.raise_error(F.lit("a span overlaps another, is empty or lies outside the text")).cast("string")).alias("out"))

    return F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
