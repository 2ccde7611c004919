"""Column functions on plain text: folding, terms, windows, patterns, percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
WORD = r"[\p{L}\p{N}_]"
ARTICLE = r"(?i)^\s*(?:(?:the|a|an)\s+)?"
CONTEXT, PASSAGE = 160, 220


def fold(text: Column) -> Column:
    """Full case folding of labels and texts: what upper case joins is one in lower case, so ß is ss, ſ is s, ς is σ.
    Dotless ı, which upper case would join with i, stays apart."""
    kept = F.replace(text, F.lit("ı"), F.lit("\ue000"))
    # what stands between the two also keeps the optimizer from taking lower(upper(x)) for lower(x)
    low = F.translate(F.lower(F.replace(F.upper(kept), F.lit("ẞ"), F.lit("SS"))), "ς", "σ")
    return F.replace(low, F.lit("\ue000"), F.lit("ı"))


def estimated_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"(?U)\s+"), ""))


def terms(text: Column) -> Column:
    """Distinct folded terms of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def title(text: Column) -> Column:
    """First line that is not blank, stripped; null if there is none."""
    return F.get(F.array_remove(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), ""), F.lit(0))


def context(text: Column, start: Column, end: Column, width: int = CONTEXT) -> Column:
    """The text from ``width`` before a span to ``width`` after it."""
    left = F.greatest(F.lit(0), start - width)
    return F.substring(text, left + 1, end + width - left)


def passage(page: Column, text: Column, start: Column, end: Column, kind: Column, key: Column, width: int = PASSAGE) -> Column:
    """The window around a span, with the span itself as a tag, under its page title."""
    from .grammar import tag

    left = F.greatest(F.lit(0), start - width)
    return F.concat(F.lit("Source page: "), page, F.lit("\nPassage: "), F.substring(text, left + 1, start - left), tag(kind, key), F.substring(text, end + 1, F.lit(width)))


def surface(text: Column) -> Column:
    """(body, offset) of a mention without outer blanks and one leading article."""
    head = F.regexp_extract(text, ARTICLE, 0)
    return F.struct(F.rtrim(F.substring(text, F.length(head) + 1, F.length(text))).alias("body"), F.length(head).alias("offset"))


def label_pattern(label: Column) -> Column:
    """A pattern for whole-word, case-insensitive occurrences of a label, which is quoted as it is."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(label, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    left = F.when(F.substring(label, 1, 1).rlike(WORD), rf"(?<!{WORD})").otherwise("")
    right = F.when(F.substring(label, -1, 1).rlike(WORD), rf"(?!{WORD})").otherwise("")
    return F.concat(F.lit("(?iu)"), left, quoted, right)


def occurrences(text: Column, label: Column) -> Column:
    """How often ``label`` occurs in ``text``, overlaps apart."""
    return ((F.length(text) - F.length(F.replace(text, label, F.lit("")))) / F.length(label)).cast("int")


def is_item_id(value: Column) -> Column:
    return value.rlike(r"^Q[1-9][0-9]*\z")


def is_sha256(value: Column) -> Column:
    return value.rlike(r"^[0-9a-f]{64}\z")


def is_commit(value: Column) -> Column:
    return value.rlike(r"^[0-9a-f]{7,40}\z")


def is_uri(value: Column) -> Column:
    """A scheme is there, and for http and https an authority."""
    web = value.rlike(r"^(?i)https?:")
    return F.coalesce(F.when(web, value.rlike(r"^(?i)https?://[^/?#\s]+")).otherwise(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:.")), F.lit(False))


def nearest_rank(value: str, share: float) -> Column:
    """Aggregate: the nearest-rank percentile of a column."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, 0.0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
