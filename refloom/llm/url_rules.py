"""Operator 9: URL filtering by a fixed rule list and by mined association rules.

FIXED rules judge a host, its subdomains and a path prefix; the longest wins. All other URLs are judged by association
rules: Spark's FP-growth mines combinations of URL tokens together with the label of labelled URLs; rules
`tokens → label` are pruned by support, by confidence, and where a part of the tokens says as much; an inverted index
from each rule's rarest token finds the rules whose tokens a URL has all of, and the one with the highest confidence,
then support, then fewest tokens decides. In the query the labelled URLs are those that the fixed rules judge.

A URL has at most ten tokens by design (host suffixes, first host label, first two path segments, suffix, first query
key, fragment), so the itemsets of one URL are at most 2^11 and a URL repeated by a third of all rows cannot blow
mining up. About MAX_LABELLED labelled rows, chosen by a hash of page and url, are mined. No rule is dropped: sets of up to
MAX_TOKENS of ten tokens with a support of MIN_SUPPORT number at most 175 / MIN_SUPPORT, 35,000, whatever the input.

Defined cases: a null URL, or one without `://`, has empty host and path and no tokens; without a matching rule the
verdict is DEFAULT; a null page_id is kept as null; repeated rows are judged alike, urls of any length whole; other columns
are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path prefix, verdict)
FIXED = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIN_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 0.8, 3
MAX_LABELLED, DEFAULT = 200_000, "allow"
_LABEL = "label="


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fixed_rule(host: Column, path: Column, rules=FIXED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls without one."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def tokens() -> Column:
    """Distinct tokens of a row with url, host and path."""
    return F.expr("""array_distinct(filter(array(
        if(host <> '', 'tld ' || element_at(split(host, '[.]'), -1), null),
        if(size(split(host, '[.]')) > 1, 'domain ' || array_join(slice(split(host, '[.]'), -2, 2), '.'), null),
        if(size(split(host, '[.]')) > 2, 'label ' || split(host, '[.]')[0], null),
        'one ' || nullif(get(split(path, '/'), 1), ''), 'two ' || nullif(get(split(path, '/'), 2), ''),
        'suffix ' || nullif(regexp_extract(path, '[.]([A-Za-z0-9]{1,5})$', 1), ''),
        'key ' || nullif(regexp_extract(url, '^[^?#]*[?]([^=&#]+)', 1), ''),
        if(instr(url, '#') > 0, 'fragment', null), 'scheme ' || nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '')
    ), x -> x is not null))""")


def _order(rule: tuple):
    """Best first: confidence, support, fewest tokens."""
    tokens_, label, confidence, support = rule
    return -confidence, -support, len(tokens_), tokens_, label


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> list[tuple]:
    """Rules ``(tokens, label, confidence, support)`` from rows ``(page_id, url, tokens, label)``, best first."""
    rows = labelled.filter("label is not null and size(tokens) > 0")
    total = rows.count()
    if not total:
        return []
    part = min(1.0, MAX_LABELLED / total)
    rows = rows.filter(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30)) < int(part * (1 << 30)))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows.select(F.array_append("tokens", F.concat(F.lit(_LABEL), "label")).alias("items")))
    found = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit(_LABEL)) & (F.size("antecedent") <= MAX_TOKENS))
    best = found.select(F.array_sort("antecedent").alias("t"), F.expr(f"substring(consequent[0], {len(_LABEL) + 1})").alias("l"), F.round("confidence", 9).alias("c"), F.round("support", 9).alias("s"))
    best = best.collect()  # at most 175 / min_support rows
    kept: list[tuple] = []
    held: dict[tuple, float] = {}
    for r in sorted(best, key=lambda r: (len(r["t"]), -r["c"], r["t"], r["l"])):
        t = tuple(r["t"])
        parts_ = [t[:i] + t[i + 1 :] for i in range(len(t))]
        stronger = max((held.get((p, r["l"]), 0.0) for p in parts_ if p), default=0.0)
        held[t, r["l"]] = max(stronger, r["c"])
        if r["c"] > stronger:
            kept.append((t, r["l"], r["c"], r["s"]))
    return sorted(kept, key=_order)


def index(rules: list[tuple]) -> dict[str, list[tuple[int, frozenset]]]:
    """Rarest token of each rule → (rank of the rule, its tokens)."""
    uses: dict[str, int] = {}
    for t, *_ in rules:
        for x in t:
            uses[x] = uses.get(x, 0) + 1
    out: dict[str, list[tuple[int, frozenset]]] = {}
    for rank, (t, *_) in enumerate(rules):
        out.setdefault(min(t, key=lambda x: (uses[x], x)), []).append((rank, frozenset(t)))
    return out


def best_rule(url_tokens, inverted) -> int | None:
    """Rank of the best rule that a URL's tokens contain."""
    have = set(url_tokens or ())
    return min((rank for x in have for rank, t in inverted.get(x, ()) if t <= have), default=None)


def _verdicts(batches, rules):
    inverted, seen = index(rules), {}
    for batch in batches:
        got = []
        for verdict, own in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
            if verdict is None:
                key = tuple(own or ())
                if key not in seen:
                    if len(seen) >= 100_000:
                        seen.clear()
                    rank = best_rule(key, inverted)
                    seen[key] = DEFAULT if rank is None else rules[rank][1]
                verdict = seen[key]
            got.append(verdict)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(got, pa.string())], ["page_id", "host", "path", "rule", "verdict"])


def prepare(pages: DataFrame) -> DataFrame:
    host, path = parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumns({"host": host, "path": path})
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "label": verdict, "tokens": tokens()})


def judge(pages: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row of ``pages``; rules are mined from it if not given."""
    rows = prepare(pages)
    rules = sorted(mine(rows) if rules is None else rules, key=_order)
    return rows.select("page_id", "host", "path", "rule", "label", "tokens").mapInArrow(partial(_verdicts, rules=rules), "page_id long, host string, path string, rule string, verdict string")
