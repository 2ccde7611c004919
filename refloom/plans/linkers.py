"""Registered queries of model-backed linkers, recorded runs, source checks and summaries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assistance, checks, index, models, registry, retrieval, runs
from . import workload as w
from .catalog import _COVER, _DOCS, _KEPT, _LEX, _LITTLE, _RANKED, _REGISTRY, _SPANS, query
from .corpora import _SPOILT_DOCS, _SPOILT_REFS

_CUES = """cues AS (SELECT s_suppkey AS doc_id, n_name, n_nationkey, s_suppkey % 4 AS k, CASE s_suppkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 11 WHEN 2 THEN 4 ELSE 10 END AS s,
    CASE s_suppkey % 4 WHEN 0 THEN 'They mentioned ' || n_name || ' today.' WHEN 1 THEN 'The nation ' || n_name || ' grew.' WHEN 2 THEN 'The ' || n_name || ' market grew.' ELSE 'A nation, ' || n_name || ', market open.' END AS plain_text
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
parts AS (SELECT 'nation-' || n_nationkey AS id, n_name AS t FROM nation UNION ALL SELECT 'market-' || n_nationkey, n_name FROM nation UNION ALL SELECT CASE k WHEN 1 THEN 'nation-' ELSE 'market-' END || n_nationkey, plain_text FROM cues WHERE k IN (1, 2))"""
_PICKED = """picked AS (SELECT doc_id, s, n_name, CASE WHEN id LIKE 'nation%' THEN 'nation' ELSE 'market' END AS type, CASE WHEN id LIKE 'nation%' THEN n_name ELSE 'M_' || n_name END AS key, plain_text
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, id) AS r FROM scores) JOIN cues USING (doc_id) WHERE r = 1)"""


def _gram_sql(name: str, source: str) -> str:
    return rf"""{name}_words AS (SELECT id, ' ' || x || ' ' AS p FROM (SELECT id, unnest(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda x: x <> '')) AS x FROM {source})),
{name} AS (SELECT id, gram, count(*) AS tf FROM (SELECT id, substr(p, i, n) AS gram FROM (SELECT id, p, n, unnest(CASE WHEN length(p) <= n THEN (CASE WHEN n = greatest(3, length(p)) THEN [1] ELSE [] END) ELSE range(1, length(p) - n + 2) END) AS i FROM {name}_words, (SELECT unnest([3, 4, 5]) AS n))) GROUP BY 1, 2)"""


def _weight_sql(name: str, grams: str) -> str:
    return f"{name} AS (SELECT id, gram, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS w FROM (SELECT id, gram, (1 + ln(tf)) * (ln(((SELECT count(DISTINCT id) FROM parts) + 1.0) / (df + 1.0)) + 1) AS v FROM {grams} JOIN dfs USING (gram)))"


_TFIDF = ",\n".join([
    "asked AS (SELECT doc_id AS id, plain_text AS t FROM cues)", _gram_sql("pg", "parts"), _gram_sql("qg", "asked"), "dfs AS (SELECT gram, count(*) AS df FROM pg GROUP BY 1)", _weight_sql("pw", "pg"), _weight_sql("qw", "qg"),
    "scores AS (SELECT c.doc_id, p.id, round(sum(q.w * p.w), 9) AS score FROM cues c JOIN qw q ON q.id = c.doc_id JOIN pw p ON p.gram = q.gram AND p.id IN ('nation-' || c.n_nationkey, 'market-' || c.n_nationkey) GROUP BY 1, 2)",
])
_LETTERS = "list_transform(range(97, 123), lambda i: CAST(length({0}) - length(replace(lower({0}), chr(CAST(i AS INTEGER)), '')) AS DOUBLE))"
_VECTORS = f"""held AS (SELECT id, {_LETTERS.format('t')} AS b FROM (SELECT id, string_agg(t, ' ') AS t FROM parts GROUP BY 1)),
scores AS (SELECT doc_id, id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 9) AS score FROM (SELECT *, {_LETTERS.format('plain_text')} AS a FROM cues) JOIN held ON id IN ('nation-' || n_nationkey, 'market-' || n_nationkey))"""


def _trained(spark, d):
    """(docs, registry, training mentions, spans of a recogniser) of supplier sentences; those with one cue are for training."""
    docs, entries = w.cue_docs(spark, d)
    k = F.pmod("doc_id", F.lit(4))
    docs = docs.select("doc_id", "plain_text")
    places = w.table(spark, d, "supplier").join(w.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("doc_id"), "n_name", "n_nationkey")
    start = F.when(k == 0, 15).when(k == 1, 11).when(k == 2, 4).otherwise(10)
    places = places.select("doc_id", "n_nationkey", start.alias("start"), (start + F.length("n_name")).alias("end"))
    known = places.filter(k.isin(1, 2)).select("doc_id", "start", "end", F.concat(F.when(k == 1, "nation-").otherwise("market-"), "n_nationkey").alias("canonical_id"))
    spans = places.select("doc_id", F.when(k == 2, 0).otherwise(F.col("start")).alias("start"), "end")  # an article is inside
    return docs, entries, known, spans


@query("tfidf_run", _CUES, _TFIDF, _PICKED, sql="""SELECT doc_id, '{"cost":{"estimated_tokens":' || len(string_split(plain_text, ' ')) || ',"model_calls":1},"id":"' || doc_id || '","mentions":[{"end":' || (s + length(n_name)) || ',"key":"' || key || '","label":"' || n_name || '","start":' || s || ',"type":"' || type || '"}]}' AS value FROM picked""")
def tfidf_run(spark, d):
    docs, entries, known, _ = _trained(spark, d)
    linked = models.tfidf_linker(docs, entries, known, docs)
    return runs.case_lines(models.costs(docs, linked), linked)


def _letters(texts):
    """A stand-in for a model: how often each letter occurs."""
    return texts.select("id", F.expr("transform(sequence(97, 122), c -> cast(length(text) - length(replace(lower(text), chr(c), '')) as double))").alias("vector"))


@query("vector_link", _CUES, _VECTORS, _PICKED, sql="SELECT doc_id, n_name AS label, s AS \"start\", type, key FROM picked")
def vector_link(spark, d):
    docs, entries, known, spans = _trained(spark, d)
    return models.vector_linker(docs, spans, entries, known, docs, _letters).select("doc_id", "label", "start", "type", "key")


@query("source_checks", _REGISTRY, _DOCS, _SPOILT_DOCS, _SPOILT_REFS, sql="""SELECT DISTINCT doc_id, 'a reference resolves to nothing' AS message FROM srefs LEFT JOIN registry USING (type, key) WHERE canonical_id IS NULL
  UNION ALL SELECT doc_id, 'references and gold differ' FROM spoilt LEFT JOIN (SELECT doc_id, list_distinct(list(canonical_id) FILTER (WHERE canonical_id IS NOT NULL)) AS ids FROM srefs LEFT JOIN registry USING (type, key) GROUP BY 1) USING (doc_id) WHERE list_sort(list_distinct(gold)) IS DISTINCT FROM list_sort(coalesce(ids, []))
  UNION ALL SELECT doc_id, 'repeated document' FROM order_docs WHERE doc_id % 13 = 5""")
def source_checks(spark, d):
    k = F.col("doc_id") % 13
    docs = w.order_docs(spark, d).select(
        "doc_id",
        F.when(k == 2, F.replace("tagged_text", F.lit("nation:"), F.lit("nationx:"))).otherwise(F.col("tagged_text")).alias("tagged_text"),
        F.when(k == 0, F.array_append("gold", F.lit("nation-999"))).when(k == 4, F.array_append("gold", F.col("gold")[0])).otherwise(F.col("gold")).alias("gold"),
    )
    return checks.source_rules(docs.union(docs.filter(k == 5)), w.registry(spark, d))


@query("run_documents", _DOCS, sql="SELECT doc_id, '$' AS location, CASE WHEN doc_id % 5 IN (1, 4) THEN 'not JSON' ELSE 'expected an object' END AS message FROM order_docs WHERE doc_id % 5 > 0")
def run_documents(spark, d):
    k = F.col("doc_id") % 5
    good = F.to_json(F.struct(F.col("plain_text").alias("input")))
    raw = F.when(k == 0, good).when(k == 1, F.substring(good, 1, 9)).when(k == 2, F.concat(F.lit("["), good, F.lit("]"))).when(k == 3, F.lit("17"))  # else null
    return runs.document_violations(w.order_docs(spark, d).select("doc_id", raw.alias("raw"))).drop("raw")


_PRINTS = f"""prints AS (SELECT entity_id, count(*) AS n, sha256(unhex(hex(encode(entity_id)) || '00' || lpad(to_hex(count(*)), 16, '0') || string_agg({_LITTLE}, '' ORDER BY doc_id))) AS digest FROM (SELECT unnest(gold) AS entity_id, doc_id FROM order_docs) GROUP BY 1),
groups_ AS (SELECT substr(sha256(entity_id), 1, 3) AS prefix, count(*) AS entities, sum(n) AS postings, sha256(string_agg(entity_id || ':' || digest, chr(10) ORDER BY entity_id)) AS digest FROM prints GROUP BY 1)"""


@query("index_digest", _DOCS, _PRINTS, sql="SELECT CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(postings) AS BIGINT) AS postings, sha256(string_agg(digest, '' ORDER BY prefix)) AS sha256 FROM groups_")
def index_digest(spark, d):
    return index.index_digest(index.fingerprint(index.entity_postings(w.order_docs(spark, d), w.registry(spark, d))))


@query("inference_summary", _LEX, sql="""SELECT count(*) AS questions, count(*) FILTER (WHERE n > 1) AS fallbacks, round(count(*) FILTER (WHERE n = 1 AND one = entity_id) / nullif(count(*) FILTER (WHERE n = 1), 0), 6) AS accuracy, count(DISTINCT CASE WHEN n > 1 THEN lower(q.label) END) AS ambiguous_labels FROM questions q JOIN labelled l ON l.label = lower(q.label)""")
def inference_summary(spark, d):
    return retrieval.inference_summary(retrieval.inference(w.questions(spark, d), registry.label_ids(w.groups(spark, d))))


@query("assist_deltas", _DOCS, _SPANS, _RANKED, _COVER, _KEPT, sql="""SELECT coverage, round(r - first_value(r) OVER o, 6) AS recall_delta, round(2 * r / (1 + r) - first_value(2 * r / (1 + r)) OVER o, 6) AS f1_delta, exact - first_value(exact) OVER o AS exact_delta
  FROM (SELECT CAST(coverage AS DOUBLE) AS coverage, sum(n) / (4.0 * count(*)) AS r, count(*) FILTER (WHERE n = 4) AS exact FROM (SELECT c.coverage, d.doc_id, count(DISTINCT u.pos) AS n FROM cover c CROSS JOIN order_docs d
    LEFT JOIN (SELECT coverage, doc_id, pos FROM picked UNION SELECT coverage, doc_id, pos FROM kept CROSS JOIN cover) u ON u.coverage = c.coverage AND u.doc_id = d.doc_id GROUP BY 1, 2) GROUP BY 1) WINDOW o AS (ORDER BY coverage)""")
def assist_deltas(spark, d):
    docs = w.order_docs(spark, d)
    _, found = w.recorded(docs)
    return assistance.deltas(assistance.curve(docs, w.spans(docs), found, w.registry(spark, d))).select("coverage", "recall_delta", "f1_delta", "exact_delta")
