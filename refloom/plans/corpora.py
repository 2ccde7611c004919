"""Registered queries of corpus checks, generated corpora, aliases, answers and small aggregates, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar
from ..functions.text import fold
from ..operators import checks, passages, registry, retrieval
from . import workload as w
from .catalog import _BAD, _CODE, _DOCS, _FOLD, _LABELS, _LEX, _REFS, _REGISTRY, _SPANS, _entities, _lexical, _top, query

_J = F.array_join
_WITH_IDS = "known AS (SELECT s.*, r.canonical_id, r.label AS entity_label FROM spans s JOIN registry r ON r.type = s.type AND r.key = s.key)"


def _known(spark, d):
    """Spans of order documents with their canonical_id."""
    return registry.resolve(w.spans(w.order_docs(spark, d)), w.registry(spark, d))


@query("conformance_failures", _DOCS, _BAD, sql=f"""SELECT doc_id AS id, expected, got FROM (SELECT doc_id, {_CODE} AS got, CASE WHEN doc_id % 11 = 0 THEN 'valid' ELSE {_CODE} END AS expected FROM bad) WHERE expected <> got""")
def conformance_failures(spark, d):
    bad = w.malformed(w.order_docs(spark, d))
    wanted = F.when(F.col("doc_id") % 11 == 0, "valid").otherwise(grammar.validation_code(F.col("value")))
    return checks.conformance(bad.select(F.col("doc_id").alias("id"), F.col("value").alias("input"), (wanted == "valid").alias("valid"), wanted.alias("result")))


_SPOILT_REGISTRY = """spoilt AS (SELECT type, key, label, canonical_id FROM registry UNION ALL SELECT 'nation', n_name, '', 'nation-' || n_nationkey FROM nation UNION ALL SELECT 'planet', r_name, r_name, 'planet-' || r_regionkey FROM region)"""


@query("registry_checks", _REGISTRY, _SPOILT_REGISTRY, sql="""SELECT type || ':' || key AS subject, 'repeated typed key' AS message FROM spoilt GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT canonical_id, 'repeated id' FROM spoilt GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT type || ':' || key, 'type is not allowed' FROM spoilt WHERE type NOT IN ('nation', 'region', 'brand', 'part', 'customer') UNION ALL SELECT canonical_id, 'empty label' FROM spoilt WHERE trim(label) = ''""")
def registry_checks(spark, d):
    good = w.registry(spark, d).select("type", "key", "label", "canonical_id")
    again = w.table(spark, d, "nation").select(F.lit("nation"), "n_name", F.lit(""), F.concat(F.lit("nation-"), "n_nationkey"))
    other = w.table(spark, d, "region").select(F.lit("planet"), "r_name", "r_name", F.concat(F.lit("planet-"), "r_regionkey"))
    return checks.registry_rules(good.union(again).union(other), ["nation", "region", "brand", "part", "customer"])


_SPOILT_DOCS = """spoilt AS (SELECT doc_id, CASE WHEN doc_id % 13 = 1 THEN '  ' ELSE plain_text END AS plain_text, CASE WHEN doc_id % 13 = 2 THEN replace(tagged_text, 'nation:', 'nationx:') WHEN doc_id % 13 = 3 THEN tagged_text || ' @@EAT x' || '@@' ELSE tagged_text END AS tagged_text,
  CASE WHEN doc_id % 13 = 0 THEN list_append(gold, 'nation-999') WHEN doc_id % 13 = 4 THEN list_append(gold, gold[1]) ELSE gold END AS gold FROM order_docs)"""
_SPOILT_REFS = _REFS.replace("refs AS", "srefs AS").replace("FROM order_docs", "FROM spoilt")


@query("gold_checks", _REGISTRY, _DOCS, _SPOILT_DOCS, _SPOILT_REFS, sql=f"""SELECT DISTINCT doc_id, 'unknown gold id' AS message FROM (SELECT doc_id, unnest(gold) AS id FROM spoilt) WHERE id NOT IN (SELECT canonical_id FROM registry)
  UNION ALL SELECT DISTINCT doc_id, 'a reference resolves to nothing' FROM srefs LEFT JOIN registry USING (type, key) WHERE canonical_id IS NULL
  UNION ALL SELECT doc_id, 'references and gold differ' FROM spoilt LEFT JOIN (SELECT doc_id, list(canonical_id) FILTER (WHERE canonical_id IS NOT NULL) AS ids FROM srefs LEFT JOIN registry USING (type, key) GROUP BY 1) USING (doc_id) WHERE list_sort(gold) IS DISTINCT FROM list_sort(coalesce(ids, []))
  UNION ALL SELECT doc_id, 'empty text' FROM spoilt WHERE trim(plain_text) = '' UNION ALL SELECT doc_id, 'broken markup' FROM spoilt WHERE contains(regexp_replace(tagged_text, '{grammar.REFERENCE}', '', 'g'), '@@')""")
def gold_checks(spark, d):
    k = F.col("doc_id") % 13
    docs = w.order_docs(spark, d).withColumns({
        "plain_text": F.when(k == 1, "  ").otherwise(F.col("plain_text")),
        "tagged_text": F.when(k == 2, F.replace("tagged_text", F.lit("nation:"), F.lit("nationx:"))).when(k == 3, F.concat("tagged_text", F.lit(" @@EAT x@@"))).otherwise(F.col("tagged_text")),
        "gold": F.when(k == 0, F.array_append("gold", F.lit("nation-999"))).when(k == 4, F.array_append("gold", F.col("gold")[0])).otherwise(F.col("gold")),
    })
    return checks.gold_rules(docs, w.registry(spark, d))


@query("label_multisets", _REGISTRY, _DOCS, _LABELS, sql=f"""SELECT doc_id, label, CAST(coalesce(occ, 0) AS INTEGER) AS found, CAST(coalesce(required, 0) AS INTEGER) AS required FROM (SELECT doc_id, label, occ FROM plain_hits)
  FULL JOIN (SELECT doc_id, label, count(*) AS required FROM (SELECT doc_id, unnest(gold) AS canonical_id FROM order_docs) JOIN (SELECT canonical_id, {_FOLD.format('label')} AS label FROM registry) USING (canonical_id) GROUP BY 1, 2) USING (doc_id, label)""")
def label_multisets(spark, d):
    return checks.label_multisets(w.order_docs(spark, d), w.registry(spark, d))


@query("shared_by_splits", sql="SELECT text, count(DISTINCT split) AS splits FROM (SELECT text, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'test' END AS split FROM documents) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def shared_by_splits(spark, d):
    rows = w.table(spark, d, "documents").select("text", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("test").alias("split"))
    return checks.shared_by_splits(rows, "split", "text")


@query("reconciled_versions", _DOCS, sql="""SELECT doc_id, CASE doc_id % 17 WHEN 0 THEN 'missing case' WHEN 1 THEN 'text differs' WHEN 2 THEN 'gold differs' ELSE 'repeated case' END AS message FROM order_docs WHERE doc_id % 17 < 4
  UNION ALL SELECT -doc_id, 'unknown case' FROM order_docs WHERE doc_id % 17 = 4""")
def reconciled_versions(spark, d):
    docs, k = w.order_docs(spark, d).select("doc_id", "plain_text", "gold"), F.col("doc_id") % 17
    other = docs.filter(k != 0).withColumns({"plain_text": F.when(k == 1, F.lower("plain_text")).otherwise(F.col("plain_text")), "gold": F.when(k == 2, F.slice("gold", 2, 3)).otherwise(F.col("gold"))})
    other = other.union(docs.filter(k == 3)).union(docs.filter(k == 4).withColumn("doc_id", -F.col("doc_id")))
    return checks.reconciled(docs, other)


@query("generated_documents", sql="SELECT i AS generated_id, s_suppkey, s_name FROM range(100000) AS t(i) JOIN (SELECT *, row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal, count(*) OVER () AS n FROM supplier) ON i % n = ordinal")
def generated_documents(spark, d):
    return passages.generated(w.table(spark, d, "supplier"), "s_suppkey", 100_000).select("generated_id", "s_suppkey", "s_name")


@query("entities_in_context", _REGISTRY, _DOCS, _SPANS, _WITH_IDS, sql="""SELECT a.doc_id, a.pos, list_aggregate(list_sort(list_distinct(list(b.canonical_id))), 'string_agg', ',') AS ids FROM known a JOIN order_docs USING (doc_id) JOIN known b ON b.doc_id = a.doc_id AND b.s >= greatest(0, a.s - 12) AND b.e <= least(length(plain_text), a.e + 12) GROUP BY 1, 2""")
def entities_in_context(spark, d):
    return passages.entities_in_context(_known(spark, d), w.order_docs(spark, d), 12).select("doc_id", "pos", _J("ids", ",").alias("ids"))


@query("scope_counts", _REGISTRY, _DOCS, _SPANS, _WITH_IDS, sql="SELECT count(DISTINCT doc_id) AS documents, count(*) AS positions, count(DISTINCT (doc_id, canonical_id)) AS pairs, count(DISTINCT canonical_id) AS entities FROM known")
def scope_counts(spark, d):
    return passages.scope(_known(spark, d))


@query("training_mentions", _REGISTRY, _DOCS, _SPANS, _WITH_IDS, sql="SELECT type AS entity_type, entity_label, count(*) AS mentions FROM known WHERE doc_id % 7 <> 0 GROUP BY 1, 2 UNION ALL SELECT NULL, NULL, count(*) FROM spans WHERE doc_id % 7 = 0")
def training_mentions(spark, d):
    rows = _known(spark, d).withColumn("canonical_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("no-"), "canonical_id")).otherwise(F.col("canonical_id")))
    known, unknown = passages.known_mentions(rows, w.registry(spark, d))
    return known.groupBy("entity_type", "entity_label").agg(F.count("*").alias("mentions")).union(unknown.agg(F.lit(None).cast("string"), F.lit(None).cast("string"), F.count("*")))


_SURFACES = "seen AS (SELECT doc_id, pos, canonical_id, CASE WHEN pos = 1 THEN 'the ' || label ELSE label END AS label FROM known)"
_ALIASES = f"""aliases AS (SELECT alias, list_aggregate(list_sort(list_distinct(list(canonical_id))), 'string_agg', ',') AS ids FROM (SELECT {_FOLD.format('trim(label)')} AS alias, canonical_id FROM registry UNION ALL SELECT {_FOLD.format('trim(label)')}, canonical_id FROM seen) WHERE length(alias) >= 2 GROUP BY 1)"""


def _seen(spark, d):
    return _known(spark, d).withColumn("label", F.when(F.col("pos") == 1, F.concat(F.lit("the "), "label")).otherwise(F.col("label")))


@query("alias_table", _REGISTRY, _DOCS, _SPANS, _WITH_IDS, _SURFACES, _ALIASES, sql="SELECT * FROM aliases")
def alias_table(spark, d):
    return passages.aliases(w.registry(spark, d), _seen(spark, d)).select("alias", _J("ids", ",").alias("ids"))


@query("alias_lookup", _REGISTRY, _DOCS, _SPANS, _WITH_IDS, _SURFACES, _ALIASES, sql="SELECT c_custkey, ids FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_mktsegment END AS surface FROM customer) LEFT JOIN aliases ON alias = lower(trim(surface))")
def alias_lookup(spark, d):
    surfaces = w.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_mktsegment")).alias("surface"))
    return passages.looked_up(surfaces, passages.aliases(w.registry(spark, d), _seen(spark, d))).select("c_custkey", _J("ids", ",").alias("ids"))


@query("entity_profiles", _REGISTRY, _DOCS, _SPANS, _WITH_IDS, sql="""SELECT r.canonical_id, md5(r.label || coalesce(x.all_, '')) AS profile FROM (SELECT DISTINCT canonical_id, label FROM registry WHERE type = 'customer') r LEFT JOIN (SELECT canonical_id, string_agg(chr(32) || chr(10) || chr(32) || substr(plain_text, greatest(0, s - 160) + 1, e + 160 - greatest(0, s - 160)), '' ORDER BY doc_id, s) AS all_ FROM known JOIN order_docs USING (doc_id) GROUP BY 1) x USING (canonical_id)""")
def entity_profiles(spark, d):
    customers = w.registry(spark, d).filter("type = 'customer'")
    found = passages.profiles(customers, _known(spark, d).filter("type = 'customer'"), w.order_docs(spark, d))
    return found.select("canonical_id", F.md5(F.encode("profile", "UTF-8")).alias("profile"))


@query("median_value", sql="SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def median_value(spark, d):
    return w.table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("numeric_id_order", sql="SELECT n_nationkey AS nation, id, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY CAST(substr(id, 2) AS BIGINT)) AS INTEGER) AS place FROM (SELECT c_nationkey AS n_nationkey, 'Q' || c_custkey AS id FROM customer)")
def numeric_id_order(spark, d):
    from pyspark.sql import Window

    rows = w.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.concat(F.lit("Q"), "c_custkey").alias("id"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("nation").orderBy(F.substring("id", 2, 40).cast("long"))))


_TOP = "top AS (" + _top("lex") + ")"
_ANSWERS = r"""texts AS (SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '')[1] AS title, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents),
firsts AS (SELECT q.question_id, q.entity_id, t.title AS answer, coalesce(t.source = q.entity_id, false) AS good FROM questions q LEFT JOIN top ON top.question_id = q.question_id AND rank = 1 LEFT JOIN texts t ON t.doc_id = top.doc_id)"""


@query("retrieval_answers", _LEX, _TOP, _ANSWERS, sql="SELECT f.question_id, f.answer, f.good AS correct, CAST(coalesce(c.words, 0) AS BIGINT) AS context_words FROM firsts f LEFT JOIN (SELECT question_id, sum(words) AS words FROM top JOIN texts USING (doc_id) GROUP BY 1) c USING (question_id)")
def retrieval_answers(spark, d):
    q, postings, weights = _lexical(spark, d)
    return passages.answers(retrieval.lexical(q, postings, weights), q, _entities(spark, d), w.table(spark, d, "documents"))


@query("failing_examples", _LEX, _TOP, _ANSWERS, sql="SELECT question_id, entity_id, NOT good AS fails FROM firsts WHERE NOT good OR NOT (SELECT bool_or(NOT good) FROM firsts) ORDER BY entity_id, question_id LIMIT 5")
def failing_examples(spark, d):
    q, postings, weights = _lexical(spark, d)
    return passages.failing(retrieval.lexical(q, postings, weights), q, _entities(spark, d))


_BIG = "lpad(to_hex(doc_id), 8, '0')"


@query("ranking_digests", _LEX, _TOP, sql=f"SELECT question_id, sha256(unhex(string_agg({_BIG}, '' ORDER BY rank))) AS sha256 FROM top GROUP BY 1")
def ranking_digests(spark, d):
    q, postings, weights = _lexical(spark, d)
    return retrieval.lexical(q, postings, weights).groupBy("question_id").agg(retrieval.digest(F.col("doc_id")).alias("sha256"))


@query("normalised_labels", sql="SELECT p_partkey, lower(trim(regexp_replace(p_name, '^(the|a|an) ', ''))) AS body FROM part")
def normalised_labels(spark, d):
    from ..functions.text import surface

    rows = w.table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, " The ").otherwise(""), "p_name", F.lit(" ")).alias("name"))
    return rows.select("p_partkey", fold(surface(F.col("name"))["body"]).alias("body"))
