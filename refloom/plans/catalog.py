"""Registered queries of the engine's operators and the same in SQL.

Arrays leave as comma-joined strings and ratios rounded to six digits, so that values compare whatever the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grammar, text
from ..operators import assistance, index, linking, registry, retrieval, runs, scoring, vectors
from . import workload as w

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

R = r"@@EAT ([A-Za-z_][A-Za-z0-9_]*):([A-Za-z_][A-Za-z0-9_]*)@@"
_REGISTRY = """registry AS (
  SELECT 'nation' AS type, n_name AS key, n_name AS label, 'nation-' || n_nationkey AS canonical_id FROM nation
  UNION ALL SELECT 'region', r_name, r_name, 'region-' || r_regionkey FROM region
  UNION ALL SELECT DISTINCT 'brand', replace(p_brand, '#', '_'), p_brand, 'brand-' || replace(p_brand, '#', '_') FROM part
  UNION ALL SELECT 'part', 'P_' || p_partkey, p_name, 'part-' || p_partkey FROM part
  UNION ALL SELECT 'customer', replace(c_name, '#', '_'), c_name, 'customer-' || c_custkey FROM customer)"""
_DOCS = """firsts AS (SELECT l_orderkey, min(l_partkey) AS pk FROM lineitem GROUP BY 1),
order_docs AS (
  SELECT o_orderkey AS doc_id, c_name || ' from ' || n_name || ' ordered ' || p_name || ' of ' || p_brand || '.' AS plain_text,
    '@@EAT customer:' || replace(c_name, '#', '_') || '@@ from @@EAT nation:' || n_name || '@@ ordered @@EAT part:P_' || p_partkey || '@@ of @@EAT brand:' || replace(p_brand, '#', '_') || '@@.' AS tagged_text,
    ['customer-' || c_custkey, 'nation-' || n_nationkey, 'part-' || p_partkey, 'brand-' || replace(p_brand, '#', '_')] AS gold,
    c_name, n_name, p_name, p_brand, p_partkey
  FROM orders JOIN firsts ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN part ON p_partkey = pk)"""
_SPANS = """spans AS (
  SELECT doc_id, 0 AS pos, c_name AS label, 0 AS s, length(c_name) AS e, 'customer' AS type, replace(c_name, '#', '_') AS key FROM order_docs
  UNION ALL SELECT doc_id, 1, n_name, length(c_name) + 6, length(c_name) + 6 + length(n_name), 'nation', n_name FROM order_docs
  UNION ALL SELECT doc_id, 2, p_name, length(c_name) + length(n_name) + 15, length(c_name) + length(n_name) + 15 + length(p_name), 'part', 'P_' || p_partkey FROM order_docs
  UNION ALL SELECT doc_id, 3, p_brand, length(c_name) + length(n_name) + length(p_name) + 19, length(c_name) + length(n_name) + length(p_name) + 19 + length(p_brand), 'brand', replace(p_brand, '#', '_') FROM order_docs)"""
_BAD = """bad AS (
  SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN g WHEN 1 THEN substr(g, 2) WHEN 2 THEN left(g, length(g) - 1) WHEN 3 THEN replace(g, ':', ' ')
    WHEN 4 THEN replace(g, 'nation:', ':') WHEN 5 THEN '@@EAT nation:@@' ELSE replace(g, 'nation:', 'na-tion:') END AS value
  FROM (SELECT doc_id, '@@EAT nation:' || n_name || '@@' AS g FROM order_docs))"""
_REFS = f"""refs AS (SELECT doc_id, unnest(range(len(t))) AS pos, unnest(t) AS type, unnest(k) AS key, unnest(raw) AS raw FROM (
  SELECT doc_id, regexp_extract_all(tagged_text, '{R}', 1) AS t, regexp_extract_all(tagged_text, '{R}', 2) AS k, regexp_extract_all(tagged_text, '{R}', 0) AS raw FROM order_docs))"""
_FOLD = "replace(lower({}), 'ß', 'ss')"
_LABELS = f"""labels_ AS (SELECT {_FOLD.format('label')} AS label, count(*) AS n, min(canonical_id) AS one FROM registry GROUP BY 1),
plain_hits AS (SELECT doc_id, label, n, one, (length(t) - length(replace(t, label, ''))) // length(label) AS occ
  FROM (SELECT doc_id, {_FOLD.format('plain_text')} AS t FROM order_docs) JOIN labels_ ON contains(t, label)),
plain_res AS (SELECT d.doc_id, d.gold, coalesce(list_sort(list_distinct(list(h.one) FILTER (WHERE h.n = 1))), []) AS predicted,
    coalesce(sum(CASE WHEN h.n > 1 THEN h.occ ELSE 0 END), 0) AS open, count(h.label) AS found, len(list_filter(regexp_split_to_array(any_value(d.plain_text), '\\s+'), lambda x: x <> '')) AS toks
  FROM order_docs d LEFT JOIN plain_hits h USING (doc_id) GROUP BY d.doc_id, d.gold),
plain_scored AS (SELECT *, len(list_intersect(predicted, gold)) AS tp, len(predicted) - len(list_intersect(predicted, gold)) AS fp, len(gold) - len(list_intersect(predicted, gold)) AS fn FROM plain_res)"""
_TERM = "[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)*"
_LEX = f"""postings AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{_TERM}', 0)) AS term FROM documents),
weights AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM postings GROUP BY 1),
questions AS (SELECT source AS question_id, source AS entity_id, 'Group ' || CASE WHEN num < 6 THEN num % 3 ELSE num END AS label, substr(t, 1, 120) AS question
  FROM (SELECT source, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS num, arg_min(text, doc_id) AS t FROM documents GROUP BY source)),
qterms AS (SELECT DISTINCT question_id, term, idf FROM (SELECT question_id, unnest(regexp_extract_all(lower(question), '{_TERM}', 0)) AS term FROM questions) JOIN weights USING (term)),
lex AS (SELECT question_id, doc_id, round(sum(idf), 9) AS score FROM qterms JOIN postings USING (term) GROUP BY 1, 2),
entities AS (SELECT source AS entity_id, doc_id FROM documents),
filt AS (SELECT q.question_id, e.doc_id, coalesce(l.score, 0.0) AS score FROM questions q JOIN entities e USING (entity_id) LEFT JOIN lex l ON l.question_id = q.question_id AND l.doc_id = e.doc_id),
labelled AS (SELECT label, count(*) AS n, min(entity_id) AS one FROM (SELECT lower(label) AS label, entity_id FROM questions) GROUP BY 1),
status AS (SELECT q.*, CASE WHEN l.n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM questions q JOIN labelled l ON l.label = lower(q.label))"""


def _top(source: str, k: int = 10) -> str:
    return f"SELECT question_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM {source}) WHERE rank <= {k}"


def query(name: str, *ctes: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL over the given table expressions."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


_J = F.array_join


@query("ref_extract", _DOCS, _REFS, sql="SELECT doc_id, CAST(pos AS INTEGER) AS pos, type, key FROM refs")
def ref_extract(spark: SparkSession, d: str) -> DataFrame:
    return registry.exploded(w.order_docs(spark, d)).select("doc_id", "pos", "type", "key")


@query("ref_offsets", _DOCS, _REFS, "gaps AS (SELECT doc_id, list_transform(regexp_split_to_array(tagged_text, '" + R + "'), lambda x: length(x)) AS g FROM order_docs)", sql="""
  SELECT doc_id, CAST(pos AS INTEGER) AS pos, raw, CAST(list_sum(g[1:pos + 1]) + coalesce(before, 0) AS INTEGER) AS "start", CAST(list_sum(g[1:pos + 1]) + coalesce(before, 0) + length(raw) AS INTEGER) AS "end"
  FROM (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM refs) JOIN gaps USING (doc_id)""")
def ref_offsets(spark, d):
    return registry.exploded(w.order_docs(spark, d)).select("doc_id", "pos", "raw", "start", "end")


_BODY = "substr(value, 7, length(value) - 8)"
_CODE = f"""CASE WHEN regexp_full_match(value, '{R}') THEN 'valid' WHEN NOT starts_with(value, '@@EAT ') THEN 'incomplete_opening_marker' WHEN NOT ends_with(value, '@@') THEN 'missing_closing_marker'
  WHEN position(':' IN {_BODY}) = 0 THEN 'missing_separator' WHEN position(':' IN {_BODY}) = 1 THEN 'missing_type' WHEN position(':' IN {_BODY}) = length({_BODY}) THEN 'missing_key' ELSE 'invalid_identifier' END"""
_DIAGNOSIS = f"""CASE WHEN starts_with(value, '@@EAT ') THEN (CASE WHEN ends_with(value, '@@') THEN {_CODE} ELSE 'missing_closing_marker' END) WHEN ends_with(value, '@@') THEN 'incomplete_opening_marker'
  WHEN regexp_matches(value, '{R}') THEN 'valid' ELSE 'invalid_reference' END"""


@query("ref_validate", _DOCS, _BAD, sql=f"SELECT doc_id, {_CODE} = 'valid' AS valid, {_CODE} AS code FROM bad")
def ref_validate(spark, d):
    return w.malformed(w.order_docs(spark, d)).select("doc_id", grammar.validate(F.col("value")).alias("v")).select("doc_id", "v.valid", "v.code")


@query("syntax_diagnose", _DOCS, _BAD, sql=f"""SELECT doc_id, {_DIAGNOSIS} AS value_code, sentence_code FROM bad JOIN (SELECT doc_id, {_DIAGNOSIS} AS sentence_code FROM (SELECT doc_id, 'See ' || value || ' today.' AS value FROM bad)) USING (doc_id)""")
def syntax_diagnose(spark, d):
    return w.malformed(w.order_docs(spark, d)).select("doc_id", grammar.diagnosis(F.col("value")).alias("value_code"), grammar.diagnosis(F.col("sentence")).alias("sentence_code"))


@query("leftover_markup", _DOCS, _BAD, sql=f"SELECT doc_id, contains(regexp_replace(value, '{R}', '', 'g'), '@@') AS leftover FROM bad")
def leftover_markup(spark, d):
    return w.malformed(w.order_docs(spark, d)).select("doc_id", grammar.has_leftover(F.col("value")).alias("leftover"))


@query("render_tags", _DOCS, sql="SELECT doc_id, tagged_text AS rendered FROM order_docs")
def render_tags(spark, d):
    docs = w.order_docs(spark, d)
    found = w.spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "type", "key")).alias("spans"))
    return docs.join(found, "doc_id").select("doc_id", grammar.rendered(F.col("plain_text"), F.col("spans")).alias("rendered"))


@query("resolve_typed", _REGISTRY, _DOCS, _REFS, sql="SELECT doc_id, CAST(pos AS INTEGER) AS pos, refs.type, refs.key, canonical_id FROM refs LEFT JOIN registry USING (type, key)")
def resolve_typed(spark, d):
    return registry.resolve(registry.exploded(w.order_docs(spark, d)), w.registry(spark, d)).select("doc_id", "pos", "type", "key", "canonical_id")


_SPOILT = f"""spoilt AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(tagged_text, 'nation:', 'nationx:') ELSE tagged_text END AS t FROM order_docs),
each AS (SELECT doc_id, unnest(range(len(k))) AS pos, unnest(t) AS type, unnest(k) AS key, unnest(raw) AS raw FROM (SELECT doc_id, regexp_extract_all(t, '{R}', 1) AS t, regexp_extract_all(t, '{R}', 2) AS k, regexp_extract_all(t, '{R}', 0) AS raw FROM spoilt))"""


@query("unresolved_refs", _REGISTRY, _DOCS, _SPOILT, sql="""SELECT doc_id, CAST(count(DISTINCT canonical_id) AS INTEGER) AS n_resolved, coalesce(string_agg(CASE WHEN canonical_id IS NULL THEN raw END, ',' ORDER BY pos), '') AS unresolved FROM each LEFT JOIN registry USING (type, key) GROUP BY 1""")
def unresolved_refs(spark, d):
    docs = w.order_docs(spark, d).withColumn("tagged_text", F.when(F.col("doc_id") % 5 == 0, F.replace("tagged_text", F.lit("nation:"), F.lit("nationx:"))).otherwise(F.col("tagged_text")))
    return registry.split_resolved(docs, w.registry(spark, d)).select("doc_id", F.size("resolved").alias("n_resolved"), _J("unresolved", ",").alias("unresolved"))


@query("label_candidates", _REGISTRY, sql=f"SELECT {_FOLD.format('label')} AS label, count(*) AS n, list_aggregate(list_sort(list_distinct(list(canonical_id))), 'string_agg', ',') AS ids FROM registry GROUP BY 1")
def label_candidates(spark, d):
    r = w.registry(spark, d)
    return registry.candidates(r).select("label", "n").join(registry.label_ids(r), "label").select("label", "n", _J("ids", ",").alias("ids"))


@query("plain_label_match", _REGISTRY, _DOCS, _LABELS, sql="SELECT doc_id, array_to_string(predicted, ',') AS predicted, CAST(open AS BIGINT) AS ambiguous FROM plain_res")
def plain_label_match(spark, d):
    return linking.plain(w.order_docs(spark, d), w.registry(spark, d)).select("doc_id", _J("predicted", ",").alias("predicted"), F.col("open").alias("ambiguous"))


_HITS = r"""hits AS (SELECT doc_id, label, unnest(list_filter(range(1, length(t) + 1), lambda i: substr(t, i, length(label)) = label
    AND NOT regexp_matches(CASE WHEN i = 1 THEN ' ' ELSE substr(t, i - 1, 1) END, '[\p{L}\p{N}_]') AND NOT regexp_matches(substr(t, i + length(label), 1), '[\p{L}\p{N}_]'))) AS i, n
  FROM (SELECT doc_id, lower(plain_text) AS t FROM order_docs) JOIN labels_ ON contains(t, label))"""


@query("gazetteer_detect", _REGISTRY, _DOCS, _LABELS, _HITS, sql='SELECT doc_id, label, CAST(i - 1 AS INTEGER) AS "start", CAST(i - 1 + length(label) AS INTEGER) AS "end" FROM hits')
def gazetteer_detect(spark, d):
    return linking.mentions(w.order_docs(spark, d), linking.label_kinds(w.registry(spark, d)).select("label")).select("doc_id", "label", "start", "end")


@query("gazetteer_link", _REGISTRY, _DOCS, _LABELS, _HITS, sql="""SELECT doc_id, h.label, CAST(i - 1 AS INTEGER) AS "start", CASE WHEN h.n = 1 THEN r.type END AS type, CASE WHEN h.n = 1 THEN r.key END AS key, CAST(h.n AS INTEGER) AS candidate_count
  FROM hits h JOIN (SELECT lower(label) AS label, min(type) AS type, min(key) AS key FROM registry GROUP BY 1) r USING (label)""")
def gazetteer_link(spark, d):
    return linking.link(w.order_docs(spark, d), w.registry(spark, d)).select("doc_id", "label", "start", "type", "key", "candidate_count")


@query("nearest_cue", sql="""SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 1 THEN 'nation' WHEN 2 THEN 'market' END AS type, CASE s_suppkey % 4 WHEN 1 THEN n_name WHEN 2 THEN 'M_' || n_name END AS key FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def nearest_cue(spark, d):
    docs, r = w.cue_docs(spark, d)
    return linking.link(docs, r).select("doc_id", "type", "key")


@query("set_score", _REGISTRY, _DOCS, _LABELS, sql="SELECT doc_id, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn FROM plain_scored")
def set_score(spark, d):
    return scoring.scored(linking.plain(w.order_docs(spark, d), w.registry(spark, d))).select("doc_id", "tp", "fp", "fn")


def _all(spark, d, names=("plain", "linker", "tagged")):
    docs, r = w.order_docs(spark, d), w.registry(spark, d)
    out = None
    for n in names:
        got = linking.condition(n)(docs, r)
        out = got if out is None else out.unionByName(got)
    return out


_SUMS = """sums AS (SELECT 'plain' AS condition, count(*) AS documents, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM plain_scored
  UNION ALL SELECT 'linker', count(*), 3 * count(*), 0, count(*) FROM order_docs UNION ALL SELECT 'tagged', count(*), 4 * count(*), 0, 0 FROM order_docs)"""


@query("micro_metrics", _REGISTRY, _DOCS, _LABELS, _SUMS, sql="""SELECT condition, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))), 6) AS f1 FROM sums""")
def micro_metrics(spark, d):
    return w.in_turn(spark, [lambda n=n: scoring.metrics(scoring.scored(_all(spark, d, (n,)))).select("condition", "tp", "fp", "fn", "precision", "recall", "f1") for n in ("plain", "linker", "tagged")])


@query("exact_match", _REGISTRY, _DOCS, _LABELS, sql="""SELECT 'plain' AS condition, count(*) AS documents, count(*) FILTER (WHERE fp = 0 AND fn = 0) AS exact FROM plain_scored UNION ALL SELECT 'tagged', count(*), count(*) FROM order_docs""")
def exact_match(spark, d):
    return scoring.metrics(scoring.scored(_all(spark, d, ("plain", "tagged")))).select("condition", "documents", "exact")


@query("cost_rollup", _REGISTRY, _DOCS, _LABELS, sql="""SELECT 'plain' AS condition, CAST(count(*) * (SELECT count(*) FROM labels_) AS BIGINT) AS label_scans, CAST(sum(found) AS BIGINT) AS registry_lookups, CAST(0 AS BIGINT) AS references_read, CAST(sum(toks) AS BIGINT) AS estimated_tokens FROM plain_res
  UNION ALL SELECT 'tagged', 0, 4 * count(*), 4 * count(*), sum(len(list_filter(regexp_split_to_array(tagged_text, '\\s+'), lambda x: x <> ''))) FROM order_docs""".replace("\\\\", "\\"))
def cost_rollup(spark, d):
    return scoring.costs(_all(spark, d, ("plain", "tagged"))).select("condition", "label_scans", "registry_lookups", "references_read", "estimated_tokens")


@query("canonical_name_mode", sql="""SELECT id, name FROM (SELECT user_id AS id, event_type AS name, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, lower(event_type), event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def canonical_name_mode(spark, d):
    return scoring.modal_names(w.table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name")))


@query("run_violations", _DOCS, sql="""SELECT '$.cases[' || doc_id || '].mentions[0]' AS location, CASE doc_id % 10 WHEN 0 THEN 'end must be greater than start' WHEN 1 THEN 'span exceeds plain_text' WHEN 2 THEN 'label does not match the plain_text span' WHEN 3 THEN 'unknown typed key' END AS message FROM order_docs WHERE doc_id % 10 < 4
  UNION ALL SELECT '$.cases[' || doc_id || ']', 'missing case' FROM order_docs WHERE doc_id % 10 = 4""")
def run_violations(spark, d):
    docs = w.order_docs(spark, d)
    cases, mentions = docs.select("doc_id", F.lit(1).alias("model_calls"), F.lit(1).alias("estimated_tokens")), w.spans(docs).filter("pos = 0").withColumn("idx", F.col("pos"))
    k = F.col("doc_id") % 10
    mentions = mentions.filter(k != 4).withColumns({"end": F.when(k == 0, 0).when(k == 1, 100_000).otherwise(F.col("end")), "label": F.when(k == 2, "other").otherwise(F.col("label")), "key": F.when(k == 3, "missing_one").otherwise(F.col("key"))})
    return runs.violations(cases.filter(k != 4), mentions, docs, w.registry(spark, d))


_KEPT = f"kept AS (SELECT * FROM spans WHERE ascii(substr(md5(doc_id || '|' || pos), 1, 1)) % 4 <> 0)"


@query("replay_score", _DOCS, _SPANS, _KEPT, sql="""SELECT 'recorded' AS condition, CAST(sum(n) AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(sum(4 - n) AS BIGINT) AS fn, count(*) FILTER (WHERE n = 4) AS exact FROM (SELECT d.doc_id, count(k.pos) AS n FROM order_docs d LEFT JOIN kept k USING (doc_id) GROUP BY 1)""")
def replay_score(spark, d):
    docs = w.order_docs(spark, d)
    return scoring.metrics(scoring.scored(runs.replayed(docs, *w.recorded(docs), w.registry(spark, d)))).select("condition", "tp", "fp", "fn", "exact")


_RANKED = "numbered AS (SELECT *, row_number() OVER (ORDER BY sha256(doc_id || '|' || s || '|' || e || '|' || type || '|' || key), doc_id, pos) AS n, count(*) OVER () AS total FROM spans)"
_COVER = "cover AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS coverage), picked AS (SELECT c.coverage, r.* FROM numbered r JOIN cover c ON r.n <= floor(total * CAST(c.coverage AS DOUBLE) + 0.5))"


@query("hash_rank_prefix", _DOCS, _SPANS, _RANKED, _COVER, sql="SELECT CAST(coverage AS DOUBLE) AS coverage, type, count(*) AS annotations, count(DISTINCT doc_id) AS documents FROM picked GROUP BY 1, 2")
def hash_rank_prefix(spark, d):
    return assistance.selected(w.spans(w.order_docs(spark, d))).groupBy("coverage", "type").agg(F.count("*").alias("annotations"), F.count_distinct("doc_id").alias("documents"))


@query("assist_curve", _DOCS, _SPANS, _RANKED, _COVER, _KEPT, sql="""SELECT CAST(coverage AS DOUBLE) AS coverage, CAST(sum(n) AS BIGINT) AS tp, CAST(sum(4 - n) AS BIGINT) AS fn, count(*) FILTER (WHERE n = 4) AS exact FROM (
  SELECT c.coverage, d.doc_id, count(DISTINCT u.pos) AS n FROM cover c CROSS JOIN order_docs d LEFT JOIN (SELECT coverage, doc_id, pos FROM picked UNION SELECT coverage, doc_id, pos FROM kept CROSS JOIN cover) u ON u.coverage = c.coverage AND u.doc_id = d.doc_id GROUP BY 1, 2) GROUP BY 1""")
def assist_curve(spark, d):
    docs = w.order_docs(spark, d)
    _, mentions = w.recorded(docs)
    return assistance.curve(docs, w.spans(docs), mentions, w.registry(spark, d)).select("coverage", "tp", "fn", "exact")


@query("entity_index", _REGISTRY, _DOCS, _REFS, sql="SELECT type, key, canonical_id, count(DISTINCT doc_id) AS documents, count(*) AS \"references\" FROM refs LEFT JOIN registry USING (type, key) GROUP BY 1, 2, 3")
def entity_index(spark, d):
    each = registry.exploded(w.order_docs(spark, d)).groupBy("type", "key", "doc_id").agg(F.count("*").alias("n"))
    sums = each.groupBy("type", "key").agg(F.count("*").alias("documents"), F.sum("n").alias("references"))
    return registry.resolve(sums, w.registry(spark, d)).select("type", "key", "canonical_id", "documents", "references")


_POSTINGS = """by_tags AS (SELECT DISTINCT canonical_id AS e, doc_id FROM refs JOIN registry USING (type, key)), by_gold AS (SELECT DISTINCT unnest(gold) AS e, doc_id FROM order_docs)"""


@query("index_equality", _REGISTRY, _DOCS, _REFS, _POSTINGS, sql="""SELECT count(*) FILTER (WHERE b.e IS NULL) AS only_tags, count(*) FILTER (WHERE a.e IS NULL) AS only_metadata, count(*) AS postings FROM by_tags a FULL JOIN by_gold b ON a.e = b.e AND a.doc_id = b.doc_id""")
def index_equality(spark, d):
    docs = w.order_docs(spark, d)
    a, b = (x.withColumn(c, F.lit(1)) for x, c in ((index.entity_postings(docs, w.registry(spark, d)), "a"), (index.metadata_postings(docs), "b")))
    both = a.join(b, ["entity_id", "doc_id"], "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_tags"), F.count_if(F.col("a").isNull()).alias("only_metadata"), F.count("*").alias("postings"))


_LITTLE = " || ".join(f"substr(lpad(to_hex(doc_id), 8, '0'), {i}, 2)" for i in (7, 5, 3, 1))


@query("index_fingerprint", _DOCS, sql=f"""SELECT entity_id, count(*) AS n, sha256(unhex(hex(encode(entity_id)) || '00' || lpad(to_hex(count(*)), 16, '0') || string_agg({_LITTLE}, '' ORDER BY doc_id))) AS sha256 FROM (SELECT unnest(gold) AS entity_id, doc_id FROM order_docs) GROUP BY 1""")
def index_fingerprint(spark, d):
    found = index.fingerprint(index.entity_postings(w.order_docs(spark, d), w.registry(spark, d)))
    return found.select("entity_id", F.col("n").cast("long").alias("n"), "sha256")


@query("entity_lookup_checksum", _DOCS, sql="""SELECT count(*) AS entities, CAST(sum(n + lo + hi) AS BIGINT) AS lookup, CAST(sum(n + s) AS BIGINT) AS scan FROM (SELECT e, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi, sum(doc_id) AS s FROM (SELECT unnest(gold) AS e, doc_id FROM order_docs) GROUP BY 1)""")
def entity_lookup_checksum(spark, d):
    return index.lookup_checksum(index.entity_postings(w.order_docs(spark, d), w.registry(spark, d)))


@query("idf_table", _LEX, sql="SELECT term, df, round(idf, 6) AS idf FROM weights")
def idf_table(spark, d):
    docs = w.table(spark, d, "documents")
    return index.idf(index.term_postings(docs), docs).select("term", "df", F.round("idf", 6).alias("idf"))


def _lexical(spark, d):
    docs = w.table(spark, d, "documents")
    postings = index.term_postings(docs)
    return w.questions(spark, d), postings, index.idf(postings, docs)


def _entities(spark, d):
    return w.table(spark, d, "documents").select(F.col("source").alias("entity_id"), "doc_id")


def _shown(ranking):
    return ranking.select("question_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


@query("lexical_topk", _LEX, sql=_top("lex"))
def lexical_topk(spark, d):
    return _shown(retrieval.lexical(*_lexical(spark, d)))


@query("tag_filtered_topk", _LEX, sql=_top("filt"))
def tag_filtered_topk(spark, d):
    return _shown(retrieval.filtered(*_lexical(spark, d), _entities(spark, d)))


@query("inferred_topk", _LEX, sql=_top("(SELECT * FROM filt WHERE question_id IN (SELECT question_id FROM status WHERE status = 'unique') UNION ALL SELECT * FROM lex WHERE question_id IN (SELECT question_id FROM status WHERE status <> 'unique'))"))
def inferred_topk(spark, d):
    q, postings, weights = _lexical(spark, d)
    return _shown(retrieval.inferred(q, registry.label_ids(w.groups(spark, d)), postings, weights, _entities(spark, d)))


_HYBRID = """boost AS (SELECT question_id, sum(idf) AS a FROM qterms GROUP BY 1), pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS r FROM lex) WHERE r <= 100),
hyb AS (SELECT coalesce(o.question_id, p.question_id) AS question_id, coalesce(o.doc_id, p.doc_id) AS doc_id, coalesce(o.own, p.score) AS score FROM pool p
  FULL JOIN (SELECT f.question_id, f.doc_id, round(f.score + coalesce(b.a, 0) + 1, 9) AS own FROM filt f LEFT JOIN boost b USING (question_id)) o ON o.question_id = p.question_id AND o.doc_id = p.doc_id)"""


@query("hybrid_topk", _LEX, _HYBRID, sql=_top("hyb"))
def hybrid_topk(spark, d):
    return _shown(retrieval.hybrid(*_lexical(spark, d), _entities(spark, d)))


@query("retrieval_metrics", _LEX, "top AS (" + _top("lex") + ")", sql="""SELECT count(*) AS questions, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_5, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0 END), 6) AS hit_k, round(avg(h / 10.0), 6) AS precision_k, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr_k
  FROM (SELECT q.question_id, min(CASE WHEN e.doc_id IS NOT NULL THEN rank END) AS f, count(e.doc_id) AS h FROM questions q LEFT JOIN top t USING (question_id) LEFT JOIN entities e ON e.entity_id = q.entity_id AND e.doc_id = t.doc_id GROUP BY 1)""")
def retrieval_metrics(spark, d):
    q, postings, weights = _lexical(spark, d)
    return retrieval.quality(retrieval.lexical(q, postings, weights), q, _entities(spark, d))


@query("label_resolution_summary", _LEX, sql="SELECT count(*) FILTER (WHERE status = 'unique') AS n_unique, count(*) FILTER (WHERE status = 'ambiguous') AS n_ambiguous, CAST(0 AS BIGINT) AS n_unresolved, round(count(*) FILTER (WHERE status = 'unique') / count(*), 6) AS coverage FROM status")
def label_resolution_summary(spark, d):
    known = retrieval.inference(w.questions(spark, d), registry.label_ids(w.groups(spark, d)))
    n = lambda s: F.count_if(F.col("status") == s)
    return known.agg(n("unique").alias("n_unique"), n("ambiguous").alias("n_ambiguous"), n("unresolved").alias("n_unresolved"), F.round(F.try_divide(n("unique"), F.count("*")), 6).alias("coverage"))


@query("nearest_rank_percentile", sql="SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def nearest_rank_percentile(spark, d):
    return w.table(spark, d, "events").groupBy("event_type").agg(*(text.nearest_rank("value", s).alias(f"p{round(100 * s)}") for s in (0.5, 0.95, 0.99)))


_GRAMS = """names AS (SELECT DISTINCT p_name AS name FROM part), words AS (SELECT name, ' ' || x || ' ' AS p FROM (SELECT name, unnest(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda x: x <> '')) AS x FROM names)),
grams AS (SELECT name, substr(p, i, n) AS gram FROM (SELECT name, p, n, unnest(CASE WHEN length(p) <= n THEN (CASE WHEN n = greatest(3, length(p)) THEN [1] ELSE [] END) ELSE range(1, length(p) - n + 2) END) AS i FROM words, (SELECT unnest([3, 4, 5]) AS n))),
tf AS (SELECT name, gram, count(*) AS n FROM grams GROUP BY 1, 2), dfs AS (SELECT gram, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT name, gram, (1 + ln(n)) * (ln(((SELECT count(*) FROM names) + 1.0) / (df + 1.0)) + 1) AS v FROM tf JOIN dfs USING (gram))""".replace("\\\\", "\\")


@query("char_ngram_tfidf", _GRAMS, sql="SELECT name, gram, round(v / sqrt(sum(v * v) OVER (PARTITION BY name)), 6) AS weight FROM raw")
def char_ngram_tfidf(spark, d):
    names = w.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    grams = vectors.char_ngrams(names, "name", "name")
    return vectors.tfidf(grams, "name", vectors.frequencies(grams, names)).select("name", "gram", F.round("weight", 6).alias("weight"))


@query("vector_cosine_argmax", sql="""WITH c AS (SELECT label, list_transform(list(embedding ORDER BY vec_id)[1], lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings GROUP BY label)
  SELECT vec_id, label AS candidate, round(s, 6) AS score FROM (SELECT vec_id, c.label, list_dot_product(v, m) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(m, m))) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, c.label) AS r
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) CROSS JOIN c) WHERE r = 1""")
def vector_cosine_argmax(spark, d):
    rows = w.table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    centres = rows.groupBy(F.col("label").alias("candidate")).agg(F.min_by("v", "vec_id").alias("m"))  # a row a label
    pairs = rows.select("vec_id", "v").crossJoin(F.broadcast(centres))
    scores = vectors.cosine_scores(pairs, "v", "m").select("vec_id", "candidate", F.round("score", 9).alias("score"))
    return vectors.best(scores, "vec_id", "candidate").select("vec_id", "candidate", F.round("score", 6).alias("score"))


@query("markup_overhead", _DOCS, sql="""SELECT CAST(sum(strlen(plain_text)) AS BIGINT) AS plain_bytes, CAST(sum(strlen(tagged_text)) AS BIGINT) AS tagged_bytes, CAST(sum(length(tagged_text) - length(plain_text)) AS BIGINT) AS added_characters, CAST(4 * count(*) AS BIGINT) AS "references", CAST(4 * count(*) AS BIGINT) AS pairs FROM order_docs""")
def markup_overhead(spark, d):
    return index.totals(w.order_docs(spark, d), w.registry(spark, d))


@query("page_titles", sql=r"SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda x: trim(x)), lambda x: x <> '')[1] AS title FROM conversations")
def page_titles(spark, d):
    return w.table(spark, d, "conversations").select("conv_id", "turn", text.title(F.col("text")).alias("title"))


@query("mention_contexts", _DOCS, _SPANS, sql="SELECT doc_id, pos, substr(plain_text, greatest(0, s - 160) + 1, e + 160 - greatest(0, s - 160)) AS context FROM spans JOIN order_docs USING (doc_id)")
def mention_contexts(spark, d):
    docs = w.order_docs(spark, d)
    return w.spans(docs).join(docs.select("doc_id", "plain_text"), "doc_id").select("doc_id", "pos", text.context(F.col("plain_text"), F.col("start"), F.col("end")).alias("context"))
