"""Edge cases of every operator: null ids, repeated rows, ties, very long texts, clashing columns, empty tables."""

import collections
import itertools
import random
import string
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from refloom.llm import benchmark_leaks, common, learn, ordinal_quality, piece_bpe, queries, similar_texts, simhash_dedup, toxicity_chain, two_pass_shards, url_rules, voronoi_topk, warc_archive, word_bpe_count

PIECE, WORD = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json"))
LONG = " ".join(f"word{i % 977} naïve {i}" for i in range(30_000))
CLASH = "doc_id long, text string, fp long, n_tokens string, bucket int, h int, words string, row int, toxic string, grade string, key int, label string"
TEXTS = [(1, LONG), (1, LONG), (None, "a null id"), (None, "a null id"), (2, None), (3, ""), (4, "one"), (4, "another text of the same id"), (5, "x" * 100_000)]


def clashing(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, 7, "n", 1, 2, "w", 3, "t", "g", 4, "l") for i, t in rows], CLASH)


def test_tokenizers_on_edges(spark):
    docs = clashing(spark)
    sp, library = sentencepiece.SentencePieceProcessor(model_file=PIECE), tokenizers.Tokenizer.from_file(WORD)
    want = collections.Counter((i, len(sp.encode(t or "")), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    pieces = collections.Counter((r.doc_id, r.n_tokens) for r in piece_bpe.digest_documents(docs, PIECE).collect())
    assert pieces == collections.Counter(x[:2] for x in want.elements())
    assert collections.Counter((r.doc_id, len(r.ids)) for r in piece_bpe.encode_documents(docs, PIECE).collect()) == pieces
    assert collections.Counter((r.doc_id, r.n_tokens) for r in word_bpe_count.count_tokens(docs, WORD).collect()) == collections.Counter((i, n) for i, _, n in want.elements())
    assert word_bpe_count.count_tokens(docs.limit(0), WORD).count() == 0


def test_pieces_at_every_letter_and_mark():
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=PIECE), piece_bpe.encoder(open(PIECE, "rb").read())
    random.seed(1)
    alphabet = sorted(bpe.alphabet)
    texts = ["".join(f"{c}{m} ab{c}{m}{random.choice(alphabet)} " for m in string.punctuation) for c in alphabet]
    texts += ["".join(random.choices(alphabet + list(" .,;:!?²³¹½₂'"), k=200)) for _ in range(200)]
    for t, want in zip(texts, sp.encode(texts)):
        assert bpe.encode(t) == want, t
    for t in texts[::17]:
        assert bpe.decode(bpe.encode(t)) == sp.decode(sp.encode(t))


def test_counts_of_random_strings_equal_the_library():
    model, library = word_bpe_count.WordBPE(open(WORD, encoding="utf-8").read()), tokenizers.Tokenizer.from_file(WORD)
    random.seed(2)
    signs = list("abcXYZ019'.,!?-_<|>  \t\n\r\x85　éßİΣςñ漢😀́") + ["<|endoftext|>", "'s", "'LL", "<|startoftext|>"]
    for t in ("".join(random.choices(signs, k=random.randrange(40))) for _ in range(3000)):
        assert model.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_simhash_on_edges(spark):
    got = simhash_dedup.near_duplicates(clashing(spark)).collect()
    prints = {t: simhash_dedup.simhash((t or "").encode()) for _, t in TEXTS}
    assert collections.Counter((r.doc_id, r.fp & (1 << 64) - 1) for r in got) == collections.Counter((i, prints[t]) for i, t in TEXTS)
    assert all((r.component_id is None) == (r.doc_id is None) for r in got) and {r.component_id for r in got if r.doc_id in (2, 3)} == {2}


def test_simhash_bits_over_the_border_of_a_chunk(monkeypatch):
    words = [f"w{i % 911}" for i in range(1000)]
    whole = simhash_dedup.simhash(" ".join(words).encode())
    for size in (7, 998, 999, 1000):
        monkeypatch.setattr(simhash_dedup, "_CHUNK", size)
        assert simhash_dedup.simhash(" ".join(words).encode()) == whole


def test_a_pair_in_a_crowded_bucket_is_linked(spark):
    random.seed(1)
    prints = [1, 1 << 32 | 1 << 48 | 1, *{random.getrandbits(32) << 32 | 1 for _ in range(5000)} - {1, 1 << 32 | 1 << 48 | 1}]
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    a = np.array(prints, np.uint64)
    want = {(i, int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1}
    for bucket in (simhash_dedup.BUCKET, 40):  # the second reaches all three levels
        found = common.components(simhash_dedup.links(fps, bucket)).collect()
        component = {r.node: r.component for r in found}
        assert (0, 1) in want and all(component[i] == component[j] for i, j in want)
        assert len(component) == len({x for pair in want for x in pair})


def test_similar_texts_on_edges(spark):
    kept = collections.Counter((r.doc_id, r.text) for r in similar_texts.drop_duplicates(clashing(spark)).collect())
    assert kept[(None, "a null id")] == 2 and kept[(1, LONG)] == 1 and kept[(4, "one")] == 1 and kept[(4, "another text of the same id")] == 1
    assert similar_texts.drop_duplicates(clashing(spark).limit(0)).count() == 0


def test_shingle_sets_of_long_texts_are_not_broadcast(spark):
    texts = [" ".join(f"w{k}x{i}" for i in range(20_000)) for k in range(15)]
    docs = spark.createDataFrame([(k * 100 + j, f"{t} copy {j}") for k, t in enumerate(texts) for j in range(3 if k else 80)], "doc_id long, text string").repartition(8)
    conf = {"spark.sql.maxBroadcastTableSize": "8m", "spark.sql.autoBroadcastJoinThreshold": "256k"}  # 122 sets of 160 kB
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert sorted(r.doc_id for r in similar_texts.drop_duplicates(docs).select("doc_id").collect()) == [k * 100 for k in range(15)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_wide_join_equals_the_plain_one(spark):
    rows = [(k, i) for k, n in ((1, 1000), (2, 65), (3, 64), (4, 3), (5, 1), (None, 70)) for i in range(n)]
    a = spark.createDataFrame(rows, "k long, i long")
    groups = a.filter("k <> 4").groupBy("k").count().withColumnRenamed("count", "n_rows").withColumn("wide", F.repeat(F.col("k").cast("string"), F.lit(9)))
    got = common.join_wide(a, groups, "k", len(rows), ["i"]).select("k", "i", "n_rows", "wide")
    assert sorted(map(tuple, got.collect())) == sorted((k, i, n, str(k) * 9) for k, i in rows if k not in (None, 4) for n in [sum(x == k for x, _ in rows)])


def test_toxicity_sample_reaches_the_driver_packed(spark):
    random.seed(3)
    vocabulary = ["".join(random.choices(string.ascii_lowercase, k=6)) for _ in range(3000)]
    texts = [" ".join(random.sample(vocabulary, 1500)) + " idiot" * (i % 5 == 0) for i in range(300)]
    docs, labels = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    tracemalloc.start()
    chain = toxicity_chain.fit(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6, most  # over half a million hashes and values
    known = {h: k for k, h in enumerate(sorted({h for t in texts for h in toxicity_chain.word_hashes(t)}))}
    rows, y = [sorted(toxicity_chain.word_hashes(t).items()) for t in texts], np.array([[i % 5 == 0] * 4 for i in range(300)], int)
    packed = toxicity_chain._Presence(np.array(sorted(known), np.int64), [np.array([known[h] for h, _ in r]) for r in rows], [np.array([v for _, v in r]) for r in rows])
    assert [link.words for link in toxicity_chain.Chain(packed, y).links] == [link.words for link in toxicity_chain.Chain([dict(r) for r in rows], y).links]
    assert chain.judge(toxicity_chain.word_hashes(texts[0]))[-1] > 0.5 > chain.judge(toxicity_chain.word_hashes(texts[1]))[-1]


def test_classifiers_on_edges(spark):
    docs = clashing(spark)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 1), (None, 1, 1), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    chain, model = toxicity_chain.fit(docs, labels), ordinal_quality.fit(docs, labels)
    ids = collections.Counter(i for i, _ in TEXTS)
    assert collections.Counter(r.doc_id for r in toxicity_chain.judge(docs, chain).collect()) == collections.Counter(r.doc_id for r in ordinal_quality.judge(docs, model).collect()) == ids
    assert toxicity_chain.select(docs, chain).columns == ordinal_quality.select(docs, model).columns == docs.columns
    nothing = docs.limit(0)
    assert toxicity_chain.judge(nothing, toxicity_chain.fit(nothing, labels)).count() == ordinal_quality.judge(nothing, ordinal_quality.fit(nothing, labels.limit(0))).count() == 0
    many = spark.createDataFrame([(1, f"text {i}") for i in range(500)], "doc_id long, text string")
    assert learn.labelled_sample(many, labels, ["toxic"]).count() == 1


def test_sparse_rows_multiply_as_dense_ones():
    rng = np.random.default_rng(3)
    dense = rng.normal(size=(20, 9)) * (rng.random((20, 9)) < 0.3)
    sparse = learn.Sparse([np.flatnonzero(r).astype(np.int32) for r in dense], [r[r != 0] for r in dense], 9)
    w, r = rng.normal(size=9), rng.normal(size=20)
    assert np.allclose(sparse @ w, dense @ w) and np.allclose(sparse.T @ r, dense.T @ r) and sparse.shape == dense.shape


def test_shards_on_edges(spark, tmp_path):
    rows = [(None, None)] * 900 + [(i, "y" * i) for i in range(300)] + [(7, LONG)] * 3
    docs = clashing(spark, rows).withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("v", F.parse_json(F.lit('{"a": 1}')))
    seen = []
    for k, d in enumerate((docs, docs.repartition(5))):
        got = two_pass_shards.digest(two_pass_shards.read_shards(spark, two_pass_shards.write_shards(d, str(tmp_path / f"s{k}"), bucket_bytes=3000), docs)).collect()
        seen.append(sorted((r.shard, r.slot, r.doc_id is None, r.doc_id or 0, r.text_crc32) for r in got))
    counts = collections.Counter(x[0] for x in seen[0])
    assert seen[0] == seen[1] and len(seen[0]) == len(rows) and len(counts) == 40 and max(counts.values()) - min(counts.values()) <= 1
    assert max(sum(x[2] for x in seen[0] if x[0] == s) for s in range(40)) < 30  # the copies lie in all shards
    assert two_pass_shards.digest(two_pass_shards.read_shards(spark, two_pass_shards.write_shards(docs.limit(0), str(tmp_path / "e")), docs)).count() == 0


def test_leaks_on_edges(spark):
    item = " ".join(f"word{i % 977} naïve {i}" for i in range(50, 80))
    bench = spark.createDataFrame([(1, item, 5), (None, item, 5), (1, item, 5), (2, None, 5)], "item_id long, text string, w int")
    got = collections.Counter((r.doc_id, r.item_id, r.similarity) for r in benchmark_leaks.leaks(clashing(spark), bench, short=True).collect())
    assert got == {(1, 1, 1.0): 2, (1, None, 1.0): 2}


def test_top_k_on_ties_and_repeated_rows(spark):
    rows = [(i, [1.0, 0.0], 9) for i in range(60)] + [(3, [1.0, 0.0], 9)] * 5 + [(20, [0.5, 0.5], 9), (None, [1.0, 1.0], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cell int")
    q = {i: min([int(64 * x) for x in v] for j, v, _ in rows if j == i) for i in (0, 20, 40)}
    for query, v in q.items():
        scores = sorted((-sum(int(64 * x) * y for x, y in zip(e, v)), i) for i, e, _ in rows if i is not None and i != query)[:20]
        got = voronoi_topk.top_k(df).filter(F.col("query_id") == query).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in scores]


def test_urls_on_edges(spark):
    urls = [(1, None), (1, None), (None, "http://a.com/x"), (2, "http://" + "a" * 50_000 + ".net/es/"), (3, "://"), (4, "")]
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in urls], "page_id long, url string, path string, rule string, tokens string")
    got = collections.Counter((r.page_id, r.rule, r.verdict) for r in url_rules.judge(pages, []).collect())
    assert got == {(1, None, "allow"): 2, (None, "com/", "allow"): 1, (2, "net/es/", "block"): 1, (3, None, "allow"): 1, (4, None, "allow"): 1}


def test_mined_rules_equal_brute_force(spark):
    random.seed(4)
    rows = [(i, f"u{i}", random.sample("abcde", random.randint(1, 4)), random.choice(["allow", "block", "block"])) for i in range(80)]
    mined = url_rules.mine(spark.createDataFrame(rows, "page_id long, url string, tokens array<string>, label string"), 0.05, 0.7)
    strong = {}
    for n in (1, 2, 3):
        for t in itertools.combinations("abcde", n):
            have = [l for _, _, x, l in rows if set(t) <= set(x)]
            for label in ("allow", "block"):
                hits = have.count(label)
                if hits / 80 >= 0.05 and hits / len(have) >= 0.7:
                    strong[t, label] = (round(hits / len(have), 9), round(hits / 80, 9))
    below = lambda t, l: max((strong[s, l][0] for n in range(1, len(t)) for s in itertools.combinations(t, n) if (s, l) in strong), default=0)
    assert {(t, l): (c, s) for t, l, c, s in mined} == {(t, l): v for (t, l), v in strong.items() if v[0] > below(t, l)}


def test_warc_of_null_and_repeated_ids(spark, tmp_path):
    body = "z" * 150
    rows = [(None, f"u{i}", f"{i}" * 120) for i in range(40)] + [(5, f"v{i}", f"{i}{body}") for i in range(40)] + [(5, "same", body)] * 3 + [(6, "same", body), (7, "long", LONG)]
    pages = spark.createDataFrame([(i, u, h, "d") for i, u, h in rows], "page_id long, url string, html string, digest string")
    folder = warc_archive.write_archive(pages, f"file://{tmp_path}/w", shard_bytes=1000)
    got = warc_archive.read_archive(spark, folder).collect()
    assert len(got) == len(rows) and collections.Counter(r.record_type for r in got) == {"response": 82, "revisit": 3}
    assert {(r.page_id, r.refers_to) for r in got if r.refers_to is not None} == {(5, 5), (6, 5)}
    files = [r.name for r in spark.read.json(f"{folder}/MANIFEST.jsonl").collect()]
    assert len({f[:10] for f in files}) > 10  # neither the null ids nor the repeated one are one shard


def test_scratch_tables_go_and_kept_ones_stay(spark):
    with common.scratch(spark):
        gone, kept = common.cut(spark.range(3).toDF("x"), "gone"), common.cut(spark.range(4).toDF("x"), "kept", keep=True)
    assert kept.count() == 4
    with pytest.raises(Exception):
        gone.collect()


def test_queries_read_whole_tables():
    assert {"op1_warc", "op6_sharding", "url_host_path_rule"} <= set(queries.QUERIES) and set(queries.ORACLES) <= set(queries.QUERIES)
