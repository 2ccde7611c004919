"""The training-data operators against libraries, brute force and round trips on small fixtures."""

import collections
import hashlib
import random
import re
import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from refloom.llm import benchmark_leaks, common, learn, ordinal_quality, piece_bpe, similar_texts, simhash_dedup, toxicity_chain, two_pass_shards, url_rules, voronoi_topk, warc_archive, word_bpe_count

ODD = [None, "", " ", "  a  b ", "x" * 500, " " * 70 + "y", "né\n▁漢字😀", "<s> <0x0A> <|endoftext|> <|EndOfText|> İΣ", "it's 'LL 123 !!", "\x1c\x85　z", "The quick brown fox " * 40]


def documents(spark, texts, extra=True):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    return df if extra else df.drop("fp")


def test_sentencepiece_equals_the_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    random.seed(3)
    texts = ODD + ["".join(random.choices(["a", "the", " ", "  ", "ing", "é", "漢", "\n", "▁", "😀", "<s>"], k=25)) for _ in range(200)]
    got = {r.doc_id: r for r in piece_bpe.digest_documents(documents(spark, texts), path).collect()}
    ids = {r.doc_id: r.ids for r in piece_bpe.encode_documents(documents(spark, texts), path).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    bpe = piece_bpe.encoder(open(path, "rb").read())
    for i, t in enumerate(texts):
        want = sp.encode(t or "")
        assert (ids[i], got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (want, len(want), sha(",".join(map(str, want))), sha(sp.decode(want)))
        odd = [random.randrange(300) for _ in range(9)]
        assert bpe.decode(odd) == sp.decode(odd)
    assert piece_bpe.digest_documents(documents(spark, []), path).count() == 0


def test_sentencepiece_cuts_no_piece_after_a_sign_that_counts_as_a_letter():
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, bpe = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.encoder(open(path, "rb").read())
    ends = [p[-2:] for p in bpe.ids if len(p) > 1 and p[-1] in string.punctuation]
    for t in ["Area: 25 km². Next", "10 m².", "ab².", "²."] + [f"{a}{e}{b}" for e in ends for a in ("", "ab", "x ") for b in ("", " y")]:
        assert bpe.encode(t) == sp.encode(t), t


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    for r in word_bpe_count.count_tokens(documents(spark, ODD), path, limit=20).collect():
        want = len(library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want, len((ODD[r.doc_id] or "").encode()), want > 20)


def test_warc_round_trip_and_determinism(spark, tmp_path):
    big = "é" * 60
    rows = [(5, "http://a/ b", big, 1), (3, None, big, 1), (3, "http://c", big, 1), (9, "u", big, 1), (None, "u", big, 1), (7, "u", None, 1), (8, "u", "", 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", "z" * 5000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, shard int")
    folders = [warc_archive.write_archive(p, f"file://{tmp_path}/{k}", shard_bytes=400, roll_bytes=300) for k, p in enumerate((pages, pages.repartition(3)))]
    got = warc_archive.read_archive(spark, folders[0], payloads=True).collect()
    assert len(got) == len(rows) and collections.Counter(r.record_type for r in got) == {"response": 7, "revisit": 3}
    assert sorted((r.page_id, r.refers_to) for r in got if r.record_type == "revisit") == [(3, 3), (5, 3), (9, 3)]
    assert {r.payload_digest for r in got} == {hashlib.sha256((x[2] or "").encode()).hexdigest() for x in rows}
    assert all(r.payload_bytes == len(r.payload) for r in got if r.payload is not None)
    manifests = ["".join(sorted(r.value + "\n" for r in spark.read.text(f"{f}/MANIFEST.jsonl").collect())) for f in folders]
    assert manifests[0] == manifests[1] and manifests[0].count("\n") > 1
    empty = warc_archive.write_archive(pages.limit(0), f"file://{tmp_path}/e")
    assert warc_archive.read_archive(spark, empty).count() == 0


def brute_components(texts, linked):
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(texts)):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in range(len(texts))}


def test_simhash_components(spark):
    random.seed(5)
    base = [" ".join(random.choices("alpha beta gamma delta eps zeta".split(), k=60)) for _ in range(6)]
    texts = ODD + [b.replace("alpha", "omega", random.randrange(4)) for b in base for _ in range(6)] + base
    prints = [simhash_dedup.simhash((t or "").encode()) for t in texts]
    want = brute_components(texts, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = simhash_dedup.near_duplicates(documents(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == dict(enumerate(prints))
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_buckets_dealt_out_again_find_the_same(spark):
    random.seed(6)
    prints = list({random.getrandbits(3) << 60 ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) for _ in range(150)})
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    want = brute_components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for bucket in (4096, 3):
        got = {r.node: r.component for r in common.components(simhash_dedup.links(fps, bucket)).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_components_and_hot_joins(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(200, 260)] + [(7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long").repartition(8)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {k: 100 for k in range(200, 260)}
    rows = spark.createDataFrame([(1,)] * 50 + [(2,), (None,)], "k long")
    groups = spark.createDataFrame([(1, 50, "a"), (3, 1, "c")], "k long, n_rows long, v string")
    assert collections.Counter(r.v for r in common.join_groups(rows, groups, "k", 52, "left").collect()) == {"a": 50, None: 2}


def test_similar_texts_at_four_fifths(spark):
    random.seed(8)
    words = [f"w{k}" for k in range(400)]
    base = [random.choices(words, k=200) for _ in range(8)]
    texts = [" ".join(b) for b in base]
    texts += [" ".join(b[:90] + ["new"] + b[91:]) for b in base] + texts[:3] + [None, ""]
    kept = similar_texts.drop_duplicates(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(8), len(texts) - 2] and kept.columns == ["doc_id", "text", "fp"]


def test_links_are_similarities_of_four_fifths_exactly(spark):
    texts, want = [], []
    for k, shared in enumerate([220, 221, 222, 223, 225, 227] * 6):  # of 250 distinct shingles each: 0.786, 0.792, 0.798, 0.805, 0.818, 0.832
        words = [f"w{k}_{i}" for i in range(254)]
        want += [len(texts)] + [len(texts) + 1] * (9 * shared < 8 * 250)
        texts += [" ".join(words), " ".join(words[:shared + 4] + [f"x{k}_{i}" for i in range(250 - shared)])]
    chain = [" ".join(f"c{i}" for i in range(at, at + 254)) for at in range(0, 250, 25)]  # each like the next two at most
    sets = [{tuple(w[i : i + 5]) for i in range(250)} for w in map(str.split, chain)]
    root = brute_components(chain, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    want += sorted({root[i] + len(texts) for i in root})
    assert sorted(r.doc_id for r in similar_texts.drop_duplicates(documents(spark, texts + chain)).collect()) == want


def test_families_round_four_fifths_equal_brute_force(spark):
    random.seed(12)
    texts = []
    for f in range(6):
        base = [f"w{f}_{i}" for i in range(150)]
        for _ in range(25):
            at, n = random.randrange(130), random.randrange(4, 20)
            texts.append(" ".join(base[:at] + [f"x{random.random()}" for _ in range(n)] + base[at + n :]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    want = brute_components(texts, similar)
    assert {r.doc_id: r.component_id for r in similar_texts.groups(documents(spark, texts)).collect()} == want
    shingles = [np.array([hash(x) for x in s], np.int64).view(np.uint64).tobytes() for s in sets]
    rows = [(k // 25, k if k % 3 else k // 9 * 1000, k, x) for k, x in enumerate(shingles)]
    cut = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 40])], ["cluster", "part", "whole", "shingles"]) for i in range(0, len(rows), 40)]
    linked = {(a, b) for batch in similar_texts._compare(cut) for a, b in zip(*batch.to_pydict().values())}
    assert all(similar(a, b) for a, b in linked)
    joined = lambda a, b: rows[a][:2] == rows[b][:2]
    assert brute_components(texts, lambda a, b: joined(a, b) or (a, b) in linked or (b, a) in linked) == brute_components(texts, lambda a, b: joined(a, b) or similar(a, b))


def test_texts_of_a_repeated_doc_id_are_judged_apart(spark):
    alone, shared, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, shared), (2, shared), (2, alone), (2, alone), (3, other), (3, other.upper()), (4, None), (4, ""), (None, shared), (5, alone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in similar_texts.drop_duplicates(docs.repartition(3)).collect()]
    assert {x for x in kept if x[0] not in (3, 4)} == {(1, shared), (2, alone), (None, shared)}
    assert sorted(x[0] or 0 for x in kept) == [0, 1, 2, 3, 4] and (2, alone) in kept


def test_signatures_of_long_texts_that_share_nothing_differ():
    texts = [" ".join(f"{c}{k}" for k in range(100_000)) for c in "ab"]
    docs = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([t.encode() for t in texts])], ["doc_id", "text"]).append_column("exact", pa.array([0, 1]))
    a, b = (np.frombuffer(x.as_py(), np.uint8).reshape(similar_texts.SIGNATURE, -1) for x in next(similar_texts._sketches([docs])).column("signature"))
    assert (a == b).all(axis=1).sum() <= 8


def test_shards(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 7 == 0 else i, "" if i % 5 else None, i) for i in range(300)], "doc_id long, text string, slot int")
    again = [[(r.doc_id, r.shard, r.slot) for r in two_pass_shards.digest(two_pass_shards.read_shards(spark, two_pass_shards.write_shards(d, str(tmp_path / f"s{k}"), shards=7, bucket_bytes=900), docs)).orderBy("shard", "slot").collect()] for k, d in enumerate((docs, docs.repartition(5)))]
    sizes = collections.Counter(s for _, s, _ in again[0])
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7
    assert [x[1:] for x in again[0]] == [(s, k) for s in range(7) for k in range(sizes[s])]
    assert again[0] == again[1]
    assert collections.Counter(x[0] for x in again[0]) == collections.Counter(r.doc_id for r in docs.collect())
    row = two_pass_shards.digest(two_pass_shards.read_shards(spark, two_pass_shards.write_shards(documents(spark, ["é"]), str(tmp_path / "one")), documents(spark, ["é"]))).first()
    assert (row["size"], row.text_crc32, row.law, row.slot, row.grown_shard) == (18, zlib.crc32("é".encode()), "rows", 0, None)


def test_leaks_equal_brute_force(spark):
    random.seed(9)
    vocabulary = [f"t{k}" for k in range(60)]
    make = lambda n: random.choices(vocabulary, k=n)
    items = [make(30), make(55), ["one", "two"], make(12) * 3, []]
    texts = ["", None] + [" ".join(make(40)) for _ in range(10)]
    for it in items[:4]:
        for cut in (0, 1, 2, 3):
            body = it[cut:] if cut < 3 else [*it[: len(it) // 2], "odd", *it[len(it) // 2 + 1 :]]
            texts += [" ".join([*make(20), *body, *make(9)]), " ".join(body).upper() + "!"]
    docs, bench = documents(spark, texts), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want, sh = {}, lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]
    for d, t in enumerate(texts):
        words = re.findall(r"[^\W_]+", (t or "").lower())
        for i, it in enumerate(items):
            c = collections.Counter(sh(it))
            for s in range(len(words) - len(it) + 1 if it else 0):
                n = sum((collections.Counter(sh(words[s : s + len(it)])) & c).values())
                j = n / (2 * sum(c.values()) - n)
                if j >= 0.8 and j > want.get((d, i), 0):
                    want[d, i] = j
    got = {(r.doc_id, r.item_id): r.similarity for r in benchmark_leaks.leaks(docs, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 10
    assert benchmark_leaks.leaks(docs, bench.limit(0)).count() == 0 and benchmark_leaks.leaks(docs.limit(0), bench).count() == 0


def test_whole_documents_shorter_than_an_item_leak(spark):
    items = [[f"t{k}n{i}" for i in range(m)] for k, m in enumerate((30, 60, 9, 5))]
    texts = [" ".join(it[a : len(it) - b]) for it in items for a in range(8) for b in range(8) if a + b < len(it)] + ["", None]
    docs, bench = documents(spark, texts), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    want, sh = {}, lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for d, t in enumerate(texts):
        words = (t or "").split()
        for i, it in enumerate(items):
            a, b = sh(words), sh(it)
            if words and len(a & b) / len(a | b) >= 0.8:
                want[d, i] = (len(words), len(a & b) / len(a | b))
    got = {(r.doc_id, r.item_id): (r.n_words, pytest.approx(r.similarity)) for r in benchmark_leaks.leaks(docs, bench, short=True).collect()}
    assert got == want and any(n < 60 for n, _ in want.values())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    vectors += [(300, None), (320, [1.0, float("nan")]), (340, [1.0]), (360, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    q = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors if i is not None and v is not None and np.isfinite(v).all()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {(i, r + 1): (j, s) for i in q if i % 20 == 0 for r, (s, j) in enumerate(sorted(((dot(q[i], q[j]), j) for j in q if j != i), key=lambda x: (-x[0], x[1]))[:20])}
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in voronoi_topk.top_k(df).collect()} == want
    assert voronoi_topk.top_k(df.limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["http://WWW.Example.com:80/en/1?q", "https://a.example.com/en/x#f", "http://com", "http://x.com/a", "y.net/es/", None, "http://z.net/es/1", "http://z.net/de/1", "ftp://net/fr/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [(("one de",), "block", 0.9, 0.1), (("one de", "tld net"), "allow", 0.95, 0.1)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got == {0: ("www.example.com:80", "/en/1", None, "allow"), 1: ("a.example.com", "/en/x", "example.com/en/", "block"), 2: ("com", "", None, "allow"), 3: ("x.com", "/a", "com/", "allow"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("z.net", "/es/1", "net/es/", "block"), 7: ("z.net", "/de/1", None, "allow"), 8: ("net", "/fr/", "net/fr/", "block")}
    many = spark.createDataFrame([(i, f"http://h{i}.net/{'es' if i % 2 else 'it'}/{i}") for i in range(60)] + [(99, "http://h.org/es/1")], "page_id long, url string")
    mined = url_rules.mine(url_rules.prepare(many))
    assert (("one es",), "block", 1.0) in [r[:3] for r in mined]
    assert {r.page_id: r.verdict for r in url_rules.judge(many).collect()}[99] == "block"
    assert url_rules.judge(many.limit(0)).count() == 0


def brute_best(tokens, rules):
    return next((k for k, (t, *_) in enumerate(rules) if set(t) <= set(tokens)), None)


def test_rule_index_equals_a_scan():
    random.seed(2)
    rules = [(tuple(sorted(random.sample("abcdefgh", random.randint(1, 3)))), "block", 1.0, 0.1) for _ in range(40)]
    inverted = url_rules.index(rules)
    for _ in range(200):
        have = random.sample("abcdefgh", random.randint(0, 5))
        assert url_rules.best_rule(have, inverted) == brute_best(have, rules)


def labelled(spark):
    random.seed(11)
    rows, labels = [], []
    for i in range(240):
        words = random.choices("the a of red blue green walk run see tree house".split(), k=40)
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            words[5] = random.choice(["idiot", "scum", "pathetic"])
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_classifiers_on_held_out_rows(spark):
    docs, labels, known = labelled(spark)
    train = labels.filter("doc_id < 160")
    odd = spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string")
    chain, model = toxicity_chain.fit(docs, train), ordinal_quality.fit(docs, train)
    toxic = {r.doc_id: r.toxic for r in toxicity_chain.judge(docs.union(odd), chain).collect()}
    keep = {r.doc_id: r.keep for r in ordinal_quality.judge(docs.union(odd), model).collect()}
    assert all(toxic[i] == bool(t) and keep[i] == bool(q) for i, q, t in known if i >= 160)
    assert not toxic[1000] and toxic[1000] == toxic[1001] and keep[1000] == keep[1001]
    assert np.all(np.diff(model.thresholds) > 0)
    assert {r.doc_id for r in toxicity_chain.select(docs, chain).collect()} == {i for i, t in toxic.items() if not t and i < 1000}
    assert {r.doc_id for r in ordinal_quality.select(docs, model).collect()} == {i for i, k in keep.items() if k and i < 1000}
    nothing = labels.limit(0)
    assert all(r.keep for r in ordinal_quality.judge(docs, ordinal_quality.fit(docs, nothing)).collect())
    assert not any(r.toxic for r in toxicity_chain.judge(docs, toxicity_chain.fit(docs, nothing)).collect())


def test_chain_links_see_out_of_fold_probabilities():
    words = [dict.fromkeys([1, 2] if i % 3 == 0 else [2, 3], 1.0) for i in range(60)]
    y = np.array([[i % 3 == 0, i % 3 == 0] for i in range(60)], int)
    chain = toxicity_chain.Chain(words, y)
    assert len(chain.links[0].before) == 0 and len(chain.links[1].before) == 1
    assert chain.judge({1: 1.0, 2: 1.0})[1] > 0.5 > chain.judge({2: 1.0, 3: 1.0})[1]


def test_gradients_of_the_ordinal_model():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    grade = np.digitize(x @ [1.0, -2.0, 0.0] + rng.logistic(size=400), [-1.0, 1.5])
    w, th = learn.fit_ordinal(x, grade, 3, ridge=0.01)
    assert np.allclose(w, [1, -2, 0], atol=0.35) and np.allclose(th, [-1, 1.5], atol=0.4)


def test_pipeline_equals_its_parts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = common.cut(stage(spark, docs, d), "t")
        assert new.columns == docs.columns and new.join(docs, "doc_id", "left_anti").isEmpty() and 0 < new.count() <= docs.count(), name
        docs = new
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert ids.count() == docs.count()
    assert corpus_pipeline.run(spark, d).agg(F.sum("n_tokens")).first() == ids.agg(F.sum("n_tokens")).first()
