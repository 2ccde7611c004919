"""Near-duplicate removal for the pipeline: texts that share 0.8 of their five-word shingles, found by SimHash and MinHash.

Such texts differ in up to about 14 of 64 SimHash bits, far beyond what Hamming balls can be enumerated for. So operator
4's pairs of at most 3 bits are completed by MinHash: each distinct text has a signature of SIGNATURE minima, whose first
BANDS * ROWS form band keys (a pair of similarity 0.8 shares one but for once in some 30 million by estimate). The texts
of a band meet in one stream; breadth-first searches at falling agreement of the signatures emit forests of candidates,
not all pairs. All candidates, SimHash's too (texts of 3 bits are at times below 0.8), are verified on the real shingle
sets; where one fails, its cluster is compared whole, so that a link is a similarity of 0.8 and no estimate.

Exact copies are one text from the start, so a hot text is one row. Defined cases: texts without words are copies of one
another; a null doc_id is kept and links to nothing; of rows equal in doc_id and text one
stays; empty tables stay empty.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_rows, join_groups, join_wide, scratch, small_batches
from .simhash_dedup import links

WIDTH, SIMILARITY, SIGNATURE, BANDS, ROWS = 5, 0.8, 128, 24, 3
#: Agreements of signatures at which forests of candidates are made; the last one is five deviations below SIMILARITY.
LEVELS = (0.9, 0.8, 0.6)
_STEP = 4096
#: Odd multipliers and offsets of the permutations, from a fixed seed.
_A, _B = np.random.default_rng(42).integers(1 << 62, size=(2, SIGNATURE, 1)).astype(np.uint64) | np.uint64(1)


def _shingles(words: list[bytes]):
    """Hashes of a text's shingles, in parts."""
    for at in range(0, max(1, len(words) - WIDTH + 1) if words else 0, _STEP):
        part = words[at : at + _STEP + WIDTH - 1]
        rows = zip(*(part[k:] for k in range(WIDTH))) if len(words) > WIDTH else [words]
        yield np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), 42) for r in rows), np.uint64)


def sketch(text: bytes | None) -> tuple[int, int, np.ndarray]:
    """(hash of the words, SimHash, minima) of a text."""
    words = (text or b"").lower().split()
    whole = xxhash.xxh64_intdigest(b" ".join(words), 42)
    low, ones, n = np.full(SIGNATURE, ~np.uint64(0)), np.zeros(64, np.int64), max(1, len(words) - WIDTH + 1)
    for h in _shingles(words):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        low = np.minimum(low, (_A * h + _B).min(axis=1))
    fp = int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0]) if words else 0
    return whole, fp, low


def _sketches(batches):
    for batch in batches:
        got = [sketch(t.as_py()) for t in batch.column(1)]
        low = np.array([g[2] for g in got], np.uint64).reshape(-1, SIGNATURE)
        bands = [[xxhash.xxh64_intdigest(bytes([b]) + x[b * ROWS : (b + 1) * ROWS].tobytes(), 7) for b in range(BANDS)] for x in low]
        signature = low.astype(np.uint8)  # the low bits: the high ones of a minimum over many shingles are all 0
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *(pa.array(np.array([g[k] for g in got], np.uint64).view(np.int64)) for k in (0, 1)), pa.array([s.tobytes() for s in signature], pa.binary()), pa.array(list(np.array(bands, np.uint64).reshape(-1, BANDS).view(np.int64)), pa.list_(pa.int64()))],
            ["doc_id", "exact", "whole", "fp", "signature", "bands"],
        )


def _sets(batches):
    """Rows (text) → (whole, shingles): the sorted hashes of a text's distinct shingles."""
    for batch in batches:
        words = [(t.as_py() or b"").lower().split() for t in batch.column(0)]
        data = [np.unique(np.concatenate([*_shingles(w), np.zeros(0, np.uint64)])).tobytes() for w in words]
        whole = np.array([xxhash.xxh64_intdigest(b" ".join(w), 42) for w in words], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(whole), pa.array(data, pa.binary())], ["whole", "shingles"])


def _similar(common, n, m):
    """Whether texts of n and m distinct shingles, so many of them in common, have a similarity of SIMILARITY."""
    return 9 * common >= 4 * (n + m)


def _verify(batches):
    """Rows (a, b, shingles of a, shingles of b) → (a, b, similar)."""
    for batch in batches:
        pairs = ([np.frombuffer(x.as_py(), np.uint64) for x in pair] for pair in zip(batch.column(2), batch.column(3)))
        good = [bool(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "similar"])


def _compare(batches):
    """Rows (cluster, part, whole, shingles) sorted by cluster → links (a, b) that connect a cluster's parts as their texts' similarities do."""

    def solve(rows):
        part, whole, sets = np.array([r[1] for r in rows]), [r[2] for r in rows], [np.frombuffer(r[3], np.uint64) for r in rows]
        size = np.array([len(x) for x in sets])
        shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
        order = np.argsort(shingle, kind="stable")
        owner, first = np.repeat(np.arange(len(rows)), size)[order], np.r_[0, np.cumsum(np.bincount(shingle))]
        at, out, left, queue = np.r_[0, np.cumsum(size)], [], np.ones(len(rows), bool), []
        while queue or left.any():
            if not queue:
                queue = [int(left.argmax())]
                left[queue[0]] = False
            i = queue.pop()
            own = left & (part == part[i])
            mine = shingle[at[i] : at[i + 1]]
            shared = np.zeros(len(rows), np.int64)
            for k in range(0, len(mine), 256):
                shared += np.bincount(np.concatenate([owner[first[x] : first[x + 1]] for x in mine[k : k + 256]]), minlength=len(rows))
            near = left & ~own & _similar(shared, size, size[i])
            out += [(whole[i], whole[j]) for j in np.flatnonzero(near).tolist()]
            queue += np.flatnonzero(own | near).tolist()
            left &= ~(own | near)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    held = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield solve(held)
                held = []
            held.append(row)
    if held:
        yield solve(held)


def _candidates(batches):
    """Rows (band, whole, signature) sorted by band → pairs (a, b) to verify: for each of LEVELS a forest of each band's texts."""

    def forest(signatures, need):
        left, queue = np.arange(1, len(signatures)), [0]
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
                continue
            i = queue.pop()
            near = (signatures[left] == signatures[i]).sum(axis=1) >= need
            for j in left[near].tolist():
                yield i, j
            queue += left[near].tolist()
            left = left[~near]

    def solve(band, reps, data):
        edge = np.flatnonzero(np.diff(band)) + 1
        out = set()
        for s, e in zip(np.r_[0, edge].tolist(), np.r_[edge, len(band)].tolist()):
            if e - s > 1:
                signatures = np.frombuffer(b"".join(data[s:e]), np.uint8).reshape(e - s, -1)
                for level in LEVELS:
                    out |= {(int(reps[s + i]), int(reps[s + j])) for i, j in forest(signatures, level * SIGNATURE)}
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), [])
    for batch in batches:
        band, reps, data = np.r_[held[0], batch.column(0).to_numpy()], np.r_[held[1], batch.column(1).to_numpy()], held[2] + batch.column(2).to_pylist()
        if len(band):
            last = int(np.searchsorted(band, band[-1]))
            if last:
                yield solve(band[:last], reps[:last], data[:last])
            held = band[last:], reps[last:], data[last:]
    if len(held[0]):
        yield solve(*held)


def _linked(pairs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect all texts, known by ``whole``, which are connected by similar ones among the candidates.

    The candidate pairs are verified on the real shingle sets. Where that breaks a forest, the whole cluster that the candidates
    connect is compared once more, in one task, except within the parts that verified links connect already.
    """
    spark = small_batches(rows).sparkSession
    nodes = pairs.select(F.col("a").alias("whole")).union(pairs.select("b")).distinct()
    ids = texts.join(nodes, "whole", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    sets = cut(rows.join(ids, "doc_id", "left_semi").select("text").mapInArrow(_sets, "whole long, shingles binary").dropDuplicates(["whole"]), "sets")
    total, checked = pairs.count(), pairs
    for end in ("a", "b"):
        known = pairs.groupBy(F.col(end).alias("whole")).agg(F.count("*").alias("n_rows")).join(sets, "whole").select(F.col("whole").alias(end), "n_rows", F.col("shingles").alias(f"of_{end}"))
        checked = join_wide(checked, known, end, total, ["a", "b"]).drop("n_rows")  # sets are as long as their texts
    checked = cut(checked.select("a", "b", "of_a", "of_b").mapInArrow(_verify, "a long, b long, similar boolean"), "verified")
    good = checked.filter("similar").select("a", "b")
    if checked.filter("not similar").isEmpty():
        return good
    parts, clusters = cut(components(good), "parts"), cut(components(pairs), "clusters")
    members = cut(clusters.toDF("whole", "cluster").join(parts.toDF("whole", "part"), "whole", "left").select("cluster", "whole", F.coalesce("part", "whole").alias("part")), "members")
    broken = members.groupBy("cluster").agg(F.countDistinct("part").alias("n_parts")).filter("n_parts > 1").select("cluster")
    again = members.join(broken, "cluster", "left_semi").join(sets, "whole").select("cluster", "part", "whole", "shingles")
    more = again.repartition("cluster").sortWithinPartitions("cluster", "whole").mapInArrow(_compare, "a long, b long")
    return good.union(cut(more, "compared"))


#: Tells texts apart, a null one from all others too.
_EXACT, _KEY = "xxhash64(text, text is null)", "__exact"


def groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id, exact, first_exact)`` of the documents with an id: the smallest doc_id of each group of similar
    texts, a hash of the document's text, and the smallest such hash of that smallest doc_id in the group."""
    rows = small_batches(docs).filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.expr(_EXACT).alias("exact"))
    marked = cut(rows.select("doc_id", "text", "exact").mapInArrow(_sketches, "doc_id long, exact long, whole long, fp long, signature binary, bands array<bigint>"), "sketches")
    total = marked.count()
    texts = cut(marked.groupBy("whole").agg(F.min(F.struct("doc_id", "exact", "fp", "signature", "bands")).alias("x"), F.count("*").alias("n_rows")).select("whole", "n_rows", F.col("x.doc_id").alias("rep"), "x.exact", "x.fp", "x.signature", "x.bands"), "texts")
    by_print = texts.groupBy("fp").agg(F.min("whole").alias("rep"), F.count("*").alias("n_rows"))
    same = join_groups(texts.select("fp", F.col("whole").alias("a")), by_print, "fp", total).select("a", F.col("rep").alias("b"))
    banded = texts.select(F.explode("bands").alias("band"), "whole", "signature").repartition("band").sortWithinPartitions("band", "whole")
    pairs = banded.mapInArrow(_candidates, "a long, b long").union(links(by_print.select("fp", "rep"))).union(same).filter("a <> b")
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    found = components(_linked(pairs, rows, texts))
    placed = cut(texts.select("whole", "rep", "exact", "n_rows").join(found.withColumnRenamed("node", "whole"), "whole", "left").withColumn("component", F.coalesce("component", "whole")), "placed")
    first = placed.groupBy("component").agg(F.min(F.struct("rep", "exact")).alias("x"), F.count("*").alias("n_rows")).select("component", "n_rows", F.col("x.rep").alias("component_id"), F.col("x.exact").alias("first_exact"))
    known = join_groups(placed.select("whole", "component", F.col("n_rows").alias("copies")), first, "component", total).select("whole", F.col("copies").alias("n_rows"), "component_id", "first_exact")
    return join_groups(marked.select("doc_id", "whole", "exact"), known, "whole", total).select("doc_id", "component_id", "exact", "first_exact")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents without all but the first of each group, all columns as they are."""
    with scratch(docs.sparkSession):
        marked = cut(groups(docs), "groups", keep=True)
    n, ids = marked.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        return drop_rows(docs, marked.filter("doc_id <> component_id").select("doc_id"), "doc_id")
    # a doc_id may have several texts: rows go by both, and of rows equal in both one stays
    gone = cut(marked.filter("doc_id <> component_id or exact <> first_exact").select("doc_id", F.col("exact").alias(_KEY)).distinct(), "dropped")
    named = docs.filter("doc_id is not null").withColumn(_KEY, F.expr(_EXACT))
    kept = named.join(gone, [named["doc_id"].cast("long") == gone["doc_id"], named[_KEY] == gone[_KEY]], "left_anti")
    return kept.dropDuplicates(["doc_id", _KEY]).select(*docs.columns).unionByName(docs.filter("doc_id is null"))
