"""Operator 7: benchmark decontamination, with DataFrame functions only.

An item of m words is compared with the windows of m words of every document, by weighted (counted) shingles of WIDTH
words; a window leaks an item at a similarity, shared over all, of at least SIMILARITY. Windows are fingerprinted by
SimHash. RADIUS + 1 Hamming blocks guarantee that a fingerprint within RADIUS bits of an item's agrees with it on one
block whole, so an equi-join on (item, block, value) finds all of them, each at its first such block; the exact
similarity then verifies them. At a similarity of 0.8 some 15 % of the bits differ, so blocks that guarantee it are 2 or 3
bits wide and select little (two random fingerprints share one with a chance of 0.993): the item is part of the key. RADIUS is so wide that a window of the similarity asked for passes it but for once in
about a million (the expected distance at 0.8 is 10 bits of 64, the deviation 3), and it costs little, as most windows
are ruled out before, without loss: a window that leaks shares at least `need` of an item's k shingles (`least` if it is a whole shorter document), so it holds
one of any k - need + 1 of them (the seeds), and it reaches its best similarity where it begins at a shared shingle, or
at the document's end, with `need` shared positions inside. Documents are searched for seeds in place: their shingle
hashes meet a Bloom filter of all seeds, as literal words of a bit set, before anything is exploded or joined.

Defined cases: a document shorter than an item is, where asked, its one window; a document or item without words leaks nothing; items of fewer than WIDTH words are one shingle of all
their words; a null doc_id or item_id is kept as null; repeated rows are judged row by row; other columns, whatever their names, are
ignored; texts are read whole, however long; empty tables give no rows.
Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words_of

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 24
#: Bits a seed gets in the Bloom filter, and the largest filter; beyond it more documents reach the exact join.
BITS_EACH, MOST_BITS = 512, 1 << 22
#: Item tables are broadcast up to so many rows of hashes, and shuffled beyond.
BROADCAST_ROWS = 200_000
#: Fixed ends of the RADIUS + 1 blocks: block b has bits [EDGES[b], EDGES[b + 1]).
EDGES = [64 * b // (RADIUS + 1) for b in range(RADIUS + 2)]


def shingles(words: str, width: str) -> str:
    """SQL: hashes of the shingles of ``width`` words of an array column of word hashes."""
    parts = ", ".join(f"{words}[i + {k}]" if k else f"{words}[i]" for k in range(int(width)))
    return f"if(size({words}) < {width}, array(), transform(sequence(0, size({words}) - {width}), i -> xxhash64({parts})))"


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprint(hashes: str, most: int) -> str:
    """SQL: SimHash of an array of at most ``most`` hashes: bit-sliced counters of the 64 ones, compared with half."""
    bits = max(1, most.bit_length())
    zero = ", ".join(f"0L as c{j}" for j in range(bits))
    step = ", ".join(f"a.c{j} ^ (h{''.join(f' & a.c{i}' for i in range(j))}) as c{j}" for j in range(bits))
    # more than half of n: count > n div 2, from the highest counter down
    over, equal = "0L", "-1L"
    for j in reversed(range(bits)):
        half = f"-(shiftright(size({hashes}) div 2, {j}) & 1L)"
        over, equal = f"({over} | ({equal} & a.c{j} & ~({half})))", f"({equal} & ~(a.c{j} ^ ({half})))"
    return f"aggregate({hashes}, struct({zero}), (a, h) -> struct({step}), a -> {over})"


def block(fp: str, b: int) -> str:
    return f"(shiftrightunsigned({fp}, {EDGES[b]}) & {(1 << EDGES[b + 1] - EDGES[b]) - 1}L)"


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, m, w, k, need, hashes, counted, fp): one row per item with words."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _hashed(words_of(F.col("text"))).alias("words")).filter("size(words) > 0")
    rows = rows.withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]).withColumns({"m": F.size("words"), "w": F.least(F.size("words"), F.lit(WIDTH))})
    by_width = "case w " + " ".join(f"when {w} then {shingles('words', str(w))}" for w in range(1, WIDTH + 1)) + " end"
    rows = cut(rows.select("item", "item_id", "m", "w", F.expr(by_width).alias("hashes")), "items")
    most = rows.agg(F.max(F.size("hashes"))).first()[0] or 1
    return rows.selectExpr("*", "size(hashes) as k", f"cast(ceil(2 * {SIMILARITY} / (1 + {SIMILARITY}) * size(hashes) - 1e-9) as int) as need", f"cast(ceil({SIMILARITY} * size(hashes) - 1e-9) as int) as least", "transform(array_distinct(hashes), x -> struct(x as h, size(filter(hashes, y -> y = x)) as n)) as counted", f"{fingerprint('hashes', most)} as fp")


def leaks(docs: DataFrame, benchmark: DataFrame, short: bool = False) -> DataFrame:
    """``(doc_id, item_id, start_word, n_words, similarity, distance)``: the best window of each leaked item in each document.

    ``row`` tells rows with the same doc_id apart. With ``short``, a document of fewer words than an item is compared with it
    as its one window; without, it has no window of the item's length.
    """
    spark = docs.sparkSession
    none = spark.createDataFrame([], "row long, doc_id long, item_id long, start_word int, n_words int, similarity double, distance int")
    items = cut(_items(benchmark), "items")
    n_items, most, total = items.agg(F.count("*"), F.max("k"), F.sum("k")).first()
    if not n_items:
        return none
    seeds = cut(items.select("item", "m", "w", F.explode(F.expr(f"slice(array_distinct(hashes), 1, k - {'least' if short else 'need'} + 1)")).alias("h")), "seeds")
    n_seeds = seeds.count()
    bits = min(MOST_BITS, 1 << max(12, math.ceil(math.log2(n_seeds * BITS_EACH))))
    # a word for each 64 bits, at most MOST_BITS / 64 of them, whatever the number of seeds
    places = seeds.select(F.explode(F.array(*(F.expr(f"shiftrightunsigned(h, {s}) & {bits - 1}L") for s in (0, 32)))).alias("p"))  # two hashes
    filled = dict(places.groupBy(F.expr("cast(p div 64 as int)").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).collect())
    bloom = "cast(split('" + ",".join(str(filled.get(i, 0)) for i in range(bits // 64)) + "', ',') as array<bigint>)"  # a constant
    hit = " and ".join(f"(get({bloom}, cast((shiftrightunsigned(h, {s}) & {bits - 1}L) div 64 as int)) & shiftleft(1L, cast(shiftrightunsigned(h, {s}) & 63L as int))) <> 0" for s in (0, 32))
    widths = sorted(r[0] for r in items.select("w").distinct().collect())  # at most WIDTH
    # one scan for all widths; each explode of one element keeps what it makes from being worked out again by what stands above
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(_hashed(words_of(F.col("text"))))).alias("words"))
    each = F.array(*(F.struct(F.lit(w).alias("w"), F.expr(shingles("words", str(w))).alias("hashes")) for w in widths))
    rows = rows.select("row", "doc_id", F.explode(each).alias("x")).select("row", "doc_id", "x.w", "x.hashes")
    rows = rows.select("row", "doc_id", "w", "hashes", F.explode(F.expr(f"filter(array(array_distinct(filter(hashes, h -> {hit}))), x -> size(x) > 0)")).alias("hits"))
    suspects = cut(rows, "suspects")
    pairs = suspects.select("row", "w", F.explode("hits").alias("h")).join(_maybe_broadcast(seeds.select("w", "h", "item"), n_seeds), ["w", "h"]).select("row", "w", "item").distinct()
    own = items.select("item", "m", "k", "need", "least", F.col("hashes").alias("own"))
    wide = suspects.select("row", "w", "doc_id", "hashes").join(pairs, ["row", "w"]).join(_maybe_broadcast(own, total), "item")
    spots = "filter(sequence(0, size(hashes) - 1), i -> array_contains(own, hashes[i]))"
    starts = wide.filter("size(hashes) >= k").withColumn("spots", F.expr(spots)).filter("size(spots) >= need")
    begin = "transform(filter(sequence(0, size(spots) - need), j -> spots[j] <= size(hashes) - k and spots[j + need - 1] < spots[j] + k), j -> spots[j])"
    end = "if(spots[size(spots) - need] >= size(hashes) - k, array(size(hashes) - k), array())"
    windows = starts.withColumn("at", F.explode(F.array_distinct(F.concat(F.expr(begin), F.expr(end))))).select("row", "doc_id", "item", "at", F.expr("slice(hashes, at + 1, k)").alias("hashes"))
    if short:
        fewer = wide.filter("size(hashes) < k and size(hashes) >= `least`").withColumn("spots", F.expr(spots)).filter(f"size(spots) >= {SIMILARITY} / (1 + {SIMILARITY}) * (k + size(hashes)) - 1e-9")
        windows = windows.union(fewer.select("row", "doc_id", "item", F.lit(0).alias("at"), "hashes"))
    found = _matches(windows.withColumn("fp", F.expr(fingerprint("hashes", most))), items, n_items)
    best = found.groupBy("row", "doc_id", "item", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("at"), F.col("words").alias("m"), F.col("distance"))).alias("b"))
    return best.select("row", "doc_id", "item_id", F.col("b.at").alias("start_word"), F.col("b.m").alias("n_words"), (-F.col("b.s")).alias("similarity"), F.col("b.distance").alias("distance"))


def _keys(fp: str) -> Column:
    return F.expr("inline(array(" + ", ".join(f"struct({b} as block, {block(fp, b)} as value)" for b in range(RADIUS + 1)) + "))")


def _matches(windows: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """Windows within RADIUS bits of the item whose seed they hold, found by equal blocks, and verified exactly."""
    table = items.select("item", "item_id", "m", "counted", "k", F.col("fp").alias("own"), _keys("fp"))
    probes = windows.select("row", "doc_id", "item", "at", "hashes", "fp", _keys("fp"))
    first = " and ".join(f"(block <= {b} or {block('(fp ^ own)', b)} <> 0)" for b in range(RADIUS))
    near = probes.join(_maybe_broadcast(table, n_items * (RADIUS + 1)), ["item", "block", "value"]).filter(F.expr(f"bit_count(fp ^ own) <= {RADIUS} and {first}"))
    shared = "aggregate(counted, 0, (a, x) -> a + least(x.n, size(filter(hashes, y -> y = x.h))))"
    near = near.withColumn("shared", F.explode(F.array(F.expr(shared)))).withColumn("similarity", F.expr("shared / (k + size(hashes) - shared)"))
    return near.filter(F.col("similarity") >= SIMILARITY).select("row", "doc_id", "item", "item_id", F.expr(f"size(hashes) + least(m, {WIDTH}) - 1").alias("words"), "at", "similarity", F.expr("cast(bit_count(fp ^ own) as int)").alias("distance"))
