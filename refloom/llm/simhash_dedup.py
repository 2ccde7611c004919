"""Operator 4: SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. Two fingerprints within RADIUS bits agree, up to one bit, in one of their two 32-bit
segments. So each distinct fingerprint enters the table of each segment under its own value, and asks that table for
the Hamming ball of radius one around it; a flip is asked for only where the segment's bit is 0, as the other of two
fingerprints then has the 1. Matches are verified on all 64 bits, bucket by bucket, and leave as spanning forests:
a bucket never becomes all its pairs. A bucket of over BUCKET entries is dealt out once more by 16-bit parts of the
other segment, and what is still too large by 8-bit parts of the other of these, which leaves at most 256 own members
each; at every level the difference that is left, of at most RADIUS bits, is at most one bit in one of two segments.

Defined cases: a null or wordless text has fingerprint 0, linked like any other; fewer words than a shingle make one
shingle of all of them; a null doc_id keeps its fingerprint, links to nothing and has a null component; repeated rows
stay, each with the same component; texts are read whole, however long; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, join_groups, small_batches

RADIUS = 3
BUCKET = 4096
SEED = 42
_CHUNK = 1 << 16


def simhash(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of ASCII-lower-cased, whitespace-separated words in shingles of ``width``."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    total, ones = max(1, n - width + 1), np.zeros(64, np.int64)
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        rows = zip(*(part[k:] for k in range(width))) if n > width else [words]
        h = np.fromiter(map(digest, map(b" ".join, rows)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches, width):
    for batch in batches:
        got = np.fromiter((simhash(x.as_py(), width) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row per row of ``docs``; fp is the fingerprint as a signed long."""
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(partial(_fingerprints, width=width), "doc_id long, fp long")


def _search(flags, fps, reps, full):
    """Links of one bucket as a forest. Two entries may be compared if, at each level, one stands under its own value."""
    left = np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start], queue = False, [start]
        while queue:
            i = queue.pop()
            near = left & ((flags | flags[i]) == full) & (np.bitwise_count(fps ^ fps[i]) <= RADIUS)
            for j in np.flatnonzero(near).tolist():
                left[j] = False
                queue.append(j)
                yield int(reps[i]), int(reps[j])


def _buckets(batches, limit, full):
    """Rows (key, flag, fp, rep) sorted by key → links (a, b), or the entries of too large a bucket as they came.

    At most ``limit`` entries of a bucket are held: from there on its entries are passed on as they come.
    """

    def out(links, kept):
        n, m = len(links), len(kept[0])
        a, b = (pa.concat_arrays([pa.array([x[k] for x in links], pa.int64()), pa.nulls(m, pa.int64())]) for k in (0, 1))
        rest = [pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)]) for x, t in zip(kept, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([a, b, *rest], ["a", "b", "key", "flag", "fp", "rep"])

    def solve(keys, flags, fps, reps):
        edge = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(keys)]
        whole = np.bitwise_or.reduceat(flags, starts) == full  # else no two entries may be compared
        links, kept = [], [np.zeros(0, np.int64)]
        for s, e in zip(starts[whole & (ends - starts > 1)].tolist(), ends[whole & (ends - starts > 1)].tolist()):
            if e - s > limit:
                kept.append(np.arange(s, e))
            else:
                links += _search(flags[s:e], fps[s:e].view(np.uint64), reps[s:e], full)
        k = np.concatenate(kept)
        return out(links, [x[k] for x in (keys, flags, fps, reps)])

    held, n, passed = [], 0, None  # the entries of the last key met, and the key whose entries are passed on
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if passed is not None:
            end = int(np.searchsorted(cols[0], passed, side="right"))
            if end:
                yield out([], [x[:end] for x in cols])
                cols = [x[end:] for x in cols]
            passed = passed if not len(cols[0]) else None
        if not len(cols[0]):
            continue
        if held and held[0][0][0] != cols[0][-1] or not held and cols[0][0] != cols[0][-1]:
            cols, held = [np.concatenate(x) for x in zip(*held, cols)], []
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield solve(*(x[:last] for x in cols))
            cols, n = [x[last:] for x in cols], 0
        held, n = [*held, cols], n + len(cols[0])
        if n > limit:
            yield out([], [np.concatenate(x) for x in zip(*held)])
            held, n, passed = [], 0, cols[0][-1]
    if held:
        yield solve(*(np.concatenate(x) for x in zip(*held)))


_OUT = "a long, b long, key long, flag int, fp long, rep long"


def _deal(rows: DataFrame, shift: str, width: int, parts: int, level: int, key: str) -> DataFrame:
    """Entries (key, flag, fp, rep) of one level: each row under its own value of each of ``parts`` segments of ``width``
    bits, the first one at bit ``shift``, and under that value with one 0 bit set. ``key`` is a prefix from the level
    before. A flag's bit ``level`` tells an own value; flags of the levels before are kept."""
    value = f"(shiftrightunsigned(fp, {shift} + {width} * p) & {(1 << width) - 1}L)"
    ball = f"concat(array(struct({value} as v, flag | {1 << level} as f)), transform(filter(sequence(0, {width - 1}), i -> ({value} & shiftleft(1L, i)) = 0), i -> struct({value} | shiftleft(1L, i) as v, flag as f)))"
    wide = rows.select("key", "flag", "fp", "rep", F.explode(F.array(*map(F.lit, range(parts)))).alias("p")).select("key", "fp", "rep", "p", F.expr(f"inline({ball})"))
    return wide.selectExpr(f"({key} * {parts} + p) * {1 << width}L + v as key", "cast(f as int) as flag", "fp", "rep")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between the ``rep`` of distinct fingerprints ``(fp, rep)``, enough to connect all within RADIUS bits."""
    rows = fps.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("flag"), "fp", "rep")
    found = None
    # (first bit of what is left of the fingerprint, bits of a segment), by the bits of the key that tell the segments before
    half, part = "32 * (1 - (shiftright(key, 32) & 1))", "(32 * (1 - (shiftright(key, 17) & 1)) + 16 * (1 - (shiftright(key, 16) & 1)))"
    for level, (shift, width) in enumerate((("0", 32), (half, 16), (part, 8))):
        entries = _deal(rows, f"cast({shift} as int)", width, 2, level, "key")
        # the last level's buckets hold at most 256 own members, whatever the input
        solve = partial(_buckets, limit=bucket if level < 2 else 1 << 62, full=(2 << level) - 1)
        done = cut(entries.repartition("key").sortWithinPartitions("key").mapInArrow(solve, _OUT), "buckets")
        new = done.filter("b is not null").select("a", "b")
        found, rows = new if found is None else found.union(new), done.filter("key is not null").select("key", "flag", "fp", "rep")
        if level == 2 or rows.isEmpty():
            return found


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``: the component is the smallest doc_id reachable over fingerprints within RADIUS bits."""
    marked = cut(fingerprints(docs, width), "fingerprints")
    total = marked.count()
    fps = cut(marked.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")), "fps")
    found = components(links(fps.select("fp", "rep")))
    groups = fps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "n_rows")
    known = join_groups(marked.filter("doc_id is not null"), groups, "fp", total).select("doc_id", "fp", "component_id")
    return known.union(marked.filter("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long")))
