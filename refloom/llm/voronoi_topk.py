"""Operator 8: exact top-k inner products by a Voronoi kNN join.

Vectors are quantised to integers floor(SCALE * x). Pivots, PIVOTS of them and one more for each CHUNK vectors up to
SAMPLE, cut queries and data into cells; the summary of a data cell is its pivot and radius. Each query has a lower bound
for its k-th score, its k-th best among a bounded sample of real candidates, and needs a cell only if query·pivot +
|query|·radius reaches that bound. Query cells are cut or merged into blocks of about BLOCK queries, so a cell that holds
a third of all queries is several blocks, and data cells into chunks of about CHUNK vectors, so no task holds a whole
cell; small neighbouring cells share a bin of at most as many. A query goes only to the bins with cells that it needs, and each data vector only to the blocks that need its
cell: a task keeps the queries of one block that need one chunk and streams that chunk past them by matrix products; the
k best of all chunks of a query are merged at the end.

Defined cases: vectors that are null or hold a null or a non-finite component take no part, nor do rows with a null id;
shorter vectors count as padded with zeros; a query's own id is no candidate; a repeated candidate row
counts each time, a repeated query id once, with the least of its vectors; ties go to the smaller id; fewer than k
candidates give that many rows; an empty table gives an empty result; other columns, whatever their names, are ignored. Scores beyond 64 bits
raise an error.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, SCALE, PIVOTS, SAMPLE, BLOCK, CHUNK = 20, 64, 63, 1024, 8192, 50_000
#: Scores worked out at once.
_AT_ONCE = 1 << 22
_EXACT = 2.0**53


def quantise(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, q array<bigint>)`` of the vectors that take part."""
    good = "vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("q"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of a list column as integers, padded to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < _EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    got = a.astype(object) @ b.T.astype(object)
    if got.size and max(abs(got.min()), abs(got.max())) >= 1 << 63:
        raise OverflowError("a score does not fit 64 bits")
    return got.astype(np.int64)


def _cells(batches, pivots):
    p = pivots.astype(float)
    for batch in batches:
        v = _matrix(batch.column(1), p.shape[1]).astype(float)
        d = np.sqrt(np.maximum((v**2).sum(1)[:, None] + (p**2).sum(1) - 2 * v @ p.T, 0))
        cell = d.argmin(1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(v)), cell])], ["vec_id", "q", "nth", "cell", "far"])


def _needs(batches, k, pivots, radii, ids, sample):
    p = pivots.astype(float)
    for batch in batches:
        v, own = _matrix(batch.column(1), pivots.shape[1]), batch.column(0).to_numpy()
        s = _products(v, sample).astype(float)
        s[own[:, None] == ids] = -np.inf
        bound = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(v), -np.inf)
        most = v @ p.T + np.sqrt((v.astype(float) ** 2).sum(1))[:, None] * radii
        slack = 1e-9 * (np.abs(most) + 1) + 1e-3
        row, cell = np.nonzero(most + slack >= bound[:, None])
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(v)))]
        cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(cell.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns, cells, pa.array(np.where(np.isfinite(bound), bound, -(2.0**62)).astype(np.int64))], [*batch.schema.names, "cells", "bound"])


def _best(row, score, vec, k):
    """The k best of each row: score descending, id ascending."""
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], score[keep], vec[keep]


def _solve(batches, k, dims):
    """Rows (block, bin, chunk, kind, vec_id, q, bound), sorted: queries of a block, then the data of a chunk."""

    def close(state):
        if state is not None:
            row, score, vec = _best(*map(np.concatenate, zip(*state["found"])), k) if state["found"] else (np.zeros(0, int),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(state["ids"][row]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    at, state = None, None
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
        edges = np.r_[0, np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1, len(key)]
        for s, e in zip(edges[:-1], edges[1:]):
            if s == e:
                continue
            part = batch.slice(s, e - s)
            v, ids, group = _matrix(part.column(5), dims), part.column(4).to_numpy(), tuple(key[s, :3])
            if group != at:
                yield from close(state)
                at, state = group, None
            if key[s, 3] == 0:
                bound = part.column(6).to_numpy()
                if state is not None:
                    v, ids, bound = np.r_[state["v"], v], np.r_[state["ids"], ids], np.r_[state["bound"], bound]
                state = {"v": v, "ids": ids, "bound": bound.copy(), "found": []}
                continue
            step = max(1, _AT_ONCE // len(state["ids"])) if state is not None else 1
            for i in range(0, len(ids) if state is not None else 0, step):
                sc = _products(state["v"], v[i : i + step])
                row, col = np.nonzero((sc >= state["bound"][:, None]) & (state["ids"][:, None] != ids[i : i + step]))
                state["found"].append((row, sc[row, col], ids[i : i + step][col]))
                if sum(len(x[0]) for x in state["found"]) > 4 * k * len(state["ids"]):
                    row, score, vec = _best(*map(np.concatenate, zip(*state["found"])), k)
                    state["found"] = [(row, score, vec)]
                    full = np.bincount(row, minlength=len(state["ids"])) == k
                    last = np.full(len(state["ids"]), np.iinfo(np.int64).max)
                    np.minimum.at(last, row, score)
                    state["bound"] = np.where(full, np.maximum(state["bound"], last), state["bound"])
    yield from close(state)


def top_k(vectors: DataFrame, k: int = K, every: int = 20, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the queries, the rows whose vec_id ``every`` divides."""
    spark = vectors.sparkSession
    data = cut(quantise(vectors, scale), "vectors")
    total, dims = data.agg(F.count("*"), F.max(F.size("q"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, dims)
    some = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # at most SAMPLE vectors
    sample = np.zeros((len(some), dims), np.int64)
    for i, r in enumerate(some):
        sample[i, : len(r["q"])] = r["q"]
    ids, pivots = np.array([r["vec_id"] for r in some]), sample[: max(PIVOTS, total // CHUNK)]
    numbered = data.withColumn("nth", F.monotonically_increasing_id())  # written down, so that it stays; deals out repeated ids
    placed = cut(numbered.mapInArrow(partial(_cells, pivots=pivots), "vec_id long, q array<bigint>, nth long, cell int, far double"), "cells")
    radii, rows = np.zeros(len(pivots)), {}
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row for each of at most SAMPLE cells
        radii[r["cell"]], rows[r["cell"]] = r["far"], r["n"]
    near = sorted(range(len(pivots)), key=lambda c: (float(pivots[c] @ pivots[0]), c))  # neighbours by direction
    bins, chunks, held = [0] * len(pivots), [], CHUNK + 1  # cell → its bin; chunks of each bin: small cells share one
    for c in near:
        n = rows.get(c, 0)
        if held + n > CHUNK:
            chunks.append(max(1, math.ceil(n / CHUNK)))
            held = 0
        bins[c], held = len(chunks) - 1, held + n
    asked = placed.filter(f"vec_id % {every} = 0").groupBy("vec_id").agg(F.min(F.struct("q", "cell")).alias("v")).select("vec_id", "v.q", "v.cell")
    asked = cut(asked.mapInArrow(partial(_needs, k=k, pivots=pivots, radii=radii, ids=ids, sample=sample), "vec_id long, q array<bigint>, cell int, cells array<int>, bound long"), "queries")
    sizes = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # as few
    first, blocks, held = {}, 0, 0  # cell → (its first block, number of blocks)
    for c in (c for c in near if c in sizes):  # neighbours share a block
        n = sizes[c]
        if n >= BLOCK:
            first[c], held = (blocks, math.ceil(n / BLOCK)), 0
            blocks += first[c][1]
            continue
        if not held or held + n > BLOCK:
            blocks, held = blocks + 1, 0
        first[c], held = (blocks - 1, 1), held + n
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    mine = spark.createDataFrame([(c, b, n) for c, (b, n) in first.items()], "cell int, base int, n int")  # a row a cell
    parts = spark.createDataFrame([(c, b, chunks[b]) for c, b in enumerate(bins)], "cell int, bin int, chunks int")  # a row a cell
    by_bin = spark.createDataFrame(list(enumerate(chunks)), "bin int, chunks int")  # as few
    block = F.expr("base + cast(pmod(xxhash64(vec_id), n) as int)").alias("block")
    placed_queries = asked.join(F.broadcast(mine), "cell").select(block, "cells", "vec_id", "q", "bound")
    needed = F.explode(F.expr(f"array_distinct(transform(cells, c -> element_at(array({', '.join(map(str, bins))}), c + 1)))")).alias("bin")
    chunk = F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk")
    queries = placed_queries.select("block", needed, "vec_id", "q", "bound").join(F.broadcast(by_bin), "bin").select("block", "bin", chunk, F.lit(0).alias("kind"), "vec_id", "q", "bound")
    wanted = placed_queries.select("block", F.explode("cells").alias("cell")).distinct().join(F.broadcast(parts), "cell").select("block", "cell", "bin", chunk)
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("chunk", F.expr("cast(pmod(xxhash64(vec_id, nth), chunks) as int)"))
    copies = dealt.drop("bin").join(wanted, ["cell", "chunk"]).select("block", "bin", "chunk", F.lit(1).alias("kind"), "vec_id", "q", F.lit(0).cast("long").alias("bound"))
    dealt = queries.union(copies).repartition("block", "bin", "chunk").sortWithinPartitions("block", "bin", "chunk", "kind")
    found = dealt.mapInArrow(partial(_solve, k=k, dims=dims), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
