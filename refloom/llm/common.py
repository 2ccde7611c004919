"""Shared pieces: the folder every executor sees, lineage cuts, joins that survive hot keys, components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds over 1/HOT_SHARE of the rows, so there are never more than HOT_SHARE hot keys.
HOT_SHARE = 1000


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``). Where that is unset, a local session gets a
    folder of its own; on a cluster it is an error, as executors would write to their own disks."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="refloom-"))
        path = _LOCAL[0]
    return path.rstrip("/")


def fresh_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(docs: DataFrame) -> DataFrame:
    """The same rows, which go to Python in batches of about BATCH_BYTES: long texts else make batches of any size, of
    which JVM and worker hold several. Sets the session's limit where it is unset."""
    if docs.sparkSession.conf.get(_BATCH, None) is None:
        docs.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return docs


#: The tables written by ``cut`` inside each open ``scratch``.
_OPEN: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder; one that is not there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``cut`` writes inside are removed at the end, but for those to ``keep``: what leaves must be kept."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def cut(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and lost executors cost no recomputation."""
    path = fresh_dir(df.sparkSession, tag)
    df.write.parquet(path)
    if _OPEN[: len(_OPEN) - keep]:
        _OPEN[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``groups``, which is unique on ``key`` and carries ``n_rows``, the rows of each key.

    The hot keys, at most HOT_SHARE by their definition, are broadcast; their rows never meet in one task.
    All other keys are joined by a shuffle. Null keys match nothing.
    """
    limit = total / HOT_SHARE
    hot = F.broadcast(groups.filter(F.col("n_rows") > limit))
    cold = groups.filter(F.col("n_rows") <= limit)
    near = rows.join(hot, key, "inner")
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, how)
    return near.unionByName(rest)


#: Rows that share a copy of their group's row in ``join_wide``, at least.
ROWS_A_COPY = 64


def join_wide(rows: DataFrame, groups: DataFrame, key: str, total: int, by: list[str]) -> DataFrame:
    """Like ``join_groups``, for groups whose rows are too large to broadcast: of these only the hot keys are broadcast.

    A hot key's rows are dealt by a hash of ``by`` over copies of its group, one for each 1/HOT_SHARE of all rows that it
    holds and for ROWS_A_COPY rows or more, so there are at most 2 * HOT_SHARE of these copies. Null keys match nothing.
    """
    limit = max(total / HOT_SHARE, ROWS_A_COPY)
    hot = groups.filter(F.col("n_rows") > limit).withColumn("n_copies", F.ceil(F.col("n_rows") / limit))
    names = F.broadcast(hot.select(key, "n_copies"))
    copies = hot.withColumn("copy", F.explode(F.expr("sequence(0L, n_copies - 1)"))).drop("n_copies")
    near = rows.join(names, key, "inner").withColumn("copy", F.pmod(F.xxhash64(*by), "n_copies")).drop("n_copies").join(copies, [key, "copy"], "inner").drop("copy")
    rest = rows.join(names.select(key), key, "left_anti").join(groups.filter(F.col("n_rows") <= limit), key, "inner")
    return near.unionByName(rest)


def _forests(batches):
    """Each task's links become stars of their local components, flushed every million links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def flush():
        out = [(x, find(x)) for x in list(parent)]
        parent.clear()
        out = [(x, r) for x, r in out if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([r for _, r in out], pa.int64())], ["a", "b"])

    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen >= 1_000_000:
            yield flush()
            seen = 0
    if parent:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a long, b long)``: ``(node, component)``, component the smallest node reachable.

    Large-star and small-star rounds over links that each task first reduces to forests; every round is written to
    the shared folder. Nodes without links do not occur; no links give no rows. Hot nodes go through ``join_groups``.
    """
    edges = cut(links.select("a", "b").filter("a <> b").mapInArrow(_forests, "a long, b long").distinct(), "links")
    while True:
        total = edges.count()
        roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
        roles = roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if not total or roles.filter("up > 1 or up = 1 and root = 1").isEmpty():  # stars: each node has one link, to a root
            return edges.toDF("node", "component").union(edges.select("b", "b").distinct())
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n_rows"))
        large = join_groups(both, low, "a", 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large, "links")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n_rows"))
        small = join_groups(down, low, "a", total).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        edges = cut(small.filter("a <> b").mapInArrow(_forests, "a long, b long").distinct(), "links")


def popcount64(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a)


def words_of(column):
    """Lower-cased runs of letters and digits of a text, as an array; a null or wordless text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


#: Ids to drop are broadcast up to so many, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000


def drop_rows(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in ``ids``; a null key stays."""
    ids = cut(ids.select(key), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti").select(*docs.columns)
