"""Operator 6: sharding by a two-pass external shuffle, with DataFrame functions only. Law: `rows`.

Pass one scatters the rows into buckets of about BUCKET_BYTES by a seeded hash of the row. Pass two collects each bucket
in a fixed order, shuffles it by Fisher-Yates (the `shuffle` function, seeded; it draws from the seed, the number of the
partition and the bucket's place in it), and writes it: the rows of all buckets, one after another, are numbered from 0,
and equal ranges of these numbers, whose lengths are at most one apart, are the shards. Text is shuffled once. The number
of buckets grows with the bytes; up to MOST_PARTS tasks hold them, each one after another.

Equal texts differ in doc_id and so scatter over all buckets. Rows repeated with doc_id and text share a hash: those that
fill a good part of a bucket are counted row by row instead, and each copy is scattered by its number, so that a row
that is a third of the table fills no bucket. Defined cases: null text counts 0 bytes; null and repeated doc_ids are
spread by their text; repeated rows are kept, each with its own slot; other columns, of whatever name and type, are kept
in the files, in `row`; very long texts make a bucket as large as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh_dir

SHARDS, SEED, BUCKET_BYTES, MOST_PARTS = 40, 42, 16 << 20, 50_000
#: Hashes whose rows hold over a bucket's quarter are scattered copy by copy; at most so many, by the threshold's definition.
MOST_HOT = 1_000_000
OVERHEAD = 16
_STEP = 100_000


def _others(docs: DataFrame) -> Column:
    """A hash of all columns but doc_id and text; maps and variants, which have no order and no hash, as JSON."""
    names = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    odd = [f.name for f in names if any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    plain = [docs[f"`{f.name}`"] for f in names if f.name not in odd]
    return F.xxhash64(F.lit(1), *plain, *([F.to_json(F.struct(*(docs[f"`{c}`"] for c in odd)))] if odd else []))


def _copies(rows: DataFrame, hot: DataFrame, seed: int) -> DataFrame:
    """(h, g, row, k) of the rows with a hot hash: equal ones are counted, and made again under a number k each."""
    each = rows.join(F.broadcast(hot.select("h")), "h", "left_semi").groupBy("h", "g").agg(F.any_value("row").alias("row"), F.count("*").alias("n"))
    parts = each.select("h", "g", "row", "n", F.explode(F.expr(f"sequence(0L, n - 1, {_STEP}L)")).alias("at")).repartition("h", "g", "at")
    return parts.select("h", "g", "row", F.explode(F.expr(f"sequence(at, least(at + {_STEP - 1}L, n - 1))")).alias("j")).select("h", "g", "row", F.xxhash64(F.lit(seed), "h", "g", "j").alias("k"))


def write_shards(docs: DataFrame, folder: str | None = None, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> str:
    """Write ``docs`` into ``shard=<n>`` folders of Parquet files with ``(slot, row)``; return the folder."""
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "shards")
    names = ["doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    rows = docs.select(F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), _others(docs).alias("g"), F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"))
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long") + OVERHEAD
    groups = cut(rows.groupBy("h").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), "hashes")
    n_rows, total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    limit = max(bucket_bytes // 4, total // MOST_HOT)
    hot = groups.filter((F.col("bytes") > limit) & (F.col("n") > 1))
    bucket = lambda k: F.expr(f"pmod({k}, {buckets}L)").alias("bucket")
    if hot.isEmpty():
        counts = groups.select(bucket("h"), "n")
        scattered = rows.select(bucket("h"), "h", "g", "row")
    else:
        cold, copies = groups.join(F.broadcast(hot.select("h")), "h", "left_anti"), _copies(rows, hot, seed)
        counts = cold.select(bucket("h"), "n").union(copies.select(bucket("k"), F.lit(1).cast("long")))
        scattered = rows.join(F.broadcast(hot.select("h")), "h", "left_anti").select(bucket("h"), "h", "g", "row").union(copies.select(bucket("k"), "h", "g", "row"))
    # where each bucket's numbers begin: sums within blocks of buckets, and sums of the blocks
    counts = counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("block", F.expr("bucket div 4096"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    starts = counts.join(blocks, "block").select("bucket", (F.col("before") + F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")).alias("start"))
    # a bucket's start travels with its rows, so nothing is broadcast that grows
    item = F.struct("h", "g", "row")
    both = scattered.select("bucket", F.lit(None).cast("long").alias("start"), item.alias("item")).unionByName(starts.select("bucket", "start"), allowMissingColumns=True)
    each = -(-buckets // MOST_PARTS)
    dealt = both.withColumn("part", F.expr(f"cast(bucket div {each} as int)")).repartitionById(-(-buckets // each), F.col("part"))
    held = dealt.groupBy("part", "bucket").agg(F.max("start").alias("start"), F.collect_list("item").alias("items")).sortWithinPartitions("bucket")
    ordered = F.expr("transform(sort_array(transform(items, (x, i) -> struct(x.h, x.g, i))), o -> items[o.i].row)")
    mixed = held.select("start", F.shuffle(ordered, seed).alias("rows"))
    placed = mixed.select("start", F.posexplode("rows").alias("at", "row")).withColumn("place", F.col("start") + F.col("at"))
    shard = F.expr(f"((place + 1) * {shards} - 1) div {max(1, n_rows)}")
    out = placed.withColumn("shard", shard.cast("int")).select("shard", F.expr(f"place - shard * {n_rows}L div {shards}").alias("slot"), "row")
    out.write.partitionBy("shard").parquet(folder)
    return folder


def read_shards(spark, folder: str, docs: DataFrame) -> DataFrame:
    """``(shard int, slot long, row)`` of a folder written from ``docs``."""
    row = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in sorted(docs.schema, key=lambda f: {"doc_id": 0, "text": 1}.get(f.name, 2)))
    return spark.read.schema(f"slot long, row struct<{row}>, shard int").parquet(folder)


def digest(shards: DataFrame) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of written shards."""
    text = F.coalesce("row.text", F.lit(""))
    return shards.select(F.col("row.doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
