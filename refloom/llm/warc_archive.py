"""Operator 1: a deterministic sharded WARC writer, and its reader.

Records are dealt into shards by ranges of (page_id, hash of the digest); the bounds come from the pages with the smallest
hashes, so they depend on the rows alone, and neither null ids nor one repeated id are a single shard. Each shard is
written in that order, one gzip member a record, and a new file starts
when the compressed size passes ROLL_BYTES. Headers, record ids and digests are made anew from the payload. Of pages
with equal payloads of at least REVISIT_BYTES bytes the smallest page_id is the response, the others are revisits; which
pages those are is found from digests alone, and travels to the shards beside the pages, so a page's html is shuffled
once and a payload that a third of all pages share never meets in one task.

A task writes under temporary names and returns a manifest row for each file; Spark's commit of the manifest keeps the
rows of just one attempt of each task. Only files in the manifest are then renamed, a step that can be repeated, the
rest is removed, and MANIFEST.jsonl, a folder of JSON lines that Spark commits last, marks a whole archive. The folder must be one that all executors see,
reached through Arrow's file systems (file, hdfs, s3, gs).

Defined cases: null html is an empty payload, empty payloads and those under REVISIT_BYTES are all responses; a null
page_id is written without an id, is always a response and is referred to by none; of repeated rows of the smallest
page_id the first is the response and the others revisit it (they share a shard, which streams them); very long payloads
are held one at a time; a null url becomes `urn:page:<id>`, white space in a url is
percent-encoded; other columns are ignored; an empty table gives an archive without files.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import uuid
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_dir, join_groups, small_batches

REVISIT_BYTES, SHARD_BYTES, ROLL_BYTES = 100, 16 << 20, 64 << 20
#: With 16 MB a shard up to 1 TB; beyond it shards grow, and roll into more files.
MOST_SHARDS, LEVEL, DATE = 65_536, 6, "1970-01-01T00:00:00Z"
_MANIFEST = "shard int, seq int, temporary string, name string, records long, bytes long, sha256 string"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def record_id(page_id, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{nth}')}>"


def record(page_id, url, payload: bytes, digest: str, nth: int, first) -> bytes:
    """One record; ``first`` is the page_id of the response that it revisits, or null."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest, nth)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if first is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {record_id(first, digest, 0)}", f"X-Refers-To-Page: {first}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches, folder, roll):
    """Rows (shard, page_id, digest, kind, first_id, url, html) in order; kind 0 tells that a page revisits, 1 is a page."""
    system, base = _open(folder)
    done, out, now = [], None, {}
    page, mark, nth = None, None, -1

    def close():
        out.close()
        done.append({k: now[k] for k in ("shard", "seq", "temporary", "name", "records", "bytes")} | {"sha256": now["sum"].hexdigest()})

    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}
            key = (row["shard"], row["page_id"], row["digest"])
            if key != page:
                page, mark, nth = key, None, -1
            if row["kind"] == 0:
                mark = row["first_id"]
                continue
            if out is None or now["shard"] != row["shard"] or now["bytes"] >= roll:
                seq = 0
                if out is not None:
                    close()
                    seq = now["seq"] + 1 if now["shard"] == row["shard"] else 0
                name = f"part-{row['shard']:05d}-{seq:05d}.warc.gz"
                now = {"shard": row["shard"], "seq": seq, "temporary": f"{name}.{uuid.uuid4().hex}", "name": name, "records": 0, "bytes": 0, "sum": hashlib.sha256()}
                out = system.open_output_stream(f"{base}/_temporary/{now['temporary']}")
            payload = row["html"] or b""
            digest, nth, first = row["digest"], nth + 1, mark
            if first is None and nth and row["page_id"] is not None and len(payload) >= REVISIT_BYTES:
                first = row["page_id"]
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = z.compress(record(row["page_id"], row["url"], payload, digest, nth, first)) + z.flush()
            out.write(data)
            now["sum"].update(data)
            now["records"] += 1
            now["bytes"] += len(data)
    if out is not None:
        close()
    yield pa.RecordBatch.from_pylist(done, pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))


def _commit(batches, folder):
    system, base = _open(folder)
    for batch in batches:
        for temporary, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist()):
            try:
                system.move(f"{base}/_temporary/{temporary}", f"{base}/{name}")
            except OSError:
                if system.get_file_info(f"{base}/{name}").type != fs.FileType.File:  # else an earlier attempt moved it
                    raise
        yield batch


_FIRST = -(1 << 63)  # where null ids are sorted


def _shards(meta: DataFrame, total: int, shard_bytes: int):
    """(number of shards, shard of page_id and sub): equal ranges by the pages with the smallest hashes."""
    n = max(1, min(math.ceil(total / shard_bytes), MOST_SHARDS))
    place = meta.select(F.coalesce("page_id", F.lit(_FIRST)).alias("id"), "sub")
    some = place.orderBy(F.xxhash64("id", "sub"), "id", "sub").limit(16 * n if n > 1 else 0).collect()  # at most 16 * MOST_SHARDS pairs
    keys = sorted((r["id"], r["sub"]) for r in some)
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    ids = np.array([x for x, _ in bounds], np.int64)

    @F.pandas_udf("int")
    def shard(page_ids: pd.Series, subs: pd.Series) -> pd.Series:
        at = page_ids.to_numpy(np.int64)
        low, high = np.searchsorted(ids, at, side="left"), np.searchsorted(ids, at, side="right")
        for i in np.flatnonzero(low < high):  # ids that are a bound's: the digest decides
            low[i] = bisect.bisect_right(bounds, (int(at[i]), int(subs.iloc[i])))
        return pd.Series(low.astype(np.int32))

    return len(bounds) + 1, shard(F.coalesce("page_id", F.lit(_FIRST)), F.col("sub"))


def write_archive(pages: DataFrame, folder: str | None = None, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> str:
    """Write ``pages(page_id, url, html)`` as an archive and return its folder, a new one in the shared folder if not given."""
    spark = pages.sparkSession
    folder = (folder or fresh_dir(spark, "warc")).rstrip("/")
    system, base = _open(folder)
    system.create_dir(f"{base}/_temporary", recursive=True)
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    sub = F.xxhash64("digest").alias("sub")
    meta = cut(rows.select("page_id", "digest", sub, F.octet_length("html").cast("long").alias("size")), "payloads")
    total, n_rows = meta.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    long = meta.filter(F.col("page_id").isNotNull() & (F.col("size") >= REVISIT_BYTES)).select("page_id", "digest")
    groups = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n_rows")).filter("n_rows > 1")
    marks = join_groups(long, groups, "digest", n_rows).filter("page_id <> first_id").select("page_id", "digest", "first_id").distinct()
    n, shard = _shards(meta, total, shard_bytes)
    order = rows.select("page_id", "digest", sub, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first_id"), "url", "html")
    order = order.unionByName(marks.select("page_id", "digest", sub, F.lit(0).alias("kind"), "first_id"), allowMissingColumns=True)
    dealt = order.withColumn("shard", shard).repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.coalesce("page_id", F.lit(_FIRST)), "sub", "page_id", "digest", "kind", "url")
    dealt = dealt.select("shard", "page_id", "digest", "kind", "first_id", "url", "html")
    manifest = cut(dealt.mapInArrow(partial(_write, folder=folder, roll=roll_bytes), _MANIFEST), "manifest")
    moved = manifest.repartitionByRange("name").sortWithinPartitions("name").mapInArrow(partial(_commit, folder=folder), _MANIFEST)
    moved.select(F.to_json(F.struct("name", "records", "bytes", "sha256")).alias("value")).write.mode("overwrite").text(f"{folder}/MANIFEST.jsonl")
    system.delete_dir(f"{base}/_temporary")
    return folder


def members(stream, size: int = 1 << 20):
    """The gzip members of a stream, decompressed, one at a time."""
    rest = b""
    while True:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            rest = rest or stream.read(size)
            if not rest:
                if out:
                    raise EOFError("a record is cut off")
                return
            out.append(z.decompress(rest))
            rest = z.unused_data
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """A record as written by ``record``; a wrong block or payload digest is an error."""
    head, _, block = data.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(names["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != names["WARC-Block-Digest"]:
        raise ValueError(f"wrong block digest in {names['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, kind = names["WARC-Payload-Digest"].removeprefix("sha256:"), names["WARC-Type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"wrong payload digest in {names['WARC-Record-ID']}")
    size = int(http.decode().rpartition("Content-Length: ")[2])
    page, first = names.get("X-Page"), names.get("X-Refers-To-Page")
    return {"page_id": None if page is None else int(page), "url": names["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": None if first is None else int(first), "payload": payload if kind == "response" else None}


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _read(batches, folder, payloads):
    system, base = _open(folder)
    schema = _RECORD.append(pa.field("payload", pa.binary())) if payloads else _RECORD
    for batch in batches:
        for name in batch.column(0).to_pylist():
            rows = []
            with system.open_input_stream(f"{base}/{name}", compression=None) as f:
                for data in members(f):
                    rows.append({k: v for k, v in parse(data).items() if payloads or k != "payload"})
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload])`` of all records, digests checked."""
    files = spark.read.schema("name string").json(f"{folder}/MANIFEST.jsonl").repartition("name")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return files.mapInArrow(partial(_read, folder=folder, payloads=payloads), schema)
