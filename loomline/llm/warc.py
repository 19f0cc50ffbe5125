"""Deterministic sharded WARC archives: write, commit, read back.

Records are dealt to shards by exact ranges of page_id and, within one page_id, of a
hash of the rest: a shard ends where the prefix sum of payload bytes passes a multiple
of its size, so neither outlying nor hot ids make shards uneven.  A task sorts one
shard and rolls it into files by compressed size.  An executor writes each file under
a temporary name and renames it when it is complete.  Executors write the list of
files too; a small manifest that the driver writes last names that list and commits
the archive, and readers follow the manifest only.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drop, new_folder, save

#: Payloads of fewer bytes are never told as revisits.
LEAST_REVISIT = 100
#: Payload bytes of a shard, and compressed bytes after which a file is closed.
SHARD_BYTES, FILE_BYTES = 32 << 20, 32 << 20
#: Shards are larger where there would be more of them: their bounds, 16 bytes each, are broadcast.
MOST_SHARDS = 1 << 20
SALTS = 32
#: Stands for no page_id where shards are bounded.
NO_ID = -(1 << 63)
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "MANIFEST.json"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def filesystem(uri: str):
    """A pyarrow filesystem and the path in it, for any scheme that it knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(_uri(uri))


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file://" + path


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as its own gzip member, with regenerated headers and digests."""
    http = _HTTP.format(len(payload)).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%%%02X" % ord(c) for c in url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def records(stream: io.RawIOBase, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of a file; one record in memory at a time."""
    data = stream.read(piece)
    while data:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            if not data and not (data := stream.read(piece)):
                raise ValueError("the file ends within a record")
            parts.append(unzip.decompress(data))
            data = unzip.unused_data if unzip.eof else b""
        whole = b"".join(parts)
        head, _, block = whole.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        if lines[0] != "WARC/1.1" or len(block) != int(headers["Content-Length"]) + 4 or not block.endswith(b"\r\n\r\n"):
            raise ValueError("no WARC record")
        yield headers, block[:-4]
        data = data or stream.read(piece)


def _writer(root: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        out, told = None, []

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                store.move(out["temp"], f"{base}/{out['name']}")  # a file of the same name holds the same bytes
                told.append((out["name"], out["n"], out["bytes"], out["hash"].hexdigest()))
            out = None

        shard, number, told_of = None, 0, None
        for batch in batches:
            plain = {name: batch.column(name).to_pylist() for name in batch.schema.names if name != "html"}
            payload = batch.column("html").cast(pa.binary())
            for row in range(batch.num_rows):
                x = {name: values[row] for name, values in plain.items()}
                page = (x["page_id"], x["url"], x["digest"])
                if x["first_id"] is not None:  # what the next rows of this page refer to
                    told_of, first_id = page, x["first_id"]
                    continue
                revisit = page == told_of
                if x["shard"] != shard:
                    close()
                    shard, number = x["shard"], 0
                elif out and out["bytes"] >= most:
                    close()
                    number += 1
                if out is None:
                    name = f"shard-{shard:06d}-{number:04d}.warc.gz"
                    temp = f"{base}/_temporary-{uuid.uuid4().hex}"
                    out = {"name": name, "temp": temp, "stream": store.open_output_stream(temp, compression=None), "n": 0, "bytes": 0, "hash": hashlib.sha256()}
                packed = record(x["page_id"], x["url"], payload[row].as_py() or b"", x["digest"], first_id if revisit else None, revisit)
                out["stream"].write(packed)
                out["hash"].update(packed)
                out["n"] += 1
                out["bytes"] += len(packed)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "n_records", "bytes", "sha256"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload bytes before each row of a task, and the task's number."""
    from pyspark import TaskContext

    task, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column("payload_bytes").to_numpy()
        upto = before + np.cumsum(size)
        columns = [pa.array(np.full(len(size), task)), batch.column("page_id"), batch.column("spread"), pa.array(upto - size), pa.array(upto)]
        yield pa.RecordBatch.from_arrays(columns, names=["task", "page_id", "spread", "before", "upto"])
        before = int(upto[-1]) if len(upto) else before


def _shards(keys: DataFrame, most: int) -> np.ndarray:
    """The least (page_id, spread) of each shard of about ``most`` payload bytes, in order.

    Exact prefix sums in two levels: within sorted ranges, whose bounds do not matter,
    and over the ranges' totals, of which the driver gets one row each.
    """
    total = keys.agg(F.sum("payload_bytes")).first()[0] or 0
    most = max(most, -(-total // MOST_SHARDS))
    if total <= most:
        return np.zeros((0, 2), np.int64)
    ranges = keys.repartitionByRange("page_id", "spread").sortWithinPartitions("page_id", "spread")
    sums = save(ranges.mapInArrow(_running, "task long, page_id long, spread long, before long, upto long"), "prefix")
    tasks = sorted((r["task"], r["bytes"]) for r in sums.groupBy("task").agg(F.max("upto").alias("bytes")).collect())
    offsets = np.concatenate([[0], np.cumsum([b for _, b in tasks])]).tolist()
    offset = sums.sparkSession.createDataFrame([(t, o) for (t, _), o in zip(tasks, offsets, strict=False)], "task long, offset long")
    shard = sums.join(F.broadcast(offset), "task").groupBy(F.expr(f"(offset + before) div {most}").alias("shard"))
    rows = shard.agg(F.min(F.struct("page_id", "spread")).alias("least")).select("shard", "least.*").toPandas().sort_values("shard")
    drop(sums)
    return rows[["page_id", "spread"]].to_numpy(np.int64)


def _dealt(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """``rows`` with the number of their shard."""
    broadcast = rows.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, spreads = np.ascontiguousarray(broadcast.value.T)
        for batch in batches:
            page, spread = batch.column("page_id").fill_null(NO_ID).to_numpy(), batch.column("spread").to_numpy()
            lo, hi = np.searchsorted(ids, page), np.searchsorted(ids, page, "right")
            place = lo.copy()
            for at in np.unique(lo[lo < hi]):  # pages that a shard begins with
                own = (lo == at) & (lo < hi)
                place[own] = at + np.searchsorted(spreads[at : hi[own][0]], spread[own], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.maximum(place - 1, 0))], names=[*batch.schema.names, "shard"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.LongType())]))


def write(pages: DataFrame, root: str | None = None, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> str:
    """Write ``pages(page_id, url, html, ...)`` as an archive; returns its folder.

    Equal payloads of ``LEAST_REVISIT`` bytes or more: the rows with the smallest
    page_id are responses, the others revisits of it; rows without a page_id
    revisit it too, and where none has one all are responses.  A null html is an
    empty payload.  Rows without a page_id come first.  Rows that repeat wholly share
    a shard.  Running it again gives the same files; an unfinished run has no manifest.
    It runs jobs: the archive stands when it returns.
    """
    spark = pages.sparkSession
    root = root or new_folder(spark, "warc")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # Which pages are revisits is found without their payloads, which are shuffled once, to
    # their shards.  Digests that repeat are dealt over salts: a third of all pages may be copies of one.
    groups = own.filter(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1 and first_id is not null")
    groups = groups.select("digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keys = own.select("page_id", "url", "digest", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int").alias("salt"))
    refers = keys.join(groups, ["digest", "salt"]).filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "url", "digest", "first_id").distinct()
    own = own.withColumn("spread", F.xxhash64("url", "digest"))
    bounds = _shards(own.select(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id"), "spread", "payload_bytes"), shard_bytes)
    none = F.lit(None)
    rows = own.select("page_id", "url", "html", "digest", none.cast("long").alias("first_id"), "spread")
    rows = rows.unionAll(refers.select("page_id", "url", none.cast("string"), "digest", "first_id", F.xxhash64("url", "digest")))
    dealt = _dealt(rows, bounds).repartitionById(max(1, len(bounds)), F.col("shard").cast("int"))
    dealt = dealt.sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "spread", "url", "digest", F.asc_nulls_last("first_id"))
    store, base = filesystem(root)
    store.create_dir(base, recursive=True)
    name = f"files-{uuid.uuid4().hex}"
    dealt.mapInArrow(_writer(root, file_bytes), _FILES).write.parquet(f"{_uri(root)}/{name}")
    told = spark.read.schema(_FILES).parquet(f"{_uri(root)}/{name}").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    body = json.dumps({"version": 2, "files": name, **told.asDict()}, indent=1).encode()
    with store.open_output_stream(f"{base}/_{MANIFEST}", compression=None) as f:
        f.write(body)
    store.move(f"{base}/_{MANIFEST}", f"{base}/{MANIFEST}")
    return root


_FILES = "file string, n_records long, bytes long, sha256 string"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file"]
        rows: list[tuple] = []

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        if head["WARC-Block-Digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
                            raise ValueError(f"{name}: a block does not match its digest")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        page, to = head.get("WARC-Page-ID"), head.get("WARC-Refers-To-Page-ID")
                        rows.append((page and int(page), size, digest, kind, to and int(to), name))
                        if len(rows) >= 20_000:
                            yield told()
        yield told()

    return run


def files(spark: SparkSession, root: str) -> DataFrame:
    """The files of a committed archive: ``file, n_records, bytes, sha256``."""
    store, base = filesystem(root)
    with store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
        name = json.loads(f.read())["files"]
    return spark.read.schema(_FILES).parquet(f"{_uri(root)}/{name}")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The records of a committed archive, one row each, digests verified."""
    names = files(spark, root).select("file")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(tasks, "file").mapInArrow(_reader(root), _READ)


def round_trip(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``, one row per page, also for repeated rows and those
    without an id; no pages give no rows.  See :func:`write` for revisits."""
    return read(pages.sparkSession, write(pages, root)).drop("file")
