"""WARC archives: write, index, and read back by coalesced byte ranges.

Records are gzip members of their own, as is usual, so that a record can be read
by its offset and length. The writer knows both as it writes; the index comes
first, as a table, and a reader selects records from it before any archive is
opened. Archives lie in the cluster's shared folder and are reached through
pyarrow's file systems, which serve file, hdfs, s3 and gs addresses alike.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: Ranges nearer than GAP bytes are read as one, up to SPAN bytes.
GAP, SPAN = 64 << 10, 8 << 20
#: Bytes of archives that a reading task is dealt.
TASK = 4 << 20


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def _uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, block = ("response", http + payload) if first is None else ("revisit", http)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(first)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> dict:
    """The fields of one record; raises ValueError if its payload doesn't match its digest."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    at = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(at["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    digest, kind = at["WARC-Payload-Digest"].removeprefix("sha1:"), at["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"digest of {at['WARC-Record-ID']}")
    return {"page_id": number(at["WARC-Record-ID"]), "url": at.get("WARC-Target-URI"), "payload_digest": digest, "record_type": kind,
            "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "refers_to": number(at.get("WARC-Refers-To")),
            "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", salts: int = 32) -> None:
    """Write ``pages`` (page_id, url, html) below ``path``: archives, and the index as a table in path/index.

    Of equal payloads of ``min_revisit_bytes`` or more, the smallest page_id's
    record is the response and others revisit it. Rows that repeat that page_id
    are responses too. Null html is an empty payload; a null page_id revisits
    equal payloads of pages with an id, and is a response where there is none.
    Only payloads seen twice take part in the join, and their rows are dealt over
    ``salts`` partitions, so that one payload of a third of all pages is no
    large task. Partitions are sorted, so a task that runs again writes the same.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    seen = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    seen = seen.where("n > 1 AND first IS NOT NULL").select(F.col("sha").alias("sha2"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt2"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    rows = rows.join(seen, (rows["sha"] == seen["sha2"]) & (rows["salt"] == seen["salt2"]), "left")
    rows = rows.select("page_id", "url", "payload", "sha", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("first"))
    rows = rows.sortWithinPartitions("page_id", "sha", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, root = _open(path + "/warc")
        files.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():05d}.warc.gz"
        tmp, at, none = f"{root}/.{name}.{task.taskAttemptId()}", 0, True
        with files.open_output_stream(tmp) as out:
            for b in batches:
                cols = [b.column(n).to_pylist() for n in ("page_id", "url", "payload", "sha", "first")]
                found = []
                for page_id, url, payload, sha, first in zip(*cols, strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    rec = _record(page_id, url, payload, digest, first, date)
                    out.write(rec)
                    found.append((name, at, len(rec), url, digest, page_id, "response" if first is None else "revisit"))
                    at += len(rec)
                    none = False
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), _schema(INDEX).types, strict=True)], schema=_schema(INDEX))
        if none:
            files.delete_file(tmp)
        else:
            files.move(tmp, f"{root}/{name}")

    rows.mapInArrow(write, INDEX).write.parquet(path + "/index")


def read_index(spark, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path + "/index")


def read_records(selected: DataFrame, path: str, with_payload: bool = True) -> DataFrame:
    """The records of ``selected`` rows of the index, read in order of offset, near ranges at once.

    They are dealt to a task for each ``TASK`` bytes of archives, and 20,000 at most.
    """
    small_batches(selected.sparkSession)
    size = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = min(20_000, 1 + size // TASK)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path + "/warc")
        name, handle = None, None
        for b in batches:
            rows = list(zip(*(b.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True))
            k, done = 0, []
            while k < len(rows):
                file, start, length = rows[k]
                j, end = k + 1, start + length
                while j < len(rows) and rows[j][0] == file and 0 <= rows[j][1] - end <= GAP and rows[j][1] + rows[j][2] - start <= SPAN:
                    end, j = rows[j][1] + rows[j][2], j + 1
                if file != name:
                    name, handle = file, files.open_input_file(f"{root}/{file}")
                data = handle.read_at(end - start, start)
                done += [parse(data[o - start : o - start + n]) for _, o, n in rows[k:j]]
                k = j
            if done:
                if not with_payload:
                    for x in done:
                        x["payload"] = None
                yield pa.RecordBatch.from_pylist(done, schema=_schema(READ))

    return selected.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, READ)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return read_records(read_index(pages.sparkSession, path), path, with_payload=False).drop("payload")
