"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each record is its own gzip member. The writer returns one index row a record - file, offset, length, URL, digest,
type - which is stored as Parquet beside the archives before anything is read; files of attempts that failed are never
in it. Readers take any selection of index rows, deal them out by stretches of files, sort them by offset, and join
neighbours into one read.

Equal payloads: the smallest page_id is the response, the others revisit it, found by a partial aggregate over digests
and a join of ids, so that payloads cross the network once. Null html is an empty payload; null page_ids are never
revisits; rows that repeat the smallest page_id with its payload are all responses. Control characters in URLs are
percent-encoded in the archive. An empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch, small_batches

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long, payload_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "1970-01-01T00:00:00Z"
STRETCH = 64 << 20
GAP, READ = 256 << 10, 8 << 20
#: The members of a file are written out when so many bytes have gathered.
FLUSH = 4 << 20


def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def render(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(payload), payload)
        head.append("Content-Type: application/http; msgtype=response")
    else:
        block = b""
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(h["Content-Length"])]
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if h["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if b32(payload) != digest:
            raise ValueError(f"damaged payload in {h['WARC-Record-ID']}")
    num = lambda x: int(x) if (x := x.split(":")[2]) else None
    return {
        "page_id": num(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "payload_bytes": int(h["X-Payload-Length"]) if payload is None else len(payload), "payload_digest": digest,
        "record_type": h["WARC-Type"], "refers_to": num(h["WARC-Refers-To"]) if payload is None else None, "payload": payload,
    }


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes the archives to folder, a URI that driver and executors share, and returns the stored index."""
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"), F.unhex(F.sha1(body)).alias("sha"))
    ids = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "sha")
    first = ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("sha").alias("_sha"), "first")
    again = ids.join(first, F.col("sha") == F.col("_sha")).where("page_id > first").select(F.col("page_id").alias("_id"), "_sha", "first").distinct()
    rows = rows.join(again, (rows["page_id"] == again["_id"]) & (rows["sha"] == again["_sha"]), "left").select("page_id", "url", "html", "first")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        held, size = [], 0
        for b in batches:
            index = []
            for i, u, t, r in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                payload = t.encode()
                digest = b32(payload)
                z = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = z.compress(render(i, u, payload, digest, r)) + z.flush()
                held.append(member)
                size += len(member)
                index.append((i, name, at, len(member), u, digest, "response" if r is None else "revisit", r, len(payload)))
                at += len(member)
                if size > FLUSH:
                    out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(b"".join(held))
                    held, size = [], 0
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        if held:
            out = out or store.open_output_stream(f"{base}/{name}", compression=None)
            out.write(b"".join(held))
        if out:
            out.close()

    to = f"{folder}/index.parquet"
    rows.mapInArrow(archive, INDEX).write.parquet(to)
    return pages.sparkSession.read.parquet(to)


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index rows."""
    rows = index.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def load(file: str, run: list[tuple[int, int]]) -> pa.RecordBatch:
            lo, hi = run[0][0], max(o + n for o, n in run)
            with store.open_input_file(f"{base}/{file}") as f:
                f.seek(lo)
                data = f.read(hi - lo)
            got = [parse(data[o - lo : o - lo + n]) for o, n in run]
            return pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in zip(names, kinds, strict=True)], names)

        file, run = None, []
        for b in batches:
            for f, o, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if run and (f != file or o - (run[-1][0] + run[-1][1]) > GAP or o + n - run[0][0] > READ):
                    yield load(file, run)
                    run = []
                file = f
                run.append((o, n))
        if run:
            yield load(file, run)

    return rows.mapInArrow(fetch, RECORD)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sql() -> str:
    """DuckDB has no base32 of bytes: 32 groups of 5 bits from the 160 bits of the digest."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = "list_aggregate(list_transform(string_split(regexp_replace(sha1(p), '(.)', '\\1,', 'g'), ',')[1:40], lambda c: right('0000' || bin(strpos('0123456789abcdef', c) - 1), 4)), 'string_agg', '')"
    return f"""
    WITH a AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
    b AS (SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes, {bits} AS bits, min(page_id) OVER (PARTITION BY p) AS first FROM a),
    c AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda k: substr('{alphabet}', 1 + list_sum(list_transform(range(0, 5), lambda j: CASE WHEN substr(bits, 5 * k + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END))::INT, 1)), 'string_agg', '') AS payload_digest FROM b)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to FROM c"""
