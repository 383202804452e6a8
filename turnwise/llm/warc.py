"""WARC archives: a deterministic sharded writer with revisit records, and a reader.

Pages are range-partitioned and sorted by page_id, so shards follow each other.
A shard rolls to its next file when the compressed size passes a limit. Every
record is a gzip member of its own with headers made afresh and digests computed
from what is written; nothing in a file depends on when or where it was written.
Files get their names only when complete, and the manifest, a Parquet table whose
rows are the files with their sizes and SHA-256, commits the whole. A repeated
task writes the same bytes, so losing an executor costs its running shards.

Equal payloads are found by digest, over narrow rows without payloads: a groupBy
that Spark pre-aggregates map-side keeps the largest page_id of each, and a join
on the digest names the pages that revisit it. Those names travel with the
payloads through the one range shuffle, just before their records, whatever the
share of repeated payloads is; no payload is moved for the sake of a join.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.llm.common import cut, sliced, small_batches
from turnwise.llm.files import Pending, store

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Compressed bytes after which a file is closed.
ROLL_BYTES = 256 << 20
#: Records carry this date unless the writer is given another.
DATE = "2020-01-01T00:00:00Z"
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(value: str | None) -> str:
    return " ".join((value or "").split())


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, date: str = DATE) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit has the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = hashlib.sha1(f"{page_id}\n{_header(url)}\n".encode() + payload).hexdigest()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-5{name[13:16]}-8{name[17:20]}-{name[20:32]}>",
        f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}",
    ]
    if _header(url):
        head.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # the header has no time
    return z.compress(data) + z.flush()


def payloads(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, digest (binary; null below ``least`` bytes), payload (binary)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    return rows.select("page_id", "url", F.when(F.octet_length("payload") >= least, F.unhex(F.sha1("payload"))).alias("digest"), "payload")


def revisits(rows: DataFrame) -> DataFrame:
    """page_id, url, digest, refers_to of the rows of :func:`payloads` that revisit another page.

    The join is on the digest: a frequent one is a skewed key on the row side alone, which AQE splits.
    """
    narrow = rows.where("digest is not null").select("page_id", "url", "digest")
    alike = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    named = narrow.join(alike.select("digest", "refers_to"), "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return named.select("page_id", "url", "digest", "refers_to").distinct()


def in_order(pages: DataFrame) -> DataFrame:
    """page_id, url, digest, refers_to, payload, range-partitioned and sorted: each row that names a revisit's target (its payload
    is null, so it is first) stands just before the payloads it is meant for."""
    rows = payloads(pages)
    named = cut(revisits(rows)).withColumn("payload", F.lit(None).cast("binary"))
    both = rows.withColumn("refers_to", F.lit(None).cast("long")).unionByName(named)
    keys = ["page_id", "url", "digest"]
    return both.select(*keys, "refers_to", "payload").repartitionByRange("page_id", "url").sortWithinPartitions(*keys, "payload")


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = DATE, level: int = LEVEL) -> None:
    """Writes ``pages`` (page_id, url, html) into ``folder``: part-SSSSSS-FFFF.warc.gz and manifest/."""

    def run(batches):
        shard, n, out = TaskContext.get().partitionId(), 0, None
        kinds = [("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())]

        def closed():
            out.commit()
            row = [name, records, out.size, digest.hexdigest(), first, last]
            return pa.RecordBatch.from_pydict({k: [x] for (k, _), x in zip(kinds, row, strict=True)}, schema=pa.schema(kinds))

        key = named = None
        for b in sliced(batches):
            for page_id, url, digest_of, refers, payload in zip(*(b.column(i) for i in range(5)), strict=True):
                last, url, payload = page_id.as_py(), url.as_py(), payload.as_py()
                mine = (last, url, digest_of.as_py())
                if payload is None:
                    key, named = mine, refers.as_py()
                    continue
                target = named if key == mine else None
                if out is None:
                    name, records, digest, first = f"part-{shard:06d}-{n:04d}.warc.gz", 0, hashlib.sha256(), last
                    out, n = Pending(folder, name), n + 1
                data = gzip_member(record(last, url, payload, target, target is not None, date), level)
                out.write(data)
                digest.update(data)
                records += 1
                if out.size >= roll_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    schema = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
    ordered = in_order(pages)
    with small_batches(pages.sparkSession):
        ordered.mapInArrow(run, schema).write.mode("overwrite").parquet(f"{folder}/manifest")


def parsed_records(chunks):
    """(header dict, block) of each record of a compressed stream, holding one record at a time."""
    z, held = None, b""
    for data in chunks:
        while data:
            z = z or zlib.decompressobj(31)
            held += z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = None
                head, _, rest = held.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                size = int(fields["Content-Length"])
                if rest[size:] != b"\r\n\r\n":
                    raise ValueError("a record's length is not its Content-Length")
                yield fields, rest[:size]
                held = b""
    if z is not None:
        raise ValueError("the archive ends inside a record")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record of the files in the manifest.

    The digest of a response is computed from its payload and must be the one
    in its header; a revisit's length and digest are those of its headers.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = manifest.count()

    def run(batches):
        where, path = store(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            for file in b.column("file").to_pylist():
                rows = []
                with where.open_input_stream(f"{path}/{file}", compression=None) as f:
                    for h, block in parsed_records(iter(lambda: f.read(1 << 20), b"")):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        if h["WARC-Block-Digest"] != _sha1(block) or h["WARC-Type"] == "response" and (h["WARC-Payload-Digest"] != _sha1(payload) or size != len(payload)):
                            raise ValueError(f"{file}: a record of page {h.get('X-Page-Id')} is damaged")
                        digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                        ids = [int(h[k]) if k in h else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        rows.append((ids[0], h.get("WARC-Target-URI"), size, digest, h["WARC-Type"], ids[1]))
                        if len(rows) == 1000:
                            yield made(rows)
                            rows = []
                yield made(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return manifest.select("file").repartitionByRange(max(1, n), "file").mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` and returns what the archives say of each.

    Null html is an empty payload, a null url an absent header. Of equal
    payloads the rows with the largest page_id are responses, also where that
    id repeats; a null page_id is never the largest unless all are null. An
    empty table makes an empty manifest. Other columns are ignored.
    """
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder)
