"""WARC archives: a writer that stores each payload once, and a splittable reader.

Every record is a gzip member of its own. A reading task gets a byte range, looks for gzip
magic, accepts a candidate if its first bytes decode to a WARC header, and from there reads
member after member as long as they start inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

MAGIC, SPLIT, READ = b"\x1f\x8b\x08", 8 << 20, 1 << 18
NONE = "none"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {re.sub('[\r\n]', '', uri)}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes one archive per partition under path; returns its table (path, size, records).

    Of rows with equal payloads of at least `least` bytes, that of the least id is a response
    and the others are revisits of it; rows of that same id (repeated rows) are responses all.
    A null payload is empty, a null url has no target, a row of a null id revisits the least
    id with its payload if there is one. An archive gets its name when it is whole, so a task
    that is run again replaces what a lost one left.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    first = rows.where(F.octet_length("payload") >= least).select("id", "sha").groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "sha", "left").select("id", "url", "payload", F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = _open(path)
        files.create_dir(root, recursive=True)
        name, size, n = f"part-{task.partitionId():06d}.warc.gz", 0, 0
        tmp = f"{root}/.{name}.{task.taskAttemptId()}"
        with files.open_output_stream(tmp, compression=None) as out:
            for b in batches:
                for key, url, payload, refers in zip(*(b.column(i) for i in range(4)), strict=True):
                    key, refers = key.as_py(), refers.as_py()
                    got = member(NONE if key is None else str(key), url.as_py(), payload.as_py().encode(), None if refers is None else str(refers))
                    out.write(got)
                    size += len(got)
                    n += 1
        files.move(tmp, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([size]), pa.array([n])], ["path", "size", "records"])

    return written(rows.mapInArrow(run, "path string, size long, records long"), "archives")


def parse(record: bytes) -> tuple | None:
    """(record id, type, target, refers to, declared digest, payload length, payload) of a decoded member."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", "0"))]
    http, cut, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    declared = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    revisit = fields.get("warc-type") == "revisit"
    return (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(declared[1]) if revisit and declared else len(payload), None if revisit else payload)


def members(file, start: int, end: int):
    """Decoded members that start in [start, end) of a random access file."""
    size, at = file.size(), start
    synced = False
    while at < min(end, size):
        if not synced:
            file.seek(at)
            chunk = file.read(READ + 2)
            found = chunk.find(MAGIC)
            if found < 0:
                at += max(1, len(chunk) - 2)
                continue
            at += found
            if at >= end:
                return
        file.seek(at)
        z, parts, fed = zlib.decompressobj(31), [], 0
        try:
            while not z.eof:
                chunk = file.read(READ if parts else 16384)
                if not chunk:
                    raise zlib.error("cut short")
                fed += len(chunk)
                parts.append(z.decompress(chunk))
                if len(parts) == 1 and not parts[0].startswith(b"WARC/1."):
                    raise zlib.error("no record")
        except zlib.error:
            at, synced = at + 1, False
            continue
        yield b"".join(parts)
        at, synced = at + fed - len(z.unused_data), True
        if at < size:
            file.seek(at)
            synced = file.read(3) == MAGIC


def read_archives(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """Records of the archives (path, size), read in ranges of `split` bytes.

    record_id, type, target, refers_to, payload_digest (as declared), payload_bytes (of the
    full payload), payload (null for revisits), digest_ok (null for revisits). Damaged members
    are skipped. Empty archives have no rows.
    """
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long"))).alias("start"))
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_())
    names = ["record_id", "type", "target", "refers_to", "payload_digest", "payload_bytes", "payload", "digest_ok"]

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                files, at = _open(path)
                out, held = [], 0
                with files.open_input_file(at) as file:
                    for record in members(file, start, start + split):
                        got = parse(record)
                        if got:
                            out.append((*got, None if got[6] is None else digest(got[6]) == got[4]))
                            held += len(record)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    n = archives.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return ranges.repartition(int(n), "path", "start").mapInArrow(run, "record_id string, type string, target string, refers_to string, payload_digest string, payload_bytes long, payload binary, digest_ok boolean")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages to archives and returns what reading them gives."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_archives(write_archives(pages, new_path(spark, "warc")))

    def number(c):
        return F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")

    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "digest_ok")
