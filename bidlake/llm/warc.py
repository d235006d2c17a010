"""WARC archives: a writer with revisit records, and a splittable reader.

Writing. Each page is a WARC/1.1 record in a gzip member of its own. Pages with equal
payloads are found by a groupBy on a SHA-256 of the payload (pre-aggregated, so a payload
that a third of all pages share does no harm; joins back are salted, and payloads are moved
by id and digest); the largest page_id is the response, the others are revisits that name it
and hold no payload. Tasks write to the shared folder, each
attempt under a name of its own; a manifest table, which Spark commits for successful
attempts only, says which files count.

Reading. A file is cut into byte ranges, one row each, and Spark deals the ranges out, in as
many tasks as the archives' bytes ask for. A
task scans its range for the gzip magic, decodes the start of each candidate member and
takes it for a record if it begins with a WARC version line; it owns the records that start
inside its range and reads the last of them past the range's end. Candidates inside
compressed data fail the decoding. From a record on, the next one starts where it ends.
Payloads are hashed piece by piece as they are decompressed.

Defined cases. Null html is an empty payload; payloads of fewer bytes than `least` are all
responses. A null page_id is written as such, and is a response unless an equal payload has
an id. Rows that share page_id and payload are all responses if they are the largest. Null
and unusual URLs are percent-encoded. An empty table writes no files and gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm.common import Workspace

MAGIC, FILE_BYTES, RANGE_BYTES, TASK_BYTES, READ, SALTS = b"\x1f\x8b\x08", 256 << 20, 8 << 20, 128 << 20, 1 << 18, 32
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long"


def open_read(path: str):
    """A seekable file in a shared folder or any store that pyarrow knows."""
    if path.startswith("/") or path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), "rb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def open_write(path: str):
    if path.startswith("/") or path.startswith("file:"):
        import os

        path = re.sub("^file:/*", "/", path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    return store.open_output_stream(at)


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One record's gzip member. refers_to: None for a response."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{sha}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def decide(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null: response) of each page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    light = rows.where(F.octet_length("payload") >= least).select("page_id", "sha")
    groups = light.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 AND top IS NOT NULL")
    # a digest that a third of all pages share meets its group in SALTS places, and payloads meet their verdicts by id and digest
    salted = groups.select(F.col("sha").alias("sha_"), "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_"))
    again = light.distinct().withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), (F.col("sha") == F.col("sha_")) & (F.col("salt") == F.col("salt_")))
    again = again.where(~F.col("page_id").eqNullSafe(F.col("top"))).select(F.col("page_id").alias("id_"), F.col("sha").alias("sha_"), "top")
    known = rows.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("id_")) & (F.col("sha") == F.col("sha_")), "left")
    return known.select("page_id", "url", "payload", F.col("top").alias("refers_to"))


def write(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", least: int = 0) -> DataFrame:
    """The manifest: path and bytes of each archive; computing it writes the archives."""

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        path, f, size, done = None, None, 0, []
        for batch in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f is None:
                    path, size = f"{folder}/pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    f = open_write(path)
                data = record(page_id, url, payload, refers, date)
                f.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    f.close()
                    done.append((path, size))
                    f = None
        if f is not None:
            f.close()
            done.append((path, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([n for _, n in done], pa.int64())], ["path", "bytes"])

    return decide(pages, least).mapInArrow(run, "path string, bytes long")


class Window:
    """Reads a file forward through a buffer, with its own count of the place."""

    def __init__(self, f, at: int):
        self.f, self.at, self.data = f, at, b""
        f.seek(at)

    def more(self) -> bool:
        got = self.f.read(READ)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _starts_record(data: bytes) -> bool:
    """Whether a gzip member of a WARC record begins here; data: its first bytes."""
    try:
        return zlib.decompressobj(31).decompress(data[:4096], 64).startswith(b"WARC/")
    except zlib.error:
        return False


def read_range(path: str, start: int, stop: int):
    """The records that start in [start, stop): (offset, headers, payload bytes as read, SHA-1 of them, HTTP length)."""
    with open_read(path) as f:
        w, aligned = Window(f, start), False
        while w.at < stop:
            while len(w.data) < 4096 and w.more():
                pass
            if not w.data:
                return
            at = 0 if aligned and w.data.startswith(MAGIC) else w.data.find(MAGIC)
            if at < 0:
                aligned = False
                w.drop(max(1, len(w.data) - 2) if len(w.data) > 2 else len(w.data))
                continue
            w.drop(at)
            if w.at >= stop:
                return
            while len(w.data) < 4096 and w.more():
                pass
            if not _starts_record(w.data):
                aligned = False
                w.drop(1)
                continue
            yield read_record(w)
            aligned = True


def read_record(w: Window) -> tuple:
    offset, z, head, sha, n, http = w.at, zlib.decompressobj(31), b"", hashlib.sha1(), 0, None
    headers: dict[str, str] = {}
    left = length = None
    while not z.eof:
        if not w.data and not w.more():
            raise EOFError(f"a record that starts at {offset} has no end")
        part = w.data
        got = z.decompress(part, 1 << 20)
        rest = z.unconsumed_tail or z.unused_data
        w.drop(len(part) - len(rest))
        if left is None or http is None:
            head += got
            got = b""
            if left is None and b"\r\n\r\n" in head:
                raw, _, head = head.partition(b"\r\n\r\n")
                headers = dict(x.split(": ", 1) for x in raw.decode().split("\r\n")[1:])
                left = int(headers["Content-Length"])
            if left is not None and http is None and b"\r\n\r\n" in head:
                raw, _, got = head.partition(b"\r\n\r\n")
                http = dict(x.split(": ", 1) for x in raw.decode().split("\r\n")[1:])
                left -= len(raw) + 4
                length = int(http["Content-Length"])
        if http is not None and got:
            body = got[: max(left, 0)]
            sha.update(body)
            n, left = n + len(body), left - len(body)
    return offset, headers, n, base64.b32encode(sha.digest()).decode(), length


def read(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the archives of a manifest (path, bytes)."""
    ranges = manifest.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))

    def run(batches):
        import pyarrow as pa

        number = lambda u: None if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", u or "")) is None else int(m[1])
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                for offset, h, n, sha, length in read_range(path, start, start + range_bytes):
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (sha != said or n != length):
                        raise ValueError(f"the payload of the record at {offset} of {path} isn't what its header says")
                    rows.append((number(h["WARC-Record-ID"]), length, said, h["WARC-Type"], number(h.get("WARC-Refers-To")), h.get("WARC-Target-URI"), path, offset))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    # ranges are tiny rows, which adaptive execution would gather in one task: as many tasks as the bytes ask for
    size = manifest.agg(F.sum("bytes"), F.sum(F.ceil(F.col("bytes") / range_bytes))).first()
    tasks = max(1, min(size[1] or 1, max(-(-(size[0] or 0) // TASK_BYTES), 4 * manifest.sparkSession.sparkContext.defaultParallelism)))
    return ranges.repartition(tasks).mapInArrow(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages into archives in the shared folder and read them back."""
    ws = Workspace(spark, "warc")
    return read(ws.cut(write(pages, f"{ws.path}/archives", least=least), "manifest"))
