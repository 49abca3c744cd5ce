"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Writer. Payloads are hashed (SHA-1) and grouped by digest; of a group whose payload has at least `min_bytes` bytes, the
page with the largest id is written as a response and the others as revisits that name it. Groups are first reduced
within a salt, then across salts, and the answer is handed back to just the salts that asked, so that a payload held by a
third of all pages is not gathered in one task. Each record is a gzip member of its own. A task writes files of its own
name, and only files named in the manifest (itself a Parquet table in the shared folder, committed by Spark) are read:
what a lost or repeated task left behind does not count.

Reader. Files are cut into byte ranges. The task of a range looks for gzip's magic bytes, takes a place as a member only
if its first bytes inflate to the whole head of a WARC record (version, named fields, type, id and a length), owns the
members that start inside its range, and reads on past the end of the range to finish the last one. Digest and length of a
response are computed from the payload that was read; `verified` says whether the head gives the same.

Nothing is lost in silence. An archive is members from its first byte to its last: a file that isn't as long as the manifest
says, a member that doesn't inflate to its end, and bytes between two members are errors, unless strict is off, where such
bytes are passed over. As each task also looks at what follows its last member, a member whose head is damaged is noticed
by the task before.

Defined results: a null html is an empty payload. A null url is written as urn:page:<id>. A page without id is a response
and is referred to by none. Pages equal in id and payload are all responses if theirs is the largest id of the group.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import short_batches, scratch

MIN_BYTES = 1000
#: Pages with one digest are first reduced in so many parts.
SALTS = 64
MAGIC = b"\x1f\x8b\x08"
#: What a candidate member has to begin with.
VERSION = b"WARC/1."
FIELDS = ("warc-type", "warc-record-id", "content-length")
#: Bytes of a reader's range, of one read, and of what is inflated at once.
RANGE, CHUNK, STEP = 32 << 20, 1 << 20, 1 << 12
#: Bytes of records that a reader hands on at once.
BATCH = 16 << 20
#: A file is closed when it has grown to this; the next record opens another.
ROLL = 1 << 30
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, stored_bytes long, verified boolean, path string, offset long"


def resolved(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest and refers_to (null: the page is written as a response)."""
    html = F.coalesce("html", F.lit(""))
    marked = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("length"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("salt"))
    parts = marked.where(F.col("length") >= min_bytes).groupBy("digest", "salt").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("digest").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts")).where("n > 1")
    answers = groups.select("digest", "last", F.explode("salts").alias("salt"))
    return marked.join(answers, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def member(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    body = html.encode("utf-8")
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {' '.join(url.split()) if url else name}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(body)}", "Content-Type: application/http;msgtype=response"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        body = b""
    block = http + body
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _write(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    files, base = fs.FileSystem.from_uri(root)
    out = path = None
    size = records = 0
    done: list[tuple[str, int, int]] = []
    for batch in batches:
        for row in batch.to_pylist():
            if out is None:
                path, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                out = files.open_output_stream(f"{base}/{path}", compression=None)
            packed = member(row["page_id"], row["url"], row["html"], row["digest"], row["refers_to"])
            out.write(packed)
            size, records = size + len(packed), records + 1
            if size >= ROLL:
                out.close()
                done.append((path, records, size))
                out = None
    if out is not None:
        out.close()
        done.append((path, records, size))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])


def write_archives(pages: DataFrame, root: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes the archives below root (a new folder in the shared one); gives the manifest: path, records, bytes."""
    spark = pages.sparkSession
    short_batches(spark)
    root = root or scratch(spark, "warc")
    files, base = fs.FileSystem.from_uri(root)
    files.create_dir(base, recursive=True)
    resolved(pages, min_bytes).mapInArrow(lambda b: _write(b, root), MANIFEST).write.parquet(f"{root}-manifest")
    return spark.read.parquet(f"{root}-manifest").withColumn("path", F.concat(F.lit(root + "/"), "path"))


class _Window:
    """A file read forwards from a place, in chunks. What has been passed is dropped when the next chunk is read."""

    def __init__(self, source: pa.NativeFile, at: int, size: int):
        self.source, self.at, self.size, self.data, self.passed = source, at, size, b"", 0

    def fill(self, n: int) -> int:
        """Bytes that are there from here on: n at least, if the file has them."""
        while (there := len(self.data) - self.passed) < n and (start := self.at + there) < self.size:
            self.source.seek(start)
            self.data, self.passed = self.data[self.passed :] + self.source.read(min(CHUNK, self.size - start)), 0
        return there

    def view(self, start: int, n: int) -> memoryview:
        """n bytes, or those that the file has, from so many bytes after here."""
        self.fill(start + n)
        return memoryview(self.data)[self.passed + start : self.passed + start + n]

    def find(self, mark: bytes) -> int:
        """How far from here the mark is in what has been read; -1 if it isn't there."""
        return max(self.data.find(mark, self.passed) - self.passed, -1)

    def skip(self, n: int) -> None:
        self.at, self.passed = self.at + n, self.passed + n


def head_of(raw: bytes) -> dict[str, str] | None:
    """Fields of a record's head, with names in lower case; null if this is no whole head of a record."""
    head, end, _ = raw.partition(b"\r\n\r\n")
    if not end or not head.startswith(VERSION):
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if all(f in fields for f in FIELDS) and fields["content-length"].isdecimal() else None


def _is_member(w: _Window) -> bool:
    """Whether what is here inflates to the whole head of a record, however long it is."""
    inflate, head, taken = zlib.decompressobj(31), b"", 0
    while b"\r\n\r\n" not in head:
        piece = w.view(taken, STEP)
        if inflate.eof or not piece or head[: len(VERSION)] != VERSION[: len(head)]:
            return False
        try:
            head += inflate.decompress(piece)
        except zlib.error:
            return False
        taken += len(piece)
    return head_of(head) is not None


def members(source: pa.NativeFile, size: int, start: int, end: int, strict: bool = False) -> Iterator[tuple[int, bytes]]:
    """Offset and inflated bytes of the members that start in [start, end)."""
    w = _Window(source, start, size)
    here = start == 0  # a member has to start at this place
    while w.at < min(end, size) or (here and w.at < size):
        known = here and strict
        if known and not (w.view(0, len(MAGIC)) == MAGIC and _is_member(w)):
            raise ValueError(f"no record starts at byte {w.at}, where one has to")
        if w.at >= end:
            return
        here = False
        there, hit = w.fill(len(MAGIC)), w.find(MAGIC)
        if hit < 0:
            if w.at + there >= size:
                return
            w.skip(max(1, there - len(MAGIC) + 1))
            continue
        w.skip(hit)
        if w.at >= end:
            return
        if not known and not _is_member(w):
            w.skip(1)
            continue
        at, inflate, parts = w.at, zlib.decompressobj(31), []
        while not inflate.eof:
            piece = w.view(0, STEP)
            if not piece:
                if strict:
                    raise ValueError(f"the record at byte {at} is cut off")
                return
            parts.append(inflate.decompress(piece))
            w.skip(len(piece) - len(inflate.unused_data))
        yield at, b"".join(parts)
        here = True


def parsed(raw: bytes) -> dict:
    """Header fields of a record in lower case, and its payload."""
    fields = head_of(raw)
    if fields is None:
        raise ValueError("not a record")
    block = raw.partition(b"\r\n\r\n")[2][: int(fields["content-length"])]
    if len(block) < int(fields["content-length"]):
        raise ValueError(f"the record {fields['warc-record-id']} is shorter than its head says")
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def _page(name: str | None) -> int | None:
    return int(name[10:-1]) if name and name.startswith("<urn:page:") else None


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool, strict: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary()][: 10 + with_payload]
    names = [*(x.split()[0] for x in RECORD.split(", ")), "payload"][: 10 + with_payload]
    for batch in batches:
        for r in batch.to_pylist():
            rows, held, files = [], 0, fs.FileSystem.from_uri(r["path"])
            with files[0].open_input_file(files[1]) as source:
                if strict and source.size() != r["bytes"]:
                    raise ValueError(f"{r['path']} has {source.size()} bytes, not {r['bytes']}")
                for at, raw in members(source, r["bytes"], r["start"], r["start"] + r["span"], strict):
                    f = parsed(raw)
                    kind, payload, told = f["warc-type"], f["payload"], f.get("warc-payload-digest", "").removeprefix("sha1:")
                    digest, length = (hashlib.sha1(payload).hexdigest(), len(payload)) if kind == "response" else (told, int(f["x-payload-length"]))
                    verified = digest == told and length == int(f.get("x-payload-length", length))
                    row = (_page(f["warc-record-id"]), f.get("warc-target-uri"), kind, _page(f.get("warc-refers-to")), digest, length, len(payload), verified, r["path"], at, payload)
                    rows.append(row[: len(names)])
                    held += len(payload) if with_payload else 100
                    if held > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_archives(manifest: DataFrame, span: int = RANGE, with_payload: bool = False, strict: bool = True) -> DataFrame:
    """One row for each record of the archives named in the manifest (path, bytes), if asked for with the stored payload."""
    spark: SparkSession = manifest.sparkSession
    ranges = manifest.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(span).cast("long"))).alias("start"), F.lit(span).cast("long").alias("span"))
    dealt = ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path", "start")
    return dealt.mapInArrow(lambda b: _read(b, with_payload, strict), RECORD + (", payload binary" if with_payload else ""))
