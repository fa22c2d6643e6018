"""Web archives: WARC 1.1 records, each compressed by itself with a Zstandard dictionary that leads its file.

A file begins with a skippable frame that holds the dictionary; then every record is one frame. The
dictionary is built from a bounded sample of the records of the file. Equal payloads are stored once: the
record with the smallest id is a response, the others are revisits that name it.

Files are written by the tasks to the shared folder through Arrow's file systems (local or mounted paths, S3,
GCS, HDFS), under a name of the attempt that is renamed when the file is whole, so a repeated task replaces
its file and a lost one leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgate.llm.common import scan
from veilgate.session import settle

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Size aimed at for a dictionary, bytes of records it is built from, and bytes taken of one record.
DICTIONARY_BYTES, SAMPLE_BYTES, RECORD_SAMPLE = 32 << 10, 1 << 20, 16 << 10
#: Bytes of records after which a file is closed and the next one begun.
FILE_BYTES = 16 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row}:{copy}')}>"


def _safe(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unsafe(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def write_record(
    page_id: int | None, url: str | None, html: str, row: str, copy: int, first_id: int | None, first_row: str | None, revisit: bool
) -> bytes:
    """One record: HTTP head and payload for a response, the HTTP head alone for a revisit."""
    payload = html.encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row, copy)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", _safe(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first_row, 0))]
        if first_id is not None:
            head.append(("X-Refers-To-Page-ID", str(first_id)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> dict:
    """Headers, HTTP head and payload of one record; a response's digest is checked."""
    if not record.startswith(b"WARC/1.1\r\n"):
        raise ValueError("not a WARC record")
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and payload_digest(payload) != digest:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not have its digest")

    def number(name: str) -> int | None:
        return int(headers[name]) if name in headers else None

    return {
        "page_id": number("X-Page-ID"),
        "url": _unsafe(headers["WARC-Target-URI"]) if "WARC-Target-URI" in headers else None,
        "payload_bytes": int(fields["Content-Length"]) if revisit else len(payload),
        "payload_digest": digest,
        "record_type": headers["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-ID"),
        "record_id": headers["WARC-Record-ID"],
        "payload": None if revisit else payload,
    }


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary from records spread evenly over the file; empty if there is too little to learn from."""
    step = max(1, len(records) * RECORD_SAMPLE // SAMPLE_BYTES)
    sample, size = [], 0
    for record in records[::step]:
        sample.append(record[:RECORD_SAMPLE])
        size += len(sample[-1])
        if size >= SAMPLE_BYTES:
            break
    if len(sample) < 8:
        return b""
    try:
        wanted = max(256, min(DICTIONARY_BYTES, size // 8))
        return zstandard.train_dictionary(wanted, sample, k=256, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_file(records: list[bytes]) -> bytes:
    """A whole archive file: the dictionary in a skippable frame, then one frame per record."""
    dictionary = build_dictionary(records)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)), dictionary]
    out += [compressor.compress(record) for record in records]
    return b"".join(out)


def unpack_file(data: bytes) -> Iterator[bytes]:
    """The records of an archive file, one at a time."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the file does not begin with a dictionary frame")
    known = zstandard.ZstdCompressionDict(bytes(data[8 : 8 + size])) if size else None
    reader = zstandard.ZstdDecompressor(dict_data=known)
    data, at = memoryview(data), 8 + size
    while at < len(data):
        one = reader.decompressobj()
        # a frame is read in steps, so the rest of the file is not copied for each record
        parts, step = [], 16 << 10
        while not one.eof:
            piece = data[at : at + step]
            if not piece:
                raise ValueError("the file ends within a record")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def mark_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0
) -> DataFrame:
    """(page_id, url, html, row, copy, first_id, first_row, revisit) per row; a null html is empty.

    ``row`` is a hash of id, url and payload, ``copy`` numbers rows that are equal in all three. Of rows with equal
    payloads of at least ``least_bytes`` the first by id (nulls last), url and copy is no revisit, all others name it.
    Payload groups are found on digests, counted per task before the shuffle; the payloads themselves move once, by
    row key, so a payload that a third of the rows share does not gather anywhere.
    """
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        html.alias("html"),
    )
    digest = F.sha1(F.col("html").cast("binary"))
    name = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), digest, F.coalesce("url", F.lit("")), F.isnull("url"))
    keyed = rows.withColumn("row", F.md5(name.cast("binary")))
    order = F.struct(F.isnull("page_id").alias("no_id"), "page_id", F.coalesce("url", F.lit("")).alias("u"), "row")
    known = settle(keyed.select("row", digest.alias("digest"), F.octet_length("html").alias("size"), order.alias("key")), "records")
    groups = known.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    groups = settle(groups.where("n > 1").selectExpr("digest", "first.page_id AS first_id", "first.row AS first_row"), "groups")
    members = settle(known.select("digest", "row").distinct().join(groups, "digest").drop("digest"), "members")
    copies = Window.partitionBy("row").orderBy(F.lit(1))
    return (
        keyed.join(members, "row", "left")
        .withColumn("copy", F.row_number().over(copies) - 1)
        .withColumn("revisit", F.expr("first_row IS NOT NULL AND (row <> first_row OR copy > 0)"))
    )


def write_archive(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Write one record per row to files below ``folder``; (file, records, bytes) of every file.

    The columns and the revisit rule are those of ``mark_revisits``. The returned table has been computed: the
    files are there. An empty table gives an empty folder.
    """
    marked = mark_revisits(pages, **columns).select("page_id", "url", "html", "row", "copy", "first_id", "first_row", "revisit")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        files = 0

        def save(records: list[bytes]) -> pa.RecordBatch:
            nonlocal files
            name, data = f"part-{part:06d}-{files:05d}.warc.zst", pack_file(records)
            files += 1
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/.{name}.{attempt}") as out:
                out.write(data)
            system.move(f"{base}/.{name}.{attempt}", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"file": [name], "records": [len(records)], "bytes": [len(data)]})

        waiting, size = [], 0
        for rows in batches:
            for row in rows.to_pylist():
                waiting.append(write_record(**row))
                size += len(waiting[-1])
                if size >= FILE_BYTES:
                    yield save(waiting)
                    waiting, size = [], 0
        if waiting:
            yield save(waiting)

    written = settle(scan(marked, each, "file string, records long, bytes long"), "archive-files")
    context = pages.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).mkdirs(path)
    return written


def read_archive(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of all files below ``folder``, with their payloads if asked (null for revisits).

    Every response is decompressed and its digest checked; a damaged record fails the read.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
    if payload:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(folder)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for content in rows.column(0):
                found = []
                for record in unpack_file(content.as_buffer()):
                    found.append(read_record(record))
                    if len(found) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)], names=names)
                        found = []
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)], names=names)

    return scan(files.select("content"), each, schema)
