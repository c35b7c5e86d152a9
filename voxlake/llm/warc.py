"""WARC archives in Zstandard: one frame per record, compressed with a dictionary from a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, make_dir, new_path, read_table, store

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives are closed at this many compressed bytes, so that a reader holds little more than one.
ARCHIVE_BYTES = 8 << 20
#: The dictionary is trained on at most so many payloads of at most so many bytes each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16 << 10, 64 << 10
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class WarcError(ValueError):
    """An archive that breaks the format."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary_frame(dictionary: bytes) -> bytes:
    """The skippable frame that leads an archive; the dictionary in it is itself compressed."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}".encode()]
    lines += [f"{k}: {v}".encode() for k, v in headers]
    lines += [b"Content-Length: %d" % len(block), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    return " ".join(value.split())


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One capture: a full HTTP response, or a revisit that holds its HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    urn = lambda i: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{i}')}>"
    headers = [
        ("WARC-Record-ID", urn(page_id)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if url:
        headers.append(("WARC-Target-URI", _clean(url)))
    if not revisit:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", urn(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    return record("revisit", headers, http)


def _split(block: bytes, what: str) -> tuple[bytes, dict[str, str], bytes]:
    """First line, headers by lower-case name, and what follows the empty line."""
    head, gap, rest = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError(f"{what}: no end of headers")
    first, *lines = head.split(b"\r\n")
    headers: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"{what}: bad header {line[:80]!r}")
        headers[name.decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return first, headers, rest


def _length(headers: dict[str, str], what: str) -> int:
    value = headers.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise WarcError(f"{what}: bad Content-Length {value!r}")
    return int(value)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the single record of a frame, after checks of version, headers, length and digest."""
    first, headers, rest = _split(data, "record")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"record: bad version {first[:40]!r}")
    for need in ("warc-type", "warc-record-id", "warc-date"):
        if need not in headers:
            raise WarcError(f"record: no {need}")
    n = _length(headers, "record")
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"record: Content-Length {n}, but {len(rest)} bytes follow the headers")
    block = rest[:n]
    if headers["warc-type"] in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        status, http, payload = _split(block, "HTTP")
        if not status.startswith(b"HTTP/"):
            raise WarcError(f"HTTP: bad status line {status[:40]!r}")
        size = _length(http, "HTTP") if "content-length" in http else len(payload)
        if "warc-truncated" not in headers and len(payload) != (size if headers["warc-type"] == "response" else 0):
            raise WarcError(f"HTTP: Content-Length {size}, but {len(payload)} bytes of payload")
        digest = headers.get("warc-payload-digest", "")
        if headers["warc-type"] == "response" and digest and digest != f"sha1:{base32_sha1(payload)}":
            raise WarcError("payload digest differs")
    return headers, block


def frames(data: bytes | memoryview) -> Iterator[bytes]:
    """Decoded frames of an archive; the dictionary comes from the leading skippable frame, if there is one."""
    view = memoryview(data)
    at, decoder = 0, zstandard.ZstdDecompressor()
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]  # a file cut off here is found out below
        raw = bytes(view[8 : 8 + size])
        if len(raw) != size:
            raise WarcError("the dictionary frame is cut off")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        at = 8 + size
    while at < len(view):
        if len(view) - at < 4:
            raise WarcError("trailing bytes")
        magic = struct.unpack_from("<I", view, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # other skippable frames
            if len(view) - at < 8:
                raise WarcError("a skippable frame is cut off")
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            if at > len(view):
                raise WarcError("a skippable frame is cut off")
            continue
        one = decoder.decompressobj()
        parts = []
        step = 1 << 16
        while not one.eof and at < len(view):
            piece = view[at : at + step]
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as error:
                raise WarcError(f"bad frame: {error}") from error
            at += len(piece) - len(one.unused_data)
            step = min(step * 4, 16 << 20)
        if not one.eof:
            raise WarcError("the last frame is cut off")
        yield b"".join(parts)


def train_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary from a bounded sample; raw content where the sample is too small to train on."""
    if sum(map(len, payloads)) >= 8 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, payloads, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(payloads)[-DICTIONARY_BYTES:] or VERSION


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_archives(records: DataFrame, path: str, dictionary: bytes) -> DataFrame:
    """Write records(page_id, url, payload, refers_to, revisit) as archives below path; one row per archive.

    An archive gets its final name by a rename when it is complete; names are unique to a task's attempt. Only the rows
    of attempts that Spark commits, written as a table, say which archives count: others may be left by lost executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, attempt = TaskContext.get(), uuid.uuid4().hex
        store, root = _store(path)
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        lead, number, done = dictionary_frame(dictionary), 0, []
        held: list[bytes] = []

        def close() -> None:
            nonlocal number
            name = f"{root}/part-{context.partitionId():06d}-{number:05d}-{attempt}.warc.zst"
            part = f"{root}/.{context.partitionId():06d}-{number:05d}-{attempt}.part"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(part) as out:
                out.write(lead)
                for frame in held:
                    out.write(frame)
            store.move(part, name)
            done.append((name.rsplit("/", 1)[1], len(held)))
            held.clear()
            number += 1

        size = 0
        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not held:
                    info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{context.partitionId()}-{number}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    held.append(coder.compress(info))
                held.append(coder.compress(page_record(page_id, url, payload, refers_to, revisit)))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    size = 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["archive", "records"])

    return records.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "archive string, records long")


#: Kinds of records that hold an HTTP message, when their content type says so.
HTTP_KINDS = ("response", "revisit", "request")
FIELDS = "archive string, position long, kind string, page_id long, url string, payload_bytes long, digest string, refers_to long, payload binary"


def _row(name: str, position: int, data: bytes) -> tuple | None:
    """A record's row; None for the archive's own description."""
    head, payload = parse_record(data)
    kind = head["warc-type"]
    if kind == "warcinfo":
        return None
    size = None
    if kind in HTTP_KINDS and head.get("content-type", "").startswith("application/http"):
        _, http, payload = _split(payload, "HTTP")
        size = _length(http, "HTTP") if "content-length" in http else None
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or (None if kind == "revisit" else base32_sha1(payload))
    number = lambda k: int(head[k]) if head.get(k, "").isascii() and head.get(k, "").isdigit() else None
    return name, position, kind, number("x-page-id"), head.get("warc-target-uri"), len(payload) if size is None else size, digest, number("x-refers-to-page-id"), payload


def _rows(archives: Iterator[tuple[str, bytes | memoryview]]) -> Iterator[pa.RecordBatch]:
    """Records of archives as batches of some megabytes."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    rows: list[tuple] = []
    size = 0

    def batch_of() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    for name, content in archives:
        for position, data in enumerate(frames(content)):
            if (row := _row(name, position, data)) is None:
                continue
            rows.append(row)
            size += len(row[-1])
            if len(rows) >= 1000 or size >= 8 << 20:
                yield batch_of()
                rows.clear()
                size = 0
    yield batch_of()


def read_archives(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records of all *.warc.zst below path, or of the archives that a manifest of `write_archives` names: archive,
    position, kind, page_id, url, payload_bytes, digest, refers_to, payload.

    Records of any kind are read; those without HTTP have their block as payload. A digest that a record leaves out is
    taken from its payload, but for revisits, whose payload lies elsewhere. Any breach of the format stops the read.
    """
    if manifest is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _rows((n.as_py(), c.as_buffer()) for b in batches for n, c in zip(b.column(0), b.column(1), strict=True))

        return files.mapInArrow(run, FIELDS)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)

        def archives() -> Iterator[tuple[str, bytes]]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                        yield f"{path}/{name}", file.read()

        yield from _rows(archives())

    parts = min(max(manifest.count(), 1), 1 << 16)
    return manifest.select("archive").repartition(parts, "archive").mapInArrow(named, FIELDS)


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) as records: of equal payloads of least_bytes or more, the smallest page_id is the
    response and the others revisit it.

    A null html is an empty payload. Rows that repeat the smallest page_id of a payload are all responses; a null
    page_id comes after all others, and payloads that only null ids hold are all responses. Equality is by SHA-1
    and length. The minimum per payload is combined before its shuffle; rows of the most frequent payloads meet it by a
    broadcast.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.struct(F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").alias("n")))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = store(first, "payloads")
    joined = hot_join(rows, first.select("key", "first"), "key", first, pages.count(), "left")
    revisit: Column = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull()
    joined = joined.withColumn("revisit", revisit).withColumnRenamed("first", "_first")
    return joined.select("page_id", "url", "payload", F.when(F.col("revisit"), F.col("_first")).alias("refers_to"), "revisit")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, written to archives in the shared folder and read back."""
    pages = read_table(spark, sf_dir, "pages")
    n = pages.count()
    # a hash picks some SAMPLE_ROWS rows in all, so what reaches the driver doesn't grow with the partitions
    picked = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 31)) < F.lit(min(1 << 31, int((1 << 31) * 1.5 * SAMPLE_ROWS / max(n, 1)) + 1))
    sample = pages.where(picked & F.octet_length("html").between(1, SAMPLE_BYTES)).select(F.col("html").cast("binary")).limit(SAMPLE_ROWS)
    dictionary = train_dictionary([bytes(r[0]) for r in sample.collect()])
    path = new_path(spark, "warc")
    make_dir(spark, path)
    manifest = store(write_archives(captures(pages), path, dictionary), "manifest")
    return read_archives(spark, path, manifest).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"
    )
