"""Web archives in zstandard frames: a writer, and a reader that validates what it reads.

An archive begins with a skippable frame that holds the dictionary; then every record is one frame of its own, compressed
with it. The reader loads the dictionary, decodes frame by frame, and checks the version line, the named headers, the
declared length against the block, the record's end and the payload digest.

Records of equal payload are written once as ``response``; the others are ``revisit`` records without a block that
refer to it. Executors write archives of a bounded size into the shared folder under names that depend on the partition
alone, by way of a temporary name, so a task that runs again replaces what it wrote.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docfields.llm.common import map_arrow, share, stored
from docfields.session import fresh_path

VERSION = "WARC/1.1"
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
# Payloads of at least so many bytes are told apart from their copies.
LEAST_PAYLOAD = 0
# An archive is closed once its frames have so many bytes.
ARCHIVE_BYTES = 16 << 20
# The dictionary: pages to learn from (expected number), characters of each, and its size.
DICTIONARY_PAGES = 400
DICTIONARY_CHARS = 8192
DICTIONARY_BYTES = 65_536
_CHUNK = 1 << 16
_FIELD_NAME = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
DATE = "2024-01-01T00:00:00Z"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes
    error: str | None


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1 digest, upper case."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves as raw content where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading frame of an archive; the dictionary in it is itself compressed."""
    content = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(content)) + content


def _one_line(value: object) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def record_bytes(headers: dict[str, object], block: bytes) -> bytes:
    lines = [VERSION, *[f"{name}: {_one_line(value)}" for name, value in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """Headers and block of a decoded record; what is wrong with it in ``error``."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        return Record({}, b"", "no version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not _FIELD_NAME.fullmatch(name):
            return Record(headers, b"", "malformed header")
        headers[name.lower()] = value.strip()
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if n not in headers]
    if missing:
        return Record(headers, b"", "missing " + ", ".join(missing))
    if not headers["content-length"].isdecimal():
        return Record(headers, b"", "bad length")
    length = int(headers["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        return Record(headers, block, "length differs")
    digest = headers.get("warc-payload-digest")
    if headers["warc-type"] == "response" and digest and digest.removeprefix("sha1:") != payload_digest(block):
        return Record(headers, block, "digest differs")
    return Record(headers, block, None)


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive, one after the other; an undecodable frame ends it with an error record."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        length = struct.unpack_from("<I", data, 4)[0]
        content = bytes(view[8 : 8 + length])
        if len(content) != length:
            yield Record({}, b"", "dictionary frame is cut off")
            return
        if content[:4] == ZSTD_MAGIC:
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary = zstandard.ZstdCompressionDict(content) if content else None
        at = 8 + length
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        frame = decoder.decompressobj()
        parts = []
        try:
            while not frame.eof and at < len(data):
                chunk = view[at : at + _CHUNK]
                parts.append(frame.decompress(chunk))
                at += len(chunk) - len(frame.unused_data)
        except zstandard.ZstdError as problem:
            yield Record({}, b"", f"bad frame: {problem}")
            return
        if not frame.eof:
            yield Record({}, b"", "frame is cut off")
            return
        yield parse_record(b"".join(parts))


def _file_system(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


class _Archives:
    """Writes numbered archives of one partition; a file appears under its name only when it is complete."""

    def __init__(self, folder: str, partition: int, attempt: int, dictionary: bytes) -> None:
        self.files, self.folder = _file_system(folder)
        self.partition, self.attempt, self.number = partition, attempt, 0
        # Above the compressed dictionary the reader has to see the very bytes that the compressor used.
        self.leading = dictionary_frame(dictionary) if dictionary else b""
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(dict_data=words) if words else zstandard.ZstdCompressor()
        self.frames: list[bytes] = []
        self.size = 0

    def add(self, record: bytes) -> None:
        self.frames.append(self.compressor.compress(record))
        self.size += len(self.frames[-1])
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if not self.frames:
            return
        name = f"{self.folder}/part-{self.partition:06d}-{self.number:06d}.warc.zst"
        with self.files.open_output_stream(f"{name}.attempt-{self.attempt}") as out:
            out.write(self.leading)
            for frame in self.frames:
                out.write(frame)
        self.files.move(f"{name}.attempt-{self.attempt}", name)
        self.frames, self.size, self.number = [], 0, self.number + 1


def _headers(page_id: object, url: str | None, kind: str, refers_to: object, digest: str, length: int) -> dict[str, object]:
    headers: dict[str, object] = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = url
    if kind == "revisit":
        headers["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    return headers | {"WARC-Payload-Digest": f"sha1:{digest}", "Payload-Length": length, "Content-Type": "text/html; charset=utf-8"}


def with_types(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """page_id, url, html and refers_to: the smallest id with the same payload, null for that page itself.

    Payload digests are combined on the map side to one row each; only payloads that occur more than once are joined back.
    """
    keyed = pages.select(
        "page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumn("payload", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    shared = stored(
        keyed.filter(F.octet_length("html") >= least_payload)
        .groupBy(F.col("payload").alias("shared_payload")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter(F.col("copies") > 1).drop("copies"),
        "payloads",
    )
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return keyed.join(shared, F.col("payload") == F.col("shared_payload"), "left").select(
        "page_id", "url", "html", refers_to.alias("refers_to")
    )


def learned_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from about ``DICTIONARY_PAGES`` pages, chosen by their ids, so that few rows come from each task.

    Empty if there are no pages with an id and a content.
    """
    fraction = min(1.0, DICTIONARY_PAGES / max(1, pages.count()))
    chosen = pages.filter(F.col("page_id").isNotNull() & (share(F.col("page_id"), "archive") < fraction))
    rows = chosen.select("page_id", F.substring(F.coalesce(F.col("html"), F.lit("")), 1, DICTIONARY_CHARS).alias("html")).collect()
    samples = [r["html"].encode("utf-8", "surrogatepass") for r in sorted(rows) if r["html"]]
    return make_dictionary(samples) if samples else b""


def write_archives(pages: DataFrame, folder: str, least_payload: int = LEAST_PAYLOAD) -> int:
    """Writes one record per row of ``pages`` (page_id, url, html; other columns are not read); returns their number.

    A null html is an empty payload. Of rows with equal payloads the smallest page_id is the response; rows that repeat
    that id are responses as well. Without rows no archive is written.
    """
    shared = pages.sparkSession.sparkContext.broadcast(learned_dictionary(pages))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        archives = _Archives(folder, context.partitionId(), context.taskAttemptId(), shared.value)
        written = 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(i) for i in range(4)], strict=True):
                payload = html.as_py().encode("utf-8", "surrogatepass")
                first = refers_to.as_py()
                kind = "response" if first is None else "revisit"
                headers = _headers(page_id.as_py(), url.as_py(), kind, first, payload_digest(payload), len(payload))
                archives.add(record_bytes(headers, payload if first is None else b""))
                written += 1
        archives.close()
        yield pa.RecordBatch.from_pydict({"records": [written]})

    files, path = _file_system(folder)
    files.create_dir(path, recursive=True)
    typed = with_types(pages, least_payload)
    ordered = typed.sortWithinPartitions("page_id", "url", "html")
    return map_arrow(ordered, run, "records long").agg(F.sum("records")).first()[0] or 0


def read_archives(spark, folder: str) -> DataFrame:
    """One row per record of all archives in a folder: record_id, record_type, target_uri, payload_digest, payload_bytes,
    refers_to, block (bytes), error (null for a valid record). Archives are of bounded size and read one at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "payload-length", "warc-refers-to")
        schema = pa.schema([*[(n, pa.string()) for n in names], ("block", pa.binary()), ("error", pa.string())])

        def out(group: list[Record]) -> pa.RecordBatch:
            columns = [[r.headers.get(n) for r in group] for n in names]
            return pa.RecordBatch.from_pydict(
                dict(zip(schema.names, [*columns, [r.block for r in group], [r.error for r in group]], strict=True)), schema=schema
            )

        for batch in batches:
            for content in batch.column(0):
                group: list[Record] = []
                size = 0
                for record in read_archive(content.as_py()):
                    group.append(record)
                    size += len(record.block)
                    if size > _CHUNK * 64 or len(group) >= 2000:
                        yield out(group)
                        group, size = [], 0
                yield out(group)

    kinds = "id string, kind string, uri string, digest string, length string, refers string, block binary, error string"
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")
    return map_arrow(archives, run, kinds).select(
        F.col("id").alias("record_id"), F.col("kind").alias("record_type"), F.col("uri").alias("target_uri"),
        F.regexp_replace("digest", "^sha1:", "").alias("payload_digest"),
        F.col("length").try_cast("long").alias("payload_bytes"), F.col("refers").alias("refers_to"), "block", "error",
    )


def page_of(urn: Column) -> Column:
    """The page id in a record's name, null without one."""
    return F.regexp_extract(urn, "^<urn:page:(.*)>$", 1).try_cast("long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` into archives below the shared folder and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, block_bytes, error, one row per row of ``pages``; none for an empty table.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, f"archives-{uuid.uuid4().hex[:8]}")
    if not write_archives(pages, folder):
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, block_bytes long, error string"
        )
    return read_archives(spark, folder).select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of(F.col("refers_to")).alias("refers_to"), F.octet_length("block").cast("long").alias("block_bytes"), "error",
    )
