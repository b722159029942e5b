"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of whole records, and at its end a seek table in a
skippable frame: the compressed and decompressed size of every frame. The index, a table, maps each record id to bundle,
frame, offset in the decompressed frame and length; so one record is read by its frame alone.

Of records with equal payloads the one with the largest key is a response, the others are revisits that refer to it: their
block holds the HTTP header, with the payload's length, and no payload.

Plan: names (digest, key, URL, how many rows are equal) are aggregated and told their winner without payloads and written; the
join on all three deals out the pages, so a payload with many copies is no hot key. Each task writes its own bundles below the shared folder and returns index rows, so
Spark's commit of the index decides which files count: a task that is run again writes other files.

Cases: null payload: empty. Equal payloads with equal keys: ordered by URL; of rows equal in all three one is the response, the
others revisit it. Rows with a key of their own are named by it, others by key, digest, URL and number, so that all names differ.
Null key: smallest.
Records are only held one frame at a time. Control characters of URLs are percent-encoded in the header.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscan.llm.common import table, text_bytes
from leakscan.session import materialise, work_path

#: Decompressed bytes from which on a frame is closed, and compressed bytes from which on a bundle is.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
#: Decompressed bytes that a task reads back.
READ_BYTES = 256 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
#: What ids of records begin with.
PAGE = "urn:x-page:"
#: Fixed values of the file formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class BundleWriter:
    """Writes bundles into a folder; ``add`` returns where the record will be, and the bundle stands once it is closed."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        import zstandard

        self._folder, self._frame_bytes, self._bundle_bytes = folder, frame_bytes, bundle_bytes
        self._compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self._file = None
        self._frame = bytearray()

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        if self._file is None:
            self.bundle = f"{self._folder}/{uuid.uuid4().hex}.warc.zst"
            system, path = _filesystem(self.bundle)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self._file, self._sizes, self._written = system.open_output_stream(path, compression=None), [], 0
        place = self.bundle, len(self._sizes), len(self._frame), len(record)
        self._frame += record
        if len(self._frame) >= self._frame_bytes:
            self._flush()
            if self._written >= self._bundle_bytes:
                self.close()
        return place

    def _flush(self) -> None:
        packed = self._compress(bytes(self._frame))
        self._file.write(packed)
        self._sizes.append((len(packed), len(self._frame)))
        self._written += len(packed)
        self._frame.clear()

    def close(self) -> None:
        if self._file is not None:
            if self._frame:
                self._flush()
            entries = b"".join(struct.pack("<II", *s) for s in self._sizes)
            footer = struct.pack("<IBI", len(self._sizes), 0, SEEKABLE)
            self._file.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
            self._file.close()
            self._file = None


class BundleReader:
    """Reads frames of one bundle through its seek table."""

    def __init__(self, bundle: str):
        import zstandard

        system, path = _filesystem(bundle)
        self._file, self._decompress = system.open_input_file(path), zstandard.ZstdDecompressor().decompress
        size = self._file.size()
        count, _, magic = struct.unpack("<IBI", self._file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {bundle}")
        entries = self._file.read_at(8 * count, size - 9 - 8 * count)
        self._starts, at = [], 0
        for packed, plain in struct.iter_unpack("<II", entries):
            self._starts.append((at, packed, plain))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, plain = self._starts[number]
        return self._decompress(self._file.read_at(packed, at), max_output_size=plain)

    def close(self) -> None:
        self._file.close()


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int


def record_bytes(record_id: str, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{x:02X}" for x in c.encode()) for c in url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        "",
        "",
    ]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
    if headers["WARC-Type"] == "revisit":
        return Record(headers, None, int(declared[b"Content-Length"]))
    if payload_digest(payload) != headers["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have its digest")
    return Record(headers, payload, len(payload))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark understands it, with its scheme, so that tasks do not take a path of a shared system for a local one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _names(rows: DataFrame) -> DataFrame:
    """digest, key, url, copies, record_id, refers_to (id of the winner, null for itself): one row for equal rows, without payloads."""
    equal = rows.groupBy("digest", "key", "url").agg(F.count(F.lit(1)).alias("copies"))
    alone = equal.groupBy("key").agg((F.sum("copies") == 1).alias("alone")).withColumnRenamed("key", "alone_key")
    own = F.concat(F.lit(PAGE), F.coalesce(F.col("key").cast("string"), F.lit("")))
    told = F.concat_ws("#", own, F.concat_ws("-", "digest", F.md5(F.col("url").cast("binary"))))
    named = equal.join(alone, F.col("key").eqNullSafe(F.col("alone_key"))).select(
        "digest", "key", "url", "copies", F.when(F.col("alone"), own).otherwise(told).alias("record_id")
    )
    winners = named.groupBy("digest").agg(F.max(F.struct("key", "url", "record_id")).alias("winner"))
    refers = F.when(F.col("record_id") != F.col("winner.record_id"), F.col("winner.record_id"))
    return named.join(winners, "digest").select("digest", "key", "url", "copies", "record_id", refers.alias("refers_to"))


def write_archive(pages: DataFrame, key: str, url: str, payload: str, folder: str) -> DataFrame:
    """Writes all rows as records and returns the index: record_id, bundle, frame, offset, length."""
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
        text_bytes(payload).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    names = materialise(_names(rows), "warc-names")

    def tag(few: DataFrame) -> DataFrame:
        few = few.withColumnsRenamed({"digest": "name_digest", "key": "name_key", "url": "name_url"})
        same = (F.col("digest") == F.col("name_digest")) & F.col("key").eqNullSafe(F.col("name_key")) & (F.col("url") == F.col("name_url"))
        return rows.join(few, same).select("record_id", "url", "payload", "refers_to", "copies")

    tagged = tag(names.filter("copies = 1")).drop("copies")
    repeated = names.filter("copies > 1")
    if not repeated.isEmpty():  # equal rows are taken once and numbered; a further reading that other tables do not need
        once = tag(repeated).dropDuplicates(["record_id"]).withColumn("number", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        first = F.col("number") == 0
        tagged = tagged.unionByName(
            once.select(
                F.when(first, F.col("record_id")).otherwise(F.concat_ws("-", "record_id", "number")).alias("record_id"),
                "url",
                "payload",
                F.when(first, F.col("refers_to")).otherwise(F.coalesce("refers_to", "record_id")).alias("refers_to"),
            )
        )
    folder = _qualified(pages.sparkSession, folder)

    def write(batches):
        writer = BundleWriter(folder)
        found = []
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("record_id", "url", "payload", "refers_to"))
            for own, u, body, refers in zip(*columns, strict=True):
                record = record_bytes(own, u, body, payload_digest(body), refers)
                found.append((own, *writer.add(record)))
        writer.close()  # before the index rows leave: an index row is never without its file
        for i in range(0, len(found), 10_000):
            part = list(zip(*found[i : i + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[0]), pa.array(part[1]), *(pa.array(c, pa.int64()) for c in part[2:])],
                names=["record_id", "bundle", "frame", "offset", "length"],
            )

    schema = "record_id string, bundle string, frame long, offset long, length long"
    return materialise(tagged.mapInArrow(write, schema), "warc-index")


def read_archive(index: DataFrame) -> DataFrame:
    """Reads the records of an index: record_id, record_type, url, payload_bytes, payload_digest, refers_to, payload."""
    schema = (
        "record_id string, record_type string, url string, payload_bytes long, payload_digest string, "
        "refers_to string, payload binary"
    )

    def read(batches):
        reader, at, frame = None, (None, None), b""
        names = schema.replace(" string", "").replace(" long", "").replace(" binary", "").split(", ")
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            out = []
            for bundle, number, offset, length in zip(
                *(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length")), strict=True
            ):
                if at[0] != bundle:
                    if reader:
                        reader.close()
                    reader = BundleReader(bundle)
                if at != (bundle, number):
                    at, frame = (bundle, number), reader.frame(number)
                r = parse_record(frame[offset : offset + length])
                h = r.headers
                refers = h.get("WARC-Refers-To")
                out.append(
                    (
                        h["WARC-Record-ID"][1:-1],
                        h["WARC-Type"],
                        h["WARC-Target-URI"],
                        r.payload_bytes,
                        h["WARC-Payload-Digest"].removeprefix("sha1:"),
                        refers and refers[1:-1],
                        r.payload,
                    )
                )
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        if reader:
            reader.close()

    size = index.agg(F.sum("length"), F.count_distinct("bundle")).first()
    cores = index.sparkSession.sparkContext.defaultParallelism
    # a number of our own: the rows of the index say nothing of the bytes behind them, by which AQE would merge partitions
    parts = max(-(-(size[0] or 0) // READ_BYTES), min(size[1], 2 * cores), 1)
    ordered = index.repartition(parts, "bundle").sortWithinPartitions("bundle", "frame", "offset")
    return ordered.mapInArrow(read, schema)


def page_key(column: str):
    """The page's key from a record id, null for none."""
    return F.expr(f"try_cast(nullif(substring_index(substring({column}, {len(PAGE) + 1}), '#', 1), '') as bigint)")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archive(table(spark, sf_dir, "pages"), "page_id", "url", "html", work_path(spark, "warc"))
    records = read_archive(index.select("record_id", "bundle", "frame", "offset", "length"))
    return records.select(
        page_key("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_key("refers_to").alias("refers_to"),
    )
