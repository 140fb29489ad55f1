"""WARC in seekable Zstandard bundles.

Each task writes one bundle: WARC records grouped into independent Zstandard frames of about ``FRAME`` bytes,
then the seek table of the seekable format in a skippable frame. An index maps each record's id to its bundle,
frame, and offset and length within the decompressed frame, so one record costs one seek and one frame.

Of records with equal payloads of at least ``LEAST`` bytes that with the smallest page_id is a response and the
others are revisits that refer to it; that is decided by a map-side-combined aggregation over digests before
anything is written. A payload is one Arrow value, so it and its frame stay under two gigabytes, which the seek
table's 32-bit sizes hold. Bundles are named by partition and put in place by a rename, so a retried task rewrites
the same file.

Defined results: a null payload is empty; a null page_id never is what others refer to, and such a row is a
revisit if an equal payload has an id; rows with equal page_id and payload are alike; an empty table writes
nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xylem.llm.shared import Scratch, small_batches

#: Bytes of records in a frame (one longer record is a frame of its own), Zstandard level, least payload that is told once.
FRAME, LEVEL, LEAST = 256 << 10, 3, 100
#: Repeated payloads up to which their digests (32 bytes and an id each) are sent to all executors; keys of one digest beyond.
SENT, SALT = 200_000, 16
# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "bundle string, record string, frame int, at long, size long"


def record(page, url: str | None, payload: bytes, digest: str, refers, revisit: bool) -> bytes:
    """One WARC record."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    body = HTTP if revisit else HTTP + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, payload and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = stop + 4
    end = start + int(head["Content-Length"])
    body = data[start:end]
    return head, body[body.index(b"\r\n\r\n") + 4 :], end + 4


class Bundle:
    """Writes frames and, at the end, the seek table."""

    def __init__(self, out):
        self.out, self.press = out, zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.size, self.table = [], 0, []

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.held and self.size + len(data) > FRAME:
            self.flush()
        place = len(self.table), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.press.compress(b"".join(self.held))
            self.out.write(frame)
            self.table.append((len(frame), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries)) + entries)
        self.out.close()


class Reader:
    """Random access to a bundle's frames."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        file.seek(size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", file.read(8 * count)):
            self.frames.append((at, packed, plain))
            at += packed
        self.press = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return self.press.decompress(self.file.read(packed), max_output_size=plain)


def opened(place: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and the path in it; ``file:/x`` is how Hadoop writes ``file:///x``."""
    if place.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + place.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(place) if "://" in place else (pyarrow.fs.LocalFileSystem(), place)


def described(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses) of each row.

    Payloads stay where they are: what is shuffled is digests, combined before they move. Only if the payloads that
    occur more than once are more than ``SENT`` are the rows shuffled, and then those of one digest go to ``SALT`` keys.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    large = pages.select("page_id", html.alias("payload")).where(F.octet_length("payload") >= LEAST).select("page_id", F.unhex(F.sha2("payload", 256)).alias("d"))
    first = large.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).select("d", "first")
    first = scratch.keep(first, "first")
    rows = pages.select("page_id", "url", html.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("d", F.unhex("digest"))
    if first.count() <= SENT:
        joined = rows.join(F.broadcast(first), "d", "left")
    else:
        salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["d", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes the archive; the index of (bundle, record, frame, at, size)."""
    small_batches(pages.sparkSession, 200)

    def run(batches):
        files, root = opened(folder)
        files.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.zst"
        bundle = None
        draft = f"{root}/.{name}.{uuid.uuid4().hex}"
        for batch in batches:
            rows = []
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or Bundle(files.open_output_stream(draft))
                data = record(page, url, payload, digest, refers, refers is not None)
                rows.append((name, None if page is None else str(page), *bundle.add(data), len(data)))
            parts = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(parts, kinds, strict=True)], ["bundle", "record", "frame", "at", "size"])
        if bundle:
            bundle.close()
            files.move(draft, f"{root}/{name}")

    return scratch.keep(described(pages, scratch).mapInArrow(run, INDEX), "index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type and refers_to of every record, read through the index."""
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("at")).alias("places"))

    def run(batches):
        files, root = opened(folder)
        name = reader = None
        for batch in batches:
            for bundle, frame, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bundle != name:
                    name, reader = bundle, Reader(files.open_input_file(f"{root}/{bundle}"))
                data, rows = reader.frame(frame), []
                for at in places:
                    head, payload, _ = parsed(data, at)
                    revisit = head["WARC-Type"] == "revisit"
                    digest, number = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Record-ID"][10:-1]
                    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"])):
                        raise ValueError(f"record {number} of {bundle} is damaged")
                    refers = int(head["WARC-Refers-To"][10:-1]) if revisit else None
                    rows.append((None if number == "none" else int(number), None if revisit else payload, int(head["X-Payload-Length"]), digest, head["WARC-Type"], refers))
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    bundles = index.agg(F.countDistinct("bundle")).first()[0]  # a bundle is a task's worth of work, however small its index is
    spread = frames.repartition(max(1, bundles), "bundle").sortWithinPartitions("bundle", "frame")
    return spread.mapInArrow(run, "page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def lookup(index: DataFrame, folder: str, page_id: int) -> tuple[dict[str, str], bytes]:
    """One record by its id: one seek and one frame."""
    found = index.where(F.col("record") == str(page_id)).first()
    files, root = opened(folder)
    head, payload, _ = parsed(Reader(files.open_input_file(f"{root}/{found.bundle}")).frame(found.frame), found.at)
    return head, payload


def op8_warc(spark, sf_dir) -> DataFrame:
    scratch = Scratch(spark, "warc")
    folder = scratch.folder("archive")
    index = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, scratch)
    result = scratch.keep(read_bundles(index, folder).drop("payload"), "result")
    scratch.drop(but=[result])  # the archive too: the query returns what was read back
    return result


OP8_SQL = f"""
WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
firsts AS (SELECT digest, min(page_id) AS first FROM rows WHERE size >= {LEAST} GROUP BY digest)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, r.digest AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM rows r LEFT JOIN firsts f ON r.digest = f.digest
"""
