"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent frames; a skippable frame with the seek table
ends the bundle. The index maps each record to its bundle, frame and place in the
frame, so one record is read by decompressing one frame. Bundles are written and read
through the file system that the folder's address names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import new_folder

# Fixed values of the formats.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES, LEVEL = 256 << 10, 3
FIXED_DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id bigint, record_id string, bundle string, frame bigint, place bigint, size bigint"
READ = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, payload binary")


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _text(value) -> str:
    """A header value on one line."""
    return re.sub(r"[\r\n]+", " ", value)


def warc_record(page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> tuple[str, bytes]:
    """One record: an HTTP response, or a revisit that keeps the HTTP header only."""
    rid = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {FIXED_DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_text(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"WARC-Refers-To-Page-ID: {refers_to}"]
    return rid, WARC_VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers by lower-case name, and the payload behind the HTTP header."""
    head, _, block = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != WARC_VERSION:
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.decode() for k, v in (x.split(b": ", 1) for x in lines)}
    block = block[:int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    headers["http-length"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": headers, "payload": payload}


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, plain) sizes, as the seekable format has it."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(read_at, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame, from the end of the bundle."""
    count, _, magic = struct.unpack("<IBI", read_at(size - 9, 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    table, out, at = read_at(size - 9 - 8 * count, 8 * count), [], 0
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def with_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``page_id, url, payload, size, digest, kind, refers_to``.

    Of equal payloads of ``least_bytes`` or more the one with the largest page_id is the
    response. Rows with that page_id too are responses; a group without any page_id has
    responses only. Only digests are grouped, with a map-side step.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"),
                        F.sha1(payload).alias("digest"))
    first = (rows.where(F.col("size") >= least_bytes).groupBy("digest")
             .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (rows.join(first, "digest", "left")
            .withColumn("kind", F.when(again, "revisit").otherwise("response"))
            .withColumn("refers_to", F.when(again, F.col("first"))).drop("first"))


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """Writes one bundle per task and returns the index of what was written.

    A bundle has a name of its own per attempt and only the index says which bundles
    count, so a task that is run again or twice leaves an unused file at worst.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        store, base = fs.FileSystem.from_uri(folder)
        name, out, frames, held, size, rows = f"{uuid.uuid4().hex}.warc.zst", None, [], [], 0, []
        pack = zstandard.ZstdCompressor(level=level)

        def close_frame():
            nonlocal held, size
            data = b"".join(held)
            packed = pack.compress(data)
            out.write(packed)
            frames.append((len(packed), len(data)))
            held, size = [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                rid, data = warc_record(row["page_id"], row["url"], row["payload"], row["size"], row["digest"],
                                        row["kind"], row["refers_to"])
                rows.append((row["page_id"], rid, name, len(frames), size, len(data)))
                held.append(data)
                size += len(data)
                if size >= frame_bytes:
                    close_frame()
        if out is not None:
            if held:
                close_frame()
            out.write(seek_table(frames))
            out.close()
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names)

    columns = ["page_id", "url", "payload", "size", "digest", "kind", "refers_to"]
    return records.select(columns).mapInArrow(write, INDEX)


def read_bundles(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The indexed records, each taken from its frame; frames are decompressed one at a time.

    Digest and length of a response are computed from the archived payload and must
    agree with its headers.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        store, base = fs.FileSystem.from_uri(folder)
        unpack = zstandard.ZstdDecompressor()
        bundle, source, table, at, frame = None, None, None, None, b""
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["bundle"] != bundle:
                    bundle, at = row["bundle"], None
                    source = store.open_input_file(f"{base}/{bundle}")
                    table = read_seek_table(lambda p, n: source.read_at(n, p), source.size())
                if row["frame"] != at:
                    at = row["frame"]
                    start, packed, plain = table[at]
                    frame = unpack.decompress(source.read_at(packed, start), max_output_size=plain)
                record = parse_record(frame[row["place"]:row["place"] + row["size"]])
                head, payload = record["headers"], record["payload"]
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-record-id"] != row["record_id"]:
                    raise ValueError(f"index and archive disagree about {row['record_id']}")
                if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != head["http-length"]):
                    raise ValueError(f"payload of {row['record_id']} is damaged")
                page, refers = head.get("warc-page-id"), head.get("warc-refers-to-page-id")
                rows.append((None if page is None else int(page), head.get("warc-target-uri"), head["http-length"], digest,
                             head["warc-type"], None if refers is None else int(refers),
                             payload if with_payload and head["warc-type"] == "response" else None))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)],
                                             [x.split()[0] for x in READ.split(", ")])

    tasks = max(1, index.select("bundle").distinct().count())
    ordered = index.repartition(tasks, "bundle").sortWithinPartitions("bundle", "frame", "place")
    return ordered.mapInArrow(read, READ)


def archive(pages: DataFrame, least_bytes: int = 1000, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes ``pages`` (``page_id, url, html``) as bundles; returns the stored index and the folder.

    A null html is an empty payload, null ids and addresses leave their header out,
    repeated rows are written again, other columns are ignored, an empty table gives an
    empty index. The index is written at once, so a bundle is written once per row.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    index = write_bundles(with_revisits(pages, least_bytes), f"{folder}/bundles")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index"), f"{folder}/bundles"
