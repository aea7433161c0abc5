"""WARC records in seekable Zstandard bundles, written and read back by Spark.

A bundle holds independent Zstandard frames of some records each, then a footer: a seek table in a
skippable frame (the public "seekable format"), so any reader finds a frame from the end of the
bundle. The index maps a record to its bundle, its frame and its place inside the
decompressed frame; one record costs one frame to read.

Bundles are rows (``bundle``, ``content``) of a Parquet table in the shared folder: Spark's
writer commits them once each, also when a task is run again. Each ``content`` is a
complete file; ``bundle`` is a suitable name.

Deduplication: of records with equal payloads of at least ``revisit_bytes`` the one with the
largest ``page_id`` is a response and the others are revisits without a payload. Smaller ones
are all responses.

Defined cases: missing html is an empty payload; a missing ``page_id`` sorts below all others and
is written as an empty record id; rows that share both the largest id and the payload are all
responses; an empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmetrics.llm.shipping import ship
from shelfmetrics.llm.stages import Stages

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")  # number of frames, descriptor, magic
ENTRY = struct.Struct("<II")  # compressed size, decompressed size

CRLF = b"\r\n"


@dataclass(frozen=True)
class Layout:
    revisit_bytes: int = 1000
    frame_bytes: int = 256 << 10
    bundle_bytes: int = 8 << 20
    level: int = 3


# --- records ------------------------------------------------------------------------------------


def _encode(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{name}: {value}".encode() for name, value in headers)]
    lines.append(b"Content-Length: %d" % len(payload))
    return CRLF.join(lines) + CRLF * 2 + payload + CRLF * 2


def _header_value(text: str) -> str:
    """A header stays on its line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", "<urn:page:%s>" % ("" if page_id is None else page_id)),
        ("WARC-Target-URI", _header_value(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if refers_to is not None:
        headers.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        payload = b""
    return _encode(headers, payload)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the place after the record."""
    end = data.index(CRLF * 2, at)
    version, *lines = data[at:end].split(CRLF)
    if version != b"WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.decode().split(": ", 1) for line in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, data[start:stop], stop + 4


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


# --- bundles ------------------------------------------------------------------------------------


class BundleWriter:
    """Collects records into frames and frames into one bundle."""

    def __init__(self, layout: Layout):
        self.layout = layout
        self.compressor = zstandard.ZstdCompressor(level=layout.level, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.held = bytearray()
        self.index: list[tuple[int | None, int, int, int]] = []
        self.written = 0

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.held and len(self.held) + len(data) > self.layout.frame_bytes:
            self._close_frame()
        self.index.append((page_id, len(self.frames), len(self.held), len(data)))
        self.held += data

    def full(self) -> bool:
        return self.written + len(self.held) >= self.layout.bundle_bytes

    def _close_frame(self) -> None:
        frame = self.compressor.compress(bytes(self.held))
        self.frames.append(frame)
        self.sizes.append(len(self.held))
        self.written += len(frame)
        self.held.clear()

    def finish(self) -> bytes:
        if self.held:
            self._close_frame()
        entries = b"".join(ENTRY.pack(len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        table = entries + FOOTER.pack(len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of every frame, read from the end of the bundle."""
    count, descriptor, magic = FOOTER.unpack_from(bundle, len(bundle) - FOOTER.size)
    if magic != SEEKABLE_MAGIC or descriptor & 0x80:
        raise ValueError("no seek table")
    at = len(bundle) - FOOTER.size - count * ENTRY.size
    start, frames = 0, []
    for k in range(count):
        packed, plain = ENTRY.unpack_from(bundle, at + k * ENTRY.size)
        frames.append((start, packed, plain))
        start += packed
    return frames


def read_frame(bundle: bytes, frame: int) -> bytes:
    start, packed, plain = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


# --- on Spark -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Archive:
    """``bundles``: bundle, content. ``index``: page_id, bundle, frame, offset, length."""

    bundles: DataFrame
    index: DataFrame


def _planned(pages: DataFrame, layout: Layout) -> DataFrame:
    """Pages with payload digest and, for a revisit, the response's id. Rows meet by digest without html.

    The html itself is shuffled by page, so a payload that a third of all pages share is
    spread evenly.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).alias("bytes"),
        payload.alias("payload"),
    )
    large = keyed.where(F.col("bytes") >= layout.revisit_bytes).select("page_id", "digest")
    groups = (
        large.groupBy("digest")
        .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") > 1)
        .select(F.col("digest").alias("g_digest"), "response")
    )
    revisits = (
        large.join(groups, F.col("digest") == F.col("g_digest"))
        .where(~F.col("page_id").eqNullSafe(F.col("response")))
        .groupBy("page_id", "digest")
        .agg(F.max("response").alias("refers_to"))
        .select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    )
    return keyed.join(
        revisits, F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left"
    ).select("page_id", "url", "payload", "digest", "refers_to")


def write_archive(pages: DataFrame, layout: Layout | None = None) -> Archive:
    """Write one record per page into bundles and the index beside them."""
    layout = layout or Layout()
    ship(pages.sparkSession)
    stages = Stages(pages.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(layout)
        for batch in batches:
            for row in batch.to_pylist():
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                writer.add(row["page_id"], data)
                if writer.full():
                    yield _bundle_row(writer)
                    writer = BundleWriter(layout)
        if writer.index:
            yield _bundle_row(writer)

    places = "array<struct<page_id:bigint,frame:int,offset:bigint,length:bigint>>"
    packed = _planned(pages, layout).mapInArrow(pack, f"bundle string, content binary, places {places}")
    bundles = stages.write(packed, "warc")
    index = bundles.select("bundle", F.inline("places")).select(
        "page_id", "bundle", "frame", "offset", "length"
    )
    return Archive(bundles.select("bundle", "content"), index)


def _bundle_row(writer: BundleWriter) -> pa.RecordBatch:
    content = writer.finish()
    places = [dict(zip(("page_id", "frame", "offset", "length"), entry, strict=True)) for entry in writer.index]
    kind = pa.list_(
        pa.struct(
            [("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]
        )
    )
    name = f"{hashlib.sha1(content).hexdigest()}.warc.zst"
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([content], pa.binary()), pa.array([places], kind)],
        ["bundle", "content", "places"],
    )


RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string,"
    " refers_to bigint, payload binary"
)


def _row(headers: dict[str, str], payload: bytes) -> dict:
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(headers["X-Payload-Length"])
    kind = headers["WARC-Type"]
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    refers = headers.get("WARC-Refers-To")
    return {
        "page_id": _page(headers["WARC-Record-ID"]),
        "url": headers["WARC-Target-URI"],
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _page(refers) if refers else None,
        "payload": payload if kind == "response" else None,
    }


def _record_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(
        rows,
        pa.schema(
            [
                ("page_id", pa.int64()),
                ("url", pa.string()),
                ("record_type", pa.string()),
                ("payload_bytes", pa.int64()),
                ("payload_digest", pa.string()),
                ("refers_to", pa.int64()),
                ("payload", pa.binary()),
            ]
        ),
    )


def read_archive(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of every bundle, frame by frame; the digest of each payload is checked."""
    ship(bundles.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column("content"):
                bundle = content.as_buffer().to_pybytes()
                for start, packed, plain in seek_table(bundle):
                    data = reader.decompress(bundle[start : start + packed], max_output_size=plain)
                    at, rows = 0, []
                    while at < len(data):
                        headers, payload, at = parse_record(data, at)
                        row = _row(headers, payload)
                        rows.append(row if payloads else row | {"payload": None})
                    yield _record_batch(rows)

    return bundles.select("content").mapInArrow(unpack, RECORD_SCHEMA)


def fetch(archive: Archive, wanted: DataFrame) -> DataFrame:
    """The records with the ids of ``wanted.page_id``: index, then only the frames they are in."""
    ship(wanted.sparkSession)
    ids = wanted.select(F.col("page_id").alias("w_id")).distinct()
    places = archive.index.join(ids, F.col("page_id") == F.col("w_id"))
    frames = places.groupBy("bundle", "frame").agg(F.collect_list(F.struct("offset", "length")).alias("spots"))
    needed = frames.select(F.col("bundle").alias("f_bundle"), "frame", "spots")
    found = archive.bundles.join(needed, F.col("bundle") == F.col("f_bundle"))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, spots = batch.column("content"), batch.column("spots").to_pylist()
            for k, frame in enumerate(batch.column("frame").to_pylist()):
                data = read_frame(contents[k].as_buffer().to_pybytes(), frame)
                yield _record_batch([_row(*parse_record(data, spot["offset"])[:2]) for spot in spots[k]])

    return found.select("content", "frame", "spots").mapInArrow(seek, RECORD_SCHEMA)


def archive_report(pages: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Write the archive, read it back, one line per record."""
    archive = write_archive(pages, layout)
    return read_archive(archive.bundles, payloads=False).drop("payload", "url")


def open_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The bundles of an archive that was written before."""
    return spark.read.parquet(folder).select("bundle", "content")
