"""Archives: round trip, frames, index, revisits."""

from __future__ import annotations

import hashlib

import zstandard
from pyspark.sql import functions as F

from shelfmetrics.llm import warc

SMALL = warc.Layout(frame_bytes=3000, bundle_bytes=6000)


def pages(spark):
    big, other = "<p>é</p>" * 300, "y" * 999
    rows = [(k, f"http://h/{k}", big if k % 3 == 0 else f"page {k} " * (40 + k)) for k in range(30)]
    rows += [(100, "http://h/\r\nX: 1", other), (101, None, other), (102, "u", None), (103, "u", ""), (None, "n", big)]
    rows += [(27, "again", big), (27, "again", big)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")


def test_report(spark):
    rows, frame = pages(spark)
    found = warc.archive_report(frame, SMALL)
    assert found.columns == ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    largest = {}
    for page, _, html in rows:
        if page is not None:
            largest[html] = max(largest.get(html, page), page)
    wanted = []
    for page, _, html in rows:
        payload = (html or "").encode()
        refers = largest[html] if len(payload) >= 1000 and page != largest[html] else None
        kind = "response" if refers is None else "revisit"
        wanted.append((page, kind, len(payload), hashlib.sha1(payload).hexdigest(), refers))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


def test_bundles_are_seekable(spark):
    rows, frame = pages(spark)
    archive = warc.write_archive(frame, SMALL)
    bundles = {r.bundle: bytes(r.content) for r in archive.bundles.collect()}
    assert len(bundles) > 1
    seen = 0
    for row in archive.index.collect():
        data = warc.read_frame(bundles[row.bundle], row.frame)
        headers, payload, end = warc.parse_record(data, row.offset)
        assert end - row.offset == row.length
        assert headers["WARC-Record-ID"] == f"<urn:page:{'' if row.page_id is None else row.page_id}>"
        seen += 1
    assert seen == len(rows)
    for content in bundles.values():
        whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(content)
        frames = warc.seek_table(content)
        assert b"".join(warc.read_frame(content, k) for k in range(len(frames))) == whole
        assert all(n >= 1 for _, _, n in frames)


def test_fetch_and_payloads(spark):
    rows, frame = pages(spark)
    archive = warc.write_archive(frame, SMALL)
    wanted = spark.createDataFrame([(1,), (103,), (1,), (999,)], "page_id bigint")
    found = {r.page_id: bytes(r.payload).decode() for r in warc.fetch(archive, wanted).collect()}
    assert found == {1: rows[1][2], 103: ""}
    texts = warc.read_archive(archive.bundles).where(F.col("record_type") == "response").collect()
    stored = {(r.page_id, bytes(r.payload).decode()) for r in texts}
    assert (29, rows[29][2]) in stored and (100, "y" * 999) in stored


def test_empty_table(spark):
    _, frame = pages(spark)
    assert warc.archive_report(frame.limit(0)).count() == 0
