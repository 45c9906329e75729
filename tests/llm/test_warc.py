"""WARC bundles: exact round trips."""

import base64
import hashlib

from wavejobs.llm import warc

PAGES = "page_id long, url string, html string, sha string, value double"


def expected(rows):
    first = {}
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        if page is not None:
            first[data] = min(first.get(data, page), page)
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        least = first.get(data)
        revisit = least is not None and page != least
        yield page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", least if revisit else None


def rows_of():
    rows = [(i, f"http://h/{i}", f"<html>{i % 40} é {'x' * (i * 37 % 9000)}\r\n\r\n WARC/1.1</html>", "clash", 0.0) for i in range(600)]
    rows += [(600 + i, None, "<p>same</p>", None, None) for i in range(300)]
    rows += [(1000, "http://a b\r\nX: y", None, None, None), (1001, "u", "", None, None), (None, "u", "", None, None), (None, None, "only here", None, None), (1003, "u", "z" * 3_000_000, None, None), (0, "http://h/0", rows[0][2], "again", 0.0)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = rows_of()
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    got = [tuple(r) for r in warc.archive(pages, str(tmp_path / "w"), bundle_bytes=300_000).collect()]
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)
    whole = warc.read(spark, str(tmp_path / "w"), payloads=True).where("record_type = 'response'").collect()
    by = {r.page_id: bytes(r.payload) for r in whole}
    assert all(by[i] == (html or "").encode() for i, _, html, *_ in rows if i in by and i is not None)
    assert len({r.file for r in whole}) >= 5
    stored = warc.store_index(spark, str(tmp_path / "w"))
    assert stored.count() == len(rows) and warc.read(spark, str(tmp_path / "w")).count() == len(rows)  # the index is no bundle
    for page in (3, 599, 1003):
        found = warc.fetch(spark, str(tmp_path / "w"), page)
        assert len(found) == 1 and f"X-Page-ID: {page}\r\n".encode() in found[0] and next(warc.records(found[0]))[1] == len(found[0])
    index = stored.where("page_id IN (3, 1003)")
    found = {r.record_id: bytes(r.record) for r in warc.lookup(spark, str(tmp_path / "w"), index).collect()}
    assert len(found) == 2 and all(v.startswith(b"WARC/1.1\r\n") and k.encode() in v for k, v in found.items())


def test_least_size(spark, tmp_path):
    rows = [(1, "u", "ab", "", 0.0), (2, "u", "ab", "", 0.0), (3, "u", "abc", "", 0.0), (4, "u", "abc", "", 0.0)]
    got = {r.page_id: r.record_type for r in warc.archive(spark.createDataFrame(rows, PAGES), str(tmp_path / "w"), 3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], PAGES), str(tmp_path / "w")).collect() == []


def test_frames_are_independent(monkeypatch):
    import struct

    import zstandard

    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    bundle = warc.Bundle()
    for i in range(40):
        bundle.add(warc.record(i, "http://h", b"x" * i * 7, None, False))
    content = bundle.close() + struct.pack("<I", warc.SEEKABLE)
    frames = warc.seek_table(content)
    assert len(frames) > 5
    seen = []
    for at, packed, size in reversed(frames):
        data = zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=size)
        seen += [int(h["X-Page-ID"]) for _, _, h, _ in warc.records(data)]
    assert sorted(seen) == list(range(40))
    whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1") == 40  # plain decoders skip the seek table
