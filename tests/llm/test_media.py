"""TIFF files and WARC archives."""

import base64
import gzip
import hashlib
import struct
import zlib

import numpy as np
import pytest

from stratagraph.llm import tiff, warc


@pytest.mark.parametrize("compression", list(tiff.CODES))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (5, 7), (40, 33), (90, 200)):
        pages = [rng.integers(0, 256, shape, dtype=np.uint8), np.full(shape, 7, np.uint8)]
        out = tiff.decode(tiff.encode(pages, compression, predictor, rows_per_strip=13, tile=tile))
        assert [o["data"] for o in out] == [p.tobytes() for p in pages] and all(o["error"] is None for o in out)


def test_known_streams():
    assert tiff.unpack_bits(bytes([254, 170, 2, 128, 0, 42, 253, 170, 3, 128, 0, 42, 34, 247, 170])) == bytes([170] * 3 + [128, 0, 42] + [170] * 4 + [128, 0, 42, 34] + [170] * 10)
    assert tiff.lzw_decode(bytes([128, 1, 224, 64, 128, 68, 8, 12, 6, 128, 128])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_big_endian_16_bit_planar():
    a, b = ((np.arange(6).reshape(2, 3) * k + j).astype(">u2") for k, j in ((1000, 0), (1, 7)))
    data = bytearray(b"MM\0*\0\0\0\0")
    offsets = [len(data), len(data) + 12]
    data += a.tobytes() + b.tobytes()
    at = len(data)
    pair = lambda x, y: struct.pack(">II", x, y)
    long_at = at + 2 + 12 * 9 + 4
    entries = [(256, 4, 1, 3), (257, 4, 1, 2), (258, 3, 2, 16 << 16 | 16), (259, 4, 1, 1), (273, 4, 2, long_at), (277, 4, 1, 2), (278, 4, 1, 2), (279, 4, 2, long_at + 8), (284, 4, 1, 2)]
    data += struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + b"\0\0\0\0" + pair(*offsets) + pair(12, 12)
    data[4:8] = struct.pack(">I", at)
    (page,) = tiff.decode(bytes(data))
    assert page["error"] is None and page["samples"] == 2 and page["data"] == np.stack([a, b], axis=-1).astype("<u2").tobytes()


def test_broken_files():
    good = tiff.encode([np.zeros((4, 4), np.uint8)])
    for bad in (b"", b"II", b"GIF89a..", good[:20], good[:-30], b"II*\0\xff\xff\xff\x7f"):
        assert tiff.decode(bad)[-1]["error"]
    loop = bytearray(good)
    at = struct.unpack_from("<I", loop, 4)[0]
    n = struct.unpack_from("<H", loop, at)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    assert [p["error"] for p in tiff.decode(bytes(loop))] == [None, "directories in a loop"]


def test_payloads(spark):
    rows = [(1, "héllo", "m"), (2, None, "m"), (3, "", "m"), (4, "x" * 400_000, "m"), (4, "x" * 400_000, "m"), (5, "a" * 576, "m"), (None, "z", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = {r.doc_id: r for r in tiff.digests(tiff.store_texts(df)).collect()}
    for r in tiff.store_texts(df).collect():
        assert hashlib.sha256(r.media).hexdigest() == got[r.doc_id].media_sha256 and len(r.media) == got[r.doc_id].media_bytes
    for i, t, _ in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[2].media_sha256 == got[3].media_sha256 and got[5].payload_bytes == 576
    pages = tiff.read_pages(tiff.store_texts(df), "doc_id").filter("doc_id = 4").collect()
    assert len(pages) == 6 and all(p.width == 576 for p in pages)
    assert tiff.digests(tiff.store_texts(df.limit(0))).count() == 0


def test_chunked_framing():
    for data in (b"", b"a", b"x" * 20_000, bytes(range(256)) * 40):
        assert warc.dechunk(warc.chunked(data)) == data
    for bad in (b"", b"zz\r\n", b"5\r\nabc", b"-1\r\n"):
        with pytest.raises(warc.WarcError):
            warc.dechunk(bad)


PAGES = "page_id long, url string, html string, payload string"


def pages(spark):
    big = "ä<p>" * 3000
    rows = [(1, "http://a", big, ""), (2, None, big, ""), (3, "http://c\r\nX: y", "small", ""), (4, "u", "small", ""), (5, "u", None, ""), (6, "u", "", ""), (7, "u", "other" * 500, ""), (None, "u", big, ""), (8, "u", "x" * 999, ""), (9, "u", "x" * 999, ""), (10, "u", "y" * 1000, ""), (11, "u", "y" * 1000, "")]
    return spark.createDataFrame(rows, PAGES), rows


@pytest.mark.parametrize("segment", [50, 4000, 1 << 20])
def test_archives(spark, segment):
    df, rows = pages(spark)
    back = warc.read_archives(warc.stored_archives(df, segment_bytes=segment, archive_bytes=3000)).collect()
    assert len(back) == len(rows) and all(r.error is None for r in back)
    by = {r.page_id: r for r in back}
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, None, 8, 9, 10, 11)] == [("revisit", 2), ("response", None), ("revisit", 2), ("response", None), ("response", None), ("revisit", 11), ("response", None)]
    for i, _, html, _ in rows:
        if by[i].record_type == "response":
            assert bytes(by[i].payload) == (html or "").encode()
        assert by[i].payload_bytes == len((html or "").encode())


def test_missing_and_repeated_segments(spark):
    df, _ = pages(spark)
    archives = [bytes(r.archive) for r in warc.write_archives(df.filter("page_id = 7").coalesce(1), segment_bytes=300, archive_bytes=1).collect()]
    read = lambda parts: warc.read_archives(spark.createDataFrame([(bytearray(p),) for p in parts], "archive binary")).collect()
    assert len(archives) > 3
    assert [bytes(r.payload) for r in read(archives[::-1])] == [b"other" * 500]
    for bad in (archives[:-1], archives[1:], [archives[0], *archives[2:]], [*archives, archives[1]]):
        (row,) = read(bad)
        assert row.error and row.payload is None
    assert read([b"\x1f\x8bjunk"])[0].error and read([b"not warc"])[0].error and read([]) == []


def test_no_pages(spark):
    assert warc.read_archives(warc.stored_archives(spark.createDataFrame([], PAGES))).count() == 0


def tiff_file(order, *pages):
    """A file of pages (fields, the only strip), the fields as (tag: 16-bit value)."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0)), 4
    for fields, strip in pages:
        at = len(out)
        out += strip
        struct.pack_into(f"{order}I", out, link, len(out))
        entries = sorted((fields | {tiff.STRIP_OFFSETS: at, tiff.STRIP_COUNTS: len(strip), tiff.PLANAR: 1}).items())
        out += struct.pack(f"{order}H", len(entries)) + b"".join(struct.pack(f"{order}HHIHH", tag, 3, 1, value, 0) for tag, value in entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def test_few_bits_and_pages_after_an_unsupported_one():
    size = lambda w, h, bits, **more: {tiff.WIDTH: w, tiff.HEIGHT: h, tiff.BITS: bits} | {getattr(tiff, k): v for k, v in more.items()}
    for order in "<>":
        got = tiff.decode(tiff_file(
            order,
            (size(10, 2, 1, COMPRESSION=32773), tiff.pack_bits(bytes([0b10110000, 0b01000000, 0b00000001, 0b10000000]))),
            (size(3, 2, 4), bytes([0x12, 0x30, 0xAB, 0xC0])),
            (size(5, 1, 2, FILL_ORDER=2), bytes([0b11100100, 0b00000001])),
            (size(4, 1, 8, COMPRESSION=7), b"abcd"),
            (size(2, 1, 8), b"xy"),
        ))
        assert [p["page"] for p in got] == [0, 1, 2, 3, 4] and [bool(p["error"]) for p in got] == [False, False, False, True, False]
        assert list(got[0]["data"]) == [1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0] and got[0]["bits"] == 1
        assert list(got[1]["data"]) == [1, 2, 3, 10, 11, 12] and got[4]["data"] == b"xy"
        turned = [int(f"{b:08b}"[::-1], 2) for b in (0b11100100, 0b00000001)]
        assert list(got[2]["data"]) == [turned[0] >> k & 3 for k in (6, 4, 2, 0)] + [turned[1] >> 6]


def test_floating_point_predictor():
    for order in "<>":
        for samples in (1, 3):
            x = np.random.default_rng(4).normal(size=(5, 7, samples)).astype("<f4")
            planes = np.moveaxis(x.astype(">f4").view(np.uint8).reshape(5, 7 * samples, 4), 2, 1).reshape(5, 28, samples)
            strip = np.diff(planes, axis=1, prepend=np.zeros((5, 1, samples), np.uint8)).astype(np.uint8).tobytes()
            (page,) = tiff.decode(tiff_file(order, ({tiff.WIDTH: 7, tiff.HEIGHT: 5, tiff.BITS: 32, tiff.SAMPLES: samples, tiff.PREDICTOR: 3, tiff.SAMPLE_FORMAT: 3}, strip)))
            assert page["error"] is None and page["data"] == x.tobytes()


def big_tiff(order, pages):
    """A file with 64-bit offsets of one-strip grey pages."""
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HHHQ", 43, 8, 0, 0)), 8
    for w, h, strip in pages:
        at = len(out)
        out += strip
        struct.pack_into(f"{order}Q", out, link, len(out))
        entries = [(tiff.WIDTH, 4, w), (tiff.HEIGHT, 4, h), (tiff.BITS, 4, 8), (tiff.STRIP_OFFSETS, 16, at), (tiff.STRIP_COUNTS, 16, len(strip))]
        out += struct.pack(f"{order}Q", len(entries))
        for tag, kind, value in entries:
            out += struct.pack(f"{order}HHQ", tag, kind, 1) + struct.pack(f"{order}Q" if kind == 16 else f"{order}I4x", value)
        link = len(out)
        out += bytes(8)
    return bytes(out)


def test_64_bit_offsets():
    for order in "<>":
        got = tiff.decode(big_tiff(order, [(3, 2, b"abcdef"), (2, 2, b"abc"), (1, 1, b"z")]))
        assert [(p["data"], bool(p["error"])) for p in got] == [(b"abcdef", False), (None, True), (b"z", False)]
    assert tiff.decode(big_tiff("<", [(1, 1, b"z")])[:12])[0]["error"]


def raw_record(block, **fields):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x-page:1>", "Content-Length": str(len(block))} | {k.replace("_", "-"): v for k, v in fields.items()}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def http(body, *lines):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *lines]) + b"\r\n\r\n" + body


def test_other_peoples_archives(spark):
    """Digests of any algorithm and spelling, headers as others write them, cut and broken records, and what follows these."""
    read = lambda *parts: warc.read_archives(spark.createDataFrame([(bytearray(p),) for p in parts], "archive binary")).collect()
    body = b"hello world"
    good = {
        "sha1:" + hashlib.sha1(body).hexdigest(): True, "SHA1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(): True, "sha256:" + hashlib.sha256(body).hexdigest().upper(): True, "md5:" + hashlib.md5(body).hexdigest(): True,
        "sha-256:" + base64.b64encode(hashlib.sha256(body).digest()).decode(): True, "sha256:" + base64.b32encode(hashlib.sha256(body).digest()).decode(): True, "xyzzy:abc": True, "sha1:!!!": False, "sha1:" + hashlib.sha1(b"x").hexdigest(): False, "": True,
    }
    for digest, fine in good.items():
        (row,) = read(raw_record(http(body), **{"WARC-Payload-Digest": digest}))
        assert (bytes(row.payload) == body and row.payload_digest == hashlib.sha1(body).hexdigest()) if fine else row.error and row.payload is None, digest
    framed = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    packed = gzip.compress(body)
    assert [bytes(r.payload) for r in read(raw_record(http(framed, b"Transfer-Encoding:chunked")), raw_record(http(framed, b"transfer-encoding :  CHUNKED ")), raw_record(http(warc.chunked(packed), b"Transfer-Encoding: gzip, chunked")), raw_record(http(body, b"X-Note: transfer-encoding: chunked")))] == [body] * 4
    cut = raw_record(http(body), **{"Content-Length": "4000"})
    odd = raw_record(http(body), **{"WARC-Segment-Number": "one"})
    lone = raw_record(b"part", **{"WARC-Type": "continuation", "WARC-Segment-Number": "2", "WARC-Record-ID": "<urn:x-page:7>"})
    rows = read(cut)
    assert len(rows) == 1 and "short" in rows[0].error
    # an uncompressed archive goes on at the next record, a compressed one at the next member
    for archive in (b"".join([raw_record(http(body)), b"junk in between\r\n\r\n", odd, raw_record(http(body)), lone]), b"".join([gzip.compress(raw_record(http(body))), b"\x1f\x8bbroken", gzip.compress(odd), gzip.compress(raw_record(http(body))), gzip.compress(lone)])):
        rows = read(archive)
        assert sorted(bytes(r.payload) for r in rows if r.error is None) == [body, body] and sum(r.error is not None for r in rows) == 3, [r.error for r in rows]
    whole = gzip.compress(raw_record(http(body)))
    assert [r.error is None for r in read(whole + whole[:-9])] == [True, False]
