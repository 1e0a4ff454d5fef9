"""WARC archives: writing with deduplication and segments, reading with reassembly.

Archives are rows of a binary column: gzip members, one for each record. A response whose block is
longer than `segment_bytes` is written as a first segment and continuation records, which name it
by WARC-Segment-Origin-ID; the last one has the total length. Payloads are framed in chunks, as
servers send them. Of equal payloads of `min_bytes` or more, the one with the largest page id is
stored, and the others are revisit records that refer to it.

Reading walks the members, groups segments by their origin, orders them by number, checks that
none is missing and that the length is right, and undoes transfer codings (chunked, gzip, deflate).
Payload digests of any algorithm that the platform has are checked, in hexadecimal, base 32 or base 64;
others aren't. A broken record is a row with its error, and reading goes on at the next one: at the
next gzip member, or the next record head of an archive that isn't compressed. Whole records are read
without any shuffle.

Defined results: null or empty html is an empty payload; rows that repeat the largest id of equal
payloads are all stored; a null id never is the stored one if the group has another; a segment
that is missing or repeated, a block shorter or longer than stated, a bad frame, number or digest give `error` and no payload; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.runtime import cut, ship, small_side, tidy

MIN_BYTES, SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 1000, 64 << 10, 8 << 10, 4 << 20
_ID = "urn:x-page:"
_GZIP = b"\x1f\x8b"


class WarcError(ValueError):
    """A record breaks the format."""


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            raise WarcError("a bad chunk length")
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise WarcError("a chunk that doesn't end")
        out.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response, without transfer codings."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"HTTP/"):
        raise WarcError("no HTTP head")
    codings: list[str] = []
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"transfer-encoding":
            codings += [c.split(";")[0].strip().lower() for c in value.decode("latin-1").split(",")]
    for coding in reversed([c for c in codings if c not in ("", "identity")]):
        if coding == "chunked":
            body = dechunk(body)
        elif coding in ("gzip", "x-gzip", "deflate"):
            try:
                body = zlib.decompress(body, 47)  # either head
            except zlib.error as e:
                raise WarcError(f"{coding}: {e}") from None
        else:
            raise WarcError(f"transfer coding {coding} isn't supported")
    return body


def digest_of(stated: str) -> tuple[str, bytes | None]:
    """Algorithm and bytes of a stated digest; no bytes if the algorithm isn't known."""
    name, _, value = stated.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in hashlib.algorithms_available or not (size := hashlib.new(name).digest_size):
        return name, None
    for encoded, decode in ((2 * size, bytes.fromhex), (-(-size // 5) * 8, lambda v: base64.b32decode(v.upper())), (-(-size * 8 // 5), lambda v: base64.b32decode(v.upper() + "=" * (-len(v) % 8))), (-(-size // 3) * 4, lambda v: base64.b64decode(v, validate=True))):
        if len(value) == encoded:
            try:
                if len(found := decode(value)) == size:
                    return name, found
            except ValueError:
                continue
    raise WarcError("a digest that can't be read")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + c.flush()


def members(archive: bytes, step: int = 1 << 16) -> Iterator[bytes | WarcError]:
    """What each gzip member holds, or the error of a broken one, after which the next is looked for; an archive that isn't compressed is one."""
    if archive[:2] != _GZIP:
        if archive:
            yield archive
        return
    at, view = 0, memoryview(archive)
    while at < len(archive):
        begin, d, out = at, zlib.decompressobj(31), []
        try:
            while not d.eof and at < len(archive):
                out.append(d.decompress(view[at : at + step]))
                at = min(at + step, len(archive)) - len(d.unused_data)
            if not d.eof:
                raise zlib.error("a member that doesn't end")
            yield b"".join(out)
        except zlib.error as e:
            yield WarcError(f"gzip: {e}")
            at = _next_member(archive, begin + 2)


def _next_member(archive: bytes, at: int) -> int:
    """Where the next member that holds a record begins, or the end."""
    while (at := archive.find(_GZIP + b"\x08", at)) >= 0:
        try:
            if zlib.decompressobj(31).decompress(archive[at : at + 4096], 5) == b"WARC/":
                return at
        except zlib.error:
            pass
        at += 1
    return len(archive)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes] | WarcError]:
    """Header fields (names in lower case) and block of every record, or the error of a broken one."""
    for data in members(archive):
        if isinstance(data, WarcError):
            yield data
            continue
        at = 0
        while at < len(data):
            try:
                end = data.find(b"\r\n\r\n", at)
                if end < 0 or data[at : at + 5] != b"WARC/":
                    raise WarcError("no record head")
                fields = {}
                for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                    name, _, value = line.partition(":")
                    fields[name.strip().lower()] = value.strip()
                size = fields.get("content-length", "")
                if not size.isdecimal():
                    raise WarcError("no content length")
                block = data[end + 4 : end + 4 + int(size)]
                if len(block) < int(size):
                    raise WarcError("a block shorter than stated")
                if data[end + 4 + int(size) : end + 8 + int(size)] not in (b"\r\n\r\n", b""):
                    raise WarcError("a block longer than stated")
                yield fields, block
                at = end + 4 + int(size) + 4
            except WarcError as e:
                yield e
                at = data.find(b"\r\n\r\nWARC/", at + 1)
                at = len(data) if at < 0 else at + 4


def response_records(page_id: int | None, serial: str, uri: str, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int) -> list[bytes]:
    """The records of one page; a revisit keeps the head only, with the payload's length and digest."""
    own = f"<{_ID}{'' if page_id is None else page_id};{serial}>"
    sha = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    shared = [("WARC-Target-URI", uri), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", sha), ("WARC-Refers-To", f"<{_ID}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return [record(fields, head + b"Content-Length: %d\r\n\r\n" % len(payload))]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", own), *shared, ("WARC-Payload-Digest", sha)]
    if len(block) <= segment_bytes:
        return [record(fields, block)]
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    out = [record([*fields, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]};{n}>"), *shared[:2], ("WARC-Segment-Number", str(n)), ("WARC-Segment-Origin-ID", own), *last], part))
    return out


def write_archives(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = MIN_BYTES, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Rows of the column `archive`, each of about archive_bytes at most. Which payloads repeat is found from digests only."""
    ship(pages)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= min_bytes
    copied = rows.filter(long).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = small_side(cut(copied.select(F.col("digest").alias("__d"), "stored")))
    rows = rows.join(copied, long & (F.col("digest") == F.col("__d")), "left")
    refers: Column = F.when(F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def run(batches):
        task, n, size, out = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for page_id, uri, data, digest, refers_to in zip(*(batch.column(k) for k in range(5))):
                n += 1
                clean = " ".join((uri.as_py() or "").split())
                parts = response_records(page_id.as_py(), f"{task:x}.{n:x}", clean, data.as_py(), digest.as_py(), refers_to.as_py(), segment_bytes)
                for part in parts:  # segments may part, as they do when archives are cut by size
                    out.append(part)
                    size += len(part)
                    if size >= archive_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])
                        size, out = 0, []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

    return rows.mapInArrow(run, "archive binary")


_RAW = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("error", pa.string())])
_RAW_SQL = "record_id string, page_id long, uri string, record_type string, refers_to long, payload_digest string, payload_bytes long, segment long, total long, block binary, error string"


def _page_id(record_id: str | None) -> int | None:
    number = (record_id or "").strip("<>").removeprefix(_ID).split(";")[0]
    return int(number) if number.lstrip("-").isdigit() else None


def _row(fields: dict[str, str], block: bytes) -> dict:
    """A record's row; the block of a segment, or else the payload, is in `block`."""
    row = dict.fromkeys(_RAW.names)
    kind = fields.get("warc-type")
    row |= {"record_id": fields.get("warc-segment-origin-id") or fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "record_type": kind}
    row["page_id"] = _page_id(row["record_id"])
    row["payload_digest"] = fields.get("warc-payload-digest") or None
    if "warc-segment-number" in fields:
        number, total = fields["warc-segment-number"], fields.get("warc-segment-total-length")
        if not number.isdecimal() or not (total or "0").isdecimal() or row["record_id"] is None or kind == "continuation" and "warc-segment-origin-id" not in fields:
            return row | {"error": "a segment without number or origin"}
        return row | {"segment": int(number), "total": None if total is None else int(total), "block": block}
    if kind == "revisit":
        length = [x.partition(b":")[2].strip() for x in block.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        return row | {"refers_to": _page_id(fields.get("warc-refers-to")), "payload_bytes": int(length[0]) if length and length[0].isdigit() else None, **_stated(row["payload_digest"])}
    if kind == "continuation":
        return row | {"error": "a segment without number or origin"}
    return row | _payload(block, row["payload_digest"])


def _stated(digest: str | None) -> dict:
    """A revisit's digest: SHA-1 as hexadecimal, others as they are."""
    try:
        name, value = digest_of(digest or "")
    except WarcError as e:
        return {"error": str(e)}
    return {"payload_digest": value.hex() if name == "sha1" and value else digest}


def _payload(block: bytes, digest: str | None) -> dict:
    try:
        payload = http_payload(block)
        name, value = digest_of(digest or "")
        if value is not None and hashlib.new(name, payload).digest() != value:
            raise WarcError("the digest is another")
    except WarcError as e:
        return {"error": str(e), "payload_digest": None}
    return {"block": payload, "payload_digest": hashlib.sha1(payload).hexdigest(), "payload_bytes": len(payload)}


def _batches(rows: Iterator[dict], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row["block"] or b"") + 200
        if size >= limit:
            yield pa.RecordBatch.from_pylist(out, _RAW)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _RAW)


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """A row for each record: page_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload, error."""
    ship(archives)

    def scan(segments: bool):
        def run(batches):
            def rows():
                for batch in batches:
                    for archive in batch.column(0):
                        for found in records(archive.as_py() or b""):
                            if isinstance(found, WarcError):
                                if not segments:
                                    yield dict.fromkeys(_RAW.names) | {"error": str(found)}
                            elif found[0].get("warc-type") in ("response", "revisit", "continuation"):
                                row = _row(*found)
                                if (row["segment"] is not None) == segments:
                                    yield row
                    tidy()

            yield from _batches(rows())

        return archives.select(column).mapInArrow(run, _RAW_SQL)

    def join(batches):
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    parts = sorted(row.pop("parts"), key=lambda p: p["segment"])
                    block, total = b"".join(p["block"] for p in parts), [p["total"] for p in parts if p["total"] is not None]
                    row = dict.fromkeys(_RAW.names) | row | {"record_type": "response"}
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or total != [len(block)]:
                        yield row | {"error": "segments are missing or repeated"}
                    else:
                        yield row | _payload(block, row["payload_digest"])

        yield from _batches(rows())

    first = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = scan(True).groupBy("record_id").agg(F.max("page_id").alias("page_id"), first("uri"), first("payload_digest"), F.collect_list(F.struct("segment", "total", "block")).alias("parts"))
    both = scan(False).unionByName(grouped.mapInArrow(join, _RAW_SQL))
    return both.select("page_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", F.col("block").alias("payload"), "error")


def stored_archives(pages: DataFrame, **options) -> DataFrame:
    """The archives of write_archives() as they lie in the shared folder."""
    return cut(write_archives(pages, **options))
