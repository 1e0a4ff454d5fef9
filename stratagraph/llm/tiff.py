"""Media columns: TIFF files in binary columns, read to one row per page.

The reader walks the chain of image directories of either byte order, with 32- or 64-bit offsets, decodes strips and tiles
that are stored plainly or by PackBits, LZW or deflate, undoes horizontal differencing and the
floating-point predictor (16 and 32 bits) and puts the samples of a page together, chunky or planar.
Samples have 1, 2, 4, 8, 16 or 32 bits; those of less than 8 come out as a byte each. The writer makes files of one
or more grey 8-bit pages; it exists to store payloads and for round trips.

Defined results: null gives no page; bytes that aren't a readable TIFF give one row with `error`,
a bad page or one of an unsupported kind gives its row with `error` and the walk goes on with the
next, a directory that can't be read or that comes again ends it; repeated rows
each give their pages; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.runtime import ship, tidy

#: Fixed values of the TIFF 6.0 format: tags, field sizes, compression numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Of files with 32-bit offsets and of those with 64-bit ones: number of entries, an entry, an offset, and the bytes of these.
CLASSIC, BIG = ("H", "HHI", "I", 2, 12, 4), ("Q", "HHQ", "Q", 8, 20, 8)
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}

#: Bytes that a page may decode to: the most that a binary value holds. A directory that claims more is an error, not an allocation.
MAX_PAGE_BYTES = (1 << 31) - 1


class TiffError(ValueError):
    """The bytes break the format, or use a part of it that isn't supported."""


def unpack_bits(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += 2 + n
        else:
            if n > 128:
                out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2 if n > 128 else 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            out += bytes((257 - (j - i), data[i]))
            i = j
            continue
        j = i
        while j < n and j - i < 128 and not data[j : j + 1] * 3 == data[j : j + 3]:
            j += 1
        out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends."""
    out: list[bytes] = []
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    width, before, have, bits = 9, b"", 0, 0
    for byte in data:
        bits = bits << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise TiffError("an LZW code beyond the table")
        out.append(entry)
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have)
            bits &= (1 << have) - 1

    table: dict[bytes, int] = {}
    width, size, run = 9, 258, b""
    put(256, 9)
    for k in range(len(data)):
        longer = run + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            run = longer
            continue
        put(table[run] if len(run) > 1 else run[0], width)
        table[longer] = size
        size += 1
        width = max(9, size.bit_length())
        if size == 4094:
            put(256, width)
            table, width, size = {}, 9, 258
        run = data[k : k + 1]
    if run:
        put(table[run] if len(run) > 1 else run[0], width)
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257, width)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def _expand(data: bytes, compression: int, limit: int) -> bytes:
    if compression == 1:
        return data
    if compression == 5:
        return lzw_decode(data)
    if compression in (8, 32946):
        try:
            return zlib.decompressobj().decompress(data, limit)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    if compression == 32773:
        return unpack_bits(data)
    raise TiffError(f"compression {compression} isn't supported")


def _turn_bits(data: bytes) -> bytes:
    return np.packbits(np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")).tobytes()


def _floats(raw: bytes, rows: int, w: int, chunky: int, size: int) -> np.ndarray:
    """Samples whose rows have all first (most significant) bytes, then all second ones, as differences of bytes."""
    sums = np.cumsum(np.frombuffer(raw, dtype=np.uint8).reshape(rows, w * size, chunky), axis=1, dtype=np.uint8)
    return np.ascontiguousarray(np.moveaxis(sums.reshape(rows, size, w * chunky), 1, 2)).view(f">u{size}").reshape(rows, w, chunky)


def _directory(data: bytes, at: int, order: str, form: tuple = CLASSIC) -> tuple[dict[int, tuple[int, ...]], int]:
    number, entry, offset, head, size_of_entry, inline = form
    try:
        (n,) = struct.unpack_from(f"{order}{number}", data, at)
        if at + head + size_of_entry * n + inline > len(data):
            raise TiffError("a directory beyond the end")
        fields: dict[int, tuple[int, ...]] = {}
        for k in range(n):
            place = at + head + size_of_entry * k
            tag, kind, count = struct.unpack_from(f"{order}{entry}", data, place)
            if kind not in FIELD:
                continue
            size = struct.calcsize(f"{order}{FIELD[kind]}") * count
            place += size_of_entry - inline
            if size > inline:
                (place,) = struct.unpack_from(f"{order}{offset}", data, place)
            if place + size > len(data):
                raise TiffError(f"tag {tag} lies beyond the end")
            fields[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, place)
        return fields, struct.unpack_from(f"{order}{offset}", data, at + head + size_of_entry * n)[0]
    except struct.error:
        raise TiffError("a directory beyond the end") from None


def _page(data: bytes, f: dict[int, tuple[int, ...]], order: str) -> dict:
    one = lambda tag, default=None: f[tag][0] if f.get(tag) else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor, planar = set(f.get(BITS, (1,))), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or len(bits) != 1 or (depth := bits.pop()) not in (1, 2, 4, 8, 16, 32):
        raise TiffError("no size, or samples that aren't all of 1, 2, 4, 8, 16 or 32 bits")
    if width * height * samples * max(depth, 8) // 8 > MAX_PAGE_BYTES:
        raise TiffError("too large a page")
    if predictor not in (1, 2, 3) or predictor == 3 and depth < 16:
        raise TiffError(f"predictor {predictor} isn't supported")
    kind = np.dtype(f"u{max(depth, 8) // 8}").newbyteorder(order)
    turned = depth < 8 and one(FILL_ORDER, 1) == 2
    chunky = samples if planar == 1 else 1
    planes = 1 if planar == 1 else samples
    tiled = TILE_WIDTH in f
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (f.get(TILE_OFFSETS, ()), f.get(TILE_COUNTS, ())) if tiled else (f.get(STRIP_OFFSETS, ()), f.get(STRIP_COUNTS, ()))
    if not w or not h:
        raise TiffError("strips or tiles of no size")
    across, down = math.ceil(width / w), math.ceil(height / h)
    if len(offsets) < across * down * planes or len(counts) < across * down * planes:
        raise TiffError("too few strips or tiles")
    page = np.zeros((planes, height, width, chunky), dtype=kind)
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        row, col = rest // across * h, rest % across * w
        rows = h if tiled else min(h, height - row)
        line = (w * chunky * depth + 7) // 8  # a row fills its last byte
        size = rows * line
        if offsets[k] + counts[k] > len(data):
            raise TiffError("a strip or tile beyond the end")
        raw = data[offsets[k] : offsets[k] + counts[k]]
        raw = _expand(_turn_bits(raw) if turned else raw, compression, size)
        if len(raw) < size:
            raise TiffError("a strip or tile that is too short")
        if depth < 8:
            bits_ = np.unpackbits(np.frombuffer(raw[:size], dtype=np.uint8).reshape(rows, line), axis=1)[:, : w * chunky * depth]
            block = np.packbits(bits_.reshape(rows, w, chunky, depth), axis=3)[..., 0] >> (8 - depth)
        elif predictor == 3:
            block = _floats(raw[:size], rows, w, chunky, depth // 8)
        else:
            block = np.frombuffer(raw[:size], dtype=kind).reshape(rows, w, chunky)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            if depth < 8:
                block &= (1 << depth) - 1
        part = block[: height - row, : width - col]
        page[plane, row : row + part.shape[0], col : col + part.shape[1]] = part
    out = page[0] if planar == 1 else np.moveaxis(page[..., 0], 0, -1)
    return {"width": width, "height": height, "samples": samples, "bits": depth, "compression": compression, "data": np.ascontiguousarray(out, dtype=kind.newbyteorder("<")).tobytes()}


def walk(data: bytes) -> Iterator[dict]:
    """A dict for each page, one at a time: page, width, height, samples, bits, compression, data (little-endian samples), error."""
    blank = dict.fromkeys(("width", "height", "samples", "bits", "compression", "data", "error"))
    n = 0
    try:
        order = {b"II": "<", b"MM": ">"}.get(data[:2])
        version = struct.unpack_from(f"{order}H", data, 2)[0] if order and len(data) >= 8 else None
        if version == 42:
            form, (at,) = CLASSIC, struct.unpack_from(f"{order}I", data, 4)
        elif version == 43 and len(data) >= 16 and struct.unpack_from(f"{order}HH", data, 4) == (8, 0):
            form, (at,) = BIG, struct.unpack_from(f"{order}Q", data, 8)
        else:
            raise TiffError("not a TIFF file")
        seen: set[int] = set()
        while at:
            if at in seen:
                raise TiffError("directories in a loop")
            seen.add(at)
            fields, at = _directory(data, at, order, form)
            try:
                page = _page(data, fields, order)
            except (TiffError, ValueError, MemoryError) as e:
                page = {"error": str(e) or type(e).__name__}
            yield blank | {"page": n} | page
            n += 1
    except TiffError as e:
        yield blank | {"page": n, "error": str(e)}


def decode(data: bytes) -> list[dict]:
    """All pages of walk()."""
    return list(walk(data))


def encode(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, rows_per_strip: int = 64, tile: int = 0, level: int = 1) -> bytes:
    """A file of grey 8-bit pages (height x width), in strips or in square tiles (`tile`, a multiple of 16)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            full = np.zeros((math.ceil(height / tile) * tile, math.ceil(width / tile) * tile), dtype=np.uint8)
            full[:height, :width] = page
            blocks = [full[r : r + tile, c : c + tile] for r in range(0, full.shape[0], tile) for c in range(0, full.shape[1], tile)]
        else:
            blocks = [page[r : r + rows_per_strip] for r in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for b in blocks:
            raw = (np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8)) if predictor == 2 else b).astype(np.uint8).tobytes()
            raw = {"none": lambda x: x, "lzw": lzw_encode, "packbits": pack_bits, "deflate": lambda x: zlib.compress(x, level)}[compression](raw)
            offsets.append(len(out))
            counts.append(len(raw))
            out += raw
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [CODES[compression]], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [rows_per_strip], STRIP_COUNTS: counts}
        entries = bytearray()
        for tag in sorted(fields):
            values = fields[tag]
            if len(values) > 1:
                place = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
            else:
                place = values[0]
            entries += struct.pack("<HHII", tag, 4, len(values), place)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, data binary, error string"


def read_pages(media: DataFrame, id_col: str, data: str = "media") -> DataFrame:
    """One row per page of the files in a binary column: id and PAGE_SCHEMA."""
    ship(media)
    slim = media.select(F.col(id_col), F.col(data).cast("binary").alias("__data"))
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    kinds = {"data": pa.binary(), "error": pa.string()}

    def run(batches):
        for batch in batches:
            for k, file in enumerate(batch.column(1)):
                if file.is_valid:  # a page at a time
                    for p in walk(file.as_py()):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([p[c]], kinds.get(c, pa.int32())) for c in names)], [id_col, *names])
            tidy()

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, {PAGE_SCHEMA}")


#: A payload is padded to whole rows of an image of this width, and pages have so many rows at most.
ROW, PAGE_ROWS, FILL = 576, 256, b"\xff"


def store(payload: bytes) -> bytes:
    """The payload as a TIFF file, padded to a positive multiple of ROW bytes."""
    padded = payload + FILL * (max(ROW, -(-len(payload) // ROW) * ROW) - len(payload))
    image = np.frombuffer(padded, dtype=np.uint8).reshape(-1, ROW)
    return encode([image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)])


def digest(media: bytes) -> dict:
    """What the pages of a stored payload hold, from its bytes alone."""
    pages = decode(media)
    if bad := [p["error"] for p in pages if p["error"]]:
        raise TiffError(bad[0])
    payload = b"".join(p["data"] for p in pages)
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / max(1, len(payload))
    feature = f"pages={len(pages)};size={pages[0]['width']}x{sum(p['height'] for p in pages)};values={len(share)};mean={np.dot(counts, np.arange(256)) / max(1, len(payload)):.6f};entropy={abs(np.sum(share * np.log2(share))):.6f}"
    return {
        "n_bytes": len(payload.rstrip(FILL)), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature,
    }


def store_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and media: each whole text, null as empty, stored as a TIFF file. UTF-8 has no byte 255, so the padding shows."""
    ship(docs)
    slim = docs.select(F.col(id_col), F.col(text).cast("string").cast("binary").alias("__t"))

    def run(batches):
        for batch in batches:
            step = max(1, min(len(batch), (4 << 20) * len(batch) // max(1, batch.nbytes)))
            for k in range(0, len(batch), step):
                b = batch.slice(k, step)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([store(t.as_py() or b"") for t in b.column(1)], pa.binary())], [id_col, "media"])
            tidy()

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, media binary")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id and what digest() finds in each file of the column media."""
    ship(media)
    cols = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    slim = media.select(id_col, "media")

    def run(batches):
        for batch in batches:
            found = [digest(m.as_py()) for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[c] for x in found], kind) for c, kind in cols.items())], [id_col, *cols])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} {'long' if k == pa.int64() else 'string'}" for c, k in cols.items()))
