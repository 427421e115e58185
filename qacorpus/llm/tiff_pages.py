"""Media columns: TIFF pages from binary columns (operator 5)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, utf8

#: Tags, field types (code of struct and size) and compressions of the TIFF 6.0 format: fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257
#: No more bytes than this come out of one, by compression: of the formats' longest codes and runs.
MOST = {NONE: 1, PACKBITS: 64, DEFLATE: 1100, OLD_DEFLATE: 1100, LZW: 4096}


def packbits(rows: np.ndarray) -> bytes:
    """Each row by itself: runs of four or more as such, all else as literals."""
    n, width = rows.shape
    same = rows[:, 1:] == rows[:, :-1]
    plain = ~(same[:, :-2] & same[:, 1:-1] & same[:, 2:]).any(1) if width > 3 else np.ones(n, bool)
    heads = [(at, min(128, width - at)) for at in range(0, width, 128)]
    literal = np.concatenate([x for at, k in heads for x in (np.full((n, 1), k - 1, np.uint8), rows[:, at : at + k])], 1)
    if plain.all():
        return literal.tobytes()
    packed: dict[bytes, bytes] = {}  # rows of padding repeat
    out = []
    for i in range(n):
        if plain[i]:
            out.append(literal[i].tobytes())
        else:
            row = rows[i].tobytes()
            if row not in packed:
                packed[row] = _packed_row(rows[i])
            out.append(packed[row])
    return b"".join(out)


def _packed_row(row: np.ndarray) -> bytes:
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    sizes = np.diff(np.append(begins, len(row)))
    data, out, open_at = row.tobytes(), [], 0

    def literals(a, b):
        for at in range(a, b, 128):
            part = data[at : min(at + 128, b)]
            out.append(bytes([len(part) - 1]) + part)

    for k in np.flatnonzero(sizes >= 4).tolist():
        a, size = int(begins[k]), int(sizes[k])
        literals(open_at, a)
        open_at = a + size
        while size > 1:
            part = min(size, 128)
            out.append(bytes([257 - part, data[a]]))
            size -= part
        if size:
            open_at -= 1
    literals(open_at, len(data))
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, have = [], 0, 0
    while have < size and at < len(data):
        n = data[at]
        if n < 128:
            part = data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            part = data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            part = b""
            at += 1
        out.append(part)
        have += len(part)
    return b"".join(out)[:size]


def _widths(codes: int) -> np.ndarray:
    """Bits of the first codes after a clear code: one more as soon as the table lacks one entry of being full."""
    table = 257 + np.arange(codes)  # the last entry's number when code k is read; the first code adds none
    return 9 + (table >= 511) + (table >= 1023) + (table >= 2047)


_width_of = np.append(_widths(4094 - 257), 12)


def lzw(data: bytes) -> bytes:
    """Most significant bit first, the width raised one code early, a clear code in front and where the table is full."""
    codes, widths = [CLEAR], [9]
    known: dict[int, int] = {}
    prefix, fresh, since = -1, 258, 0
    segments = [0]
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        if key in known:
            prefix = known[key]
            continue
        codes.append(prefix)
        known[key] = fresh
        fresh += 1
        prefix = b
        if fresh == 4094:
            codes.append(CLEAR)
            segments.append(len(codes) - 1)
            known, fresh = {}, 258
    if prefix >= 0:
        codes.append(prefix)
    codes.append(END)
    ends = [*segments[1:], len(codes)]
    widths = np.concatenate([np.append(_width_of[(ends[k - 1] - segments[k - 1] - 1)] if k else 9, _width_of[: b - a - 1]) for k, (a, b) in enumerate(zip(segments, ends))])
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16)[None, :] >= 16 - widths[:, None]]).tobytes()


def unlzw(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.uint32)
    starts = np.append(0, np.cumsum(_width_of))
    out, have, bit, limit = [], 0, 0, 8 * len(data)
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    while have < size:
        at = bit + starts
        many = int(np.searchsorted(at[:-1] + _width_of, limit, side="right"))
        if not many:
            break
        at, width = at[:many], _width_of[:many]
        byte = at >> 3
        word = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = (word >> (24 - (at & 7) - width).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else many
        table, last = list(base), b""
        for code in codes[:n].tolist():
            entry = table[code] if code < len(table) else last + last[:1]
            if last:
                table.append(last + entry[:1])
            out.append(entry)
            have += len(entry)
            last = entry
        if not len(stop) or codes[n] == END:
            break
        bit = int(at[n] + width[n])
    return b"".join(out)[:size]


def write_tiff(payload: bytes, width: int, compression: int, predictor: int, tiled: bool, page_rows: int = 512, part: int = 64, tile_rows: int = 16) -> bytes:
    """A grey 8-bit TIFF of one or more pages whose pixels, row by row, are the payload.

    Strips have `part` rows, tiles `part` columns and `tile_rows` rows.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, directories = [b"II*\0", b""], []
    at = 8
    for first in range(0, len(rows), page_rows):
        page = rows[first : first + page_rows]
        offsets, counts = [], []
        high = tile_rows if tiled else part
        for top in range(0, len(page), high):
            band = page[top : top + high]
            if tiled:
                band = np.concatenate([band, np.zeros((high - len(band), width), np.uint8)])
            for cell in np.split(band, range(part, width, part), 1) if tiled else [band]:
                if predictor == 2:
                    cell = np.concatenate([cell[:, :1], np.diff(cell, axis=1)], 1)
                data = np.ascontiguousarray(cell).tobytes()
                data = zlib.compress(data, 6) if compression == DEFLATE else lzw(data) if compression == LZW else packbits(cell) if compression == PACKBITS else data
                offsets.append(at)
                counts.append(len(data))
                data += b"\0" * (len(data) % 2)
                out.append(data)
                at += len(data)
        place = {TILE_WIDTH: [part], TILE_LENGTH: [high], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tiled else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [high], STRIP_COUNTS: counts}
        tags = {WIDTH: [width], HEIGHT: [len(page)], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PLANAR: [1], PREDICTOR: [predictor]} | place
        extra = {}
        for tag, values in tags.items():
            if len(values) > 1:
                extra[tag] = at
                data = struct.pack(f"<{len(values)}I", *values)
                out.append(data)
                at += len(data)
        directories.append((len(out), at))
        out.append(b"".join([struct.pack("<H", len(tags)), *(struct.pack("<HHII", t, 4, len(v), extra.get(t, v[0])) for t, v in sorted(tags.items())), b"next"]))
        at += len(out[-1])
    out[1] = struct.pack("<I", directories[0][1])
    for (k, _), following in zip(directories, [*(x for _, x in directories[1:]), 0]):
        out[k] = out[k][:-4] + struct.pack("<I", following)
    return b"".join(out)


@dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: int = 0
    predictor: int = 1
    pixels: bytes | None = None
    error: str | None = None


def read_pages(data: bytes | None) -> list[Page]:
    """The pages of a TIFF file in the order of its directories.

    Pixels come row by row, samples together, in the file's byte order made little-endian. What can't be read gives a
    page with an error and no pixels; null or other data gives one such page.
    """
    order = {b"II*\0": "<", b"MM\0*": ">"}.get((data or b"")[:4])
    if order is None:
        return [Page(0, error="not a TIFF file")]
    pages: list[Page] = []
    seen: set[int] = set()
    try:
        (at,) = struct.unpack_from(order + "I", data, 4)
        while at and at not in seen:
            seen.add(at)
            (many,) = struct.unpack_from(order + "H", data, at)
            tags = {}
            for k in range(many):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if kind not in TYPES:
                    continue
                code, size = TYPES[kind]
                place = at + 10 + 12 * k
                if size * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
            page = Page(len(pages))
            pages.append(page)
            try:
                _fill(page, tags, data, order)
            except (ValueError, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError, zlib.error, struct.error) as e:
                page.pixels, page.error = None, f"{type(e).__name__}: {e}"[:200]
            (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * many)
    except struct.error as e:
        pages.append(Page(len(pages), error=f"broken directory: {e}"[:200]))
    return pages


def _fill(page: Page, tags: dict, data: bytes, order: str) -> None:
    one = lambda tag, default=None: tags[tag][0] if default is None else tags.get(tag, (default,))[0]
    page.width, page.height, page.samples, page.bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    page.compression, page.predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if page.bits not in (8, 16) or len(set(tags.get(BITS, (1,)))) > 1 or page.predictor not in (1, 2):
        raise ValueError(f"{page.bits} bits with predictor {page.predictor} aren't supported")
    kind = np.dtype("u1" if page.bits == 8 else order + "u2")
    planes, depth = (page.samples, 1) if one(PLANAR, 1) == 2 else (1, page.samples)
    tiled = TILE_OFFSETS in tags
    wide, high = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (page.width, min(one(ROWS_PER_STRIP, page.height), page.height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if min(page.width, page.height, page.samples, wide, high) < 1:
        raise ValueError("a size is 0")
    across, down = -(-page.width // wide), -(-page.height // high)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("strips or tiles are missing")
    most = sum(min(n, len(data)) for n in counts) * MOST.get(page.compression, 1)
    if (across * wide * down * high if tiled else page.width * page.height) * page.samples * kind.itemsize > most:
        raise ValueError("more pixels than the strips or tiles can hold")
    image = np.zeros((down * high, across * wide, page.samples), kind)
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        top, left = cell // across * high, cell % across * wide
        rows = high if tiled else min(high, page.height - top)
        size = rows * wide * depth * kind.itemsize
        raw = data[offsets[k] : offsets[k] + counts[k]]
        if page.compression in (DEFLATE, OLD_DEFLATE):
            raw = zlib.decompressobj().decompress(raw, size)
        elif page.compression == LZW:
            raw = unlzw(raw, size)
        elif page.compression == PACKBITS:
            raw = unpackbits(raw, size)
        elif page.compression != NONE:
            raise ValueError(f"compression {page.compression} isn't supported")
        if len(raw) < size:
            raise ValueError(f"{len(raw)} of {size} bytes in strip or tile {k}")
        part = np.frombuffer(raw[:size], kind).reshape(rows, wide, depth)
        if page.predictor == 2:
            part = np.cumsum(part, 1, dtype=kind.newbyteorder("="))
        image[top : top + rows, left : left + wide, plane if planes > 1 else slice(None)] = part[:, :, 0] if planes > 1 else part
    page.pixels = image[: page.height, : page.width].astype(kind.newbyteorder("<")).tobytes()


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """A row per page of each file in a binary column: the key and what read_pages() finds.

    A null or broken file gives a row with an error. The other columns of df aren't read; repeated rows give their
    pages each.
    """
    kind = df.schema[key].dataType.simpleString()

    def of(batches):
        for batch in slices(batches, rows=100, column="media"):
            found = [(i, p) for i, x in enumerate(batch.column("media").to_pylist()) for p in read_pages(x)]
            names = ["number", "width", "height", "samples", "bits", "compression", "predictor"]
            columns = [pa.array([getattr(p, n) for _, p in found], pa.int32()) for n in names]
            columns += [pa.array([p.pixels for _, p in found], pa.binary()), pa.array([p.error for _, p in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([i for i, _ in found], pa.int64())), *columns], names=[key, "page", *names[1:], "pixels", "error"])

    return df.selectExpr(f"`{key}` as key", f"`{media}` as media").mapInArrow(of, f"`{key}` {kind}, {PAGE}")


#: How payloads are stored: by the remainder of their crc32, so that all forms occur and equal texts share one.
FORMS = [(DEFLATE, 1, False), (DEFLATE, 2, False), (DEFLATE, 1, True), (DEFLATE, 2, True), (PACKBITS, 1, False), (PACKBITS, 1, True), (LZW, 1, True), (LZW, 2, False)]
ROW = 192


def payload_of(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // ROW)) * ROW - len(text))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the TIFF file that holds each text; null counts as empty.

    Repeated rows give a row each, an empty table gives none, and other columns of docs aren't read.
    """

    def of(batches):
        for batch in slices(batches, rows=500):
            texts = utf8(batch.column("text"))
            files = []
            for payload in map(payload_of, texts):
                compression, predictor, tiled = FORMS[zlib.crc32(payload) % len(FORMS)]
                files.append(write_tiff(payload, ROW, compression, predictor, tiled))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n_bytes long, media binary")


def feature_of(pages_read: list[Page]) -> str:
    """How many pages there are, the mean grey value and an 8 x 8 average hash of all their rows."""
    image = np.concatenate([np.frombuffer(p.pixels, np.uint8).reshape(p.height, p.width) for p in pages_read]).astype(np.int64)
    rows = np.linspace(0, len(image), 9).astype(int)
    sums = np.append(np.zeros((1, image.shape[1]), np.int64), np.cumsum(image, 0), 0)
    bands = np.stack([sums[max(b, a + 1)] - sums[a] for a, b in zip(np.minimum(rows[:-1], len(image) - 1), rows[1:])])
    high = np.maximum(rows[1:], np.minimum(rows[:-1], len(image) - 1) + 1) - np.minimum(rows[:-1], len(image) - 1)
    cells = bands.reshape(8, 8, -1).sum(2) / high[:, None]
    return f"{len(pages_read)}:{image.mean():.6f}:{np.packbits(cells > cells.mean()).tobytes().hex()}"


def stored_features(files: DataFrame) -> DataFrame:
    """Digests and a feature of each file of store_texts(), from the bytes that read_pages() gives back.

    Repeated rows give a row each, an empty table gives none. A null or broken file, or one with pages of other widths or
    samples than store_texts() writes, has nulls for what its payload would give; a null file has no digest either.
    """

    def of(batches):
        for batch in slices(batches, rows=500, column="media"):
            rows = []
            for media in batch.column("media").to_pylist():
                found = read_pages(media)
                stored_as = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
                if not found or any(p.error is not None or p.width != ROW or p.samples != 1 or p.bits != 8 for p in found):
                    rows.append((None, None, None, *stored_as, None))
                    continue
                payload = b"".join(p.pixels for p in found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *stored_as, feature_of(found)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return files.mapInArrow(of, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
