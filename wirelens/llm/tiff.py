"""TIFF images in binary columns: write, and read one row per page."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelens.llm.common import batches

#: Fixed values of the TIFF 6.0 format: field types' sizes, tags, compression schemes.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, SCHEME, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZE, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page", T.IntegerType()), T.StructField("n_pages", T.IntegerType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()),
        T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("compression", T.StringType()), T.StructField("predictor", T.IntegerType()),
        T.StructField("tiled", T.BooleanType()), T.StructField("pixels", T.BinaryType()), T.StructField("error", T.StringType()),
    ]
)


#: Bytes of samples that a page may have, and the most that one stored byte can stand for in any scheme; beyond either a header is false.
MOST_PIXELS, MOST_RATIO = 1 << 31, 4096


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (most is None or len(out) < most):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, start = bytearray(), 0, 0

    def literal(end: int) -> None:
        for a in range(start, end, 128):
            part = data[a : min(end, a + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    while i < len(data):
        j = i + 1
        while j < len(data) and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i >= 3:
            literal(i)
            out += bytes((257 - (j - i), data[i]))
            start = j
        i = j
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early."""
    size = 0
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, width, held, bits, last = [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        size += len(entry)
        if most is not None and size >= most:
            break
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def reset() -> None:
        nonlocal width
        put(256)
        table.clear()
        table.update({bytes((i,)): i for i in range(256)})
        width = 9

    reset()
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer] = len(table) + 2
        if len(table) + 2 >= 4094:
            reset()
        elif len(table) + 2 >= (1 << width) - 0:
            width += 1
        run = data[i : i + 1]
    if run:
        put(table[run])
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _decoded(data: bytes, scheme: int, most: int) -> bytes:
    """What a strip or tile stands for; decoding ends soon after ``most`` bytes."""
    if scheme == NONE:
        return data
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if scheme == PACKBITS:
        return unpack_bits(data, most)
    if scheme == LZW:
        return lzw_decode(data, most)
    raise ValueError(f"compression {scheme} is not supported")


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Walk the chain of image directories: byte order and fields of each. A chain that loops ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen, used = struct.unpack(f"{order}I", data[4:8])[0], set(), 0
    while at and at not in seen:
        seen.add(at)
        fields: dict[int, list[int]] = {}
        (n,) = struct.unpack_from(f"{order}H", data, at)
        used += 6 + 12 * n
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
            size = TYPE_SIZE.get(kind, 0) * count
            used += size if size > 4 else 0
            if used > len(data):  # directories and values don't share bytes, so an honest file has room for them
                raise ValueError("directories are larger than the file")
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{order}I", data, at + 10 + 12 * k)[0]
            if code := {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}.get(kind):
                fields[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
        yield order, fields
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


def page_pixels(data: bytes, order: str, f: dict[int, list[int]]) -> tuple[np.ndarray, dict]:
    """Samples of a page as (height, width, samples), with what the directory says of them."""
    width, height, samples = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, [1])[0]
    bits, scheme, predictor, planar = f.get(BITS, [1]), f.get(SCHEME, [1])[0], f.get(PREDICTOR, [1])[0], f.get(PLANAR, [1])[0]
    if len(set(bits)) > 1 or bits[0] not in (8, 16):
        raise ValueError(f"{bits} bits a sample are not supported")
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    if scheme not in NAMES:
        raise ValueError(f"compression {scheme} is not supported")
    tiled = TILE_AT in f
    bw, bh = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(height, f.get(STRIP_ROWS, [height])[0]) or 1)
    at, size = (f[TILE_AT], f[TILE_SIZE]) if tiled else (f[STRIP_AT], f[STRIP_SIZE])
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    kind = np.dtype(f"{order}u{bits[0] // 8}")
    if min(width, height, samples, bw, bh) < 1:
        raise ValueError("a size is not positive")
    across, down = -(-width // bw), -(-height // bh)
    if min(len(at), len(size)) < planes * across * down:
        raise ValueError("too few strips or tiles")
    # Before anything is allocated: what the header promises must be in the file, or come out of it.
    ratio = 1 if scheme == NONE else MOST_RATIO
    block = bw * (bh if tiled else min(bh, height)) * each * kind.itemsize
    if max(height * width * samples * kind.itemsize, block) > min(MOST_PIXELS, ratio * (sum(min(x, len(data)) for x in size) + 1)):
        raise ValueError("the page is larger than its data")
    image = np.zeros((height, width, samples), kind)
    for k in range(planes * across * down):
        plane, y, x = k // (across * down), k // across % down * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        wanted = rows * bw * each * kind.itemsize
        raw = _decoded(data[at[k] : at[k] + size[k]], scheme, wanted)
        if len(raw) < wanted:
            raise ValueError("a strip or tile is cut short")
        part = np.frombuffer(raw, kind, rows * bw * each).reshape(rows, bw, each)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        image[y : y + rows, x : x + bw, plane if planar == 2 else slice(None)] = part[: height - y, : width - x, 0 if planar == 2 else slice(None)]
    return image, {"width": width, "height": height, "samples": samples, "bits": bits[0], "compression": NAMES[scheme], "predictor": predictor, "tiled": tiled}


def read_pages(data: bytes | None) -> Iterator[tuple]:
    """Rows of ``PAGE_SCHEMA``; what can't be read gives a row with its error and no pixels, after the pages before it."""
    if data is None:
        return
    found, broken = [], None
    try:
        for x in directories(data):
            found.append(x)
    except (ValueError, OverflowError, struct.error) as e:
        broken = (None, len(found), None, None, None, None, None, None, None, None, str(e))
    for page, (order, fields) in enumerate(found):
        try:
            image, m = page_pixels(data, order, fields)
        except (ValueError, KeyError, IndexError, OverflowError, struct.error, zlib.error) as e:
            yield (page, len(found), None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")
            continue
        yield (page, len(found), m["width"], m["height"], m["samples"], m["bits"], m["compression"], m["predictor"], m["tiled"], image.tobytes(), None)
    if broken:
        yield broken


def _coded(part: np.ndarray, scheme: int, predictor: int) -> bytes:
    if predictor == 2:
        part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
    raw = part.tobytes()
    return raw if scheme == NONE else zlib.compress(raw, 1) if scheme in (DEFLATE, OLD_DEFLATE) else pack_bits(raw) if scheme == PACKBITS else lzw_encode(raw)


def write_tiff(images: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, strip_rows: int = 256, tile: int = 0) -> bytes:
    """A little-endian file of 8- or 16-bit images (height, width, samples), one page each, in strips or, with ``tile``, square tiles."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for image in images:
        height, width, samples = image.shape
        image = image.astype(image.dtype.newbyteorder("<"))
        if tile:
            padded = np.pad(image, ((0, -height % tile), (0, -width % tile), (0, 0)))
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, height, tile) for x in range(0, width, tile)]
        else:
            parts = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        at, size = [], []
        for part in parts:
            coded = _coded(part, scheme, predictor)
            at.append(len(out))
            size.append(len(coded))
            out += coded + b"\0" * (len(coded) % 2)
        fields = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8 * image.itemsize] * samples), SCHEME: (3, [scheme]), PHOTOMETRIC: (3, [2 if samples >= 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [tile]), TILE_HEIGHT: (4, [tile]), TILE_AT: (4, at), TILE_SIZE: (4, size)} if tile else {STRIP_AT: (4, at), STRIP_ROWS: (4, [strip_rows]), STRIP_SIZE: (4, size)}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                place = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(df: DataFrame, content: str) -> DataFrame:
    """One row per page of the TIFF file in the binary column ``content``, which is left out; other columns are repeated.

    ``pixels`` holds the samples row by row in the file's byte order. Null
    gives no row. A file or page that can't be read gives a row with
    ``error`` set. A file's pages are neighbours, in order. Page columns
    take the place of columns of the same name.
    """
    names = {f.name for f in PAGE_SCHEMA}
    rest = [c for c in df.columns if c != content and c not in names]
    schema = T.StructType([*df.select(*rest).schema.fields, *PAGE_SCHEMA.fields])
    own = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kept = part.drop_columns([content])
            arrow = pa.schema([*kept.schema, *(pa.field(f.name, t) for f, t in zip(PAGE_SCHEMA, own, strict=True))])
            pages = ((*row.values(), *page) for row, data in zip(kept.to_pylist(), part.column(content), strict=True) for page in read_pages(data.as_py()))
            yield from batches(pages, arrow, weight=len(rest) + 9)

    return df.select(*rest, content).mapInArrow(read, schema)


PAYLOAD_UNIT = 192
PAGE_ROWS = 512


def payload(text: str | None) -> bytes:
    """UTF-8 of a text, null as empty, with bytes 32 up to a positive multiple of 192."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // PAYLOAD_UNIT)) * PAYLOAD_UNIT, b" ")


def text_images(data: bytes) -> list[np.ndarray]:
    """A payload as 8-bit images of 64 pixels of three samples across."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, PAYLOAD_UNIT // 3, 3)
    return [rows[a : a + PAGE_ROWS] for a in range(0, len(rows), PAGE_ROWS)]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a TIFF file: id, n_bytes, tiff. Small texts take tiles, larger ones strips; all are deflated after the horizontal predictor."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("tiff", pa.binary())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                text = text.as_py()
                images = text_images(payload(text))
                tile = 16 if len(images[0]) <= 16 else 0
                yield i, len((text or "").encode("utf-8", "surrogatepass")), write_tiff(images, DEFLATE, 2, 128, tile)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lambda it: batches(rows(it), schema, weight=2), "doc_id long, n_bytes long, tiff binary")


def texts_read_back(docs: DataFrame) -> DataFrame:
    """The media digest of every row of ``docs``: its text stored as TIFF, decoded page by page, and measured.

    Null and empty texts are a payload of 192 spaces. Equal texts give equal
    values; repeated rows each give a row; an empty table gives an empty
    result; other columns are ignored. ``feature`` has the mean of each of the
    three samples and a histogram of all samples in eight equal bars.
    """
    stored = store_texts(docs).withColumns({"media_bytes": F.octet_length("tiff").cast("long"), "media_sha256": F.sha2("tiff", 256)})
    names = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())])

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        # A file's pages follow one another within a partition, so a running digest is enough.
        for part in parts:
            for r in part.to_pylist():
                if r["error"] is not None:
                    raise ValueError(f"document {r['doc_id']}: {r['error']}")
                if r["page"] == 0:
                    digest, size, sums, counts, tail = hashlib.sha256(), 0, np.zeros(3, np.int64), np.zeros(8, np.int64), b""
                pixels = r["pixels"]
                samples = np.frombuffer(pixels, np.uint8)
                digest.update(pixels)
                size, tail = size + len(pixels), pixels[-16:]
                sums += samples.reshape(-1, 3).sum(axis=0, dtype=np.int64)
                counts += np.bincount(samples >> 5, minlength=8)
                if r["page"] == r["n_pages"] - 1:
                    feature = "mean=" + ",".join(f"{x:.3f}" for x in sums * 3 / size) + ";hist=" + ",".join(map(str, counts.tolist()))
                    yield r["doc_id"], r["n_bytes"], size, digest.hexdigest(), zlib.crc32(tail), r["media_bytes"], r["media_sha256"], feature, r["n_pages"]

    return tiff_pages(stored, "tiff").mapInArrow(lambda it: batches(rows(it), schema), names)
