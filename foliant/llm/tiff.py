"""TIFF media columns: a binary column of TIFF files becomes one row per page.

Reading walks the chain of image directories (either byte order, classic and
64-bit offsets, a repeated directory ends the walk), decodes strips or tiles
stored plain, by PackBits, LZW or deflate, undoes the horizontal predictor for 8 to
64 bits and the floating-point one for 16 to 64 bits, and returns the samples row by
row in little-endian order, pixels interleaved; samples of 1, 2 and 4 bits take a
byte each.  Writing stores bytes as 8-bit grey pages for the same reader.

Defined results: a null or empty file has no page; a page that breaks
the format or is of another kind gives one row with ``error`` set and no samples, and
the walk goes on; where the next directory's place can't be read, such a row ends it; a page whose decoded samples
exceed ``most_page_bytes`` (64 MiB unless given) gives such a row too, before anything of it is decoded; repeated rows
read alike; whole files are read; only the media column is needed.

Memory: a worker holds the file, one page's samples at most twice, and a block of numbers for mean and
spread; rows leave in pieces of ``PIECE_BYTES`` of samples, or one page.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

#: Fixed values of the format: compression codes.
COMPRESSIONS = {1: "none", 5: "lzw", 8: "deflate", 32773: "packbits", 32946: "deflate"}
#: Fixed values of the format: bytes of each field type.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_LETTERS = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q"}
#: Fixed values of the format: tags read here.
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 266: "fill_order", 273: "strip_offsets", 277: "samples",
    278: "strip_rows", 279: "strip_sizes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_sizes", 339: "sample_format",
}

PAGE_FIELDS = "page int, width int, height int, samples_per_pixel int, bits int, compression string, predictor int, layout string, samples binary, mean double, spread double, error string"
_PAGE_TYPE = StructType([StructField(f.split()[0], {"int": IntegerType(), "double": DoubleType(), "string": StringType(), "binary": BinaryType()}[f.split()[1]]) for f in PAGE_FIELDS.split(", ")])
_PAGE = pa.struct([(f.split()[0], {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]]) for f in PAGE_FIELDS.split(", ")])
#: Decoded bytes of one page, unless given; samples that leave a worker at once; samples whose moments are summed at once.
MOST_PAGE_BYTES, PIECE_BYTES, BLOCK = 64 << 20, 16 << 20, 1 << 18

ROW = 64
PAGE_ROWS = 1024
CHUNK_ROWS = 64


def unpack_bits(data: bytes) -> bytes:
    """Undo PackBits."""
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += 2 + head
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of three or more, literals between them."""
    out, at = [], 0

    def literal(a: int, b: int) -> None:
        for i in range(a, b, 128):
            part = data[i : min(b, i + 128)]
            out.append(bytes((len(part) - 1,)) + part)

    for run in _RUN.finditer(data):
        literal(at, run.start())
        out.append(bytes((257 - (run.end() - run.start()), data[run.start()])))
        at = run.end()
    literal(at, len(data))
    return b"".join(out)


def lzw_decode(data: bytes) -> bytes:
    """Undo the format's LZW: codes of 9 to 12 bits from the high end, widened one code early."""
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out = list(singles), []
    acc = held = at = 0
    width, previous, n = 9, None, len(data)
    while True:
        while held < width:
            if at >= n:
                return b"".join(out)
            acc = (acc << 8) | data[at]
            at += 1
            held += 8
        held -= width
        code = acc >> held
        acc &= (1 << held) - 1
        if code == 256:
            table, width, previous = list(singles), 9, None
            continue
        if code == 257:
            return b"".join(out)
        if previous is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = previous + previous[:1]
            else:
                raise ValueError("LZW code beyond the table")
            table.append(previous + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        previous = entry


def lzw_encode(data: bytes) -> bytes:
    """The format's LZW; every chunk starts with a clear code."""
    out = bytearray()
    acc, held, width, size = 256, 9, 9, 258
    table: dict[int, int] = {}
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = (prefix << 8) | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        acc = (acc << width) | prefix
        held += width
        table[key] = size
        size += 1
        if size == 4095:
            acc = (acc << 12) | 256
            held += 12
            table, width, size = {}, 9, 258
        elif size >= 1 << width:
            width += 1
        prefix = byte
        if held >= 512:
            keep = held & 7
            out += (acc >> keep).to_bytes(held >> 3, "big")
            acc &= (1 << keep) - 1
            held = keep
    if prefix >= 0:
        acc, held = (acc << width) | prefix, held + width
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    acc, held = (acc << width) | 257, held + width
    pad = -held % 8
    out += (acc << pad).to_bytes((held + pad) >> 3, "big")
    return bytes(out)


def _decode(kind: str, data: bytes, size: int) -> bytes:
    if kind == "none":
        raw = data
    elif kind == "packbits":
        raw = unpack_bits(data)
    elif kind == "lzw":
        raw = lzw_decode(data)
    else:
        raw = zlib.decompressobj().decompress(data, size)
    if len(raw) < size:
        raise ValueError(f"{kind} data ends after {len(raw)} of {size} bytes")
    return raw[:size]


def _following(data: bytes, at: int, order: str, big: bool) -> int:
    """The offset of the directory after the one at ``at``."""
    head, entry = ("Q", 20) if big else ("H", 12)
    (n,) = struct.unpack_from(order + head, data, at)
    return struct.unpack_from(order + ("Q" if big else "I"), data, at + struct.calcsize(head) + n * entry)[0]


def _directory(data: bytes, at: int, order: str, big: bool) -> dict:
    """Values by tag name."""
    head, entry, inline = ("Q", 20, 8) if big else ("H", 12, 4)
    (n,) = struct.unpack_from(order + head, data, at)
    at += struct.calcsize(head)
    found = {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", data, at + i * entry)
        (count,) = struct.unpack_from(order + ("Q" if big else "I"), data, at + i * entry + 4)
        if tag not in TAGS or kind not in TYPE_LETTERS:
            continue
        where = at + i * entry + (12 if big else 8)
        if count * TYPE_SIZES[kind] > inline:
            (where,) = struct.unpack_from(order + ("Q" if big else "I"), data, where)
        found[TAGS[tag]] = struct.unpack_from(f"{order}{count}{TYPE_LETTERS[kind]}", data, where)
    return found


def _samples(raw: bytes, rows: int, across: int, each: int, bits: int, predictor: int, wide: np.dtype) -> np.ndarray:
    """A decoded strip or tile as rows, pixels, samples, its predictor undone."""
    flat = np.frombuffer(raw, np.uint8)
    if bits < 8:
        single = np.unpackbits(flat.reshape(rows, -1), axis=1)[:, : across * each * bits].reshape(rows, across, each, bits)
        return single @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
    if predictor == 3:  # bytes of a row: all the high ones first, each less the one before
        planes = np.cumsum(flat.reshape(rows, across * wide.itemsize, each), axis=1, dtype=np.uint8).reshape(rows, wide.itemsize, across * each)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(wide.newbyteorder(">")).reshape(rows, across, each)
    chunk = flat.view(wide).reshape(rows, across, each)
    return np.cumsum(chunk, axis=1, dtype=wide.newbyteorder("=")) if predictor == 2 else chunk


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _moments(values: np.ndarray, kind: np.dtype) -> tuple[float, float]:
    """Mean and standard deviation of all samples, read as ``kind``, in blocks."""
    flat = values.reshape(-1).view(kind)
    blocks = [slice(at, at + BLOCK) for at in range(0, len(flat), BLOCK)]
    mean = sum(float(flat[b].sum(dtype=np.float64)) for b in blocks) / len(flat)
    return mean, math.sqrt(sum(float(np.square(flat[b].astype(np.float64) - mean).sum()) for b in blocks) / len(flat))


def _page(data: bytes, tags: dict, order: str, most_bytes: int) -> dict:
    """A page's fields; ``samples`` is a view of its decoded bytes."""
    one = lambda name, default=None: tags[name][0] if tags.get(name) else default
    width, height, samples = one("width"), one("height"), one("samples", 1)
    bits, predictor, planar = one("bits", 1), one("predictor", 1), one("planar", 1)
    kind = COMPRESSIONS.get(one("compression", 1))
    if not width or not height or kind is None or bits not in (1, 2, 4, 8, 16, 32, 64) or predictor not in (1, 2, 3) or len(set(tags.get("bits", (bits,)))) > 1:
        raise ValueError("a size, compression, sample depth or predictor that is not supported")
    if predictor > 1 and bits < 8 * (predictor - 1):
        raise ValueError("a predictor that such samples don't have")
    if width * height * samples * max(8, bits) // 8 > most_bytes:
        raise ValueError(f"more than {most_bytes} bytes of samples")
    tiled = "tile_offsets" in tags
    if tiled:
        cw, ch, offsets, sizes = one("tile_width"), one("tile_height"), tags["tile_offsets"], tags["tile_sizes"]
    else:
        cw, ch, offsets, sizes = width, min(height, one("strip_rows", height)), tags["strip_offsets"], tags["strip_sizes"]
    across, down = -(-width // cw), -(-height // ch)
    planes, each = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < across * down * planes or len(sizes) < len(offsets):
        raise ValueError("too few strips or tiles")
    wide = np.dtype(f"{'<' if order == '<' else '>'}u{max(8, bits) // 8}")
    if cw * ch * each * max(8, bits) // 8 > most_bytes:
        raise ValueError(f"strips or tiles of more than {most_bytes} bytes")
    whole = across * down * planes == 1 and (cw, ch) == (width, height)  # the only cell is the page itself
    image = None if whole else np.zeros((planes, height, width, each), wide.newbyteorder("<"))
    for k in range(across * down * planes):
        plane, cell = divmod(k, across * down)
        top, left = cell // across * ch, cell % across * cw
        rows = ch if tiled else min(ch, height - top)
        stored = data[offsets[k] : offsets[k] + sizes[k]]
        if one("fill_order", 1) == 2:
            stored = stored.translate(_REVERSED)
        raw = _decode(kind, stored, rows * -(-cw * each * bits // 8))
        chunk = _samples(raw, rows, cw, each, bits, predictor, wide)
        if whole:
            image = chunk.astype(wide.newbyteorder("<"), copy=False)[None]
            break
        image[plane, top : top + rows, left : left + cw] = chunk[: height - top, : width - left]
    image = np.ascontiguousarray(np.moveaxis(image, 0, -1).reshape(height, width, samples) if planes > 1 else image[0])
    floats = bits >= 16 and (predictor == 3 or one("sample_format", 1) == 3)
    mean, spread = _moments(image, np.dtype(f"<f{bits // 8}") if floats else image.dtype)
    return {
        "width": width, "height": height, "samples_per_pixel": samples, "bits": bits, "compression": kind, "predictor": predictor, "layout": "tiles" if tiled else "strips",
        "samples": memoryview(image.reshape(-1).view(np.uint8)), "mean": mean, "spread": spread,
    }


#: What reading a broken or unsupported page raises.
_BROKEN = (ValueError, KeyError, TypeError, struct.error, zlib.error, IndexError, ZeroDivisionError, OverflowError, MemoryError)


def walk(data: bytes | None, most_page_bytes: int = MOST_PAGE_BYTES) -> Iterator[dict]:
    """The pages of a file one by one, in the order of its directories; ``samples`` are views."""
    if not data:
        return
    n = 0

    def failed(error: Exception) -> dict:
        return {"page": n, "error": f"{type(error).__name__}: {error}"[:200]}

    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        (magic,) = struct.unpack_from(order + "H", data, 2)
        big = {42: False, 43: True}[magic]
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
        seen = set()
        while at and at not in seen:
            seen.add(at)
            here, at = at, _following(data, at, order, big)
            try:
                page = _page(data, _directory(data, here, order, big), order, most_page_bytes) | {"page": n}
            except _BROKEN as error:
                page = failed(error)
            yield page
            n += 1
    except _BROKEN as error:
        yield failed(error)


def pages(data: bytes | None, most_page_bytes: int = MOST_PAGE_BYTES) -> list[dict]:
    """Every page of a file, samples as bytes."""
    return [p | {"samples": bytes(p["samples"])} if "samples" in p else p for p in walk(data, most_page_bytes)]


def write(payload: bytes, compression: str = "deflate", tiled: bool = False, predictor: int = 1, width: int = ROW, page_rows: int = PAGE_ROWS, chunk_rows: int = CHUNK_ROWS) -> bytes:
    """A little-endian file of 8-bit grey pages that hold ``payload``, whose size is a multiple of ``width``."""
    code = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}[compression]
    pack = {"none": bytes, "lzw": lzw_encode, "packbits": pack_bits, "deflate": lambda raw: zlib.compress(raw, 6)}[compression]
    out, patch = bytearray(b"II*\0\0\0\0\0"), 4
    for begin in range(0, len(payload), width * page_rows):
        image = np.frombuffer(payload[begin : begin + width * page_rows], np.uint8).reshape(-1, width)
        height, chunks = len(image), []
        for top in range(0, height, chunk_rows):
            rows = image[top : top + chunk_rows]
            if tiled and len(rows) < chunk_rows:
                rows = np.vstack([rows, np.zeros((chunk_rows - len(rows), width), np.uint8)])
            if predictor == 2:
                rows = np.diff(rows, axis=1, prepend=np.uint8(0))
            chunks.append(pack(rows.tobytes()))
        offsets, sizes = [], [len(c) for c in chunks]
        for c in chunks:
            offsets.append(len(out))
            out += c
        fields = [(256, [width]), (257, [height]), (258, [8]), (259, [code]), (262, [1])]
        if not tiled:
            fields += [(273, offsets), (277, [1]), (278, [chunk_rows]), (279, sizes), (317, [predictor])]
        else:
            fields += [(277, [1]), (317, [predictor]), (322, [width]), (323, [chunk_rows]), (324, offsets), (325, sizes)]
        entries = b""
        for tag, values in fields:
            if len(values) > 1:
                place = len(out)
                out += struct.pack(f"<{len(values)}I", *values)
                entries += struct.pack("<HHII", tag, 4, len(values), place)
            else:
                entries += struct.pack("<HHII", tag, 4, 1, values[0])
        struct.pack_into("<I", out, patch, len(out))
        out += struct.pack("<H", len(fields)) + entries
        patch = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def store(payload: bytes) -> bytes:
    """A file for ``payload``; its checksum picks codec, layout and predictor, so that a corpus holds every kind."""
    pick = zlib.crc32(payload)
    compression = ("lzw", "packbits", "deflate")[pick % 3]
    return write(payload, compression, tiled=bool(pick >> 8 & 1), predictor=1 + (pick >> 9 & 1))


class TiffColumns:
    """Writing TIFF files as a column function."""

    def __init__(self, spark: SparkSession) -> None:

        @F.pandas_udf("binary")
        def stored(payloads: pd.Series) -> pd.Series:
            return pd.Series([None if p is None else store(bytes(p)) for p in payloads], dtype=object)

        self._stored = stored

    def store(self, payload: Column | str) -> Column:
        """A TIFF file for each payload; its size must be a multiple of 64."""
        return self._stored(payload)


def _page_array(found: list[dict]) -> pa.StructArray:
    """Pages as an Arrow array; the samples of a single page aren't copied."""
    parts = []
    for field in _PAGE:
        if field.name == "samples" and len(found) == 1 and "samples" in found[0]:
            view = found[0]["samples"]
            parts.append(pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(view)], np.int32)), pa.py_buffer(view)]))
        else:
            parts.append(pa.array([p.get(field.name) for p in found], field.type))
    return pa.StructArray.from_arrays(parts, fields=list(_PAGE))


def _pieces(batch: pa.RecordBatch, most_page_bytes: int) -> Iterator[tuple[list[int], list[dict]]]:
    """(rows, their pages) of a batch whose last column is the file, at most ``PIECE_BYTES`` of samples or one page."""
    rows, found, held = [], [], 0
    for row in range(batch.num_rows):
        for page in walk(batch.column(batch.num_columns - 1)[row].as_py(), most_page_bytes):
            size = len(page.get("samples", b""))
            if found and held + size > PIECE_BYTES:
                yield rows, found
                rows, found, held = [], [], 0
            rows.append(row)
            found.append(page)
            held += size
    if found:
        yield rows, found


def page_rows(files: DataFrame, media: str = "media", most_page_bytes: int = MOST_PAGE_BYTES) -> DataFrame:
    """One row per page: the other columns of ``files``, then PAGE_FIELDS as struct ``tiff``.

    Files without a page have no row.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in _pieces(batch, most_page_bytes):
                own = batch.take(pa.array(rows, pa.int32())).columns[:-1] if batch.num_columns > 1 else []
                yield pa.RecordBatch.from_arrays([*own, _page_array(found)], names=[*batch.schema.names[:-1], "tiff"])

    rows = files.select(*[c for c in files.columns if c != media], F.col(media).alias("__media"))
    return rows.mapInArrow(read, StructType(rows.schema.fields[:-1]).add("tiff", _PAGE_TYPE))


def file_rows(files: DataFrame, media: str = "media", most_page_bytes: int = MOST_PAGE_BYTES) -> DataFrame:
    """One row per file: its columns, the file last, then ``pages``, an array of PAGE_FIELDS; a row holds all pages of its file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, lists = 0, 0, []
            for row in range(batch.num_rows):
                lists.append(pages(batch.column(batch.num_columns - 1)[row].as_py(), most_page_bytes))
                held += sum(len(p.get("samples", b"")) for p in lists[-1])
                if held > PIECE_BYTES or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(lists)).columns, pa.array(lists, pa.list_(_PAGE))], names=[*batch.schema.names, "pages"])
                    at, held, lists = row + 1, 0, []

    rows = files.select(*[c for c in files.columns if c != media], media)
    return rows.mapInArrow(read, StructType(list(rows.schema.fields)).add("pages", ArrayType(_PAGE_TYPE)))
