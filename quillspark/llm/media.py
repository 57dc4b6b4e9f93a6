"""PNG images in binary columns: written and read chunk by chunk, with checksums, and hashed by their cosine transform.

Only 8-bit greyscale images without interlacing are written and read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_chunks

WIDTH = 576
FILL = b"\xff"
LEVEL = 1
IDAT_BYTES = 1 << 16
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRID, LOW = 32, 8
COSINES = np.cos(np.pi / GRID * (np.arange(GRID) + 0.5)[None, :] * np.arange(LOW)[:, None])


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode(pixels: np.ndarray, level: int = LEVEL, filters: np.ndarray | None = None) -> bytes:
    """A PNG of a two-dimensional uint8 array. ``filters``: a filter type for each row; by default none."""
    height, width = pixels.shape
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = 0 if filters is None else filters
    lines[:, 1:] = pixels if filters is None else _filtered(pixels, filters)
    packed = zlib.compress(lines.tobytes(), level)
    parts = [packed[i : i + IDAT_BYTES] for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)), *(_chunk(b"IDAT", p) for p in parts), _chunk(b"IEND", b"")])


def _filtered(pixels: np.ndarray, filters: np.ndarray) -> np.ndarray:
    p = pixels.astype(np.int16)
    left, up, both = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    left[:, 1:], up[1:], both[1:, 1:] = p[:, :-1], p[:-1], p[:-1, :-1]
    guess = np.choose(np.asarray(filters)[:, None], [np.zeros_like(p), left, up, (left + up) // 2, _paeth(left, up, both)])
    return (p - guess).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Pixels of filtered rows whose first byte is the filter type. Rows of types 0 to 2 are sums along an axis, whole
    runs at once; types 3 and 4 go pixel by pixel, as each needs the one before."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG filter")
    y, height = 0, len(out)
    while y < height:
        kind, end = kinds[y], y + 1
        while end < height and kinds[end] == kind:
            end += 1
        above = out[y - 1] if y else np.zeros(out.shape[1], np.uint8)
        if kind == 1:
            out[y:end] = np.cumsum(out[y:end], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[y:end] = np.cumsum(np.concatenate((above[None], out[y:end])), axis=0, dtype=np.uint8)[1:]
        elif kind > 2:
            for r in range(y, end):
                row, up, left, corner = out[r].tolist(), (out[r - 1] if r else above).tolist(), 0, 0
                for x, b in enumerate(up):
                    if kind == 3:
                        guess = (left + b) // 2
                    else:
                        da, db, dc = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
                        guess = left if da <= db and da <= dc else b if db <= dc else corner
                    row[x] = left = (row[x] + guess) & 255
                    corner = b
                out[r] = row
        y = end
    return out


def decode(png: bytes) -> np.ndarray:
    """The pixels of a PNG. A wrong signature, checksum, header or amount of data is a ValueError."""
    if png[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, size, packed, ended = 8, None, [], False
    while at < len(png):
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if len(png) < at + 12 + n or zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError("a chunk is broken")
        at += 12 + n
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit greyscale image")
            size = height * (width + 1)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
    if size is None or not ended:
        raise ValueError("a chunk is missing")
    inflate = zlib.decompressobj()
    raw = inflate.decompress(b"".join(packed), size + 1)
    if len(raw) != size or not inflate.eof and inflate.decompress(inflate.unconsumed_tail, 1):
        raise ValueError("the image has another size than it says")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def cosine_hash(pixels: np.ndarray) -> str:
    """64 bits, as hex: which of the 8 x 8 lowest cosine coefficients of the image, shrunk to 32 x 32 by means, exceed
    their median. The constant coefficient counts as 0, so brightness alone changes nothing."""
    small = pixels.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        at = np.arange(GRID) * n // GRID
        width = np.maximum(np.diff(np.append(at, n)), 1)
        small = np.add.reduceat(small, at, axis=axis) / (width[:, None] if axis == 0 else width[None, :])
    low = np.round(COSINES @ small @ COSINES.T, 6)
    low[0, 0] = 0
    return np.packbits((low > np.median(low)).ravel()).tobytes().hex()


def payload(text: str | None, unit: int = WIDTH) -> tuple[bytes, int]:
    """A text's UTF-8 bytes, filled with 255 to a positive multiple of ``unit``, and their number before."""
    raw = (text or "").encode()
    return raw + FILL * (max(1, -(-len(raw) // unit)) * unit - len(raw)), len(raw)


def images(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, level: int = LEVEL) -> DataFrame:
    """(id, n_bytes, media): each text's bytes as the pixels of a PNG, ``width`` to a row. Null text counts as empty,
    which is one row of filling. Repeated rows each have their image; equal texts have equal images."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "text"):
            made = [payload(t, width) for t in b.column(1).to_pylist()]
            pngs = [encode(np.frombuffer(p, np.uint8).reshape(-1, width), level) for p, _ in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for _, n in made], pa.int64()), pa.array(pngs, pa.binary())], ["id", "n_bytes", "media"])

    return small_batches(narrow).mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary")


def features(media: DataFrame, keep: tuple[str, ...] = ("id", "n_bytes"), column: str = "media") -> DataFrame:
    """(*keep, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of stored images, each
    read back from its bytes. A null image has nulls; a broken one fails the query, as a stored table must be whole."""
    narrow = media.select(*keep, F.col(column).alias("__media"))
    kept = len(keep)

    def of(png: bytes | None) -> tuple:
        if png is None:
            return (None,) * 6
        pixels = decode(png)
        body = pixels.tobytes()
        return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(pixels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for b in text_chunks(batches, "__media"):
            found = list(zip(*[of(p) for p in b.column(kept).to_pylist()])) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:kept], *(pa.array(c, k) for c, k in zip(found, kinds))],
                [*b.schema.names[:kept], "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema[:kept])
    return small_batches(narrow).mapInArrow(run, f"{fields}payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
