"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized by integral images, as NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sessionloom.llm.shared import written

#: Pixels of a row of stored text bytes; a payload is a positive multiple of it.
ROW = 576
FILL = 255
TAIL = 32
#: Height and width of a text's tile.
TILE = (16, 18)
#: Rows of pixels whose integral image is held at once.
BAND = 4096


def _netpbm_tokens(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """``n`` header numbers from position ``at``, and where the one white space behind them ends."""
    found: list[int] = []
    while len(found) < n:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("no number in a Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels) of uint8 or uint16; P1 and P4 give 0 for black and 1 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _netpbm_tokens(data, 2, 2 if bitmap else 3)
    width, height, top = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    n = width * height * channels
    if kind == b"P4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at).reshape(height, -1)
        return (1 - np.unpackbits(rows, axis=1)[:, :width])[..., None]
    if kind == b"P1":
        bits = [c - 48 for c in data[at:] if c in b"01"]
        return (1 - np.array(bits[:n], np.uint8)).reshape(height, width, 1)
    wide = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
    if kind in (b"P2", b"P3"):
        values = np.array(data[at:].split()[:n], dtype=np.int64).astype(wide.newbyteorder("="))
    else:
        values = np.frombuffer(data, wide, n, at).astype(wide.newbyteorder("="))
    return values.reshape(height, width, channels)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits a pixel as (height, width, 1, 3 or 4) of uint8, top row first, RGB(A) order."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packing = struct.unpack_from("<4xIIiiHHI", data, 6)
    if packing not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError(f"BMP of {bits} bits with compression {packing}")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    pixels = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        grey = (palette == palette[:, :1]).all()
        return palette[pixels[..., 0]][..., :1] if grey else palette[pixels[..., 0]]
    return pixels[..., [2, 1, 0] if bits == 24 else [2, 1, 0, 3]]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_netpbm(image: np.ndarray) -> bytes:
    """(height, width, 1 or 3) of uint8 as binary P5 or P6."""
    height, width, channels = image.shape
    return b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, width, height) + image.astype(np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """(height, width, 3) of uint8 as a 24-bit BMP."""
    height, width, _ = image.shape
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = image[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0)
    return head + rows.tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas of each channel, as (height, width, channels) of float64.

    An integral image gives the sum over any rectangle from its corners; between pixels it is linear. It is built in
    bands of rows, and only its values at the output's edges are kept, so memory does not grow with the image's height.
    """
    h, w, channels = image.shape
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    at, part = np.minimum(xs.astype(int), w - 1), xs - np.minimum(xs.astype(int), w - 1)
    edges = np.zeros((height + 1, width + 1, channels))
    above = np.zeros((width + 1, channels))
    for top in range(0, h, BAND):
        band = image[top : top + BAND].astype(np.float64)
        across = np.zeros((len(band), w + 1, channels))
        np.cumsum(band, axis=1, out=across[:, 1:])
        sums = across[:, at] + (across[:, at + 1] - across[:, at]) * part[:, None]
        integral = np.concatenate([above[None], above + np.cumsum(sums, axis=0)])
        here = np.flatnonzero((ys > top) & (ys <= top + len(band)))
        y = np.minimum((ys[here] - top).astype(int), len(band) - 1)
        edges[here] = integral[y] + (integral[y + 1] - integral[y]) * (ys[here] - top - y)[:, None, None]
        above = integral[-1]
    sums = edges[1:, 1:] - edges[:-1, 1:] - edges[1:, :-1] + edges[:-1, :-1]
    return sums / ((h / height) * (w / width))


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hex of the bits that tell whether each cell of a (side, side + 1) resize is brighter than the one to its right."""
    grey = area_resize(image[..., :3], side, side + 1).mean(axis=2)
    bits = np.round(grey[:, :-1], 6) > np.round(grey[:, 1:], 6)
    return np.packbits(bits.ravel()).tobytes().hex()


def npy_tiles(image: np.ndarray, side: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY file) of the tiles of at most ``side`` by ``side`` pixels."""
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            yield y // side, x // side, npy(image[y : y + side, x : x + side])


def text_image(data: bytes) -> np.ndarray:
    """Text bytes as pixels: rows of ROW bytes, filled up with FILL, at least one row.

    Texts whose CRC is odd become RGB images of ROW / 3 pixels a row, the others grey ones; so equal texts are equal images.
    """
    rows = max(1, -(-len(data) // ROW))
    pixels = np.full(rows * ROW, FILL, dtype=np.uint8)
    pixels[: len(data)] = np.frombuffer(data, np.uint8)
    return pixels.reshape(rows, ROW // 3, 3) if zlib.crc32(data) % 2 else pixels.reshape(rows, ROW, 1)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as an image, grey ones as P5 and RGB ones as 24-bit BMP.

    A null text is empty; an empty text is one row of FILL. A very long text is one image, held by one task.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                image = text_image(data)
                sizes.append(len(data))
                media.append(encode_netpbm(image) if image.shape[2] == 1 else encode_bmp(image))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(store, f"doc_id {kind}, n_bytes long, media binary")


def npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(image), allow_pickle=False)
    return out.getvalue()


def media_tiles(stored: DataFrame) -> DataFrame:
    """What the stored bytes decode to, per row of (doc_id, n_bytes, media): sizes, digests, and the image as an NPY tile.

    The tile is the image area-resized to TILE pixels. A null media value gives nulls; bytes that are no image of these
    formats raise an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                media = value.as_py()
                if media is None:
                    rows.append((None,) * 6)
                    continue
                image = decode(media)
                payload = image.tobytes()
                tile = np.round(area_resize(image, *TILE)).astype(np.uint8)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), npy(tile)))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "npy"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            found = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *found], ["doc_id", "n_bytes", *names])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, npy binary")


def hashed_tiles(table: DataFrame) -> DataFrame:
    """``table`` with its NPY tiles (column ``npy``) replaced by their difference hashes, ``feature``; null for null."""
    kept = [c for c in table.columns if c != "npy"]
    schema = T.StructType([*(table.schema[c] for c in kept), T.StructField("feature", T.StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [difference_hash(np.load(io.BytesIO(v.as_py()), allow_pickle=False)) if v.is_valid else None for v in batch.column("npy")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], [*kept, "feature"])

    return table.mapInArrow(read, schema)


def tiles(stored: DataFrame, height: int, width: int, side: int) -> DataFrame:
    """(doc_id, tile_row, tile_column, npy, tile_hash): each image resized to (height, width) and cut into NPY tiles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, value in zip(batch.column("doc_id"), batch.column("media"), strict=True):
                if not value.is_valid:
                    continue
                image = np.round(area_resize(decode(value.as_py()), height, width)).astype(np.uint8)
                found = [(r, c, tile, difference_hash(np.load(io.BytesIO(tile)))) for r, c, tile in npy_tiles(image, side)]
                cols = [pa.array([t[i] for t in found], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(found), doc.type), *cols], ["doc_id", "tile_row", "tile_column", "npy", "tile_hash"])

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "media").mapInArrow(cut, f"doc_id {kind}, tile_row int, tile_column int, npy binary, tile_hash string")


def text_media(docs: DataFrame) -> DataFrame:
    """The features of the texts of ``docs``: stored as images, read back and cut to NPY tiles, which are stored and read too.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, the
    tile's difference hash. A null text is empty, a null doc_id stays, repeated rows are rows, equal texts get equal
    values, other columns go; an empty table gives an empty result.
    """
    stored = written(store_texts(docs), "media-stored")
    return hashed_tiles(written(media_tiles(stored), "media-tiles"))
