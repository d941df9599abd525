"""Media columns: Netpbm and BMP images in binary columns.

Decoding gives numpy arrays of 8- or 16-bit samples; resizing averages over areas by
integral images; tiles are written as NPY; a difference hash describes each image.

Defined results: a null payload is an empty one; an image of no rows or columns is
refused by the encoders with ValueError, and `payload_to_image` never makes one,
since it pads with blanks to at least one row. Broken or null stored bytes decode to
a null feature and null payload (`read_media` with strict=False) or raise ValueError.
Repeated rows give repeated results. Other columns of the input are passed over.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dimspark.llm.common import map_rows, read_table

#: Samples in a row of a stored payload: 64 pixels of three channels.
ROW_BYTES = 192
#: Rows whose integral image is held at a time.
BAND_ROWS = 4096


# --- Netpbm ---------------------------------------------------------------


def encode_netpbm(image: np.ndarray) -> bytes:
    """A grey (h, w) image as P5, a colour (h, w, 3) image as P6; bool as P4."""
    if image.ndim not in (2, 3) or 0 in image.shape or (image.ndim == 3 and image.shape[2] != 3):
        raise ValueError(f"not an image: shape {image.shape}")
    h, w = image.shape[:2]
    if image.dtype == bool:
        if image.ndim != 2:
            raise ValueError("a bitmap has one channel")
        return b"P4\n%d %d\n" % (w, h) + np.packbits(image, axis=1).tobytes()
    if image.dtype not in (np.uint8, np.uint16):
        raise ValueError(f"samples of type {image.dtype}")
    wide = image.dtype == np.uint16
    body = image.astype(">u2").tobytes() if wide else np.ascontiguousarray(image).tobytes()
    return b"%s\n%d %d\n%d\n" % (b"P5" if image.ndim == 2 else b"P6", w, h, 65535 if wide else 255) + body


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """The numbers after the magic, with comments skipped, and where the samples begin."""
    values, at = [], 2
    while len(values) < fields:
        if at >= len(data):
            raise ValueError("the header ends early")
        c = data[at : at + 1]
        if c == b"#":
            end = data.find(b"\n", at)
            at = len(data) if end < 0 else end + 1
        elif c.isspace():
            at += 1
        elif c.isdigit():
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            values.append(int(data[at:end]))
            at = end
        else:
            raise ValueError("the header has something other than numbers")
    return values, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6: bitmaps as bool (true is black), grey (h, w), colour (h, w, 3)."""
    magic = data[:2]
    if magic not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    bitmap, plain, colour = magic in (b"P1", b"P4"), magic in (b"P1", b"P2", b"P3"), magic in (b"P3", b"P6")
    values, at = _header(data, 2 if bitmap else 3)
    w, h = values[:2]
    most = 1 if bitmap else values[2]
    if not w or not h or not 0 < most < 65536:
        raise ValueError("an empty image or a bad range")
    shape = (h, w, 3) if colour else (h, w)
    count = h * w * (3 if colour else 1)
    if plain:
        body = b"\n".join(line.split(b"#")[0] for line in data[at - 1 :].split(b"\n"))
        found = list(body.translate(None, b" \t\r\n\x0b\x0c")) if magic == b"P1" else body.split()
        if len(found) < count:
            raise ValueError("too few samples")
        flat = np.array([int(chr(x)) if magic == b"P1" else int(x) for x in found[:count]], dtype=np.uint16)
    elif bitmap:
        row = (w + 7) // 8
        if len(data) - at < row * h:
            raise ValueError("too few samples")
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at).reshape(h, row), axis=1)
        return bits[:, :w].astype(bool)
    else:
        kind = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
        if len(data) - at < count * kind.itemsize:
            raise ValueError("too few samples")
        flat = np.frombuffer(data, kind, count, at)
    if flat.size and int(flat.max()) > most:
        raise ValueError("a sample above the range")
    return flat.astype(bool if bitmap else np.uint16 if most > 255 else np.uint8).reshape(shape)


# --- BMP ------------------------------------------------------------------


def encode_bmp(image: np.ndarray) -> bytes:
    """An 8-bit colour (h, w, 3) image as uncompressed 24-bit BMP, rows from the bottom."""
    if image.ndim != 3 or image.shape[2] != 3 or image.dtype != np.uint8 or 0 in image.shape:
        raise ValueError(f"not an 8-bit colour image: shape {image.shape}")
    h, w = image.shape[:2]
    row = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = image[::-1, :, ::-1].reshape(h, w * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + row * h, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0) + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (with palette), 24 or 32 bits, either row order, as (h, w, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not BMP")
    start = struct.unpack_from("<I", data, 10)[0]
    head, w, h, _, depth, packing = struct.unpack_from("<IiiHHI", data, 14)
    down, h = h < 0, abs(h)
    if packing != 0 or depth not in (8, 24, 32) or w <= 0 or not h:
        raise ValueError("a BMP of a kind that isn't read")
    row = (w * depth // 8 + 3) // 4 * 4
    if len(data) < start + row * h:
        raise ValueError("too few samples")
    rows = np.frombuffer(data, np.uint8, row * h, start).reshape(h, row)
    rows = rows if down else rows[::-1]
    if depth == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(used, 4)
        return np.ascontiguousarray(palette[rows[:, :w]][:, :, 2::-1])
    pixels = rows[:, : w * depth // 8].reshape(h, w, depth // 8)
    return np.ascontiguousarray(pixels[:, :, 2::-1])


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# --- resizing, tiles and hashes ---------------------------------------------


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Averages of the areas that each output pixel covers, as float64.

    The integral image is made in bands of rows and read between its points by linear
    interpolation, which is exact for pixels of constant value.
    """
    source = image.reshape(*image.shape[:2], -1)
    h, w, c = source.shape
    ys, xs = np.arange(height + 1) * h / height, np.arange(width + 1) * w / width
    x0 = np.minimum(xs.astype(np.int64), w - 1)
    fx = (xs - x0)[None, :, None]
    lines = np.zeros((height + 1, width + 1, c))
    above, done = np.zeros((w + 1, c)), 0
    y0 = np.minimum(ys.astype(np.int64), h - 1)
    for at in range(0, h, BAND_ROWS):
        band = source[at : at + BAND_ROWS]
        sums = np.zeros((len(band) + 1, w + 1, c))
        np.cumsum(np.cumsum(band, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
        sums += above
        end = int(np.searchsorted(y0, at + len(band), "left"))
        for k in range(done, end):
            line = sums[y0[k] - at] + (ys[k] - y0[k]) * (sums[y0[k] - at + 1] - sums[y0[k] - at])
            lines[k] = (line[x0] + fx[0] * (line[x0 + 1] - line[x0]))
        done, above = end, sums[-1].copy()
    area = (h / height) * (w / width)
    out = (lines[1:, 1:] - lines[:-1, 1:] - lines[1:, :-1] + lines[:-1, :-1]) / area
    return out.reshape(height, width, *image.shape[2:])


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, side: int = 32) -> bytes:
    """The image resized to side x side, rounded to 8 bits, as NPY."""
    small = np.rint(area_resize(image.astype(np.uint8) * 255 if image.dtype == bool else image, side, side))
    return npy_bytes(small.astype(np.uint16 if image.dtype == np.uint16 else np.uint8))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 areas is darker than the one to its right."""
    small = area_resize(image, 8, 9)
    grey = small if small.ndim == 2 else small @ np.array([0.299, 0.587, 0.114])
    bits = np.packbits((grey[:, :-1] + 1e-9 < grey[:, 1:]).ravel())
    return int.from_bytes(bits.tobytes(), "big")


# --- columns ----------------------------------------------------------------


def payload_to_image(payload: bytes) -> np.ndarray:
    """Bytes as rows of 64 RGB pixels, padded by blanks to a positive multiple of a row."""
    full = payload + b" " * (-len(payload) % ROW_BYTES or (0 if payload else ROW_BYTES))
    return np.frombuffer(full, np.uint8).reshape(-1, ROW_BYTES // 3, 3)


ENCODERS = {"ppm": encode_netpbm, "bmp": encode_bmp}
DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, dhash string, npy_sha256 string"


def stored_form(payload: bytes | None, container: str = "ppm") -> bytes:
    """The stored image of a payload."""
    return ENCODERS[container](payload_to_image(payload or b""))


def digests_of(stored: bytes, side: int = 32) -> tuple:
    """The DIGESTS of an image, all from its stored bytes."""
    image = decode(stored)
    body = image.tobytes()
    return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{difference_hash(image):016x}", hashlib.sha256(tile(image, side)).hexdigest()


def store_media(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("doc_id",), container: str = "ppm") -> DataFrame:
    """The columns keep, n_bytes (of the unpadded payload) and media (the stored image)."""
    fields = df.select(*keep).schema
    run = lambda *row: (*row[:-1], len(row[-1] or b""), stored_form(row[-1], container))
    return map_rows(df.withColumn(payload, F.col(payload).cast("binary")), fields.add("n_bytes", "long").add("media", "binary"), run, [*keep, payload])


def read_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes"), digest: bool = False, side: int = 32, strict: bool = True) -> DataFrame:
    """Decodes the stored images.

    Returns keep, payload (the samples as bytes), width, height, npy (the tile), dhash
    (hexadecimal) and npy_sha256; with digest, the DIGESTS of payload, media and tile.
    """
    schema = df.select(*keep).schema
    for f in StructType.fromDDL(DIGESTS if digest else "payload binary, width int, height int, npy binary, dhash string, npy_sha256 string"):
        schema = schema.add(f)
    width = len(schema) - len(keep)

    def run(*row):
        stored = row[-1] if row[-1] is not None else b""
        try:
            if digest:
                return *row[:-1], *digests_of(stored, side)
            image = decode(stored)
        except (ValueError, struct.error):
            if strict:
                raise
            return (*row[:-1], *[None] * width)
        npy = tile(image, side)
        return (*row[:-1], image.tobytes(), image.shape[1], image.shape[0], npy, f"{difference_hash(image):016x}", hashlib.sha256(npy).hexdigest())

    return map_rows(df, schema, run, [*keep, media], 500)


def digest_media(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("doc_id",), container: str = "ppm") -> DataFrame:
    """`read_media` with digest of `store_media`, in one pass: each image is stored, and read back from its stored bytes, where it is made."""
    schema = df.select(*keep).schema.add("n_bytes", "long")
    for f in StructType.fromDDL(DIGESTS):
        schema = schema.add(f)
    run = lambda *row: (*row[:-1], len(row[-1] or b""), *digests_of(stored_form(row[-1], container)))
    return map_rows(df.withColumn(payload, F.col(payload).cast("binary")), schema, run, [*keep, payload], 500)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("payload"))
    feature = F.concat_ws(":", F.lit("dhash"), "dhash", F.lit("npy"), F.substring("npy_sha256", 1, 16)).alias("feature")
    return digest_media(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)
