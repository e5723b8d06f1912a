"""Images in columns: Netpbm and BMP decoding, area resizing, NPY tiles and difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echofold.llm.spark_util import parts_by_bytes, text_or_empty

WIDTH = 64
TILE = 16
#: Samples that are held as wide integers at a time while resizing.
BLOCK = 1 << 20


def decode_netpbm(data: bytes) -> np.ndarray:
    """P2, P3, P5 or P6 with at most 255 levels as (rows, columns[, 3]) uint8; other input raises ValueError."""
    fields, at = [], 0
    while len(fields) < 4:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        begin = at
        while at < len(data) and not data[at : at + 1].isspace():
            at += 1
        if begin == at:
            raise ValueError("the header ends early")
        fields.append(data[begin:at])
    kind, width, height, most = fields[0], int(fields[1]), int(fields[2]), int(fields[3])
    if kind not in (b"P2", b"P3", b"P5", b"P6") or not 0 < most < 256:
        raise ValueError("not an 8-bit Netpbm image")
    channels = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * channels
    if kind in (b"P5", b"P6"):
        samples = np.frombuffer(data, np.uint8, offset=at + 1, count=count)
    else:
        samples = np.array(data[at:].split()[:count], dtype=np.uint8)
    if len(samples) != count:
        raise ValueError("samples are missing")
    return samples.reshape((height, width, 3) if channels == 3 else (height, width))


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (palette) or 24-bit BMP; grey palettes give (rows, columns), else (rows, columns, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    offset, header = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing or bits not in (8, 24):
        raise ValueError("only uncompressed 8 and 24 bits are read")
    stride = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, offset=offset, count=stride * abs(height)).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 24:
        return rows[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 256
    palette = np.frombuffer(data, np.uint8, offset=14 + header, count=4 * used).reshape(used, 4)[:, 2::-1]
    colours = palette[rows[:, :width]]
    return colours[:, :, 0] if (palette == palette[:, :1]).all() else colours


def encode_bmp(image: np.ndarray) -> bytes:
    """Grey (rows, columns) as 8-bit BMP with a grey palette."""
    height, width = image.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = image[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    offset = 14 + 40 + 1024
    return (
        b"BM"
        + struct.pack("<IHHI", offset + rows.size, 0, 0, offset)
        + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 0, 0, 256, 0)
        + palette.tobytes()
        + rows.tobytes()
    )


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _at_edges(sums: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Linear interpolation of cumulative sums (first row 0) at fractional positions along axis 0."""
    low = np.minimum(edges.astype(np.int64), len(sums) - 1)
    high = np.minimum(low + 1, len(sums) - 1)
    part = (edges - low)[:, None]
    return sums[low] * (1 - part) + sums[high] * part


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over each target cell's area, whole and partial samples weighed by area, as float64.

    The integral image is built a block of rows at a time, and only its values at cell edges are kept.
    """
    height, width = image.shape
    x_edges = np.linspace(0, width, columns + 1)
    y_edges = np.linspace(0, height, rows + 1)
    out = np.zeros((rows + 1, columns + 1))
    base = np.zeros(columns + 1)
    step = max(1, BLOCK // max(width, 1))
    for top in range(0, height, step):
        block = image[top : top + step].astype(np.int64)
        across = np.zeros((width + 1, len(block)), np.int64)
        np.cumsum(block.T, axis=0, out=across[1:])
        kept = _at_edges(across, x_edges).T
        down = np.vstack([base, base + np.cumsum(kept, axis=0)])
        here = (y_edges >= top) & (y_edges <= top + len(block))
        out[here] = _at_edges(down, y_edges[here] - top)
        base = down[-1]
    return np.diff(np.diff(out, axis=0), axis=1) / (height / rows * width / columns)


def _grey(image: np.ndarray) -> np.ndarray:
    """Colours as the whole part of their mean."""
    return image if image.ndim == 2 else (image.sum(axis=2, dtype=np.int64) // 3).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in 16 hex digits: whether each of 8 x 9 area means is less than its right neighbour."""
    grey = _grey(image)
    small = np.round(area_resize(grey, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side, in NPY format."""
    grey = _grey(image)
    out = io.BytesIO()
    np.save(out, np.round(area_resize(grey, side, side)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def _shown(text):
    """UTF-8 bytes of a text, zero-filled to a positive multiple of 64, and the number of rows of 64 samples."""
    height = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / WIDTH)).cast("int")
    return F.rpad(F.encode(text, "UTF-8"), height * WIDTH, F.unhex(F.lit("00"))), height


def pgm_column(text):
    """A binary column with the text's bytes as a PGM 64 wide."""
    payload, height = _shown(text)
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{WIDTH} "), height.cast("string"), F.lit("\n255\n")), "UTF-8"), payload)


def bmp_column(text):
    """The same as an 8-bit BMP with a grey palette, its rows from top to bottom (which a negative height says)."""
    payload, height = _shown(text)

    def le(value):
        digits = F.right(F.hex(value.cast("long")), F.lit(8))
        digits = F.lpad(digits, 8, "0")
        return F.unhex(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]))

    def fixed(data: bytes):
        return F.unhex(F.lit(data.hex()))

    start = 14 + 40 + 1024
    palette = b"".join(bytes([k, k, k, 0]) for k in range(256))
    sizes = (F.lit(start) + height * WIDTH, height * WIDTH)
    return F.concat(
        fixed(b"BM"), le(sizes[0]), fixed(struct.pack("<HHIIi", 0, 0, start, 40, WIDTH)), le(-height), fixed(struct.pack("<HHI", 1, 8, 0)), le(sizes[1]), fixed(struct.pack("<iiII", 0, 0, 256, 0) + palette), payload
    )


def media_features(media: DataFrame, tile: bool = True) -> DataFrame:
    """Decode the binary column ``media`` of rows (other columns, media) and add features.

    Adds payload_bytes, payload_sha256, tail_crc32, feature (difference hash), error and, unless told not to, tile (NPY bytes); other columns stay, but
    for those of these names, which are replaced. A null or unreadable image has nulls and the reason in ``error``. Row order and count stay.
    """
    new = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("feature", "string"), ("error", "string")] + ([("tile", "binary")] if tile else [])
    names = [n for n, _ in new]
    fields = [f for f in media.schema.fields if f.name != "media" and f.name not in names]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def of_one(data) -> tuple:
        try:
            if data is None:
                raise ValueError("no image")
            image = decode_image(data)
            payload = np.ascontiguousarray(image).reshape(-1)
            row = (payload.size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), difference_hash(image), None)
            return (*row, npy_tile(image)) if tile else row
        except (ValueError, IndexError, struct.error) as e:
            return (None, None, None, None, str(e)) + ((None,) if tile else ())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_by_bytes(batch, batch.num_columns - 1):
                rows = [of_one(x) for x in part.column(part.num_columns - 1).to_pylist()]
                added = [pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *added], [f.name for f in fields] + names)

    schema = T.StructType(list(fields))
    for name, kind in new:
        schema = schema.add(name, kind)
    return media.select(*[F.col(f"`{f.name}`") for f in fields], "media").mapInArrow(decode, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Store each text of (doc_id, text) as an image and read it back.

    Returns doc_id, n_bytes, media_bytes, media_sha256 and what ``media_features`` adds. Half of the texts, by a bit of their checksum, become PGM
    images and the others BMP. A null text is stored as the empty one: one row of 64 zero samples. Equal texts give equal values; rows that
    repeat stay; an empty table gives an empty result; other columns are ignored.
    """
    text = text_or_empty()
    stored = F.when(F.crc32(F.encode(text, "UTF-8")) % 2 == 0, pgm_column(text)).otherwise(bmp_column(text))
    media = docs.select(F.col("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), stored.alias("media"))
    media = media.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return media_features(media)


def op2_netpbm_media(spark, sf_dir: str) -> DataFrame:
    out = text_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))
