"""Media columns: texts stored as lossless WebP images and read back.

The UTF-8 bytes of a text, filled up with bytes 255 to a positive multiple of 576, are
the pixels of an image of 144 columns (four bytes a pixel). Images of 256 colours or
less have a palette; others have the predictor, cross-colour and subtract-green
transforms. What repeats is stored as back-references. Features are computed from the
decoded pixels.

Results for special cases: null and empty texts give one row of 255s; equal texts have
equal results; a null doc_id is passed on; further columns are ignored; texts of any
length are stored whole: a side may have 16,384 pixels, so longer images get wider, or
are stored as several files one after the other if no width divides them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftloom.llm import webp
from driftloom.llm.common import over_texts, texts_of

UNIT, COLUMNS, SIDE = 576, 144, 1 << 14


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8")
    return raw + b"\xff" * (UNIT - len(raw) if len(raw) <= UNIT else -len(raw) % UNIT), len(raw)


def shape_of(payload: bytes) -> tuple[int, int]:
    """Height and width of the whole image, which may be higher than a file's may be."""
    rows = len(payload) // (4 * COLUMNS)
    # images side by side where there are too many rows
    wide = next((w for w in range(-(-rows // SIDE), SIDE // COLUMNS + 1) if rows % w == 0), 1)
    return rows // wide, COLUMNS * wide


def images_of(payload: bytes) -> list[np.ndarray]:
    image = np.frombuffer(payload, "<u4").astype(np.int64).reshape(shape_of(payload))
    return [image[k : k + SIDE] for k in range(0, len(image), SIDE)]


def store(payload: bytes) -> bytes:
    return b"".join(map(stored_image, images_of(payload)))


def stored_image(image: np.ndarray) -> bytes:
    few = len(np.unique(image.reshape(-1)[:1024])) <= 256  # if not, the whole has more too
    if few and len(np.unique(image)) <= 256:
        return webp.encode(image, transforms=(webp.PALETTE,))
    return webp.encode(image)


def load(stored: bytes) -> bytes:
    parts, at = [], 0
    while at < len(stored):
        end = at + 8 + int.from_bytes(stored[at + 4 : at + 8], "little")
        parts.append(webp.decode(stored[at:end]).astype("<u4").tobytes())
        at = end
    return b"".join(parts)


def feature_of(payload: bytes) -> str:
    """Width and height, mean and spread of the samples in thousandths, their entropy in
    thousandths of a bit, and a hash of which of 64 parts are lighter than the mean."""
    height, width = shape_of(payload)
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    mean, spread = float(x.mean()), float(x.std())
    at = np.arange(64) * len(x) // 64
    light = np.add.reduceat(x, at, dtype=np.int64) > mean * np.diff(at, append=len(x))
    hashed = np.packbits(light).tobytes().hex()
    return f"{width}x{height}:{round(mean * 1000)}:{round(spread * 1000)}:{round(float(-(p * np.log2(p)).sum()) * 1000)}:{hashed}"


def media(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """A row for each document: sizes and digests of what was stored and read back, and
    with ``keep_bytes`` the image itself."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for text in texts_of(batch):
                payload, n = payload_of(text)
                stored = store(payload)
                back = load(stored)
                row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(back), stored)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            n = 8 if keep_bytes else 7
            arrays = [pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=NAMES[: n + 1])

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if keep_bytes else "")
    return over_texts(docs.select("doc_id", "text"), make, schema)


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
