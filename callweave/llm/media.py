"""Media columns: texts stored as JPEG images, and features of image columns.

`stored_media` adds a binary column of images that hold the texts' UTF-8 bytes, padded with spaces to a positive multiple
of 192. `features` reads a column of images: their dimensions, a thumbnail hash and, for images made here, the payload's
digests. Null texts are empty. Images that are no baseline JPEG, null ones too, get nulls.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import batches, ship, utf8

BATCH = 2 << 20


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % jpeg.UNIT or (0 if text else jpeg.UNIT))


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each of docs (doc_id, text)."""
    ship(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "t", BATCH):
            texts = b.column(1).to_pylist()
            images = jpeg.payload_images([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("t")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def _row(data: bytes, image: jpeg.Image | None, blocks: np.ndarray | None) -> tuple:
    if image is None:
        return (None,) * 3 + ((None, None) if data is None else (len(data), sha256(data).hexdigest())) + (None,) * 3
    payload = jpeg.payloads([image], [blocks])[0] if any(c.startswith(b"payload ") for c in image.comments) else None
    own = (None, None, None) if payload is None else (len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    feature = f"{image.width}x{image.height}:{jpeg.mean_hash(jpeg.thumbnail(image, blocks)):016x}"
    return (*own, len(data), sha256(data).hexdigest(), feature, image.width, image.height)


def features(media: DataFrame) -> DataFrame:
    """The columns of SCHEMA for each row of media (doc_id, n_bytes, media)."""
    ship(media.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def parsed(data: bytes | None) -> jpeg.Image | None:
        try:
            return None if data is None else jpeg.parse(data)
        except jpeg.Unsupported:
            return None

    def blocks_of(images: list[jpeg.Image]) -> list[np.ndarray | None]:
        try:
            return jpeg.coefficients(images)
        except jpeg.Unsupported:  # one is broken: each by itself
            return [blocks_of([i])[0] for i in images] if len(images) > 1 else [None]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, "media", BATCH):
            data = b.column(2).to_pylist()
            images = [parsed(d) for d in data]
            known = [i for i in images if i is not None]
            blocks = iter(blocks_of(known) if known else [])
            rows = []
            for d, image in zip(data, images, strict=True):
                own = next(blocks) if image is not None else None
                rows.append(_row(d, image if own is not None else None, own))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, SCHEMA)
