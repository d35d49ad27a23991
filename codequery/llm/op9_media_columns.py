"""Media columns: progressive JPEG decoded into full-resolution RGB tensors, and bytes kept losslessly in such files.

See jpeg.py for the codec. decode() turns a column of JPEG files into tensors; archive() stores any bytes as the
quantised coefficients of a progressive file (the format's lossless unit), and the query reads them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import table

UNIT = 64
GROUP_BYTES = 2 << 20
#: Files that declare more are not decoded: a few bytes can claim 65,535 squared.
MAX_PIXELS = 1 << 26


def padded(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def groups(sizes: list[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about the limit; a longer row is a run of its own."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def feature(tensor: np.ndarray) -> str:
    """Height, width, mean of each channel and CRC of an RGB tensor."""
    means = tensor.reshape(-1, 3).sum(0, dtype=np.int64) / max(1, tensor.size // 3)
    return f"{tensor.shape[0]}x{tensor.shape[1]}:{means[0]:.3f},{means[1]:.3f},{means[2]:.3f}:{zlib.crc32(tensor.tobytes()):08x}"


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column(1).to_pylist()
        rows: list[tuple] = []
        for a, b in groups([len(f or b"") for f in files]):
            for i in range(a, b):
                try:
                    picture = jpeg.parse(files[i] or b"")
                    if picture.height * picture.width > MAX_PIXELS or len(picture.components) not in (1, 3):
                        raise ValueError("too large, or no grey or YCbCr picture")
                    tensor = jpeg.rgb(picture, jpeg.coefficients([picture])[0])
                    rows.append((*tensor.shape[:2], tensor.tobytes()))
                except (ValueError, LookupError, OverflowError, TypeError, struct.error):  # whatever a broken file makes the reader do
                    rows.append((None, None, None))
        kinds = (pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["id", "height", "width", "rgb"])


def decode(files: DataFrame, key: str, data: str) -> DataFrame:
    """(id, height, width, rgb binary of height x width x 3): null tensors for null and broken files, for those
    that declare more than MAX_PIXELS, and for pictures of other than one or three components."""
    return files.select(F.col(key).cast("long").alias("id"), F.col(data).alias("data")).mapInArrow(_decoded, "id long, height int, width int, rgb binary")


def _archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).to_pylist()]
        for a, b in groups([len(t) for t in texts]):
            files = jpeg.encode([padded(t) for t in texts[a:b]])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])


def archive(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded, as a progressive JPEG file."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("data")).mapInArrow(_archived, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = batch.column(2).to_pylist()
        for a, b in groups([len(f) for f in files]):
            pictures = [jpeg.parse(f) for f in files[a:b]]
            coefs = jpeg.coefficients(pictures)
            columns: list[list] = [[] for _ in range(6)]
            for file, picture, coef, tensor in zip(files[a:b], pictures, coefs, jpeg.rgb_all(pictures, coefs), strict=True):
                payload = coef[: int(picture.comment)].astype(np.int8).tobytes()
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(tensor))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *map(pa.array, columns)], [f.split()[0] for f in DIGEST.split(", ")])


def digest(archived: DataFrame) -> DataFrame:
    """DIGEST of what the stored files hold when read back.

    Null texts are empty; every row gives one row, ids may be null or repeat; a text of any length is one file
    of its own; no rows give no rows. Other columns are not read.
    """
    return archived.mapInArrow(_digest, DIGEST)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of all documents' archives; see there for nulls, repeats and empty tables."""
    return digest(archive(table(spark, sf_dir, "documents")))
