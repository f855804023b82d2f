"""Embedding jobs. Encoders are plug-ins; they are shipped once per worker process."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traincover.sources.tars import BATCH_BYTES, MemberReader

# Items handed to an encoder at a time.
IMAGE_BATCH, TEXT_BATCH = 32, 128
# Rows and bytes of text that a task embeds before it hands on their vectors, however large an Arrow batch is.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20


class Encoder(Protocol):
    """Picklable. Load heavy state on first use: the object stays alive in its worker across tasks."""

    dim: int

    def encode(self, items: list) -> np.ndarray:
        """(n, dim) for n texts or n image byte strings; a row with a NaN marks an item it cannot encode."""


class _Buckets(dict):
    """Token to bucket, filled on demand and emptied when it grows too large. Long tokens, rarely met again, stay out."""

    LIMIT, LONGEST = 1 << 16, 64

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __reduce__(self):
        return _Buckets, (self.dim,)

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(token.encode("utf-8"), usedforsecurity=False).digest()
        bucket = int.from_bytes(digest[:2], "big") % self.dim
        if len(token) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[token] = bucket
        return bucket


class HashedTokenEncoder:
    """Bag-of-words text vectors: tokens counted in md5 buckets.

    Tokens are the white-space-separated words of the lower-cased text, all of them. The bucket is the number in the
    first four hex digits of the md5, modulo `dim`.
    """

    def __init__(self, dim: int = 1024):
        self.dim = dim
        self._buckets = _Buckets(dim)

    def encode(self, items: list) -> np.ndarray:
        counts = np.zeros((len(items), self.dim), dtype=np.float32)
        for row, text in enumerate(items):
            tokens = list(map(self._buckets.__getitem__, text.lower().split()))
            if tokens:
                counts[row] = np.bincount(tokens, minlength=self.dim)
        return counts


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length, single precision."""
    matrix = np.asarray(matrix, dtype=np.float64)
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return (matrix / np.maximum(lengths, 1e-12)).astype(np.float32)


def _vector_column(matrix: np.ndarray, rows: np.ndarray, total: int) -> pa.Array:
    """A list column of `total` rows with the vectors at `rows`, NULL elsewhere and for NaN vectors."""
    good = np.isfinite(matrix).all(axis=1)
    matrix, rows = matrix[good], rows[good]
    present = np.zeros(total, dtype=bool)
    present[rows] = True
    ends = np.concatenate([[0], np.cumsum(present)]).astype(np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel()), mask=pa.array(~present)
    )


_IN_WORKER: dict[str, Encoder] = {}


def _ship(rows: DataFrame, encoder: Encoder):
    """A function that gives tasks their worker's copy of the encoder, unpacked once per worker process."""
    packed, key = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(encoder)), uuid.uuid4().hex

    def unpack() -> Encoder:
        if key not in _IN_WORKER:
            while len(_IN_WORKER) >= 4:  # an image and a text encoder, of this job and the last
                _IN_WORKER.pop(next(iter(_IN_WORKER)))
            _IN_WORKER[key] = cloudpickle.loads(packed.value)
        return _IN_WORKER[key]

    return unpack


def _with_vectors(rows: DataFrame, out: str) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])


def _encode(encoder: Encoder, items: list, step: int) -> np.ndarray:
    """Unit vectors of any number of items, `step` at a time."""
    parts = [unit_rows(encoder.encode(items[at:at + step])) for at in range(0, len(items), step)]
    return np.concatenate(parts) if parts else np.zeros((0, encoder.dim), np.float32)


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices bounded by number and by bytes of the texts in column `at`; nothing is copied."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            fitting = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1
            end = min(max(fitting, start + 1), start + SLICE_ROWS, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def embed_texts(
    rows: DataFrame, encoder: Encoder, text: str = "text", out: str = "embedding", batch_size: int = TEXT_BATCH,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add the unit vector of each text; NULL and empty texts get NULL. Filter blank texts before this call.

    A task holds the vectors of one slice of its rows, not of a whole Arrow batch. A text repeated within a slice is
    encoded once; that needs no shuffle and a text that half the rows share costs next to nothing. `profile` asks for executors with GPUs, for encoders that want them.
    """
    unpack = _ship(rows, encoder)
    at = rows.columns.index(text)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unpack()
        for batch in _slices(batches, at):
            texts = batch.column(at).to_pylist()
            slots = {t: i for i, t in enumerate(dict.fromkeys(t for t in texts if t))}
            filled = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
            vectors = _encode(encoder, list(slots), batch_size)
            matrix = vectors[[slots[texts[i]] for i in filled]]
            column = _vector_column(matrix, filled, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return rows.mapInArrow(embed, _with_vectors(rows, out), profile=profile)


def embed_images(
    rows: DataFrame, encoder: Encoder, path: str = "image_path", out: str = "embedding",
    batch_size: int = IMAGE_BATCH, profile: ResourceProfile | None = None,
) -> DataFrame:
    """Add the unit vector of the image behind each path; NULL where it cannot be read or encoded.

    Bytes are read and encoded in one task, in steps bounded by number and bytes: they never enter the JVM.
    """
    unpack = _ship(rows, encoder)

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, reader = unpack(), MemberReader()
        for batch in batches:
            found, vectors, waiting, held = [], [], [], 0
            for row, data in enumerate(reader.read_batch(batch, path)):
                if data:
                    found.append(row)
                    waiting.append(data)
                    held += len(data)
                if len(waiting) >= batch_size or held >= BATCH_BYTES:
                    vectors.append(_encode(encoder, waiting, batch_size))
                    waiting, held = [], 0
            vectors.append(_encode(encoder, waiting, batch_size))
            column = _vector_column(np.concatenate(vectors), np.array(found, dtype=np.int64), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return rows.mapInArrow(embed, _with_vectors(rows, out), profile=profile)


def version_vectors(samples: DataFrame, modality: str, embedded: str = "embedding") -> DataFrame:
    """Embedded samples as rows of the vector table, failed ones left out. `index_id` is added by the caller."""
    return samples.where(F.col(embedded).isNotNull()).select(
        F.col(embedded).alias("embedding"), "image_path", "text", "annotation", "source", "global_id",
        F.lit(modality).alias("modality"),
    )
