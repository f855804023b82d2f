"""What the operators of this subpackage share: tables, words, hashes, folds and streams of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(divisor: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo `divisor`: the folds by which rows are held out (0 for a null key)."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % divisor, F.lit(0)).cast("int")


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text with A-Z in lower case. Bytes know ASCII letters and ASCII white space only."""
    return text.lower().split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of `n` consecutive word hashes; a shorter sequence counts as one run."""
    if len(hashes) < n:
        n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        total += mix(hashes[i: len(hashes) - n + 1 + i] * _ODD[i % len(_ODD)] + np.uint64(i))
    return mix(total)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def smaller(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`, none of them empty."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
