"""Hard negatives for anchors, scored exactly by Kronecker-packed integer products.

Each row has integer components floor(FACTOR x) and a label. A row's score is its inner product with the anchor. An
anchor's positives are its first `positives` other rows of its label, by score, higher first, then the smaller vec_id
(null ids last, then the row's own key). For each positive, the negatives are the first `negatives` rows of another label
whose score s lies in low * ps <= high * s <= high * ps, ps being the positive's score, in the same order.

Packing: a block of candidates becomes one wide integer per component, W_j = sum_i (c_ij + bc) 2^(F i): every candidate's
component, made non-negative by the block's bias bc, in a field of its own F bits. One anchor multiplies each W_j once by
(a_j + ba) and adds them up; field i of the sum is sum_j (a_j + ba)(c_ij + bc), which F bits hold without carry, and
dot_i = field_i - bc sum_j a_j - ba sum_j c_ij - d ba bc exactly.

Defined cases: rows whose label, vector or any component is null or non-finite take no part. Vectors of other lengths
are padded with zeros (the inner product of the common components). Rows are told apart by a key of their own: a
repeated row is a candidate of its twin, an anchor is never its own positive. Anchors without positives, and positives
without negatives in their window, give no rows. An empty table gives an empty result. Other columns are ignored.
Scores must fit in a long.

Scale: anchors go in chunks of at most about `chunk` rows; each chunk (and later its positives) is broadcast, all rows
are scanned once per pass where they lie, each task keeps only the best few per anchor across its blocks, and a ranking
by anchor merges them. Results of each chunk are appended to one staged table. No candidate row is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traincover.llm.base import smaller
from traincover.session import stage, staging_root

FACTOR = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100
CHUNK_ANCHORS = 8192
PACK_ROWS = 4096

_FOUND = "anchor_key long, anchor_id long, positive_key long, positive_id long, positive_score long, key long, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(table: DataFrame, factor: int = FACTOR) -> DataFrame:
    """row_key, vec_id, label, v (array<long>): the rows that take part, each with a key of its own."""
    v = F.col("embedding").cast("array<double>")
    ok = v.isNotNull() & F.col("label").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(ok).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x * factor).cast("long")).alias("v"),
    )
    return stage(rows.withColumn("row_key", F.monotonically_increasing_id()), "hardneg-rows")


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Block:
    """Candidates packed as one wide integer per component."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.keys = batch.column("row_key").to_numpy()
        ids = batch.column("vec_id")
        self.null_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        self.labels = batch.column("label").to_numpy()
        self.vectors = batch.column("v").to_pylist()
        self.width = max([width, *map(len, self.vectors)])
        c = _matrix(self.vectors, self.width)
        self.bias = int(np.abs(c).max()) if c.size else 0
        self.sums = c.sum(axis=1)
        self.c = c

    def packed(self, anchor_bias: int) -> tuple[list[int], int]:
        """W_j for every component, and the field width in bytes for anchors of this bias."""
        largest = self.width * (2 * anchor_bias) * (2 * self.bias)
        size = max(1, -(-largest.bit_length() // 8))
        size = 4 if size <= 4 else 8 if size <= 8 else size
        shifted = self.c + self.bias
        if size in (4, 8):
            fields = shifted.astype(f"<u{size}")
            return [int.from_bytes(fields[:, j].tobytes(), "little") for j in range(self.width)], size
        return [sum(int(x) << (8 * size * i) for i, x in enumerate(shifted[:, j])) for j in range(self.width)], size


def packed_scores(anchor: np.ndarray, anchor_bias: int, block: Block, packed: list[int], size: int) -> np.ndarray:
    """Exact inner products of one anchor with every candidate of `block`: one multiplication per component."""
    total = 0
    for j, w in enumerate(packed):
        total += int(anchor[j] + anchor_bias) * w
    n = len(block.keys)
    raw = total.to_bytes(n * size, "little")
    fixed = block.bias * int(anchor[: block.width].sum()) + block.width * anchor_bias * block.bias
    if size in (4, 8):  # arithmetic modulo 2^64 is exact for results that fit in a long
        fields = np.frombuffer(raw, f"<u{size}").astype(np.uint64)
        correction = np.uint64(fixed % (1 << 64)) + np.uint64(anchor_bias % (1 << 64)) * block.sums.astype(np.uint64)
        return (fields - correction).view(np.int64)
    fields = [int.from_bytes(raw[i * size: (i + 1) * size], "little") for i in range(n)]
    return np.array([f - fixed - anchor_bias * int(c) for f, c in zip(fields, block.sums)], np.int64)


def _best(keep: np.ndarray, scores: np.ndarray, block: Block, k: int) -> np.ndarray:
    """Positions among `keep` of the first k by score (higher first), then vec_id (nulls last), then key."""
    if len(keep) > k:
        kth = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= kth]
    order = np.lexsort((block.keys[keep], block.ids[keep], block.null_id[keep], -scores[keep]))
    return keep[order[:k]]


class Held:
    """The best rows found so far for each (anchor, positive), kept per task across blocks."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def add(self, slot: tuple, found: list[tuple]):
        held = self.rows.get(slot, []) + found
        held.sort(key=lambda r: (-r[2], r[1] is None, r[1] or 0, r[0]))
        self.rows[slot] = held[: self.k]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _FOUND.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _scan(anchors, positives, k: int):
    """A task over candidates: positives when `positives` is None, else the negatives of each known positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        held = Held(k)
        for batch in smaller(batches, PACK_ROWS):
            block = Block(batch, a["width"])
            packed, size = block.packed(a["bias"])
            matrix = a["matrix"]
            if block.width > matrix.shape[1]:
                matrix = np.pad(matrix, ((0, 0), (0, block.width - matrix.shape[1])))
            for i, key in enumerate(a["keys"]):
                scores = packed_scores(matrix[i], a["bias"], block, packed, size)
                if positives is None:
                    keep = np.flatnonzero((block.labels == a["labels"][i]) & (block.keys != key))
                    slots = [((key, a["ids"][i], None, None, None), keep)]
                else:
                    other = np.flatnonzero(block.labels != a["labels"][i])
                    slots = []
                    for p_key, p_id, ps in positives.value.get(key, []):
                        window = (LOW * ps <= HIGH * scores[other]) & (HIGH * scores[other] <= HIGH * ps)
                        slots.append(((key, a["ids"][i], p_key, p_id, ps), other[window]))
                for slot, keep in slots:
                    if len(keep):
                        top = _best(keep, scores, block, k)
                        held.add(slot, [(int(block.keys[t]), None if block.null_id[t] else int(block.ids[t]), int(scores[t])) for t in top])
        yield _batch([(*slot, *row) for slot, rows in held.rows.items() for row in rows])

    return run


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         chunk: int = CHUNK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of `vectors`.

    `vectors`: vec_id, label, embedding; `is_anchor`, an expression of the names vec_id and label (as `F.col`), picks anchors
    among the rows that take part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    anchors = rows.where(is_anchor)
    n = anchors.count()
    chunks = -(-n // chunk)
    anchors = stage(anchors.withColumn("chunk", F.pmod(F.xxhash64("row_key"), F.lit(max(chunks, 1)))), "hardneg-anchors")
    out = f"{staging_root(spark)}/traincover-staged-hardneg-{uuid.uuid4().hex}"
    context = spark.sparkContext
    written = False
    for c in range(chunks):  # each chunk is bounded; all rows are read twice for it
        got = anchors.where(F.col("chunk") == c).toArrow()
        if not got.num_rows:
            continue
        vectors_of = got["v"].to_pylist()
        width = max(map(len, vectors_of))
        matrix = _matrix(vectors_of, width)
        shared = context.broadcast({
            "keys": got["row_key"].to_pylist(), "ids": got["vec_id"].to_pylist(), "labels": got["label"].to_numpy(),
            "matrix": matrix, "bias": int(np.abs(matrix).max()) if matrix.size else 0, "width": width,
        })
        first = _ranked(rows.mapInArrow(_scan(shared, None, positives), _FOUND), ["anchor_key"], positives)
        by_anchor: dict[int, list] = {}
        for r in first.select("anchor_key", "key", "vec_id", "score").toLocalIterator():
            by_anchor.setdefault(r.anchor_key, []).append((r.key, r.vec_id, r.score))
        known = context.broadcast(by_anchor)
        second = _ranked(rows.mapInArrow(_scan(shared, known, negatives), _FOUND), ["anchor_key", "positive_key"], negatives)
        second.select(
            "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        ).write.mode("append").parquet(out)
        written = True
        shared.destroy()
        known.destroy()
    if not written:
        return spark.createDataFrame([], RESULT)
    return spark.read.schema(RESULT).parquet(out)


def query_table(table: DataFrame, anchors_every: int = 100, relabel_every: int = 7) -> DataFrame:
    """The contract's form: labels of rows whose vec_id `relabel_every` divides move on by one (mod 10)."""
    label = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % anchors_every == 0)
