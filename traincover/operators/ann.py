"""Approximate top-k: vectors are grouped into cells, a query looks only into the cells nearest to it.

Scores of what it finds are exact. Recall depends on the data: measure it with `recall`, never assume it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traincover.functions.vectors import is_finite
from traincover.operators import topk
from traincover.session import stage

# Centres are broadcast, so their number is bounded.
MAX_CELLS = 16_384


@dataclass(frozen=True)
class CellIndex:
    """Cell centres, one per row, and optionally each cell's covering radius (for exact search)."""

    centres: np.ndarray
    radii: np.ndarray | None = None


def fit_cells(vectors: DataFrame, cells: int, seed: int = 0) -> CellIndex:
    """Find cell centres for a corpus (column `embedding`), from all its finite vectors."""
    if not 0 < cells <= MAX_CELLS:
        raise ValueError(f"cells must be in 1..{MAX_CELLS}")
    rows = vectors.select(array_to_vector("embedding").alias("features")).where(is_finite(F.col("embedding")))
    # The block solver fails where the data yield fewer centres than asked for.
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10, solver="row").fit(rows).clusterCenters())
    return CellIndex(centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12))


def nearest_cells(rows: DataFrame, index: CellIndex, nprobe: int) -> DataFrame:
    """Add `cells`: the `nprobe` cells whose centres have the largest inner product with `embedding`."""
    shared = rows.sparkSession.sparkContext.broadcast(index.centres.T.copy())
    count = min(nprobe, len(index.centres))
    schema = T.StructType([*rows.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    at = rows.columns.index("embedding")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            near = np.zeros((0, count), dtype=np.int32)
            if batch.num_rows:
                matrix = topk.to_matrix(batch.column(at)).astype(np.float64)
                step = max(1, topk.PAIR_CELLS // centres.shape[1])  # bounds one score matrix
                near = np.concatenate([
                    np.argsort(-(matrix[i: i + step] @ centres), axis=1, kind="stable")[:, :count].astype(np.int32)
                    for i in range(0, len(matrix), step)
                ])
            ends = np.arange(len(near) + 1, dtype=np.int32) * count
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[*batch.schema.names, "cells"])

    return rows.mapInArrow(assign, schema)


def house(vectors: DataFrame, index: CellIndex) -> DataFrame:
    """Add `cell`, the cell of each vector. Store the result sorted or partitioned by it: searches then reuse the
    assignment and skip what no query probes."""
    housed = nearest_cells(vectors.where(is_finite(F.col("embedding"))), index, 1)
    return housed.withColumn("cell", F.get("cells", F.lit(0))).drop("cells")


def approximate_topk(
    queries: DataFrame, corpus: DataFrame, k: int, index: CellIndex, nprobe: int = 8
) -> DataFrame:
    """As `topk.topk`, but each query meets only the corpus rows of its `nprobe` nearest cells.

    A corpus without the column `cell` is housed first. A cell with many rows is cut into fragments and a cell that many queries probe into chunks, so a cell holding a
    third of the corpus runs as many tasks as its size calls for.
    """
    queries, housed = _usable(queries, corpus, index)
    probes = nearest_cells(queries, index, nprobe).select("sample_id", "embedding", F.explode("cells").alias("cell"))
    return topk.final_ranking(_probed_partials(queries, probes, housed, k), k)


def _usable(queries: DataFrame, corpus: DataFrame, index: CellIndex) -> tuple[DataFrame, DataFrame]:
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    queries = queries.select("sample_id", vector).where(is_finite(F.col("embedding")))
    if "cell" not in corpus.columns:
        corpus = house(corpus.select("version_pos", "index_id", vector), index)
    return queries, corpus.select("version_pos", "index_id", vector, "cell").where(is_finite(F.col("embedding")))


def _probed_partials(queries: DataFrame, probes: DataFrame, housed: DataFrame, k: int) -> DataFrame:
    """Partial results of every (sample_id, embedding, cell) probe against the housed rows of its cell."""
    # One row per probed cell (at most MAX_CELLS): how many chunks it needs. Only probed cells of the corpus are read;
    # where the corpus is stored by cell (`sources.vectors.write_cells`) the others' folders are pruned.
    probed = probes.groupBy("cell").agg(F.ceil(F.count("*") / topk.CHUNK_QUERIES).cast("int").alias("chunks")).collect()
    housed = housed.where(F.col("cell").isin([row.cell for row in probed]))
    chunks = queries.sparkSession.createDataFrame(probed, "cell int, chunks int")
    fragments = housed.groupBy("cell").agg(F.ceil(F.count("*") / topk.FRAGMENT_ROWS).cast("int").alias("fragments"))
    sizes = F.broadcast(chunks.join(fragments, "cell"))

    def copies(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = (
        probes.join(sizes, "cell")
        .withColumn("chunk", F.pmod(F.xxhash64("sample_id"), F.col("chunks")).cast("int"))
        .withColumn("fragment", copies("fragments"))
    )
    right = (
        housed.join(sizes, "cell")
        .withColumn("fragment", F.pmod(F.xxhash64("version_pos", "index_id"), F.col("fragments")).cast("int"))
        .withColumn("chunk", copies("chunks"))
    )
    return topk.block_partials(left, right, k, topk._partial_schema(queries))


def cell_radii(housed: DataFrame, index: CellIndex) -> np.ndarray:
    """Covering radius of each cell: the greatest distance of its vectors (`embedding`, `cell`) to its centre; 0 for an
    empty cell. One row per cell reaches the driver."""
    spark = housed.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centres)], "cell int, centre array<double>")
    v = F.col("embedding").cast("array<double>")
    squares = F.zip_with(v, F.col("centre"), lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    found = housed.where(is_finite(F.col("embedding"))).join(F.broadcast(centres), "cell").groupBy("cell").agg(
        F.max(distance).alias("radius")
    ).collect()
    radii = np.zeros(len(index.centres))
    for row in found:
        radii[row.cell] = row.radius
    return radii


# Bounds are widened by this share of their terms (and a little more): float scores never fall outside them.
_BOUND_SLACK = 1e-5


def _further_cells(queries: DataFrame, index: CellIndex, nprobe: int) -> DataFrame:
    """(sample_id, embedding, cell) for every cell beyond a query's `nprobe` nearest whose bound q.c + |q| r reaches the
    query's `kth` score (all of them where `kth` is null: fewer than k were found)."""
    shared = queries.sparkSession.sparkContext.broadcast((index.centres.T.copy(), np.asarray(index.radii, float)))
    schema = T.StructType([queries.schema["sample_id"], queries.schema["embedding"], T.StructField("cell", T.IntegerType())])

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii = shared.value
        norms = np.linalg.norm(centres, axis=0)
        for batch in batches:
            if not batch.num_rows:
                continue
            matrix = topk.to_matrix(batch.column("embedding")).astype(np.float64)
            kth = batch.column("kth").to_numpy(zero_copy_only=False)
            take, cells = [], []
            for i, q in enumerate(matrix):
                near = q @ centres
                order = np.argsort(-near, kind="stable")[nprobe:]
                length = np.linalg.norm(q)
                bound = near[order] + length * radii[order] + _BOUND_SLACK * (np.abs(near[order]) + length * (norms[order] + radii[order]) + 1)
                kept = order if np.isnan(kth[i]) else order[bound >= kth[i]]
                take += [i] * len(kept)
                cells += kept.tolist()
            index_of = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("sample_id").take(index_of), batch.column("embedding").take(index_of), pa.array(cells, pa.int32())],
                names=["sample_id", "embedding", "cell"],
            )

    return queries.mapInArrow(further, schema)


def exact_topk(queries: DataFrame, corpus: DataFrame, k: int, index: CellIndex, nprobe: int = 8) -> DataFrame:
    """As `topk.topk`, exactly, reading only cells that can hold a winner.

    First the `nprobe` nearest cells of each query; the k-th score found there is a lower bound of the true one. Then
    every other cell whose upper bound q.c + |q| r (r: its covering radius, `index.radii`) reaches it, ties included.
    Exact at any `nprobe`; the better the cells, the fewer are read the second time.
    """
    if index.radii is None:
        raise ValueError("exact search through cells needs their radii (cell_radii)")
    queries, housed = _usable(queries, corpus, index)
    housed = stage(housed, "cells-housed")
    first = stage(approximate_topk(queries, housed, k, index, nprobe), "cells-first")
    found = first.groupBy("sample_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    kth = F.when(F.col("n") >= k, F.col("least")).cast("double").alias("kth")
    asked = queries.join(found.select("sample_id", kth), "sample_id", "left")
    second = _probed_partials(queries, _further_cells(asked, index, nprobe), housed, k)
    return topk.final_ranking(first.drop("rank").unionByName(second), k)


def load_index(spark, root: str, version: str | None = None) -> tuple[CellIndex, DataFrame]:
    """A stored cell index: its centres and its vectors by cell, ready for `approximate_topk` or `search(index=...)`."""
    from traincover.sources.vectors import read_cells

    centres, radii, vectors = read_cells(spark, root, version)
    return CellIndex(centres, radii), vectors


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall): the share of exactly ranked ids that the approximate search found too."""
    key = ["sample_id", "version_pos", "index_id"]
    flagged = exact.select(*key).join(found.select(*key).withColumn("hit", F.lit(1)), key, "left")
    return flagged.agg(
        F.count("*").alias("n_exact"),
        F.count("hit").alias("n_found"),
        (F.count("hit") / F.greatest(F.count("*"), F.lit(1))).alias("recall"),
    )
