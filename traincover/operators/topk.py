"""Exact top-k similarity join: for every query vector, the k corpus vectors with the largest inner product.

Few queries (the usual case: an evaluation set) are broadcast, after a check of their size, and every task runs over
its part of the corpus keeping k rows per query: the corpus is never shuffled. Too many queries for that are cut into
chunks and meet the corpus, cut into fragments, through an equi-join key; both sides of a key are bounded. Either
way a window over k rows per query and task makes the final ranking.

Order: score descending, then the version's place in the selection, then `index_id`. Scores are computed in double
precision and rounded to 9 decimals, so that the summation order of a matrix product cannot decide a tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traincover.functions.vectors import is_finite

DECIMALS = 9
# Queries are broadcast only within both bounds.
BROADCAST_QUERIES = 20_000
BROADCAST_BYTES = 128 << 20
# Result rows whose metadata is fetched by a broadcast of the ids.
BROADCAST_MATCHES = 500_000
# Cells of one similarity matrix (float32: 16 MB), and components of the corpus rows it takes (float32: 4 MB).
PAIR_CELLS = 4 << 20
BLOCK_CELLS = 1 << 20
# Sizes of the blocks that meet when the queries are too many to broadcast.
CHUNK_QUERIES = 32_768
FRAGMENT_ROWS = 500_000

_CORPUS_COLUMNS = ("version_pos", "index_id", "embedding")


def to_matrix(vectors: pa.Array) -> np.ndarray:
    """A FLOAT list column as an (n, d) matrix. All vectors must have one length."""
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) > 1 or (lengths and lengths[0] is None):
        raise ValueError(f"vectors of different lengths: {lengths}")
    width = lengths[0] if lengths else 0
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)


class RunningTopK:
    """The best k corpus rows seen so far for each row of a query matrix."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries = np.ascontiguousarray(queries, dtype=np.float32)
        self.norms = np.linalg.norm(self.queries, axis=1)
        self.k = k
        shape = (len(queries), k)
        self.scores = np.full(shape, -np.inf)
        self.places = np.zeros(shape, dtype=np.int32)
        self.ids = np.zeros(shape, dtype=np.int64)

    def absorb(self, vectors: np.ndarray, places: np.ndarray, ids: np.ndarray) -> None:
        """Take in a block of corpus rows."""
        if not len(self.queries):
            return
        rows = min(PAIR_CELLS // len(self.queries), BLOCK_CELLS // max(1, vectors.shape[1]))
        step = max(self.k, rows, 1)
        for start in range(0, len(vectors), step):
            part = slice(start, start + step)
            self._absorb(vectors[part], places[part], ids[part])

    def _absorb(self, block, places, ids) -> None:
        rough = self.queries @ block.T
        # How far a single-precision product can be off; nothing within reach of the k-th place is discarded.
        longest = float(np.linalg.norm(block, axis=1).max())
        slack = (block.shape[1] + 2) * 2.0**-23 * self.norms * longest + 10.0 ** -(DECIMALS - 1)
        floor = self.scores[:, -1] - slack
        if rough.shape[1] > self.k and np.isneginf(floor).any():
            kth = -np.partition(-rough, self.k - 1, axis=1)[:, self.k - 1]
            floor = np.maximum(floor, kth - 2 * slack)
        query, row = np.nonzero(rough >= floor[:, None])
        if not len(query):
            return
        if len(query) * 8 > rough.size:
            score = (self.queries.astype(np.float64) @ block.T.astype(np.float64))[query, row]
        else:
            score = np.empty(len(query))
            width = max(1, PAIR_CELLS // max(1, block.shape[1]))
            for at in range(0, len(query), width):
                some = slice(at, at + width)
                left, right = self.queries[query[some]], block[row[some]]
                score[some] = np.einsum("ij,ij->i", left.astype(np.float64), right.astype(np.float64))
        self._merge(query, np.round(score, DECIMALS) + 0.0, places[row], ids[row])

    def _merge(self, query, score, place, index_id) -> None:
        touched = np.unique(query)
        query = np.concatenate([np.repeat(touched, self.k), query])
        score = np.concatenate([self.scores[touched].ravel(), score])
        place = np.concatenate([self.places[touched].ravel(), place])
        index_id = np.concatenate([self.ids[touched].ravel(), index_id])
        order = np.lexsort((index_id, place, -score, query))
        sorted_query = query[order]
        first = np.searchsorted(sorted_query, touched)
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[rank < self.k]  # k rows per touched query: the old list has k itself
        shape = (len(touched), self.k)
        self.scores[touched] = score[kept].reshape(shape)
        self.places[touched] = place[kept].reshape(shape)
        self.ids[touched] = index_id[kept].reshape(shape)

    def rows(self):
        """(query row, place, id, score) of the filled entries."""
        query, slot = np.nonzero(np.isfinite(self.scores))
        return query, self.places[query, slot], self.ids[query, slot], self.scores[query, slot]


def _partial_schema(queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("sample_id", queries.schema["sample_id"].dataType),
        T.StructField("version_pos", T.IntegerType()),
        T.StructField("index_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ])


def _result(best: RunningTopK, samples: pa.Array) -> pa.RecordBatch:
    query, place, index_id, score = best.rows()
    return pa.RecordBatch.from_arrays(
        [samples.take(pa.array(query)), pa.array(place, pa.int32()), pa.array(index_id), pa.array(score)],
        names=["sample_id", "version_pos", "index_id", "score"],
    )


def _broadcast_partials(queries: pa.Table, corpus: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Map-only pass over the corpus against all queries at once."""
    context = corpus.sparkSession.sparkContext
    samples = queries["sample_id"].combine_chunks()
    shared = context.broadcast((samples, to_matrix(queries["embedding"].combine_chunks())))
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, matrix = shared.value
        best = RunningTopK(matrix, k)
        for batch in batches:
            if batch.num_rows:
                place, index_id, vectors = (batch.column(name) for name in _CORPUS_COLUMNS)
                best.absorb(to_matrix(vectors), place.to_numpy(), index_id.to_numpy())
        yield _result(best, samples)

    return corpus.mapInArrow(scan, schema)


def block_partials(queries: DataFrame, corpus: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """Partial results of queries and corpus rows that share the columns `cell`, `chunk` and `fragment`.

    The sort puts the (bounded) queries of a key before its corpus rows, which then stream through: a task holds one
    chunk of queries and one batch of corpus rows, however many rows a key has.
    """
    key = ["cell", "chunk", "fragment"]
    sample_type = queries.schema["sample_id"].dataType
    left = queries.select(
        *key, F.lit(0).alias("side"), "sample_id", F.lit(None).cast("int").alias("version_pos"),
        F.lit(None).cast("long").alias("index_id"), "embedding",
    )
    right = corpus.select(
        *key, F.lit(1).alias("side"), F.lit(None).cast(sample_type).alias("sample_id"), "version_pos", "index_id",
        "embedding",
    )
    met = left.unionByName(right).repartition(*key).sortWithinPartitions(*key, "side")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, waiting, best, samples = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(name).to_numpy() for name in [*key, "side"]])
            cuts = np.flatnonzero((np.diff(marks, axis=1) != 0).any(axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                run = batch.slice(start, end - start)
                *where, side = marks[:, start]
                if tuple(where) != current:
                    if best is not None:
                        yield _result(best, samples)
                    current, waiting, best = tuple(where), [], None
                if side == 0:
                    waiting.append(run)
                elif waiting:
                    if best is None:
                        table = pa.Table.from_batches(waiting)
                        samples = table["sample_id"].combine_chunks()
                        best = RunningTopK(to_matrix(table["embedding"].combine_chunks()), k)
                    best.absorb(
                        to_matrix(run.column("embedding")),
                        run.column("version_pos").to_numpy(), run.column("index_id").to_numpy(),
                    )
        if best is not None:
            yield _result(best, samples)

    return met.mapInArrow(scan, schema)


def _many_queries(queries: DataFrame, corpus: DataFrame, k: int, schema: T.StructType) -> DataFrame:
    """All queries against the whole corpus, block by block."""
    chunks = -(-queries.count() // CHUNK_QUERIES)
    fragments = max(1, -(-corpus.count() // FRAGMENT_ROWS))
    left = queries.select(
        "sample_id", "embedding", F.lit(0).alias("cell"),
        F.pmod(F.xxhash64("sample_id"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment"),
    )
    right = corpus.select(
        *_CORPUS_COLUMNS, F.lit(0).alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"),
        F.pmod(F.xxhash64("version_pos", "index_id"), F.lit(fragments)).cast("int").alias("fragment"),
    )
    return block_partials(left, right, k, schema)


def final_ranking(partials: DataFrame, k: int) -> DataFrame:
    """The global best k of each sample out of partial results, ranked from 1."""
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), "version_pos", "index_id")
    return partials.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(queries: DataFrame, corpus: DataFrame, k: int, broadcast_queries: int = BROADCAST_QUERIES) -> DataFrame:
    """(sample_id, rank, score, version_pos, index_id) of the best k corpus rows per query.

    `queries`: sample_id (unique), embedding. `corpus`: version_pos INT, index_id LONG, embedding. Rows without a
    vector, or with a null, NaN or infinite component, are left out on both sides.
    """
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    queries = queries.select("sample_id", vector).where(is_finite(F.col("embedding")))
    corpus = corpus.select("version_pos", "index_id", vector).where(is_finite(F.col("embedding")))
    schema = _partial_schema(queries)
    # One row over the bound proves that the queries are too many; no more than that reaches the driver.
    held = queries.limit(broadcast_queries + 1).toArrow()
    if held.num_rows <= broadcast_queries and held.nbytes <= BROADCAST_BYTES:
        partials = _broadcast_partials(held, corpus, k, schema)
    else:
        partials = _many_queries(queries, corpus, k, schema)
    return final_ranking(partials, k)
