"""Exact dedup with an index of cuckoo filters that follows insertions and deletions.

Texts are equal when they are identical without `[\\x20\\x09-\\x0D]`. The index is a table of live digests (SHA-256 of
the text without those characters), dealt over shards by digest. A shard's task holds a cuckoo filter: buckets of four
16-bit fingerprints, each digest in one of two buckets. A digest that the filter doesn't know is new and is inserted; one
that it may know is compared with the stored digests of the two buckets, so a false hit costs one comparison and never
merges texts. When an insertion runs out of moves, the filter is built again, twice as large, from the stored digests.
Deleting a document lowers its digest's count; the last one takes the digest and its fingerprint out again.

Of equal texts the row with the most code points stays, then the smallest doc_id (null last). Null texts count as empty
and equal each other. Repeated rows are members of their group; if rows share that doc_id, all of them carry
`kept`. An empty table gives an empty result. Columns beyond doc_id and text are ignored.

Scale: texts never leave their scan. Digests are combined inside each scan task first, so a text that makes up a third of
the table arrives as one row for each batch. A shard holds its digests only; the number of shards follows the row count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traincover.llm.base import SPACE
from traincover.session import stage

SHARD_ROWS = 250_000
_SLOTS = 4
_MOVES = 200

ENTRY = "text_sha256 string, group_size long, keep_chars long, keep_id long"


class CuckooFilter:
    """Fingerprints of digests with the key number that each slot stands for; keys themselves stay outside."""

    def __init__(self, buckets: int = 256):
        self.mask = buckets - 1
        self.slots: list[list[tuple[int, int]]] = [[] for _ in range(buckets)]

    @staticmethod
    def fingerprint(digest: str) -> int:
        return int(digest[16:20], 16) | 1 << 16

    def places(self, digest: str) -> tuple[int, int]:
        first = int(digest[:15], 16) & self.mask
        return first, self.other(first, self.fingerprint(digest))

    def other(self, bucket: int, fingerprint: int) -> int:
        """The second bucket of a fingerprint: the same function leads back."""
        return (bucket ^ fingerprint * 0x5BD1E995) & self.mask

    def candidates(self, digest: str) -> list[int]:
        """Numbers of the keys that the digest may equal; empty: it is certainly not there."""
        fingerprint = self.fingerprint(digest)
        first, second = self.places(digest)
        found = [key for f, key in self.slots[first] if f == fingerprint]
        if second != first:
            found += [key for f, key in self.slots[second] if f == fingerprint]
        return found

    def insert(self, digest: str, key: int) -> bool:
        """False when no slot could be freed: the filter has then lost one entry and must be built again."""
        item, (first, second) = (self.fingerprint(digest), key), self.places(digest)
        bucket = first if len(self.slots[first]) <= len(self.slots[second]) else second
        for move in range(_MOVES):
            held = self.slots[bucket]
            if len(held) < _SLOTS:
                held.append(item)
                return True
            turn = move % _SLOTS
            item, held[turn] = held[turn], item
            bucket = self.other(bucket, item[0])
        return False

    def delete(self, digest: str, key: int) -> None:
        item = (self.fingerprint(digest), key)
        for bucket in self.places(digest):
            if item in self.slots[bucket]:
                self.slots[bucket].remove(item)
                return


class Shard:
    """The live digests of one shard behind a filter."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.digests: list[str | None] = []
        self.counts: list[int] = []
        self.best: list[tuple[int, float]] = []  # (-code points, doc_id): the smallest stays

    def find(self, digest: str) -> int | None:
        for key in self.filter.candidates(digest):
            if self.digests[key] == digest:
                return key
        return None

    def insert(self, digest: str, count: int, best: tuple[int, float]) -> None:
        key = self.find(digest)
        if key is not None:
            self.counts[key] += count
            self.best[key] = min(self.best[key], best)
            return
        self.digests.append(digest)
        self.counts.append(count)
        self.best.append(best)
        if not self.filter.insert(digest, len(self.digests) - 1):
            self._resize()

    def delete(self, digest: str, count: int) -> None:
        key = self.find(digest)
        if key is None:
            return
        self.counts[key] -= count
        if self.counts[key] <= 0:
            self.filter.delete(digest, key)
            self.digests[key] = None

    def _resize(self) -> None:
        buckets = len(self.filter.slots)
        while True:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            if all(self.filter.insert(d, i) for i, d in enumerate(self.digests) if d is not None):
                return

    def entries(self) -> Iterator[pa.RecordBatch]:
        live = [i for i, d in enumerate(self.digests) if d is not None]
        for start in range(0, len(live), 50_000):
            some = live[start: start + 50_000]
            yield pa.RecordBatch.from_arrays([
                pa.array([self.digests[i] for i in some]),
                pa.array([self.counts[i] for i in some], pa.int64()),
                pa.array([-self.best[i][0] for i in some], pa.int64()),
                pa.array([None if self.best[i][1] == np.inf else self.best[i][1] for i in some], pa.int64()),
            ], names=["text_sha256", "group_size", "keep_chars", "keep_id"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of the text without white space, n_points of the text itself."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.regexp_replace(text, SPACE, "").cast("binary"), 256).alias("text_sha256"),
        F.length(text).cast("long").alias("n_points"),
    )


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of a batch in one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        order = pc.sort_indices(batch, sort_keys=[("text_sha256", "ascending"), ("keep_chars", "descending"), ("keep_id", "ascending")])
        batch = batch.take(order)
        text = batch.column("text_sha256")
        first = np.ones(len(text), bool)
        first[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(first)
        total = np.add.reduceat(batch.column("group_size").to_numpy(), starts)
        kept = batch.take(pa.array(starts))
        yield pa.RecordBatch.from_arrays(
            [kept.column("text_sha256"), pa.array(total, pa.int64()), kept.column("keep_chars"), kept.column("keep_id")],
            names=["text_sha256", "group_size", "keep_chars", "keep_id"],
        )


def _dealt(entries: DataFrame, shards: int) -> DataFrame:
    return entries.repartition(shards, F.substring("text_sha256", 21, 8))


def _rows(batch: pa.RecordBatch):
    ids = batch.column("keep_id").to_pylist()
    best = zip((-n for n in batch.column("keep_chars").to_pylist()), (np.inf if i is None else i for i in ids))
    return zip(batch.column("text_sha256").to_pylist(), batch.column("group_size").to_pylist(), best)


def _entries(found: DataFrame) -> DataFrame:
    one = found.select("text_sha256", F.lit(1).cast("long").alias("group_size"), F.col("n_points").alias("keep_chars"), F.col("doc_id").alias("keep_id"))
    return one.mapInArrow(_combined, ENTRY)


def shards_for(rows: int) -> int:
    return max(1, -(-rows // SHARD_ROWS)) * 4


def insert(index: DataFrame | None, found: DataFrame, shards: int) -> DataFrame:
    """The index after inserting rows of `digests`; None is the empty index."""
    entries = _entries(found)
    if index is not None:
        entries = index.select("text_sha256", "group_size", "keep_chars", "keep_id").unionByName(entries)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for digest, count, best in _rows(batch):
                shard.insert(digest, count, best)
        yield from shard.entries()

    return _dealt(entries, shards).mapInArrow(fill, ENTRY)


def delete(index: DataFrame, gone: DataFrame, left: DataFrame, shards: int) -> DataFrame:
    """The index after deleting the rows `gone`. `left`: `digests` of the documents that remain, among which a new
    one is chosen to stay where the old one was deleted."""
    minus = _entries(gone).withColumn("group_size", -F.col("group_size"))
    both = index.select("text_sha256", "group_size", "keep_chars", "keep_id").unionByName(minus)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = Shard(), []
        for batch in batches:
            for digest, count, best in _rows(batch):
                if count > 0:
                    shard.insert(digest, count, best)
                else:
                    waiting.append((digest, -count))
        for digest, count in waiting:
            shard.delete(digest, count)
        yield from shard.entries()

    changed = stage(_dealt(both, shards).mapInArrow(apply, ENTRY), "cuckoo-deleted")
    touched = gone.select("text_sha256").distinct()
    again = insert(None, left.join(touched, "text_sha256", "left_semi"), shards)
    same = changed.join(touched, "text_sha256", "left_anti")
    return same.unionByName(again)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`."""
    found = stage(digests(docs), "digests")
    index = insert(None, found, shards_for(found.count()))
    # Digests of one document only need no partner; the join below carries all of them, as one row each.
    joined = found.join(index, "text_sha256")
    return joined.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
    )
