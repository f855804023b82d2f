"""Consecutive numbering without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traincover.session import stage

# Offsets of up to this many blocks (about 100 bytes each) may be broadcast; more are joined by shuffle.
BROADCAST_BLOCKS = 500_000
BUCKET_ROWS = 1 << 16


def block_offsets(blocks: DataFrame, order: list[str]) -> DataFrame:
    """Rows ahead of each block, from a table of (order columns..., n): sums level by level, outer keys first.

    Every window covers one parent's children only, so no task sees the whole list of a deep order.
    """
    if len(order) == 1:
        before = Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
        return blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    outer = order[:-1]
    above = block_offsets(blocks.groupBy(*outer).agg(F.sum("n").alias("n")), outer)
    inside = Window.partitionBy(*outer).orderBy(order[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (
        inner.join(above.select(*outer, F.col("offset").alias("base")), outer)
        .withColumn("offset", F.col("base") + F.col("ahead"))
        .drop("base", "ahead")
    )


def add_offsets(rows: DataFrame, blocks: DataFrame, order: list[str], position, out: str) -> DataFrame:
    """Add `position` plus the rows in the blocks before the row's own; other block columns stay on the row."""
    offsets = stage(block_offsets(blocks, order), "offsets")
    small = offsets.count() <= BROADCAST_BLOCKS
    offsets = offsets.drop("n")
    joined = rows.join(F.broadcast(offsets) if small else offsets, order)
    return joined.withColumn(out, (F.col("offset") + position).cast("long")).drop("offset")


def mark_rows(rows: DataFrame) -> DataFrame:
    """Mark each row's place in the scan. `rows` must come straight from a scan: filters and projections only."""
    return rows.withColumn("_at", F.monotonically_increasing_id())


def marked_ids(marked: DataFrame, order: tuple[str, ...], out: str = "global_id") -> DataFrame:
    """Number marked rows from 0 by (order columns, mark).

    The last order column must tell the file splits apart. Each split is then one gapless run of marks, so a row's
    number is its distance from the run's start plus the rows in earlier splits: no row is shuffled.
    """
    order = list(order)
    blocks = marked.groupBy(*order).agg(F.count("*").alias("n"), F.min("_at").alias("_start"))
    return add_offsets(marked, blocks, order, F.col("_at") - F.col("_start"), out).drop("_at", "_start")


def scan_ids(rows: DataFrame, order: tuple[str, ...], out: str = "global_id") -> DataFrame:
    """`marked_ids` of a scan that is cheap enough to be read twice."""
    return marked_ids(mark_rows(rows), order, out)


def shard_ids(rows: DataFrame, shards: int, key: str = "global_id", out: str = "index_id") -> DataFrame:
    """Number the rows from 0 as if shard 0 of a round-robin split (key % shards) came first, then shard 1, ...

    Works in buckets of neighbouring keys, so a window never holds more than one bucket, however large a shard.
    """
    rows = rows.withColumn("_shard", F.col(key) % shards).withColumn("_bucket", F.expr(f"{key} div {BUCKET_ROWS}"))
    order = ["_shard", "_bucket"]
    in_bucket = Window.partitionBy(*order).orderBy(key)
    ranked = rows.withColumn("_pos", F.row_number().over(in_bucket) - 1)
    blocks = rows.groupBy(*order).agg(F.count("*").alias("n"))
    return add_offsets(ranked, blocks, order, F.col("_pos"), out).drop("_pos", "_shard", "_bucket")


def positions(rows: DataFrame, *order, out: str = "position") -> DataFrame:
    """Number the rows from 1 in any order: a range sort, staged, then one offset per sorted partition."""
    staged = stage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    # The upper bits hold the partition of the sort, the lower 33 the row's place in it.
    runs = staged.withColumn("_run", F.shiftright("_at", 33))
    blocks = runs.groupBy("_run").agg(F.count("*").alias("n"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return add_offsets(runs, blocks, ["_run"], place, out).drop("_at", "_run")
