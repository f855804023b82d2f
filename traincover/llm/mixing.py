"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

The documents of a source, in the order of a keyed digest, form one stream of words; the stream is repeated, and cut
into blocks of equally many words. Slot t of the schedule takes the point frac(t * golden ratio), maps it through the
cumulative targets to a source, and the r-th slot of a source takes its r-th block. A source that the points leave
short gets its last slots at the end; its last block ends where its target does. So every source's share holds in any
stretch of the schedule, its total is its rounded target, and no document is taken more than twice.

Sizes are word counts (null text: 0). Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. The
targets share 150 % of all words by weight, but stop at twice their source's words; the excess is shared again by
weight among the others. As a formula: target = least(2 * size, level * weight) with one level for all.

Repeated rows are documents of their own; rows that share doc_id and size are interchangeable. Documents without words
are never taken. An empty table gives an empty result. Columns beyond doc_id, text and source are ignored.

Scale: positions within a source are sums per (source, digest bucket) plus a window inside a bucket, slot ranks are
sums per (source, stretch of slots) plus a window inside a stretch; so a source with most of the rows is spread over
thousands of groups. The text is read once, for its word counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traincover.llm.base import WORD
from traincover.session import stage

# The weights, the words to share over all words, and the most a document is repeated.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2

BLOCK_WORDS = 2048
# Digest buckets of a source (three hexadecimal digits), slots of a stretch, cells of the unit interval.
BUCKETS = 4096
STRETCH = 4096
CELLS = 4096


def _kept(row_key: str | None) -> list[str]:
    return [row_key] if row_key else []


def sized(docs: DataFrame, seed: str = "mix", row_key: str | None = None) -> DataFrame:
    """doc_id, source, size, shuffle key and its bucket (and `row_key`): all that mixing needs of a document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *_kept(row_key)).withColumn(
        "bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_no, weight, source_size, target, need (rounded target) out of (source, size) rows."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = per_source.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(weights, F.col("source_no") % len(WEIGHTS) + 1)
    )
    # Sources fill up in the order of size over weight. The level, were this source the first not to be full:
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(everything) - REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = F.max("level").over(everything)
    cap = (REPEATS * F.col("source_size")).cast("double")
    return (
        ranked.withColumn("level", left / F.sum("weight").over(onward))
        .withColumn("target", F.least(cap, level * F.col("weight")))
        .withColumn("need", F.floor(F.col("target") + 0.5).cast("long"))
        .drop("level")
    )


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source_no, block: which block of which source each slot takes. `sources`: what `targets` returns."""
    spark = sources.sparkSession
    total, n_sources = sources.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    n_slots = -(-total // block_words)
    order = Window.orderBy("source_no")
    taking = sources.where("need > 0").withColumn("blocks", F.ceil(F.col("need") / block_words).cast("long"))
    low = F.coalesce(F.sum("need").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) / F.lit(float(max(total, 1)))
    ranges = taking.select("source_no", "blocks", low.alias("low")).withColumn("high", F.lead("low", 1, 2.0).over(order))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    in_cells = ranges.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))

    # The fractional part of t / golden ratio, in 32-bit fixed point, so that it is exact for every t.
    points = spark.range(n_slots).select(
        F.col("id").alias("slot"), ((F.col("id") % 2**31 * 2654435769) % 2**32 / F.lit(2.0**32)).alias("point")
    ).withColumn("cell", cell(F.col("point")))
    dealt = points.join(in_cells, "cell").where("low <= point and point < high").select(
        "slot", "source_no", F.floor(F.col("slot") / STRETCH).cast("long").alias("stretch")
    )
    dealt = stage(dealt, "slots")
    earlier = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("source_no", "stretch").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("source_no", "stretch").orderBy("slot")
    ranked = (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets.select("source_no", "stretch", "offset"), ["source_no", "stretch"])
        .select("slot", "source_no", (F.col("offset") + F.col("place")).alias("block"))
    )
    got = counts.groupBy("source_no").agg(F.sum("n").alias("got"))
    short = taking.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where("got < blocks")
    added = short.select("source_no", "got", F.explode(F.sequence(F.col("got"), F.col("blocks") - 1)).alias("block"))
    # By turns, so that no two sources share a slot.
    slot = n_slots + (F.col("block") - F.col("got")) * n_sources + F.col("source_no")
    added = added.select(slot.alias("slot"), "source_no", "block")
    wanted = ranked.join(taking.select("source_no", "blocks"), "source_no").where("block < blocks").drop("blocks")
    return wanted.unionByName(added)


def _placed(docs: DataFrame, sources: DataFrame, row_key: str | None = None) -> DataFrame:
    """Where each document starts in its source's stream, with all about its source."""
    per_bucket = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = per_bucket.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
    renamed = sources.withColumnRenamed("source", "of_source")
    buckets = buckets.join(renamed, F.col("source").eqNullSafe(F.col("of_source"))).select(
        F.col("of_source"), F.col("bucket").alias("of_bucket"), "base", "source_no", "source_size", "target", "need"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *_kept(row_key)).rowsBetween(Window.unboundedPreceding, 0)
    located = docs.withColumn("upto", F.sum("size").over(inside))
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket"))
    return located.join(buckets, same).select(
        "doc_id", "source", "source_no", "size", "source_size", "target", "need",
        (F.col("base") + F.col("upto") - F.col("size")).alias("start"), *_kept(row_key),
    )


def _pieces(placed: DataFrame, block_words: int, row_key: str | None = None) -> DataFrame:
    """Each document cut at block ends, once for each time it can be taken, up to its source's target."""
    times = placed.where("size > 0").withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(REPEATS)])))
    begin = F.col("turn") * F.col("source_size") + F.col("start")
    times = times.withColumn("begin", begin).withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("need")))
    whole = lambda x: F.floor(x / block_words).cast("long")
    cut = times.where("begin < end").withColumn("block", F.explode(F.sequence(whole(F.col("begin")), whole(F.col("end") - 1))))
    first = F.greatest(F.col("begin"), F.col("block") * block_words)
    last = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    return cut.select(
        "doc_id", "source", "source_no", "size", "source_size", "target", "start", "turn", "block",
        (first - F.col("begin")).alias("from_word"), (last - first).alias("n_words"), *_kept(row_key),
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, row_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, per document).

    mixture: slot, doc_id, source, size, start, turn, from_word, n_words: the pieces of the mix; sort by slot, turn and start to read
    them in order. Per document: doc_id, source, size, source_size, target, taken; one row for each row of `docs`.
    With `row_key`, a column that tells rows apart, the mixture has it too, and it orders rows that share doc_id and size.
    """
    docs = stage(sized(docs, row_key=row_key), "sized")
    sources = stage(targets(docs), "targets")
    placed = stage(_placed(docs, sources, row_key), "placed")
    slots = schedule(sources, block_words)
    mixture = _pieces(placed, block_words, row_key).join(slots, ["source_no", "block"])
    columns = ["doc_id", "source", "size", "source_size", "target", "start"]
    untaken = placed.select(*columns, F.lit(0).cast("long").alias("n_words"), F.when(F.col("size") == 0, F.monotonically_increasing_id()).alias("empty"))
    counted = mixture.select(*columns, "n_words", F.lit(None).cast("long").alias("empty")).unionByName(untaken)
    # Documents of a source start at different places, unless they are empty.
    per_document = counted.groupBy(*columns, "empty").agg(F.sum("n_words").alias("taken")).drop("start", "empty")
    return mixture.select("slot", "doc_id", "source", "size", "start", "turn", "from_word", "n_words", *_kept(row_key)), per_document
