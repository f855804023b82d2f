"""Line dedup by content-defined chunks. DataFrame functions only.

A text's lines are cut into chunks: a line starts a new one where the rolling hash of it and the two lines before is
divisible by `DIVISOR`, so boundaries follow the content and a shared passage is cut alike wherever it stands. Of chunks
of at least two lines that occur more than once in the table, the first (smallest doc_id, then place in the text) stays
and the others go, if their bytes equal those of the one that stays.

Null texts count as empty and stay empty. Rows that share doc_id and text are one document and share its fate. Null
doc_ids come first. Single-line chunks always stay, so texts of one line pass through. An empty table gives an empty
result. Columns beyond doc_id and text are ignored.

Scale: cutting is done inside each row, in time linear in its lines. Digests are counted with partial sums. Chunks meet
the repeated digests under one of `SALTS` keys for each, and what is repeated meets the bytes that stay under as many keys
as its count asks for, so a passage that a third of all documents share is dealt over many tasks. Each text of several
lines is shuffled once, to meet the list of its chunks that go. What grows with the table is never broadcast, so the plan is the
same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traincover.session import release, stage

DIVISOR = 4
LEAST_LINES = 2
# The rolling hash: a polynomial of three line hashes (28 bits of MD5 each) modulo a prime.
WINDOW, BASE, PRIME = 3, 31, 2147483647
# Keys for each repeated digest while its count is unknown; then occurrences for each key.
SALTS, ROWS_PER_KEY = 16, 2000


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def with_chunks(rows: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """`chunks`: array<struct<place, n_lines, text>> of `text`, in place of it."""
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(*others, F.split("text", "\n", -1).alias("lines"))
    rows = rows.select(*others, "lines", F.transform("lines", _line_hash).alias("hashes"))

    def is_start(i: Column) -> Column:
        rolled = sum(F.coalesce(F.get("hashes", i - 1 - k), F.lit(0)) * BASE**k for k in range(WINDOW))
        return (i == 1) | ((rolled % PRIME) % divisor == 0)

    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), is_start)
    rows = rows.select(*others, "lines", starts.alias("starts"))

    def chunk(start: Column, k: Column) -> Column:
        size = F.coalesce(F.get("starts", k + 1), F.size("lines") + 1) - start
        text = F.array_join(F.slice("lines", start, size), "\n")
        return F.struct(k.alias("place"), size.alias("n_lines"), text.alias("text"))

    return rows.select(*others, F.transform("starts", chunk).alias("chunks"))


def _occurrences(docs: DataFrame, divisor: int) -> DataFrame:
    """One row for each chunk of several lines: its digest, where it is, its bytes."""
    # The filter stands inside the generator: a condition on its rows would be copied below the cutting.
    long = F.filter("chunks", lambda c: c["n_lines"] >= LEAST_LINES)
    each = with_chunks(docs, divisor).select("doc_id", "row", F.explode(long).alias("chunk"))
    return each.select(
        F.sha2(F.col("chunk.text").cast("binary"), 256).alias("digest"),
        F.struct("doc_id", "row", "chunk.place").alias("at"), F.col("chunk.text").alias("bytes"),
    )


def line_dedup(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, n_lines, removed_lines, removed_chunks, text (what stays): one row for each row of `docs`."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    single = docs.where(~F.contains("text", F.lit("\n"))).select(
        "doc_id", F.lit(1).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("removed_lines"),
        F.lit(0).cast("long").alias("removed_chunks"), "text",
    )
    several = docs.where(F.contains("text", F.lit("\n"))).select("doc_id", F.xxhash64("text").alias("row"), "text")

    found = _occurrences(several, divisor)
    counted = found.groupBy("digest").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n"))
    repeated = stage(counted.where("first != last").select("digest", "first", "n"), "repeated")

    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = found.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int"))
    met = stage(found.join(salted.hint("merge"), ["digest", "salt"]).drop("salt"), "repeated-chunks")

    keys = F.floor(F.col("n") / ROWS_PER_KEY).cast("int")
    stays = met.where("at = first").dropDuplicates(["digest"]).select(
        F.col("digest").alias("d"), F.explode(F.sequence(F.lit(0), keys)).alias("s"), F.col("bytes").alias("stays")
    )
    others = met.where("at != first").withColumn("salt", F.pmod(F.xxhash64("at"), keys + 1).cast("int"))
    same = others.join(stays.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s"))).where("bytes = stays")
    gone = stage(
        same.groupBy(F.col("at.doc_id").alias("of"), F.col("at.row").alias("of_row")).agg(F.collect_set("at.place").alias("gone")),
        "chunks-to-remove",
    )
    release(repeated, met)

    joined = several.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    joined = joined.select("doc_id", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), "text")
    cut = with_chunks(joined, divisor)
    places = F.transform("chunks", lambda c: c["place"])
    cut = cut.withColumn("left", F.transform(F.array_except(places, "gone"), lambda k: F.get("chunks", k)))
    lines = lambda chunks: F.aggregate(chunks, F.lit(0).cast("long"), lambda n, c: n + c["n_lines"])
    cut = cut.select(
        "doc_id", lines("chunks").alias("n_lines"), (lines("chunks") - lines("left")).alias("removed_lines"),
        F.size("gone").cast("long").alias("removed_chunks"), F.array_join(F.transform("left", lambda c: c["text"]), "\n").alias("text"),
    )
    return single.unionByName(cut)
