"""Packing of tokenised documents into sequences of a fixed window, by non-negative least squares.

A document's ids (the tokenizer's, then one end id) are cut into pieces: as many whole windows as fit, each a sequence of
its own, and a rest shorter than the window. The rests are packed:
1. Their lengths make a histogram h (one row per length: at most `window` rows, whatever the data size).
2. Shallow combinations, multisets of at most `depth` lengths present in h whose sum fills the window exactly, are the
   columns of a matrix A (A[l, c]: how often length l occurs in combination c).
3. Non-negative least squares, min |A x - h| over x >= 0, solved by accelerated projected gradient, gives repeat counts;
   they are rounded down and then cut to what the histogram holds, greedily by count.
4. Rests left over are packed greedily: laid end to end, longest first, and cut at window boundaries, so that only the
   very last sequence is short.
Combination sequences hold whole rests and no padding. A sequence is padded to the window, except one whose length is a
power of two, which is left as it is (`padded_length`).

Placement is exact and distributed: ranks within a length, and token positions of the leftovers, come from counts per
(key, partition) summed in small tables, plus running sums within a partition; no window spans all rows.

Defined cases: a null text is empty (its only id is the end id). Repeated doc_ids are documents of their own. An empty table
gives no pieces. Every id lies in exactly one piece. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traincover.llm.base import smaller
from traincover.session import stage

WINDOW = 1024
DEPTH = 3
END_ID = 0
STEPS = 3000
ENCODE_ROWS = 64

TOKENS = "doc_id long, doc_tokens long, window_crc32 array<long>, rest binary, rest_crc32 long"


def read_tokenizer(path: str | None = None) -> tuple[bytes, str]:
    """(ranks file, split pattern) of a byte-level BPE; by default the 50k vocabulary of the public tokenizers installed here.

    Ids are those of the tokenizers library with `byte_bpe_50k.json` (special-token strings as ordinary text): the same
    vocabulary as ranks, applied by tiktoken, which is several times faster (tests compare both on every fixture).
    """
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def _width(largest: int) -> str:
    """Little-endian unsigned type for ids up to `largest`: two bytes where they suffice (staged and moved that way)."""
    return "<u2" if largest < 1 << 16 else "<u4"


def _crc(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, tokenizer: tuple[bytes, str], window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per document row, staged: doc_id, doc_tokens, window_crc32 (checksum of each whole window of its ids),
    rest (the ids after the last whole window, little-endian unsigned, 2 or 4 bytes each as `_width` says), rest_crc32,
    _part, _key. Ids themselves are kept only for the rest: pieces that whole windows make need no more."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def encode(batches):
        import base64

        import tiktoken

        table, pattern = shared.value
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, table.splitlines()) if a}
        coder = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        width = _width(max([*ranks.values(), end_id]))
        for batch in smaller(batches, ENCODE_ROWS):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            sizes, windows, rests, rest_sums = [], [], [], []
            for ids in coder.encode_ordinary_batch(texts, num_threads=1):
                coded = np.array([*ids, end_id], width)
                whole = len(coded) // window * window
                sizes.append(len(coded))
                windows.append([_crc(coded[i: i + window]) for i in range(0, whole, window)])
                rests.append(coded[whole:].tobytes())
                rest_sums.append(_crc(coded[whole:]) if whole < len(coded) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(windows, pa.list_(pa.int64())),
                 pa.array(rests, pa.binary()), pa.array(rest_sums, pa.int64())],
                names=["doc_id", "doc_tokens", "window_crc32", "rest", "rest_crc32"],
            )

    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = coded.mapInArrow(encode, TOKENS)
    return stage(coded.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_key")), "packing-ids")


def _before(rows: DataFrame, keys: list[str], weight: str, across: bool = True) -> DataFrame:
    """`rows` with `_before`: the sum of `weight` over the rows ahead in the order (keys, _part, _key).

    With `across` false, only rows of the same keys count (a rank within the key, for a weight of one).
    """
    per = rows.groupBy(*keys, "_part").agg(F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_in_key", F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
    if keys and across:
        totals = per.groupBy(*keys).agg(F.sum("_w").alias("_t"))
        ahead = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row per key: at most a window's
        totals = totals.withColumn("_keys_before", F.coalesce(F.sum("_t").over(ahead), F.lit(0))).drop("_t")
        per = per.join(totals, keys)
    else:
        per = per.withColumn("_keys_before", F.lit(0))
    base = per.select(*keys, "_part", (F.col("_in_key") + F.col("_keys_before")).alias("_base"))
    local = Window.partitionBy(*keys, "_part").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
    return placed.join(base, [*keys, "_part"]).withColumn("_before", (F.col("_base") + F.col("_local")).cast("long")).drop("_base", "_local")


def combinations(lengths: list[int], window: int = WINDOW, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of at most `depth` of `lengths` (non-decreasing) whose sum is the window."""
    present = sorted(set(lengths))
    have = set(present)
    found = [(window,)] if window in have else []

    def extend(prefix: tuple[int, ...], least: int, left: int):
        if len(prefix) == depth - 1:
            if left >= least and left in have:
                found.append((*prefix, left))
            return
        if left in have and left >= least:
            found.append((*prefix, left))
        for length in present:
            if length > left // 2:
                break
            if length >= least:
                extend((*prefix, length), length, left - length)

    for first in present:
        if first > window // 2:
            break
        extend((first,), first, window - first)
    return sorted(set(found))


def nnls(columns: list[tuple[int, ...]], hist: dict[int, int], steps: int = STEPS) -> np.ndarray:
    """x >= 0 that makes sum_c x_c * (length counts of c) near h, by accelerated projected gradient."""
    index = {length: i for i, length in enumerate(sorted(hist))}
    h = np.array([hist[length] for length in sorted(hist)], float)
    rows, cols, vals = [], [], []
    for c, combo in enumerate(columns):
        for length, m in Counter(combo).items():
            rows.append(index[length])
            cols.append(c)
            vals.append(m)
    rows, cols, vals = np.array(rows, int), np.array(cols, int), np.array(vals, float)
    n = len(columns)
    if not n:
        return np.zeros(0)
    times = lambda x: np.bincount(rows, vals * x[cols], len(h))
    back = lambda r: np.bincount(cols, vals * r[rows], n)
    lipschitz = max(np.bincount(rows, vals, len(h)).max() * np.bincount(cols, vals, n).max(), 1.0)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(y - back(times(y) - h) / lipschitz, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


def plan(hist: dict[int, int], window: int = WINDOW, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): repeat counts rounded down, then cut greedily (largest first) to what h holds."""
    columns = combinations(list(hist), window, depth)
    x = nnls(columns, hist)
    left = dict(hist)
    chosen = []
    for c in np.argsort(-x, kind="stable"):
        want = int(np.floor(x[c] + 1e-9))
        if want <= 0:
            break
        need = Counter(columns[c])
        k = min([want, *(left[length] // m for length, m in need.items())])
        if k > 0:
            for length, m in need.items():
                left[length] -= m * k
            chosen.append((columns[c], k))
    return chosen


def _slots(chosen: list[tuple[tuple[int, ...], int]], first_sequence: int) -> list[tuple]:
    """(length, lo, hi, m, first sequence, offsets): ranks [lo, hi) of a length fill m slots of each copy of a combination."""
    out, seen, seq = [], Counter(), first_sequence
    for combo, k in chosen:
        at, offsets = 0, {}
        for length in combo:
            offsets.setdefault(length, []).append(at)
            at += length
        for length, where in offsets.items():
            m = len(where)
            lo = seen[length]
            out.append((length, lo, lo + m * k, m, seq, where))
            seen[length] += m * k
        seq += k
    return out


def pack(docs: DataFrame, tokenizer: tuple[bytes, str] | None = None, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length: one row per piece.

    `docs`: doc_id, text. `padded_length` is the length its sequence is padded to.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or read_tokenizer()
    coded = tokenized(docs, tokenizer, window)
    wholes = F.size("window_crc32").cast("long")

    # Whole windows: one sequence each, numbered in the order of their documents.
    full = _before(coded.select("_key", "_part", "doc_id", "doc_tokens", "window_crc32", wholes.alias("_n")).where("_n > 0"), [], "_n")
    n_full = full.agg(F.sum("_n")).first()[0] or 0
    full = full.select("doc_id", "doc_tokens", "_before", F.posexplode("window_crc32").alias("_i", "ids_crc32")).select(
        "doc_id", (F.col("_i") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32",
        "doc_tokens", (F.col("_before") + F.col("_i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )

    rest = F.col("doc_tokens") - wholes * window
    rests = coded.where(rest > 0).select(
        "_key", "_part", "doc_id", "doc_tokens", "rest_crc32", (wholes * window).alias("start"), rest.alias("length"),
        F.lit(1).alias("_one"),
    )
    rests = stage(_before(rests, ["length"], "_one", across=False).withColumnRenamed("_before", "_rank"), "packing-rests")
    hist = {r.length: r.n for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most a window's rows
    chosen = plan(hist, window, depth)
    slots = _slots(chosen, n_full)
    n_combined = sum(k for _, k in chosen)
    table = spark.createDataFrame(slots, "length long, lo long, hi long, m long, first long, offsets array<long>")
    combined = rests.join(F.broadcast(table), "length").where((F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    at = F.col("_rank") - F.col("lo")
    combined = combined.select(
        "doc_id", "start", "length", F.col("rest_crc32").alias("ids_crc32"), "doc_tokens",
        (F.col("first") + (at / F.col("m")).cast("long")).alias("sequence_id"),
        F.element_at("offsets", (at % F.col("m") + 1).cast("int")).alias("offset"),
    )

    used = {}
    for length, _, hi, *_ in slots:
        used[length] = max(used.get(length, 0), hi)
    used_table = spark.createDataFrame(list(used.items()) or [(0, 0)], "length long, used long")
    left = rests.join(F.broadcast(used_table), "length", "left").where(F.col("_rank") >= F.coalesce("used", F.lit(0)))
    left = _before(left.withColumn("_longest", -F.col("length")), ["_longest"], "length")
    first_window = (F.col("_before") / window).cast("long")
    last_window = ((F.col("_before") + F.col("length") - 1) / window).cast("long")
    cut = left.select(
        "_key", "doc_id", "doc_tokens", "rest_crc32", "start", "length", "_before",
        F.explode(F.sequence(first_window, last_window)).alias("_w"),
    )
    lo = F.greatest(F.col("_before"), F.col("_w") * window)
    hi = F.least(F.col("_before") + F.col("length"), (F.col("_w") + 1) * window)
    cut = cut.select(
        "_key", "doc_id", "doc_tokens", "rest_crc32", (lo - F.col("_before")).alias("_in_rest"), (hi - lo).alias("_length"),
        F.col("length").alias("_rest_length"), (F.col("start") + lo - F.col("_before")).alias("start"),
        (F.lit(n_full + n_combined) + F.col("_w")).alias("sequence_id"), (lo - F.col("_w") * window).alias("offset"),
    )
    # A rest that a window boundary splits meets its ids once more; whole rests keep their checksum.
    whole = cut.where(F.col("_length") == F.col("_rest_length")).select(
        "doc_id", "start", F.col("_length").alias("length"), F.col("rest_crc32").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )
    split = cut.where(F.col("_length") < F.col("_rest_length")).join(coded.select("_key", "rest"), "_key")
    size = 2 if _width(max(_largest(tokenizer[0]), END_ID)) == "<u2" else 4
    split = split.select("doc_id", "start", "_length", "_in_rest", "rest", "doc_tokens", "sequence_id", "offset").mapInArrow(
        _checksums(size), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )

    pieces = full.unionByName(combined).unionByName(whole).unionByName(split)
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("_filled"))
    power = F.col("_filled").bitwiseAND(F.col("_filled") - 1) == 0
    padded = filled.select("sequence_id", F.when(power, F.col("_filled")).otherwise(F.lit(window)).cast("long").alias("padded_length"))
    return pieces.join(padded, "sequence_id").select(
        "doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), "ids_crc32",
        "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"),
        "padded_length",
    )


def _largest(ranks: bytes) -> int:
    return max((int(line.split()[1]) for line in ranks.splitlines() if line.strip()), default=0)


def _checksums(size: int):
    """ids_crc32 of the part [_in_rest, _in_rest + _length) of each rest."""

    def run(batches):
        for batch in batches:
            starts, lengths = batch.column("_in_rest").to_numpy(), batch.column("_length").to_numpy()
            sums = [_crc(np.frombuffer(rest, f"<u{size}")[s: s + n]) for rest, s, n in zip(batch.column("rest").to_pylist(), starts, lengths)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), batch.column("_length"), pa.array(sums, pa.int64()),
                 batch.column("doc_tokens"), batch.column("sequence_id"), batch.column("offset")],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run
