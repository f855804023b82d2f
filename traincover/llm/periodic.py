"""Runs of periodic words, found through string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length >= max(6, 4 q)
that no neighbouring word extends keeping period q. Words are compared as they are (no case folding).

Candidate periods come from three places, and each candidate d is then checked exactly: every maximal stretch where
words d apart agree, long enough for d, is a run of its smallest period q (q divides d, by Fine and Wilf).
* d = 1, directly.
* Synchronising sets at dyadic scales t = 1, 2, 4, ...: a position i is selected when the least hash of the t-word
  windows starting in [i, i + t] starts at i or at i + t; windows inside highly periodic regions do not compete. The
  choice depends on the 2t words from i alone (local consistency), so two selected positions whose 2t-word contexts agree,
  d < 4 t apart, propose the period d. A run of period q in [2t, 4t) holds such a pair q apart.
* Highly periodic regions of scale t (a t/2-word window that recurs at most t/4 words later) are left out of the sets
  above; the distance of the recurrence is proposed as a period itself.
Window hashes of scale 2t are built from two of scale t, so each scale costs linear time.

Defined cases: a null or empty text has no words and no runs; a null doc_id plants nothing. Runs of one text may overlap. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traincover.llm.base import WORD, mix

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
RUNS = "runs array<struct<start:long,length:long,period:long>>, kept array<boolean>"
_INF = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for every i with a whole window (van Herk / Gil-Werman)."""
    n = len(x)
    pad = (-n) % w
    y = np.concatenate([x, np.full(pad, _INF, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1: n])


def _recur_within(h: np.ndarray, reach: int) -> np.ndarray:
    """For each window, the distance to the next equal hash if it is at most `reach`, else 0."""
    order = np.lexsort((np.arange(len(h)), h))
    nxt = np.zeros(len(h), np.int64)
    same = h[order[1:]] == h[order[:-1]]
    gap = order[1:] - order[:-1]
    close = same & (gap <= reach)
    nxt[order[:-1][close]] = gap[close]
    return nxt


def proposals(h: np.ndarray) -> set[int]:
    """Candidate periods of a sequence of word hashes."""
    n = len(h)
    found = {1} if n > 1 else set()
    windows = {1: h}
    t = 1
    while 8 * t <= n:
        if 2 * t not in windows:
            a = windows[t]
            windows[2 * t] = mix(a[:-t] * _ODD + mix(a[t:]))
        ids = windows[t].copy()
        if t >= 4:
            half = windows[t // 2]
            near = _recur_within(half, t // 4)
            found.update(np.unique(near[near > 0]).tolist())
            ids[near[: len(ids)] > 0] = _INF
        if len(ids) > t:
            least = _sliding_min(ids, t + 1)
            m = len(least)
            chosen = (least < _INF) & ((ids[:m] == least) | (ids[t: t + m] == least))
            context = windows[2 * t]
            pos = np.flatnonzero(chosen[: len(context)])
            if len(pos) > 1:
                ctx = context[pos]
                order = np.lexsort((pos, ctx))
                p, c = pos[order], ctx[order]
                k = 1
                while k < len(p):
                    d = p[k:] - p[:-k]
                    ok = (c[k:] == c[:-k]) & (d < 4 * t)
                    if not ok.any():
                        break
                    found.update(np.unique(d[ok]).tolist())
                    k += 1
        t *= 2
    return found


def runs_of(h: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, runs = len(h), set()
    for d in sorted(proposals(h)):
        if d >= n:
            continue
        eq = np.concatenate([[False], h[:-d] == h[d:], [False]])
        edges = np.flatnonzero(np.diff(eq.astype(np.int8)))
        for b, e in zip(edges[::2], edges[1::2]):
            length = int(e - b + d)
            if length < max(LEAST_LENGTH, LEAST_EXPONENT * d):
                continue
            q = next(q for q in range(1, d + 1) if d % q == 0 and bool(np.all(h[b: b + length - q] == h[b + q: b + length])))
            runs.add((int(b), length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> list[bool]:
    cover = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        cover[start + q] += 1
        cover[start + length] -= 1
    return (np.cumsum(cover[:n]) == 0).tolist()


def numbered(words: list) -> np.ndarray:
    """Equal words get equal numbers, different words different ones."""
    seen: dict = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)


def _detect(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, kept = [], []
            for words in batch.column(column).to_pylist():
                words = words or []
                runs = runs_of(mix(numbered(words) + np.uint64(1)))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                kept.append(_kept(len(words), runs))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, _RUN_TYPE), pa.array(kept, pa.list_(pa.bool_()))],
                names=[*batch.schema.names, "runs", "kept"],
            )

    return run


_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), 1)


def find_runs(table: DataFrame, words: str = "words") -> DataFrame:
    """The rows of `table` with `runs` (by start, then period) and `kept` (a flag for each word of the array `words`).

    Columns of `table` called `runs` or `kept` are replaced.
    """
    staged = table.select(*(c for c in table.columns if c not in ("runs", "kept")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema.fields)
    return staged.mapInArrow(_detect(words), f"{schema}, {RUNS}")


def planted(doc_id: Column, words: Column) -> Column:
    """The contract's planted repetition: where crc32(doc_id) ends in 0, words from a on repeat with period p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words)
    a = F.when(n > 0, g % n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # Slices only: a lambda that reads `words` would evaluate the expression behind it once for every word.
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    repeated = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    moved = F.concat(F.slice(words, 1, a.cast("int")), F.slice(repeated, 1, (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), moved).otherwise(words)


def summary(found: DataFrame, words: str = "words") -> DataFrame:
    """n_runs, the longest run, runs_sha256 and collapsed_sha256 beside the other columns of `found`."""
    runs = F.col("runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("neg_start"), (-r["period"]).alias("neg_period"), r.alias("run"))))
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))
    kept = F.filter(F.col(words), lambda w, i: F.col("kept")[i])
    best = longest["run"]
    return found.select(
        "*", F.size(runs).cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.array_join(kept, " ").cast("binary"), 256).alias("collapsed_sha256"),
    )


def query_table(documents: DataFrame) -> DataFrame:
    """The contract's form over `documents` (doc_id, text)."""
    words = documents.select("doc_id", planted(F.col("doc_id"), word_list(F.col("text"))).alias("words"))
    return summary(find_runs(words)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
