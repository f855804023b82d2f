"""Language-model scores from an interpolated modified Kneser-Ney bigram model counted over the whole training set.

Tokens are words (A-Z lowered, split at ASCII white space) and one end per text; every text starts in a context of its own.
Counting tasks send each shard the distinct bigrams they met, with counts. A shard adds them up and writes its part of the
model to the shared folder: sorted arrays of 64-bit bigram hashes with counts. Words get arrays of their token count, of
the number of distinct words before them, and of their sums as a context. Scoring tasks map these files into memory and
look up the sorted distinct words and bigrams of a batch; nothing of the model is sent to the driver but some totals.

    p(w | v) = max(c(vw) - D(c), 0) / c(v.) + lambda(v) p(w)        p(w) likewise from continuation counts over 1 / (V + 1)

Each level has three discounts, from its counts of counts. The unknown word is one word more than the V known ones.
The base score is the add-one unigram model of the same counts.

Null texts count as empty: their one token is the end. Without training rows every probability is 1 / (V + 1) with
V = 0. Repeated rows count as often as they occur; rows that share a doc_id are scored one by one. Words are told apart
by 48 bits, bigrams by 64. An empty table gives an empty result. Columns other than doc_id and text are ignored.

Scale: contexts that hold over a thousandth of all tokens (at most a thousand words, broadcast) are split over the
shards by the next word. Files lie in `spark.checkpoint.dir`; where that is no mounted folder, tasks fetch them through
Arrow's file systems first.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traincover.llm.base import mix, smaller, texts_of, word_hashes, words
from traincover.session import stage, staging_root

END, BEGIN = np.uint64(1), np.uint64(2)
HOT_SHARE = 1000
CHUNK_TOKENS = 3_000_000
_BATCH = 1024
_ID_BITS = 48


def _token_ids(text: bytes | None) -> np.ndarray:
    return np.append(word_hashes(words(text)) >> np.uint64(64 - _ID_BITS), END)


def _shard(ids: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of ids: a sorted array of ids stays together shard by shard."""
    return ((ids * np.uint64(shards)) >> np.uint64(_ID_BITS)).astype(np.int32)


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) + w * np.uint64(0x9E3779B97F4A7C15))


def _pack(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids, "<u8").view("u1").reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(raw, "u1").reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as one byte each, and (place, count) of those over 255."""
    over = np.flatnonzero(counts > 255)
    return np.minimum(counts, 255).astype("u1").tobytes(), np.stack([over.astype("u8"), counts[over].astype("u8")]).tobytes()


def _large(small: np.ndarray | bytes, over: bytes) -> np.ndarray:
    counts = np.frombuffer(small, "u1").astype(np.int64)
    at, n = np.frombuffer(over, "u8").reshape(2, -1)
    counts[at.astype(np.int64)] = n
    return counts


class Store:
    """Raw arrays in a folder that all executors share."""

    def __init__(self, folder: str):
        self.folder = folder

    def _where(self, name: str):
        system, path = pafs.FileSystem.from_uri(f"{self.folder}/{name}")
        return system, path

    def write(self, name: str, **arrays: np.ndarray) -> None:
        """One file an array. A retried task writes the same again; a file appears whole or not at all."""
        for column, array in arrays.items():
            system, path = self._where(f"{name}.{column}")
            system.create_dir(os.path.dirname(path), recursive=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part) as out:
                out.write(np.ascontiguousarray(array).data if len(array) else b"")
            system.move(part, path)

    def map(self, name: str, column: str, kind: str) -> np.ndarray:
        system, path = self._where(f"{name}.{column}")
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound or not info.size:
            return np.empty(0, kind)
        if isinstance(system, pafs.LocalFileSystem):
            return np.memmap(path, kind, "r")
        with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(path) as source:
            while block := source.read(1 << 22):
                copy.write(block)
            copy.flush()
            return np.memmap(copy.name, kind, "r")  # the mapping outlives the name


def _added(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct sorted keys with the sums of their values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def _counted_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> dict[int, list[dict]]:
    held: dict[int, list[dict]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            held.setdefault(row["shard"], []).append(row)
    return held


_WORDS = "shard int, ids binary, counts binary"
_TOTALS = "shard int, tokens long, kinds long, frequent array<long>, frequent_counts array<long>"


def _count_words(training: DataFrame, shards: int, store: Store) -> DataFrame:
    """Writes the token counts by shard; returns one row for each shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            ids, n = np.unique(np.concatenate(parts), return_counts=True)
            cuts = np.searchsorted(_shard(ids, shards), np.arange(shards + 1))
            rows = [(s, _pack(ids[a:b]), n[a:b].astype("u4").tobytes()) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["shard", "ids", "counts"])

        parts, size = [], 0
        for batch in smaller(batches, _BATCH):
            for text in texts_of(batch):
                parts.append(_token_ids(text))
                size += len(parts[-1])
            if size >= CHUNK_TOKENS:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches).items():
            ids, n = _added(np.concatenate([_unpack(r["ids"]) for r in rows]), np.concatenate([np.frombuffer(r["counts"], "u4").astype(np.int64) for r in rows]))
            store.write(f"words-{shard}", ids=ids, tokens=n)
            often = np.flatnonzero(n * HOT_SHARE > n.sum())
            yield pa.RecordBatch.from_pylist([{
                "shard": shard, "tokens": int(n.sum()), "kinds": len(n), "frequent": ids[often].astype(np.int64).tolist(), "frequent_counts": n[often].tolist(),
            }], schema=pa.schema([("shard", pa.int32()), ("tokens", pa.int64()), ("kinds", pa.int64()), ("frequent", pa.list_(pa.int64())), ("frequent_counts", pa.list_(pa.int64()))]))

    return training.select("text").mapInArrow(count, _WORDS).repartition(shards, "shard").mapInArrow(add, _TOTALS)


_BIGRAMS = "shard int, v binary, runs binary, w binary, counts binary, over binary"
# A shard's sums by word: as a context (sum, followers seen once, twice, more often) and as a follower (distinct contexts).
_SUMS = "shard int, counts_of_counts array<long>, ids binary, sums binary"
_COLUMNS = ("total", "once", "twice", "more", "before")


def _count_bigrams(training: DataFrame, shards: int, hot: list[int], store: Store) -> DataFrame:
    """Writes the bigram arrays by shard; returns the sums by word, for the shards of words."""
    hot_ids = np.array(sorted(hot), np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            ids, place = np.unique(np.concatenate(parts), return_inverse=True)
            begin = int(np.searchsorted(ids, BEGIN))
            size = np.uint64(len(ids))
            code = place[:-1].astype(np.uint64) * size + place[1:].astype(np.uint64)
            code = code[place[1:] != begin]  # a text's end and the next one's start are no bigram
            code, n = np.unique(code, return_counts=True)
            vi, wi = (code // size).astype(np.int64), (code % size).astype(np.int64)
            shard = bigram_shard(ids[vi], ids[wi], hot_ids, shards)
            order = np.argsort(shard, kind="stable")
            vi, wi, n, shard = vi[order], wi[order], n[order], shard[order]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a == b:
                    continue
                first = np.flatnonzero(np.append(True, np.diff(vi[a:b]) != 0))
                runs = np.diff(np.append(first, b - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32())] + [pa.array([x], pa.binary()) for x in (_pack(ids[vi[a:b][first]]), runs.astype("u4").tobytes(), _pack(ids[wi[a:b]]), *_small(n[a:b]))],
                    names=["shard", "v", "runs", "w", "counts", "over"],
                )

        parts, size = [], 0
        for batch in smaller(batches, _BATCH):
            for text in texts_of(batch):
                parts += [np.array([BEGIN]), _token_ids(text)]
                size += len(parts[-1])
            if size >= CHUNK_TOKENS:
                yield from flush(parts)
                parts, size = [], 0
        if parts:
            yield from flush(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches).items():
            uv, vi = np.unique(np.concatenate([np.repeat(_unpack(r["v"]), np.frombuffer(r["runs"], "u4")) for r in rows]), return_inverse=True)
            uw, wi = np.unique(np.concatenate([_unpack(r["w"]) for r in rows]), return_inverse=True)
            n = np.concatenate([_large(r["counts"], r["over"]) for r in rows])
            rows.clear()
            code, n = _added(vi.astype(np.uint64) * np.uint64(len(uw)) + wi.astype(np.uint64), n)
            vi, wi = (code // np.uint64(len(uw))).astype(np.int64), (code % np.uint64(len(uw))).astype(np.int64)
            keys = _pair_hash(uv[vi], uw[wi])
            order = np.argsort(keys)
            small, over = _small(n[order])
            store.write(f"bigrams-{shard}", keys=keys[order], counts=np.frombuffer(small, "u1"), over=np.frombuffer(over, "u1"))
            context = [np.bincount(vi, n, minlength=len(uv))] + [np.bincount(vi, x, minlength=len(uv)) for x in (n == 1, n == 2, n > 2)]
            sums = np.zeros((len(_COLUMNS), len(uv) + len(uw)), np.int64)
            sums[:4, : len(uv)] = context
            sums[4, len(uv):] = np.bincount(wi, minlength=len(uw))
            ids, *sums = _added(np.concatenate([uv, uw]), *sums)
            cuts = np.searchsorted(_shard(ids, shards), np.arange(shards + 1))
            counted = _counted_counts(n)
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b or counted:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s], pa.int32()), pa.array([counted], pa.list_(pa.int64())), pa.array([_pack(ids[a:b])]),
                        pa.array([_varied(np.stack([x[a:b] for x in sums]))]),
                    ], names=["shard", "counts_of_counts", "ids", "sums"])
                    counted = None

    return training.select("text").mapInArrow(count, _BIGRAMS).repartition(shards, "shard").mapInArrow(add, _SUMS)


def _varied(sums: np.ndarray) -> bytes:
    small, over = _small(sums.ravel())
    return len(small).to_bytes(8, "little") + small + over


def _unvaried(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return _large(raw[8: 8 + n], raw[8 + n:]).reshape(len(_COLUMNS), -1)


def bigram_shard(v: np.ndarray, w: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a bigram: by its context, but by both words for a frequent context."""
    own = _shard(v, shards)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, v), len(hot) - 1)
        often = hot[at] == v
        own[often] = _shard(_pair_hash(v[often], w[often]) >> np.uint64(64 - _ID_BITS), shards)
    return own


def _sum_words(sums: DataFrame, shards: int, store: Store) -> DataFrame:
    """Writes what each word is as a context and as a follower, beside its token count; returns counts of counts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches).items():
            parts = [_unvaried(r["sums"]) for r in rows]
            ids, *columns = _added(np.concatenate([_unpack(r["ids"]) for r in rows]), *np.concatenate(parts, axis=1))
            store.write(f"contexts-{shard}", ids=ids, **{c: x.astype("u8") for c, x in zip(_COLUMNS, columns)})
            before = columns[4]
            low = [int((before == k).sum()) for k in (1, 2, 3, 4)] + [int((before > 2).sum()), int(before.sum())]
            high = [sum(r["counts_of_counts"][k] for r in rows if r["counts_of_counts"]) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([low], pa.list_(pa.int64())), pa.array([high], pa.list_(pa.int64()))], names=["low", "high"])

    return sums.repartition(shards, "shard").mapInArrow(add, "low array<long>, high array<long>")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts by count: 0, 1, 2, 3 and more. With too few counts to estimate them: halves."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class Model:
    """Where the arrays lie, and the totals."""

    def __init__(self, store: Store, shards: int, hot: list[int], tokens: int, kinds: int, low: np.ndarray, high: np.ndarray):
        self.store, self.shards, self.hot = store, shards, np.array(sorted(hot), np.uint64)
        self.tokens, self.kinds = tokens, kinds
        self.low_discounts, self.high_discounts = discounts(*low[:4]), discounts(*high[:4])
        self.bigram_kinds = int(low[5])
        d = self.low_discounts
        self.low_left = float(d[1] * low[0] + d[2] * low[1] + d[3] * low[4]) / max(self.bigram_kinds, 1) if self.bigram_kinds else 1.0

    def discard(self, spark) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.store.folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def train(training: DataFrame, shards: int | None = None) -> Model:
    """Count the model over `training` (text)."""
    spark = training.sparkSession
    shards = shards or max(8, training.rdd.getNumPartitions())
    store = Store(f"{staging_root(spark)}/traincover-lm-{uuid.uuid4().hex}")
    totals = stage(_count_words(training, shards, store), "lm-words")
    tokens, kinds = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    each = totals.select(F.explode(F.arrays_zip("frequent", "frequent_counts")).alias("f")).select("f.*")
    hot = [r[0] for r in each.where(F.col("frequent_counts") * HOT_SHARE > tokens).collect()]  # fewer than HOT_SHARE
    sums = _count_bigrams(training, shards, hot, store)
    counted = stage(_sum_words(sums, shards, store), "lm-contexts")
    columns = [F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for c, n in (("low", 6), ("high", 4)) for i in range(n)]
    found = [int(x) for x in counted.agg(*columns).first()]
    return Model(store, shards, hot, tokens, kinds, np.array(found[:6]), np.array(found[6:]))


class Scorer:
    """Looks up the words and bigrams of a batch of texts in the mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[tuple, np.ndarray] = {}

    def _file(self, name: str, column: str, kind: str) -> np.ndarray:
        if (name, column) not in self.files:
            self.files[name, column] = self.model.store.map(name, column, kind)
        return self.files[name, column]

    def _look_up(self, keys: np.ndarray, shard: np.ndarray, what: str, key: str, columns: dict[str, str]) -> list[np.ndarray]:
        """The columns' values of distinct keys, 0 where a key is missing. Each shard is searched in key order."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        order = np.lexsort((keys, shard))
        cuts = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[s]: cuts[s + 1]]
            sorted_keys = self._file(f"{what}-{s}", key, "u8")
            if not len(sorted_keys):
                continue
            at = np.minimum(np.searchsorted(sorted_keys, keys[mine]), len(sorted_keys) - 1)
            hit = sorted_keys[at] == keys[mine]
            mine, at = mine[hit], at[hit]
            for x, (column, kind) in zip(out, columns.items()):
                x[mine] = self._file(f"{what}-{s}", column, kind)[at]
                if column == "counts":
                    places, counts = self._file(f"{what}-{s}", "over", "u8").reshape(2, -1)
                    if len(places):
                        big = np.flatnonzero(x[mine] == 255)
                        found = np.minimum(np.searchsorted(places, at[big]), len(places) - 1)
                        same = places[found] == at[big].astype(np.uint64)
                        x[mine[big[same]]] = counts[found[same]]
        return out

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known tokens, base score, score (log10)."""
        m = self.model
        parts = [_token_ids(t) for t in texts]
        lengths = np.array([len(p) for p in parts])
        tokens = np.concatenate(parts)
        doc = np.repeat(np.arange(len(parts)), lengths)
        ids, place = np.unique(tokens, return_inverse=True)
        shard = _shard(ids, m.shards)
        (count,) = self._look_up(ids, shard, "words", "ids", {"tokens": "i8"})
        total, once, twice, more, before = self._look_up(ids, shard, "contexts", "ids", dict.fromkeys(_COLUMNS, "u8"))

        base = np.log10((count + 1) / (m.tokens + m.kinds + 1))
        low = np.maximum(before - m.low_discounts[np.minimum(before, 3)], 0) / max(m.bigram_kinds, 1) + m.low_left / (m.kinds + 1)
        # The words before: the context of a first token is BEGIN, which no text holds.
        start = np.cumsum(lengths) - lengths
        all_ids = np.append(ids, BEGIN)
        begin = self._look_up(np.array([BEGIN]), _shard(np.array([BEGIN]), m.shards), "contexts", "ids", dict.fromkeys(_COLUMNS[:4], "u8"))
        total, once, twice, more = (np.append(a, b) for a, b in zip((total, once, twice, more), begin))
        previous = np.empty(len(place), np.int64)
        previous[1:] = place[:-1]
        previous[start] = len(ids)
        d = m.high_discounts
        left = np.where(total > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(total, 1), 1.0)

        code, of = np.unique(previous.astype(np.uint64) * np.uint64(len(all_ids)) + place.astype(np.uint64), return_inverse=True)
        vi, wi = (code // np.uint64(len(all_ids))).astype(np.int64), (code % np.uint64(len(all_ids))).astype(np.int64)
        v, w = all_ids[vi], all_ids[wi]
        keys, inverse = np.unique(_pair_hash(v, w), return_inverse=True)
        shard = np.empty(len(keys), np.int32)
        shard[inverse] = bigram_shard(v, w, m.hot, m.shards)
        (n,) = self._look_up(keys, shard, "bigrams", "keys", {"counts": "u1"})
        n = n[inverse]
        p = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total[vi], 1) + left[vi] * low[wi]
        size = len(parts)
        return (
            lengths, np.bincount(doc, count[place] > 0, minlength=size).astype(np.int64),
            np.bincount(doc, base[place], minlength=size), np.bincount(doc, np.log10(p)[of], minlength=size),
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in smaller(batches, _BATCH):
            n, known, base, own = scorer.score(texts_of(batch))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(n), shared.value.tokens)), pa.array(base),
                pa.array(own), pa.array(10.0 ** np.minimum(-own / n, 300)),
            ], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def train_and_score(docs: DataFrame, is_training: Column) -> DataFrame:
    """Scores of all rows of `docs` (doc_id, text) under the model of those that `is_training` picks. The scores are
    written to the staging folder, so that the model's files can go."""
    model = train(docs.where(is_training))
    try:
        return stage(score(docs, model), "lm-scores")
    finally:
        model.discard(docs.sparkSession)
