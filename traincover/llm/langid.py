"""Language identification of mixed text: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts, over all training rows, character trigrams of words (as many as their words occur; hashed to a fixed
number of cells) and the scripts of words, per language. A word's script narrows the languages: those in which at least
a thousandth of the words have that script, or all if there is none. A word's score in a language is the logarithm of
the smoothed likelihood of its trigrams. Viterbi over the words of a text, with a penalty for each switch, labels
spans; a text's language is the one whose spans hold the most letters (ties: the smaller name), and its score is that
share of letters, weighted with the confidence of its words against their runners-up.

Null texts and texts without letters are `und` with score 0 and no spans. Rows with a null language are not learnt from;
without any training row every text is `und`. Repeated rows count as often as they occur. An empty table gives an empty
result. Whole texts are read; memory follows the words of one batch of documents, not their longest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import regex
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traincover.llm.base import mix, smaller

UNDETERMINED = "und"
CELLS = 1 << 16
SWITCH_PENALTY = 12.0
LEAST_SCRIPT_SHARE = 0.001
# Languages that one model holds at most; more raise an error instead of being dropped.
MOST_LANGUAGES = 512

# First code points of the ranges in which a script prevails, and their names.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1380, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
_BOUNDS = np.array([start for start, _ in SCRIPT_RANGES])
_SCRIPT_NO = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])

# A word: a letter, then letters and marks (numerals such as ½ or ① are no letters; vowel signs stay in their word).
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_REMEMBERED = 1_000_000


def _lowered(words: list[str]) -> list[str]:
    """In lower case, word by word (a lowered text may split into other words)."""
    return " ".join(words).lower().split(" ") if words else []


class Words:
    """Trigram cells and scripts of many words at once."""

    def __init__(self, words: list[str], cells: int = CELLS):
        points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))  # letters, and trigrams too with both ends marked
        ends = np.cumsum(self.lengths + 2)
        inside = np.ones(len(points), bool)
        inside[ends - 1] = inside[ends - 2] = False
        hashed = mix(points[:-2] | points[1:-1] << np.uint64(21) | points[2:] << np.uint64(42)) if len(words) else points
        self.cells = (hashed % np.uint64(cells)).astype(np.int64)[inside[: len(hashed)]]
        self.first = np.cumsum(self.lengths) - self.lengths  # of each word among all cells
        letters = np.ones(len(points), bool)
        letters[ends - 1] = letters[ends - self.lengths - 2] = False
        script = _SCRIPT_NO[np.searchsorted(_BOUNDS, points[letters].astype(np.int64), "right") - 1]
        word = np.repeat(np.arange(len(words)), self.lengths)
        table = np.bincount(word * len(SCRIPTS) + script, minlength=len(words) * len(SCRIPTS))
        self.scripts = table.reshape(-1, len(SCRIPTS)).argmax(axis=1)  # that of most letters; ties: the first of the list


def counts(training: DataFrame, cells: int = CELLS) -> DataFrame:
    """lang, cell, n: trigram counts (cell from 0) and word counts by script (cell from -1 down)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        waiting: dict[str, Counter] = {}

        def settle(lang: str) -> None:
            total = found.setdefault(lang, np.zeros(cells + len(SCRIPTS), np.int64))
            counted = waiting.pop(lang)
            n = np.fromiter(counted.values(), np.int64, len(counted))
            own = Words(list(counted), cells)
            total[:cells] += np.bincount(own.cells, np.repeat(n, own.lengths), minlength=cells).astype(np.int64)
            total[cells:] += np.bincount(own.scripts, n, minlength=len(SCRIPTS)).astype(np.int64)

        for batch in smaller(batches, 1024):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if text:
                    waiting.setdefault(lang, Counter()).update(_lowered(_WORDS.findall(text)))
            for lang in [lang for lang, words in waiting.items() if len(words) > 100_000]:
                settle(lang)
        for lang in [lang for lang, words in waiting.items() if words]:
            settle(lang)
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < cells, at, cells - 1 - at), pa.int32()), pa.array(total[at]),
            ], names=["lang", "cell", "n"])

    partial = training.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, cell int, n long")
    return partial.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Trigram log likelihoods by cell and language, and which languages a script admits."""

    def __init__(self, rows: pa.Table, cells: int = CELLS):
        self.langs = sorted(set(rows["lang"].to_pylist()))
        self.cells = cells
        k = len(self.langs)
        place = {lang: i for i, lang in enumerate(self.langs)}
        lang = np.array([place[x] for x in rows["lang"].to_pylist()], np.int64)
        cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
        grams, scripts = np.zeros((cells, k)), np.zeros((len(SCRIPTS), k))
        gram = cell >= 0
        grams[cell[gram], lang[gram]] = n[gram]
        scripts[-1 - cell[~gram], lang[~gram]] = n[~gram]
        smooth = 0.5
        self.log_likelihood = np.log((grams + smooth) / (grams.sum(axis=0) + smooth * cells)).astype(np.float32) if k else grams
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.admitted = share >= LEAST_SCRIPT_SHARE
        self.admitted[~self.admitted.any(axis=1)] = True


def train(training: DataFrame, cells: int = CELLS, most_languages: int = MOST_LANGUAGES) -> Model:
    """Learn from `lang` and `text`. The model has a fixed number of cells for each language."""
    table = counts(training, cells)
    # The rows sent are bounded by cells times languages, which is checked first.
    known = training.where(F.col("lang").isNotNull()).select("lang").distinct().limit(most_languages + 1).count()
    if known > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    return Model(table.toArrow(), cells)


class Labeller:
    """Labels the words of many texts at once."""

    def __init__(self, model: Model, penalty: float = SWITCH_PENALTY):
        self.model, self.penalty = model, penalty
        self.known: dict[str, int] = {}
        self.table = np.empty((0, len(model.langs)), np.float32)
        self.used = 0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Row numbers of the words in `table`."""
        if len(self.known) > _REMEMBERED:
            self.known.clear()
            self.used = 0
        known = self.known
        fresh = [w for w in set(words) if w not in known]
        if fresh:
            need = self.used + len(fresh)
            if need > len(self.table):
                bigger = np.empty((max(need, 2 * len(self.table)), len(self.model.langs)), np.float32)
                bigger[: self.used] = self.table[: self.used]
                self.table = bigger
            own = Words(fresh, self.model.cells)
            score = np.add.reduceat(self.model.log_likelihood[own.cells], own.first, axis=0)
            barred = ~self.model.admitted[own.scripts]
            score = np.where(barred, score.min(axis=1, keepdims=True) - 50, score)
            # Words differ in length; only differences between languages matter.
            self.table[self.used: need] = score - score.max(axis=1, keepdims=True)
            known.update(zip(fresh, range(self.used, need)))
            self.used = need
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def label(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """For each text's rows of `table` the languages of its words. Texts in which no stretch of words gains as much
        as one switch costs, even with the best other language for each word, are in one language; the others go
        through Viterbi together."""
        labels, mixed = [], []
        for i, r in enumerate(rows):
            best = 0
            if len(r):
                score = self.table[r]
                best = int(score.sum(axis=0).argmax())
                own = score[:, best].copy()
                score[:, best] = -np.inf
                gain = np.concatenate([[0.0], np.cumsum(np.maximum(score.max(axis=1), -1e6) - own, dtype=np.float64)])
                if (gain - np.minimum.accumulate(gain)).max() > self.penalty:
                    mixed.append(i)
            labels.append(np.full(len(r), best, np.int16))
        for i, path in zip(mixed, self._viterbi([rows[i] for i in mixed])):
            labels[i] = path
        return labels

    def _viterbi(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """One step for the n-th words of all texts."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lengths = np.array([len(rows[i]) for i in order], np.int64)
        labels = [np.empty(len(r), np.int16) for r in rows]
        if not len(lengths) or not lengths[0]:
            return labels
        k = len(self.model.langs)
        live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")  # texts with an n-th word: the first so many
        starts = np.concatenate([[0], np.cumsum(live)])
        by_step = np.empty(starts[-1], np.int64)
        for place, i in enumerate(order):
            if len(rows[i]):
                by_step[starts[: len(rows[i])] + place] = rows[i]
        came_from = np.empty((starts[-1], k), np.int16)
        own = np.arange(k, dtype=np.int16)
        best = self.table[by_step[: live[0]]].astype(np.float64)
        last = np.empty(len(order), np.int16)
        for step in range(1, lengths[0]):
            ended = live[step]
            if ended < len(best):
                last[ended: len(best)] = best[ended:].argmax(axis=1)
                best = best[:ended]
            top = best.argmax(axis=1)
            switched = best[np.arange(len(best)), top] - self.penalty
            stays = best >= switched[:, None]
            came_from[starts[step]: starts[step + 1]] = np.where(stays, own, top[:, None])
            best = np.where(stays, best, switched[:, None]) + self.table[by_step[starts[step]: starts[step + 1]]]
        last[: len(best)] = best.argmax(axis=1)
        state = last.copy()
        for step in range(lengths[0] - 1, -1, -1):
            now = slice(starts[step], starts[step + 1])
            by_step[now] = state[: live[step]]
            if step:
                state[: live[step]] = came_from[now][np.arange(live[step]), state[: live[step]]]
        for place, i in enumerate(order):
            labels[i] = by_step[starts[: len(rows[i])] + place].astype(np.int16)
        return labels


SPANS = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType()),
]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def _verdict(text: str, words: list[str], rows: np.ndarray, labels: np.ndarray, labeller: Labeller):
    """(language, score, spans) of one text with words."""
    langs = labeller.model.langs
    chosen, share = int(labels[0]), 1.0
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
    if len(cuts) > 2:
        held = np.bincount(labels, np.fromiter(map(len, words), np.int64, len(words)), minlength=len(langs))
        chosen = int(held.argmax())
        share = held[chosen] / held.sum()
        found = [m.span() for m in _WORDS.finditer(text)]
        spans = [{"start": found[a][0], "end": found[b - 1][1], "lang": langs[labels[a]]} for a, b in zip(cuts, cuts[1:])]
    else:
        spans = [{"start": text.index(words[0]), "end": text.rindex(words[-1]) + len(words[-1]), "lang": langs[chosen]}]
    score = labeller.table[rows[labels == chosen]] if len(cuts) > 2 else labeller.table[rows]
    rival = np.delete(score, chosen, axis=1)
    margin = (score[:, chosen] - rival.max(axis=1)).sum() if rival.shape[1] else 30.0
    return langs[chosen], float(share / (1 + np.exp(-np.clip(margin, -30, 30)))), spans


def label_languages(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """`docs` with lang_pred, score and lang_spans (start and end in code points). Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score", "lang_spans")
    names = kept.columns
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", SPANS)]
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        for batch in smaller(batches, 1024):
            texts = batch.column("text").to_pylist()
            found = [_WORDS.findall(t) if t and labeller.model.langs else [] for t in texts]
            numbered = np.split(
                labeller.word_scores(_lowered([w for words in found for w in words])), np.cumsum([len(f) for f in found])[:-1]
            )
            verdicts = [
                _verdict(t, f, r, x, labeller) if f else (UNDETERMINED, 0.0, [])
                for t, f, r, x in zip(texts, found, numbered, labeller.label(numbered))
            ]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array([v[0] for v in verdicts], pa.string()), pa.array([v[1] for v in verdicts], pa.float64()),
                pa.array([v[2] for v in verdicts], _SPAN),
            ], names=[*names, "lang_pred", "score", "lang_spans"])

    return kept.mapInArrow(run, schema)
