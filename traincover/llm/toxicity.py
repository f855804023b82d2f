"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

1. Terms. A document's terms are its distinct words in lower case and their beginnings of four to seven letters. Over all
   labelled training rows Spark counts in how many toxic and other documents each term occurs. The `n_terms` most telling
   ones are kept.
2. Voters. Terms that speak for toxicity are dealt in turn to `n_lexicons` lexicon voters, which vote when a document has
   one of their terms; one more votes when none does. Pattern voters look at shouting, exclamation marks, long repeats
   of a character and the share of marks. No voter sees a label, lang, source or doc_id.
3. Label model. Over all documents Spark adds up how often each two voters vote together. Votes come from a hidden
   class: covariance of two voters = p (1 - p) gap_i gap_j + what the class doesn't explain. Gaps (a voter's accuracy
   above chance) are solved from triples of voters, what is left over is the correlation of two voters given the class,
   and a document's log-odds are linear in its votes with the inverse of that conditional covariance. The share p of toxic documents is
   that of all labelled training rows. A labelled row's own label is one more voter of fixed accuracy.
4. A logistic regression over the kept terms is fitted to the posteriors of a sample: at most `sample_rows` labelled
   rows, chosen by a hash of doc_id.

Null and empty texts have no terms and get the score of the intercept. Rows whose label is null, or whose document is
missing, are not learnt from; several labels of one document count as toxic if one is. If they have no toxic row or nothing else, all
scores are the (smoothed) share of toxic rows. An empty table gives an empty result. Whole texts are read everywhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from traincover.llm.base import fold, smaller
from traincover.llm.jaccard import _bitmap as bitmap
from traincover.llm.jaccard import _mark as mark
from traincover.session import stage

SAMPLE_ROWS = 20_000
N_TERMS = 4096
N_LEXICONS = 24
LABEL_ACCURACY = 0.999
# Voters together say at most so much (in log odds), so that they don't outvote a label.
MOST_LOG_ODDS = 4.0
PREFIXES = (4, 5, 6, 7)
HELD_OUT_FOLDS = 5

_WORD = re.compile(r"[^\W\d_]+")
_REPEAT = re.compile(r"(.)\1{4,}")
# Words that a task remembers, and terms that it counts before it hands them on.
_REMEMBERED = 1 << 16
_COUNTED = 300_000
# Bits of the filter that keeps documents without a label out of the join.
_LABEL_BITS = 1 << 26


def word_terms(word: str) -> list[str]:
    """A word and its beginnings, which are marked so that they differ from words."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def patterns(text: str) -> list[bool]:
    """Votes that need no lexicon."""
    letters = sum(map(str.isalpha, text[:1])) if len(text) < 2 else len(text)
    upper = sum(1 for c in text if c.isupper())
    marks = text.count("!")
    return [
        upper > 0.3 * letters and len(text) > 20,
        marks >= 3,
        _REPEAT.search(text) is not None,
        sum(text.count(c) for c in "*#$%&@") > 0.05 * len(text) and len(text) > 20,
    ]


N_PATTERNS = 4


class TermReader:
    """The kept terms of texts, with a bounded memory of words."""

    def __init__(self, terms: dict[str, int]):
        self.terms = terms
        self.known: dict[str, tuple[int, ...]] = {}

    def read(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int64)
        found: set[int] = set()
        known, terms = self.known, self.terms
        for word in set(_WORD.findall(text.lower())):
            hits = known.get(word)
            if hits is None:
                hits = tuple(terms[t] for t in word_terms(word) if t in terms)
                if len(known) >= _REMEMBERED:
                    known.clear()
                known[word] = hits
            if hits:
                found.update(hits)
        return np.fromiter(sorted(found), np.int64, len(found))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, toxic (0 or 1): the labels that may be learnt from, one for each doc_id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(HELD_OUT_FOLDS) != 0))
    return usable.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def labelled_sample(usable: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[int, int]]:
    """(doc_id, toxic) of at most `rows` training labels, those with the smallest hashes: what the classifier is fitted to."""
    # At most `rows` small rows reach the driver.
    return [(r[0], r[1]) for r in usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "toxic").collect()]


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic: the documents that have a training label. A bitmap keeps most others out of the shuffle, the join decides."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(labels, "doc_id", _LABEL_BITS))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, "u1")
        for batch in batches:
            at = mark(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), _LABEL_BITS)
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype("u1") & 1).astype(bool)))

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return asked.mapInArrow(screen, "doc_id long, text string").join(labels.hint("shuffle_hash"), "doc_id")


def _term_counts(docs: DataFrame) -> DataFrame:
    """term, n_toxic, n_other over `docs` (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        counts = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            terms = list(counts[0].keys() | counts[1].keys())
            batch = pa.RecordBatch.from_arrays([
                pa.array(terms, pa.string()),
                pa.array([counts[1][t] for t in terms], pa.int64()),
                pa.array([counts[0][t] for t in terms], pa.int64()),
            ], names=["term", "n_toxic", "n_other"])
            for c in counts:
                c.clear()
            return batch

        for batch in smaller(batches, 256):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found: set[str] = set()
                for word in set(_WORD.findall((text or "").lower())):
                    terms = known.get(word)
                    if terms is None:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        terms = known[word] = word_terms(word)
                    found.update(terms)
                counts[toxic].update(found)
            if len(counts[0]) + len(counts[1]) >= _COUNTED:
                yield flush()
        yield flush()

    partial = docs.select("text", "toxic").mapInArrow(count, "term string, n_toxic long, n_other long")
    return partial.groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_other").alias("n_other"))


def choose_terms(counts: DataFrame, n_toxic: int, n_other: int, n_terms: int = N_TERMS) -> list[tuple[str, float]]:
    """(term, log odds) of the most telling terms: by the lower end of the interval around their log odds."""
    a, b = F.col("n_toxic") + 0.5, F.col("n_other") + 0.5
    c, d = n_toxic - F.col("n_toxic") + 0.5, n_other - F.col("n_other") + 0.5
    odds = F.log(a) - F.log(c) - F.log(b) + F.log(d)
    doubt = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    telling = counts.where("n_toxic + n_other >= 3").select("term", odds.alias("odds"), (F.abs(odds) - 2.0 * doubt).alias("sure"))
    top = telling.where("sure > 0").orderBy(F.desc("sure"), "term").limit(n_terms).collect()
    return [(r.term, r.odds) for r in top]


class Voters:
    """Lexicon and pattern voters over term numbers; `lexicon_of`: the lexicon of each term, or -1."""

    def __init__(self, odds: np.ndarray, n_lexicons: int = N_LEXICONS, least: float = 1.0):
        self.lexicon_of = np.full(len(odds), -1)
        speaking = np.flatnonzero(odds >= least)  # in the order of how telling they are
        self.lexicon_of[speaking] = np.arange(len(speaking)) % n_lexicons
        self.n_lexicons = n_lexicons
        self.n = n_lexicons + 1 + N_PATTERNS

    def vote(self, terms: np.ndarray, text: str | None) -> np.ndarray:
        votes = np.zeros(self.n)
        lexicons = self.lexicon_of[terms]
        lexicons = lexicons[lexicons >= 0]
        votes[lexicons] = 1
        votes[self.n_lexicons] = not len(lexicons)
        votes[self.n_lexicons + 1:] = patterns(text or "")
        return votes


def _vote_sums(docs: DataFrame, shared) -> tuple[float, np.ndarray, np.ndarray]:
    """Documents, votes of each voter, joint votes of each two: added up over all documents, a fixed number of sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, voters = shared.value
        reader, n, joint = TermReader(terms), 0, np.zeros((voters.n, voters.n))
        for batch in smaller(batches, 1024):
            texts = batch.column("text").to_pylist()
            votes = np.stack([voters.vote(reader.read(t), t) for t in texts])
            n, joint = n + len(votes), joint + votes.T @ votes
        flat = np.append(joint.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "value"])

    sums = docs.select("text").mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    size = shared.value[1].n
    flat = np.zeros(size * size + 1)
    for cell, value in sums.collect():
        flat[cell] = value
    joint = flat[:-1].reshape(size, size)
    return flat[-1], np.diag(joint).copy(), joint


class LabelModel:
    """Accuracies and correlations of voters under a hidden two-valued class."""

    def __init__(self, n: float, votes: np.ndarray, joint: np.ndarray, share: float):
        rate = votes / max(n, 1)
        cov = joint / max(n, 1) - np.outer(rate, rate)
        spread = share * (1 - share)
        variance = np.diag(cov)
        self.used = np.flatnonzero(variance > 1e-9)
        k = len(self.used)
        c = cov[np.ix_(self.used, self.used)]
        # gap_i^2 = c_ij c_ik / (c_jk p (1 - p)): the median over the pairs j, k that speak clearly.
        gap = np.zeros(k)
        clear = np.abs(c) > 3 * np.sqrt(np.outer(np.diag(c), np.diag(c)) / max(n, 1))
        for i in range(k):
            j, m = np.triu_indices(k, 1)
            ok = (j != i) & (m != i) & clear[j, m] & clear[i, j] & clear[i, m]
            squares = (c[i, j] * c[i, m])[ok] / c[j, m][ok] / spread
            squares = squares[squares > 0]
            gap[i] = np.sqrt(np.median(squares)) if len(squares) else 0.0
        # Only products of gaps are known; voters that vote with the lexicons speak for toxicity.
        lead = c[:, self.used < N_LEXICONS].sum(axis=1) if (self.used < N_LEXICONS).any() else np.ones(k)
        rates = rate[self.used]
        limit = np.minimum(rates / np.where(lead >= 0, share, 1 - share), (1 - rates) / np.where(lead >= 0, 1 - share, share))
        self.gap = np.sign(lead) * np.minimum(gap, np.minimum(limit, 0.98))
        self.given_toxic = np.clip(rates + (1 - share) * self.gap, 1e-4, 1 - 1e-4)
        self.given_other = np.clip(rates - share * self.gap, 1e-4, 1 - 1e-4)
        explained = spread * np.outer(self.gap, self.gap)
        unexplained = c - explained
        own = share * self.given_toxic * (1 - self.given_toxic) + (1 - share) * self.given_other * (1 - self.given_other)
        limit = 0.9 * np.sqrt(np.outer(own, own))
        self.correlation = np.where(np.eye(k, dtype=bool), own, np.where(clear, np.clip(unexplained, -limit, limit), 0.0))
        # Votes are combined linearly, correlated voters sharing their weight.
        values, vectors = np.linalg.eigh(self.correlation)
        inverse = (vectors / np.maximum(values, 0.02 * max(values.max(), 1e-9) if k else 1)) @ vectors.T if k else np.zeros((0, 0))
        self.weights = inverse @ (self.given_toxic - self.given_other)
        middle = (self.given_toxic + self.given_other) / 2
        self.intercept = float(np.log(share / (1 - share)) - self.weights @ middle) if k else float(np.log(share / (1 - share)))

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        return np.clip(votes[:, self.used] @ self.weights + self.intercept, -MOST_LOG_ODDS, MOST_LOG_ODDS)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(rows: list[np.ndarray], goal: np.ndarray, size: int, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft goals over sets of term numbers (accelerated gradient steps)."""
    lengths = np.array([len(r) for r in rows])
    column = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    weight = np.zeros(size + 1)
    weight[-1] = np.log((goal.mean() + 1e-3) / (1 - goal.mean() + 1e-3))
    often = np.bincount(column, minlength=size) if len(column) else np.zeros(size)
    # Terms have different scales: each has a step of its own.
    step = 1 / (0.25 * np.append(often * max(1.0, np.sqrt(lengths.mean() + 1)), len(rows) * max(1.0, np.sqrt(lengths.mean() + 1))) + penalty)
    ahead, before = weight.copy(), weight.copy()
    decay = np.append(np.full(size, penalty), 0.0)
    for k in range(steps):
        score = ahead[-1] + np.bincount(row, ahead[column], minlength=len(rows))
        error = _sigmoid(score) - goal
        slope = np.append(np.bincount(column, error[row], minlength=size), error.sum()) + decay * ahead
        weight = ahead - step * slope
        ahead = weight + (k / (k + 3)) * 0.5 * (weight - before)
        before = weight
    return weight[:-1], float(weight[-1])


class Model:
    """What scoring needs: term numbers, weights, intercept."""

    def __init__(self, terms: dict[str, int], weights: np.ndarray, intercept: float):
        self.terms, self.weights, self.intercept = terms, weights, intercept


def _sample_rows(docs: DataFrame, shared) -> DataFrame:
    """doc_id, terms, votes of the sampled documents."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, terms, voters = shared.value
        reader = TermReader(terms)
        for batch in smaller(batches, 2048):
            rows = []
            for at, i in enumerate(batch.column("doc_id").to_pylist()):
                if i in labels:
                    text = batch.column("text")[at].as_py()
                    found = reader.read(text)
                    rows.append((i, found.tolist(), voters.vote(found, text).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.float64())),
                ], names=["doc_id", "terms", "votes"])

    return docs.select("doc_id", "text").mapInArrow(read, "doc_id long, terms array<long>, votes array<double>")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on `docs` (doc_id, text) and `labels` (doc_id, toxic)."""
    context = docs.sparkSession.sparkContext
    usable = stage(training_labels(labels), "toxic-labels")
    labelled = _labelled(docs, usable)
    # Repeated rows of a document are rows of their own, here as in the counts of terms.
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(usable, "doc_id")
    n_toxic, n_labelled = met.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    share = (n_toxic + 0.5) / (n_labelled + 1)
    if not 0 < n_toxic < n_labelled:
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))))
    chosen = choose_terms(_term_counts(labelled), n_toxic, n_labelled - n_toxic)
    sample = dict(labelled_sample(usable, sample_rows))
    terms = {term: k for k, (term, _) in enumerate(chosen)}
    voters = Voters(np.array([odds for _, odds in chosen]))
    label_model = LabelModel(*_vote_sums(docs, context.broadcast((terms, voters))), share)
    # Repeated ids give several rows; the sample bounds the ids, and at most four rows of one are used.
    rows = stage(_sample_rows(docs, context.broadcast((sample, terms, voters))), "toxic-sample").orderBy("doc_id").limit(4 * sample_rows).toArrow()
    if not rows.num_rows:
        return Model({}, np.zeros(0), float(np.log(share / (1 - share))))
    votes = np.array(rows["votes"].to_pylist())
    label = np.array([sample[i] for i in rows["doc_id"].to_pylist()])
    own_vote = np.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY)) * (2 * label - 1)
    posterior = _sigmoid(label_model.log_odds(votes) + own_vote)
    found = [np.array(t, np.int64) for t in rows["terms"].to_pylist()]
    weights, intercept = fit_logistic(found, posterior, len(terms))
    return Model(terms, weights, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `score` (0 to 1) and `predicted` (1 from 0.5 on). Columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score", "predicted")
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader = TermReader(own.terms)
        for batch in smaller(batches, 1024):
            odds = np.array([own.intercept + own.weights[reader.read(t)].sum() for t in batch.column("text").to_pylist()])
            value = _sigmoid(odds)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(value), pa.array((value >= 0.5).astype("i4"))], names=[*names, "score", "predicted"]
            )

    return kept.mapInArrow(run, schema)
