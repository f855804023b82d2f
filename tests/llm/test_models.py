"""Language identification, language-model scores and toxicity: brute force, held-out accuracy, hard cases."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from traincover.llm import langid, ngramlm, toxicity
from traincover.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def _kneser_ney(training, texts):
    split = lambda t: (t or "").encode().lower().split() + [b"</s>"]
    words, pairs = Counter(), Counter()
    for t in map(split, training):
        words.update(t)
        pairs.update(zip([b"<s>"] + t, t))
    total, kinds = sum(words.values()), len(words)
    context, before = defaultdict(lambda: [0, 0, 0, 0]), Counter()
    for (v, w), n in pairs.items():
        context[v][0] += n
        context[v][min(n, 3)] += 1
        before[w] += 1

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not all(n):
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *(min(max(d, 0.05), k + 1) for k, d in enumerate(raw))]

    high, low = discounts(list(pairs.values())), discounts(list(before.values()))
    left = sum(low[min(n, 3)] for n in before.values()) / len(pairs) if pairs else 1.0

    def unigram(w):
        return max(before[w] - low[min(before[w], 3)], 0) / max(len(pairs), 1) + left / (kinds + 1)

    def bigram(v, w):
        if v not in context:
            return unigram(w)
        n, c = pairs[v, w], context[v]
        return max(n - high[min(n, 3)], 0) / c[0] + sum(high[k] * c[k] for k in (1, 2, 3)) / c[0] * unigram(w)

    rows = []
    for t in map(split, texts):
        rows.append((
            len(t), sum(words[w] > 0 for w in t), total, sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in t),
            sum(math.log10(bigram(v, w)) for v, w in zip([b"<s>"] + t, t)),
        ))
    return rows, bigram, words


@pytest.mark.parametrize("partitions", [1, 6])
def test_lm_matches_plain_counting(spark, partitions):
    pick = random.Random(19)
    vocabulary = ["the"] * 200 + [f"w{i}" for i in range(60)] + ["É", "é", "B", "b"]
    rows = [(i, " ".join(pick.choices(vocabulary, k=pick.randint(0, 60))) if pick.random() > 0.05 else None) for i in range(300)]
    rows += [(999, "the " * 50_000), (5, "w1 w1"), (None, "w2"), (None, "unseen words only")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(partitions)
    training = F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 1
    got = sorted((tuple(r)[:6] for r in ngramlm.train_and_score(docs, training).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    want, bigram, words = _kneser_ney([t for i, t in rows if (i or 0) % 3 != 1], [t for _, t in rows])
    want = sorted(((i, *w) for (i, _), w in zip(rows, want)), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4:] == pytest.approx(b[4:], rel=1e-9)
    assert sum(bigram(b"the", w) for w in words) + bigram(b"the", b"\x00") == pytest.approx(1)


def test_lm_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ngramlm.train_and_score(docs, F.lit(False)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score, got[1].score) == (3, 0, 0, 0.0, 0.0)
    assert ngramlm.train_and_score(docs.limit(0), F.lit(True)).collect() == []


def test_lm_files_are_removed(spark):
    from traincover.session import staging_root
    import os

    listed = lambda: {x for x in os.listdir(staging_root(spark).removeprefix("file:")) if x.startswith("traincover-lm-") and "words" not in x}
    before = listed()
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    ngramlm.train_and_score(docs, F.lit(True)).collect()
    assert listed() <= before


def test_languages_of_held_out_documents(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    rows = [r for r in QUERIES["op1_language_id"](spark, SF).collect() if r.held_out]
    assert len(rows) > 250
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def _languages(spark):
    pick = random.Random(23)
    syllables = {"aa": ["ka", "ti", "mo"], "bb": ["sch", "ung", "ver"], "ru": ["да", "не", "ма"]}
    make = lambda lang, n: " ".join("".join(pick.choices(syllables[lang], k=3)) for _ in range(n))
    rows = [(make(lang, 60), lang) for lang in syllables for _ in range(20)] + [(None, "aa"), ("xyz", None)]
    return langid.train(spark.createDataFrame(rows, "text string, lang string")), make


def test_spans_of_mixed_text(spark):
    model, make = _languages(spark)
    a, b = make("aa", 40), make("bb", 25)
    texts = [a + " 12 " + b, make("ru", 5), None, "", "12 !! _", "kati " * 20_000, "मम", make("ru", 20) + " " + make("aa", 5),
             "½ ² ① ٣ Ⅻ"]  # numerals of other categories are no letters
    docs = spark.createDataFrame(
        [(i, t, "old", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double"
    )
    got = {r.doc_id: r for r in langid.label_languages(docs, model).collect()}
    assert [(s.lang, s.start, s.end) for s in got[0].lang_spans] == [("aa", 0, len(a)), ("bb", len(a) + 4, len(texts[0]))]
    assert got[1].lang_pred == "ru" and got[5].lang_pred == "aa" and len(got[5].lang_spans) == 1
    assert [(got[i].lang_pred, got[i].score, got[i].lang_spans) for i in (2, 3, 4, 8)] == [("und", 0.0, [])] * 4
    assert got[6].lang_pred in ("aa", "bb", "ru")
    assert [s.lang for s in got[7].lang_spans] == ["ru", "aa"] and 0 < got[7].score < 1
    assert langid.label_languages(docs.limit(0), model).collect() == []


def test_viterbi_is_optimal(spark):
    model, make = _languages(spark)
    labeller = langid.Labeller(model, penalty=4.0)
    pick = random.Random(29)
    texts = [" ".join(make(pick.choice(["aa", "bb"]), 1) for _ in range(n)).split() for n in (1, 2, 3, 7, 9)]
    rows = np.split(labeller.word_scores([w for t in texts for w in t]), np.cumsum([len(t) for t in texts])[:-1])
    worth = lambda r, path: sum(labeller.table[x, l] for x, l in zip(r, path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:]))
    from itertools import product

    for r, path in zip(rows, labeller.label(rows)):
        best = max(worth(r, p) for p in product(range(3), repeat=len(r))) if len(r) < 8 else worth(r, path)
        assert worth(r, path) == pytest.approx(best)


def test_languages_without_training(spark):
    model = langid.train(spark.createDataFrame([("a", None)], "text string, lang string"))
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.label_languages(docs, model).collect()] == [("und", 0.0)]


def _comments(spark, n=1500):
    pick = random.Random(31)
    clean, bad = [f"word{i}" for i in range(400)], ["vilegrub", "slagmop", "dreckpate", "foulnik"]
    docs, labels = [], []
    for i in range(n):
        toxic = pick.random() < 0.12
        tokens = pick.choices(clean, k=30)
        if toxic:
            for _ in range(3):
                tokens[pick.randrange(30)] = pick.choice(bad) + pick.choice(["", "s", "ing"])
        docs.append((i, " ".join(tokens), int(toxic), "x"))
        if i % 2:
            labels.append((i, int(toxic)))
    docs += [(9001, None, 0, "x"), (9002, "", 0, "x"), (9003, "clean " * 50_000, 0, "x"), (None, "word1", 0, "x")]
    labels += [(1, None), (77_777, 1), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, truth int, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_unseen_documents(spark):
    docs, labels = _comments(spark)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == 1504
    unseen = [r for r in rows if r.doc_id is not None and r.doc_id < 9000 and r.doc_id % 2 == 0]
    assert np.mean([r.predicted for r in unseen if r.truth]) > 0.95
    assert np.mean([r.predicted for r in unseen if not r.truth]) < 0.01
    scores = {r.doc_id: r.score for r in rows}
    assert scores[9001] == scores[9002] < 0.5 and scores[9003] < 0.5
    assert all((r.score >= 0.5) == (r.predicted == 1) and 0 <= r.score <= 1 for r in rows)


def test_toxic_terms_come_from_all_labelled_rows(spark):
    docs, labels = _comments(spark)
    small = toxicity.train(docs, labels, sample_rows=60)
    assert set(small.terms) == set(toxicity.train(docs, labels).terms)
    assert {"vilegrub", "slagmop", "dreckpate", "foulnik"} <= set(small.terms)


def test_toxicity_without_labels(spark):
    docs, labels = _comments(spark, 50)
    rows = toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()
    assert {round(r.score, 6) for r in rows} == {0.5}
    only_clean = toxicity.train(docs, labels.where("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, only_clean).collect())
    assert toxicity.score(docs.limit(0), only_clean).collect() == []


def test_label_model_finds_accuracies_and_a_correlated_pair():
    rng = np.random.default_rng(37)
    n, share = 200_000, 0.2
    truth = rng.random(n) < share
    hit, noise = np.array([0.8, 0.7, 0.6, 0.75, 0.5, 0.5]), np.array([0.05, 0.1, 0.05, 0.2, 0.02, 0.02])
    votes = rng.random((n, 6)) < np.where(truth[:, None], hit, noise)
    votes[:, 5] = np.where(rng.random(n) < 0.8, votes[:, 4], votes[:, 5])  # the last two vote together
    joint = (votes.T.astype(float) @ votes)
    model = toxicity.LabelModel(n, np.diag(joint).copy(), joint, share)
    assert model.gap[:4] == pytest.approx(hit[:4] - noise[:4], abs=0.05)
    scaled = model.correlation / np.sqrt(np.outer(np.diag(model.correlation), np.diag(model.correlation)))
    off = np.abs(scaled - np.diag(np.diag(scaled)))
    assert off[4, 5] == off.max() > 0.4
    assert np.mean((model.log_odds(votes.astype(float)) > 0) == truth) > 0.93


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = [r for r in QUERIES["op10_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.96
    assert np.mean([r.predicted for r in rows if not truth[r.doc_id]]) < 0.01


def test_toxicity_remembers_a_bounded_number_of_words():
    word = lambda i: "w" + "".join(chr(97 + int(d)) for d in str(i))
    reader = toxicity.TermReader({word(7): 0, "wb*": 1, "wbaa*": 2})
    for at in range(0, 100_000, 1000):
        found = reader.read(" ".join(map(word, range(at, at + 1000))))
        plain = {t for i in range(at, at + 1000) for t in toxicity.word_terms(word(i)) if t in reader.terms}
        assert set(found) == {reader.terms[t] for t in plain}
        assert len(reader.known) <= 1 << 16
