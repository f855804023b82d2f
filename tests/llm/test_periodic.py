"""Runs of periodic words against a plain search over all periods and stretches."""

import hashlib
import random
import re
import zlib

import numpy as np

from traincover.llm import periodic


def _runs(w):
    n, out = len(w), set()
    for q in range(1, n):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                if next(p for p in range(1, q + 1) if all(w[k] == w[k + p] for k in range(i, i + length - p))) == q:
                    out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = _runs(w)
    dropped = set()
    for s, length, q in runs:
        dropped.update(range(s + q, s + length))
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_runs_of_random_and_planted_words():
    rnd = random.Random(5)
    for _ in range(1500):
        n = rnd.randrange(0, 100)
        w = [rnd.randrange(rnd.choice([1, 2, 3, 20])) for _ in range(n)]
        if rnd.random() < 0.5 and n > 4:
            a = rnd.randrange(n)
            p = rnd.randrange(1, max(2, (n - a) // 3 + 1))
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        assert periodic.runs_of(periodic.mix(periodic.numbered(w) + np.uint64(1))) == _runs(w)


def test_nested_periodic_blocks():
    rnd = random.Random(8)
    for _ in range(60):
        inner = [rnd.randrange(3) for _ in range(rnd.randrange(1, 4))] * rnd.randrange(1, 12)
        block = inner + [rnd.randrange(50) for _ in range(rnd.randrange(0, 5))]
        w = [rnd.randrange(9) for _ in range(rnd.randrange(0, 20))] + block * rnd.randrange(1, 7) + [rnd.randrange(9) for _ in range(5)]
        assert periodic.runs_of(periodic.mix(periodic.numbered(w) + np.uint64(1))) == _runs(w)


def test_query_matches_plain_rules(spark):
    rnd = random.Random(2)
    vocab = ["a", "b", "c", "Ab", "xé", "1"]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 80))), "x") for i in range(300)]
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "a a a a a a a", "x"), (None, None, "x"), (7, "a\tb  a\nb a b a b a b", "x")]
    rows += [(8, " ".join(["w"] * 5000 + [str(i) for i in range(3000)] * 5), "x")]
    rows += rows[:3]
    planted = [i for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert planted  # some rows have a planted repetition
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted((tuple(r) for r in periodic.query_table(docs).collect()), key=repr)
    assert got == sorted((_plain(i, t) for i, t, _ in rows), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert periodic.query_table(docs).collect() == []
