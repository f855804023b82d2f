"""Packing: every id in exactly one piece, sequences gapless and within the window, ids as the library gives them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from traincover.llm import packing


def _ids(text):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    return [*coder.encode(text or "", add_special_tokens=False).ids, 0]


def _check(rows, got, window=1024):
    want = {}
    for i, (doc_id, text, *_) in enumerate(rows):
        want.setdefault(doc_id, []).append(_ids(text))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, docs in want.items():
        pieces = sorted(by_doc[doc_id], key=lambda r: (r.start, r.ids_crc32))
        # Repeated doc_ids: each of its rows is covered once, so each start occurs as often as rows reach it.
        covered = Counter()
        for r in pieces:
            assert r.length > 0
            covered.update(range(r.start, r.start + r.length))
            ids = next(d for d in docs if len(d) == r.doc_tokens)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start: r.start + r.length], "<u4").tobytes())
        assert covered == Counter(i for d in docs for i in range(len(d)))
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        assert seq[0].padded_length == (at if at & (at - 1) == 0 else window)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_pieces_cover_every_id_once(spark):
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "<|endoftext|>", "é", "数据", "\n\n", "  "]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 50, 300, 700]))), "x", 1) for i in range(120)]
    rows += [(500, None, "x", 1), (501, "", "x", 1), (None, "no id", "x", 1), (502, "word " * 6000, "x", 1)]
    rows += rows[:5]  # repeated rows are documents of their own
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, _key int").repartition(3)
    _check(rows, packing.pack(docs).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs).collect() == []


def test_plan_fills_windows_and_holds_to_the_histogram():
    hist = {100: 50, 924: 40, 512: 9, 300: 30, 424: 20, 7: 3}
    chosen = packing.plan(hist)
    used = Counter()
    for combo, k in chosen:
        assert sum(combo) == 1024 and len(combo) <= 3 and k > 0
        for length in combo:
            used[length] += k
    assert all(used[length] <= hist[length] for length in used)
    assert used[100] == 40 and used[924] == 40 and used[512] == 8 and used[300] == 30 and used[424] == 15
