"""Line dedup on shifted passages and hard rows, against a brute-force version."""

import hashlib
import random

from traincover.llm import linededup

DOCS = "doc_id long, text string, chunks string"


def _cut(text):
    lines, chunks, hashes = (text or "").split("\n"), [], []
    for i, line in enumerate(lines):
        hashes.append(int(hashlib.md5(line.encode()).hexdigest()[:7], 16))
        rolled = sum(h * 31**k for k, h in enumerate(reversed(hashes[-3:]))) % 2147483647
        if i == 0 or rolled % 4 == 0:
            chunks.append([])
        chunks[-1].append(line)
    return chunks


def _brute(rows):
    """(doc_id, n_lines, removed_lines, removed_chunks, text) of rows (doc_id, text): the first occurrence stays."""
    cut = {row: _cut(row[1]) for row in rows}
    first = {}
    for row in sorted(cut, key=lambda r: (r[0] is not None, r[0] or 0)):
        for place, chunk in enumerate(cut[row]):
            first.setdefault("\n".join(chunk), (row, place))
    out = []
    for row in rows:
        gone = [c for p, c in enumerate(cut[row]) if len(c) > 1 and first["\n".join(c)] != (row, p)]
        left = [c for p, c in enumerate(cut[row]) if len(c) < 2 or first["\n".join(c)] == (row, p)]
        out.append((row[0], sum(map(len, cut[row])), sum(map(len, gone)), len(gone), "\n".join("\n".join(c) for c in left)))
    return out


def _rows(seed):
    pick = random.Random(seed)
    passage = [f"shared line {i} é" for i in range(60)]
    own = lambda k: [f"own {k} {i}" for i in range(pick.randint(0, 9))]
    texts = {k: own(k) + (passage if k % 3 else []) + own(-k - 1) for k in range(30)}
    texts[3] = passage * 4  # repeated within one text
    rows = [(k, "\n".join(t)) for k, t in texts.items()]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "one line"), (104, "x\r\n" * 3000), (None, "\n".join(passage)), rows[5], rows[5]]


def test_equals_brute_force(spark, monkeypatch):
    rows = _rows(41)
    docs = spark.createDataFrame([(*row, "x") for row in rows], DOCS).repartition(4)
    want = sorted(_brute(rows), key=repr)
    assert sorted(map(tuple, linededup.line_dedup(docs).collect()), key=repr) == want
    monkeypatch.setattr(linededup, "ROWS_PER_KEY", 2)  # many keys for each repeated chunk
    assert sorted(map(tuple, linededup.line_dedup(docs).collect()), key=repr) == want


def test_most_of_a_shifted_passage_goes_and_own_lines_stay(spark):
    rows = [row for row in _rows(42) if row[0] is not None and row[0] < 30]
    left = {r.doc_id: r for r in linededup.line_dedup(spark.createDataFrame([(*row, "x") for row in rows], DOCS)).collect()}
    for k, text in rows:
        own = lambda t: [x for x in t.split("\n") if x.startswith("own")]
        assert own(left[k].text) == own(text)
        assert k < 2 or k % 3 == 0 or left[k].removed_lines > 25


def test_empty_table_and_bytes_decide(spark, monkeypatch):
    assert linededup.line_dedup(spark.createDataFrame([], DOCS)).collect() == []
    # Under a digest that all chunks share, bytes alone tell which are equal to the one that stays.
    monkeypatch.setattr(linededup.F, "sha2", lambda column, bits: linededup.F.lit("same"))
    rows = [(1, "a\nb", "x"), (2, "a\nb", "x"), (3, "a\nc", "x")]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(rows, DOCS), divisor=2**30).collect()}
    assert got == {1: "a\nb", 2: "", 3: "a\nc"}
