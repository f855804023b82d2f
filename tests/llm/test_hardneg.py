"""Hard-negative mining against a plain brute force, and the packed products against numpy."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from traincover.llm import hardneg

ROWS = "vec_id long, label int, embedding array<float>, rank string, key int"


def _brute(rows, anchor_every=100, k=5):
    usable = []
    for n, (vid, label, vec, *_) in enumerate(rows):
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        usable.append((n, vid, label, [math.floor(256 * float(np.float32(x))) for x in vec]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda r: (-r[2], r[1] is None, r[1] or 0)
    out = []
    for n, vid, label, vec in usable:
        if vid is None or vid % anchor_every:
            continue
        scored = [(m, w, dot(vec, v), lab) for m, w, lab, v in usable if m != n]
        positives = sorted((s for s in scored if s[3] == label), key=order)[:k]
        for _, pid, ps, _ in positives:
            window = sorted((s for s in scored if s[3] != label and 80 * ps <= 100 * s[2] <= 100 * ps), key=order)[:k]
            out += [(vid, pid, r + 1, s[1], ps, s[2]) for r, s in enumerate(window)]
    return sorted(out, key=repr)


def _mine(spark, rows, parts=3):
    table = spark.createDataFrame(rows, ROWS).repartition(parts)
    got = hardneg.mine(table, F.col("vec_id") % 100 == 0, 5, 5, chunk=3).collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_packed_products_are_exact():
    rng = np.random.default_rng(1)
    for scale, width in ((256, 64), (1 << 20, 7), (1 << 31, 2)):  # 4, 8 and 9-byte fields
        c = rng.integers(-scale, scale, (50, width))
        a = rng.integers(-scale, scale, width)
        batch = pa.RecordBatch.from_pydict({
            "row_key": np.arange(50), "vec_id": np.arange(50), "label": np.zeros(50, np.int64), "v": c.tolist(),
        })
        block = hardneg.Block(batch, width)
        bias = int(np.abs(a).max())
        packed, size = block.packed(bias)
        want = [sum(int(x) * int(y) for x, y in zip(a, row)) for row in c]
        assert hardneg.packed_scores(a, bias, block, packed, size).tolist() == want


def test_mining_matches_brute_force_with_ties_repeats_and_nulls(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        vec = [rnd.choice([-0.5, -0.25, 0.0, 0.25, 0.5, rnd.uniform(-1, 1)]) for _ in range(6)]
        rows.append((i, rnd.randrange(4), vec, "x", 1))
    rows += [rows[100], rows[200]]                      # repeated rows: anchors twice, each its twin's candidate
    rows += [(None, 1, [0.5] * 6, "x", 1), (None, 2, [0.25] * 6, "x", 1)]  # null ids: last among equal scores
    rows += [(700, None, [0.1] * 6, "x", 1), (800, 1, None, "x", 1), (900, 1, [0.1, None, 0.2, 0.0, 0.0, 0.0], "x", 1)]
    rows += [(1000, 2, [0.1, float("nan"), 0.0, 0.0, 0.0, 0.0], "x", 1), (1100, 3, [float("inf")] * 6, "x", 1)]
    rows += [(1200, 2, [0.5, 0.5], "x", 1)]             # shorter: its missing components count as zeros
    assert _mine(spark, rows) == _brute(rows)


def test_empty_and_anchorless_tables(spark):
    assert _mine(spark, []) == []
    assert _mine(spark, [(1, 1, [0.5], "x", 1), (2, 1, [0.5], "x", 1)]) == []
    # An anchor alone in its label has no positives; no negatives come without one.
    assert _mine(spark, [(100, 1, [0.5], "x", 1), (2, 2, [0.5], "x", 1)]) == []


def test_query_relabels_every_seventh(spark):
    rows = [(i, i % 3, [((i * 7) % 11) / 11, ((i * 5) % 13) / 13], "x", 1) for i in range(300)]
    table = spark.createDataFrame(rows, ROWS)
    got = sorted((tuple(r) for r in hardneg.query_table(table).collect()), key=repr)
    moved = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v, *rest) for i, lab, v, *rest in rows]
    assert got == _brute(moved)
