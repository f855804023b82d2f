"""Jaccard join, top-k search and SentencePiece coding against brute force and the library."""

import random
from collections import defaultdict

import numpy as np
import pytest

from traincover.llm import jaccard, mtree, sentpiece

DOCS = "doc_id long, text string, class int, shingles string"


def _shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i: i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def _components(rows, linked):
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    smallest = defaultdict(lambda: 1 << 60)
    for i, (key, _) in enumerate(rows):
        smallest[top(i)] = min(smallest[top(i)], key)
    return [smallest[top(i)] for i in range(len(rows))]


def _check_join(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(4)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    sets = [_shingles(t) for _, t in rows]
    linked = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    want = _components(rows, linked)
    # Rows that share a doc_id and have no words are nobody's copies, but carry one id.
    assert got == sorted((i, len(s), c) for (i, _), s, c in zip(rows, sets, want))


def test_join_with_null_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    # 7 and 9 link only through a text that rows without a doc_id alone hold; two more texts have no doc_id at all.
    chain = [(9, near(0, 59)), (None, near(0)), (None, near(0)), (7, near())]
    other = " ".join(f"v{i}" for i in range(40))
    rows = chain + [(None, other), (None, other + " v40"), (None, None), (None, "alone"), (3, "not alone")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([
        (9, 56, 7), (None, 56, 7), (None, 56, 7), (7, 56, 7), (None, 36, None), (None, 37, None), (None, 0, None), (None, 1, None), (3, 1, 3),
    ], key=repr)


def test_join_of_chains_copies_and_short_texts(spark):
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, key = [], 1000
    for _ in range(25):
        base = pick.choices(vocabulary, k=pick.choice([3, 5, 6, 20, 60, 120]))
        for _ in range(pick.randint(1, 6)):
            if pick.random() < 0.7:  # a drift: neighbours link, ends may not
                base = list(base)
                base[pick.randrange(len(base))] = pick.choice(vocabulary)
            key -= pick.randint(1, 3)
            rows.append((key, pick.choice([" ", "\n", " \t"]).join(base).replace("w1", pick.choice(["w1", "W1"]))))
    rows += [(2, None), (3, ""), (4, " \n"), (5, "one"), (6, "ONE "), (7, "a b c d e"), (8, "a b c d"), (9, "É"), (10, "é")]
    rows += [(11, "word " * 30_000), (12, "word " * 29_000)]
    _check_join(spark, rows)


def test_join_when_hubs_leave_links_open(spark):
    """A long common part with own ends of different lengths: many texts share prefixes, some only link through others."""
    pick = random.Random(13)
    common = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(pick.randint(0, 26))]
        rows.append((i + 1, " ".join(common + own)))
    _check_join(spark, rows)


def test_join_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.near_duplicates(empty).collect() == []
    one = jaccard.near_duplicates(spark.createDataFrame([(7, "a b c d e f", 1, "")], DOCS)).collect()
    assert [tuple(r) for r in one] == [(7, 2, 7)]


def _brute(rows, every, k):
    usable = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in usable:
        if q is None or q % every:
            continue
        scored = sorted((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, v string").repartition(3)


@pytest.mark.parametrize("trees", [1, 5])
def test_topk_is_exact(spark, trees):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + 0.2 * rng.normal(size=12)).astype("f4").tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(80)]  # one vector, many rows
    rows += [(3000, None), (3020, [None] + rows[0][1][1:]), (3040, [float("nan")] * 12), (3060, [float("inf")] + rows[0][1][1:])]
    rows += [(3080, [0.0] * 12), (3100, [1e-9] * 12), (3101, [-0.5] * 12)]
    got = mtree.topk(mtree.quantised(_table(spark, rows)), mtree.F.expr("vec_id % 20 = 0"), k=20, trees=trees, block=50)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == _brute(rows, 20, 20)


def test_topk_of_few_rows(spark):
    rows = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert [tuple(r) for r in mtree.query_table(_table(spark, rows)).orderBy("rank").collect()] == [(20, 1, 1, 2048), (20, 2, 2, 2048)]
    assert mtree.query_table(_table(spark, [])).collect() == []


def test_bounds_spare_computations():
    rng = np.random.default_rng(4)
    points = np.floor(64 * (rng.normal(size=(20, 8))[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 8))))
    points = np.unique(points, axis=0)
    lifted = mtree._lifted(points)
    builder = mtree.Builder(lifted, 1)
    root = builder.build(np.arange(len(points)), lifted[0])
    rows = [{
        "node": 0 if n == root else n + 1, "leaf": leaf, "n": len(r), "objects": lifted[r].tobytes(), "radii": radii.tobytes(),
        "to_parent": d.tobytes(), "children": (c + 1).astype("i4").tobytes(), "ids": [[int(i)] for i in r] if leaf else [],
    } for n, (leaf, r, radii, d, c) in enumerate(builder.nodes)]
    tree = mtree.Tree(mtree.pa.Table.from_pylist(rows))
    for q in range(0, 200, 10):
        tree.computed = 0
        got = tree.search(points[q], None, 5)
        scores = points @ points[q]
        want = sorted(((-int(s), i) for i, s in enumerate(scores)))[:5]
        assert [(-s, i) for s, i in got] == want
        assert tree.computed < 0.6 * len(points)


def _tree_of(points, ids):
    lifted = mtree._lifted(points)
    builder = mtree.Builder(lifted, 1)
    root = builder.build(np.arange(len(points)), lifted[0])
    return mtree.Tree(mtree.pa.Table.from_pylist([{
        "node": 0 if n == root else n + 1, "leaf": leaf, "n": len(r), "objects": lifted[r].tobytes(), "radii": radii.tobytes(),
        "to_parent": d.tobytes(), "children": (c + 1).astype("i4").tobytes(), "ids": [ids[i] for i in r] if leaf else [],
    } for n, (leaf, r, radii, d, c) in enumerate(builder.nodes)]))


def test_a_group_of_queries_opens_a_page_once(monkeypatch):
    rng = np.random.default_rng(6)
    points = np.unique(np.floor(64 * rng.normal(size=(3000, 16))), axis=0)
    tree, opened = _tree_of(points, [[i] for i in range(len(points))]), []
    pop = mtree.heapq.heappop
    monkeypatch.setattr(mtree.heapq, "heappop", lambda heap: (opened.append(1), pop(heap))[1])
    query, places, scores = tree.search_all(points[:200], list(range(200)), 20)
    products = (points[:200] @ points.T).astype(int)
    for q in range(200):
        want = sorted((-s, i) for i, s in enumerate(products[q].tolist()) if i != q)[:20]
        found = zip((-scores[query == q]).tolist(), tree.ids.take(mtree.pa.array(places[query == q])).to_pylist())
        assert list(found) == want
    assert len(opened) < 10 * len(tree.pages)  # one query after another: nearly 200 times


def test_groups_meet_ties_repeated_and_null_ids():
    rng = np.random.default_rng(8)
    points = np.unique(rng.integers(-1, 2, size=(900, 4)).astype(float), axis=0)  # 81 vectors, many equal scores
    ids = [sorted(rng.integers(0, 60, 30).tolist())[:21] + ([None] if i % 5 == 0 else []) for i in range(len(points))]
    ids = [some + [3, 3] for some in ids]  # an id that every vector has more than once
    queries, own = points[rng.integers(0, len(points), 300)], [3, None, *rng.integers(0, 70, 298).tolist()]
    tree = _tree_of(points, ids)
    query, places, scores = tree.search_all(queries, own, 7)
    for q in range(300):
        rows = [(-int(s), i is None, i or 0) for s, some in zip(points @ queries[q], ids) for i in some if i != own[q]]
        found = zip((-scores[query == q]).tolist(), tree.ids.take(mtree.pa.array(places[query == q])).to_pylist())
        assert [(s, i is None, i or 0) for s, i in found] == sorted(rows)[:7]


@pytest.mark.parametrize("seed", range(4))
def test_equal_queries_wait_for_one_page_at_one_distance(monkeypatch, seed):
    monkeypatch.setattr(mtree, "PAGE", 4)
    monkeypatch.setattr(mtree, "FAN", 4)  # many levels
    points = np.unique(np.floor(64 * np.random.default_rng(seed).normal(size=(400, 16))), axis=0)
    tree = _tree_of(points, [[i] for i in range(len(points))])
    asked = np.repeat(np.arange(0, len(points), 10), 6)
    own = [int(i) if n % 6 else -1 for n, i in enumerate(asked)]  # the first of six meets its own row
    query, places, scores = tree.search_all(points[asked], own, 10)
    products = (points[asked] @ points.T).astype(int)
    for q in range(len(asked)):
        want = sorted((-s, i) for i, s in enumerate(products[q].tolist()) if i != own[q])[:10]
        found = zip((-scores[query == q]).tolist(), tree.ids.take(mtree.pa.array(places[query == q])).to_pylist())
        assert list(found) == want


def test_a_cut_tree_is_searched_in_parts(monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 8)
    monkeypatch.setattr(mtree, "FAN", 4)
    rng = np.random.default_rng(12)
    points = np.unique(np.floor(64 * rng.normal(size=(700, 5))), axis=0)
    lifted = mtree._lifted(points)
    builder = mtree.Builder(lifted, 1)
    root = builder.build(np.arange(len(points)), lifted[0])
    pages = mtree.pa.Table.from_pylist([{
        "node": 0 if n == root else n + 1, "leaf": leaf, "n": len(r), "objects": lifted[r].tobytes(), "radii": radii.tobytes(),
        "to_parent": d.tobytes(), "children": (c + 1).astype("i4").tobytes(), "ids": [[int(i) % 300 or None] for i in r] if leaf else [],
    } for n, (leaf, r, radii, d, c) in enumerate(builder.nodes)])
    pages = pages.take(rng.permutation(len(pages)))
    own = [int(i) for i in range(0, 200)]
    found = mtree._Found(len(own), 6)
    for a in range(0, len(pages), 23):
        tree = mtree.Tree(pages.slice(a, 23))
        query, places, scores = tree.search_all(points[:200], own, 6, found.floors())
        found.take(query, scores, tree.ids.take(mtree.pa.array(places)))
    got = list(zip(found.query.tolist(), found.scores.tolist(), found.ids.to_pylist()))
    want = []
    for q, i in enumerate(own):
        rows = sorted((-int(s), at % 300 == 0, at % 300) for at, s in enumerate(points @ points[q]) if at % 300 != i or at % 300 == 0)
        want += [(q, -s, i or None) for s, _, i in rows[:6]]
    assert got == want


def test_topk_when_ids_repeat_or_are_null(spark):
    rng = np.random.default_rng(14)
    vectors = [rng.normal(size=4).astype("f4").tolist() for _ in range(12)]
    rows = [(20, vectors[0])] * 9 + [(i, vectors[0]) for i in range(1, 13)] + [(5, v) for v in vectors] + [(None, v) for v in vectors * 30]
    got = mtree.topk(mtree.quantised(_table(spark, rows)), mtree.F.expr("vec_id = 20"), k=4, trees=3)
    usable = [(i, np.floor(64 * np.array(v))) for i, v in rows]
    best = sorted((-int(usable[0][1] @ w), i is None, i or 0) for i, w in usable if i != 20)
    want = sorted((s, none, i) for s, none, i in best * 9)[:4]  # each of the nine rows meets the same ones
    assert [(-r.score, r.vec_id is None, r.vec_id or 0) for r in got.orderBy("rank").collect()] == want
    parts = mtree.build_index(mtree.quantised(_table(spark, rows)), 3, 4).where("leaf").groupBy("tree").sum("n").collect()
    assert sum(r[1] for r in parts) == 12 and len(parts) > 1  # an entry for each vector, in several trees


def test_a_block_reads_the_index_where_it_lies(spark):
    rows = [(i, v) for i, v in enumerate(np.random.default_rng(15).normal(size=(200, 4)).astype("f4").tolist())]
    index = mtree.stage(mtree.build_index(mtree.quantised(_table(spark, rows)), 40, 20), "mtree-test")
    found = mtree.search(spark.sparkContext.broadcast({}), index)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism


@pytest.fixture(scope="module")
def model():
    return sentpiece.read_model()


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_codec_agrees_with_the_library(model, library):
    codec = sentpiece.codec(model)
    pick = random.Random(17)
    letters = "ab  \n\té▁<>0x😀梦的aeithno...---''　\x00\r"
    texts = ["", " ", "▁", "<s></s><unk>", "<0x41>", "a" * 3000, " " * 100, "\n\n \n"]
    texts += ["".join(pick.choices(letters, k=pick.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(library.id_to_piece(pick.randrange(259, 32000)) for _ in range(pick.randint(1, 8))) for _ in range(3000)]
    for text in texts:
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)


def test_round_trip_of_a_table(spark, model):
    rows = [(1, "A text.\n  Two"), (2, None), (3, ""), (None, "x" * 200_000), (1, "A text.\n  Two")]
    docs = spark.createDataFrame([(*r, "old", 5) for r in rows], "doc_id long, text string, ids string, n int")
    got = sentpiece.round_trip(docs, model).collect()
    assert [r.decoded for r in got] == [t or "" for _, t in rows]
    assert [r.n for r in got] == [5] * 5
    both = sentpiece.decode(sentpiece.encode(docs, model), model).collect()
    assert [(r.ids, r.decoded) for r in both] == [(r.ids, r.decoded) for r in got]
    assert sentpiece.round_trip(docs.limit(0), model).collect() == []
    assert sentpiece.codec(model).decode([1, 0, 2]) == " ⁇ "[1:]


def test_sentencepiece_remembers_a_bounded_number_of_segments():
    codec = sentpiece.Codec(sentpiece.read_model())
    texts = [" ".join(f"n{i}" for i in range(at, at + 1000)) for at in range(0, 300_000, 1000)]
    codec.encode(texts[0])
    coded = [codec.encode(text) for text in texts]
    assert len(codec.remembered) <= 1 << 17 and len(codec.older) <= 1 << 17
    assert [codec.decode(ids) for ids in coded[-3:]] == texts[-3:]
    assert sentpiece.Codec(sentpiece.read_model()).encode(texts[-1]) == coded[-1]


def test_sentencepiece_cuts_punctuation_off_and_keeps_ids_packed(model, library):
    codec = sentpiece.Codec(model)
    text = " ".join(f"Wort{mark}" for mark in (".", ",", "!", ").", "...", "%%%", "’,", "².", "\r.", "7", "x2", "\n")) + "x²=y_z «Ja», …"
    ids = codec.packed(text)
    assert isinstance(ids, bytes) and memoryview(ids).cast("i").tolist() == library.encode(text)
    assert [s for s in codec.remembered if "Wort" in s] == ["▁Wort", "▁Wortx"]  # one segment whatever follows the word
    assert all(type(found) is bytes for found in codec.remembered.values())


def test_bitmaps_reach_the_driver_once_and_only_where_they_hold_a_bit(spark, monkeypatch):
    values = [None, 0, 7, *range(1, 3000)]
    few = spark.createDataFrame([(v,) for v in values], "v long").repartition(8)
    many = spark.range(0, 800_000, 1, 8).select((jaccard.F.col("id") % 400_000).alias("v"))
    sent = []
    frame = type(few)
    collect, iterate = frame.collect, frame.toLocalIterator
    monkeypatch.setattr(frame, "collect", lambda self: [sent.append(len(r[-1])) or r for r in collect(self)])
    monkeypatch.setattr(frame, "toLocalIterator", lambda self, *a: (sent.append(len(r[-1])) or r for r in iterate(self, *a)))
    for table, marked, bits, most in ((few, [v or 0 for v in values], 1 << 26, 20_000), (many, range(400_000), 1 << 20, 1 << 17), (few, [v or 0 for v in values], 1 << 10, 1 << 7)):
        sent.clear()
        expected = np.zeros(bits, bool)
        expected[jaccard._mark(np.array(marked), bits)] = True
        assert jaccard._bitmap(table, "v", bits) == np.packbits(expected).tobytes()
        assert 0 < sum(sent) <= most
    assert jaccard._bitmap(few.limit(0), "v", 1 << 20) == bytes(1 << 17)
