"""The similarity join against brute force, with forced ties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from traincover.operators import ann, topk
from traincover.functions.vectors import inner_product


def unit(rng, n, d):
    x = rng.standard_normal((n, d)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, queries, corpus, places=None, partitions=3):
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)],
                              "sample_id string, embedding array<float>")
    places = [1] * len(corpus) if places is None else places
    c = spark.createDataFrame([(int(p), i, v.tolist()) for i, (p, v) in enumerate(zip(places, corpus))],
                              "version_pos int, index_id long, embedding array<float>")
    return q, c.repartition(partitions)


def brute(queries, corpus, k, places=None):
    places = np.ones(len(corpus), int) if places is None else np.asarray(places)
    out = {}
    for i, q in enumerate(queries):
        score = np.round(corpus.astype(np.float64) @ q.astype(np.float64), topk.DECIMALS)
        order = np.lexsort((np.arange(len(corpus)), places, -score))[:k]
        out[f"q{i}"] = [(r + 1, int(j), round(float(score[j]), 7)) for r, j in enumerate(order)]
    return out


def collected(result):
    out = {}
    for row in result.orderBy("sample_id", "rank").collect():
        out.setdefault(row.sample_id, []).append((row.rank, row.index_id, round(row.score, 7)))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    base = unit(rng, 150, 16)
    corpus = np.concatenate([base, base, base])  # every vector three times
    return unit(rng, 23, 16), corpus[rng.permutation(len(corpus))]


@pytest.mark.parametrize("partitions", [1, 3, 8])
@pytest.mark.parametrize("k", [1, 7])
def test_matches_brute_force(spark, data, partitions, k):
    queries, corpus = data
    q, c = frames(spark, queries, corpus, partitions=partitions)
    assert collected(topk.topk(q, c, k)) == brute(queries, corpus, k)


def test_ties_go_to_the_earlier_version(spark, data):
    queries, corpus = data
    places = np.arange(len(corpus)) % 4 + 1
    q, c = frames(spark, queries, corpus, places)
    assert collected(topk.topk(q, c, 7)) == brute(queries, corpus, 7, places)


def test_blocks_give_the_same_result(spark, data, monkeypatch):
    queries, corpus = data
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 5)
    monkeypatch.setattr(topk, "FRAGMENT_ROWS", 40)
    q, c = frames(spark, queries, corpus)
    assert collected(topk.topk(q, c, 7, broadcast_queries=10)) == brute(queries, corpus, 7)


def test_small_matrix_steps_give_the_same_result(data):
    queries, corpus = data
    best = topk.RunningTopK(queries, 7)
    for start in range(0, len(corpus), 9):
        part = corpus[start:start + 9]
        best.absorb(part, np.ones(len(part), np.int32), np.arange(start, start + len(part)))
    expected = brute(queries, corpus, 7)
    assert [best.ids[i].tolist() for i in range(len(queries))] == [
        [j for _, j, _ in expected[f"q{i}"]] for i in range(len(queries))
    ]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 9), st.integers(1, 60), st.integers(1, 12), st.integers(1, 20))
def test_any_split_gives_the_same_ranking(seed, n_queries, n_rows, k, step):
    """Few distinct values make many exact ties."""
    rng = np.random.default_rng(seed)
    queries = rng.integers(-1, 2, (n_queries, 3)).astype(np.float32)
    corpus = rng.integers(-1, 2, (n_rows, 3)).astype(np.float32)
    places = rng.integers(1, 3, n_rows).astype(np.int32)
    best = topk.RunningTopK(queries, k)
    order = rng.permutation(n_rows)
    for start in range(0, n_rows, step):
        part = order[start:start + step]
        best.absorb(corpus[part], places[part], part.astype(np.int64))
    query, _, index_id, score = best.rows()
    found = {f"q{i}": [] for i in range(n_queries)}
    for q, i, s in zip(query, index_id, score):
        found[f"q{q}"].append((len(found[f"q{q}"]) + 1, int(i), round(float(s), 7)))
    assert found == brute(queries, corpus, k, places)


def test_one_vector_fills_a_third_of_the_corpus(spark):
    rng = np.random.default_rng(3)
    corpus = unit(rng, 600, 8)
    corpus[rng.permutation(600)[:200]] = corpus[0]
    queries = np.concatenate([corpus[:1], unit(rng, 4, 8)])
    q, c = frames(spark, queries, corpus)
    assert collected(topk.topk(q, c, 10)) == brute(queries, corpus, 10)


def test_fewer_rows_than_k_and_none_at_all(spark, data):
    queries, corpus = data
    q, c = frames(spark, queries, corpus[:3])
    assert collected(topk.topk(q, c, 50)) == brute(queries, corpus[:3], 50)
    assert topk.topk(q, c.limit(0), 5).count() == 0
    assert topk.topk(q.limit(0), c, 5).count() == 0


def test_rows_without_a_vector_are_left_out(spark, data):
    queries, corpus = data
    q, c = frames(spark, queries, corpus)
    q = q.unionByName(q.select(F.lit("none").alias("sample_id"), F.lit(None).cast("array<float>").alias("embedding")))
    c = c.unionByName(c.limit(1).withColumns({"index_id": F.lit(9999), "embedding": F.lit(None).cast("array<float>")}))
    assert collected(topk.topk(q, c, 3)) == brute(queries, corpus, 3)


def test_ragged_vectors_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError):
        topk.to_matrix(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0]], pa.list_(pa.float32())))


def test_inner_product_expression_agrees(spark, data):
    queries, corpus = data
    q, c = frames(spark, queries[:2], corpus[:20])
    pairs = q.crossJoin(c).select("sample_id", "index_id", inner_product(q.embedding, c.embedding).alias("score"))
    for row in pairs.collect():
        exact = float(corpus[row.index_id].astype(np.float64) @ queries[int(row.sample_id[1:])].astype(np.float64))
        assert abs(row.score - exact) < 1e-12


def test_probing_all_cells_is_exact_whatever_their_sizes(spark, data, monkeypatch):
    queries, corpus = data
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 5)
    monkeypatch.setattr(topk, "FRAGMENT_ROWS", 20)
    q, c = frames(spark, queries, corpus)
    # Nearly everything falls into one cell.
    index = ann.CellIndex(np.concatenate([np.ones((1, 16)), -np.ones((3, 16))]) / 4)
    assert collected(ann.approximate_topk(q, c, 7, index, nprobe=4)) == brute(queries, corpus, 7)


def test_fewer_cells_find_a_subset_with_true_scores(spark, data):
    queries, corpus = data
    q, c = frames(spark, queries, corpus)
    index = ann.fit_cells(c, 8)
    found = ann.approximate_topk(q, c, 5, index, nprobe=2)
    exact = topk.topk(q, c, 5)
    report = ann.recall(found, exact).first()
    assert report.n_exact == 23 * 5 and 0 < report.n_found <= report.n_exact
    for row in found.collect():
        true = corpus[row.index_id].astype(np.float64) @ queries[int(row.sample_id[1:])].astype(np.float64)
        assert abs(row.score - true) < 1e-8


def test_a_block_of_wide_vectors_is_taken_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    queries, corpus, sizes = unit(rng, 3, 2048), unit(rng, 2000, 2048), []
    taken = topk.RunningTopK._absorb
    monkeypatch.setattr(topk.RunningTopK, "_absorb", lambda self, block, *rest: (sizes.append(block.size), taken(self, block, *rest)))
    best = topk.RunningTopK(queries, 4)
    best.absorb(corpus, np.ones(len(corpus), np.int32), np.arange(len(corpus)))
    assert max(sizes) <= 1 << 20 and sum(sizes) == corpus.size
    expected = np.argsort(-(queries.astype(np.float64) @ corpus.T.astype(np.float64)), axis=1, kind="stable")[:, :4]
    assert (best.ids == expected).all()
