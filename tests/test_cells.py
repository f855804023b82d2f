"""A stored cell index: written by cell beside a version, loaded, probed with folders of other cells pruned."""

import re

import numpy as np
from pyspark.sql import functions as F

from tests.test_jobs import TEXT, ByteEncoder, tree
from traincover.operators import ann, search, topk
from traincover.plans import build
from traincover.sources import vectors as table


def _corpus(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    centres = np.eye(4, 8)
    rows = []
    for i in range(n):
        v = centres[i % 4] + rng.normal(0, 0.05, 8)
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)], i, "image", None, None, None, f"s{i % 3}"))
    schema = "index_id long, embedding array<float>, global_id long, modality string, image_path string, text string, annotation string, source string"
    return spark.createDataFrame(rows, schema), centres


def _stored(spark, tmp_path):
    corpus, centres = _corpus(spark)
    index = ann.CellIndex(centres)
    table.write_cells(ann.house(corpus, index), index.centres, str(tmp_path), "v1")
    return corpus, ann.load_index(spark, str(tmp_path), "v1")


def test_round_trip_keeps_centres_rows_and_cells(spark, tmp_path):
    corpus, (index, stored) = _stored(spark, tmp_path)
    assert np.allclose(index.centres, np.eye(4, 8))
    got = sorted((r.index_id, r.cell, r.version, r.modality) for r in stored.collect())
    assert got == [(i, i % 4, "v1", "image") for i in range(400)]
    # The vector table's own listing does not see the index folder.
    assert table.read_vectors(spark, str(tmp_path)).count() == 0


def test_probing_reads_only_probed_cells(spark, tmp_path):
    corpus, (index, stored) = _stored(spark, tmp_path)
    queries = corpus.where("index_id IN (0, 4, 8)").select(F.col("index_id").alias("sample_id"), "embedding")
    found = search.rank(queries, stored, "image", ["v1"], k=5, index=index, nprobe=1)
    assert {r.index_id % 4 for r in found.collect()} == {0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Every scan of the stored vectors reads the probed cell's folder alone.
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert scans and all(re.search(r"\(cell#\d+ = 0\)", found) for found in scans)


def test_all_cells_probed_is_exact(spark, tmp_path):
    corpus, (index, stored) = _stored(spark, tmp_path)
    queries = corpus.where("index_id % 37 = 0").select(F.col("index_id").alias("sample_id"), "embedding")
    found = search.rank(queries, stored, "image", ["v1"], k=7, index=index, nprobe=4)
    exact = topk.topk(queries, corpus.select(F.lit(1).alias("version_pos"), "index_id", "embedding"), 7)
    key = lambda rows: sorted((r.sample_id, r.rank, r.index_id, round(r.score, 6)) for r in rows)
    assert key(found.collect()) == key(exact.collect())


def test_build_stores_an_index_beside_the_version(spark, tmp_path):
    data = tree(tmp_path / "data", [f"thing number{i}" for i in range(12)])
    root = str(tmp_path / "index")
    counts = build.build_version(spark, str(data), root, ByteEncoder(), TEXT, "v", cells=2, run_qc=False)
    index, stored = ann.load_index(spark, root, "v")
    assert counts["image"] == stored.count() == 8 and len(index.centres) == 2 and index.radii is not None
    vectors = table.read_vectors(spark, root)
    queries = vectors.where("modality = 'image'").select(F.col("index_id").alias("sample_id"), "embedding")
    approximate = search.search_images(queries, stored, k=3, index=index, nprobe=2)
    exact = search.search_images(queries, vectors, k=3)
    key = lambda rows: sorted((r.sample_id, r.rank, r.index_id, round(r.score, 6)) for r in rows)
    assert key(approximate.collect()) == key(exact.collect())


def _exact_key(rows):
    return sorted((r.sample_id, r.rank, r.index_id, round(r.score, 6)) for r in rows)


def test_bounded_search_is_exact_and_skips_far_cells(spark):
    corpus, centres = _corpus(spark)
    housed = ann.house(corpus.select(F.lit(1).alias("version_pos"), "index_id", "embedding"), ann.CellIndex(centres))
    index = ann.CellIndex(centres, ann.cell_radii(housed, ann.CellIndex(centres)))
    assert np.all(index.radii > 0) and np.all(index.radii < 0.5)
    queries = corpus.where("index_id % 9 = 0").select(F.col("index_id").alias("sample_id"), "embedding")
    exact = topk.topk(queries, corpus.select(F.lit(1).alias("version_pos"), "index_id", "embedding"), 6)
    for nprobe in (1, 2, 4):
        assert _exact_key(ann.exact_topk(queries, housed, 6, index, nprobe).collect()) == _exact_key(exact.collect())
    # Tight clusters: after the nearest cell, no other cell's bound reaches the sixth score.
    asked, _ = ann._usable(queries, housed, index)
    asked = asked.withColumn("kth", F.lit(0.9).cast("double"))
    assert ann._further_cells(asked, index, 1).count() == 0


def test_bounded_search_keeps_ties_at_the_bound(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 6)]) for i in range(300)]
    rows += [(1000 + i, v) for i, v in rows[:40]]  # repeated vectors: equal scores, told apart by index_id
    corpus = spark.createDataFrame(rows, "index_id long, embedding array<float>").select(F.lit(1).alias("version_pos"), "*")
    fitted = ann.CellIndex(np.eye(6) - np.eye(6, k=1))
    housed = ann.house(corpus, fitted)
    index = ann.CellIndex(fitted.centres, ann.cell_radii(housed, fitted))
    queries = corpus.where("index_id % 13 = 0").select(F.col("index_id").alias("sample_id"), "embedding")
    exact = topk.topk(queries, corpus, 8)
    for nprobe in (1, 3, 6):
        assert _exact_key(ann.exact_topk(queries, housed, 8, index, nprobe).collect()) == _exact_key(exact.collect())


def test_bounded_search_with_fewer_rows_than_k_and_without_radii(spark):
    corpus = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "version_pos int, index_id long, embedding array<float>")
    fitted = ann.CellIndex(np.eye(2))
    housed = ann.house(corpus, fitted)
    index = ann.CellIndex(fitted.centres, ann.cell_radii(housed, fitted))
    queries = spark.createDataFrame([("q", [1.0, 1.0])], "sample_id string, embedding array<float>")
    assert len(ann.exact_topk(queries, housed, 5, index, 1).collect()) == 2
    try:
        ann.exact_topk(queries, housed, 5, fitted, 1)
    except ValueError:
        pass
    else:
        raise AssertionError("radii are required")
