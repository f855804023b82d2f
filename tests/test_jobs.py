"""Build, search, evaluate and export end to end, with a stub image encoder."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import PNG, record, write_jsonl, write_tar
from traincover.operators import coverage, embed, search
from traincover.plans import build, evaluate, export
from traincover.sources import vectors as table


class ByteEncoder:
    """Counts the bytes of an image; a leading '!' makes it unreadable."""

    dim = 256

    def encode(self, items):
        counts = np.stack([np.bincount(np.frombuffer(b, np.uint8), minlength=256) for b in items]).astype(float)
        counts[[b.startswith(b"!") for b in items]] = np.nan
        return counts


TEXT = embed.HashedTokenEncoder(64)


def picture(i):
    return PNG + bytes([100 + i]) * 40


def tree(root, names, start=0):
    """One shard; every third image is missing, a blank name every fourth."""
    lines = []
    for i, name in enumerate(names, start):
        entity = {"entity_name": name if i % 4 else " "}
        lines.append(record(f"u{i}", f"{i}.png", f"about {name}", meta_info_image={
            "knowledge_info": {"knowledge_entities": [entity]}, "source_info": {"source_name": f"src{i % 2}"}}))
    write_jsonl(root / "d" / "jsonl" / "s.jsonl", lines)
    write_tar(root / "d" / "images" / "s.tar", [
        (f"{i}.png", picture(i)) for i in range(start, start + len(names)) if i % 3])
    return root


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("index")
    names = [f"thing number{i}" for i in range(12)]
    for version, start in ((None, 0), ("2024", 12), ("v b", 24)):
        data = tree(tmp_path_factory.mktemp("data"), names, start)
        counts = build.build_version(spark, str(data), str(root), ByteEncoder(), TEXT, version, shards=3,
                                     huge_archives=version == "v b")
        assert counts == {"image": 8, "text": 9}
    return root


def test_vector_table(spark, index):
    stored = table.read_vectors(spark, str(index))
    assert [tuple(r) for r in table.versions(stored).collect()] == [
        ("default", 8, 9), ("2024", 8, 9), ("v b", 8, 9)]
    assert table.duplicate_ids(stored).count() == 0
    images = stored.where("version = '2024' AND modality = 'image'").orderBy("index_id").collect()
    survivors = [i for i in range(12) if (i + 12) % 3]
    assert [r.global_id for r in images] == sorted(survivors, key=lambda i: (i % 3, i))
    assert [r.index_id for r in images] == list(range(8))
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in images)


def test_folders_are_pruned(spark, index):
    plan = table.read_vectors(spark, str(index)).where("version = '2024' AND modality = 'text'").select("text")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in text and "ReadSchema: struct<text:string>" in text


def test_active_versions(spark, index):
    stored = table.read_vectors(spark, str(index))
    assert table.active_versions(stored) == ["default", "2024", "v b"]
    assert table.active_versions(stored, []) == ["default", "2024", "v b"]
    assert table.active_versions(stored, ["v b", "gone", "default"]) == ["v b", "default"]
    assert table.active_versions(stored, ["gone"]) == []
    assert table.active_versions(table.read_vectors(spark, str(index / "gone"))) == []


def test_rebuild_replaces_the_whole_version(spark, index, tmp_path):
    data = tree(tmp_path / "data", [" "] * 4)
    root = str(tmp_path / "index")
    build.build_version(spark, str(tree(tmp_path / "old", ["x"] * 4)), root, ByteEncoder(), TEXT, "v")
    counts = build.build_version(spark, str(data), root, ByteEncoder(), TEXT, "v", run_qc=False)
    assert counts == {"image": 2}


def test_bad_builds(spark, tmp_path):
    for name in ("default", "a/b", "a=b"):
        with pytest.raises(ValueError):
            build.build_version(spark, str(tmp_path), str(tmp_path / "i"), ByteEncoder(), TEXT, name)
    with pytest.raises(ValueError, match="no valid data"):
        build.build_version(spark, str(tmp_path), str(tmp_path / "i"), ByteEncoder(), TEXT)


def test_image_audit(spark, tmp_path):
    annotated = build.scan_annotations(spark, str(tree(tmp_path, ["a"] * 6)))
    checked = build.check_dataset(annotated, check_images=True)
    bad = {r.global_id for r in checked.where(F.exists("issues", lambda i: i["field"] == "image")).collect()}
    assert bad == {0, 3}


def queries(spark, *numbers):
    rows = [(f"q{i}", picture(i)) for i in numbers]
    encoded = embed.unit_rows(ByteEncoder().encode([b for _, b in rows]))
    return spark.createDataFrame([(n, v.tolist()) for (n, _), v in zip(rows, encoded)],
                                 "sample_id string, embedding array<float>")


def test_search_merges_versions(spark, index):
    stored = table.read_vectors(spark, str(index))
    found = search.search_images(queries(spark, 13, 5), stored, k=30).collect()
    assert len(found) == 2 * 24
    best = {r.sample_id: r for r in found if r["rank"] == 1}
    assert best["q13"].version == "2024" and best["q13"].source == "[2024] src1" and best["q13"].score > 0.999
    assert best["q13"].annotation == "about thing number1" and best["q13"].image_path.endswith("::13.png")
    # All other pictures are equally far from the query: earlier versions first, then lower ids.
    rest = sorted((r["rank"], r.version, r.index_id) for r in found if r.sample_id == "q13")[1:]
    assert [v for _, v, _ in rest] == ["default"] * 8 + ["2024"] * 7 + ["v b"] * 8
    one = search.search_images(queries(spark, 13), stored, k=2, versions=["v b", "gone"]).collect()
    assert {r.source[0] for r in one} == {"s"} and {r.version for r in one} == {"v b"}
    assert search.search_images(queries(spark, 13), stored, versions=["gone"]).count() == 0


def test_single_searches(spark, index, tmp_path):
    stored = table.read_vectors(spark, str(index))
    (tmp_path / "q.png").write_bytes(picture(13))
    found = evaluate.search_by_image(str(tmp_path / "q.png"), stored, ByteEncoder(), top_k=2).orderBy("rank").collect()
    assert [r.image_path.rsplit("::", 1)[1] for r in found][0] == "13.png" and len(found) == 2
    assert evaluate.search_by_image(str(tmp_path / "gone.png"), stored, ByteEncoder()).count() == 0
    texts = evaluate.search_by_text("thing number1", stored, TEXT, top_k=3, versions=["2024"]).orderBy("rank").collect()
    assert texts[0].text == "thing number1" and {r.channel for r in texts} == {"text"} and len(texts) == 3
    assert evaluate.search_by_text("", stored, TEXT).count() == 0


def test_unreadable_and_repeated_items(spark):
    rows = spark.createDataFrame([(1, "same words"), (2, ""), (3, None), (4, "same words"), (5, "other")],
                                 "id int, text string").coalesce(1)
    vectors = {r.id: r.embedding for r in embed.embed_texts(rows, TEXT).collect()}
    assert vectors[1] == vectors[4] and vectors[2] is None and vectors[3] is None and vectors[5] != vectors[1]


@pytest.fixture(scope="module")
def evaluated(spark, index, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bench")
    asked = {"hit": (picture(13), "thing number1"), "no_text": (picture(5), ""), "broken": (b"!", "thing number2"),
             "far": (bytes(range(200, 250)), "zzz")}
    for stem, (image, text) in asked.items():
        (folder / f"{stem}.png").write_bytes(image)
        (folder / f"{stem}.json").write_text(json.dumps({"model": [{"answer": text}]}))
    samples = evaluate.evaluation_samples(spark, str(folder), "model[0].answer")
    return evaluate.match_samples(samples, table.read_vectors(spark, str(index)), ByteEncoder(), TEXT, k=3)


def test_evaluation(evaluated):
    samples, matches = evaluated
    counts = {(r.sample_id.rsplit("/", 1)[1], r.channel): r["count"]
              for r in matches.groupBy("sample_id", "channel").count().collect()}
    assert counts == {("hit.png", "image"): 3, ("hit.png", "text"): 3, ("no_text.png", "image"): 3,
                      ("broken.png", "text"): 3, ("far.png", "image"): 3, ("far.png", "text"): 3}
    assert [r.stem for r in samples.where("error = 'image'").collect()] == ["broken"]
    classified = coverage.classify(coverage.facts(samples, matches), 0.9)
    assert {r.stem: r.category for r in classified.collect()} == {
        "hit": "agree", "no_text": "image", "broken": "text", "far": "none"}
    listed = evaluate.drill_down(classified, matches, 0.9, "image").where("channel = 'image'").orderBy("position")
    assert [(r.position, r.stem, r.n_shown, r.n_hidden) for r in listed.collect()] == [
        (1, "hit", 1, 2), (2, "no_text", 1, 2)]


def test_exports(spark, evaluated, tmp_path):
    samples, matches = evaluated
    classified = coverage.classify(coverage.facts(samples, matches), 0.9)
    export.write_overview(classified, str(tmp_path / "csv"), stem="stem")
    rows = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    by_stem = {r["样本"]: r for r in rows}
    assert by_stem["hit"]["覆盖状态"] == "🟣 图文一致" and by_stem["no_text"]["文物名称"] == "-"
    export.write_detail(classified, matches, str(tmp_path / "json"), stem="stem")
    detail = {r["样本"]: r for r in spark.read.json(str(tmp_path / "json")).collect()}
    assert [m["rank"] for m in detail["hit"]["图像检索结果"]] == [1, 2, 3]
    assert detail["no_text"]["文本检索结果"] == [] and detail["far"]["覆盖状态"] == "无匹配"
    manifest = export.agree_manifest(classified, matches, 0.9, stem="stem")
    export.write_bundle(manifest, str(tmp_path / "bundle"))
    images = spark.read.parquet(str(tmp_path / "bundle" / "images")).collect()
    assert [(r.image_file, bytes(r.content)) for r in images] == [("hit/thing number1_001.jpg", picture(13))]
    line = spark.read.json(str(tmp_path / "bundle" / "matched_annotations")).first()
    assert line.query_sample == "hit" and line.matched_entity == "thing number1" and line.source == "[2024] src1"


def test_failed_build_leaves_the_old_version_readable(spark, tmp_path):
    root = str(tmp_path / "index")
    build.build_version(spark, str(tree(tmp_path / "old", [f"old{i}" for i in range(6)])), root, ByteEncoder(), TEXT, "v", run_qc=False)
    before = sorted(tuple(r) for r in table.read_vectors(spark, root).select("modality", "index_id", "text").collect())

    class Failing(ByteEncoder):
        def encode(self, items):
            raise RuntimeError("encoder lost")

    with pytest.raises(Exception):
        build.build_version(spark, str(tree(tmp_path / "new", ["new"] * 6)), root, Failing(), TEXT, "v", run_qc=False)
    after = sorted(tuple(r) for r in table.read_vectors(spark, root).select("modality", "index_id", "text").collect())
    assert after == before and before
    # A later build that succeeds replaces it whole, and leaves no scratch folder behind.
    build.build_version(spark, str(tree(tmp_path / "new2", ["new"] * 6)), root, ByteEncoder(), TEXT, "v", run_qc=False)
    texts = {r.text for r in table.read_vectors(spark, root).where("modality = 'image'").collect()}
    assert "new" in texts and texts <= {"new", " "}  # every fourth name of the fixture is blank
    assert not list((tmp_path / "index" / "_building").iterdir())
