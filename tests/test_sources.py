"""Annotation trees, tars and evaluation folders on generated files."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from traincover.functions import paths
from traincover.operators import ids
from traincover.plans.build import scan_annotations
from traincover.sources import annotations, benchmark, tars

PNG = b"\x89PNG\r\n\x1a\n" + b"0" * 20


def write_tar(path, members):
    path.parent.mkdir(parents=True, exist_ok=True)
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def record(uuid="u", image="a.png", annotation="text", **more):
    return {
        "data_uuid": uuid,
        "data": [
            {"content": [{"type": "image", "image": {"relative_path": image}}]},
            {"content": [{"type": "text", "text": {"string": annotation}}]},
        ],
        **more,
    }


def write_jsonl(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(
        (line if isinstance(line, str) else json.dumps(line, ensure_ascii=False)) + "\n" for line in lines
    ), encoding="utf-8")


@pytest.fixture
def tree(tmp_path):
    named = {
        "meta_info_image": {
            "knowledge_info": {"knowledge_entities": [{"entity_name": "鼎", "entity_tags": ["bronze", "old"]}]},
            "source_info": {"source_name": "museum"},
        },
        "data_generated_info": {"task_oriented_data": [{"model_name": "m1"}]},
    }
    text_first = record("a4")
    text_first["data"][0]["content"].insert(0, {"type": "text", "text": {"string": "look"}})
    no_path = record("a5")
    no_path["data"][0]["content"] = [{"type": "image"}, {"type": "image", "image": {"relative_path": "b.png"}}]
    stray = record("a6")
    stray["data"][0]["content"].insert(0, "stray")
    plain = record("a7")
    plain["data"][1]["content"] = "plain"
    odd_entities = record("a8", meta_info_image={"knowledge_info": {"knowledge_entities": "none"}})
    odd_tags = record("a9", meta_info_image={
        "knowledge_info": {"knowledge_entities": [{"entity_name": "n", "entity_tags": "t"}]}})
    write_jsonl(tmp_path / "源A" / "jsonl" / "data_0.jsonl", [
        record("full", "珐琅/a.png", "a bronze 鼎", **named),
        "", "   　", "{broken", "[1, 2]", {"data": None}, {"data": {"a": 1, "b": 2}},
        {"data": [{"content": []}]}, text_first, no_path, stray, plain, odd_entities, odd_tags,
        '{"data_uuid": "first", "data_uuid": "last", "data": '
        '[{"content": [{"type": "image", "image": {"relative_path": "d.png"}}]}, {}]}',
        record("missing", "missing.png"), record("empty", "empty.png"),
    ])
    write_tar(tmp_path / "源A" / "images" / "data_0.tar", [
        ("珐琅/a.png", b"old"), ("珐琅/a.png", PNG), ("a.png", PNG), ("d.png", b"no image"), ("empty.png", b""),
    ])
    write_jsonl(tmp_path / "b c%+" / "jsonl" / "x[1].v.jsonl", [record("other")])
    write_tar(tmp_path / "b c%+" / "images" / "x[1].v.tar", [("a.png", PNG)])
    write_jsonl(tmp_path / "b c%+" / "jsonl" / "lonely.jsonl", [record("lonely")])
    (tmp_path / "nothing").mkdir()
    (tmp_path / "stray.jsonl").write_text("{}")
    return tmp_path


def test_scan(spark, tree):
    lines = annotations.scan_lines(spark, str(tree))
    assert annotations.scan_stats(lines).first().asDict() == {"total": 18, "valid": 10, "skipped": 6}
    rows = {row.data_uuid: row for row in annotations.annotations(lines).collect()}
    assert set(rows) == {"full", "a4", "a6", "a7", "a8", "a9", "last", "missing", "empty", "other"}
    full = rows["full"]
    assert full.image_path == f"tar://{tree}/源A/images/data_0.tar::珐琅/a.png"
    assert (full.entity_name, full.entity_tags, full.annotation) == ("鼎", ["bronze", "old"], "a bronze 鼎")
    assert (full.source_name, full.model_name, full.source_dataset, full.tar_name) == ("museum", "m1", "源A", "data_0")
    assert rows["a7"].annotation == "" and rows["a8"].entity_name == ""
    assert rows["a9"].entity_name == "n" and rows["a9"].entity_tags == []
    assert rows["other"].image_path == f"tar://{tree}/b c%+/images/x[1].v.tar::a.png"


def test_shards(spark, tree):
    pairs = {(r.source_dataset, r.tar_name) for r in annotations.shard_pairs(spark, str(tree)).collect()}
    assert pairs == {("源A", "data_0"), ("b c%+", "x[1].v")}
    assert [r.tar_name for r in annotations.missing_tars(spark, str(tree)).collect()] == ["lonely"]


def test_scan_of_an_empty_root(spark, tmp_path):
    assert annotations.scan_stats(annotations.scan_lines(spark, str(tmp_path))).first().asDict() == {
        "total": 0, "valid": 0, "skipped": 0}


def test_ids_follow_the_scan_order(spark, tree):
    rows = scan_annotations(spark, str(tree)).orderBy("global_id").collect()
    assert [row.global_id for row in rows] == list(range(10))
    assert [row.data_uuid for row in rows] == [
        "other", "full", "a4", "a6", "a7", "a8", "a9", "last", "missing", "empty"]


def test_ids_over_many_splits(spark, tmp_path):
    expected = []
    for shard in ("s0", "s1", "s2"):
        lines = [record(f"{shard}-{i:05d}") if i % 3 else "" for i in range(4000)]
        write_jsonl(tmp_path / "d" / "jsonl" / f"{shard}.jsonl", lines)
        write_tar(tmp_path / "d" / "images" / f"{shard}.tar", [])
        expected += [line["data_uuid"] for line in lines if line]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        rows = scan_annotations(spark, str(tmp_path), keep_raw=False).orderBy("global_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [row.data_uuid for row in rows] == expected
    assert [row.global_id for row in rows] == list(range(len(expected)))


def test_shard_ids(spark, monkeypatch):
    monkeypatch.setattr(ids, "BUCKET_ROWS", 16)
    kept = [i for i in range(500) if i % 5]
    rows = spark.createDataFrame([(i,) for i in kept], "global_id long").repartition(5)
    numbered = {r.global_id: r.index_id for r in ids.shard_ids(rows, 8).collect()}
    assert numbered == {g: i for i, g in enumerate(sorted(kept, key=lambda g: (g % 8, g)))}


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(6)
    placed = ids.positions(rows, F.desc("x")).collect()
    ordered = sorted((r.x for r in placed), reverse=True)
    assert {r.x: r.position for r in placed} == {x: i + 1 for i, x in enumerate(ordered)}


def test_members_and_images(spark, tree):
    members = tars.list_members(spark, f"{tree}/*/images/*.tar").collect()
    assert {(m.member, m.member_bytes) for m in members} >= {("珐琅/a.png", len(PNG)), ("empty.png", 0)}
    (tree / "plain.png").write_bytes(PNG)
    a = f"tar://{tree}/源A/images/data_0.tar::"
    cases = {
        a + "珐琅/a.png": PNG, a + "d.png": b"no image", a + "empty.png": b"", a + "gone.png": None,
        f"tar://{tree}/gone.tar::a.png": None, "tar://no-mark": None, f"{tree}/plain.png": PNG, f"{tree}/gone.png": None,
    }
    rows = spark.createDataFrame([(p,) for p in [*cases, None]], "image_path string")
    read = {r.image_path: r.content and bytes(r.content) for r in tars.read_images(tars.gather_by_archive(rows)).collect()}
    assert {p: read[p] or None for p in cases} == {p: d or None for p, d in cases.items()}
    located = tars.locate(rows, tars.list_members(spark, f"{tree}/*/images/*.tar"))
    assert {r.image_path: r.member_bytes for r in located.collect()}[a + "珐琅/a.png"] == len(PNG)
    assert {r.image_path: r.content and bytes(r.content) for r in tars.read_images(located).collect()} == read
    ok = {r.image_path for r in tars.readable(rows).where("image_readable").collect()}
    assert ok == {a + "珐琅/a.png", f"{tree}/plain.png"}


def test_links_and_many_archives(spark, tmp_path):
    for i in range(20):
        with tarfile.open(tmp_path / f"{i}.tar", "w") as tar:
            info = tarfile.TarInfo("x/a.png")
            info.size = len(PNG)
            tar.addfile(info, io.BytesIO(PNG))
            for name, kind, target in (("h.png", tarfile.LNKTYPE, "x/a.png"), ("x/s.png", tarfile.SYMTYPE, "a.png"),
                                       ("x/loop.png", tarfile.SYMTYPE, "loop.png")):
                link = tarfile.TarInfo(name)
                link.type, link.linkname = kind, target
                tar.addfile(link)
    reader = tars.MemberReader()
    for _ in range(2):
        for i in range(20):
            uri = f"tar://{tmp_path}/{i}.tar::"
            assert reader.read(uri + "h.png") == reader.read(uri + "x/s.png") == PNG
            assert reader.read(uri + "x/loop.png") is None


def test_evaluation_folder(spark, tmp_path):
    folder = tmp_path / "bench [1]"
    (folder / "sub").mkdir(parents=True)
    for name in ("a.JPG", "a.png", "b.webp", "c.tiff", "lone.png", "bad.png", "latin.png", "dots.v1.png", "note.txt"):
        (folder / name).write_bytes(PNG)
    (folder / "sub" / "s.png").write_bytes(PNG)
    (folder / "sub" / "s.json").write_text("{}")
    for name in ("a", "b", "c", "dots.v1", "note"):
        (folder / f"{name}.json").write_text(json.dumps({"name": name}), encoding="utf-8")
    (folder / "bad.json").write_text("{")
    (folder / "latin.json").write_bytes('{"a": "é"}'.encode("latin-1"))
    found = benchmark.scan_folder(spark, str(folder)).collect()
    assert sorted((r.stem, r.image_path.rsplit("/", 1)[1]) for r in found) == [
        ("a", "a.JPG"), ("a", "a.png"), ("b", "b.webp"), ("c", "c.tiff"), ("dots.v1", "dots.v1.png")]
    assert found[0].image_path.startswith(str(folder))
    last = benchmark.scan_folder(spark, str(folder), dedupe="last").where("stem = 'a'").collect()
    assert [r.image_path.rsplit("/", 1)[1] for r in last] == ["a.png"]
    assert benchmark.scan_folder(spark, str(tmp_path / "gone")).count() == 0


def test_file_names(spark):
    names = ["/x/a.b.JPG", "/x/.jpg", "/x/a.", "a.jpeg", "/x.png/a"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(
        paths.stem(F.col("p")), paths.suffix(F.col("p")), paths.is_image(F.col("p"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a.b", ".JPG", True), (".jpg", "", False), ("a.", "", False), ("a", ".jpeg", True), ("a", "", False)]
