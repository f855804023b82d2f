"""Quality rules and reports."""

import pytest
from pyspark.sql import functions as F

from traincover.functions import text
from traincover.operators import quality

COLUMNS = ("global_id long, data_uuid string, image_relative_path string, entity_name string, annotation string, "
           "model_name string, source_name string, source_dataset string")


def rows(spark, *cases):
    filled = []
    for i, case in enumerate(cases):
        row = {"global_id": i, "data_uuid": f"u{i}", "image_relative_path": f"{i}.png", "entity_name": "name",
               "annotation": "name " + "x" * 60, "model_name": "m", "source_name": "s", "source_dataset": "d", **case}
        filled.append(tuple(row[c.split()[0]] for c in COLUMNS.split(", ")))
    return spark.createDataFrame(filled, COLUMNS)


def found(spark, **case):
    return [(i.severity, i.field) for i in quality.check(rows(spark, case)).first().issues]


@pytest.mark.parametrize("case, expected", [
    ({"annotation": "name " + "x" * 45}, []),
    ({"annotation": "name " + "x" * 44}, [("WARNING", "annotation")]),
    ({"annotation": "y" * 20_001}, [("WARNING", "annotation"), ("INFO", "annotation")]),
    ({"annotation": "　　"}, [("ERROR", "annotation")]),
    ({"annotation": None}, [("ERROR", "annotation")]),
    ({"entity_name": "  "}, [("WARNING", "entity_name")]),
    ({"entity_name": "absent"}, [("INFO", "annotation")]),
    ({"model_name": "  "}, [("WARNING", "model_name")]),
    ({"entity_name": " x ", "annotation": "y" * 50 + "x"}, []),
    ({"image_relative_path": ""}, [("ERROR", "image_relative_path")]),
])
def test_rules(spark, case, expected):
    assert found(spark, **case) == expected


def test_messages_carry_the_numbers(spark):
    short = quality.check(rows(spark, {"annotation": "name"})).first().issues[0]
    assert short.message == "打标结果过短 (4 字符 < 50)"


def test_thresholds_are_parameters(spark):
    checked = quality.check(rows(spark, {"annotation": "name"}), min_length=4, max_length=4).first()
    assert checked.is_clean


def test_unreadable_images(spark):
    flagged = rows(spark, {}, {}).withColumn("ok", F.col("global_id") == 0)
    counts = [len(r.issues) for r in quality.check(flagged, image_readable="ok").orderBy("global_id").collect()]
    assert counts == [0, 1]


def test_summary_counts_hints_as_warnings(spark):
    checked = quality.check(rows(spark, {}, {"entity_name": "absent"}, {"annotation": ""}, {"entity_name": ""}))
    assert quality.summary(checked).first().asDict() == {
        "total_samples": 4, "clean_samples": 1, "error_samples": 1, "warning_samples": 2}


def test_distributions(spark):
    table = rows(spark, {"source_name": "b"}, {"source_name": "a"}, {"source_name": ""}, {"source_name": "a"},
                 {"source_name": "b"}, {"model_name": " "})
    result = [(r.value, r.n) for r in quality.distributions(table).where("dimension = 'source'").orderBy("rank").collect()]
    assert result == [("b", 2), ("a", 2), ("(空)", 1), ("s", 1)]
    models = {r.value: r.n for r in quality.distributions(table).where("dimension = 'model'").collect()}
    assert models == {"m": 5, " ": 1}
    assert [r.value for r in quality.top_sources(table, limit=2).collect()] == ["b", "a"]


def test_many_values_are_ranked_alike(spark, monkeypatch):
    table = rows(spark, *[{"source_name": f"s{i % 7}", "model_name": f"m{i % 3}"} for i in range(40)])
    few = {tuple(r) for r in quality.distributions(table).collect()}
    monkeypatch.setattr(quality, "WINDOW_VALUES", 1)
    assert {tuple(r) for r in quality.distributions(table).collect()} == few


def test_issue_fields(spark):
    checked = quality.check(rows(spark, {}, {"annotation": "y" * 20_001}, {"model_name": ""}))
    result = [tuple(r) for r in quality.issue_fields(checked).orderBy("rank").collect()]
    assert result == [("annotation", 2, 66.7, 1), ("model_name", 1, 33.3, 2)]


def test_problem_list_filters_after_the_limit(spark):
    checked = quality.check(rows(spark, {}, {"entity_name": "absent"}, {"model_name": ""}, {"annotation": ""}))
    assert [r.global_id for r in quality.problems(checked).orderBy("global_id").collect()] == [2, 3]
    assert [r.global_id for r in quality.problems(checked, limit=2).collect()] == [2]
    assert [r.is_error for r in quality.problems(checked).orderBy("global_id").collect()] == [False, True]


def test_report_text(spark):
    report = quality.report_text(quality.check(rows(spark, {}, {"annotation": ""}))).split("\n")
    assert "总样本数:     2" in report and "  d: 2" in report and "  annotation: 1 条" in report


def test_strip_is_the_unicode_one(spark):
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    padded = spark.createDataFrame([(c + "a b" + c,) for c in spaces] + [("​a b",)], "s string")
    result = {r[0] for r in padded.select(text.strip(F.col("s"))).collect()}
    assert result == {"a b", "​a b"}


def test_labels_and_bundle_files(spark):
    table = spark.createDataFrame([("", "", "u"), (" ", "p", "u"), (None, "p", "u")], "a string, b string, c string")
    assert [r[0] for r in table.select(text.first_filled(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["u", " ", "p"]
    names = spark.createDataFrame([("a/b\\c", 1), ("", 12), ("鼎" * 70, 1000)], "n string, i int")
    assert [r[0] for r in names.select(text.bundle_file(F.lit("s"), F.col("n"), F.col("i"))).collect()] == [
        "s/a_b_c_001.jpg", "s/unknown_012.jpg", f"s/{'鼎' * 60}_1000.jpg"]
