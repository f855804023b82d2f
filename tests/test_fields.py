"""Paths into free-form JSON."""

import json

import pytest
from pyspark.sql import functions as F

from traincover.functions import jsonpath
from traincover.operators import fields

SAMPLES = [
    {"entity_name": "鼎", "n": 5, "blank": " 　", "deep": {"a": [{"b": "x"}, {"c": "never"}]}},
    {"ModelA": [{"question": "q", "answer": "the { [ \\\" answer"}], "empty": [], "none": None, "obj": {}},
    {"a.b": "dotted", "c[0]": {"d": "bracket"}, "grid": [["cell"]], "ModelA": [{"answer": ""}], "flag": True},
    ["first", "second"],
    "just text",
]


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(f"s{i}", json.dumps(s, ensure_ascii=False)) for i, s in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, "stem string, body string").select("stem", F.parse_json("body").alias("json"))


def test_deep_nesting(spark):
    deep = '{"a":[' * 250 + '"x"' + "]}" * 250
    rows = spark.createDataFrame([("s", deep), ("t", '{"b": "y"}')], "stem string, body string")
    found = fields.text_paths(rows.select("stem", F.parse_json("body").alias("json"))).collect()
    assert [r.path for r in found] == [".".join(["a[0]"] * 250), "b"]


def test_paths(samples):
    found = [r.path for r in fields.text_paths(samples).collect()]
    assert found == sorted([
        "entity_name", "deep.a[0].b", "ModelA[0].question", "ModelA[0].answer", '["a.b"]', '["c[0]"].d', "grid[0][0]",
        "[0]",
    ])
    assert [r.path for r in fields.text_paths(samples, first=1).collect()] == ["deep.a[0].b", "entity_name"]


def test_found_paths_resolve(samples):
    for row in fields.text_paths(samples).collect():
        values = [r[0] for r in samples.select(jsonpath.text_at(F.col("json"), row.path)).collect()]
        assert any(v and v.strip() for v in values), row.path


def test_depth_of_nothing(spark, samples):
    assert fields.text_paths(samples.limit(0)).count() == 0


@pytest.mark.parametrize("path, expected", [
    ("entity_name", ["鼎", None, None, None, None]),
    ("n", [None] * 5),
    ("flag", [None] * 5),
    ("ModelA[0].answer", [None, 'the { [ \\" answer', "", None, None]),
    ("ModelA[5].answer", [None] * 5),
    ("[1]", [None, None, None, "second", None]),
])
def test_values(samples, path, expected):
    rows = samples.orderBy("stem").select(jsonpath.text_at(F.col("json"), path)).collect()
    assert [r[0] for r in rows] == expected


def test_parse_path():
    assert jsonpath.parse_path("ModelA[0].answer") == ["ModelA", 0, "answer"]
    assert jsonpath.parse_path("a[0][1]") == ["a", 0, 1]
    assert jsonpath.parse_path('["a.b"].c') == ["a.b", "c"]
    assert jsonpath.parse_path("a[x") == ["a[x"]
    with pytest.raises(ValueError):
        jsonpath.variant_path(["both \" and '"])


def test_answers_keys_and_previews(samples):
    rows = samples.orderBy("stem").select(jsonpath.answer_of(F.col("json"), "ModelA")).collect()
    assert [r[0] for r in rows] == [None, 'the { [ \\" answer', None, None, None]
    assert [r.key for r in fields.list_keys(samples).collect()] == ["ModelA", "empty", "grid"]
    assert [r.value for r in fields.preview(samples, "ModelA[0].answer", n=3).collect()] == ['the { [ \\" answer']
