"""Coverage categories, counters and listings."""

import pytest

from traincover.operators import coverage

MATCHES = {
    "c1": ([(0.9, "A")], [(0.8, "A")]),
    "c2": ([(0.9, "B"), (0.6, "A")], [(0.8, "A")]),
    "c3": ([(0.9, "B"), (0.4, "A")], [(0.8, "A")]),
    "c4": ([(0.9, "")], [(0.8, "")]),
    "c5": ([(0.5, "B")], []),
    "c6": ([(0.4, "B")], [(0.5, "A")]),
    "c7": ([], []),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (sample, channel, rank, score, name, f"{sample}-{rank}.png")
        for sample, both in MATCHES.items()
        for channel, found in zip(("image", "text"), both)
        for rank, (score, name) in enumerate(found, 1)
    ]
    matches = spark.createDataFrame(
        rows, "sample_id string, channel string, rank int, score double, text string, image_path string")
    samples = spark.createDataFrame([(s, s.upper()) for s in MATCHES], "sample_id string, query_text string")
    return samples, matches


def categories(tables, threshold):
    classified = coverage.classify(coverage.facts(*tables), threshold)
    return {r.sample_id: r.category for r in classified.collect()}


def test_categories(tables):
    assert categories(tables, 0.5) == {
        "c1": "agree", "c2": "agree", "c3": "both", "c4": "both", "c5": "image", "c6": "text", "c7": "none"}


def test_no_result_still_reaches_zero(tables):
    at_zero = categories(tables, 0.0)
    assert at_zero["c7"] == "both" and at_zero["c3"] == "agree"


def test_counters(tables):
    row = coverage.summary(coverage.facts(*tables), 0.5).first().asDict()
    assert {k: v for k, v in row.items() if not k.endswith("_pct")} == {
        "total": 7, "image_hits": 5, "text_hits": 5, "both_hits": 4, "agree_hits": 2, "no_hits": 1}
    assert row["image_hits_pct"] == 71 and row["no_hits_pct"] == 14


def test_counters_of_nothing(tables):
    row = coverage.summary(coverage.facts(tables[0].limit(0), tables[1]), 0.5).first()
    assert row.total == 0 and row.image_hits_pct == 0


def test_sweep_agrees_with_single_thresholds_and_falls(tables):
    covered = coverage.facts(*tables)
    rows = {r.threshold: r for r in coverage.sweep(covered).collect()}
    assert sorted(rows) == [i / 20 for i in range(21)]
    for threshold in (0.0, 0.4, 0.5, 0.9):
        single = coverage.summary(covered, threshold).first()
        assert all(single[k] == rows[threshold][k] for k in single.asDict())
    for name in ("image_hits", "text_hits", "both_hits", "agree_hits"):
        counts = [rows[t][name] for t in sorted(rows)]
        assert counts == sorted(counts, reverse=True)
    for r in rows.values():
        assert r.both_hits <= min(r.image_hits, r.text_hits) and r.agree_hits <= r.both_hits
        assert r.no_hits + r.image_hits + r.text_hits - r.both_hits == r.total


def test_filters_overlap(tables):
    classified = coverage.classify(coverage.facts(*tables), 0.5)
    shown = {name: {r.sample_id for r in coverage.filtered(classified, name).collect()} for name in coverage.FILTERS}
    assert shown["image"] == {"c1", "c2", "c3", "c4", "c5"} and shown["text"] == {"c1", "c2", "c3", "c4", "c6"}
    assert shown["both"] == {"c1", "c2", "c3", "c4"} and shown["agree"] == {"c1", "c2"} and shown["none"] == {"c7"}
    membership = {(r["filter"], r.sample_id) for r in coverage.filter_membership(classified).collect()}
    assert membership == {(name, s) for name, ids in shown.items() for s in ids}
    with pytest.raises(ValueError):
        coverage.filtered(classified, "other")


def test_agreed_matches(tables):
    classified = coverage.classify(coverage.facts(*tables), 0.5)
    agreed = coverage.agreed_matches(tables[1], classified, 0.5).collect()
    assert {(r.sample_id, r.text, r["rank"], r.sequence) for r in agreed} == {("c1", "A", 1, 1), ("c2", "A", 2, 1)}


def test_shown_and_hidden(tables):
    counts = {(r.sample_id, r.channel): (r.n_shown, r.n_hidden) for r in coverage.shown_hidden(tables[1], 0.5).collect()}
    assert counts[("c3", "image")] == (1, 1) and counts[("c6", "image")] == (0, 1) and counts[("c5", "image")] == (1, 0)


def test_overview_order(tables):
    rows = coverage.overview(coverage.classify(coverage.facts(*tables), 0.5)).collect()
    assert [r.stem for r in rows] == ["c1", "c2", "c3", "c4", "c5", "c6", "c7"]
    assert rows[-1].best_image == 0.0 and rows[0].text == "C1"


def test_score_bands(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.91,), (0.9,), (0.71,), (0.7,)], "s double")
    assert [r[0] for r in rows.select(coverage.score_band(F.col("s"))).collect()] == ["high", "mid", "mid", "low"]
