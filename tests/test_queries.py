"""Every registered query against its SQL, at the smallest scale (where some images have no document)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference
from traincover.plans import on_tables
from traincover.plans.expected_sql import EXPECTED
from traincover.plans.on_tables import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    assert difference(spark, con, SF, queries()[name], oracle_sql()[name]) is None


def test_only_the_approximate_search_has_no_sql():
    assert set(QUERIES) - set(EXPECTED) == {"ann_recall"}


def test_recall_is_whole_when_every_cell_is_probed(spark):
    recall = {row.nprobe: row.recall for row in queries()["ann_recall"](spark, SF).collect()}
    assert recall[16] == 1.0
    assert 0 < recall[1] <= recall[4] <= 1.0


def test_entry_runs(spark):
    assert entry(spark).count() == 21


def test_lines_hold_all_turns_of_conversations(spark, con):
    lines = on_tables.jsonl_lines(spark, SF).where("value like '{\"data_uuid\"%'")
    turns = lines.selectExpr("size(try_variant_get(parse_json(value), '$.data', 'array<variant>')) AS n").agg({"n": "sum"}).first()[0]
    assert turns == con.sql("SELECT count(*) FROM conversations").fetchall()[0][0]
