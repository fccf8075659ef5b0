"""Rows with a null id hold windows like any other, and each row of an id is judged by its own text."""

import corpus_pipeline
import pytest
from basewise.llm import decontam

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
ROWS = [(None, f"so {ITEM} it is"), (None, "some other words alone"), (4, ITEM), (4, "more words of the same id"), (5, "alpha bravo"), (6, "delta echo foxtrot golf hotel india juliet")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, ITEM)], "item_id long, text string")


def test_op6(docs, items):
    got = {r.doc_id: (r.n_hit, r.contaminated) for r in decontam.op6_query(docs, items).collect()}
    assert got == {None: (10, True), 4: (10, True), 5: (0, False), 6: (0, False)}


def test_proximity(docs, items):
    assert {r.doc_id for r in decontam.proximity_query(docs, items).collect()} == {None, 4}


def test_proximity_is_not_pooled_over_null_ids(spark):
    """Words of different rows never make one window."""
    parts = spark.createDataFrame([(None, "alpha x x x x x x x x x"), (None, "x bravo x x x x x x x x"), (None, "x x charlie x x x x x x x")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha bravo charlie")], "item_id long, text string")
    assert decontam.proximity_query(parts, items).count() == 0


def test_stage(spark, docs, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == sorted((i or 0, t) for i, t in ROWS if ITEM not in t)
