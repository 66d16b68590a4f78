"""Plans are those that a large cluster wants."""

from pathlib import Path

import pytest

from loamgrid.plans import pipeline, problems

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(pipeline.page_lookup(spark, FOLDER))
    assert "EqualTo(code,700001)" in text and "EqualTo(page,1)" in text
    assert "embed_text" not in plan(pipeline.chunk_stats_by_company(spark, FOLDER))
    assert "answer" not in plan(pipeline.missed_targets(spark, FOLDER))


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_rrf", "alias_match", "coverage_matrix", "section_asof", "chunk_catalog"])
def test_no_product_of_tables(spark, name):
    assert "CartesianProduct" not in plan(pipeline.QUERIES[name](spark, FOLDER))


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(pipeline.bm25_topk(spark, FOLDER))


def test_units_stay_one_pass(spark):
    text = plan(problems.p1_found(spark, FOLDER))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text
