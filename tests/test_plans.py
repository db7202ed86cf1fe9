"""Plan checks: no product joins, pushed filters, early rank limits, same result on any partitioning."""

import pytest
from pyspark.sql import functions as F

from bindloom import catalog
from bindloom.catalog import adapters as D

catalog.load()
SF = "/root/testdata/sf0.001"
def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rank_limit_before_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["top_pose_window"](spark, SF))


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(catalog.QUERIES["src_parquet"](spark, SF))
    assert "EqualTo(l_returnflag,R)" in text and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


@pytest.mark.parametrize("name", ["agg_validate", "top_best_model", "bucket_difficulty", "filter_decoys_iqr", "nearest_ligand_atoms", "msa_sample"])
def test_partitioning_does_not_matter(spark, monkeypatch, name):
    rows = lambda: sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))
    want = rows()
    for n in (1, 17):
        monkeypatch.setattr(D, "spread", lambda df, n=n: df.repartition(n))
        assert rows() == want
