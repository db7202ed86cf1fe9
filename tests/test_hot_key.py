"""The SQL comparison again on tables where one key holds a third of all rows."""

import duckdb
import pytest

from bindloom import catalog
from oracle_check import TABLES, compare, connect

catalog.load()
SF = "/root/testdata/sf0.001"
HOT = {
    "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_suppkey END AS l_suppkey) FROM t",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS o_custkey) FROM t",
    "embeddings": "SELECT * REPLACE (CASE WHEN vec_id % 3 = 0 THEN 1 ELSE label END AS label) FROM t",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM t",
    "conversations": "SELECT * REPLACE (CASE WHEN conv_id % 3 = 0 THEN 20 * (conv_id // 3) ELSE conv_id END AS conv_id) FROM t",
}
NAMES = [
    "agg_pairs", "agg_validate", "top_best_pair", "flt_ligand_overlap", "join_wt_mutant", "join_target_offtarget", "agg_off_summary", "pairs_target_off",
    "bucket_difficulty", "stat_spearman", "group_tertiles", "top_pose_window", "rank_composite", "filter_decoys_iqr", "agg_progress", "agg_failures",
    "pocket_residues", "nearest_ligand_atoms", "score_mean_of_means", "msa_sample", "msa_nearest_cluster", "msa_merge", "assign_ids", "agg_join_limited",
]


@pytest.fixture(scope="module")
def hot(tmp_path_factory):
    folder = tmp_path_factory.mktemp("hot")
    con = duckdb.connect()
    for name in TABLES:
        source = f"read_parquet('{SF}/{name}.parquet')"
        query = HOT.get(name, "SELECT * FROM t").replace("FROM t", f"FROM {source}")
        con.execute(f"COPY ({query}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, hot, name):
    n, problem = compare(catalog.QUERIES[name](spark, hot), connect(hot), catalog.ORACLES[name])
    assert not problem and n > 0
