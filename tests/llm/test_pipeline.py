"""Registered queries on the smallest tables: SQL twins, brute force on documents, the pipeline's stages."""

import hashlib

import pytest

from bindloom.llm import queries as L
from oracle_check import compare, connect
from test_joins import plain_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(L.ORACLES))
def test_matches_sql(spark, name):
    assert compare(L.QUERIES[name](spark, SF), connect(SF), L.ORACLES[name])[1] == ""


def test_near_duplicates_of_the_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = L.QUERIES["op5_ngram_join"](spark, SF).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_stages(spark):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, SF), "stage")
        after = docs.count()
        assert docs.columns == columns and 0 < after <= before, name
        before = after
    last = C.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(last) == len(texts)
    assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in last)


def test_pipeline_on_odd_documents(spark, odd, tmp_path):
    import corpus_pipeline as C

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in C.STAGES[1:]:  # without labels every score is a half, and nothing is accepted
        docs = C.written(stage(spark, docs, str(tmp_path)), "odd")
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, 4, None, 7, 8, 9}
    assert C.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_other_columns_and_unlinked_rows(spark, tmp_path):
    import corpus_pipeline as C

    long = " ".join(f"w{i}" for i in range(40))
    near = long + " more"
    other = " ".join(f"u{i}" for i in range(30))
    texts = [(1, long), (5, long), (5, other), (7, near), (7, other + " x"), (8, None), (8, None), (None, long), (9, "one two")]
    clash = "score predicted n_lines n_removed n_worded n_words n_hit contaminated class_key component_key n_shingles _id _text _k0 _first ids n_tokens".split(" ")
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", *[f"'own {x}' AS {x}" for x in clash])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[x] == f"own {x}" for r in rows for x in clash), name
        kept[name] = sorted(((r.doc_id, r.text) for r in rows), key=str)
    assert kept["n-gram Jaccard join"] == sorted([(1, long), (5, other), (8, None), (None, long), (9, "one two")], key=str)
    assert (9, "one two") not in kept["benchmark decontamination"] and len(kept["benchmark decontamination"]) == 8
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(texts)
