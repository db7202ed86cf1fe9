"""Language identification: held-out accuracy, what it may learn from, odd texts."""

import zlib

import numpy as np
import pytest

from bindloom.llm import language as G
from bindloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return G.fit(docs)


def test_held_out_accuracy(spark, docs):
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = QUERIES["op13_language"](spark, SF).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.lang_pred in {"en", "de", "fr", "es"} for r in rows)


def test_learns_from_permitted_rows_only(docs, model):
    other = docs.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 'zz ' || text ELSE text END AS text",
                            "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 'xx' ELSE lang END AS lang", "'s' AS source")
    more = other.unionByName(other.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "'yy' AS lang", "source"))
    again = G.fit(more.unionByName(other.selectExpr("doc_id", "'new words' AS text", "CAST(NULL AS STRING) AS lang", "source")).repartition(7))
    assert again.languages == model.languages and again.temperature == model.temperature
    assert np.array_equal(again.weights, model.weights) and np.array_equal(again.idf, model.idf)


def test_odd_texts(spark, odd, nothing, model):
    texts = ["", None, " \n", "123 ,;", "́̂", "the of and", "der die das und", "漢字", "😀", "É"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'q' AS lang_pred", "2 AS score", "'en' AS lang")
    got = G.identify(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    by_id = {r.doc_id: r for r in got.collect()}
    assert [by_id[i].lang_pred for i in range(5)] == ["und"] * 5 and all(by_id[i].score == 0 for i in range(5))
    assert by_id[5].lang_pred == "en" and by_id[6].lang_pred == "de" and by_id[7].lang_pred != "und" and by_id[8].lang_pred == "und"
    assert G.identify(odd, model, keep=["doc_id"]).count() == odd.count()
    assert G.identify(nothing, model).count() == 0
    empty = G.fit(nothing.selectExpr("doc_id", "text", "'en' AS lang"))
    assert {(r.lang_pred, r.score) for r in G.identify(df, empty).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(1, "alpha beta", "aa"), (1, "alpha beta", "aa"), (2, "gamma", None), (3, None, "bb")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in G.identify(df.filter("doc_id > 4"), G.fit(one)).collect()} == {"aa", "und"}


def test_columns_do_not_depend_on_length():
    text = "Über den Fluß, 12 Bäume. " * 400
    at, times = G.columns_of(text)
    grams = {}
    points = G.letters_of(text).tolist()
    assert "".join(map(chr, points)).startswith(" über den fluß bäume ")
    for n in range(1, G.LONGEST + 1):
        for i in range(len(points) - n + 1):
            key = tuple(points[i : i + n])
            grams[key] = grams.get(key, 0) + 1
    assert times.sum() == sum(grams.values()) and len(at) <= len(grams)
    short = G.columns_of("Über den")
    assert set(short[0].tolist()) <= set(at.tolist())
