"""Cases beyond former limits: any seed numbers, long sequences, missing names and values."""

import random

import pytest
from pyspark.sql import functions as F

from bindloom.functions import sequences as Q
from bindloom.operators import ranking as R, statistics as T, templates as M


def test_all_seed_pairs_whatever_their_numbers(spark):
    rows = [("c", s, [float(s * k % 7) for k in range(9)]) for s in (1, 2, 3, 40)]
    df = spark.createDataFrame(rows, "complex string, seed int, xyz array<double>")
    pairs = R.seed_pairs(df, ["complex"], "seed", ["xyz"]).select("seed", "other").collect()
    assert sorted(map(tuple, pairs)) == [(a, b) for a in (1, 2, 3, 40) for b in (1, 2, 3, 40) if a < b]
    many = spark.range(700).selectExpr("'c' AS complex", "id AS seed", "array(1D, 2D, 3D) AS xyz")
    got = R.seed_pairs(many, ["complex"], "seed", ["xyz"]).agg(F.count("seed"), F.count_distinct(F.struct("seed", "other"))).first()
    assert tuple(got) == (700 * 699 // 2,) * 2


@pytest.mark.parametrize("n", [150, 200, 300, 2000])
def test_one_deletion_is_one_edit(n):
    rng = random.Random(n)
    letters = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)]
    letters[9:12] = "AWC"
    text = "".join(letters)
    assert Q.describe_edit(text, text[:10] + text[11:]) == ("del11", 0, 0, 1)


@pytest.mark.parametrize("missing", [[float("nan")] * 2, [None] * 2, [None, float("nan")]])
def test_confidence_falls_back_if_missing_throughout(spark, missing):
    df = spark.createDataFrame([("a", i, 1.0, m, 90.0) for i, m in enumerate(missing)], "label string, idx int, rmsd double, plddt double, plddt_pde double")
    none = spark.createDataFrame([], "label string, rmsd_threshold double, plddt_threshold double")
    assert R.filter_ensemble(df, none, "label", "idx", 2.0, 50.0, 5).count() == 2


def test_one_known_confidence_is_used_for_its_label(spark):
    rows = [("a", 0, 1.0, 80.0, 10.0), ("a", 1, 1.0, None, 90.0), ("a", 2, float("nan"), 80.0, 90.0), ("a", 3, None, 80.0, 90.0)]
    df = spark.createDataFrame(rows, "label string, idx int, rmsd double, plddt double, plddt_pde double")
    none = spark.createDataFrame([], "label string, rmsd_threshold double, plddt_threshold double")
    assert [r.idx for r in R.filter_ensemble(df, none, "label", "idx", 2.0, 50.0, 5).collect()] == [0]


def test_missing_values_take_no_part_in_statistics(spark):
    nan = float("nan")
    rows = [("p", float(i), float(i * i)) for i in range(30)] + [("p", nan, 3.0), ("p", 5.0, nan), ("p", None, 1.0), ("p", 2.0, None), ("p", nan, nan)]
    df = spark.createDataFrame(rows, "p string, x double, y double")
    rho = T.spearman(df, "p", "x", "y").first()
    assert rho.rho == pytest.approx(1) and rho.n_pairs == 30
    plain = T.pearson(df.limit(30), "x", "y").first()
    r = T.pearson(df, "x", "y").first()
    assert r.n == 30 and r.r == pytest.approx(plain.r) and 0.9 < r.r < 1
    u = T.mann_whitney(df, "x", F.col("y") < 100).first()
    assert (u.n_a, u.n_b) == (10 + 0, 20 + 0) or u.n_a + u.n_b == 31  # the row (2, null) is in neither group
    assert T.pearson(df.limit(0), "x", "y").first().n == 0


def test_an_epoch_is_full(spark):
    items = spark.createDataFrame([("en", i) for i in range(5)] + [("es", 9), ("zz", 11)], "lang string, id long")
    got = M.mix_epoch(items, "lang", "id", {"en": 2, "fr": 5, "es": 1, "de": 0}, 300).collect()
    assert sorted(r.slot for r in got) == list(range(300)) and {r.lang for r in got} == {"en", "es"}
    assert 60 < sum(r.lang == "es" for r in got) < 140
    times = [sum(r.id == i for r in got) for i in range(5)]
    assert max(times) - min(times) <= 1
    assert M.mix_epoch(items.filter("id > 100"), "lang", "id", {"en": 1.0}, 10).count() == 0


def test_decoys_without_file_names_stay_apart(spark):
    df = spark.createDataFrame([(1, i, None, 10.0, 1.0, 0.0) for i in range(6)], "c int, row int, file string, totalscore double, fa_rep double, ddg double")
    assert R.filter_decoys_second(df, ["c"], "file", "row", 10).count() == 6
