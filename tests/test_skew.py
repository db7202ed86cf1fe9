"""Distributed ranking, quantiles, cells and distance joins against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bindloom.operators import similarity as N
from bindloom.plans import grid as G, skew as S


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key; many ties; one null key."""
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 40, n).astype(str))
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "v": np.round(rng.normal(0, 30, n), 1)})
    pdf.loc[pdf.index % 97 == 0, "key"] = None
    return pdf


@pytest.mark.parametrize("parts", [1, 17])
def test_ranked(spark, hot, parts):
    df = spark.createDataFrame(hot).repartition(parts)
    got = S.ranked(df, ["key"], [F.col("v"), F.col("id")], "rn", total="n").toPandas()
    want = hot.assign(key=hot.key.fillna("-")).sort_values(["v", "id"])
    want["rn"] = want.groupby("key").cumcount() + 1
    m = got.merge(want[["id", "rn"]], on="id", suffixes=("", "_w"))
    assert len(m) == len(hot) and (m.rn == m.rn_w).all()
    assert (got.groupby(got.key.fillna("-")).n.first() == want.groupby("key").size()).all()


def test_a_key_of_one_value_spreads_over_the_ranges(spark):
    n = 1_000_000
    df = spark.range(n).selectExpr("'k' AS k", "1.0 AS v", "id * 7919 % 1000003 AS i").unionByName(spark.createDataFrame([(None, 1.0, 3), (None, 0.5, 4)], "k string, v double, i long"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows are small enough for one task
    try:
        rows = S.in_ranges(df, ["k"], [F.col("v"), F.col("i")])
        assert rows.groupBy("_range").count().agg(F.max("count")).first()[0] < n / 20
        got = S.ranked(df, ["k"], [F.col("v"), F.col("i")], "rn", total="n")
        in_order = got.filter("k IS NOT NULL").agg(F.count_distinct("rn"), F.max("rn"), F.min("n"), F.corr("rn", "i")).first()
        assert in_order[:3] == (n, n, n) and in_order[3] > 0.999
        assert sorted((r.v, r.rn) for r in got.filter("k IS NULL").collect()) == [(0.5, 1), (1.0, 2)]
        assert S.ranked(df.limit(0), ["k"], [F.col("i")]).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("parts", [1, 17])
def test_exact_quantiles(spark, hot, parts):
    df = spark.createDataFrame(hot).repartition(parts)
    got = S.exact_quantiles(df, ["key"], "v", {"q1": 0.25, "med": 0.5, "top": 0.95}).toPandas()
    got = got.assign(key=got.key.fillna("-")).set_index("key").sort_index()
    g = hot.assign(key=hot.key.fillna("-")).groupby("key").v
    for name, p in (("q1", 0.25), ("med", 0.5), ("top", 0.95)):
        np.testing.assert_allclose(got[name], g.quantile(p).sort_index(), rtol=1e-12, atol=1e-12)
    one = S.exact_quantiles(df, [], "v", {"med": 0.5}).collect()
    assert one[0].med == pytest.approx(hot.v.median())


def test_large_top_k(spark, hot):
    df = spark.createDataFrame(hot).withColumn("key", F.lit("one"))
    got = S.top_k(df, ["key"], [F.col("v"), F.col("id")], 1500).select("id", "rn").collect()
    want = hot.sort_values(["v", "id"]).id.head(1500).tolist()
    assert [r.id for r in sorted(got, key=lambda r: r.rn)] == want


def test_a_key_with_many_values_stays_one_row(spark):
    df = spark.range(10_050).selectExpr("'a' AS k", "concat('x', lpad(id, 5, '0')) AS v").unionByName(spark.createDataFrame([("b", "y"), ("b", " ")], "k string, v string"))
    rows = S.joined_cells(df.unionByName(df), ["k"], {"ids": "v"}).orderBy("k").collect()
    assert [r.k for r in rows] == ["a", "b"] and rows[1].ids == "y"
    assert rows[0].ids == ";".join(f"x{i:05d}" for i in range(10_050))


def test_nan_is_missing_for_quantiles_and_last_in_ranks(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(9)] + [(9, float("nan")), (10, None), (11, float("inf"))], "id int, v double")
    assert S.exact_quantiles(df.filter("id < 11"), [], "v", {"med": 0.5}).collect()[0].med == 4.0
    got = S.ranked(df.filter("id <> 10"), [], [F.col("v")], "rn").orderBy("rn").collect()
    assert [r.id for r in got] == [*range(9), 11, 9]


def _points(rng, n, name):
    return pd.DataFrame({"s": rng.integers(0, 3, n), name: np.arange(n), "x": rng.normal(0, 9, n), "y": rng.normal(0, 9, n), "z": rng.normal(0, 9, n)})


def _distances(a, b, ka, kb):
    m = a.merge(b, on="s", suffixes=("", "_r"))
    m["d2"] = (m.x - m.x_r) ** 2 + (m.y - m.y_r) ** 2 + (m.z - m.z_r) ** 2
    return m[["s", ka, kb, "d2"]]


def test_within_radius(spark):
    rng = np.random.default_rng(1)
    a, b = _points(rng, 60, "p"), _points(rng, 300, "q")
    got = G.within_radius(spark.createDataFrame(a), spark.createDataFrame(b), ["s"], 5.0).select("p", "r_q").toPandas()
    d = _distances(a, b, "p", "q")
    want = d[d.d2 <= 25]
    assert len(want) > 20 and set(zip(got.p, got.r_q)) == set(zip(want.p, want.q)) and len(got) == len(want)


def test_k_nearest_reaches_far_points(spark):
    rng = np.random.default_rng(2)
    a, b = _points(rng, 40, "p"), _points(rng, 120, "q")
    a.loc[:3, ["x", "y", "z"]] = 3e6  # nothing within the first radii
    b = b[(b.s != 2) | (b.q < 40)]
    b.loc[:30, ["x", "y", "z"]] = np.round(b.loc[:30, ["x", "y", "z"]])  # ties
    b.loc[40:60, ["x", "y", "z"]] = [1.0, 2.0, 3.0]
    got = G.k_nearest(spark.createDataFrame(a), spark.createDataFrame(b), ["s"], ["p"], "q", 4).select("p", "r_q", "rank").toPandas()
    d = _distances(a, b, "p", "q").sort_values(["d2", "q"])
    d["rank"] = d.groupby("p").cumcount() + 1
    want = d[d["rank"] <= 4]
    assert set(zip(got.p, got.r_q, got["rank"])) == set(zip(want.p, want.q, want["rank"]))


@pytest.mark.parametrize("k", [1, 5, 40])
def test_k_nearest_of_uneven_points(spark, k):
    """Clusters of very different density, one far point on either side, missing coordinates, fewer points than ``k``."""
    rng = np.random.default_rng(k)
    near = [rng.normal(c, s, (n, 3)) for c, s, n in ((0, 0.01, 60), (5, 1, 60), (900, 40, 60), (-2e5, 1e-3, 20))]
    b = pd.DataFrame(np.concatenate([*near, [[1e7, 0, 0]]]), columns=["x", "y", "z"]).assign(s=0)
    b = pd.concat([b, pd.DataFrame({"x": [1.0, 1.0, 2.0], "y": 0.0, "z": 0.0, "s": 1})], ignore_index=True)
    b["q"] = np.arange(len(b))
    a = pd.DataFrame(np.concatenate([rng.normal(0, 3, (40, 3)), rng.normal(900, 60, (20, 3)), [[0, 0, 0], [-1e6, 1e6, 5]]]), columns=["x", "y", "z"]).assign(s=0)
    a = pd.concat([a, pd.DataFrame({"x": [1.0, 50.0], "y": 0.0, "z": 0.0, "s": [1, 2]})], ignore_index=True)
    a["p"] = np.arange(len(a))
    sa, sb = spark.createDataFrame(a), spark.createDataFrame(b)
    sa = sa.unionByName(spark.range(1).selectExpr("999L AS p", "CAST('NaN' AS DOUBLE) AS x", "0D AS y", "0D AS z", "0L AS s"))
    sb = sb.unionByName(spark.range(1).selectExpr("999L AS q", "CAST(NULL AS DOUBLE) AS x", "0D AS y", "0D AS z", "0L AS s"))
    got = G.k_nearest(sa, sb, ["s"], ["p"], "q", k)
    assert got.columns == ["x", "y", "z", "s", "p", "r_x", "r_y", "r_z", "r_q", "d2", "rank"]
    d = _distances(a, b, "p", "q").sort_values(["d2", "q"])
    d["rank"] = d.groupby("p").cumcount() + 1
    want = d[d["rank"] <= k]
    assert sorted((r.p, r.rank, r.r_q) for r in got.collect()) == sorted(zip(want.p, want["rank"], want.q))


@pytest.mark.parametrize("threshold, bits, most", [(0.2, 40, 12), (0.5, 40, 12), (0.8, 2000, 40), (1.0, 40, 3), (0.5, 14, 13), (0.9, 30, 29)])
def test_similar_pairs(spark, threshold, bits, most):
    rng = np.random.default_rng(3)
    base = [sorted(rng.choice(bits, rng.integers(1, most), replace=False).tolist()) for _ in range(60)]
    rows = [(i, i % 2, b if i % 3 else base[0]) for i, b in enumerate(base)]
    rows[7] = (7, 1, [])
    df = spark.createDataFrame(rows, "id int, g int, bits array<int>")
    got = N.similar_pairs(df.filter("id < 30"), df.filter("id >= 25"), ["g"], "id", threshold, block=7).collect()
    want = {}
    for i, g, a in rows[:30]:
        for j, h, b in rows[25:]:
            t = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
            if g == h and i != j and t >= threshold:
                want[i, j] = t
    assert {(r.id_1, r.id_2): pytest.approx(r.similarity_2d) for r in got} == want and len(got) == len(want)
