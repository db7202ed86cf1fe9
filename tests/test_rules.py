"""Rule branches on hand-made rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bindloom.functions import affinity as A, sequences as Q, similarity as M, superposition as U, text as X
from bindloom.operators import alignments as L, assay as O, ranking as R, sampling as G, scores as C, spatial as P, structures as J, templates as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize(
    "cell, want",
    [(">1000", [1000.0]), ("<0.5", [0.5]), ("1,000", [1.0]), ("5;7 9", [5.0, 7.0, 9.0]), ("", []), ("0", []), ("-3", []), ("abc; 1e3", [1000.0]), (None, [])],
)
def test_numbers_in(spark, cell, want):
    assert one(spark, X.numbers_in(F.lit(cell).cast("string"))) == want


def _validated(spark, values):
    df = spark.createDataFrame([("p", "l", float(v), i) for i, v in enumerate(values)], "p string, l string, nM double, id int")
    return O.validate_replicates(O.aggregate_pairs(df, ["p", "l"], "nM", "id")).first()


def test_replicates(spark):
    assert _validated(spark, [20]).reason == "single_value" and _validated(spark, [20, 20]).representative_nM == 20
    assert _validated(spark, [100]).reason == "median_in_gray_zone"
    assert _validated(spark, [31.6]).reason == "single_value" and _validated(spark, [3160.0]).reason == "single_value"
    r = _validated(spark, [10, 20, 25])
    px = -np.log10(np.array([10, 20, 25]) * 1e-9)
    assert r.reason == "valid_std" and r.detail == f"{px.std(ddof=1):.3f}" and r.representative_nM == pytest.approx(20)
    assert _validated(spark, [10, 1000]).reason == "high_std"
    # many equal values keep the spread small while the range crosses both categories
    r = _validated(spark, [20] * 60 + [5000])
    assert r.reason == "crosses_categories" and r.detail == "20.00-5000.00"
    r = _validated(spark, [100, 110, 120])
    assert r.reason == "median_in_gray_zone" and not r.is_valid and r.detail == "110.00"


def test_labels(spark):
    v = spark.createDataFrame([(31.6,), (31.7,), (3159.0,), (3160.0,), (None,)], "v double").select(A.label_nm(F.col("v")).alias("t")).collect()
    assert [r.t for r in v] == ["target", None, None, "off_target", None]
    d = spark.createDataFrame([(1.0,), (0.29,), (0.3,), (-1.0,), (-0.5,), (None,)], "v double")
    fine = [r.t for r in d.select(A.label_delta(F.col("v")).alias("t")).collect()]
    assert fine == ["target", "nochange", "below_par", "negative", "below_par", None]
    second = [r.t for r in d.select(A.label_delta(F.col("v"), 0.5, -0.5, None).alias("t")).collect()]
    assert second == ["target", "nochange", "nochange", "negative", "negative", None]


@pytest.mark.parametrize(
    "label, want",
    [("E199V", (None, "E", 199, "V")), ("A:199V", ("A", None, 199, "V")), ("A:E199V", ("A", "E", 199, "V")), ("A:199:E>V", ("A", "E", 199, "V")), ("A:199:V", ("A", None, 199, "V")), ("A:199", ("A", None, 199, None)), ("x?", None)],
)
def test_labels_of_mutations(spark, label, want):
    got = one(spark, Q.parse_label(F.lit(label)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "a, b, want",
    [("ABCDEF", "ABXDEF", ("C3X", 1, 0, 0)), ("ABCDEF", "ABDEF", ("del3", 0, 0, 1)), ("ABCDEF", "ABEF", ("del3-4", 0, 0, 2)), ("ABEF", "ABCDEF", ("ins2:CD", 0, 2, 0)), ("ABC", "ABC", ("", 0, 0, 0))],
)
def test_edit_text(a, b, want):
    assert Q.describe_edit(a, b) == want


def test_codes(spark):
    assert [one(spark, Q.het_code(F.lit(x))) for x in (" atp ", "123", "ABCD", "a1")] == ["ATP", None, None, "A1"]
    assert one(spark, Q.code_map(F.lit("6ta3:mzk;6TIW:ABCD, 6ta3:xyz"))) == {"6TA3": "XYZ", "6TIW": "ABC"}
    assert one(spark, Q.substitutions(F.lit("AB-D"), F.lit("ABCD"))) is None
    assert one(spark, Q.substitutions(F.lit("ABCD"), F.lit("AXCE"))) == ["B2X", "D4E"]


def test_similarity_properties(spark):
    rng = np.random.default_rng(0)
    rows = [([int(x) for x in rng.choice(128, rng.integers(0, 20), replace=False)], [int(x) for x in rng.choice(128, rng.integers(0, 20), replace=False)]) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    w = lambda c: M.pack_bits(F.col(c), 2)
    got = df.select(M.tanimoto(w("a"), w("b")).alias("x"), M.tanimoto(w("b"), w("a")).alias("y"), M.tanimoto_sets(F.col("a"), F.col("b")).alias("z")).collect()
    assert all(r.x == r.y == pytest.approx(r.z) and 0 <= r.x <= 1 for r in got)
    # every differing property adds 4 to the squared distance of two scaled rows
    sim = one(spark, M.physchem([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.lit(1.0), F.lit(5.0), F.lit(9.0)]))
    assert sim == pytest.approx(math.exp(-math.sqrt(8)))


def test_funnel(spark):
    pairs = spark.createDataFrame([(1, "", "U", "ATP"), (2, "1aaa,2bbb", "U", "ATP"), (3, "3ccc;4ddd", "U", "ATP"), (4, "5eee 6fff", "U", "ATP"), (5, "7ggg;8hhh,9iii", "U", "ATP")], "r int, ids string, u string, het string")
    meta = spark.createDataFrame(
        [("1AAA", ["X"], [], 1.0), ("3CCC", ["U"], [], 1.0), ("5EEE", ["U"], ["A1G"], 1.0), ("7GGG", ["U"], [], 0.0), ("8HHH", ["U"], [], 2.5), ("9III", ["U", "X"], None, 2.0)],
        "pdb_id string, uniprot_ids array<string>, mutations array<string>, resolution double",
    )
    lig = spark.createDataFrame([("5EEE", "atp"), ("7GGG", "ATP"), ("8HHH", "ATP"), ("9III", "ATP"), ("3CCC", "GOL")], "pdb_id string, het_id string")
    got = {r.r: (r.status, r.valid_pdb_id) for r in J.structure_funnel(pairs, meta, lig, "r", "ids", "u", "het").collect()}
    assert got == {1: ("no ids", None), 2: ("no protein match", None), 3: ("no ligand match", None), 4: ("no wild-type structure", None), 5: ("valid", "9III")}


def test_best_model(spark):
    cols = "entry int, idx int, all_passed boolean, passes_valence_checks boolean, passes_kekulization boolean, number_clashes int, confidence_score double, vina_score_min double"
    rows = [
        (1, 0, False, True, True, 0, 0.9, -9.0), (1, 1, False, True, True, 0, 0.95, -1.0),  # none valid: best confidence
        (2, 0, True, True, True, 2, 0.99, -9.0), (2, 1, True, True, True, 0, 0.80, -5.0), (2, 2, True, True, True, 0, 0.79, -6.0),  # margin: lower score
        (3, 0, True, True, True, 0, None, -3.0), (3, 1, True, True, True, 0, None, -4.0),  # no confidence: lowest score
        (4, 0, True, True, True, 0, 0.8, None), (4, 1, True, True, True, 0, 0.81, None),  # no score: best confidence
        (5, 0, False, False, True, 1, None, None), (5, 1, False, False, True, 1, None, -1.0),  # nothing: first model
        (6, 0, True, True, True, 0, 0.9, None), (6, 1, True, True, True, 0, 0.7, -9.0),  # outside the margin
    ]
    got = O.best_model(spark.createDataFrame(rows, cols), "entry", "idx").select("entry", "idx").collect()
    assert {r.entry: r.idx for r in got} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 0, 6: 0}


def test_diversity_contract(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i % 3}", i, float(c), float(c) + rng.normal(0, 0.01), 4) for i, c in enumerate(rng.integers(0, 4, 90) * 10)]
    rows += [("small", 1000 + i, float(i), 0.0, 4) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id int, a double, b double, k int")
    out = G.diversity_sample(df, ["g"], "id", ["a", "b"], "k").collect()
    sizes = pd.Series([r.g for r in out]).value_counts().to_dict()
    assert sizes == {"g0": 4, "g1": 4, "g2": 4, "small": 3}
    again = G.diversity_sample(df.repartition(7), ["g"], "id", ["a", "b"], "k").collect()
    assert {r.id for r in out} == {r.id for r in again}


def test_diversity_sample_settles(spark):
    """Lloyd's rounds in numpy from the same first centres, until nothing moves."""
    rng = np.random.default_rng(11)
    rows = [("g", i, *map(float, rng.normal(rng.choice([-3, 0, 4]), 1, 2)), 7) for i in range(300)] + [("h", i, 1.0, 2.0, 3) for i in range(9)] + [("e", 1, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, id int, a double, b double, k int")
    got = G.diversity_sample(df, ["g"], "id", ["a", "b"], "k").collect()
    order = {r.id: r.h for r in df.filter("g = 'g'").select("id", G.hash_order("g", "id").alias("h")).collect()}
    ids = sorted(order, key=order.get)
    z = np.array([rows[i][2:4] for i in ids])
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    centres = z[:7]
    while True:
        near = ((z[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        now = np.array([z[near == j].mean(axis=0) for j in range(7)])
        if np.abs(now - centres).max() < 1e-9:
            break
        centres = now
    want = {ids[np.flatnonzero(near == j)[0]] for j in range(7)}
    assert {r.id for r in got if r.g == "g"} == want
    assert sum(r.g == "h" for r in got) == 3 and not any(r.g == "e" for r in got)


def test_priority_quota(spark):
    rows = [("p", f"t{i}", "target", 8.6 if i < 2 else 7.6, float(i)) for i in range(8)]
    rows += [("p", f"o{i}", "off_target", 4.0 if i < 6 else 5.0, float(i)) for i in range(9)] + [("q", "t", "target", 9.0, 1.0)]
    df = spark.createDataFrame(rows, "p string, l string, target_type string, px double, mw double")
    got = G.sample_by_priority(df, "p", "l", "px", ["mw", "px"], 3).collect()
    assert {r.p for r in got} == {"p"}
    t = [r for r in got if r.target_type == "target"]
    o = [r for r in got if r.target_type == "off_target"]
    assert len(t) == 3 and len(o) == 3 and {"t0", "t1"} <= {r.l for r in t} and all(r.px == 4.0 for r in o)


def plain_rmsd(a, b):
    """By singular values; no reflection."""
    a, b = (np.reshape(x, (-1, 3)) for x in (a, b))
    if a.shape != b.shape:
        return None
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    s = np.linalg.svd(a.T @ b, compute_uv=False)
    s[2] *= np.sign(np.linalg.det(a.T @ b))
    return np.sqrt(max(0.0, (a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a))


def test_superposed_rmsd(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(7, 3)) * 5
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    flat, line = a * [1, 1, 0], a * [1, 0, 0]
    pairs = [(a, a @ turn + 3), (a, -a), (a, rng.normal(size=(7, 3))), (flat, -flat @ turn), (line, -line), (a[:1], a[1:2]), (a[:2], a[3:5]), (a * 1e4, a[::-1] * 1e4), (0 * a, a), (0 * a, 0 * a)]
    rows = [(x.ravel().tolist(), y.ravel().tolist()) for x, y in pairs]
    bad = [([1.0] * 9, [1.0] * 6), (None, [1.0] * 6), ([], []), ([1.0] * 4, [1.0] * 4), ([1.0, None, 2.0], [1.0, 2.0, 3.0]), ([1.0, float("nan"), 2.0], [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows + bad, "a array<double>, b array<double>")
    got = [r.v for r in df.select(U.superposed_rmsd(U.centred(F.col("a")), U.centred(F.col("b"))).alias("v")).collect()]
    assert got[len(rows) :] == [None] * len(bad)
    for x, (u, v) in zip(got, pairs):
        assert x == pytest.approx(plain_rmsd(u, v), rel=1e-6, abs=1e-5 * max(1, np.abs(u).max()))


def plain_poses(poses, n_select):
    """(pose, cluster) in order of rank, by farthest points."""
    poses = sorted(poses, key=lambda p: (p[1], p[0]))
    n, apart = len(poses), lambda a, b: round(x, 9) if (x := plain_rmsd(a[2], b[2])) is not None else 999.0
    k = 1 if n <= n_select else min(n_select, max(3, n // 3))
    centres, near = [poses[0]], []
    while True:
        near = [min((apart(p, t), i) for i, t in enumerate(centres)) for p in poses]
        if len(centres) == k:
            break
        centres.append(poses[max(range(n), key=lambda i: (near[i][0], -i))])
    seen, late = {}, []
    for p, (_, i) in zip(poses, near):
        seen[i] = seen.get(i, 0) + 1
        share = n if n <= n_select else max(1, sum(j == i for _, j in near) * n_select // n)
        late.append((seen[i] > share, p[1], p[0], i + 1))
    return [(p, i) for _, _, p, i in sorted(sorted(late)[:n_select], key=lambda x: (x[1], x[2]))]


def test_pose_clusters(spark):
    rng = np.random.default_rng(7)
    shapes = [rng.normal(size=(6, 3)) * 5 for _ in range(4)]
    rows = [("c", i, (shapes[i % 4] + rng.normal(0, 0.01, (6, 3))).ravel().tolist(), 0 if i % 10 else 3, float(i % 13)) for i in range(40)]
    rows += [("clash", i, shapes[0].ravel().tolist(), 2 + i, 1.0) for i in range(5)]
    rows += [("odd", i, rng.normal(size=(5 + (i == 17), 3)).ravel().tolist(), 0, float(i % 7)) for i in range(30)]
    rows += [("many", i, rng.normal(size=(4, 3)).ravel().tolist(), 0, float(i % 11)) for i in range(1500)]
    df = spark.createDataFrame(rows, "config string, pose int, xyz array<double>, n_clashes int, com_distance double")
    got = R.cluster_poses(df, "config", "pose", "xyz", 8, 15.0).orderBy("config", "rank").collect()
    c = [r for r in got if r.config == "c"]
    assert {r.pose % 4 for r in c} == {0, 1, 2, 3} and all(r.pose % 10 for r in c)
    assert sorted(r.pose for r in got if r.config == "clash") == [0, 1, 2]  # relaxed to the least clashes + 2
    for config in ("c", "odd", "many"):
        mine = [r for r in got if r.config == config]
        assert [r["rank"] for r in mine] == list(range(1, 9))
        poses = [(p, d, xyz) for name, p, xyz, n, d in rows if name == config and n == 0]
        assert [(r.pose, r.cluster) for r in mine] == plain_poses(poses, 8)
    assert R.cluster_poses(df.limit(0), "config", "pose", "xyz").count() == 0


def test_decoy_relaxation(spark):
    rows = [("g", i, float(i), 1.0 if i < 3 else 9.0, 1.0, -1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, id int, energy double, ca_rmsd double, all_atom_rmsd double, interface double")
    level = lambda k: {r.level for r in R.filter_decoys(df, ["g"], "id", k).collect()}
    assert level(3) == {0} and level(4) == {1} and level(11) == {3}


def test_renumber(spark):
    numbers = [52, 52, 52, 53, 54, 54, 55]
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate(numbers)], "s string, pos int, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "3", "9"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = P.renumber(df.unionByName(df.withColumn("s", F.lit(None))), ["s"], "pos", "n").orderBy("s", "pos").collect()
            assert [r.n_new for r in got] == [52, 53, 54, 55, 56, 57, 58] * 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_site_map(spark):
    res = spark.createDataFrame([("s", "A", 5, 0, "E"), ("s", "B", 5, 1, "K"), ("s", "A", 6, 2, "V")], "st string, chain string, resseq int, idx int, aa string")
    lab = spark.createDataFrame([("s", "5V", None, 5, None), ("s", "E5V", None, 5, "E"), ("s", "b:5V", "b", 5, None), ("s", "W6V", None, 6, "W"), ("s", "9V", None, 9, None)], "st string, label string, chain string, pos int, wt string")
    got = {r.label: (r.idx, r.status) for r in C.map_sites(lab, res, "st").collect()}
    assert got == {"5V": (None, "ambiguous"), "E5V": (0, "ok"), "b:5V": (1, "ok"), "W6V": (2, "mismatch"), "9V": (None, "not found")}


def test_template_locate(spark):
    chains = spark.createDataFrame([("p", "A", 0, "MKVLAXGT"), ("p", "B", 1, "GGMKVLA")], "pdb string, chain string, ord int, seqres string")
    hits = spark.createDataFrame([(1, "p", "B", "KVL"), (2, "p", "C", "KVL"), (3, "p", "A", "LARGT"), (4, "p", "A", "KXL"), (5, "p", "A", "WWW")], "id int, pdb string, chain string, sequence string")
    got = {r.id: (r.tier, r.found_chain, r.offset) for r in T.locate(hits, chains, "id").collect()}
    assert got == {1: (0, "B", 3), 2: (1, "A", 1), 3: (2, "A", 3), 4: (2, "A", 1), 5: (None, None, None)}


def test_mean_of_means_is_not_pooled(spark):
    df = spark.createDataFrame([("r1", 0, 1.0), ("r1", 1, 3.0), ("r2", 0, 10.0)], "run string, batch int, logit double").withColumn("aa", F.lit("A"))
    assert C.mean_of_means(df, ["aa"], "run").first().logit == pytest.approx(6.0)


def test_p_values(spark):
    from bindloom.functions import stats as P2

    # known values: r = 0.5 over 10 pairs, chi-square 3.841 with one degree, z = 1.96
    row = spark.range(1).select(
        P2.correlation_p(F.lit(0.5), F.lit(10)).alias("r"), P2.chi2_p(F.lit(3.841458820694124), F.lit(1)).alias("c"),
        P2.normal_p(F.lit(1.959963984540054)).alias("z"), P2.chi2_p(F.lit(100.0), F.lit(81)).alias("d"),
    ).first()
    assert row.r == pytest.approx(0.14111328125, rel=1e-9) and row.c == pytest.approx(0.05, rel=1e-9) and row.z == pytest.approx(0.05, rel=1e-9)
    assert row.d == pytest.approx(0.0748, abs=2e-3)


def test_cluster_assignment_without_agreement(spark):
    rows = [("q", 0, p, a, "sample") for p, a in enumerate("ACD")] + [("q", 3, p, a, "sample") for p, a in enumerate("WCD")] + [("q", 5, p, a, "extra") for p, a in enumerate("WCE")] + [("q", 6, p, "-", "extra") for p in range(3)]
    df = spark.createDataFrame(rows, "q string, i int, pos int, aa string, part string")
    got = {r.i: r.centre for r in L.nearest_cluster(df, "q", "i").collect()}
    assert got == {5: 3, 6: 0}


@pytest.mark.parametrize("gap_weight", [0.0, 0.5])
def test_nearest_cluster_by_bit_planes(spark, gap_weight):
    rng = np.random.default_rng(5)
    letters = list("ACDW-*X")
    rows = {(q, i): rng.choice(letters, 150).tolist() for q in "ab" for i in range(25)}
    rows["a", 20] = rows["a", 3][:70] + [None] * 80
    long = [(q, i, p, x, "sample" if i < 6 else "extra") for (q, i), r in rows.items() for p, x in enumerate(r) if not (i == 21 and p < 64)]
    df = spark.createDataFrame(long + [("c", 0, 0, "A", "sample"), ("c", 1, 900, "A", "extra")], "q string, i int, pos int, aa string, part string")
    got = {(r.q, r.i): r.centre for r in L.nearest_cluster(df, "q", "i", gap_weight).collect()}
    weight = lambda x: gap_weight if x == "-" else 0.0 if x == "*" else 1.0
    for (q, i), r in rows.items():
        if i >= 6:
            score = lambda c: sum(weight(x) for p, (x, y) in enumerate(zip(r, rows[q, c])) if x == y is not None and not (i == 21 and p < 64))
            assert got[q, i] == max(range(6), key=lambda c: (score(c), -c))
    assert got["c", 1] == 0 and len(got) == 2 * 19 + 1
