"""Steps whose memory or time once grew faster than their input: same rows as a plain count, and no such step in the plan."""

import difflib
import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from bindloom import catalog
from bindloom.catalog import assay, files
from bindloom.functions import sequences as Q
from bindloom.operators import designs as E, sampling as G, similarity as N, structures as J
from bindloom.sources import readers as R
from oracle_check import compare

catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold, bits, most", [(0.3, 30, 20), (0.5, 20, 15), (0.4, 1500, 900)])
def test_similar_pairs_once(spark, threshold, bits, most):
    """Every pair once, from many blocks, with keys that repeat or are missing, and with more bits than words hold."""
    rng = random.Random(bits)
    rows = [(i - i % 40 // 39 if i != 17 else None, i % 2, rng.sample(range(bits), rng.randint(most // 2, most))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, g int, bits array<int>")
    got = N.similar_pairs(df, df, ["g"], "id", threshold, block=9, once=True).collect()
    want = []
    for (i, g, a), (j, h, b) in itertools.permutations(rows, 2):
        t = len(set(a) & set(b)) / len(set(a) | set(b))
        if g == h and None not in (i, j) and i < j and t >= threshold:
            want.append((i, j, pytest.approx(t)))
    key = lambda p: p[:2]
    assert sorted(((r.id_1, r.id_2, r.similarity_2d) for r in got), key=key) == sorted(want, key=key) and got


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("threshold, bits, most", [(0.45, 20, 15), (0.45, 1500, 900), (0.6, 400, 6), (1.0, 30, 2)])
def test_similar_pairs_without_key_or_bits(spark, threshold, bits, most, once):
    """No pair is lost where a key is missing or repeated, or where both sets are empty: dense and sparse groups, many blocks."""
    rng = random.Random(bits)
    base = [rng.sample(range(bits), rng.randint(1, most)) for _ in range(25)]
    rows = [(None if i % 4 == 1 else i // 2, (0, 1, None)[i % 3], [] if i % 7 == 2 else None if i % 11 == 5 else base[rng.randrange(25)], i % 5 < 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, g int, bits array<int>, near boolean")
    left, right = (df, df) if once else (df.filter("near"), df.filter("NOT near"))
    got = N.similar_pairs(left, right, ["g"], "id", threshold, block=9, once=once).collect()
    want = []
    for (i, g, a, near), (j, h, b, far) in itertools.permutations(rows, 2):
        if g != h or None in (a, b) or (None in (i, j) or i >= j if once else not near or far or (i is not None and i == j)):
            continue
        t = len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else math.nan
        if not t < threshold:
            want.append((g, i, j, round(t, 9)))
    assert sorted(map(str, want)) == sorted(str((r.g, r.id_1, r.id_2, round(r.similarity_2d, 9))) for r in got)
    assert any(math.isnan(t[3]) for t in want) and once != any(t[2] is None for t in want)


@pytest.mark.parametrize("name", ["pairs_target_off", "pairs_all_similar"])
def test_similar_pairs_match_sql_on_odd_vectors(spark, tmp_path, name):
    """Vectors without an id, without a positive value, without values, and twice the same ones."""
    rng = random.Random(4)
    rows = [(None if i % 6 == 1 else i - i % 20 // 19 * 3, [rng.uniform(-1, 0.2 if i % 5 else 0) for _ in range(16 * (i % 13 > 0))], i % 2) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    n, problem = compare(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])
    assert not problem and n > 0


def test_dense_pairs_travel_as_words(spark):
    rows = spark.range(60).selectExpr("id", "0 AS g", "transform(sequence(0, 19), b -> CAST((id + b) % 30 AS INT)) AS bits")
    text = plan(N.similar_pairs(rows, rows, ["g"], "id", 0.5, block=7, once=True))
    assert "bit_count" in text


def test_replaced_ids_come_in_several_files(spark):
    value = F.concat(F.lit("OBSLTE    31-JUL-94 A001     B"), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(" "))
    rows = spark.range(3000).select(F.col("id").alias("ord"), value.alias("value")).repartition(5)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = R.text_lines(spark, files.write_list(spark, rows, "ids"))
        assert lines.select("file").distinct().count() > 1
        assert [tuple(r) for r in R.parse_replaced_ids(lines).collect()] == [("a001", "b999")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_records_are_numbered_in_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "RUN_LINES", 3)
    (tmp_path / "a.fa").write_text("\n" + "".join(f">h{i}\n" + "AC\nDE\n" * (i % 4) for i in range(30)))
    lines = R.text_lines(spark, str(tmp_path))
    assert "_run" in plan(R.number_records(lines, F.col("value").startswith(">")))
    got = {r.idx: (r.header, r.sequence) for r in R.parse_fasta(lines).collect()}
    assert got == {i: (f"h{i}", "ACDE" * (i % 4)) for i in range(30)}


def test_similarity_rows_are_not_shuffled_again(spark):
    df = spark.createDataFrame([(1, "p", "a", "off_target"), (2, "p", "b", "off_target"), (3, "p", "c", "target"), (4, "q", "c", "target"), (5, None, "a", "target")], "row_id int, protein string, ligand string, target_type string")
    sims = spark.createDataFrame([("p", "a", None, "x"), ("p", "b", "t2", "x"), ("p", "b", "t1", "y"), ("p", "c", None, "z")], "protein string, off_ligand string, target_ligand string, bucket string")
    out = J.merge_similarity(df, sims, "protein", "ligand", "row_id")
    got = sorted((r.row_id, r.target_ligand or "", r.bucket) for r in out.collect())
    assert got == [(1, "", "x"), (2, "t1", "y"), (2, "t2", "x"), (3, "t1", "z"), (4, "", "target"), (5, "", "target")]
    # the similarity rows are joined last
    assert "ligand" in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]


def test_funnel_joins_the_ids_once(spark):
    pairs = spark.createDataFrame([(1, "u", "a", "S1;S2;S3;S4"), (2, "u", "b", "S1"), (3, "v", "a", "S1"), (4, "u", "a", None), (5, "u", None, "S2")], "row_id int, u string, het string, ids string")
    meta = spark.createDataFrame([("S1", ["u"], ["A1G"], 1.0), ("S2", ["u"], None, 0.0), ("S3", ["u"], [], 2.0), ("S4", ["w"], None, 1.0)], "pdb_id string, uniprot_ids array<string>, mutations array<string>, resolution double")
    ligands = spark.createDataFrame([("S1", "A"), ("S1", "A"), ("S2", "a"), ("S3", "A"), ("S9", "A"), ("S2", None)], "pdb_id string, het_id string")
    out = J.structure_funnel(pairs, meta, ligands, "row_id", "ids", "u", "het")
    got = {r.row_id: (r.n_ids, r.n_protein, r.n_ligand, r.n_wild_type, r.valid_pdb_id, r.status) for r in out.collect()}
    assert got == {1: (4, 3, 3, 2, "S3", "valid"), 2: (1, 1, 0, 0, None, "no ligand match"), 3: (1, 0, 0, 0, None, "no protein match"), 4: (0, 0, 0, 0, None, "no ids"), 5: (1, 1, 0, 0, None, "no ligand match")}
    assert "_hit" not in plan(out)


def test_positions_are_compared_once(spark):
    rows = [("ABCDE", "ABXDEFG", [1, 0, 1, None, 0]), ("AB", "", [1, 1]), ("AAAA", "AABB", None), ("AB", "AB", [0, 0]), (None, "A", [1])]
    df = spark.createDataFrame(rows, "a string, b string, m array<int>")
    out = E.regional_identity(df, "a", "b", "m")
    got = [tuple(r)[3:] for r in out.collect()]
    assert got == [(0.8, 0.5, 1.0), (0.0, 0.0, 0.0), (0.5, 0.0, 0.0), (1.0, 0.0, 1.0), (0.0, 0.0, 0.0)]
    assert plan(out).count("arrays_zip(") == 1


@pytest.mark.parametrize("letters", ["AC", "ACDEFGHIKLMNPQRSTVWY"])
def test_letter_matcher_finds_the_same_blocks(letters):
    rng = random.Random(1)
    for n in (0, 1, 5, 40, 300):
        a = "".join(rng.choices(letters, k=n))
        for b in (a.replace("AC", "D"), "".join(rng.choices(letters, k=n + 3)), a[n // 2 :] + a[: n // 2]):
            plain = difflib.SequenceMatcher(a=a, b=b, autojunk=False)
            assert Q.LetterMatcher(a=a, b=b, autojunk=False).get_opcodes() == plain.get_opcodes()


def test_groups_that_stand_still_leave_the_rounds(spark, monkeypatch):
    """One group settles at once, the other takes several rounds; the later rounds deal with the latter alone."""
    rows = [("a", i, float(i % 2 * 100), 2) for i in range(8)] + [("b", i, float(i * i % 97 + i), 6) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, k int, f double, n int")
    groups = []
    write = G.written
    monkeypatch.setattr(G, "written", lambda t, name: (lambda w: groups.append(w.select("g").distinct().count()) or w)(write(t, name)))
    got = G.diversity_sample(df, ["g"], "k", ["f"], "n").groupBy("g").count().collect()
    assert {(r.g, r["count"]) for r in got} == {("a", 2), ("b", 6)}
    assert groups[1] == 2 and groups[-1] == 1


def test_audit_makes_the_pairs_once(spark, monkeypatch):
    made = []
    write = assay.written
    monkeypatch.setattr(assay, "written", lambda t, name: made.append(name) or write(t, name))
    out = catalog.QUERIES["snk_audit"](spark, "/root/testdata/sf0.001")
    assert made == ["pairs"] and "FileScan" in plan(out) and out.count() == 5
