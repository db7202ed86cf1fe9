"""Readers on real files: several blocks per file, several documents, empty files."""

import os

import pytest
from pyspark.sql import functions as F

from bindloom.sources import readers as R
from bindloom.streaming import progress as live


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_across_blocks(spark, tmp_path, small_blocks):
    records = [(f"rec{i}, id={i}, T=0.1, seed=7, overall_confidence=0.5, ligand_confidence=0.25, seq_rec=0.5", "ACDEFGHIKL" * (5 + i % 40)) for i in range(60)]
    text = "".join(f">{h}\n" + "\n".join(s[k : k + 50] for k in range(0, len(s), 50)) + "\n\n" for h, s in records)
    (tmp_path / "a.fa").write_text(text)
    lines = R.text_lines(spark, str(tmp_path))
    assert lines.select("block").distinct().count() > 5
    got = R.parse_fasta(lines).orderBy("idx").collect()
    assert [(r.header, r.sequence) for r in got] == records
    designs = R.parse_designs(R.text_lines(spark, str(tmp_path))).orderBy("idx").collect()
    assert len(designs) == 59 and designs[0].id == 1 and designs[0].overall_confidence == 0.5 and designs[0].name == "rec1"


def test_a3m(spark, tmp_path):
    (tmp_path / "m.a3m").write_text(">q\nACDE\n>h\nAbcCd-E\n")
    got = R.parse_a3m(R.text_lines(spark, str(tmp_path))).orderBy("idx").collect()
    assert [(r.aligned, r.deletions) for r in got] == [("ACDE", [0, 0, 0, 0]), ("AC-E", [0, 2, 1, 0])]


def test_stockholm(spark, tmp_path):
    (tmp_path / "m.sto").write_text("# STOCKHOLM 1.0\n#=GS hit/1-4 DE [subseq from] a thing\n\nquery AC-D\nhit/1-4 A-GD\n\nquery -E\nhit/1-4 KE\n//\n")
    lines = R.text_lines(spark, str(tmp_path))
    got = {r.name: (r.aligned, r.deletions, r.is_query) for r in R.parse_stockholm(lines).collect()}
    assert got == {"query": ("ACDE", [0, 0, 0, 0], True), "hit/1-4": ("A-DE", [0, 0, 1, 1], False)}
    a3m = {r.name: r.a3m for r in R.stockholm_to_a3m(lines).collect()}
    assert a3m["hit/1-4"] == ">hit/1-4 [subseq from] a thing\nA-gDkE"


def test_constraints(spark, tmp_path):
    (tmp_path / "bias.json").write_text('{\n"./x.pdb": {"C1": {"A": 3.0,\n "P": -2.0}}\n}\n')
    (tmp_path / "fix.json").write_text('{"./x.pdb": "C1 C2", "./y.pdb": ["A7", "A8"]}')
    (tmp_path / "list.json").write_text('["1abc", "2def"]')
    bias = R.read_constraints(spark, str(tmp_path / "bias.json"), "bias").collect()
    assert {(r.residue, r.aa, r.value) for r in bias} == {("C1", "A", 3.0), ("C1", "P", -2.0)}
    fixed = R.read_constraints(spark, str(tmp_path / "fix.json"), "fixed").collect()
    assert {(r.structure_id, r.residue) for r in fixed} == {("./x.pdb", "C1"), ("./x.pdb", "C2"), ("./y.pdb", "A7"), ("./y.pdb", "A8")}
    assert [r.id for r in R.read_id_list(spark, str(tmp_path / "list.json")).collect()] == ["1abc", "2def"]


def test_status_files(spark, tmp_path):
    for name, text in {"c1/1_a.success": "", "c1/1_a.failed": "x\nError: old\n", "c1/2_b.failed": "log\nError: no poses here\nmore", "c2/1_a.skip": "x", "c2/readme.txt": "?"}.items():
        os.makedirs(tmp_path / name.split("/")[0], exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {(r.complex_id, r.stage): (r.status, r.error) for r in R.read_status_files(spark, str(tmp_path)).collect()}
    assert got == {("c1", "1_a"): ("success", None), ("c1", "2_b"): ("failed", "no poses here"), ("c2", "1_a"): ("skip", None)}


def test_atoms_of_models(spark, tmp_path):
    line = "ATOM  {s:5d}  CA  ALA A{r:4d}{i:1s}   {x:8.3f}{x:8.3f}{x:8.3f}  {o:4.2f} 10.00           C"
    rows = ["MODEL        1", line.format(s=1, r=52, i="", x=1.5, o=1), line.format(s=2, r=52, i="A", x=-2.25, o=1), "ENDMDL", "MODEL        2", line.format(s=3, r=53, i="", x=3, o=0), "ENDMDL"]
    (tmp_path / "x.pdb").write_text("\n".join(rows) + "\n")
    lines = R.text_lines(spark, str(tmp_path))
    got = [(r.model, r.resseq, r.icode, r.x, r.element) for r in R.parse_atoms(lines).orderBy("serial").collect()]
    assert got == [(1, 52, "", 1.5, "C"), (1, 52, "A", -2.25, "C")]
    assert R.parse_atoms(lines, zero_occupancy=True).count() == 3


def test_stream_keeps_newest(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    batch = lambda rows: spark.createDataFrame(rows, live.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(source)
    batch([(1, "a", "failed", "x", at(1), 1), (2, "a", "success", None, at(1), 2)])
    live.start(live.read_events(spark, source), target, mark).awaitTermination()
    batch([(1, "a", "success", None, at(5), 3), (2, "a", "failed", "late", at(0), 4)])  # the second one is older
    live.start(live.read_events(spark, source), target, mark).awaitTermination()
    got = {(r.stage, r.status): r.n for r in live.progress_counts(spark, target).collect()}
    assert got == {("a", "success"): 2}


def test_delimited_quarantine(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(' Target   Name\tKi (nM)\n"a b"\t>10\nbad\t1\t2\n"x"\t\n')
    good, bad = R.read_delimited(spark, str(tmp_path / "a.tsv"))
    assert good.columns == ["Target Name", "Ki (nM)"] and good.count() == 2
    assert bad.count() == 1
