"""Readers. Text formats are parsed from lines: a file is split into blocks by Spark, records
are numbered by a running count inside each block plus the totals of the blocks before, so
a file of any size is read by many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

CORRUPT = "_corrupt"
RUN_LINES = 4096  # lines numbered together


# ---- tables


def clean_header(name: str) -> str:
    return " ".join(name.split())


def read_delimited(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, DataFrame]:
    """All-string table with normalised headers, and the rows that do not fit it.

    Only the header line is looked at beforehand; bad rows go to the second result.
    """
    options = dict(sep=sep, quote='"', escape="\\", header=True, recursiveFileLookup=True, columnPruning=False)
    names = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(schema).csv(path)
    raw = raw.toDF(*[clean_header(n) for n in names], CORRUPT)
    # Spark refuses plans that read nothing but the corrupt column, such as a count of rows
    raw = raw.filter(F.length(F.coalesce(F.col(clean_header(names[0])), F.lit(""))) >= 0)
    bad = F.col(CORRUPT).isNotNull()
    return raw.filter(~bad).drop(CORRUPT), raw.filter(bad)


def read_gzip_csv(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """Compressed CSV: one task per file while reading, spread out afterwards."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.repartition(partitions) if partitions else df.repartition()


def read_run_csvs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Summary CSVs of several runs with their file name and the seed in it; missing files are
    skipped, columns may differ. ``paths`` is a short list of runs, each may be large."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def exists(p):
        path = jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(conf).exists(path)

    tables = [spark.read.csv(p, header=True).withColumn("source", F.lit(p.rstrip("/").rsplit("/", 1)[-1])) for p in paths if exists(p)]
    if not tables:
        raise ValueError("none of the summary files exists")
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    seed = F.regexp_extract("source", r"_([0-9]+)\.csv$", 1)
    return merged.withColumn("seed", F.when(seed != "", seed))


def read_constraints(spark: SparkSession, path: str, kind: str, one_per_line: bool = False) -> DataFrame:
    """Design constraints: (structure, residue, kind, aa, value), from one JSON document per
    file, or one per line for large sets.

    bias: {structure: {residue: {aa: value}}}; omit: {structure: {residue: letters}};
    fixed / redesign: {structure: "residues separated by blanks"} or a list.
    """
    text = spark.read.text(path, wholetext=not one_per_line)
    if kind == "bias":
        m = F.from_json("value", "map<string,map<string,map<string,double>>>")
        x = text.select(F.explode(m).alias("structure_id", "_r")).select("structure_id", F.explode("_r").alias("residue", "_a"))
        x = x.select("structure_id", "residue", F.explode("_a").alias("aa", "value"))
    elif kind == "omit":
        m = F.from_json("value", "map<string,map<string,string>>")
        x = text.select(F.explode(m).alias("structure_id", "_r")).select("structure_id", F.explode("_r").alias("residue", "_l"))
        x = x.select("structure_id", "residue", F.explode(F.filter(F.split("_l", ""), lambda c: c != "")).alias("aa"))
        x = x.withColumn("value", F.lit(None).cast("double"))
    else:
        m = F.from_json("value", "map<string,string>")
        x = text.select(F.explode(m).alias("structure_id", "_l"))
        bare = F.regexp_replace("_l", r'[\[\]",]', " ")
        x = x.select("structure_id", F.explode(F.filter(F.split(F.trim(bare), r"\s+"), lambda c: c != "")).alias("residue"))
        x = x.withColumn("aa", F.lit(None).cast("string")).withColumn("value", F.lit(None).cast("double"))
    return x.withColumn("kind", F.lit(kind))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of ids (or the keys of an object) as rows."""
    text = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", "array<string>")
    as_keys = F.map_keys(F.from_json("value", "map<string,string>"))
    return text.select(F.explode(F.when(F.trim("value").startswith("["), as_list).otherwise(as_keys)).alias("id"))


# ---- text lines


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with file, block and their order inside the block."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )


def number_records(lines: DataFrame, start: Column, name: str = "rec") -> DataFrame:
    """Running number of the record a line belongs to; a record begins where ``start`` holds.

    Lines before the first start of a file get 0. Lines are numbered inside runs of ``RUN_LINES`` and the starts of
    the runs before are added, so that no task has to hold a block of a file.
    """
    x = lines.withColumn("_start", F.coalesce(start.cast("int"), F.lit(0))).withColumn("_run", F.floor(F.col("line") / RUN_LINES))
    run = ["file", "block", "_run"]
    runs = x.groupBy(*run).agg(F.sum("_start").alias("_n"))
    upto = W.partitionBy("file").orderBy("block", "_run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*run, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*run).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    x = x.join(runs, run)
    return x.withColumn(name, F.col("_before") + F.sum("_start").over(inside)).drop("_start", "_before", "_run")


def _joined(value: Column, sep: str = "") -> Column:
    """Texts of a record in line order; a record is as long as its sequence."""
    cell = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("block", "line", value.alias("v")))))
    return F.array_join(F.transform(cell, lambda s: s["v"]), sep)


def parse_fasta(lines: DataFrame) -> DataFrame:
    """FASTA records: file, idx (from 0), header, sequence."""
    v = F.trim("value")
    head = v.startswith(">")
    x = number_records(lines, head).filter("rec > 0")
    text = F.when(~head & (v != ""), v)
    out = x.groupBy("file", "rec").agg(F.max(F.when(head, F.substr(v, F.lit(2)))).alias("header"), _joined(text).alias("sequence"))
    return out.select("file", (F.col("rec") - 1).alias("idx"), "header", "sequence")


def parse_designs(lines: DataFrame, skip_native: bool = True) -> DataFrame:
    """Designed sequences with the ``key=value`` fields of their headers; the first record of a
    file is the native sequence."""
    f = parse_fasta(lines)
    f = f.filter("idx > 0") if skip_native else f

    def field(key, kind):
        found = F.regexp_extract("header", rf"(?:^|[ ,]){key}=([^,\s]+)", 1)
        return F.when(found != "", found).try_cast(kind).alias(key)

    kinds = {"id": "long", "T": "double", "seed": "long", "overall_confidence": "double", "ligand_confidence": "double", "seq_rec": "double"}
    return f.select(
        "file", "idx", F.trim(F.substring_index("header", ",", 1)).alias("name"), "sequence", *[field(k, t) for k, t in kinds.items()]
    )


def split_insertions(sequence: Column) -> tuple[Column, Column]:
    """Aligned sequence and number of lower-case letters before each of its columns."""
    before = F.regexp_extract_all(sequence, F.lit("([a-z]*)[^a-z]"), 1)
    return F.regexp_replace(sequence, "[a-z]", ""), F.transform(before, lambda s: F.length(s))


def parse_a3m(lines: DataFrame) -> DataFrame:
    aligned, deleted = split_insertions(F.col("sequence"))
    return parse_fasta(lines).withColumn("aligned", aligned).withColumn("deletions", deleted).drop("sequence")


def _stockholm_rows(lines: DataFrame) -> DataFrame:
    """Blocks of every sequence joined in line order, with the first line as position."""
    v = F.trim("value")
    body = lines.filter((v != "") & ~v.startswith("#") & ~v.startswith("//"))
    parts = body.select("file", "block", "line", F.split(v, r"\s+")[0].alias("name"), F.split(v, r"\s+")[1].alias("chunk"))
    rows = parts.groupBy("file", "name").agg(F.min(F.struct("block", "line")).alias("_at"), _joined(F.col("chunk")).alias("sequence"))
    query = rows.groupBy("file").agg(F.min_by("sequence", "_at").alias("query"), F.min("_at").alias("_q"))
    return rows.join(query, "file").withColumn("is_query", F.col("_at") == F.col("_q")).drop("_q")


def _columns(sequence: str, query: str) -> Column:
    chars = lambda c: F.filter(F.split(F.col(c), ""), lambda x: x != "")
    return F.arrays_zip(chars(sequence).alias("s"), chars(query).alias("q"))


def parse_stockholm(lines: DataFrame) -> DataFrame:
    """Sequences on the columns of the query, with deletions before each column."""
    zipped = _columns("sequence", "query")
    # d marks a residue without a query column, | a query column
    marks = F.array_join(
        F.transform(zipped, lambda c: F.when(c["q"] != "-", "|").when(c["s"] != "-", "d").otherwise("")), ""
    )
    kept = F.array_join(F.transform(F.filter(zipped, lambda c: c["q"] != "-"), lambda c: c["s"]), "")
    deleted = F.transform(F.regexp_extract_all(marks, F.lit(r"(d*)\|"), 1), lambda s: F.length(s))
    return _stockholm_rows(lines).select("file", "name", "is_query", F.col("_at").alias("at"), kept.alias("aligned"), deleted.alias("deletions"))


def stockholm_to_a3m(lines: DataFrame, max_sequences: int | None = None) -> DataFrame:
    """A3M text per sequence: residues outside the query columns in lower case, with descriptions."""
    x = _stockholm_rows(lines)
    if max_sequences:
        w = W.partitionBy("file").orderBy("_at")
        x = x.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_sequences).drop("_rn")
    letters = F.transform(
        _columns("sequence", "query"), lambda c: F.when(c["q"] != "-", c["s"]).when(c["s"] != "-", F.lower(c["s"])).otherwise("")
    )
    notes = lines.filter(F.col("value").startswith("#=GS")).select(
        "file", "block", "line", F.regexp_extract("value", r"^\S+\s+(\S+)\s+DE\s*(.*)$", 1).alias("name"),
        F.regexp_extract("value", r"^\S+\s+(\S+)\s+DE\s*(.*)$", 2).alias("text"),
    ).filter("name <> ''")
    notes = notes.groupBy("file", "name").agg(F.max_by("text", F.struct("block", "line")).alias("description"))
    x = x.join(notes, ["file", "name"], "left")
    text = F.concat(F.lit(">"), "name", F.lit(" "), F.coalesce("description", F.lit("")), F.lit("\n"), F.array_join(letters, ""))
    return x.select("file", "name", F.col("_at").alias("at"), text.alias("a3m"))


def parse_evalues(lines: DataFrame) -> DataFrame:
    """Target and e-value of a search-hit table; the query itself has e-value 0, the last hit wins."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        "file", f[0].alias("target"), f[4].try_cast("double").alias("e_value"), F.struct("block", "line").alias("_at")
    )
    hits = rows.groupBy("file", "target").agg(F.max_by("e_value", "_at").alias("e_value"))
    own = lines.select("file").distinct().select("file", F.lit("query").alias("target"), F.lit(0.0).alias("e_value"))
    return own.join(hits.filter("target = 'query'").select("file"), "file", "left_anti").unionByName(hits)


def parse_replaced_ids(lines: DataFrame) -> DataFrame:
    """Replaced structure ids of a fixed-width list, the last entry of an id wins.

    A list may come in several files, in the order of their names. The last line of every distinct entry of a
    block is found first, with numbers alone in the state, so that the lines themselves are not sorted.
    """
    v = F.trim("value")
    rows = lines.filter(v.startswith("OBSLTE") & (F.length(v) > 30)).select(
        F.lower(F.substring(v, 21, 4)).alias("from_id"), F.lower(F.substring(v, 30, 4)).alias("to_id"), "file", "block", "line"
    )
    last = rows.groupBy("from_id", "to_id", "file", "block").agg(F.max("line").alias("line"))
    return last.groupBy("from_id").agg(F.max_by("to_id", F.struct("file", "block", "line")).alias("to_id"))


def parse_atoms(lines: DataFrame, chains: list[str] | None = None, zero_occupancy: bool = False) -> DataFrame:
    """Atoms of fixed-column structure text with model number (0 without MODEL lines)."""
    def cut(start, length):
        return F.trim(F.substring("value", start, length))

    x = number_records(lines, F.col("value").startswith("MODEL "), "model")
    x = x.filter(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM"))
    name = cut(13, 4)
    element = cut(77, 2)
    atoms = x.select(
        "file", "model", cut(1, 6).alias("record"), cut(7, 5).try_cast("long").alias("serial"), name.alias("atom"), cut(17, 1).alias("altloc"),
        cut(18, 3).alias("resname"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resseq"), cut(27, 1).alias("icode"),
        *[cut(31 + 8 * i, 8).try_cast("double").alias(a) for i, a in enumerate("xyz")],
        F.coalesce(cut(55, 6).try_cast("double"), F.lit(1.0)).alias("occupancy"), cut(61, 6).try_cast("double").alias("bfactor"),
        F.upper(F.when(element != "", element).otherwise(F.substring(name, 1, 1))).alias("element"),
    ).filter("x is not null and y is not null and z is not null")
    if not zero_occupancy:
        atoms = atoms.filter("occupancy > 0")
    return atoms.filter(F.col("chain").isin(*chains)) if chains else atoms


def parse_hhr(lines: DataFrame) -> DataFrame:
    """Template hits of HHR text: (file, hit, name, probability, e_value, aligned_cols, sum_probs, query_sequence, hit_sequence, indices_query, indices_hit).

    A hit begins at its ``No`` line. The query and template lines of its blocks are put together in order; the
    indices count residues from 0 and are -1 at gaps. Secondary structure and consensus lines are passed over.
    A hit without blocks has empty sequences.
    """
    x = number_records(lines, F.col("value").rlike(r"^No [0-9]+\s*$")).filter("rec > 0")
    part = r"^{} +(?!ss_dssp|ss_pred|ss_conf|Consensus)\S+ +([0-9]+) ([A-Za-z-]+) +[0-9]+ +\([0-9]+\)"
    field = lambda name: F.max(F.regexp_extract("value", rf"(?:^|\s){name}=([0-9.eE+-]+)", 1).try_cast("double"))
    line = F.struct("block", "line")

    def side(letter: str) -> tuple[Column, Column]:
        text, start = (F.regexp_extract("value", part.format(letter), i) for i in (2, 1))
        own = lambda i: F.length(F.replace(F.substring(text, F.lit(1), i), F.lit("-"), F.lit("")))
        # the residue at a place, from the residues of the line before it
        places = F.transform(F.split(text, ""), lambda v, i: F.when(v == "-", -1).otherwise(start.cast("int") - 1 + own(i)))
        cell = F.array_sort(F.collect_list(F.when(text != "", F.struct("block", "line", text.alias("t"), places.alias("i")))))
        return F.array_join(F.transform(cell, lambda r: r["t"]), ""), F.flatten(F.transform(cell, lambda r: r["i"]))

    (query, at_query), (hit, at_hit) = side("Q"), side("T")
    name = F.min_by(F.when(F.col("value").startswith(">"), F.substr("value", F.lit(2))), F.when(F.col("value").startswith(">"), line))
    return x.groupBy("file", "rec").agg(
        F.max(F.regexp_extract("value", r"^No ([0-9]+)\s*$", 1).try_cast("int")).alias("hit"), name.alias("name"),
        field("Probab").alias("probability"), field("E-value").alias("e_value"), field("Aligned_cols").cast("int").alias("aligned_cols"),
        field("Sum_probs").alias("sum_probs"), query.alias("query_sequence"), hit.alias("hit_sequence"),
        at_query.alias("indices_query"), at_hit.alias("indices_hit"),
    ).drop("rec")


_TOKEN = r"""'(?:[^']|'(?=\S))*'(?=\s|$)|"(?:[^"]|"(?=\S))*"(?=\s|$)|\S+"""


def parse_mmcif(lines: DataFrame, category: str) -> DataFrame:
    """Rows of one category of mmCIF text: (file, table, block, line, items), ``items`` a map from item to value.

    Looped rows and single ``_category.item value`` lines are read; the latter are one row per file. ``?``
    and ``.`` are unknown and left out. Values in text fields (lines from ``;`` to ``;``) and rows that go on over
    several lines are left out, too: the tables of atoms, dates and resolutions have none.
    """
    v = F.trim("value")
    x = number_records(lines, F.col("value").startswith(";"), "_texts").filter((F.col("_texts") % 2 == 0) & ~F.col("value").startswith(";"))
    x = number_records(x, (F.lower(v) == "loop_") | v.startswith("#") | F.lower(v).startswith("data_"), "table")
    mark = f"_{category}."
    tokens = F.regexp_extract_all("value", F.lit(_TOKEN), 0)
    bare = lambda t: F.when((F.length(t) > 1) & t.rlike("^(['\"]).*\\1$"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    x = x.select("file", "table", "block", "line", v.alias("v"), F.transform(tokens, bare).alias("t"))
    is_head = F.col("v").startswith(mark)
    # a table's head: the items in order and whether they have their values beside them
    order = F.array_sort(F.collect_list(F.struct("block", "line", F.substr(F.col("t")[0], F.lit(len(mark) + 1)).alias("item"), F.get("t", F.lit(1)).alias("value"))))
    heads = x.filter(is_head).groupBy("file", "table").agg(order.alias("_items"))
    known = lambda m: F.map_filter(m, lambda k, w: w.isNotNull() & ~w.isin("?", "."))
    looped = F.exists("_items", lambda i: i["value"].isNull())
    singles = heads.filter(~looped)
    single = F.map_from_entries(F.transform("_items", lambda i: F.struct(i["item"], i["value"])))
    first = F.col("_items")[0]
    singles = singles.select("file", "table", first["block"].alias("block"), first["line"].alias("line"), known(single).alias("items"))
    rows = x.filter((F.col("v") != "") & ~F.col("v").startswith("_") & (F.lower("v") != "loop_") & ~F.col("v").startswith("#"))
    rows = rows.join(heads.filter(looped), ["file", "table"]).filter(F.size("t") == F.size("_items"))
    row = F.map_from_arrays(F.transform("_items", lambda i: i["item"]), F.col("t"))
    return rows.select("file", "table", "block", "line", known(row).alias("items")).unionByName(singles)


def parse_mmcif_atoms(lines: DataFrame, chains: list[str] | None = None, zero_occupancy: bool = False) -> DataFrame:
    """Atoms of mmCIF text with the columns of ``parse_atoms``; names of the authors where given."""
    x = parse_mmcif(lines, "atom_site")
    item = lambda *names: F.coalesce(*[F.try_element_at("items", F.lit(n)) for n in names])
    text = lambda *names: F.coalesce(item(*names), F.lit(""))
    number = lambda *names: item(*names).try_cast("double")
    atoms = x.select(
        "file", F.coalesce(item("pdbx_PDB_model_num").try_cast("long"), F.lit(0)).alias("model"), text("group_PDB").alias("record"), item("id").try_cast("long").alias("serial"),
        text("auth_atom_id", "label_atom_id").alias("atom"), text("label_alt_id").alias("altloc"), text("auth_comp_id", "label_comp_id").alias("resname"),
        text("auth_asym_id", "label_asym_id").alias("chain"), item("auth_seq_id", "label_seq_id").try_cast("int").alias("resseq"), text("pdbx_PDB_ins_code").alias("icode"),
        *[number(f"Cartn_{a}").alias(a) for a in "xyz"], F.coalesce(number("occupancy"), F.lit(1.0)).alias("occupancy"), number("B_iso_or_equiv").alias("bfactor"),
        F.upper(text("type_symbol")).alias("element"),
    ).filter("x is not null and y is not null and z is not null")
    if not zero_occupancy:
        atoms = atoms.filter("occupancy > 0")
    return atoms.filter(F.col("chain").isin(*chains)) if chains else atoms


def parse_poses(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Poses of multi-model text: (file, model, pose_id, score) and their atoms."""
    start = F.col("value").startswith("MODEL")
    x = number_records(lines, start, "model").filter("model > 0")
    found = F.regexp_extract("value", r"^REMARK VINA RESULT:\s*(\S+)", 1).try_cast("double")
    number = F.regexp_extract("value", r"^MODEL\s+(\d+)", 1).try_cast("int")
    at = F.struct("block", "line")
    poses = x.groupBy("file", "model").agg(
        F.max(number).alias("pose_id"), F.max_by(found, F.when(found.isNotNull(), at)).alias("score"),
        F.count_if(F.col("value").startswith("ATOM") | F.col("value").startswith("HETATM")).alias("n_atoms"),
    )
    return poses, parse_atoms(lines, zero_occupancy=True).filter("model > 0")


def parse_status(files: DataFrame) -> DataFrame:
    """Status of every (complex, stage) from (path, text) of files ``complex/stage.status``;
    success comes before failed before skip. Failed files carry the error text."""
    parts = r"([^/]+)/([^/]+)\.(success|failed|skip)$"
    names = [F.regexp_extract("path", parts, i + 1).alias(n) for i, n in enumerate(("complex_id", "stage", "status"))]
    error = F.trim(F.regexp_extract("text", r"(?m)^Error:(.*)$", 1))
    x = files.select(*names, F.when(error != "", error).alias("error")).filter("status <> ''")
    order = F.when(F.col("status") == "success", 0).when(F.col("status") == "failed", 1).otherwise(2)
    best = F.min_by(F.struct("status", F.when(F.col("status") == "failed", F.col("error")).alias("error")), order).alias("_s")
    return x.groupBy("complex_id", "stage").agg(best).select("complex_id", "stage", "_s.status", "_s.error")


def read_status_files(spark: SparkSession, path: str) -> DataFrame:
    """Status files of a job folder. Spark's scan leaves out empty files, so their names come
    from the file listing that Spark keeps anyway."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{success,failed,skip}").load(path)
    # the listing writes local names as file:///x, the scan as file:/x
    name = F.regexp_replace("path", "^file:/+", "file:/").alias("path")
    names = spark.createDataFrame([(n,) for n in scan.inputFiles()], "path string").select(name)
    texts = scan.select(name, F.decode("content", "utf-8").alias("text"))
    return parse_status(names.join(texts, "path", "left"))
