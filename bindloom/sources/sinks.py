"""Writers of curated tables, reference sequences, manifests and copy plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_dataset(df: DataFrame, path: str, partitions: list[str] = (), csv: bool = False) -> None:
    """Parquet table partitioned by low-cardinality columns, optionally a CSV copy."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    if csv:
        df.write.mode("overwrite").csv(f"{path}_csv", header=True)


def fasta_text(df: DataFrame, header: str, sequence: str, width: int = 80, max_header: int = 100) -> DataFrame:
    """One FASTA record per row: blanks of the header become underscores, sequences are wrapped."""
    name = F.substring(F.replace(F.col(header), F.lit(" "), F.lit("_")), 1, max_header)
    wrapped = F.rtrim(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"))
    return df.filter(F.length(sequence) > 0).select(F.concat(F.lit(">"), name, F.lit("\n"), wrapped).alias("value"))


def write_fasta(df: DataFrame, header: str, sequence: str, path: str) -> None:
    fasta_text(df, header, sequence).write.mode("overwrite").text(path)


def structure_text(atoms: DataFrame) -> DataFrame:
    """Fixed-column structure text: one ``value`` line per atom beside the atom's columns.

    Numbers keep three decimals (coordinates) or two; names of one to three letters begin in the second column of
    their field. Atoms whose number, residue number or coordinates do not fit their fields get a null line.
    """
    right = lambda x, w: F.when(F.length(x) <= w, F.lpad(x, w, " "))
    fixed = lambda name, w, d: right(F.format_string(f"%.{d}f", F.col(name).cast("double")), w)
    text = lambda name: F.coalesce(F.trim(name), F.lit(""))
    name = F.when(F.length(text("atom")) < 4, F.concat(F.lit(" "), text("atom"))).otherwise(text("atom"))
    blank = lambda n: F.lit(" " * n)
    line = F.concat(
        F.rpad("record", 6, " "), right(F.col("serial").cast("string"), 5), blank(1), F.rpad(name, 4, " "), F.rpad(text("altloc"), 1, " "),
        right(text("resname"), 3), blank(1), F.rpad(text("chain"), 1, " "), right(F.col("resseq").cast("string"), 4), F.rpad(text("icode"), 1, " "), blank(3),
        *[fixed(a, 8, 3) for a in "xyz"], fixed("occupancy", 6, 2), F.coalesce(fixed("bfactor", 6, 2), blank(6)), blank(10), right(text("element"), 2),
    )
    return atoms.withColumn("value", line)


def write_structures(atoms: DataFrame, structure: str, order: str, path: str) -> None:
    """One folder of text per structure, its atoms in order, each file ended by END."""
    lines = structure_text(atoms).filter(F.col("value").isNotNull()).select(structure, F.col(order).alias("_o"), "value")
    ends = atoms.groupBy(structure).agg((F.max(order) + 1).alias("_o")).withColumn("value", F.lit("END"))
    x = lines.unionByName(ends).repartition(structure).sortWithinPartitions(structure, "_o")
    x.select(structure, "value").write.partitionBy(structure).text(path)


def manifest(df: DataFrame, entry: str, model: str, ranges: list[tuple[int, int]], pattern: str) -> DataFrame:
    """Distinct file paths per id range; ranges are a short list of the job."""
    known = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in ranges])
    hit = F.explode(F.filter(known, lambda r: (F.col(entry) >= r["a"]) & (F.col(entry) <= r["b"])))
    x = df.select(entry, model, hit.alias("_r"))
    return x.select(
        F.concat_ws("_to_", "_r.a", "_r.b").alias("id_range"), F.format_string(pattern, F.col(entry), F.col(model)).alias("path")
    ).distinct()


def write_manifest(df: DataFrame, path: str) -> None:
    df.repartition("id_range").sortWithinPartitions("id_range", "path").write.mode("overwrite").partitionBy("id_range").text(path)


def layout(df: DataFrame, listing: DataFrame, source: str = "structures") -> DataFrame:
    """Copy plan: source and destination of every row, with the reason where it is skipped."""
    folder = F.when(F.col("target_type") == "target", "tar").when(F.col("target_type") == "off_target", "off")
    x = df.withColumn("source_path", F.concat(F.lit(f"{source}/"), "pdb_id", F.lit(".pdb")))
    x = x.withColumn("target_path", F.concat_ws("/", "uniprot_id", folder, "het_id", F.concat("pdb_id", F.lit(".pdb"))))
    x = x.join(listing.select(F.col("path").alias("source_path")).distinct().withColumn("_found", F.lit(True)), "source_path", "left")
    missing = F.col("uniprot_id").isNull() | F.col("target_type").isNull() | F.col("het_id").isNull() | F.col("pdb_id").isNull()
    reason = F.when(missing, "missing data").when(folder.isNull(), "unknown label").when(F.col("_found").isNull(), "source not found")
    x = x.withColumn("reason", reason).drop("_found")
    return x.withColumn("target_path", F.when(F.col("reason").isNull(), F.col("target_path")))


def pose_layout(df: DataFrame, row: str, blurred: str, poses: str) -> DataFrame:
    """Copy plan of final files: blurred targets, and poses below the run folder of their complex."""
    t = df.filter(F.trim(blurred) != "").select(row, F.trim(blurred).alias("source_path"))
    t = t.withColumn("target_path", F.concat(F.lit("target_blurred/"), F.substring_index("source_path", "/", -1)))
    p = df.select(row, F.explode(F.split(poses, ";")).alias("source_path")).withColumn("source_path", F.trim("source_path")).filter("source_path <> ''")
    run = F.regexp_extract("source_path", r"/runs/([^/]+)/", 1)
    name = F.substring_index("source_path", "/", -1)
    p = p.withColumn("target_path", F.when(run != "", F.concat(F.lit("offtarget_poses/"), run, F.lit("/"), name)))
    both = t.unionByName(p)
    return both.withColumn("reason", F.when(F.col("target_path").isNull(), "no run folder in path"))
