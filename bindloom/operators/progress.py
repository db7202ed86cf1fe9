"""Status of staged jobs: progress matrix, failures, survival, coverage and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.plans import skew as S

# fixed values: stages in order, and keyword rules of error categories, first match wins
STAGES = ["1_save_ligands", "2_prep_target", "3_generate_config", "4_vina_prep", "5_vina_dock", "6_vina_post"]
ERROR_RULES = [
    (["file not found", "does not exist"], "any", "File Not Found"),
    (["timeout"], "any", "Timeout"),
    (["vina", "failed"], "all", "Vina Execution Failed"),
    (["empty", "no poses"], "any", "No Poses Generated"),
    (["pdbqt"], "any", "PDBQT Conversion Error"),
    (["parsing", "parse"], "any", "Parsing Error"),
    (["permission"], "any", "Permission Error"),
    (["memory"], "any", "Memory Error"),
]


def error_category(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for words, mode, name in ERROR_RULES:
        hits = [low.contains(w) for w in words]
        test = hits[0]
        for h in hits[1:]:
            test = (test | h) if mode == "any" else (test & h)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when(text.isNotNull(), "Other Error")


def latest_status(events: DataFrame, order: list[str]) -> DataFrame:
    """Last status per (complex, stage)."""
    return events.groupBy("complex_id", "stage").agg(
        F.max_by(F.struct("status", "error"), F.struct(*order)).alias("_s")
    ).select("complex_id", "stage", "_s.status", "_s.error")


def progress_matrix(latest: DataFrame, stages: list[str]) -> DataFrame:
    """One row per complex with a status and an error column per stage; missing is pending."""
    wide = latest.groupBy("complex_id").pivot("stage", stages).agg(
        F.max("status").alias("status"), F.max(F.when(F.col("status") == "failed", F.col("error"))).alias("error")
    )
    cols = [F.coalesce(F.col(f"`{s}_status`"), F.lit("pending")).alias(s) for s in stages]
    errors = [F.col(f"`{s}_error`").alias(f"{s}_error") for s in stages]
    done = cols[0] == "success"
    for c in cols[1:]:
        done = done & (c == "success")
    return wide.select("complex_id", *cols, *errors, done.alias("all_success"))


def success_rate(matrix: DataFrame) -> DataFrame:
    return matrix.agg(
        F.count(F.lit(1)).alias("n_complexes"),
        F.count_if("all_success").alias("n_success"),
        F.avg(F.col("all_success").cast("double")).alias("success_rate"),
    )


def failures(latest: DataFrame, examples: int = 3) -> DataFrame:
    """Failures per stage and category with share of the stage and a few example complexes."""
    bad = latest.filter("status = 'failed'").withColumn("category", error_category(F.col("error")))
    counts = bad.groupBy("stage", "category").agg(F.count(F.lit(1)).alias("n"))
    counts = S.with_group(counts, ["stage"], F.sum("n").alias("_t")).withColumn("share", F.col("n") / F.col("_t")).drop("_t")
    few = S.top_k(bad, ["stage", "category"], [F.col("complex_id")], examples)
    cell = F.array_sort(F.collect_list(F.struct("rn", F.col("complex_id").cast("string").alias("id"))))
    few = few.groupBy("stage", "category").agg(F.array_join(F.transform(cell, lambda s: s["id"]), ",").alias("examples"))
    return counts.join(few, ["stage", "category"])


def stage_survival(counts: DataFrame, position: str, n: str) -> DataFrame:
    """Rows per stage, lost and survival percentage against the stage before (one row per stage)."""
    before = F.lag(n).over(W.partitionBy(F.lit(0)).orderBy(position))
    x = counts.withColumn("_b", before)
    return x.withColumn("lost", F.col("_b") - F.col(n)).withColumn(
        "survival_percent", F.when(F.col("_b") > 0, F.col(n) / F.col("_b") * 100)
    ).drop("_b")


def retry_selection(stage_input: DataFrame, latest: DataFrame, stage: str) -> DataFrame:
    """Input rows of the complexes that failed at a stage."""
    failed = latest.filter((F.col("stage") == stage) & (F.col("status") == "failed")).select("complex_id")
    return stage_input.join(failed, "complex_id", "left_semi")


def final_report(configs: DataFrame, poses: DataFrame) -> DataFrame:
    """Totals of the final table: distinct ids, configs with poses, poses per config."""
    ids = configs.agg(
        F.count(F.lit(1)).cast("double").alias("total_complexes"),
        F.count_distinct("protein_key").cast("double").alias("unique_proteins"),
        F.count_distinct("target_complex_id").cast("double").alias("unique_targets"),
        F.count_distinct("offtarget_complex_id").cast("double").alias("unique_offtargets"),
    )
    per = poses.groupBy("config_id").agg(F.count(F.lit(1)).alias("n"))
    got = per.agg(
        F.count(F.lit(1)).cast("double").alias("configs_with_poses"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_poses"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_poses_per_config"),
    )
    wide = S.with_row(ids, got)
    return wide.unpivot([], wide.columns, "figure", "value")


def top_proteins(configs: DataFrame, k: int = 10) -> DataFrame:
    counts = configs.groupBy("protein_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("protein_key")).limit(k)


def coverage(expected: DataFrame, actual: DataFrame, protein: str) -> DataFrame:
    """Expected and actual structures per protein and label side by side, with proteins that lost a side."""

    def wide(df, name):
        n = lambda label: F.count_if(F.col("target_type") == label)
        return df.groupBy(protein).agg(n("target").alias(f"target_{name}"), n("off_target").alias(f"off_target_{name}"))

    x = wide(expected, "expected").join(wide(actual, "actual"), protein, "left")
    x = x.na.fill(0, ["target_actual", "off_target_actual"])
    gone = [(F.col(f"{s}_expected") > 0) & (F.col(f"{s}_actual") == 0) for s in ("target", "off_target")]
    missing = F.col("target_expected") + F.col("off_target_expected") - F.col("target_actual") - F.col("off_target_actual")
    return x.withColumn("missing", missing).withColumn("lost_side", gone[0] | gone[1])


def coverage_rate(cov: DataFrame) -> DataFrame:
    total = F.sum(F.col("target_expected") + F.col("off_target_expected"))
    return cov.agg(
        total.alias("expected"),
        F.sum("missing").alias("missing"),
        (100 * (1 - F.sum("missing") / total)).alias("success_rate"),
        F.count_if("lost_side").alias("n_lost_side"),
    )


def off_summary(df: DataFrame, protein: str, ligand: str, structure: str) -> DataFrame:
    """One row per protein and validated target with the off-target ids and both counts."""
    targets = df.filter((F.col("target_type") == "target") & F.col(structure).isNotNull()).select(protein, ligand, structure).distinct()
    targets = targets.withColumnsRenamed({ligand: "target_id", structure: "target_structure"})
    off = df.filter("target_type = 'off_target'").select(protein, ligand).filter(F.col(ligand).isNotNull()).distinct()
    n_off = off.groupBy(protein).agg(F.count(F.lit(1)).alias("n_off_targets"))
    n_tar = targets.select(protein, "target_id").distinct().groupBy(protein).agg(F.count(F.lit(1)).alias("n_targets"))
    ids = S.joined_cells(off, [protein], {"off_target_ids": ligand})
    return targets.join(n_off, protein).join(n_tar, protein).join(ids, protein)


def off_thresholds(summary: DataFrame, protein: str, levels: list[int]) -> DataFrame:
    """Number of proteins with at least k targets and k off-targets, for each k."""
    one = summary.select(protein, "n_targets", "n_off_targets").distinct()
    both = F.least("n_targets", "n_off_targets")
    x = one.withColumn("threshold", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("_ok", both >= F.col("threshold"))
    return x.groupBy("threshold").agg(F.count_if("_ok").alias("n_proteins"))


def per_complex(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def seed_success(df: DataFrame, seed: str, ok: Column) -> DataFrame:
    return df.groupBy(seed).agg(F.count(F.lit(1)).alias("n"), F.avg(ok.cast("double")).alias("success_rate"))


def fallback_source(candidates: DataFrame, row: str, max_atoms: int) -> DataFrame:
    """Chosen source per row: first usable candidate by priority; oversized ones are rejected."""
    small = F.col("n_atoms") <= max_atoms
    usable = F.col("error").isNull() & small
    return candidates.groupBy(row).agg(
        F.min_by("source", F.when(usable, F.col("priority"))).alias("source"),
        F.min_by("path", F.when(usable, F.col("priority"))).alias("path"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.coalesce(F.bool_or(F.col("error").isNull() & ~small), F.lit(False)).alias("size_rejected"),
    )


def source_errors(candidates: DataFrame, row: str, examples: int = 10) -> DataFrame:
    """Error counts per source and category with a few example rows."""
    bad = candidates.filter(F.col("error").isNotNull())
    counts = bad.groupBy("source", "error").agg(F.count(F.lit(1)).alias("n"))
    few = S.top_k(bad, ["source", "error"], [F.col(row)], examples)
    cell = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(row).cast("string").alias("id")))), lambda s: s["id"])
    return counts.join(few.groupBy("source", "error").agg(F.array_join(cell, ",").alias("examples")), ["source", "error"])
