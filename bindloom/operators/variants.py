"""Reference sequences, variants and wild-type/mutant pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.functions import sequences as Q
from bindloom.plans import skew as S


def reference_sequence(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The sequence with most records per key, ties by md5."""
    counts = df.groupBy(*keys, sequence).agg(F.count(F.lit(1)).alias("n_records"))
    return S.first_per(counts, keys, [F.desc("n_records"), F.md5(sequence).asc()])


def reference_by_length(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Modal length first (ties: shorter), then the modal sequence of that length (ties: alphabetical)."""
    counts = df.filter(F.col(sequence).isNotNull()).groupBy(*keys, sequence).agg(F.count(F.lit(1)).alias("n_records"))
    counts = counts.withColumn("_len", F.length(sequence))
    lengths = counts.groupBy(*keys, "_len").agg(F.sum("n_records").alias("_n"))
    modal = lengths.groupBy(*keys).agg(F.max_by("_len", F.struct("_n", -F.col("_len"))).alias("_len"))
    return S.first_per(counts.join(modal, [*keys, "_len"]).drop("_len"), keys, [F.desc("n_records"), F.asc(sequence)])


def mark_substitutions(df: DataFrame, reference: str, variant: str, limit: int = 100) -> DataFrame:
    """Substitution list, count, indel flag and whether the count lies within the limit."""
    return (
        df.withColumn("mutations", Q.substitutions(F.col(reference), F.col(variant)))
        .withColumn("has_indel", F.col("mutations").isNull())
        .withColumn("n_subs", F.when(~F.col("has_indel"), F.size("mutations").cast("long")))
        .withColumn("within_limit", F.coalesce(F.col("n_subs") <= limit, F.lit(False)))
    )


def pair_with_wild_type(
    df: DataFrame, group: list[str], sequence: str, ligand: str, assay: str, nm: str, limit: int = 100
) -> DataFrame:
    """Each mutant next to the wild-type value of the same group, ligand and assay.

    ``df`` holds one row per (group, sequence, ligand, assay); the wild type is the most
    frequent sequence of the group, so every mutant row meets at most one partner.
    """
    wild = reference_sequence(df, group, sequence).select(*group, F.col(sequence).alias("wildtype_seq"))
    x = df.join(wild, group)
    base = x.filter(F.col(sequence) == F.col("wildtype_seq")).select(*group, ligand, assay, F.col(nm).alias("wt_nM"))
    # the substitutions are worked out once per distinct pair of sequences
    pairs = x.filter(F.col(sequence) != F.col("wildtype_seq")).select(sequence, "wildtype_seq").distinct()
    marked = mark_substitutions(pairs, "wildtype_seq", sequence, limit).filter("within_limit and n_subs > 0")
    variants = x.join(marked.select(sequence, "wildtype_seq", "mutations", "n_subs"), [sequence, "wildtype_seq"])
    return variants.join(base, [*group, ligand, assay]).withColumn("delta_pX", F.log10(F.col("wt_nM") / F.col(nm)))


def best_affinity_long(df: DataFrame, columns: dict[str, str], id_columns: list[str]) -> DataFrame:
    """Wide affinity columns to (assay_type, affinity_nM) rows."""
    wide = df.select(*id_columns, *[F.col(c).alias(kind) for kind, c in columns.items()])
    return wide.unpivot(id_columns, list(columns), "assay_type", "affinity_nM").filter(F.col("affinity_nM").isNotNull())
