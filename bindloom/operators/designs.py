"""Designed sequences against a reference: recovery, identity, position profiles, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.functions import sequences as Q


def recovery(designs: DataFrame, native: str, design: str, mask: str) -> DataFrame:
    """Share of masked positions equal to the native sequence; ``mask`` is an array of 0/1."""
    cells = F.arrays_zip(Q.chars(F.col(native)).alias("a"), Q.chars(F.col(design)).alias("b"), F.col(mask).alias("m"))
    total = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.coalesce(c["m"].cast("double"), F.lit(0.0)))
    same = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.when(c["a"] == c["b"], c["m"].cast("double")).otherwise(0.0))
    return designs.withColumn("seq_rec", F.when(total > 0, same / total))


def positions(df: DataFrame, sequence: str) -> DataFrame:
    """One row per position (0-based) and character."""
    rest = [c for c in df.columns if c != sequence]
    return df.select(*rest, F.posexplode(Q.chars(F.col(sequence))).alias("pos", "aa"))


def regional_identity(designs: DataFrame, reference: str, design: str, pocket: str) -> DataFrame:
    """Identity overall, in the pocket and outside it; ``pocket`` is an array of 0/1 per position.
    A region without positions scores 0. The positions are compared once, to one letter each, which all three count."""
    a, b = F.col(reference), F.col(design)
    n = F.least(F.length(a), F.length(b))
    cells = F.arrays_zip(Q.chars(a).alias("a"), Q.chars(b).alias("b"), F.coalesce(pocket, F.array().cast("array<int>")).alias("m"))

    def mark(cell):  # upper case where both are equal
        region = F.when(cell["m"] == 1, "p").when(cell["m"] == 0, "r").otherwise("n")
        return F.when(cell["a"] == cell["b"], F.upper(region)).otherwise(region)

    marks = F.when(n > 0, F.array_join(F.transform(F.slice(cells, 1, F.greatest(n, F.lit(1))), mark), ""))

    def share(others):
        total = F.length(F.translate("_marks", others, ""))
        return F.coalesce(F.when(total > 0, F.length(F.translate("_marks", others + "prn", "")) / total), F.lit(0.0))

    shares = {"identity": share(""), "pocket_identity": share("RrNn"), "rest_identity": share("PpNn")}
    return designs.withColumn("_marks", marks).withColumns(shares).drop("_marks")


def position_profile(designs: DataFrame, reference: DataFrame, label: str, sequence: str) -> DataFrame:
    """Per position of the reference: share of designs that match it and variability (1 − modal share)."""
    counts = positions(designs.select(label, sequence), sequence).groupBy(label, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    ref = positions(reference.select(label, sequence), sequence).withColumnRenamed("aa", "ref_aa")
    x = ref.join(counts, [label, "pos"], "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    match = F.coalesce(F.sum(F.when(F.col("aa") == F.col("ref_aa"), F.col("n"))), F.lit(0))
    return x.groupBy(label, "pos").agg(
        F.when(total > 0, match / total).otherwise(0.0).alias("similarity"),
        F.when(total > 0, 1 - F.max("n") / total).otherwise(0.0).alias("variability"),
    )


def baseline_delta(profile: DataFrame, label: str, baseline: str) -> DataFrame:
    """Variability per position minus that of the baseline set."""
    base = profile.filter(F.col(label) == baseline).select("pos", F.col("variability").alias("_b"))
    x = profile.filter(F.col(label) != baseline).join(base, "pos")
    return x.withColumn("delta", F.col("variability") - F.col("_b")).drop("_b")


def region_summary(identities: DataFrame, profile: DataFrame, pocket: DataFrame, label: str) -> DataFrame:
    """Mean identities and mean variability by region for each design set."""
    a = identities.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("identity", "pocket_identity", "rest_identity")]
    )
    inside = pocket.select("pos").distinct().withColumn("_in", F.lit(True))
    v = profile.join(inside, "pos", "left")
    b = v.groupBy(label).agg(
        F.avg("variability").alias("variability"),
        F.avg(F.when(F.col("_in"), F.col("variability"))).alias("pocket_variability"),
        F.avg(F.when(F.col("_in").isNull(), F.col("variability"))).alias("rest_variability"),
    )
    return a.join(b, label)


def pocket_union(lists: DataFrame, residues: str, length: Column) -> DataFrame:
    """Distinct 0-based positions of residue lists such as ``A55,A56,B385`` within the sequence length."""
    token = lists.select(F.explode(F.split(residues, ",")).alias("_t"), length.alias("_len"))
    number = F.substring(F.trim("_t"), 2, 12).try_cast("int") - 1
    return token.select(number.alias("pos"), "_len").filter((F.col("pos") >= 0) & (F.col("pos") < F.col("_len"))).select("pos").distinct()


def batch_manifest(results: DataFrame, structures: DataFrame, sequences: DataFrame, keys: list[str], atom_limit: int) -> DataFrame:
    """Results joined to their designed sequences, with the size flag and the reason of every failed row."""
    s = structures.groupBy(*keys).agg(F.min_by("path", "priority").alias("structure_path"))
    x = results.join(s, keys, "left").join(sequences, keys, "left")
    error = (
        F.when(F.coalesce("n_atoms", F.lit(0)) == 0, "invalid_smiles")
        .when(F.col("structure_path").isNull(), "structure_not_found")
        .when(F.col("sequence").isNull(), "sequences_not_found")
    )
    return x.withColumn("error", error).withColumn("exceeds_limit", F.col("n_atoms") > atom_limit)
