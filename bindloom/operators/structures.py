"""Joins of curated pairs with structure metadata, files, stages and other sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.functions import text as X
from bindloom.plans import skew as S


def activity_star(t: dict[str, DataFrame], standard_type: str, min_confidence: int) -> DataFrame:
    """Star join of activities with assays, targets, components, sequences, molecules, documents."""
    act = t["activities"].filter(
        (F.col("standard_type") == standard_type) & F.col("standard_value").isNotNull() & (F.col("standard_units") == "nM")
    )
    seq = t["component_sequences"].filter((F.length("sequence") > 0) & (F.col("component_type") == "PROTEIN"))
    return (
        act.join(t["assays"].filter(F.col("confidence_score") >= min_confidence), "assay_id")
        .join(t["target_dictionary"].filter(F.col("target_type") == "SINGLE PROTEIN"), "tid")
        .join(t["target_components"].filter(F.col("homologue") == 0), "tid")
        .join(seq, "component_id")
        .join(t["molecule_dictionary"], "molregno")
        .join(t["compound_structures"].filter(F.col("standard_inchi_key").isNotNull()), "molregno")
        .join(t["docs"], "doc_id", "left")
        .distinct()
    )


def config_plan(df: DataFrame, keys: list[str], blurred: str, het: str, ligand_path: str) -> DataFrame:
    """Docking configurations per protein: targets × off-targets with success and failure counts.

    Counted from the two sides without writing out the product; the explicit rows of a
    target come from :func:`offtarget_lookup`, which is linear in the listed ids.
    """
    target, off = F.col("target_type") == "target", F.col("target_type") == "off_target"
    usable = F.col(blurred).isNotNull() & F.col(het).isNotNull()
    sides = df.groupBy(*keys).agg(
        F.count_if(target).alias("n_targets"),
        F.count_if(off).alias("n_offtargets"),
        F.count_if(target & usable).alias("_t"),
        F.count_if(off & F.col(ligand_path).isNotNull()).alias("_o"),
    )
    both = sides.filter("n_targets > 0 and n_offtargets > 0")
    return both.select(
        *keys,
        "n_targets",
        "n_offtargets",
        (F.col("n_targets") * F.col("n_offtargets")).alias("n_configs"),
        (F.col("_t") * F.col("_o")).alias("n_success"),
        (F.col("n_targets") * F.col("n_offtargets") - F.col("_t") * F.col("_o")).alias("n_failed"),
    )


def offtarget_lookup(
    targets: DataFrame, offs: DataFrame, key: str, target_id: str, ids: str, het: str, path: str, order: str
) -> DataFrame:
    """Listed off-target codes of each target row resolved to a ligand path of the same protein.

    The first path of a code wins, the order of the list is kept, repeats are dropped.
    Targets without any match come back with a reason.
    """
    lookup = offs.filter(F.col(path).isNotNull()).groupBy(key, het).agg(F.min_by(path, order).alias("off_path"))
    tokens = F.array_distinct(F.filter(F.transform(F.split(F.col(ids), ";"), lambda x: F.trim(x)), lambda x: x != ""))
    listed = targets.select(key, target_id, F.posexplode_outer(tokens).alias("pos", het))
    found = listed.join(lookup, [key, het], "left")
    hits = found.groupBy(key, target_id).agg(F.count("off_path").alias("n_found"))
    found = found.join(hits, [key, target_id]).filter(F.col("off_path").isNotNull() | (F.col("n_found") == 0))
    reason = F.when(F.col("n_found") == 0, "no matching off-target")
    none = found.filter("n_found = 0").select(key, target_id).distinct()
    rows = found.filter("n_found > 0").select(key, target_id, F.col("pos").cast("long").alias("pos"), het, "off_path")
    return rows.withColumn("reason", F.lit(None).cast("string")).unionByName(
        none.withColumn("reason", F.lit("no matching off-target")), allowMissingColumns=True
    )


def compare_sources(a: DataFrame, b: DataFrame, protein: str) -> DataFrame:
    """Every protein with its row count in both sources and where it occurs."""
    left = a.groupBy(protein).agg(F.count(F.lit(1)).alias("n_a"))
    right = b.groupBy(protein).agg(F.count(F.lit(1)).alias("n_b"))
    where = F.when(F.col("n_a").isNull(), "only_b").when(F.col("n_b").isNull(), "only_a").otherwise("common")
    return left.join(right, protein, "full").select(
        protein, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), where.alias("found_in")
    )


def common_pairs(a: DataFrame, b: DataFrame, protein: str, ligand: str, structure: str) -> DataFrame:
    """(protein, ligand) pairs of both sources: matches, structure flag and joined structure ids.

    Rows are aggregated on each side first, so many rows of one pair never multiply.
    """
    keys = [protein, ligand]
    left = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
    right = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    ids = S.joined_cells(a.filter(F.col(structure).isNotNull()), keys, {"structure_ids": structure})
    both = left.join(right, keys).withColumn("n_matches", F.col("n_a") * F.col("n_b"))
    return both.join(ids, keys, "left").withColumn("has_structure", F.col("structure_ids").isNotNull()).withColumn(
        "part", F.coalesce("part", F.lit(0))
    )


def resolve_paths(df: DataFrame, candidates: list[Column], listing: DataFrame, row: str) -> DataFrame:
    """First candidate path that the file listing holds; all candidates are tried in order."""
    tried = df.select("*", F.posexplode(F.array(*candidates)).alias("_prio", "path"))
    found = tried.join(listing.select("path").distinct(), "path")
    best = found.groupBy(row).agg(F.min_by("path", "_prio").alias("path"))
    return df.join(best, row, "left").withColumn("found", F.col("path").isNotNull())


def structure_funnel(
    pairs: DataFrame, meta: DataFrame, ligands: DataFrame, row: str, ids: str, uniprot: str, het: str
) -> DataFrame:
    """Validate structure ids step by step: protein, ligand, wild type, best resolution.

    ``meta`` has one row per structure (pdb_id, uniprot_ids, mutations, resolution),
    ``ligands`` one row per (pdb_id, het_id). The status names the first failing step.
    """
    listed = pairs.select(row, uniprot, F.upper(F.trim(het)).alias("_het"), F.posexplode_outer(X.split_ids(F.col(ids))).alias("_ord", "pdb_id"))
    # the codes of a structure travel with it, so the long list of ids is joined once
    codes = ligands.groupBy("pdb_id").agg(F.collect_set(F.upper("het_id")).alias("_codes"))
    known = meta.select("pdb_id", "uniprot_ids", "mutations", "resolution").join(codes, "pdb_id", "left")
    x = listed.join(known, "pdb_id", "left")
    s1 = F.coalesce(F.array_contains("uniprot_ids", F.col(uniprot)), F.lit(False))
    s2 = s1 & F.coalesce(F.array_contains("_codes", F.col("_het")), F.lit(False))
    s3 = s2 & (F.coalesce(F.size("mutations"), F.lit(0)) <= 0)
    steps = F.when(s3, 3).when(s2, 2).when(s1, 1).otherwise(0)
    resolution = F.coalesce(F.nullif("resolution", F.lit(0.0)), F.lit(999.9))
    # rows of a few numbers are dealt by row, and only then sorted
    x = x.select(row, "pdb_id", "_ord", steps.alias("_steps"), resolution.alias("_res")).repartition(F.col(row))
    passed = lambda n: F.count_if(F.col("_steps") >= n)
    out = x.groupBy(row).agg(
        F.count("pdb_id").alias("n_ids"),
        passed(1).alias("n_protein"),
        passed(2).alias("n_ligand"),
        passed(3).alias("n_wild_type"),
        F.min_by("pdb_id", F.when(F.col("_steps") == 3, F.struct("_res", "_ord"))).alias("valid_pdb_id"),
    )
    status = (
        F.when(F.col("n_ids") == 0, "no ids")
        .when(F.col("n_protein") == 0, "no protein match")
        .when(F.col("n_ligand") == 0, "no ligand match")
        .when(F.col("n_wild_type") == 0, "no wild-type structure")
        .otherwise("valid")
    )
    return out.withColumn("status", status)


def structure_ligands(meta: DataFrame, fields: list[str], solvents: DataFrame) -> DataFrame:
    """Ligand codes of each structure from several array fields, without solvents and unknowns."""
    arrays = [F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields]
    codes = meta.select("pdb_id", F.explode(reduce(F.array_union, arrays)).alias("het_id"))
    return codes.filter(~F.col("het_id").isin("", "UNK")).join(solvents, "het_id", "left_anti").distinct()


def structure_flags(pairs: DataFrame, ligands: DataFrame, meta: DataFrame, row: str, ids: str, inchikey: str) -> DataFrame:
    """Per pair: has a ligand, the ligand matches, the structure is a mutant (title words), with id lists.

    ``ligands`` has (pdb_id, inchikey); it is reduced to one flag per (row, id) before ids are listed.
    """
    listed = pairs.select(row, inchikey, F.explode(F.array_distinct(X.split_ids(F.col(ids)))).alias("pdb_id"))
    lig = ligands.select("pdb_id", F.col("inchikey").alias("_k")).distinct()
    seen = lig.select("pdb_id").distinct().withColumn("_any", F.lit(True))
    same = lig.withColumnRenamed("_k", inchikey).withColumn("_same", F.lit(True))
    x = listed.join(seen, "pdb_id", "left").join(same, ["pdb_id", inchikey], "left")
    mutant = meta.select("pdb_id", F.lower("title").rlike("mutant|mutation|variant").alias("_mut"))
    x = x.join(mutant, "pdb_id", "left")
    flags = x.groupBy(row).agg(
        F.coalesce(F.bool_or("_any"), F.lit(False)).alias("has_ligand"),
        F.coalesce(F.bool_or("_same"), F.lit(False)).alias("ligand_matches"),
        F.coalesce(F.bool_or("_mut"), F.lit(False)).alias("is_mutant"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_any"), F.col("pdb_id")))), ";").alias("ligand_ids"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_same"), F.col("pdb_id")))), ";").alias("match_ids"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("_mut"), F.col("pdb_id")))), ";").alias("mutant_ids"),
    )
    return flags


def affinity_pairs(pairs: DataFrame, px: DataFrame, protein: str, ligand: str, value: str) -> DataFrame:
    """pX of both ligands of a pair within the protein and their absolute difference; duplicates are averaged."""
    mean = px.groupBy(protein, ligand).agg(F.avg(value).alias("_v"))
    a = mean.select(protein, F.col(ligand).alias(f"{ligand}_1"), F.col("_v").alias("px_1"))
    b = mean.select(protein, F.col(ligand).alias(f"{ligand}_2"), F.col("_v").alias("px_2"))
    out = pairs.join(a, [protein, f"{ligand}_1"]).join(b, [protein, f"{ligand}_2"])
    return out.withColumn("delta_px", F.abs(F.col("px_1") - F.col("px_2"))).filter(F.col("delta_px").isNotNull())


def merge_similarity(df: DataFrame, sims: DataFrame, protein: str, ligand: str, row_id: str) -> DataFrame:
    """Similarity rows on off-targets; targets take the protein's first listed target ligand.

    The first target ligand is found from the first row and the least target ligand of every (protein, ligand),
    before the similarity rows multiply the rows; the multiplied rows are not shuffled again.
    """
    keys = [protein, ligand]
    sims = sims.withColumnRenamed("off_ligand", ligand)
    least = sims.filter(F.col("target_ligand").isNotNull()).groupBy(*keys).agg(F.min("target_ligand").alias("target_ligand"))
    at = F.when(F.count_if(F.col(row_id).isNull()) == 0, F.min(row_id))  # a row without a number comes first
    rows = df.filter(F.col("target_type") == "off_target").groupBy(*keys).agg(at.alias("_at"))
    first = rows.join(least, keys).groupBy(protein).agg(F.min_by("target_ligand", F.struct("_at", "target_ligand")).alias("_first"))
    filled = F.when(F.col("target_type") == "target", F.coalesce("target_ligand", "_first")).otherwise(F.col("target_ligand"))
    return (
        df.join(first, protein, "left")
        .join(sims, keys, "left")
        .withColumn("target_ligand", filled)
        .withColumn("bucket", F.coalesce("bucket", F.lit("target")))
        .drop("_first")
    )


def merge_after_stages(original: DataFrame, stage2: DataFrame, last: DataFrame) -> DataFrame:
    """Sampled rows that survived the docking stages, with the columns of the last stage on off-targets."""

    def short(df):
        return df.withColumn("_pk", F.split("protein_key", "_")[0])

    orig, s2, s6 = short(original), short(stage2), short(last)
    off_ids = (
        s2.filter("target_type = 'off_target'")
        .groupBy("_pk", "ligand_inchikey")
        .agg(F.max_by("complex_id", "row_id").alias("offtarget_complex_id"))
    )
    off = orig.filter("target_type = 'off_target'").join(off_ids, ["_pk", "ligand_inchikey"])
    off = off.join(s6.drop("protein_key"), ["_pk", "offtarget_complex_id"])
    by_id = s2.filter("target_type = 'target'").groupBy("complex_id").agg(F.max_by("ligand_inchikey", "row_id").alias("ligand_inchikey"))
    alive = by_id.join(s6.select(F.col("target_complex_id").alias("complex_id")).distinct(), "complex_id")
    keep = alive.groupBy("ligand_inchikey").agg(F.max("complex_id").alias("target_complex_id"))
    tar = orig.filter("target_type = 'target'").join(keep, "ligand_inchikey")
    return tar.drop("_pk").unionByName(off.drop("_pk", "offtarget_complex_id"), allowMissingColumns=True)
