"""Curation of affinity measurements: parsing, pair aggregates, validation, labels, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.functions import affinity as A, text as X
from bindloom.plans import skew as S
from bindloom.session import written


def resolve_columns(df: DataFrame, candidates: dict[str, list[str]], keep_rest: bool = False) -> DataFrame:
    """Rename by candidate lists (case-insensitive), add missing columns as null, prune the rest."""
    present = {c.strip().lower(): c for c in df.columns}
    found, used = [], set()
    for name, options in candidates.items():
        source = next((present[o.lower()] for o in [name, *options] if o.lower() in present), None)
        used.add(source)
        found.append((df[source] if source else F.lit(None).cast("string")).alias(name))
    rest = [df[c] for c in df.columns if c not in used] if keep_rest else []
    return df.select(*found, *rest)


def parse_measurements(df: DataFrame, cell: str, out: str = "nM") -> DataFrame:
    """One row per positive number in the cell; rows without any are dropped."""
    return df.withColumn(out, F.explode(X.numbers_in(F.col(cell)))).drop(cell)


def aggregate_pairs(
    df: DataFrame,
    keys: list[str],
    value: str,
    row_id: str,
    first: list[str] = (),
    joined: dict[str, str] | None = None,
) -> DataFrame:
    """Pair aggregate: pooled measurement statistics, first filled texts, joined distinct ids.

    Measurements are counted per (pair, value) once; statistics and the exact median both
    read those counts. Rows with a null key are dropped.
    """
    df = df.dropna(subset=keys)
    firsts = [F.min(F.when(F.trim(c) != "", F.struct(F.col(row_id).alias("at"), F.col(c).alias("v")))).alias(c) for c in first]
    hist = df.groupBy(*keys, value).agg(F.count(value).alias("_n"), *firsts).withColumn("_px", A.nm_to_px(F.col(value)))
    # the filter that the quantile needs, on all readers of the counts, so that they share one shuffle
    hist = hist.select(*keys, value, "_n", "_px", *first).filter(F.col("_px").isNotNull())
    # spread around a fixed centre of the pX scale, which keeps the sums well conditioned
    d = F.col("_px") - (A.TARGET_PX + A.OFF_TARGET_PX) / 2
    n, s1, s2 = F.sum("_n"), F.sum(F.col("_n") * d), F.sum(F.col("_n") * d * d)
    stats = hist.groupBy(*keys).agg(
        n.alias("n_measurements"),
        F.min(value).alias("min_nM"),
        F.max(value).alias("max_nM"),
        F.min("_px").alias("min_px"),
        F.max("_px").alias("max_px"),
        F.when(n > 1, F.sqrt(F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0)))).alias("std_px"),
        *[F.min(c)["v"].alias(c) for c in first],
    )
    out = stats.join(S.exact_quantiles(hist, keys, "_px", {"median_px": 0.5}, weight="_n"), keys, "left")
    if joined:
        out = out.join(S.joined_cells(df, keys, joined), keys, "left")
    return out


def validate_replicates(pairs: DataFrame) -> DataFrame:
    """Rule cascade over pair statistics: reason code, detail, representative value in nM."""
    single = F.col("min_nM") == F.col("max_nM")
    gray_nm = (F.col("min_nM") > A.TARGET_NM) & (F.col("min_nM") < A.OFF_TARGET_NM)
    gray_px = (F.col("median_px") > A.OFF_TARGET_PX) & (F.col("median_px") < A.TARGET_PX)
    crosses = (F.col("min_px") <= A.OFF_TARGET_PX) & (F.col("max_px") >= A.TARGET_PX)
    reason = (
        F.when(F.coalesce("n_measurements", F.lit(0)) == 0, "no_valid_values")
        .when(single & gray_nm, "median_in_gray_zone")
        .when(single, "single_value")
        .when(F.col("std_px") >= A.MAX_STD, "high_std")
        .when(crosses, "crosses_categories")
        .when(gray_px, "median_in_gray_zone")
        .otherwise("valid_std")
    )
    detail = (
        F.when(F.col("reason").isin("high_std", "valid_std"), F.format_string("%.3f", "std_px"))
        .when(F.col("reason") == "crosses_categories", F.format_string("%.2f-%.2f", "min_nM", "max_nM"))
        .when((F.col("reason") == "median_in_gray_zone") & ~single, F.format_string("%.2f", A.px_to_nm(F.col("median_px"))))
    )
    valid = F.col("reason").isin("single_value", "valid_std")
    return (
        pairs.withColumn("reason", reason)
        .withColumn("detail", detail)
        .withColumn("is_valid", valid)
        .withColumn(
            "representative_nM",
            F.when(F.col("reason") == "single_value", F.col("min_nM")).when(valid, A.px_to_nm(F.col("median_px"))),
        )
    )


def label_pairs(pairs: DataFrame, value: str = "representative_nM") -> DataFrame:
    """Target / off-target label; unlabelled rows are dropped."""
    labelled = pairs.withColumn("target_type", A.label_nm(F.col(value)))
    return labelled.filter(F.col("target_type").isNotNull())


# ---- filters with a condition on the group: one partial aggregate, one semi or anti join


def keep_groups(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Rows of the groups that satisfy an aggregate condition."""
    good = df.groupBy(*keys).agg(condition.alias("_ok")).filter("_ok").select(*keys)
    return df.join(good, keys, "left_semi")


def has_both(label: str, a: str = "target", b: str = "off_target") -> Column:
    return F.bool_or(F.col(label) == a) & F.bool_or(F.col(label) == b)


def keep_both_types(df: DataFrame, key: str, label: str = "target_type") -> DataFrame:
    return keep_groups(df, [key], has_both(label))


def keep_min_counts(df: DataFrame, key: str, n: int = 3, label: str = "target_type") -> DataFrame:
    enough = (F.count_if(F.col(label) == "target") >= n) & (F.count_if(F.col(label) == "off_target") >= n)
    return keep_groups(df, [key], enough)


def drop_conflicts(df: DataFrame, keys: list[str], label: str = "target_type") -> DataFrame:
    bad = df.groupBy(*keys).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).filter("_a <> _b").select(*keys)
    return df.join(bad, keys, "left_anti")


def keep_with_structure(df: DataFrame, key: str, structure: str, targets_only: bool = False, every_row: bool = False) -> DataFrame:
    filled = F.trim(F.coalesce(F.col(structure), F.lit(""))) != ""
    if every_row:
        return df.filter(filled)
    if targets_only:
        filled = filled & (F.col("target_type") == "target")
    return keep_groups(df, [key], F.bool_or(filled))


def keep_with_target(df: DataFrame, key: str, label: str = "target_type") -> DataFrame:
    return keep_groups(df, [key], F.bool_or(F.col(label) == "target"))


def keep_same_mutation(df: DataFrame, key: str, mutations: str, label: str = "target_type") -> DataFrame:
    """Rows whose set of mutations occurs among the targets of the same protein."""
    x = df.withColumn("_mut", F.array_join(F.array_sort(F.col(mutations)), ";"))
    wanted = x.filter(F.col(label) == "target").select(key, "_mut").distinct()
    return x.join(wanted, [key, "_mut"], "left_semi").drop("_mut")


def keep_ligand_overlap(df: DataFrame, key: str, ligand: str, is_reference: str, n: int = 2) -> DataFrame:
    """Ligands measured on both reference and mutant, for proteins with at least ``n`` of them."""
    both = F.bool_or(F.col(is_reference)) & F.bool_or(~F.col(is_reference))
    shared = df.groupBy(key, ligand).agg(both.alias("_b")).filter("_b").drop("_b")
    enough = shared.groupBy(key).count().filter(F.col("count") >= n).select(key)
    return df.join(shared.join(enough, key, "left_semi"), [key, ligand], "left_semi")


def keep_multi_variant(df: DataFrame, key: str, sequence: str) -> DataFrame:
    return keep_groups(df, [key], F.min(sequence) != F.max(sequence))


def keep_substitutions(df: DataFrame, key: str, ligand: str, structure: str, nm: str) -> DataFrame:
    """Substitution-only variants plus reference rows of their proteins; a variant must bring
    a ligand that the reference lacks, a structure and an affinity."""
    reference = df.filter("is_reference")
    pure = (F.col("n_ins") == 0) & (F.col("n_del") == 0) & (F.col("n_subs") > 0)
    usable = pure & X.blank_to_null(F.col(structure)).isNotNull() & F.col(nm).isNotNull()
    variants = df.filter(~F.col("is_reference") & usable)
    new = variants.join(reference.select(key, ligand), [key, ligand], "left_anti")
    return new.unionByName(reference.join(new.select(key), [key], "left_semi"))


def keep_shared_ligands(df: DataFrame, key: str, ligand: str, sequence: str, n_subs: str, limit: int = 30) -> DataFrame:
    """Protein–ligand groups measured on several sequences, one of them a mutant."""
    near = df.filter(F.col(n_subs) < limit)
    several = (F.min(sequence) != F.max(sequence)) & F.bool_or(F.col(n_subs) > 0)
    return keep_groups(near, [key, ligand], several)


def check_cardinality(df: DataFrame, entry: str, single: list[str], n_models: int = 5) -> DataFrame:
    """Audit row per entry: number of models and whether each named column has one value."""
    aggs = [F.count(F.lit(1)).alias("n_models")]
    aggs += [F.coalesce(F.min(c) == F.max(c), F.lit(False)).alias(f"one_{c}") for c in single]
    audit = df.groupBy(entry).agg(*aggs)
    ok = F.col("n_models") == n_models
    for c in single:
        ok = ok & F.col(f"one_{c}")
    return audit.withColumn("ok", ok)


def keep_consistent(df: DataFrame, entry: str, single: list[str], n_models: int = 5) -> DataFrame:
    return df.join(check_cardinality(df, entry, single, n_models).filter("ok").select(entry), [entry], "left_semi")


def keep_confident(df: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Minimum thresholds; a missing confidence counts as 0."""
    out = df
    for name, low in thresholds.items():
        out = out.filter(F.coalesce(F.col(name), F.lit(0.0)) >= low)
    return out


# ---- rankings and reports


def best_pair(df: DataFrame, key: str, ligand: str, value: str, structure: str | None = None) -> DataFrame:
    """Strongest target and weakest off-target of every protein, ties by ligand key."""
    if structure:
        df = df.filter(X.blank_to_null(F.col(structure)).isNotNull())
    strength = F.when(F.col("target_type") == "target", F.col(value)).otherwise(-F.col(value))
    return S.first_per(df, [key, "target_type"], [strength.asc(), F.col(ligand).asc()])


def curate(raw: DataFrame, protein: str, ligand: str, cell: str, row_id: str) -> DataFrame:
    """Measurements to labelled pairs: parse, aggregate, validate, label, drop conflicts, keep both types."""
    pairs = aggregate_pairs(parse_measurements(raw, cell), [protein, ligand], "nM", row_id)
    # the pair table is small against the measurements and read by every later filter
    labelled = written(label_pairs(validate_replicates(pairs).filter("is_valid")), "pairs")
    return keep_both_types(drop_conflicts(labelled, [protein, ligand]), protein)


def audit(steps: dict[str, DataFrame]) -> DataFrame:
    """Rows before, after and dropped for a chain of named steps, from one aggregate per step."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_after")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n_after")
        for i, (name, df) in enumerate(steps.items())
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    # as many rows as there are steps
    before = F.lag("n_after").over(W.partitionBy(F.lit(0)).orderBy("step"))
    return out.withColumn("n_before", before).withColumn("dropped", F.col("n_before") - F.col("n_after"))


def stats_per_protein(df: DataFrame, key: str, sequence: str, ligand: str, is_reference: str) -> DataFrame:
    """Distinct sequences and ligands per protein, over all rows, reference rows and mutant rows."""
    ref = F.col(is_reference)
    # one row per distinct fact keeps the aggregate free of several distinct counts on hot keys
    sequences = df.groupBy(key, sequence).agg(F.bool_or(~ref).alias("_mut"))
    ligands = df.groupBy(key, ligand).agg(F.bool_or(ref).alias("_r"), F.bool_or(~ref).alias("_m"))
    a = sequences.groupBy(key).agg(F.count(sequence).alias("n_seq"), F.count_if("_mut").alias("n_seq_mut"))
    b = ligands.groupBy(key).agg(
        F.count(ligand).alias("n_lig"), F.count_if("_r").alias("n_lig_ref"), F.count_if("_m").alias("n_lig_mut")
    )
    return a.join(b, key)


def mode_value(df: DataFrame, keys: list[str], value: str, row_id: str) -> DataFrame:
    """Most frequent value per key, ties by first row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.min(row_id).alias("_first")
    )
    return counts.groupBy(*keys).agg(
        F.max_by(value, F.struct("n", -F.col("_first"))).alias(value), F.max("n").alias("n")
    )


def first_seen_joined(df: DataFrame, keys: list[str], value: str, row_id: str, k: int, sep: str = "; ") -> DataFrame:
    """First-seen distinct values per key, at most ``k`` of them, joined in order."""
    seen = df.filter(F.trim(value) != "").groupBy(*keys, value).agg(F.min(row_id).alias("_first"))
    kept = S.top_k(seen, keys, [F.col("_first")], k)
    cell = F.array_sort(F.collect_list(F.struct("rn", value)))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(cell, lambda s: s[value]), sep).alias(value))


def best_model(df: DataFrame, entry: str, index: str, margin: float = 0.02) -> DataFrame:
    """One model per entry: valid, clash-free if possible, within a margin of the best
    confidence, then lowest docking score, with fallbacks where values are missing."""
    ok = F.coalesce(F.col("all_passed") & F.col("passes_valence_checks") & F.col("passes_kekulization"), F.lit(False))
    clean = ok & F.coalesce(F.col("number_clashes") == 0, F.lit(False))
    x = S.with_group(
        df.withColumn("_tier", F.when(clean, 2).when(ok, 1).otherwise(0)), [entry], F.max("_tier").alias("_best")
    ).filter(F.col("_tier") == F.col("_best"))
    x = S.with_group(x, [entry], F.max("confidence_score").alias("_top"))
    near = F.coalesce(F.col("confidence_score") >= F.col("_top") - margin, F.col("_top").isNull())
    # invalid entries rank by confidence alone
    by_score = F.when((F.col("_best") > 0) & near, F.col("vina_score_min"))
    order = [
        F.when((F.col("_best") > 0) & ~near, 1).otherwise(0).asc(),
        by_score.asc_nulls_last(),
        F.col("confidence_score").desc_nulls_last(),
        F.col(index).asc(),
    ]
    return S.first_per(x, [entry], order).drop("_tier", "_best", "_top")


def share_comparison(before: DataFrame, after: DataFrame, category: str) -> DataFrame:
    """Share of each category before and after sampling."""

    def shares(df, name):
        counts = df.groupBy(category).agg(F.count(F.lit(1)).alias(f"n_{name}"))
        return S.with_group(counts, [], F.sum(f"n_{name}").alias("_t")).select(
            category, f"n_{name}", (F.col(f"n_{name}") / F.col("_t")).alias(f"share_{name}")
        )

    return shares(before, "before").join(shares(after, "after"), category, "full")


def entropy(df: DataFrame, category: str) -> DataFrame:
    """Shannon entropy in bits of the category counts."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("_t")
    return S.with_group(counts, [], F.sum("n").alias("_t")).agg(
        F.sum(-p * F.log2(p + 1e-10)).alias("entropy"), F.count(F.lit(1)).alias("n_categories")
    )


def histogram(df: DataFrame, value: Column, edges: list[float], by: str) -> DataFrame:
    """Counts per bin and label; bins are closed on the left, the last one on both sides."""
    edge = F.array(*[F.lit(float(e)) for e in edges])
    last = len(edges) - 2
    idx = F.least(F.size(F.filter(edge, lambda e: e <= value)) - 1, F.lit(last))
    return (
        df.filter((value >= edges[0]) & (value <= edges[-1]))
        .groupBy(by, idx.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
