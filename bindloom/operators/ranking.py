"""Ranking and filtering of docked poses, decoys and ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.functions import affinity as A, superposition as P
from bindloom.plans import skew as S
from bindloom.session import dropped, written

# fixed values: weights of the composite and of the two final scores
COMPOSITE = {"score": 0.5, "distance": 0.2, "interactions": 0.3}
FINAL_FULL = {"energy": 0.4, "drift": 0.2, "hbonds": 0.2, "contacts": 0.2}
FINAL_SHORT = {"energy": 0.6, "drift": 0.4}


def window_poses(df: DataFrame, by: list[str], tie: str, max_com: float = 4.0, window: float = 3.0, min_dist: float = 2.0, k: int = 5) -> DataFrame:
    """Poses near the reference pocket, within an energy window of the best score, without clash; top ``k``."""
    x = S.with_group(df, by, F.min("score").alias("_best"))
    in_window = F.coalesce(F.col("score") <= F.col("_best") + window, F.lit(True))
    x = x.filter((F.col("com_distance") <= max_com) & in_window & (F.col("min_distance") >= min_dist)).drop("_best")
    return S.top_k(x, by, [F.coalesce("score", F.lit(999.0)), F.col("com_distance"), F.col(tie)], k, "rank")


def filter_poses(df: DataFrame, by: list[str], tie: str, cutoff: float, k: int) -> DataFrame:
    """Best ``k`` clash-free poses under a score cut-off; far or little overlapping ones are flagged."""
    x = df.filter((F.col("score") <= cutoff) & ~F.col("has_clash"))
    x = S.top_k(x, by, [F.col("score"), F.col(tie)], k, "rank")
    return x.withColumn("possible_allosteric", (F.col("com_distance") > 10.0) | (F.col("pocket_overlap") < 0.3))


def minmax(df: DataFrame, by: list[str], columns: dict[str, str], eps: float = 0.0, source: DataFrame | None = None) -> DataFrame:
    """Min–max scaled copies of columns per group; the limits may come from an earlier state of the rows."""
    aggs = [f(c).alias(f"_{n}_{c}") for c in columns.values() for n, f in (("lo", F.min), ("hi", F.max))]
    x = S.null_safe_join(df, source.groupBy(*by).agg(*aggs), by) if source and by else S.with_group(df, by, *aggs)
    out = {o: F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}") + eps) for o, c in columns.items()}
    return x.withColumns(out).drop(*[f"_{n}_{c}" for c in columns.values() for n in ("lo", "hi")])


def robust_minmax(df: DataFrame, by: list[str], columns: dict[str, str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Min–max between two quantiles with clipping; 0.5 where the quantiles coincide."""
    x = df
    for out, c in columns.items():
        q = S.exact_quantiles(df, by, c, {"_lo": low, "_hi": high})
        x = S.null_safe_join(x, q, by, "left") if by else S.with_row(x, q)
        span = F.col("_hi") - F.col("_lo")
        clipped = F.least(F.greatest(F.col(c), F.col("_lo")), F.col("_hi"))
        scaled = F.when(F.coalesce(span, F.lit(0.0)) == 0, 0.5).when(F.col(c).isNotNull(), (clipped - F.col("_lo")) / span)
        x = x.withColumn(out, scaled).drop("_lo", "_hi")
    return x


def composite_rank(df: DataFrame, by: list[str], tie: str, score: str, distance: str, interactions: str, k: int = 10) -> DataFrame:
    """Weighted sum of scaled score, scaled distance and inverted interactions; lowest ``k``."""
    x = robust_minmax(df, by, {"score_norm": score, "distance_norm": distance})
    x = minmax(x, by, {"_i": interactions}, source=df).withColumn("interactions_norm", 1 - F.col("_i")).drop("_i")
    total = (
        COMPOSITE["score"] * F.col("score_norm")
        + COMPOSITE["distance"] * F.col("distance_norm")
        + COMPOSITE["interactions"] * F.col("interactions_norm")
    )
    x = x.withColumn("composite_score", F.round(total, 9))
    return S.top_k(x, by, [F.asc_nulls_last("composite_score"), F.col(tie)], k, "rank")


def final_quality(df: DataFrame, by: list[str], tie: str, max_drift=2.0, min_hbonds=2, min_contacts=5, share=0.25, k=10) -> DataFrame:
    """Quality filters, lowest share by energy, top ``k``, then both weighted final scores (lower is better)."""
    x = df.filter((F.col("drift") <= max_drift) & (F.col("hbonds") >= min_hbonds) & (F.col("contacts") >= min_contacts))
    cut = S.exact_quantiles(x, by, "energy", {"_cut": share})
    x = S.null_safe_join(x, cut, by).filter(F.col("energy") <= F.col("_cut")).drop("_cut")
    x = S.top_k(x, by, [F.col("energy"), F.col(tie)], k, "_rn").drop("_rn")
    x = minmax(x, by, {f"_{c}": c for c in FINAL_FULL}, eps=1e-6)
    part = {"energy": F.col("_energy"), "drift": F.col("_drift"), "hbonds": 1 - F.col("_hbonds"), "contacts": 1 - F.col("_contacts")}
    for out, weights in (("final_score", FINAL_FULL), ("short_score", FINAL_SHORT)):
        x = x.withColumn(out, F.round(sum((w * part[c] for c, w in weights.items()), F.lit(0.0)), 9))
    x = x.drop(*[f"_{c}" for c in FINAL_FULL])
    return x.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("final_score", tie)))


def filter_decoys(
    df: DataFrame, by: list[str], tie: str, k: int = 50, ca=(0.3, 2.0), max_all_atom: float = 3.5, weight: float = 0.1
) -> DataFrame:
    """Decoys without energy, RMSD and interface outliers; filters are given up in turn where
    fewer than ``k`` remain; ranked by energy plus an interface penalty."""
    x = df.dropna(subset=["energy", "ca_rmsd", "all_atom_rmsd"])
    # quartiles of both columns from one pass over (group, column, value)
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("c"), F.col(n).alias("v")) for n in ("energy", "interface")])).alias("_l")
    q = S.exact_quantiles(x.select(*by, both).select(*by, "_l.c", "_l.v"), [*by, "c"], "v", {"_q1": 0.25, "_q3": 0.75})
    pick = lambda n, p: F.max(F.when(F.col("c") == n, F.col(p)))
    q = q.groupBy(*by).agg(
        *[pick(n, p).alias(a) for a, n, p in (("_e1", "energy", "_q1"), ("_e3", "energy", "_q3"), ("_i1", "interface", "_q1"), ("_i3", "interface", "_q3"))]
    )
    x = S.null_safe_join(x, q, by)
    ok_e = F.col("energy") <= F.col("_e3") + 1.5 * (F.col("_e3") - F.col("_e1"))
    ok_i = F.coalesce(F.col("interface") <= F.col("_i3") + 2.0 * (F.col("_i3") - F.col("_i1")), F.lit(False))
    ok_r = F.col("ca_rmsd").between(*ca) & (F.col("all_atom_rmsd") <= max_all_atom)
    # level of each row: 0 passes all, 1 energy and interface, 2 energy, 3 nothing
    x = x.withColumn("_level", F.when(ok_e & ok_i & ok_r, 0).when(ok_e & ok_i, 1).when(ok_e, 2).otherwise(3))
    # the rows are read several times from here on: a written table instead of as many scans of the input
    x = written(x.drop("_e1", "_e3", "_i1", "_i3"), "decoys")
    n = [F.count_if(F.col("_level") <= level).alias(f"_n{level}") for level in range(3)]
    need = F.when(F.col("_n0") >= k, 0).when(F.col("_n1") >= k, 1).when(F.col("_n2") >= k, 2).otherwise(3)
    x = S.with_group(x, by, *n).withColumn("level", need).filter(F.col("_level") <= F.col("level"))
    x = x.drop("_level", "_n0", "_n1", "_n2")
    med = S.exact_quantiles(x, by, "interface", {"_med": 0.5})
    x = S.null_safe_join(x, med, by, "left")
    penalty = F.greatest(F.col("interface") - F.col("_med"), F.lit(0.0))
    x = x.withColumn("score_eff", F.when(F.col("interface").isNotNull(), F.col("energy") + weight * penalty)).drop("_med")
    return S.top_k(x, by, [F.asc_nulls_last("score_eff"), F.col(tie)], k, "rank")


def filter_decoys_second(df: DataFrame, by: list[str], file: str, row_id: str, k: int) -> DataFrame:
    """Second decoy filter: one row per file, total-score then repulsion outliers, ranked by score and ddg.

    A row without a file name is a file of its own, named by its row id.
    """
    text = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    named = df.filter(F.col("totalscore").isNotNull() & ~F.isnan("totalscore"))
    named = named.withColumn("_file", F.coalesce(text("file ", file), text("row ", row_id)))
    x = written(S.first_per(named, [*by, "_file"], [F.col(row_id)]).drop("_file"), "decoys")
    for c in ("totalscore", "fa_rep"):
        q = S.exact_quantiles(x, by, c, {"_q1": 0.25, "_q3": 0.75})
        x = S.null_safe_join(x, q, by)
        x = x.filter(F.col(c) <= F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).drop("_q1", "_q3")
    return S.top_k(x, by, [F.col("totalscore"), F.asc_nulls_last("ddg"), F.col(row_id)], k, "rank")


def filter_ensemble(df: DataFrame, overrides: DataFrame, label: str, index: str, max_rmsd: float, min_plddt: float | None, k: int) -> DataFrame:
    """Models under RMSD and confidence thresholds (per label where overridden), top ``k`` by RMSD.

    Returns every model that passed, with its rank (null beyond ``k``); the confidence falls
    back to the second column where a label has none in the first.
    """
    x = S.with_group(df, [label], F.count_if(F.col("plddt").isNotNull() & ~F.isnan("plddt")).alias("_has"))
    x = x.join(overrides, label, "left")
    conf = F.when(F.col("_has") > 0, F.col("plddt")).otherwise(F.col("plddt_pde"))
    limit = F.coalesce("rmsd_threshold", F.lit(max_rmsd))
    ok = F.col("rmsd").isNotNull() & ~F.isnan("rmsd") & (F.col("rmsd") <= limit)
    floor = F.coalesce("plddt_threshold", F.lit(min_plddt).cast("double"))
    ok = ok & (floor.isNull() | F.coalesce(~F.isnan(conf) & (conf >= floor), F.lit(False)))
    kept = x.withColumn("used_rmsd", limit).withColumn("used_plddt", floor).filter(ok)
    kept = kept.select(label, index, "rmsd", "used_rmsd", "used_plddt")
    best = S.top_k(kept, [label], [F.col("rmsd"), F.col(index)], k, "rank").select(label, index, "rank")
    return kept.join(best, [label, index], "left")


def ensemble_summary(kept: DataFrame, label: str, index: str, base: int = 1) -> DataFrame:
    """Counts and ranked model indices per label; the list holds at most the top-k models."""
    ranked = F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", index))))
    return kept.groupBy(label).agg(
        F.count(F.lit(1)).alias("filtered_count"),
        F.count("rank").alias("ranked_count"),
        F.array_join(F.transform(ranked, lambda s: (s[index] + base).cast("string")), ",").alias("ranked_model_indices"),
    )


def select_models(df: DataFrame, label: str, indices: str, listing: DataFrame, pattern: str, shift: int = 0) -> DataFrame:
    """One row per listed model with its file name (two digits) and whether the file exists."""
    numbers = F.regexp_extract_all(F.col(indices), F.lit(r"(\d+)"), 1)
    x = df.select(label, F.posexplode(numbers).alias("pos", "_i")).withColumn("model", F.col("_i").cast("int") + shift)
    path = F.format_string(pattern, F.col(label), F.lpad(F.col("model").cast("string"), 2, "0"))
    known = listing.select("path").distinct().withColumn("found", F.lit(True))
    x = x.withColumn("path", path).join(known, "path", "left")
    return x.select(label, F.col("pos").cast("long").alias("pos"), "model", "path", F.coalesce("found", F.lit(False)).alias("found"))


def assign_ids(df: DataFrame, protein: str, tag: str, order: str) -> DataFrame:
    """Running id per protein, ``{protein}_{tag}_{n:06d}``."""
    x = S.ranked(df, [protein], [F.col(order)], "_n")
    return x.withColumn("complex_id", F.format_string(f"%s_{tag}_%06d", F.col(protein), F.col("_n"))).drop("_n")


PAIR_BLOCK = 256  # seeds of a complex that meet in one block


def seed_pairs(df: DataFrame, by: list[str], seed: str, columns: list[str]) -> DataFrame:
    """Every two seeds of a complex once, the smaller one first, whatever the seeds' numbers.

    The seeds of a complex are dealt to blocks and two blocks meet at a time, so that the pairs of one
    complex are made by as many tasks as its size asks for.
    """
    one = S.with_group(S.first_per(df, [*by, seed], [F.col(c) for c in columns]), by, F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / PAIR_BLOCK).cast("int")
    own, every = F.pmod(F.xxhash64(seed), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    a = one.select(*by, F.col(seed), *columns, own.alias("_i"), every.alias("_j"))
    b = one.select(*by, F.col(seed).alias("other"), *[F.col(c).alias(f"other_{c}") for c in columns], own.alias("_j"), every.alias("_i"))
    return S.null_safe_join(a, b, [*by, "_i", "_j"]).filter(F.col(seed) < F.col("other")).drop("_i", "_j")


def _pair_rmsd(df: DataFrame, by: list[str], seed: str, coords: str) -> DataFrame:
    """(by, seed, other, rmsd) of every two seeds; null where their atom counts differ."""
    moved = df.select(*by, seed, P.centred(F.col(coords)).alias("_xyz"))
    return seed_pairs(moved, by, seed, ["_xyz"]).select(*by, seed, "other", P.superposed_rmsd(F.col("_xyz"), F.col("other__xyz")).alias("rmsd"))


def pose_rmsd(df: DataFrame, by: list[str], seed: str, coords: str) -> DataFrame:
    """Mean superposed RMSD over all seed pairs of a complex."""
    each = _pair_rmsd(df, by, seed, coords)
    return each.groupBy(*by).agg(F.avg("rmsd").alias("mean_rmsd"), F.count("rmsd").alias("n_pairs"))


def relax_delta(df: DataFrame, by: list[str], seed: str, coords: str) -> DataFrame:
    """Change of score and repulsion by relaxation; spread of each seed's RMSD to the other seeds."""
    each = _pair_rmsd(df, by, seed, coords)
    both = each.select(*by, F.explode(F.array(seed, "other")).alias(seed), "rmsd")
    spread = both.groupBy(*by, seed).agg(F.avg("rmsd").alias("rmsd_mean"), F.stddev_pop("rmsd").alias("rmsd_std"))
    change = df.withColumn("d_total", F.col("total_after") - F.col("total_before")).withColumn(
        "d_rep", F.col("rep_after") - F.col("rep_before")
    )
    return S.null_safe_join(change, spread, [*by, seed], "left")


UNLIKE = 999.0  # fixed value: the distance of poses with different atom counts


def cluster_poses(
    df: DataFrame, by: str, pose: str, coords: str, n_select: int = 10, max_com: float = 15.0, max_clashes: int = 0
) -> DataFrame:
    """Diverse poses per configuration: clash and distance filters, RMSD clusters, share per cluster.

    Of n poses that pass, min(n_select, max(3, n // 3)) become centres: first the one nearest to the
    centre of mass, then again and again the pose farthest from all centres so far (ties to the
    smaller distance and id). A pose belongs to its nearest centre. Only the centres, ``n_select`` per
    configuration at most, travel to the poses, so a configuration of any size is never gathered.
    Each cluster gives its share of ``n_select``, at least one, the rest is filled up by distance; up to
    ``n_select`` poses are all taken as one cluster.
    """
    x = S.with_group(df, [by], F.count_if(F.col("n_clashes") <= max_clashes).alias("_clean"), F.min("n_clashes").alias("_least"))
    limit = F.when(F.col("_clean") > 0, F.lit(max_clashes)).otherwise(F.col("_least") + 2)
    x = x.filter((F.col("n_clashes") <= limit) & (F.col("com_distance") <= max_com))
    x = x.select(by, pose, F.col("com_distance").cast("double").alias("com_distance"), P.centred(F.col(coords)).alias("_xyz"))
    x = S.with_group(x, [by], F.count(F.lit(1)).alias("_n"))
    wanted = F.when(F.col("_n") <= n_select, 1).otherwise(F.least(F.lit(n_select), F.greatest(F.lit(3), F.floor(F.col("_n") / 3))))
    x = written(x.withColumns({"_k": wanted, "_d": F.lit(float("inf")), "cluster": F.lit(0).cast("long")}), "poses")
    newest = x.groupBy(by).agg(F.min_by("_xyz", F.struct("com_distance", pose)).alias("_t"), F.lit(True).alias("_new"))
    # the farthest pose; of equally far ones the first
    last = F.struct((-F.col("_d")).alias("d"), "com_distance", pose)
    apart = F.round(F.coalesce(P.superposed_rmsd(F.col("_xyz"), F.col("_t")), F.lit(UNLIKE)), 9)
    for turn in range(1, (x.agg(F.max("_k")).first()[0] or 0) + 1):
        y = S.null_safe_join(x, newest, [by], "left").withColumn("_a", F.when(F.col("_new"), apart))
        closer = F.coalesce(F.col("_a") < F.col("_d"), F.lit(False))
        y = y.withColumns({"_d": F.when(closer, F.col("_a")).otherwise(F.col("_d")), "cluster": F.when(closer, turn).otherwise(F.col("cluster")).cast("long")})
        before, x = x, written(y.select(*x.columns), "poses")
        dropped(x.sparkSession, before)
        newest = x.filter(F.col("_k") > turn).groupBy(by).agg(F.min_by("_xyz", last).alias("_t"), F.lit(True).alias("_new"))
    members = x.select(by, pose, "com_distance", "cluster", "_n")
    sized = S.with_group(members, [by, "cluster"], F.count(F.lit(1)).alias("_size"))
    share = F.when(F.col("_n") <= n_select, F.col("_n")).otherwise(F.greatest(F.lit(1), F.floor(F.col("_size") * n_select / F.col("_n"))))
    first = S.top_k(sized, [by, "cluster"], [F.col("com_distance"), F.col(pose)], n_select, "_i").withColumn("_late", (F.col("_i") > share).cast("int"))
    picked = S.top_k(first, [by], [F.col("_late"), F.col("com_distance"), F.col(pose)], n_select, "_i")
    ranked = S.top_k(picked, [by], [F.col("com_distance"), F.col(pose)], n_select, "rank")
    return ranked.select(by, pose, "com_distance", "cluster", F.col("rank").cast("long").alias("rank"))


def interaction_counts(df: DataFrame, pose: str, kind: str, kinds: list[str]) -> DataFrame:
    """Interactions per pose by type, missing types as 0, with the total."""
    x = df.groupBy(pose).pivot(kind, kinds).count().na.fill(0, kinds)
    return x.withColumn("total", sum((F.col(k) for k in kinds), F.lit(0)))
