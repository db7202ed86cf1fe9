"""Binning and sampling of labelled pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.functions import affinity as A
from bindloom.plans import skew as S
from bindloom.session import dropped, written

# fixed values: tier cut-offs in pX, size bins of sequences and ligands
TIGHT_PX, NON_BINDER_PX = 8.5, 4.5
SIZE_NAMES = ["small", "medium", "large", "very_large"]
SEQUENCE_EDGES = [150, 300, 500]
MASS_EDGES = [250, 400, 600]


def affinity_tier(label: Column, px: Column) -> Column:
    target = F.when(px >= TIGHT_PX, "tight_binder").otherwise("moderate_binder")
    return F.when(label == "target", target).otherwise(
        F.when(px <= NON_BINDER_PX, "non_binder").otherwise("weak_binder")
    )


def protein_size(length: Column) -> Column:
    return A.bins(length, SEQUENCE_EDGES, SIZE_NAMES)


def ligand_size(mass: Column) -> Column:
    return A.bins(mass, MASS_EDGES, SIZE_NAMES)


def cluster_id(*bins: str) -> Column:
    return F.concat_ws("_", *bins)


def hash_order(*parts: str, seed: int = 42) -> Column:
    """Reproducible pseudo-random order of rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def hash_uniform(*parts: str, seed: int = 42) -> Column:
    """Reproducible draw from [0, 1) per row."""
    return F.conv(F.substring(hash_order(*parts, seed=seed), 1, 8), 16, 10).cast("double") / 4294967296.0


SETTLED = 1e-9  # centres that move less stand still


def diversity_sample(df: DataFrame, by: list[str], key: str, features: list[str], size: str) -> DataFrame:
    """Diverse rows per group: k-means on standardised features, one row per cluster.

    ``size`` is a column with the number of rows wanted by the group; as many rows with the least hash are
    the first centres. Rounds go on until no centre of any group moves. Groups are never gathered: the
    centres of a group travel to its rows, and a round is one join and one partial aggregate over the
    groups that still move. Clusters
    that lose their rows are topped up with further rows of the group in the order of their hash.
    """
    stats = [s for f in features for s in (F.avg(f).alias(f"_m_{f}"), F.stddev_pop(f).alias(f"_s_{f}"))]
    x = S.with_group(df, by, *stats)
    scaled = F.array(
        *[F.when(F.col(f"_s_{f}") > 0, (F.coalesce(F.col(f), F.lit(0.0)) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")).otherwise(0.0) for f in features]
    )
    x = x.withColumn("_z", scaled).drop(*[f"_{p}_{f}" for f in features for p in "ms"]).withColumn("_h", hash_order(*by, key))
    x = written(x, "kmeans")  # read by every round
    most = x.agg(F.max(size)).first()[0] or 0
    seeds = S.top_k(x, by, [F.col("_h")], most, "_i").filter(F.col("_i") <= F.col(size))

    def listed(moved):
        return moved.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_z").alias("z")))).alias("_centres"))

    def dist(z, centre):
        return F.aggregate(F.zip_with(z, centre, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    def assign(centres):
        y = S.null_safe_join(x, centres, by)
        options = F.transform("_centres", lambda k: F.struct(dist(F.col("_z"), k["z"]).alias("d"), k["i"].alias("i")))
        return y.withColumn("_cluster", F.array_min(options)["i"]).drop("_centres")

    centres = written(listed(seeds), "kmeans-centres")
    settled, kept, last = [], set(), centres  # groups whose centres stand still leave the rounds
    while most > 0:
        mean = F.array(*[F.avg(F.col("_z")[j]) for j in range(len(features))])
        moved = assign(centres).groupBy(*by, F.col("_cluster").alias("_i")).agg(mean.alias("_z"))
        # a centre that lost its rows has no place in the new list
        both = S.null_safe_join(listed(moved), centres.withColumnRenamed("_centres", "_last"), by)
        apart = F.transform(F.arrays_zip("_centres", "_last"), lambda p: dist(p["_centres"]["z"], p["_last"]["z"]))
        stand = (F.size("_centres") == F.size("_last")) & ~F.exists(apart, lambda d: d > SETTLED * SETTLED)
        now = written(both.select(*by, "_centres", F.coalesce(stand, F.lit(True)).alias("_stand")), "kmeans-centres")
        some = now.groupBy().agg(F.count_if("_stand").alias("still"), F.count_if(~F.col("_stand")).alias("moving")).first()
        if some.still:
            settled.append(now.filter("_stand").drop("_stand"))
        if last._written_path not in kept:
            dropped(x.sparkSession, last)
        kept |= {now._written_path} if some.still else set()
        centres, last = now.filter("NOT _stand").drop("_stand"), now
        if not some.moving:
            break
    near = assign(reduce(DataFrame.unionByName, settled, centres))
    first = S.first_per(near, [*by, "_cluster"], [F.col("_h")]).select(*by, key, F.lit(0).alias("_prio"))
    order = [F.coalesce("_prio", F.lit(1)).asc(), F.col("_h").asc()]
    ranked = S.top_k(S.null_safe_join(near, first, [*by, key], "left"), by, order, most, "_i")
    return ranked.filter(F.col("_i") <= F.col(size)).drop("_i", "_prio", "_h", "_z")


def sample_by_priority(df: DataFrame, protein: str, ligand: str, px: str, features: list[str], n: int) -> DataFrame:
    """Per protein ``n`` targets and ``n`` off-targets: extreme binders first, the rest by diversity."""
    extreme = F.when(F.col("target_type") == "target", F.col(px) >= TIGHT_PX).otherwise(F.col(px) <= NON_BINDER_PX)
    x = df.withColumn("_extreme", extreme.cast("int"))
    group = [protein, "target_type"]
    x = S.with_group(x, group, F.sum("_extreme").alias("_n_ext"))
    # the quota of a tier: all wanted rows from the extreme tier if it is large enough, else the remainder from the other
    quota = F.when(F.col("_extreme") == 1, F.least("_n_ext", F.lit(n))).otherwise(F.greatest(F.lit(n) - F.col("_n_ext"), F.lit(0)))
    x = x.withColumn("_quota", quota.cast("int")).filter("_quota > 0")
    picked = diversity_sample(x, [*group, "_extreme"], ligand, features, "_quota")
    both = picked.groupBy(protein).agg(F.count_distinct("target_type").alias("_k")).filter("_k = 2").select(protein)
    return picked.join(both, protein, "left_semi").drop("_extreme", "_n_ext", "_quota", "_cluster")


def stratified_quota(df: DataFrame, family: str, total: int, minimum: int = 3) -> DataFrame:
    """Rows to draw per family: proportional, at least ``minimum``, capped by size, scaled down over the total."""
    sizes = df.groupBy(family).agg(F.count(F.lit(1)).alias("size"))
    x = S.with_group(sizes, [], F.sum("size").alias("_all"))
    ideal = F.greatest(F.lit(minimum), F.floor(F.lit(total) * F.col("size") / F.col("_all")))
    x = x.withColumn("quota", F.least(ideal, "size"))
    x = S.with_group(x, [], F.sum("quota").alias("_sum"))
    scaled = F.greatest(F.lit(1), F.floor(F.col("quota") * (F.lit(float(total)) / F.col("_sum"))))
    return x.select(family, "size", F.when(F.col("_sum") > total, scaled).otherwise(F.col("quota")).cast("long").alias("quota"))


def sample_stratified(df: DataFrame, key: str, family: str, total: int, minimum: int = 3, seed: int = 42) -> DataFrame:
    """Draw the quota of every family without replacement, in seeded hash order."""
    order = hash_order(key, seed=seed)
    ranked = S.ranked(df.withColumn("_h", order), [family], [F.col("_h"), F.col(key)], "_rn")
    quota = stratified_quota(df, family, total, minimum).select(family, "quota")
    return ranked.join(quota, family).filter(F.col("_rn") <= F.col("quota")).drop("_h", "_rn", "quota")
