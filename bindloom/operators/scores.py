"""Analysis of model scores in a long table (…, residue, aa, logit)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.plans import skew as S

# fixed values: amino-acid order of the model, the unknown channel, floors of probabilities
AA = "ACDEFGHIKLMNPQRSTVWYX"
UNKNOWN = "X"
EPS = 1e-12


def aa_index(c: str = "aa") -> Column:
    return F.instr(F.lit(AA), F.col(c)) - 1


def with_softmax(df: DataFrame, cell: list[str], logit: str = "logit", temperature: float = 1.0) -> DataFrame:
    """Probability and log-probability per cell; the unknown channel is masked out.

    A cell is one residue of one score set, at most one row per letter of the alphabet.
    """
    x = F.when(F.col("aa") != UNKNOWN, F.col(logit) / temperature)
    w = W.partitionBy(*cell)
    out = df.withColumn("_x", x).withColumn("_m", F.max("_x").over(w))
    out = out.withColumn("_s", F.sum(F.exp(F.col("_x") - F.col("_m"))).over(w))
    log_prob = F.col("_x") - F.col("_m") - F.log("_s")
    return out.withColumn("log_prob", log_prob).withColumn("prob", F.coalesce(F.exp("log_prob"), F.lit(0.0))).drop("_x", "_m", "_s")


def mean_std(df: DataFrame, keys: list[str], value: str = "prob") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def mean_of_means(df: DataFrame, keys: list[str], run: str, value: str = "logit") -> DataFrame:
    """Average over the batch of each run, then over runs."""
    per_run = df.groupBy(*keys, run).agg(F.avg(value).alias("_v"))
    return per_run.groupBy(*keys).agg(F.avg("_v").alias(value))


def fuse(target: DataFrame, offs: DataFrame, mask: DataFrame, keys: list[str], w_target: float = 1.0, w_off: float = 1.0) -> DataFrame:
    """Target logits minus masked mean off-target logits, with fresh log-probabilities.

    ``offs`` holds one row per (keys, residue, aa, off-target); ``mask`` (keys, residue, mask).
    """
    cell = [*keys, "residue"]
    mean = offs.groupBy(*cell, "aa").agg(F.avg("logit").alias("_off"))
    x = target.join(mean, [*cell, "aa"], "left").join(mask, cell, "left")
    fused = w_target * F.col("logit") - w_off * F.coalesce("mask", F.lit(1.0)) * F.coalesce("_off", F.lit(0.0))
    return with_softmax(x.withColumn("logit", fused).drop("_off", "mask"), cell)


def penalty_mask(residues: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Product of masks; a residue missing from a mask counts as 0 there, no mask at all gives 1."""
    out = residues
    for i, part in enumerate(parts):
        out = out.join(part.select(*keys, F.col("mask").cast("double").alias(f"_m{i}")), keys, "left")
    product = reduce(lambda a, b: a * b, [F.coalesce(f"_m{i}", F.lit(0.0)) for i in range(len(parts))], F.lit(1.0))
    return out.withColumn("mask", product).drop(*[f"_m{i}" for i in range(len(parts))])


def delta_matrix(target: DataFrame, off: DataFrame, keys: list[str], pocket: DataFrame) -> DataFrame:
    """Difference of logits for every pocket residue and amino acid."""
    cell = [*keys, "residue"]
    a = target.join(pocket, cell, "left_semi")
    b = off.select(*cell, "aa", F.col("logit").alias("off_logit"))
    x = a.join(b, [*cell, "aa"]).filter(F.col("aa") != UNKNOWN)
    return x.withColumn("delta", F.col("logit") - F.col("off_logit"))


def pocket_delta(target: DataFrame, off: DataFrame, keys: list[str], pocket: DataFrame, native: DataFrame) -> DataFrame:
    """Native-residue logit on target and off-target with their difference."""
    rows = delta_matrix(target, off, keys, pocket).join(native, [*keys, "residue", "aa"], "left_semi")
    return rows.select(*keys, "residue", "aa", "logit", "off_logit", "delta")


def with_fallback(target: DataFrame, off: DataFrame, all_off: DataFrame) -> DataFrame:
    """Off-target means for every cell of ``target``; samples without their own take the overall mean."""
    own = off.select("sample", "residue", "aa", F.col("logit").alias("_own"))
    has = off.select("sample").distinct().withColumn("_has", F.lit(True))
    x = target.select("sample", "residue", "aa").join(own, ["sample", "residue", "aa"], "left").join(has, "sample", "left")
    x = x.join(all_off.select("residue", "aa", F.col("logit").alias("_all")), ["residue", "aa"], "left")
    x = x.withColumn("logit", F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_all")))
    return x.filter(F.col("logit").isNotNull()).select("sample", "residue", "aa", "logit")


def topk_success(df: DataFrame, other: DataFrame, ensemble: list[str], wanted: DataFrame) -> DataFrame:
    """How often the wanted amino acid is first or among the first three at its site.

    Only samples present in ``other`` count; one row per sample and site, and an ALL row per site.
    """
    site = df.join(other.select("sample").distinct(), "sample", "left_semi").filter(F.col("aa") != UNKNOWN)
    site = site.join(wanted, "residue")
    top = S.top_k(site, ["sample", *ensemble, "residue"], [F.desc("logit"), aa_index().asc()], 3, "_rn")
    hit = F.col("aa") == F.col("wanted_aa")
    per = top.groupBy("sample", "residue", "wanted_aa").agg(
        F.count_if(hit & (F.col("_rn") == 1)).alias("top1"), F.count_if(hit).alias("top3"), F.count_if(F.col("_rn") == 1).alias("total")
    )
    total = per.groupBy("residue", "wanted_aa").agg(*[F.sum(n).alias(n) for n in ("top1", "top3", "total")])
    return per.unionByName(total.withColumn("sample", F.lit("ALL")))


def argmax(df: DataFrame, cell: list[str], value: str = "logit", *extra: Column) -> DataFrame:
    """Best amino acid per cell, ties by alphabet order."""
    best = F.struct(F.col(value), -aa_index())
    return df.filter(F.col("aa") != UNKNOWN).groupBy(*cell).agg(F.max_by("aa", best).alias("aa"), F.max(value).alias(value), *extra)


def margin_js(target: DataFrame, off_mean: DataFrame, fused: DataFrame, keys: list[str], pocket: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Specificity figures per key: mean margin, mean Jensen–Shannon divergence, change rate of the
    best amino acid in the pocket, mean log-probability drop of the designed sequence."""
    cell = [*keys, "residue"]
    t = with_softmax(target, cell, temperature=temperature)
    o = with_softmax(off_mean, cell, temperature=temperature).select(
        *cell, "aa", F.col("logit").alias("_ol"), F.col("prob").alias("_op"), F.col("log_prob").alias("_olp")
    )
    x = t.join(o, [*cell, "aa"])
    p, q = F.greatest("prob", F.lit(EPS)), F.greatest("_op", F.lit(EPS))
    m = F.greatest(0.5 * (F.col("prob") + F.col("_op")), F.lit(EPS))
    js = 0.5 * p * (F.log(p) - F.log(m)) + 0.5 * q * (F.log(q) - F.log(m))
    # the masked unknown channel takes part in the mean margin with difference 0
    margin = F.when(F.col("aa") == UNKNOWN, 0.0).otherwise(F.col("logit") - F.col("_ol"))
    cells = x.groupBy(*cell).agg(F.sum(margin).alias("_ms"), F.count(F.lit(1)).alias("_n"), F.sum(js).alias("_js"))
    best_t = argmax(target, cell).select(*cell, F.col("aa").alias("_at"))
    best_f = argmax(fused, cell).select(*cell, F.col("aa").alias("_af"))
    pick = x.join(best_f, cell).filter(F.col("aa") == F.col("_af")).select(*cell, (F.col("log_prob") - F.col("_olp")).alias("_drop"))
    inside = pocket.select(*cell).distinct().withColumn("_in", F.lit(True))
    y = cells.join(best_t, cell).join(best_f, cell).join(pick, cell).join(inside, cell, "left")
    changed = F.col("_in") & (F.col("_at") != F.col("_af"))
    return y.groupBy(*keys).agg(
        (F.sum("_ms") / F.sum("_n")).alias("margin"),
        F.avg("_js").alias("js"),
        (F.count_if(changed) / F.greatest(F.count_if("_in"), F.lit(1))).alias("site_change_rate"),
        F.avg("_drop").alias("off_drop"),
    )


def keysite(df: DataFrame, keys: list[str], replicate: list[str], site: Column) -> DataFrame:
    """Chosen amino acids at a key site: count, fraction, mean log-probability and logit per letter."""
    at = df.filter(site & (F.col("aa") != UNKNOWN))
    chosen = argmax(at, [*keys, *replicate], "prob").groupBy(*keys, "aa").agg(F.count(F.lit(1)).alias("_n"))
    stats = at.groupBy(*keys, "aa").agg(
        F.avg(F.log(F.greatest("prob", F.lit(EPS)))).alias("mean_log_prob"),
        F.avg("logit").alias("mean_logit"),
        F.count(F.lit(1)).alias("total_reps"),
    )
    x = stats.join(chosen, [*keys, "aa"], "left").withColumn("count", F.coalesce("_n", F.lit(0)))
    return x.withColumn("fraction", F.col("count") / F.col("total_reps")).drop("_n")


def confidence_profile(df: DataFrame, keys: list[str], replicate: list[str], centre: Column, half_width: int = 20) -> DataFrame:
    """Mean probability of the chosen amino acid per residue within a window around the key site."""
    near = df.filter(F.abs(F.col("residue") - centre) <= half_width)
    best = argmax(near, [*keys, *replicate, "residue"], "prob")
    return best.groupBy(*keys, "residue").agg(F.avg("prob").alias("mean_chosen_prob"))


def version_summary(df: DataFrame, keys: list[str], batch: str) -> DataFrame:
    """Majority amino acid, its count and the mean logit per version; ties by first batch."""
    counts = df.groupBy(*keys, "aa").agg(F.count(F.lit(1)).alias("n"), F.min(batch).alias("_f"), F.sum("logit").alias("_l"))
    return counts.groupBy(*keys).agg(
        F.max_by("aa", F.struct("n", -F.col("_f"))).alias("majority_aa"),
        F.max("n").alias("majority_count"),
        (F.sum("_l") / F.sum("n")).alias("mean_logit"),
    )


def version_agreement(df: DataFrame, mutation: str, version: str, batch: str) -> DataFrame:
    """Share of equal predictions per pair of versions, compared by the order of their batches."""
    x = S.ranked(df.select(mutation, version, batch, "aa"), [mutation, version], [F.col(batch)], "_i")
    # one row per version at each place, so a place yields at most versions² / 2 rows
    a = x.select(mutation, "_i", F.col(version).alias("version_a"), F.col("aa").alias("_a"))
    b = x.select(mutation, "_i", F.col(version).alias("version_b"), F.col("aa").alias("_b"))
    pairs = a.join(b, [mutation, "_i"]).filter(F.col("version_a") < F.col("version_b"))
    return pairs.groupBy(mutation, "version_a", "version_b").agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement")
    )


def map_sites(labels: DataFrame, residues: DataFrame, structure: str) -> DataFrame:
    """Mutation labels (structure, label, chain?, pos, wt?) to residue indices with a status."""
    x = labels.join(residues.select(structure, F.col("chain").alias("_c"), F.col("resseq").alias("pos"), "idx", F.col("aa").alias("_aa")), [structure, "pos"], "left")
    ok = F.col("idx").isNotNull() & (F.col("chain").isNull() | (F.upper("chain") == F.upper("_c")))
    same = ok & (F.col("wt") == F.col("_aa"))
    g = x.groupBy(structure, "label").agg(
        F.count_if(ok).alias("_n"), F.count_if(same).alias("_s"), F.max(F.col("wt").isNotNull()).alias("_w"),
        F.min(F.when(ok, F.col("idx"))).alias("_any"), F.min(F.when(same, F.col("idx"))).alias("_nat"),
    )
    idx = F.when(F.col("_n") == 1, F.col("_any")).when(F.col("_s") == 1, F.col("_nat"))
    status = (
        F.when(F.col("_n") == 0, "not found")
        .when((F.col("_n") > 1) & (F.col("_s") != 1), "ambiguous")
        .when(F.col("_w") & (F.col("_s") == 0), "mismatch")
        .otherwise("ok")
    )
    return g.select(structure, "label", idx.alias("idx"), status.alias("status"))


def to_wide(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Long scores to one column per amino acid in fixed order."""
    return df.groupBy(*keys).pivot("aa", list(AA)).agg(F.max(value))


def to_long(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.unpivot(keys, [a for a in AA if a in df.columns], "aa", value)


def sequence_confidence(df: DataFrame, keys: list[str], log_prob: str, mask: Column, pocket: Column) -> DataFrame:
    """Mean negative log-probability over the mask and its exponential, overall and in the pocket."""
    def loss(m):
        return F.sum(-F.col(log_prob) * m) / (F.sum(m) + 1e-8)

    a, b = loss(mask.cast("double")), loss(mask.cast("double") * pocket.cast("double"))
    return df.groupBy(*keys).agg(a.alias("loss"), F.exp(-a).alias("confidence"), b.alias("pocket_loss"), F.exp(-b).alias("pocket_confidence"))
