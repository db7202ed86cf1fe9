"""Template hits, structure metadata and training-set selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.functions import sequences as Q
from bindloom.operators.sampling import hash_order, hash_uniform
from bindloom.plans import skew as S

# fixed values: letters a sequence can hold
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prefilter(
    hits: DataFrame, dates: DataFrame, replaced: DataFrame, max_date: str, max_hits: int,
    min_align: float = 0.1, max_subsequence: float = 0.95, min_length: int = 10, days: int = 60,
) -> DataFrame:
    """Hits with the reason of rejection; accepted hits are ranked by score, up to ``max_hits``.

    ``hits``: query_id, hit_id, query_sequence, query_pdb, query_date, hit_pdb, hit_sequence,
    aligned_cols, sum_probs. ``dates``: pdb, date. ``replaced``: from_id, to_id.
    """
    known = dates.select(F.col("pdb").alias("hit_pdb"), F.lit(True).alias("_known"))
    x = hits.join(known, "hit_pdb", "left").join(replaced.select(F.col("from_id").alias("hit_pdb"), "to_id"), "hit_pdb", "left")
    x = x.withColumn("pdb", F.when(F.col("_known").isNull(), F.coalesce("to_id", "hit_pdb")).otherwise(F.col("hit_pdb")))
    x = x.join(dates.select("pdb", "date"), "pdb", "left")
    cutoff = F.least(F.lit(max_date).cast("date"), F.date_sub("query_date", days))
    letters = F.replace(F.col("hit_sequence"), F.lit("-"), F.lit(""))
    n, q = F.length(letters), F.length("query_sequence")
    reason = (
        F.when(F.col("date") > cutoff, "after cut-off date")
        .when(F.lower("query_pdb") == F.lower("pdb"), "same structure")
        .when(F.col("aligned_cols") / q <= min_align, "align ratio too small")
        .when(F.contains(F.col("query_sequence"), letters) & (n / q > max_subsequence), "exact subsequence")
        .when(n < min_length, "too short")
    )
    x = x.withColumn("reason", reason).drop("_known", "to_id", "date")
    best = S.top_k(x.filter(F.col("reason").isNull()), ["query_id"], [F.desc("sum_probs"), F.asc("hit_id")], max_hits, "rank")
    return x.join(best.select("query_id", "hit_id", "rank"), ["query_id", "hit_id"], "left")


def locate(hits: DataFrame, chains: DataFrame, hit_id: str) -> DataFrame:
    """Chain and offset of each hit sequence: same chain exactly, any chain exactly, X as wildcard.

    ``hits``: hit_id, pdb, chain, sequence; ``chains``: pdb, chain, ord, seqres.
    """
    c = chains.select("pdb", F.col("chain").alias("found_chain"), "ord", "seqres")
    x = hits.join(c, "pdb")
    at = F.instr(F.col("seqres"), F.col("sequence"))
    parts = F.transform(Q.chars(F.col("sequence")), lambda a: F.when(a == "X", ".").otherwise(F.concat(F.lit("["), a, F.lit("X]"))))
    fuzzy_at = F.regexp_instr(F.col("seqres"), F.array_join(parts, ""))
    tier = F.when((at > 0) & (F.col("chain") == F.col("found_chain")), 0).when(at > 0, 1).when(fuzzy_at > 0, 2)
    offset = F.when(F.col("tier") < 2, at - 1).when(F.col("tier") == 2, fuzzy_at - 1)
    x = x.withColumn("tier", tier).withColumn("offset", offset)
    best = F.min_by(F.struct("tier", "found_chain", "offset"), F.when(F.col("tier").isNotNull(), F.struct("tier", "ord")))
    found = x.groupBy(hit_id).agg(best.alias("_b")).select(hit_id, "_b.tier", "_b.found_chain", "_b.offset")
    return hits.join(found, hit_id, "left").withColumn("found", F.col("tier").isNotNull())


def map_indices(df: DataFrame, hit_query: str, hit_sequence: str, indices_query: str, indices_hit: str, query_sequence: str) -> DataFrame:
    """Query position → hit position for every aligned column, as rows (query_pos, hit_pos)."""
    def shifted(c):
        least = F.array_min(F.filter(F.col(c), lambda i: i > -1))
        return least

    x = df.withColumn("_mq", shifted(indices_query)).withColumn("_mh", shifted(indices_hit))
    bare = lambda c: F.replace(F.col(c), F.lit("-"), F.lit(""))
    x = x.withColumn("_off", F.instr(F.col(query_sequence), bare(hit_query)) - 1)
    x = x.withColumn("_nh", F.length(bare(hit_sequence))).withColumn("_nq", F.length(query_sequence))
    x = x.filter(F.length(hit_query) > 0)
    rows = x.withColumn("_p", F.explode(F.arrays_zip(F.col(indices_query).alias("q"), F.col(indices_hit).alias("h"))))
    rows = rows.filter("_p.q > -1 and _p.h > -1")
    rows = rows.withColumn("query_pos", F.col("_p.q") - F.col("_mq") + F.col("_off")).withColumn("hit_pos", F.col("_p.h") - F.col("_mh"))
    keep = (F.col("hit_pos") < F.col("_nh")) & (F.col("query_pos") < F.col("_nq"))
    return rows.filter(keep).drop("_mq", "_mh", "_off", "_nh", "_nq", "_p")


def gap_check(ca: DataFrame, by: list[str], pos: str, limit: float) -> DataFrame:
    """Chains whose neighbouring CA atoms are farther apart than the limit are rejected.

    Neighbours are found by an equi-join on position + 1, so a chain is never gathered.
    """
    nxt = ca.select(*by, (F.col(pos) - 1).alias(pos), *[F.col(v).alias(f"n{v}") for v in "xyz"])
    d2 = sum(((F.col(v) - F.col(f"n{v}")) * (F.col(v) - F.col(f"n{v}")) for v in "xyz"), F.lit(0.0))
    pairs = ca.join(nxt, [*by, pos], "left").withColumn("_d", F.sqrt(d2))
    return pairs.groupBy(*by).agg(
        F.max("_d").alias("max_step"), F.coalesce(F.bool_or(F.col("_d") > limit), F.lit(False)).alias("rejected")
    )


def dates_and_resolution(meta: DataFrame, revisions: str, fields: list[str]) -> DataFrame:
    """Oldest revision date; last valid number among the resolution fields, null when none."""
    numbers = [F.col(f).try_cast("double") for f in reversed(fields)]
    return meta.withColumn("release_date", F.array_min(revisions)).withColumn("resolution", F.coalesce(*numbers))


def train_filter(chains: DataFrame, sequence: str, resolution: str, max_resolution: float = 9.0, max_share: float = 0.8) -> DataFrame:
    """Chains with good resolution (null passes) and no letter above the largest share.

    Letters are counted inside the row, so no sequence is exploded or shuffled.
    """
    n = [F.length(sequence) - F.length(F.replace(F.col(sequence), F.lit(a), F.lit(""))) for a in LETTERS]
    x = chains.filter(F.col(resolution).isNull() | (F.col(resolution) <= max_resolution))
    share = F.try_divide(F.greatest(*n), F.length(sequence))
    # a generator keeps the filter below from copying the sequence expression into every count
    x = x.select("*", F.explode(F.array(share)).alias("largest_share"))
    return x.filter(F.col("largest_share") <= max_share)


def train_probability(length: Column, cluster_size: Column) -> Column:
    """1 / cluster size (where known) times the length clamped to 256…512 over 512."""
    by_cluster = F.when(cluster_size > 0, 1.0 / cluster_size).otherwise(1.0)
    return by_cluster * F.least(F.greatest(length, F.lit(256)), F.lit(512)) / 512.0


def train_draw(chains: DataFrame, key: str, length: Column, cluster_size: Column, seed: int = 7) -> DataFrame:
    x = chains.withColumn("p", train_probability(length, cluster_size))
    return x.filter(hash_uniform(key, seed=seed) < F.col("p"))


def mix_epoch(accepted: DataFrame, dataset: str, key: str, weights: dict[str, float], epoch_len: int, epoch: int = 0, seed: int = 7) -> DataFrame:
    """An epoch of exactly ``epoch_len`` items: each slot draws a dataset by weight and takes its next item.

    Items of a dataset come in seeded hash order and start over when exhausted. Only datasets with an
    item and a positive weight are drawn, with their weights scaled up to one; without any the epoch is empty.
    """
    spark = accepted.sparkSession
    named = accepted.select(dataset, key).filter(F.col(dataset).isin([n for n, w in weights.items() if w > 0]))
    items = named.withColumn("_h", hash_order(key, seed=seed + epoch))
    items = S.ranked(items, [dataset], [F.col("_h"), F.col(key)], "_i", total="_size")
    sizes = items.groupBy(dataset).agg(F.max("_size").alias("_size"))
    held = {r[dataset] for r in sizes.select(dataset).collect()}  # as many rows as there are weights, at most
    slots = spark.range(epoch_len if held else 0).select(F.col("id").alias("slot")).withColumn("_u", hash_uniform("slot", seed=seed + 1000 * (epoch + 1)))
    drawn = {n: w for n, w in weights.items() if n in held}
    total, upto, pick = sum(drawn.values()), 0.0, F.when(F.lit(False), "")
    for name, w in drawn.items():
        upto += w
        pick = pick.when(F.col("_u") < upto / total, name)
    slots = S.ranked(slots.withColumn(dataset, pick), [dataset], [F.col("slot")], "_n")
    slots = slots.join(sizes, dataset).withColumn("_i", (F.col("_n") - 1) % F.col("_size") + 1)
    out = slots.join(items.drop("_size", "_h"), [dataset, "_i"])
    return out.select(F.lit(epoch).alias("epoch"), "slot", dataset, key)
