"""Ligand pairs: exact threshold joins, sampled pairs, difficulty buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.plans import skew as S
from bindloom.session import written

N_BITS = 2048  # fixed value: fingerprint length, which bounds the table of ranks
MET_COST = 4  # a pair met through a leading bit costs as much as so many pairs looked at in blocks
MOST_WORDS = 16  # more of them would make the generated code of a pair too long


def bit_ranks(rows: DataFrame) -> DataFrame:
    """One row: the rank of every bit, from rare to frequent, as an array by bit; ``N_BITS`` entries at most."""
    freq = rows.select(F.explode(F.array_distinct("bits")).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    ranks = freq.withColumn("rank", F.row_number().over(W.orderBy("n", "bit")))  # as many rows as bits
    known = ranks.agg(F.map_from_entries(F.collect_list(F.struct("bit", "rank"))).alias("m"), F.max("bit").alias("top"))
    return known.select(F.transform(F.sequence(F.lit(0), F.coalesce("top", F.lit(0))), lambda b: F.try_element_at("m", b)).alias("ranks"))


def _enough(overlap: Column, n: Column, m: Column, threshold: float) -> Column:
    """An overlap of two sets of n and m that reaches the threshold; the margin is for rounding only."""
    return overlap * (1 + threshold) >= (n + m) * threshold - 1e-9


def similar_pairs(left: DataFrame, right: DataFrame, by: list[str], key: str, threshold: float, block: int = 2048, once: bool = False) -> DataFrame:
    """All pairs within ``by`` whose Tanimoto similarity reaches the threshold, exactly.

    Bits are ranked from rare to frequent. Two similar sets share one of their first bits, at places that still
    allow the overlap, so most groups are joined on (group, leading bit) with ids, sizes and places only;
    the bits come back for the pairs that are left. A group whose leading bits are so common that this
    would cost more than a look at every pair is joined by bands of sizes instead, block by block; there the
    bits travel as 64-bit words, and a pair is looked at by counting common bits of words.
    ``bits`` holds the on-bits. The similarity of two empty sets is NaN, which is above every threshold as in SQL, so
    they are a pair; an empty set and another one are not, and null bits are no set. Rows of one key are no
    pair; a row without a key may be any and is told from all others. With ``once``, for two sides that are the same
    rows, a pair comes once, the smaller key first, and is looked at once; rows without a key have no place in that order.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    sides = [df.select(*by, F.col(key).alias("_key"), "bits", F.lit(i).alias("_side")) for i, df in enumerate((left, right))]
    both = sides[0].unionByName(sides[1])
    x = S.with_row(both, bit_ranks(both)).withColumn("_r", F.array_sort(F.transform(F.array_distinct("bits"), lambda b: F.get("ranks", b))))
    x = x.withColumn("_n", F.size("_r")).filter("_n >= 0").select(*by, "_key", "_side", "_n", "_r")
    x = written(x.withColumn("_row", F.monotonically_increasing_id()), "fingerprints").withColumn("_empty", F.col("_n") == 0)
    parts = [*by, "_empty"]  # the empty sets of a group are one of their own, in which all are pairs
    first = F.slice("_r", 1, F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9).cast("int") + 1)
    heads = x.select(*by, "_row", "_key", "_side", "_n", F.posexplode(first).alias("_pos", "_bit"))
    mine = [F.col("_side") == i for i in (0, 1)]
    met = heads.groupBy(*by, "_bit").agg(*[F.count_if(m).alias(f"_c{i}") for i, m in enumerate(mine)]).groupBy(*by).agg(F.sum(F.col("_c0") * F.col("_c1")).alias("_met"))
    sizes = x.groupBy(*parts).agg(*[F.count_if(m).alias(f"_c{i}") for i, m in enumerate(mine)])
    dense = F.col("_empty") | (F.col("_met") * MET_COST > F.col("_c0") * F.col("_c1"))
    groups = S.null_safe_join(sizes, met.withColumn("_empty", F.lit(False)), parts, "left").withColumn("_dense", dense)
    groups = written(groups.filter("_met > 0 OR _empty AND _c0 > 0 AND _c1 > 0").withColumn("_blocks", F.ceil(F.greatest("_c0", "_c1") / block).cast("int")), "fingerprint-groups")
    apart = F.col("_key") < F.col("_key2") if once else F.coalesce(F.col("_key") != F.col("_key2"), F.lit(True))

    sparse = S.null_safe_join(heads, groups.filter("NOT _dense").select(*by), by, "left_semi")
    b = sparse.filter("_side = 1").select(*by, "_bit", F.col("_row").alias("_row2"), F.col("_key").alias("_key2"), F.col("_n").alias("_m"), F.col("_pos").alias("_at"))
    pairs = S.null_safe_join(sparse.filter("_side = 0"), b, [*by, "_bit"])
    most = F.least("_pos", "_at") + F.least(F.col("_n") - F.col("_pos"), F.col("_m") - F.col("_at"))
    pairs = pairs.filter(apart & _fits(threshold) & _enough(most, F.col("_n"), F.col("_m"), threshold))
    pairs = pairs.select("_row", "_row2").distinct()
    pairs = pairs.join(x.filter("_side = 0").select(*by, "_row", "_key", "_n", "_r"), "_row")
    pairs = pairs.join(x.filter("_side = 1").select(*[F.col(k).alias(v) for k, v in {"_row": "_row2", "_key": "_key2", "_n": "_m", "_r": "_r2"}.items()]), "_row2")
    pairs = pairs.withColumn("_o", F.size(F.array_intersect("_r", "_r2")))

    words, overlap = _bits_as_words(x)
    packed = x.select(*parts, "_row", "_key", "_n", "_side", *[w.alias(f"_w{i}") for i, w in enumerate(words)])
    packed = S.null_safe_join(packed, groups.filter("_dense").select(*parts, "_blocks"), parts)
    # sizes that fit lie in one band or in neighbouring ones
    band = F.floor(F.log(F.greatest("_n", F.lit(1)).cast("double")) / (1.001 * max(math.log(1 / threshold), 1e-3))).cast("int")
    own, last = F.pmod(F.xxhash64("_key" if once else "_row"), F.col("_blocks")).cast("int"), F.col("_blocks") - 1
    packed = packed.withColumn("_own", own).withColumn("_band", band)
    packed = packed.filter(F.col("_key").isNotNull()) if once else packed
    # of two blocks of the same rows, only the earlier one is the left side
    cols = ["_key", "_n", *[f"_w{i}" for i in range(len(words))]]
    a = packed.filter("_side = 0").select(*parts, *cols, "_band", F.col("_own").alias("_i"), F.explode(F.sequence("_own" if once else F.lit(0), last)).alias("_j"))
    b = packed.filter("_side = 1").select(*parts, *cols, "_band", F.col("_own").alias("_j"), F.explode(F.sequence(F.lit(0), "_own" if once else last)).alias("_i"))
    b = b.withColumn("_band", F.explode(F.array(*[F.col("_band") + d for d in (-1, 0, 1)])))
    b = b.withColumnsRenamed({"_key": "_key2", "_n": "_m"} | {f"_w{i}": f"_v{i}" for i in range(len(words))})
    blocks = S.null_safe_join(a, b, [*parts, "_band", "_i", "_j"])
    blocks = blocks.filter(((F.col("_i") != F.col("_j")) | apart if once else apart) & _fits(threshold) & _enough(overlap, F.col("_n"), F.col("_m"), threshold))
    ends = [F.least("_key", "_key2").alias("_key"), F.greatest("_key", "_key2").alias("_key2")] if once else ["_key", "_key2"]
    blocks = blocks.select(*by, *ends, "_n", "_m", overlap.alias("_o"))

    out = pairs.select(*by, "_key", "_key2", "_n", "_m", "_o").unionByName(blocks)
    similarity = F.coalesce(F.try_divide("_o", F.col("_n") + F.col("_m") - F.col("_o")), F.lit(float("nan")))
    out = out.withColumn("similarity_2d", similarity).filter(F.col("similarity_2d") >= threshold)
    return out.select(*by, F.col("_key").alias(f"{key}_1"), F.col("_key2").alias(f"{key}_2"), "similarity_2d")


def _bits_as_words(x: DataFrame) -> tuple[list[Column], Column]:
    """The columns in which the ranks ``_r`` of a row travel, and the overlap of the columns ``_w`` and ``_v`` of two rows.

    Up to ``MOST_WORDS`` words of 64 bits; the ranks themselves where there are more distinct bits than these hold.
    """
    top = x.agg(F.max(F.array_max("_r"))).first()[0] or 1
    n = (top + 63) // 64
    if n > MOST_WORDS:
        return [F.col("_r")], F.size(F.array_intersect("_w0", "_v0"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def word(i):
        bit = lambda r: F.when(F.floor((r - 1) / 64) == i, F.call_function("shiftleft", one, ((r - 1) % 64).cast("int"))).otherwise(zero)
        return F.aggregate("_r", zero, lambda acc, r: acc.bitwiseOR(bit(r)))

    overlap = sum((F.bit_count(F.col(f"_w{i}").bitwiseAND(F.col(f"_v{i}"))) for i in range(1, n)), F.bit_count(F.col("_w0").bitwiseAND(F.col("_v0"))))
    return [word(i) for i in range(n)], overlap


def _fits(threshold: float) -> Column:
    n, m = F.col("_n"), F.col("_m")
    return (n >= m * threshold - 1e-9) & (m >= n * threshold - 1e-9)


def sampled_ligands(df: DataFrame, by: list[str], key: str, max_ligands: int, seed: int = 42) -> DataFrame:
    """At most ``max_ligands`` distinct ligands per protein, drawn by a seeded hash."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *by, F.col(key).cast("string")))
    one = S.first_per(df, [*by, key], [F.col(key)])
    return S.top_k(one, by, [draw], max_ligands, "_i")


def sampled_pairs(df: DataFrame, by: list[str], key: str, max_ligands: int, blocks: int = 8, seed: int = 42) -> DataFrame:
    """Unordered pairs among the sampled ligands of a protein.

    The sample size is a parameter of the operator and bounds every protein to
    ``max_ligands² / 2`` rows; the first side is spread over ``blocks`` so that the pairs of one
    protein are made by several tasks.
    """
    s = sampled_ligands(df, by, key, max_ligands, seed).drop("_i")
    a = s.withColumn("_blk", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    b = s.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rest = [c for c in s.columns if c not in by]
    a = a.withColumnsRenamed({c: f"{c}_1" for c in rest})
    b = b.withColumnsRenamed({c: f"{c}_2" for c in rest})
    return a.join(b, [*by, "_blk"]).filter(F.col(f"{key}_1") < F.col(f"{key}_2")).drop("_blk")


def difficulty_bucket(df: DataFrame, by: list[str], score: str, ties: list[Column]) -> DataFrame:
    """Per protein, lowest 30 % of the similarities easy, from 70 % on hard, the rest medium."""
    x = S.ranked(df, by, [F.col(score), *ties], "_rn", total="_n")
    name = (
        F.when(F.col("_rn") <= F.floor(F.col("_n").cast("double") * 0.30), "easy")
        .when(F.col("_rn") > F.floor(F.col("_n").cast("double") * 0.70), "hard")
        .otherwise("medium")
    )
    return x.withColumn("bucket", name).drop("_rn", "_n")
