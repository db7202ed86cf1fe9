"""Alignment tables: merge, pair chains, profile, sampling, clusters, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.functions import sequences as Q
from bindloom.operators.sampling import hash_order, hash_uniform
from bindloom.plans import skew as S

# fixed values: letter codes of alignments (B as D, J/O/X unknown, U as C, Z as E, gap last), chain gap
CODES = {
    "A": 0, "B": 2, "C": 1, "D": 2, "E": 3, "F": 4, "G": 5, "H": 6, "I": 7, "J": 20, "K": 8, "L": 9, "M": 10, "N": 11,
    "O": 20, "P": 12, "Q": 13, "R": 14, "S": 15, "T": 16, "U": 1, "V": 17, "W": 18, "X": 20, "Y": 19, "Z": 3, "-": 21,
}
UNKNOWN, GAP, MASK = "X", "-", "*"
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
CHAIN_GAP = 200


def encode(sequence: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.transform(Q.chars(sequence), lambda c: F.try_element_at(codes, c))


def merge(msas: DataFrame, query: str, sequence: str, order: list[str]) -> DataFrame:
    """Alignments of a query stacked without repeated sequences (first kept), numbered and encoded."""
    first = S.first_per(msas, [query, sequence], [F.col(o) for o in order])
    x = S.ranked(first, [query], [F.col(o) for o in order], "seq_idx", total="num_alignments")
    return x.withColumn("seq_idx", F.col("seq_idx") - 1).withColumn("codes", encode(F.col(sequence)))


def chain_layout(chains: DataFrame, complex_id: str, chain: str, sequence: str) -> DataFrame:
    """Offset, padding after and residue-index shift of every chain (one row per chain).

    Lengths are added up inside ranges of (complex, chain) and over range totals, whatever the number of chains."""
    x = S.in_ranges(chains.select(complex_id, chain, F.length(sequence).alias("len")), [complex_id], [F.col(chain)])
    totals = x.groupBy(complex_id, "_range").agg(F.sum("len").alias("_len"), F.count(F.lit(1)).alias("_n"))
    parts = W.partitionBy(complex_id).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(complex_id)
    carried = [F.coalesce(F.sum(v).over(parts), F.lit(0)).alias(f"{v}_before") for v in ("_len", "_n")]
    totals = totals.select(complex_id, "_range", *carried, F.sum("_len").over(whole).alias("_all"))
    x = S.null_safe_join(x, totals, [complex_id, "_range"])
    inside = W.partitionBy(complex_id, "_range").orderBy(chain)
    upto = F.col("_len_before") + F.sum("len").over(inside.rowsBetween(W.unboundedPreceding, 0))
    number = F.col("_n_before") + F.row_number().over(inside) - 1
    x = x.select(complex_id, chain, "len", upto.alias("_upto"), "_all", number.alias("_number"))
    shift = (F.col("_number") * CHAIN_GAP).cast("long")
    return x.select(complex_id, chain, "len", (F.col("_upto") - F.col("len")).alias("before"), (F.col("_all") - F.col("_upto")).alias("after"), shift.alias("index_shift"))


def pair_chains(alignments: DataFrame, layout: DataFrame, complex_id: str, chain: str, sequence: str) -> DataFrame:
    """Alignment rows of each chain at their place in the complex: the letters with the gaps ``before`` and ``after``.

    The table is as large as the alignments; ``padded`` writes the gaps out where a file wants them."""
    return S.null_safe_join(alignments, layout.select(complex_id, chain, "before", "after"), [complex_id, chain])


def padded(placed: DataFrame, sequence: str) -> DataFrame:
    """Rows of ``pair_chains`` with their gaps written out, chain after chain, for a writer of whole rows."""
    gap = lambda n: F.repeat(F.lit(GAP), F.col(n).cast("int"))
    return placed.withColumn(sequence, F.concat(gap("before"), F.col(sequence), gap("after"))).drop("before", "after")


def residue_index(layout: DataFrame, complex_id: str, chain: str) -> DataFrame:
    """Residue index of every position of the complex with the jump between chains."""
    x = layout.filter("len > 0").select(complex_id, chain, "before", "index_shift", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("_i"))
    pos = F.col("before") + F.col("_i")
    return x.select(complex_id, chain, pos.cast("long").alias("pos"), (pos + F.col("index_shift")).alias("residue_index"))


def profile(msa: DataFrame, query: str) -> DataFrame:
    """Share of each letter per alignment column."""
    counts = msa.groupBy(query, "pos", "aa").agg(F.count(F.lit(1)).alias("n"))
    depth = counts.groupBy(query, "pos").agg(F.sum("n").alias("depth"))
    return counts.join(depth, [query, "pos"]).withColumn("share", F.col("n") / F.col("depth")).drop("n", "depth")


def sample(rows: DataFrame, query: str, index: str, max_seq: int, max_extra: int | None = None, seed: int = 7) -> DataFrame:
    """Query row plus a random draw of ``max_seq - 1`` rows as the sample, the others as extra rows.

    With ``max_extra`` the extra rows are cropped to a second random draw.
    """
    x = S.with_group(rows, [query], F.min(index).alias("_q"))
    is_query = (F.col(index) == F.col("_q")).cast("int")
    x = x.withColumn("_h", F.when(is_query == 1, "").otherwise(hash_order(query, index, seed=seed)))
    x = S.ranked(x, [query], [F.col("_h"), F.col(index)], "_rn")
    x = x.withColumn("part", F.when(F.col("_rn") <= max_seq, "sample").otherwise("extra")).drop("_q", "_h", "_rn")
    if max_extra is None:
        return x
    x = x.withColumn("_h", hash_order(query, index, seed=seed + 1))
    x = S.ranked(x, [query, "part"], [F.col("_h"), F.col(index)], "_rn")
    return x.filter((F.col("part") == "sample") | (F.col("_rn") <= max_extra)).drop("_h", "_rn")


def block_delete(rows: DataFrame, query: str, index: str, fraction: float, n_blocks: int, seed: int = 7) -> DataFrame:
    """Random contiguous blocks of rows removed; the query (first row) is kept."""
    x = S.ranked(rows, [query], [F.col(index)], "_rn", total="_n")
    x = x.withColumn("_i", F.col("_rn") - 1).withColumn("_size", F.floor(F.col("_n") * fraction))
    gone = F.lit(False)
    for b in range(n_blocks):
        start = F.floor(hash_uniform(query, "_blk", seed=seed) * F.col("_n"))
        x = x.withColumn("_blk", F.lit(b)).withColumn("_s", start)
        gone_b = (F.col("_i") >= F.col("_s")) & (F.col("_i") < F.col("_s") + F.col("_size"))
        x = x.withColumn(f"_gone{b}", gone_b)
        gone = gone | F.col(f"_gone{b}")
    kept = x.filter((F.col("_i") == 0) | ~gone)
    return kept.drop("_rn", "_n", "_i", "_size", "_blk", "_s", *[f"_gone{b}" for b in range(n_blocks)])


PLANES = 7  # bits of a letter


def bit_planes(msa: DataFrame, rows: list[str]) -> DataFrame:
    """One row per aligned row: its letters as bit planes, an array of words of 64 columns.

    Plane k holds bit k of every letter; ``letter`` and ``gap`` mark the columns that hold one, ``any`` either."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    marks = {f"p{k}": F.ascii("aa").bitwiseAND(1 << k) != 0 for k in range(PLANES)}
    marks |= {"any": F.lit(True), "gap": F.col("aa") == GAP, "letter": ~F.col("aa").isin(GAP, MASK)}
    known = msa.filter(F.col("aa").isNotNull()).withColumn("_w", F.floor(F.col("pos") / 64).cast("int"))
    words = known.groupBy(*rows, "_w").agg(*[F.bit_or(F.when(m, bit).otherwise(F.lit(0).cast("long"))).alias(n) for n, m in marks.items()])
    return words.groupBy(*rows).agg(F.array_sort(F.collect_list(F.struct("_w", *marks))).alias("words"))


def agreement(a: Column, b: Column, gap_weight: float) -> Column:
    """Columns where the words ``a`` and ``b`` hold the same letter, gaps by weight, masked ones never."""

    def of(x: Column, y: Column) -> Column:
        differ = x["p0"].bitwiseXOR(y["p0"])
        for k in range(1, PLANES):
            differ = differ.bitwiseOR(x[f"p{k}"].bitwiseXOR(y[f"p{k}"]))
        same = F.bitwise_not(differ).bitwiseAND(y["any"])
        return F.bit_count(same.bitwiseAND(x["letter"])) + gap_weight * F.bit_count(same.bitwiseAND(x["gap"]))

    # words that both rows have; usually they have all
    partner = lambda x: F.get(F.filter(b, lambda y: y["_w"] == x["_w"]), 0)
    each = F.transform(a, lambda x: F.coalesce(F.transform(F.array(partner(x)), lambda y: of(x, y))[0], F.lit(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v)


def nearest_cluster(msa: DataFrame, query: str, index: str, gap_weight: float = 0.0) -> DataFrame:
    """Each extra row assigned to the sampled row with most agreeing columns, ties to the first.

    ``msa`` is the long table with ``part`` sample or extra. A row becomes bit planes, and the sampled rows
    of a query, bounded by the sample size, are one array that every extra row is compared with in place.
    """
    planes = bit_planes(msa, [query, index, "part"])
    centres = planes.filter("part = 'sample'").groupBy(query).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("centre"), "words"))).alias("_centres"))
    rows = msa.filter("part = 'extra'").select(query, index).distinct()
    extra = S.null_safe_join(rows, planes.filter("part = 'extra'").drop("part"), [query, index], "left")
    x = S.null_safe_join(extra, centres, [query])
    none = F.array().cast(planes.schema["words"].dataType)
    scores = F.transform("_centres", lambda c: F.struct((-agreement(F.coalesce("words", none), c["words"], gap_weight)).alias("s"), c["centre"].alias("centre")))
    return x.select(query, index, F.array_min(scores)["centre"].alias("centre"))


def cluster_summary(msa: DataFrame, assignment: DataFrame, query: str, index: str) -> DataFrame:
    """Profile and mean deletions per cluster and column, centre included."""
    centre = msa.filter("part = 'sample'").withColumn("centre", F.col(index))
    extra = msa.filter("part = 'extra'").join(assignment, [query, index])
    x = centre.select(query, "centre", "pos", "aa", "n_deleted").unionByName(extra.select(query, "centre", "pos", "aa", "n_deleted"))
    counts = x.groupBy(query, "centre", "pos", "aa").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_deleted").alias("_d"))
    total = counts.groupBy(query, "centre", "pos").agg(F.sum("_n").alias("_t"), F.sum("_d").alias("_dt"))
    out = counts.join(total, [query, "centre", "pos"])
    size = F.col("_t") + 1e-6
    return out.select(query, "centre", "pos", "aa", (F.col("_n") / size).alias("share"), (F.col("_dt") / size).alias("deletion_mean"))


def deletion_features(d: Column) -> tuple[Column, Column]:
    """Deletion flag and squashed deletion count."""
    return F.least(F.greatest(d.cast("double"), F.lit(0.0)), F.lit(1.0)), F.atan(d / 3.0) * (2.0 / F.pi())


def mask(msa: DataFrame, shares: DataFrame, query: str, index: str, replace: float, uniform: float, by_profile: float, same: float, seed: int = 7) -> DataFrame:
    """A fraction of cells replaced by a uniform letter, a profile draw, the same letter or the
    mask token; the true letter and the flag are kept. Draws are seeded per cell."""
    cell = F.array_sort(F.collect_list(F.struct("aa", "share")))  # at most one entry per letter
    draws = shares.groupBy(query, "pos").agg(cell.alias("_p"))
    u1, u2, u3 = (hash_uniform(query, index, "pos", seed=seed + k) for k in range(3))
    x = msa.join(draws, [query, "pos"]).withColumns({"bert_mask": u1 < replace, "_u": u2, "_v": u3})
    letter = F.substring(F.lit(LETTERS), F.floor(F.col("_v") * 20).cast("int") + 1, F.lit(1))
    picked = F.aggregate(
        "_p",
        F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("string").alias("aa"), F.col("_v").alias("v")),
        lambda s, p: F.struct(
            (s["c"] + p["share"]).alias("c"), F.when(s["aa"].isNull() & (s["c"] + p["share"] > s["v"]), p["aa"]).otherwise(s["aa"]).alias("aa"), s["v"].alias("v")
        ),
        lambda s: s["aa"],
    )
    drawn = (
        F.when(F.col("_u") < uniform, letter)
        .when(F.col("_u") < uniform + by_profile, F.coalesce(picked, F.col("aa")))
        .when(F.col("_u") < uniform + by_profile + same, F.col("aa"))
        .otherwise(MASK)
    )
    x = x.withColumn("true_aa", F.col("aa"))
    return x.withColumn("aa", F.when(F.col("bert_mask"), drawn).otherwise(F.col("aa"))).drop("_p", "_u", "_v")


def replace_unknown(msa: DataFrame, query: str, index: str, fraction: float, seed: int = 7) -> DataFrame:
    """A fraction of the letters (not gaps) replaced by the unknown letter."""
    hit = (hash_uniform(query, index, "pos", seed=seed) < fraction) & (F.col("aa") != GAP)
    return msa.withColumn("aa", F.when(hit, UNKNOWN).otherwise(F.col("aa")))


def crop(df: DataFrame, key: str, sequence: str, size: int, seed: int = 7) -> DataFrame:
    """Random contiguous crop of each sequence; shorter ones stay whole."""
    n = F.greatest(F.length(sequence) - size, F.lit(0))
    x = F.floor(hash_uniform(key, seed=seed) * (n + 1))
    start = F.floor(hash_uniform(key, seed=seed + 1) * (n - x + 1))
    return df.withColumn("start", start).withColumn(sequence, F.substring(F.col(sequence), (F.col("start") + 1).cast("int"), F.lit(size)))
