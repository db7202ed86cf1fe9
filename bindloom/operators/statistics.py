"""Statistics over ligand pairs: cliffs, quantile bins, correlations, tests, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.functions import stats as P
from bindloom.plans import skew as S

# fixed values: an activity cliff is a similar pair with a tenfold difference
CLIFF_SIMILARITY, CLIFF_DELTA = 0.7, 1.0
TERTILE_NAMES = ["Low", "Mid", "High"]


def is_cliff(similarity: Column, delta: Column) -> Column:
    return (similarity >= CLIFF_SIMILARITY) & (delta >= CLIFF_DELTA)


def cliff_rate(df: DataFrame, similarity: str, delta: str, by: str) -> DataFrame:
    """Cliffs and their share per protein, with an overall row where the protein is ALL."""
    x = df.select(F.col(by), is_cliff(F.col(similarity), F.col(delta)).alias("_c"))
    counts = x.groupBy(by).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("_c").alias("n_cliffs"))
    total = counts.agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_cliffs").alias("n_cliffs")).select(F.lit("ALL").alias(by), "*")
    return counts.unionByName(total).withColumn("cliff_rate", F.col("n_cliffs") / F.col("n_pairs"))


def bin_of(value: Column, edges: Column) -> Column:
    """Right-closed bin number from 1, given an array of inner edges."""
    return (F.size(F.filter(edges, lambda e: e < value)) + 1).cast("long")


def quantile_bins(df: DataFrame, value: str, q: int, out: str) -> DataFrame:
    """Bin by exact quantile edges; the edges are one row."""
    edges = S.exact_quantiles(df, [], value, {f"e{i}": i / q for i in range(1, q)})
    row = edges.select(F.array(*[f"e{i}" for i in range(1, q)]).alias("_edges"))
    return S.with_row(df, row).withColumn(out, bin_of(F.col(value), F.col("_edges"))).drop("_edges")


def bin_profile(df: DataFrame, bin_column: str, value: str) -> DataFrame:
    return df.groupBy(bin_column).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count")
    )


def equal_width_bins(df: DataFrame, value: str, n: int, out: str) -> DataFrame:
    """``n`` bins of equal width between minimum and maximum, right-closed; the lowest edge is included."""
    lim = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / n
    inner = F.array(*[F.col("_lo") + step * i for i in range(1, n)])
    x = S.with_row(df, lim)
    return x.withColumn(out, F.when(F.col(value).isNotNull(), bin_of(F.col(value), inner))).drop("_lo", "_hi")


def group_tertiles(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Tertile name within the protein; repeated edges merge bins, names are taken from the top."""
    edges = S.exact_quantiles(df, [by], value, {f"e{i}": i / 3 for i in range(4)})
    cell = F.array_distinct(F.array(*[f"e{i}" for i in range(4)]))
    x = df.join(edges.select(by, cell.alias("_edges")), by, "left")
    n_bins = F.size("_edges") - 1
    inner = F.slice(F.col("_edges"), 2, F.greatest(n_bins - 1, F.lit(0)))
    name = F.element_at(F.array(*[F.lit(t) for t in TERTILE_NAMES]), (bin_of(F.col(value), inner) + 3 - n_bins).cast("int"))
    return x.withColumn(out, F.when(n_bins > 0, name)).drop("_edges")


def rank_table(df: DataFrame, by: list[str], value: str, out: str, weight: str) -> DataFrame:
    """Average rank (ties share the mean) of every value within its key, from counted rows."""
    hist = df.groupBy(*by, value).agg(F.sum(weight).alias("_n")).withColumn("_c", S.coarse(F.col(value)))
    upto = W.partitionBy(*by).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    cells = hist.groupBy(*by, "_c").agg(F.sum("_n").alias("_m"))
    cells = cells.select(*by, "_c", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_off"))
    inner = F.sum("_n").over(W.partitionBy(*by, "_c").orderBy(value))
    rank = F.col("_off") + inner - F.col("_n") + (F.col("_n") + 1) / 2
    return hist.join(cells, [*by, "_c"]).select(*by, value, rank.alias(out))


def known(value: str) -> Column:
    """Neither null nor NaN: both are missing values here."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    r = df.filter(known(x) & known(y)).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("p", P.correlation_p("r", "n"))


def spearman(df: DataFrame, by: str, x: str, y: str, min_pairs: int = 20) -> DataFrame:
    """Rank correlation per protein with at least ``min_pairs`` pairs."""
    d = df.filter(known(x) & known(y)).select(by, x, y)
    # equal pairs are counted once; both rank tables come from those counts
    pairs = d.groupBy(by, x, y).agg(F.count(F.lit(1)).alias("_w"))
    ranked = pairs.join(rank_table(pairs, [by], x, "_rx", "_w"), [by, x]).join(rank_table(pairs, [by], y, "_ry", "_w"), [by, y])
    # weighted correlation around the mean rank, which is known from the number of pairs
    n = F.sum("_w")
    s = lambda a, b: F.sum(F.col("_w") * F.col(a) * F.col(b))
    sums = ranked.groupBy(by).agg(n.alias("n_pairs"), s("_rx", "_rx").alias("_xx"), s("_ry", "_ry").alias("_yy"), s("_rx", "_ry").alias("_xy"))
    shift = F.col("n_pairs") * F.pow((F.col("n_pairs") + 1) / 2.0, F.lit(2.0))
    cov = F.col("_xy") - shift
    rho = F.try_divide(cov, F.sqrt((F.col("_xx") - shift) * (F.col("_yy") - shift)))
    rho = sums.filter(F.col("n_pairs") >= min_pairs).select(by, rho.alias("rho"), "n_pairs")
    return rho.withColumn("p", P.correlation_p("rho", "n_pairs"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence test on the table of two binned columns (few cells, all pre-aggregated)."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    # windows over the pre-aggregated cells: at most bins × bins rows
    x = cells.select(
        a,
        b,
        "n",
        F.sum("n").over(W.partitionBy(a)).alias("_ra"),
        F.sum("n").over(W.partitionBy(b)).alias("_cb"),
        F.sum("n").over(W.partitionBy(F.lit(0))).alias("_t"),
    )
    # sum of (o - e)²/e over all cells equals sum of o²/e over the filled cells minus the total
    dof = (F.count_distinct(a) - 1) * (F.count_distinct(b) - 1)
    o2e = F.col("n") * F.col("n") / (F.col("_ra") * F.col("_cb") / F.col("_t"))
    out = x.agg((F.sum(o2e) - F.max("_t")).alias("chi2"), dof.alias("dof"))
    return out.withColumn("p", P.chi2_p("chi2", "dof"))


def mann_whitney(df: DataFrame, value: str, in_first: Column) -> DataFrame:
    """U statistic of the first group, tie-corrected normal p; built from counts per value."""
    hist = (
        df.filter(known(value))
        .groupBy(value)
        .agg(F.count_if(in_first).alias("_a"), F.count_if(~in_first).alias("_b"))
        .withColumn("_c", S.coarse(F.col(value)))
        .withColumn("_g", F.lit(0))
    )
    cells = hist.groupBy("_g", "_c").agg(F.sum("_b").alias("_m"))
    upto = W.partitionBy("_g").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("_c", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_off"))
    below = F.col("_off") + F.sum("_b").over(W.partitionBy("_c").orderBy(value)) - F.col("_b")
    t = (F.col("_a") + F.col("_b")).cast("double")
    x = hist.join(cells, "_c").withColumn("_below", below)
    out = x.agg(
        F.sum(F.col("_a") * (F.col("_below") + F.col("_b") / 2)).alias("u"),
        F.sum("_a").alias("n_a"),
        F.sum("_b").alias("n_b"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n = (F.col("n_a") + F.col("n_b")).cast("double")
    ab = F.col("n_a").cast("double") * F.col("n_b")
    sd = F.sqrt(ab / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - ab / 2) - 0.5) / sd
    return out.withColumn("z", z).withColumn("p", P.normal_p("z")).drop("_ties")


def summary(df: DataFrame, by: str, similarity: str, delta: str) -> DataFrame:
    """One row per figure: totals, means, medians, cliff rate, median rank correlation, significant share."""
    s, d = F.col(similarity), F.col(delta)
    base = df.agg(
        F.count(F.lit(1)).cast("double").alias("pairs"),
        F.count_distinct(by).cast("double").alias("proteins"),
        F.avg(s).alias("mean_similarity"),
        F.avg(d).alias("mean_delta"),
        F.count_if(is_cliff(s, d)).cast("double").alias("cliffs"),
        (F.count_if(is_cliff(s, d)) / F.count(F.lit(1)) * 100).alias("cliff_rate_percent"),
    )
    m1 = S.exact_quantiles(df, [], similarity, {"median_similarity": 0.5})
    m2 = S.exact_quantiles(df, [], delta, {"median_delta": 0.5})
    rho = spearman(df, by, similarity, delta)
    m3 = S.exact_quantiles(rho, [], "rho", {"median_rho": 0.5})
    sig = rho.agg((F.count_if(F.col("p") < 0.05) / F.count(F.lit(1))).alias("significant_share"))
    wide = base
    for one in (m1, m2, m3, sig):
        wide = S.with_row(wide, one)
    return wide.unpivot([], wide.columns, "figure", "value")
