"""Ranking, quantiles and list cells that stay distributed when one key holds most rows.

The common idea: split every key into *cells* by a coarse, order-preserving bucket of the
ordering column. Cell sizes come from a partial aggregate, the running total over the
cells of a key is a window over few pre-aggregated rows, and the fine ordering happens
inside a cell. No task ever sees a whole hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from bindloom.session import written

WHOLE = "_whole"
GROUP_LIMIT = 1000  # spark.sql.optimizer.windowGroupLimitThreshold
SALTS = 256


def coarse(value: Column, steps: int = 1024) -> Column:
    """Order-preserving bucket of a number on a logarithmic scale (``steps`` per doubling).

    NaN is the largest value, as in Spark's order; infinities are beyond all other numbers.
    """
    v = value.cast("double")
    ends = F.when(F.isnan(v), F.lit(1 << 62)).when(v == float("inf"), F.lit((1 << 62) - 1)).when(v == float("-inf"), F.lit(1 - (1 << 62)))
    return ends.otherwise((F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * steps)).cast("long"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null; the keys of the left side are kept."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    out = left.join(renamed, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame as a scalar subquery: no join, no driver round trip."""
    row = one.select(F.struct(*one.columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[c].alias(c) for c in one.columns])


def with_group(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Attach aggregates of the key to every row.

    Partial aggregation plus a join instead of a whole-partition window: the row side of
    the join can be split by the skew handling of adaptive execution, a window cannot.
    """
    if not keys:
        return with_row(df, df.agg(*aggs))
    return null_safe_join(df, df.groupBy(*keys).agg(*aggs), keys)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rn") -> DataFrame:
    """The first ``k`` rows per key. Spark limits each key to ``k`` rows per task *before*
    the shuffle (rank limit push-down), so a hot key sends ``k`` rows per map task.

    Above Spark's limit for that (1000) the key is split by a hash first, so that no task
    ranks more than its share of a hot key.
    """
    if k > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS))
        w = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).drop("_salt", name)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def in_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows in ranges of (keys, order), with ``_range`` and ``_at``, the place among the sorted rows of the range.

    The borders come from a sample of the rows, so a key of any size, and one value of a key too,
    spreads over as many ranges as its rows fill. ``order`` should tell rows apart; equal ones share a range. The
    ranges are written once: all later steps see the same ones.
    """
    cols = [F.col(k) for k in keys]
    x = df.repartitionByRange(*cols, *order).sortWithinPartitions(*cols, *order)
    x = written(x.withColumn("_id", F.monotonically_increasing_id()), "ranges")
    return x.withColumns({"_range": F.shiftright("_id", 33), "_at": F.col("_id") % (1 << 33)}).drop("_id")


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn", total: str | None = None) -> DataFrame:
    """Exact row number of every row inside its key, by the whole ``order``; no limit on the key's size.

    A row's number is its place in its range, counted from the key's first row there, plus the key's rows in
    the ranges before. Only these counts, one per key and range, are added up key by key.
    """
    keys = list(keys)
    rows = in_ranges(df, keys, order)
    counts = rows.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(upto), F.lit(0)) - F.col("_first") + 1
    offsets = counts.select(*keys, "_range", before.alias("_add"), F.sum("_n").over(W.partitionBy(*keys)).alias("_total"))
    x = null_safe_join(rows, offsets, [*keys, "_range"])
    x = x.withColumn(name, F.col("_at") + F.col("_add"))
    x = x.withColumnRenamed("_total", total) if total else x.drop("_total")
    return x.drop("_range", "_at", "_add")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    cell: Column | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per key with linear interpolation, one column per entry of ``probs``.

    Equal values are counted before the first shuffle, the cells that hold a wanted rank
    are found from cell counts, and only their rows are sorted. ``weight`` names the count
    column of rows that are counted already. NaN is a missing value, as null is.
    """
    keys = list(keys)
    whole = not keys
    if whole:
        df, keys = df.withColumn(WHOLE, F.lit(0)), [WHOLE]
    v = F.col("_v")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_n") if weight is None else F.col(weight).alias("_n"))
    rows = rows.filter(v.isNotNull() & ~F.isnan(v))
    hist = rows if weight else rows.groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    hist = hist.withColumn("_c", coarse(v) if cell is None else cell)
    cells = hist.groupBy(*keys, "_c").agg(F.sum("_n").alias("_m"))
    upto = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(
        *keys,
        "_c",
        "_m",
        F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_off"),
        F.sum("_m").over(W.partitionBy(*keys)).alias("_t"),
    )
    pos = {name: F.lit(float(p)) * (F.col("_t") - 1) for name, p in probs.items()}
    ends = [f(h) for h in pos.values() for f in (F.floor, F.ceil)]
    hit = reduce(lambda a, b: a | b, [(F.col("_off") <= e) & (e < F.col("_off") + F.col("_m")) for e in ends])
    rows = null_safe_join(hist, cells.filter(hit), [*keys, "_c"])
    run = F.sum("_n").over(W.partitionBy(*keys, "_c").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_end", F.col("_off") + run).withColumn("_start", F.col("_end") - F.col("_n"))

    def at(rank):
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), v))

    aggs = []
    for name, h in pos.items():
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}")]
        aggs.append(F.max(h - F.floor(h)).alias(f"_fr_{name}"))
    out = rows.groupBy(*keys).agg(*aggs)
    picked = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n) for n in probs
    ]
    return out.select(*([] if whole else keys), *picked)


def joined_cells(df: DataFrame, keys: list[str], values: dict[str, str], sep: str = ";") -> DataFrame:
    """Sorted distinct values of several string columns, joined into one text cell per key.

    Values are made distinct by a partial aggregate before they travel. A key is one row, however
    many values it has (``part`` is 0); a cell is as large as the distinct values of its key.
    """
    fields = F.explode(
        F.array(*[F.struct(F.lit(name).alias("f"), F.col(src).cast("string").alias("v")) for name, src in values.items()])
    )
    long = df.select(*keys, fields.alias("_e")).select(*keys, "_e.f", "_e.v").filter(F.trim("v") != "").distinct()
    cells = [F.array_join(F.sort_array(F.collect_list(F.when(F.col("f") == name, F.col("v")))), sep).alias(name) for name in values]
    return long.groupBy(*keys).agg(F.lit(0).cast("long").alias("part"), *cells)
