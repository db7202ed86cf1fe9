"""Distance joins on coordinates: equi-joins on grid cells, never a join on the structure alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.plans import skew as S
from bindloom.session import written

AXES = ("x", "y", "z")
CELL = [f"_c{axis}" for axis in AXES]
EXPONENTS = range(-3, 13)  # the finest grid of a structure has an edge of 2^e; coarser ones follow as far as needed
c = F.col


def _cells(radius: float, shift: bool):
    """Cell numbers per axis; with ``shift`` the cell and its two neighbours."""
    base = {a: F.floor(F.col(a) / radius).cast("long") for a in AXES}
    return {a: F.array(b - 1, b, b + 1) for a, b in base.items()} if shift else base


def _d2() -> Column:
    return sum(((c(v) - c(f"r_{v}")) * (c(v) - c(f"r_{v}")) for v in AXES), F.lit(0.0))


def within_radius(left: DataFrame, right: DataFrame, by: list[str], radius: float) -> DataFrame:
    """All (left, right) rows of the same ``by`` keys at most ``radius`` apart.

    Right columns get the prefix ``r_``; ``d2`` is the squared distance. The left rows (the
    smaller side) visit 27 cells, so the join key is (keys, cell): a large structure
    spreads over as many keys as it has occupied cells.
    """
    a = left
    for axis, cells in _cells(radius, True).items():
        a = a.withColumn(f"_c{axis}", F.explode(cells))
    keyed = right.withColumns({f"_c{axis}": cell for axis, cell in _cells(radius, False).items()})
    b = keyed.select(*by, *CELL, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    joined = a.join(b, [*by, *CELL]).drop(*CELL)
    return joined.withColumn("d2", _d2()).filter(F.col("d2") <= radius * radius)


def located(df: DataFrame) -> DataFrame:
    """Rows with three finite coordinates."""
    known = [c(v).isNotNull() & ~F.isnan(v) & (F.abs(c(v)) < float("inf")) for v in AXES]
    return df.filter(known[0] & known[1] & known[2])


def _edge(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def _cell_at(e: Column) -> dict[str, Column]:
    return {f"_c{v}": F.floor(c(v) / _edge(e)).cast("long") for v in AXES}


def _around(df: DataFrame) -> DataFrame:
    """One row per cell of the 27 around (and with) the row's own."""
    for v in CELL:
        df = df.withColumn(v, F.explode(F.array(c(v) - 1, c(v), c(v) + 1)))
    return df


def grid_levels(right: DataFrame, by: list[str], k: int) -> DataFrame:
    """Per structure: points (``_n``), their box, the finest level ``_e0`` that is worth while and the level ``_top`` of the box.

    The finest level is the coarsest one whose occupied cells hold ``k`` points on average, from
    estimated numbers of occupied cells, so that neither empty space nor one far point makes cells crowded.
    """
    hashed = {e: F.xxhash64(*[F.floor(c(v) / 2.0**e).cast("long") for v in AXES]) for e in EXPONENTS}
    ends = [f(v).alias(f"_{name}{v}") for v in AXES for name, f in (("lo", F.min), ("hi", F.max))]
    x = right.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *ends, *[F.approx_count_distinct(h, 0.1).alias(f"_m{i}") for i, h in enumerate(hashed.values())])
    fine = [F.when(c("_n") <= c(f"_m{i}") * k, F.lit(e)) for i, e in reversed(list(enumerate(EXPONENTS)))]
    extent = F.greatest(*[c(f"_hi{v}") - c(f"_lo{v}") for v in AXES], F.lit(2.0 ** EXPONENTS[0]))
    e0 = F.coalesce(*fine, F.lit(EXPONENTS[0]))
    top = F.greatest(e0, F.ceil(F.log2(extent)).cast("int"))
    return x.select(*by, "_n", *[f"_{end}{v}" for v in AXES for end in ("lo", "hi")], e0.alias("_e0"), top.alias("_top"))


def _search_levels(left: DataFrame, right: DataFrame, by: list[str], levels: DataFrame, k: int) -> DataFrame:
    """Left rows with ``_want`` partners to find and the level ``_e`` at which the 27 cells around hold as many.

    ``_far`` rows lie so far out that only a level with all points around will do."""
    box = levels.select(*by, "_e0", "_top")
    finest = right.select(*by, *AXES).join(box, by).select(*by, "_e0", "_top", *[e.alias(v) for v, e in _cell_at(c("_e0")).items()])
    finest = finest.groupBy(*by, "_e0", "_top", *CELL).agg(F.count(F.lit(1)).alias("_k"))

    def coarser(df):
        up = df.withColumn("_e", F.explode(F.sequence("_e0", "_top")))
        return up.withColumns({v: F.call_function("shiftright", c(v), c("_e") - c("_e0")) for v in CELL})

    held = coarser(finest).groupBy(*by, "_e", *CELL).agg(F.sum("_k").alias("_k"))
    around = _around(held).groupBy(*by, "_e", *CELL).agg(F.sum("_k").alias("_k"))
    x = left.join(levels, by).withColumns(_cell_at(c("_e0"))).withColumn("_want", F.least(c("_n"), F.lit(k)))
    asked = x.select(*by, "_e0", "_top", "_want", *[c(v).alias(f"_0{v}") for v in CELL]).distinct()
    asked = coarser(asked.withColumns({v: c(f"_0{v}") for v in CELL})).join(around, [*by, "_e", *CELL]).filter("_k >= _want")
    best = asked.groupBy(*by, *[f"_0{v}" for v in CELL]).agg(F.min("_e").alias("_e")).withColumnsRenamed({f"_0{v}": v for v in CELL})
    x = x.join(best, [*by, *CELL], "left")
    away = F.greatest(*[F.greatest(F.abs(c(v) - c(f"_lo{v}")), F.abs(c(f"_hi{v}") - c(v))) for v in AXES], F.lit(2.0 ** EXPONENTS[0]))
    x = x.withColumn("_far", c("_e").isNull()).withColumn("_e", F.coalesce("_e", _level_of(away)))
    return x.drop(*CELL, "_n", "_e0", "_top", *[f"_{end}{v}" for v in AXES for end in ("lo", "hi")])


def _level_of(radius: Column) -> Column:
    """The least level whose edge is at least the radius."""
    return F.ceil(F.log2(radius * 1.000001)).cast("int")


def _partners(x: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``x`` with all right rows in the 27 cells around them, at the row's level ``_e``."""
    used = x.groupBy(*by).agg(F.collect_set("_e").alias("_e"))  # a structure has some tens of levels at most
    points = right.join(used, by).withColumn("_e", F.explode("_e")).withColumns(_cell_at(c("_e")))
    points = points.select(*by, "_e", *CELL, *[c(n).alias(f"r_{n}") for n in right.columns if n not in by])
    return _around(x.withColumns(_cell_at(c("_e")))).join(points, [*by, "_e", *CELL]).drop(*CELL).withColumn("d2", _d2())


def k_nearest(left: DataFrame, right: DataFrame, by: list[str], key: list[str], tie: str, k: int) -> DataFrame:
    """The ``k`` nearest right rows of every left row, exactly, with ``rank`` from 1; ties to the smaller ``tie``.

    Every structure has grids of doubling cell edges, the finest one fitted to its density. A left row first
    searches the 27 cells at the finest level that holds ``k`` points there. What it finds is final if
    the k-th distance does not reach beyond these cells; if it does, one more search at the level of
    that distance is. Rows without three finite coordinates take no part; left rows without partners
    have no result.
    """
    left, right = located(left), located(right)
    x = written(_search_levels(left, right, by, grid_levels(right, by, k), k), "grid-levels")
    order = [c("d2"), c(f"r_{tie}")]
    found = S.top_k(_partners(x, right, by), [*by, *key], order, k, "rank")
    s = _edge(c("_e"))
    margin = F.least(*[F.least(c(v) - (cell - 1) * s, (cell + 2) * s - c(v)) for v, cell in zip(AXES, _cell_at(c("_e")).values())])
    found = written(found.withColumn("_safe", F.when(c("_far"), float("inf")).otherwise(margin)), "grid-first")
    last = found.filter("rank = _want").select(*by, *key, c("d2").alias("_reach"), (c("d2") <= c("_safe") * c("_safe")).alias("_done"))
    final = found.join(last.filter("_done").select(*by, *key), [*by, *key], "left_semi").drop("_safe")
    again = x.join(last.filter("NOT _done").drop("_done"), [*by, *key]).withColumn("_e", _level_of(F.sqrt("_reach")))
    more = _partners(again, right, by).filter("d2 <= _reach").drop("_reach")
    final = final.unionByName(S.top_k(more, [*by, *key], order, k, "rank"))
    return final.select(*left.columns, *[f"r_{n}" for n in right.columns if n not in by], "d2", "rank")
