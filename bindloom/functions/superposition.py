"""RMSD after optimal superposition in column expressions.

The largest eigenvalue of the 4 x 4 key matrix of two centred coordinate sets is the largest root of a
polynomial of degree four, found by Newton steps from above; no rotation is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AXES = "xyz"
STEPS = 50  # quadratic convergence needs about ten, a double root gains one bit a step


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def centred(coords: Column) -> Column:
    """Coordinates x1, y1, z1, x2, … as a struct of centred axes with their squared norm ``g`` and the number of atoms ``n``.

    Null for a null or empty list, one that is no multiple of three long, and one with a null or NaN in it."""
    n = F.size(coords) / 3

    def moved(k: int) -> Column:
        axis = F.filter(coords, lambda v, i: i % 3 == k)
        return _let(_sum(axis) / n, lambda mean: F.transform(axis, lambda v: v - mean))

    known = ~F.exists(coords, lambda v: v.isNull() | F.isnan(v))
    whole = (F.size(coords) > 0) & (F.size(coords) % 3 == 0) & known
    out = _let(F.struct(*[moved(k).alias(x) for k, x in enumerate(AXES)]), lambda s: F.struct(
        *[s[x].alias(x) for x in AXES], (_dot(s["x"], s["x"]) + _dot(s["y"], s["y"]) + _dot(s["z"], s["z"])).alias("g"), n.cast("int").alias("n")
    ))
    return F.when(whole, out)


def _largest_root(s: Column, start: Column) -> Column:
    """Largest eigenvalue of the key matrix of the sums ``s`` (xx, xy, … of the products of both sides)."""
    xx, xy, xz, yx, yy, yz, zx, zy, zz = (s[a + b] for a in AXES for b in AXES)
    square = sum((s[a + b] * s[a + b] for a in AXES for b in AXES), F.lit(0.0))
    det = xx * (yy * zz - yz * zy) - xy * (yx * zz - yz * zx) + xz * (yx * zy - yy * zx)
    # the symmetric key matrix, row by row from the diagonal on
    key = F.struct(
        (xx + yy + zz).alias("a"), (yz - zy).alias("b"), (zx - xz).alias("c"), (xy - yx).alias("d"),
        (xx - yy - zz).alias("e"), (xy + yx).alias("f"), (zx + xz).alias("g"),
        (-xx + yy - zz).alias("h"), (yz + zy).alias("i"), (-xx - yy + zz).alias("j"),
    )

    def determinant(k: Column) -> Column:
        a, b, c, d, e, f, g, h, i, j = (k[x] for x in "abcdefghij")
        # minors of the two upper rows, each next to that of the other columns of the two lower rows
        minors = [
            (a * e - b * b, h * j - i * i), (c * b - a * f, f * j - i * g), (a * g - d * b, f * i - h * g),
            (b * f - c * e, c * j - i * d), (d * e - b * g, c * i - h * d), (c * g - d * f, c * g - f * d),
        ]
        return sum((upper * lower for upper, lower in minors), F.lit(0.0))

    def root(q: Column) -> Column:
        def step(x: Column, _: Column) -> Column:
            value = ((x * x + q["p2"]) * x + q["p1"]) * x + q["p0"]
            slope = (4 * x * x + 2 * q["p2"]) * x + q["p1"]
            return F.when(slope > 0, x - value / slope).otherwise(x)

        return F.aggregate(F.array_repeat(F.lit(0), STEPS), start, step)

    return _let(F.struct((-2 * square).alias("p2"), (-8 * det).alias("p1"), _let(key, determinant).alias("p0")), root)


def superposed_rmsd(a: Column, b: Column) -> Column:
    """RMSD of two ``centred`` sets after the best rotation (no reflection); null if either is null or their sizes differ."""
    sums = F.struct(*[_dot(a[u], b[v]).alias(u + v) for u in AXES for v in AXES])
    middle = (a["g"] + b["g"]) / 2
    rmsd = _let(sums, lambda s: F.sqrt(F.greatest((middle - _largest_root(s, middle)) * 2 / a["n"], F.lit(0.0))))
    return F.when(a["n"] == b["n"], rmsd)
