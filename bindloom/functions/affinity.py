"""Affinity units, labels and tiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: label cut-offs in nM and in pX, replicate spread limit
TARGET_NM, OFF_TARGET_NM = 31.6, 3160.0
TARGET_PX, OFF_TARGET_PX = 7.5, 5.5
MAX_STD = 0.5


def nm_to_px(nm: Column) -> Column:
    return F.when(nm > 0, -F.log10(nm * 1e-9))


def px_to_nm(px: Column) -> Column:
    return F.pow(F.lit(10.0), -px) / 1e-9


def label_nm(nm: Column) -> Column:
    return F.when(nm <= TARGET_NM, "target").when(nm >= OFF_TARGET_NM, "off_target")


def label_px(px: Column) -> Column:
    return F.when(px >= TARGET_PX, "target").when(px <= OFF_TARGET_PX, "off_target")


def label_delta(delta: Column, gain: float = 1.0, loss: float = -1.0, flat: float | None = 0.3) -> Column:
    """Change of pX of a variant: gain, then no change, then loss, the rest below par.

    With ``flat=None`` everything between loss and gain counts as no change.
    """
    named = F.when(delta >= gain, "target")
    if flat is None:
        return named.when(delta <= loss, "negative").when(delta.isNotNull(), "nochange")
    return named.when(F.abs(delta) < flat, "nochange").when(delta <= loss, "negative").when(delta.isNotNull(), "below_par")


def pick_affinity(**named: Column) -> Column:
    """First filled value in argument order, with its type, as struct(type, value)."""
    options = [
        F.when(value.isNotNull(), F.struct(F.lit(kind).alias("type"), value.alias("value"))) for kind, value in named.items()
    ]
    return F.coalesce(*options)


def bins(c: Column, edges: list[float], names: list[str], right_open: bool = True) -> Column:
    """Name of the first bin whose upper edge lies above the value; the last name takes the rest."""
    out = None
    for edge, name in zip(edges, names):
        hit = c < edge if right_open else c <= edge
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(c.isNotNull(), names[-1])
