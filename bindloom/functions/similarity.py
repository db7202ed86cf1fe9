"""Fingerprint and feature similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: weights of the composite similarity
WEIGHTS = {"2d": 0.4, "scaffold": 0.3, "physchem": 0.3}


def pack_bits(bits: Column, n_words: int) -> Column:
    """On-bits as an array of 64-bit words."""
    def word(i):
        own = F.filter(F.array_distinct(bits), lambda b: F.floor(b / 64) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))

    return F.array(*[word(i) for i in range(n_words)])


def tanimoto(a: Column, b: Column) -> Column:
    """Tanimoto of two word arrays; 0 when both are empty."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, n: s + n)
    either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y))), F.lit(0), lambda s, n: s + n)
    return F.when(either > 0, both / either).otherwise(0.0)


def tanimoto_sets(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.size(F.array_intersect(a, b)) / either).otherwise(0.0)


def scaffold(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False)).cast("double")


def physchem(a: list[Column], b: list[Column]) -> Column:
    """exp(-distance) after scaling over the two rows: every differing property adds 4 to the squared distance."""
    k = sum((F.when(x != y, 1).otherwise(0) for x, y in zip(a, b)), F.lit(0))
    return F.exp(-2 * F.sqrt(k.cast("double")))


def composite(**parts: Column) -> Column:
    """Weighted mean over the chosen methods (``d2`` stands for the 2-D fingerprint)."""
    names = {"d2": "2d"}
    weight = {n: WEIGHTS[names.get(n, n)] for n in parts}
    total = sum(weight.values())
    return sum((F.lit(weight[n] / total) * v for n, v in parts.items()), F.lit(0.0))


def set_similarity(a: Column, b: Column) -> Column:
    """Set similarity of interaction lists: both empty 1, one empty 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        tanimoto_sets(a, b)
    )
