"""Text, key and number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SEPARATORS = r"[;,\s]+"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def clean_text(c: Column) -> Column:
    """Collapse white space, null becomes the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def clean_sequence(c: Column) -> Column:
    return F.upper(F.coalesce(F.regexp_replace(c, r"\s+", ""), F.lit("")))


def first_filled(*cols: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in cols])


def identity_key(candidates: list[Column], group: Column, default: str, group_default: str, sep: str = " | ") -> Column:
    """First filled candidate and group (organism), each with a constant as last resort."""
    name = F.coalesce(*[blank_to_null(clean_text(c)) for c in candidates], F.lit(default))
    return F.concat_ws(sep, name, F.coalesce(blank_to_null(clean_text(group)), F.lit(group_default)))


def strict_key(name: Column, group: Column, sep: str = "_") -> Column:
    """Both parts joined, null when one of them is missing."""
    return F.concat(blank_to_null(name), F.lit(sep), blank_to_null(group))


def split_ids(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), SEPARATORS), lambda x: F.upper(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def numbers_in(c: Column) -> Column:
    """Positive numbers of a cell: tokens split on separators, one leading < or > dropped."""
    tokens = F.split(F.trim(c), SEPARATORS)
    values = F.transform(tokens, lambda t: F.regexp_replace(t, "^[<>]", "").try_cast("double"))
    return F.filter(F.coalesce(values, F.array().cast("array<double>")), lambda v: (v > 0) & ~F.isnan(v))


def first_number(c: Column) -> Column:
    found = F.regexp_extract(c, r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", 1)
    return F.when(found != "", found.try_cast("double"))


def single_chain(c: Column) -> Column:
    """True when the first digits of the cell are at most 1, or there are none."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(1)) <= 1


def same_id_set(a: Column, b: Column, is_reference: Column) -> Column:
    """Two id lists hold the same ids; null for reference rows and where the list of the reference is empty."""
    left, right = F.array_sort(F.array_distinct(split_ids(a))), F.array_sort(F.array_distinct(split_ids(b)))
    return F.when(is_reference | (F.size(right) == 0), F.lit(None).cast("boolean")).otherwise(left == right)
