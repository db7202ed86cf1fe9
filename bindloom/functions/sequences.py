"""Sequence expressions: mutation labels, substitutions, identity, structure codes."""

from __future__ import annotations

import difflib
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from bindloom.functions.text import SEPARATORS

# fixed values: label grammars. wild type first, position first, chain first
LABEL_WT = r"^([A-Z])(\d+)([A-Z])?$"
LABEL_SITE = r"^(?:([A-Za-z]+):)?([A-Z])?(\d+)([A-Z])?$"
LABEL_ARROW = r"^([A-Z]):(\d+):(?:([A-Z])>)?([A-Z])$"
NAMED_MUTATION = r"^[A-Z]\d+[A-Z]$"


def chars(c: Column) -> Column:
    """Array of characters; the empty string gives an empty array."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))


def mutations_in_name(name: Column) -> Column:
    """Substitution tokens inside square brackets of a name."""
    blocks = F.regexp_extract_all(name, F.lit(r"\[([^\]]+)\]"), 1)
    tokens = F.flatten(F.transform(blocks, lambda b: F.split(F.trim(b), r"[,\s]+")))
    return F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.rlike(NAMED_MUTATION))


def parse_label(label: Column) -> Column:
    """Mutation label as struct(chain, wt, pos, mut): ``E199V``, ``A:199V``, ``A:E199V``, ``A:199:E>V``."""
    s = F.regexp_replace(F.trim(label), r"\s+", "")

    def part(pattern, i):
        x = F.regexp_extract(s, pattern, i)
        return F.when(x != "", x)

    def parsed(pattern, chain, wt, pos, mut):
        none = F.lit(None).cast("string")
        return F.when(
            s.rlike(pattern),
            F.struct(
                (part(pattern, chain) if chain else none).alias("chain"),
                (part(pattern, wt) if wt else none).alias("wt"),
                part(pattern, pos).cast("int").alias("pos"),
                F.upper(part(pattern, mut)).alias("mut"),
            ),
        )

    return F.coalesce(
        parsed(LABEL_WT, None, 1, 2, 3), parsed(LABEL_ARROW, 1, 3, 2, 4), parsed(LABEL_SITE, 1, 2, 3, 4)
    )


def substitutions(reference: Column, variant: Column) -> Column:
    """Substitution labels of two sequences of equal length; null on unequal length or gaps (indel)."""
    ref, var = chars(reference), chars(variant)
    pairs = F.filter(
        F.transform(F.arrays_zip(ref.alias("r"), var.alias("v")), lambda p, i: F.struct(p["r"].alias("r"), p["v"].alias("v"), (i + 1).alias("i"))),
        lambda p: p["r"] != p["v"],
    )
    labels = F.transform(pairs, lambda p: F.concat(p["r"], p["i"].cast("string"), p["v"]))
    gapped = F.exists(pairs, lambda p: (p["r"] == "-") | (p["v"] == "-"))
    return F.when((F.length(reference) == F.length(variant)) & ~gapped, labels)


class LetterMatcher(difflib.SequenceMatcher):
    """The matcher on two texts, without its rule for popular letters; same blocks, found by text search."""

    def find_longest_match(self, alo=0, ahi=None, blo=0, bhi=None):
        a, b = self.a[:ahi], self.b[blo:bhi]
        at, size = alo, 0
        for i in range(alo, len(a)):
            if i + size >= len(a):
                break
            while i + size < len(a) and a[i : i + size + 1] in b:  # longer than the best so far
                at, size = i, size + 1
        return difflib.Match(at, blo + b.index(a[at : at + size]), size)


def describe_edit(reference: str, variant: str) -> tuple[str, int, int, int]:
    """Edits that turn the reference into the variant: text and counts (subs, ins, dels).

    Common ends are trimmed first, so one edit in a long sequence stays one edit; what is left is
    aligned without the matcher's rule for popular letters, which fits no alphabet of twenty.
    """
    notes: list[str] = []
    subs = ins = dels = 0
    head = len(os.path.commonprefix([reference, variant]))
    tail = len(os.path.commonprefix([reference[head:][::-1], variant[head:][::-1]]))
    a, b = reference[head : len(reference) - tail], variant[head : len(variant) - tail]
    for kind, a0, a1, b0, b1 in LetterMatcher(a=a, b=b, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        a0, a1, b0, b1 = a0 + head, a1 + head, b0 + head, b1 + head
        both = min(a1 - a0, b1 - b0)
        changed = [f"{reference[a0 + k]}{a0 + k + 1}{variant[b0 + k]}" for k in range(both) if reference[a0 + k] != variant[b0 + k]]
        lost, gained = a1 - a0 - both, variant[b0 + both : b1]
        notes += changed
        if lost:
            notes.append(f"del{a0 + both + 1}" + (f"-{a1}" if lost > 1 else ""))
        if gained:
            notes.append(f"ins{a0 + both}:{gained}")
        subs, ins, dels = subs + len(changed), ins + len(gained), dels + lost
    return "; ".join(notes), subs, ins, dels


EDITS = T.StructType(
    [T.StructField("diffs", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("n_subs", "n_ins", "n_del")]]
)


@F.pandas_udf(EDITS)
def aligned_edits(reference: pd.Series, variant: pd.Series) -> pd.DataFrame:
    rows = [describe_edit(r, v) if r is not None and v is not None else (None,) * 4 for r, v in zip(reference, variant)]
    return pd.DataFrame(rows, columns=["diffs", "n_subs", "n_ins", "n_del"])


def align_variants(df: DataFrame, reference: str, variant: str) -> DataFrame:
    """Alignment edits for sequences of any length, computed once per distinct pair."""
    pairs = df.select(reference, variant).distinct()
    done = pairs.withColumn("_e", aligned_edits(reference, variant)).select(reference, variant, "_e.*")
    return df.join(done, [reference, variant], "left")


def het_code(c: Column) -> Column:
    """Ligand code: 1–3 upper-case letters or digits, not digits alone."""
    s = F.upper(F.trim(c))
    return F.when(s.rlike("^[A-Z0-9]{1,3}$") & ~s.rlike("^[0-9]+$"), s)


def structure_code_pairs(ids: Column, het: Column) -> Column:
    """``1ABC:XYZ;2DEF:XYZ`` from a list of four-letter structure ids and a ligand code."""
    tokens = F.filter(F.transform(F.split(ids, r"[;,\s]+"), lambda x: F.upper(x)), lambda x: F.length(x) == 4)
    code = het_code(het)
    cell = F.array_join(F.transform(F.array_sort(F.array_distinct(tokens)), lambda x: F.concat(x, F.lit(":"), code)), ";")
    return F.when(code.isNotNull() & (F.size(tokens) > 0), cell)


def code_map(c: Column) -> Column:
    """``PDB:HET`` tokens as a map; codes are cut to three letters, the last entry of an id wins."""
    tokens = F.filter(F.split(F.upper(F.trim(c)), SEPARATORS), lambda t: t.rlike("^[^:]+:.+"))
    entries = F.transform(
        tokens,
        lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.substring(F.regexp_replace(t, "^[^:]+:", ""), 1, 3).alias("v")),
    )
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, last)


def identity(a: Column, b: Column, mask: Column | None = None) -> Column:
    """Share of equal characters on the common prefix length, over positions whose mask is 1."""
    n = F.least(F.length(a), F.length(b))
    # the mask travels inside the zipped cells: lambdas must not hold array expressions of their own
    columns = [chars(a).alias("a"), chars(b).alias("b")] + ([] if mask is None else [mask.alias("m")])
    pairs = F.slice(F.arrays_zip(*columns), 1, F.greatest(n, F.lit(1)))
    if mask is not None:
        pairs = F.filter(pairs, lambda p: p["m"] == 1)
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when((n > 0) & (F.size(pairs) > 0), same / F.size(pairs))
