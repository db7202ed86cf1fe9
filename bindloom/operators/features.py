"""Per-ligand features: one computation per distinct key, median fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from bindloom.plans import skew as S


def featurize_distinct(df: DataFrame, key: str, compute: Callable[[Column], Column]) -> DataFrame:
    """Struct column ``features`` computed once per distinct key; ``failed`` marks null results.

    ``compute`` turns the key column into a struct, usually with a pandas_udf of the user.
    """
    distinct = df.select(key).distinct().withColumn("features", compute(F.col(key)))
    return df.join(distinct, key, "left").withColumn("failed", F.col("features").isNull())


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls replaced by the exact median of the column."""
    out = df
    for name in columns:
        median = S.exact_quantiles(df, [], name, {"_median": 0.5})
        out = S.with_row(out, median)
        out = out.withColumn(name, F.coalesce(F.col(name), F.col("_median"))).drop("_median")
    return out
