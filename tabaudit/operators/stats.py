"""Grouped counts, shares and distances that the audits are built from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.order_stats import complement_quantiles, group_quantiles, value_edges, with_total

MIN_TABLE_ROW = 20


def null_rates(df: DataFrame, slicer: str, target: str) -> DataFrame:
    """Rows and null share of ``target`` per level."""
    return df.filter(F.col(slicer).isNotNull()).groupBy(F.col(slicer).cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(target).isNull().cast("double")).alias("null_rate"))


def crosstab_shares(df: DataFrame, slicer: str, target: str, min_row: int = MIN_TABLE_ROW) -> DataFrame:
    """Row-normalised contingency table in long form; levels with fewer than ``min_row`` rows are dropped."""
    counts = df.filter(F.col(slicer).isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col(slicer).cast("string").alias("level"), F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("level").agg(F.sum("n").alias("n_level")).filter(F.col("n_level") >= min_row)
    return counts.join(total, "level").select("level", "value", "n", "n_level", (F.col("n") / F.col("n_level")).alias("share"))


def stratum_medians(df: DataFrame, slicer: str, stratum: str, target: str) -> DataFrame:
    """Median and size of ``target`` per (level, stratum)."""
    rows = df.select(F.col(slicer).cast("string").alias("level"), F.col(stratum).cast("string").alias("stratum"),
                     F.col(target).cast("double").alias("x")).filter("level is not null and stratum is not null")
    return group_quantiles(rows, ["level", "stratum"], {"median": 0.5})


def complement_medians(df: DataFrame, slicer: str, target: str) -> DataFrame:
    """Median of every level and of all other levels, without another pass per level."""
    rows = df.select(F.col(slicer).cast("string").alias("level"), F.col(target).cast("double").alias("x")).filter("level is not null")
    edges = value_edges(rows, ["x"])["x"]
    own = group_quantiles(rows, ["level"], {"median": 0.5}, edges=edges).select("level", F.lit("own").alias("side"), "n", "median")
    rest = complement_quantiles(rows.withColumn("_all", F.lit(1)), ["_all"], ["level"], {"median": 0.5}, edges=edges)
    return own.unionByName(rest.select("level", F.lit("rest").alias("side"), "n", "median"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among the non-null rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return with_total(counts, "n", "_t").select("value", "n", (F.col("n") / F.col("_t")).alias("share"))


def tv_distance(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "value", share: str = "share") -> DataFrame:
    """Total variation distance of two category mixes per key, over the union of their categories."""
    keys = list(keys)
    both = a.select(*keys, value, F.col(share).alias("_a")).join(b.select(*keys, value, F.col(share).alias("_b")), [*keys, value], "full")
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return both.groupBy(*keys).agg((F.sum(gap) * 0.5).alias("tv"))


def tv_vs_rest(df: DataFrame, slicer: str, target: str) -> DataFrame:
    """Total variation between each level's mix and the mix of all other levels."""
    counts = df.filter(F.col(slicer).isNotNull() & F.col(target).isNotNull()).groupBy(
        F.col(slicer).cast("string").alias("level"), F.col(target).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("level").agg(F.sum("n").alias("n_level"))
    totals = counts.groupBy("value").agg(F.sum("n").alias("n_value"))
    j = counts.join(sizes, "level").join(totals, "value")
    rest_size = with_total(sizes, "n_level", "n_all").select("level", (F.col("n_all") - F.col("n_level")).alias("n_rest"))
    j = j.join(rest_size, "level")
    gap = F.abs(F.col("n") / F.col("n_level") - (F.col("n_value") - F.col("n")) / F.col("n_rest"))
    # a value the level lacks differs by its whole share in the rest: rows of the rest minus those of shared values
    absent = F.first("n_rest") - F.sum(F.col("n_value") - F.col("n"))
    return j.groupBy("level").agg(((F.sum(gap) + absent / F.first("n_rest")) * 0.5).alias("tv"))
