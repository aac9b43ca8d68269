"""Labelled error injection: each operator returns (dirty, truth).

``truth`` is a long table (error, row_id). Which rows of a slice are hit is decided
by a hash of the row identity, so injection is one map-only pass and the same on
every run. ``exact=True`` hits exactly ``floor(n * frac)`` rows: those with the
smallest hashes, found by an exact order statistic of the hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.order_stats import group_quantiles, value_edges
from tabaudit.functions.predicates import window_pred
from tabaudit.functions.rng import key_text, uniform

Keys = str | Sequence[str]


def smallest(df: DataFrame, u: Column, rows: Column, k: int, n: int) -> Column:
    """Predicate for exactly the ``k`` of ``n`` selected rows with the smallest ``u``."""
    if k <= 0:
        return F.lit(False)
    if k >= n:
        return rows
    x = df.filter(rows).select(u.alias("x"), F.lit(0).alias("_g"))
    edges = [i / 16 for i in range(17)]  # a hash uniform needs no sampling pass
    cut = group_quantiles(x, ["_g"], {"at": (k - 1) / (n - 1)}, edges=edges).first()["at"]
    return rows & (u <= F.lit(cut + 1e-15))


def sampled(df: DataFrame, rows: Column, frac: float, keys: Keys, salt: str, exact: bool = False) -> Column:
    """Predicate for a random fraction of the rows that satisfy ``rows``."""
    if frac >= 1.0:
        return rows
    u = uniform(key_text(keys), salt)
    if not exact:
        return rows & (u < F.lit(float(frac)))
    n = df.filter(rows).count()
    return smallest(df, u, rows, int(n * frac), n)


def truth_of(df: DataFrame, hit: Column, error: str, keys: Keys) -> DataFrame:
    return df.filter(hit).select(F.lit(error).alias("error"), key_text(keys).alias("row_id"))


def _write(df: DataFrame, column: str, hit: Column, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(hit, value).otherwise(F.col(column)))


def corrupt_overwrite(df: DataFrame, column: str, rows: Column, value: Any, *, keys: Keys, error: str, frac: float = 1.0,
                      salt: str = "overwrite", truth_mode: str = "slice", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Write one value into a slice. ``truth_mode='changed'`` labels only rows whose value differs."""
    hit = sampled(df, rows, frac, keys, salt, exact)
    labelled = hit if truth_mode == "slice" else hit & F.coalesce(F.col(column) != F.lit(value), F.lit(True))
    return _write(df, column, hit, F.lit(value)), truth_of(df, labelled, error, keys)


def corrupt_randint(df: DataFrame, column: str, rows: Column, lo: int, hi: int, *, keys: Keys, error: str, frac: float = 1.0,
                    salt: str = "randint", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Write random integers from lo..hi into a fraction of a slice."""
    hit = sampled(df, rows, frac, keys, salt, exact)
    draw = F.lit(lo) + F.floor(uniform(key_text(keys), f"{salt}-value") * (hi - lo + 1))
    return _write(df, column, hit, draw.cast("double")), truth_of(df, hit, error, keys)


def corrupt_scale(df: DataFrame, column: str, rows: Column, factor: float, *, keys: Keys, error: str) -> tuple[DataFrame, DataFrame]:
    """Multiply a slice by a constant."""
    hit = rows & F.col(column).isNotNull()
    return _write(df, column, hit, F.col(column) * F.lit(factor)), truth_of(df, hit, error, keys)


def corrupt_shift(df: DataFrame, column: str, rows: Column, amount: float, *, keys: Keys, error: str) -> tuple[DataFrame, DataFrame]:
    """Add a constant to a slice."""
    hit = rows & F.col(column).isNotNull()
    return _write(df, column, hit, F.col(column) + F.lit(amount)), truth_of(df, hit, error, keys)


def corrupt_null(df: DataFrame, column: str, rows: Column, frac: float, *, keys: Keys, error: str, salt: str = "null",
                 exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Null a random fraction of a slice."""
    hit = sampled(df, rows & F.col(column).isNotNull(), frac, keys, salt, exact)
    return df.withColumn(column, F.when(~hit, F.col(column))), truth_of(df, hit, error, keys)


def corrupt_collapse(df: DataFrame, column: str, rows: Column, *, keys: Keys, error: str, high: float = 0.03,
                     salt: str = "collapse") -> tuple[DataFrame, DataFrame]:
    """Multiply the chosen rows by a uniform factor in [0, high)."""
    u = uniform(key_text(keys), salt)
    return _write(df, column, rows, F.col(column) * (u * F.lit(high))), truth_of(df, rows, error, keys)


def corrupt_quantile_band(df: DataFrame, column: str, rows: Column, *, keys: Keys, error: str, lo: float = 0.85, hi: float = 0.95,
                          salt: str = "band") -> tuple[DataFrame, DataFrame]:
    """Overwrite the chosen rows by uniform draws between two quantiles of the column."""
    x = df.select(F.col(column).cast("double").alias("x"), F.lit(0).alias("_g"))
    edges = value_edges(x, ["x"])["x"]
    q = group_quantiles(x, ["_g"], {"lo": lo, "hi": hi}, edges=edges).first()
    if q is None:
        return df, truth_of(df, F.lit(False), error, keys)
    draw = F.lit(q["lo"]) + uniform(key_text(keys), salt) * F.lit(q["hi"] - q["lo"])
    return _write(df, column, rows, draw), truth_of(df, rows, error, keys)


def corrupt_window(df: DataFrame, columns: Sequence[str], entity_col: str, entities: Sequence[Any], time_col: str, start: int, end: int,
                   factor: float, *, keys: Keys, error: str) -> tuple[DataFrame, DataFrame]:
    """Multiply several measures of the chosen entities inside a time window."""
    rows = F.lit(False)
    for e in entities:
        rows = rows | window_pred(entity_col, e, time_col, start, end)
    out = df.withColumns({c: F.when(rows, F.col(c) * F.lit(factor)).otherwise(F.col(c)) for c in columns})
    return out, truth_of(df, rows, error, keys)


def ground_truth(*truths: DataFrame) -> DataFrame:
    """One long table (error, row_id) from several injections."""
    out = truths[0]
    for t in truths[1:]:
        out = out.unionByName(t)
    return out


def ground_truth_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("error").agg(F.count(F.lit(1)).alias("n_rows"))
