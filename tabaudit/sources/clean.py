"""Canonicalising a raw table: names, sentinels, casts and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import FEW_ROWS
from tabaudit.functions.order_stats import group_quantiles, value_edges
from tabaudit.functions.predicates import as_number

# fixed values: a title token inside a personal name ("Surname, Title. Given")
TOKEN_PATTERN = r",\s*([A-Za-z ]+?)\."
LOOSE_TOKEN_PATTERN = r",\s*([^\.]+)\."
TOKEN_SUFFIX = "__title"


def canonical_names(df: DataFrame) -> DataFrame:
    """Trim the column names and write ``-`` and ``.`` as ``_``."""
    return df.toDF(*[c.strip().replace("-", "_").replace(".", "_") for c in df.columns])


def resolve_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """First column whose lower-cased name contains a key, keys tried in order."""
    found = {}
    for name, keys in wanted.items():
        hits = [c for k in keys for c in df.columns if k in c.lower()]
        if hits:
            found[name] = hits[0]
    return found


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL everywhere in the engine, never NaN."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df


def null_sentinels(df: DataFrame, columns: Sequence[str] | None = None, sentinel: str = "?") -> DataFrame:
    """Replace a sentinel text (blanks around it ignored) by null."""
    cols = columns or [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({c: F.when(F.trim(F.col(c)) != sentinel, F.col(c)) for c in cols})


def to_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cast to double; what is not a number becomes null."""
    return df.withColumns({c: as_number(F.col(c)) for c in columns})


def label_contains(column: str, text: str) -> Column:
    """0/1 label: does the text contain ``text`` (null counts as no)?"""
    return F.coalesce(F.col(column).contains(text), F.lit(False)).cast("int")


def drop_prefix_rows(df: DataFrame, code: str, prefix: str) -> DataFrame:
    """Drop aggregate rows: a null code or one that starts with ``prefix``."""
    return df.filter(F.col(code).isNotNull() & ~F.col(code).startswith(prefix))


def row_total(columns: Sequence[str]) -> Column:
    """Sum across columns with null as zero."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return total


def above_group_median(df: DataFrame, value: str, group: str, out: str) -> DataFrame:
    """0/1 label: is the value above the median of its group?

    The medians are exact order statistics joined back, so one large group (a
    year with most of the rows) is not gathered in a single window task.
    """
    rows = df.select(group, F.col(value).cast("double").alias("x"))
    med = group_quantiles(rows, [group], {"_median": 0.5}).select(group, "_median")
    joined = df.join(med, group, "left")
    return joined.withColumn(out, F.coalesce(F.col(value) > F.col("_median"), F.lit(False)).cast("int")).select(*df.columns, out)


def token(column: str, pattern: str = TOKEN_PATTERN) -> Column:
    """The captured token, trimmed; null when there is none."""
    t = F.trim(F.regexp_extract(F.col(column).cast("string"), pattern, 1))
    return F.when(t != "", t)


def token_columns(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """The candidates that carry a token in over half of the rows, 2..60 different ones."""
    if not candidates:
        return []
    aggs = [F.avg(token(c).isNotNull().cast("double")).alias(f"s{i}") for i, c in enumerate(candidates)]
    aggs += [F.count_distinct(token(c)).alias(f"d{i}") for i, c in enumerate(candidates)]
    row = df.agg(*aggs).first()
    return [c for i, c in enumerate(candidates) if (row[f"s{i}"] or 0) > 0.5 and 2 <= row[f"d{i}"] <= 60]


def derive_tokens(df: DataFrame, candidates: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add ``<column>__title`` for each candidate that qualifies."""
    kept = [c for c in token_columns(df, candidates) if f"{c}{TOKEN_SUFFIX}" not in df.columns]
    return df.withColumns({f"{c}{TOKEN_SUFFIX}": token(c) for c in kept}) if kept else df, [f"{c}{TOKEN_SUFFIX}" for c in kept]


def feature_view(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Only the declared features: absent numbers are null, absent categories OTHER."""
    have = set(df.columns)
    num = [as_number(F.col(c)).alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in numeric]
    cat = [F.coalesce(F.col(c).cast("string"), F.lit("OTHER")).alias(c) if c in have else F.lit("OTHER").alias(c) for c in categorical]
    return df.select(*keep, *num, *cat)


def column_medians(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> dict[str, float | None]:
    """Exact median of each column (one value per column comes to the driver); a row counts ``weight`` times."""
    if not columns:
        return {}
    if weight and df.count() <= FEW_ROWS:  # counts of few distinct rows: an aggregate holds them
        row = df.agg(*[F.percentile(as_number(F.col(c)), F.lit(0.5), F.col(weight)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(columns)}
    nums = df.select(*[as_number(F.col(c)).alias(c) for c in columns])
    edges = value_edges(nums, columns)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), as_number(F.col(c)).alias("x")) for c in columns])).alias("e")
    long = df.select(cells, (F.col(weight) if weight else F.lit(1)).alias("w")).select("e.*", "w")
    edges = {c: (edges[c] or [0.0]) for c in columns}
    rows = group_quantiles(long, ["column"], {"m": 0.5}, weight="w", edges=edges, edges_key="column").collect()
    return {c: None for c in columns} | {r["column"]: r["m"] for r in rows}


