"""Reading tables; writing versions, findings and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabaudit.sources.clean import above_group_median, as_number, drop_prefix_rows, nan_to_null, resolve_columns, row_total


def read_table(spark: SparkSession, path: str, *, fmt: str | None = None, schema: StructType | str | None = None,
               names: Sequence[str] | None = None, label: str | None = None) -> DataFrame:
    """Read parquet, or headered CSV with inferred types unless ``schema`` is given.

    With ``names`` and ``label`` a CSV may lack its header: when the first line
    has as many fields as ``names`` but no ``label`` among them, it is data.
    """
    kind = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if kind != "csv":
        return nan_to_null(spark.read.format(kind).load(path))
    reader = spark.read.option("ignoreLeadingWhiteSpace", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    if names is None:
        return nan_to_null(reader.option("header", True).csv(path))
    head = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path).columns
    if label in head or len(head) != len(names):
        return nan_to_null(reader.option("header", True).csv(path))
    return nan_to_null(reader.option("header", False).csv(path).toDF(*names))


def load_panel(raw: DataFrame, keys: Mapping[str, Sequence[str]], measures: Mapping[str, Sequence[str]], *,
               entity: str, time: str, code: str | None = None, prefix: str = "OWID", label: str | None = None) -> DataFrame:
    """Canonical panel: resolve columns by name part, cast, drop aggregates, label.

    ``keys`` names the entity, time and (optional) code columns; ``measures`` the
    numeric ones. A row needs a time and at least one measure. ``label`` is 1 where
    the row total is above the median total of its time point.
    """
    found = resolve_columns(raw, {**keys, **measures})
    have = [m for m in measures if m in found]
    cols = [F.col(f"`{found[entity]}`").cast("string").alias(entity), as_number(F.col(f"`{found[time]}`")).cast("int").alias(time)]
    if code and code in found:
        cols.append(F.col(f"`{found[code]}`").cast("string").alias(code))
    cols += [as_number(F.col(f"`{found[m]}`")).alias(m) for m in have]
    out = raw.select(*cols)
    if code and code in found:
        out = drop_prefix_rows(out, code, prefix)
    out = out.na.drop(subset=[time]).na.drop(how="all", subset=have)
    if label:
        names = out.columns
        out = above_group_median(out.withColumn("_total", row_total(have)), "_total", time, label).select(*names, label)
    return out


def write_version(df: DataFrame, folder: str, version: int, fmt: str = "parquet", order: Sequence[str] = ()) -> str:
    """Write one table version to ``folder/v{n}`` and return that path."""
    path = f"{folder.rstrip('/')}/v{version}"
    out = df.sortWithinPartitions(*order) if order else df
    writer = out.write.mode("errorifexists")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
    return path


def write_findings(df: DataFrame, path: str) -> str:
    """Findings, ground truth or a summary as JSON lines (one object per row)."""
    df.write.mode("errorifexists").json(path)
    return path


def best_version(history: DataFrame, fallback: str | int | None = None) -> DataFrame:
    """The version with the best score, the earliest on ties; else the fallback."""
    best = history.agg(F.max_by("version", F.struct(F.col("score"), -F.col("step"))).alias("version"), F.max("score").alias("score"))
    if fallback is None:
        return best
    return best.withColumn("version", F.coalesce("version", F.lit(fallback)))
