"""Column expressions shared by the operators: words, lines, bound values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, and the pattern of a run of them.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(col: str | Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    inner = F.btrim(text_of(col), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN, -1))


def total(values: Column) -> Column:
    """Sum of an array of whole numbers (0 when empty)."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with only the ``used`` columns in sight; the others lie in one column, where no name can clash."""
    return docs.select(*used, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in used], F.lit(0).alias("__end")).alias("__aside"))


def restored(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """The ``columns`` of the table that was put aside, in their order."""
    return df.select(*[F.col(c) if c in used else F.col(f"__aside.`{c}`").alias(c) for c in columns])
