"""Row predicates and small column expressions shared by the operators."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def equals_level(column: str, level: Any) -> Column:
    """``column = level``; a null never matches. A text level is compared as text."""
    c = _col(column)
    if isinstance(level, str):
        c = c.cast("string")
    return F.coalesce(c == F.lit(level), F.lit(False))


def slice_pred(slicer: str, level: Any, context: str | None = None, context_level: Any = None) -> Column:
    """Rows of one slice, optionally inside one level of a context column."""
    pred = equals_level(slicer, level)
    if context is not None:
        pred = pred & equals_level(context, context_level)
    return pred


def slice_complement(slicer: str, level: Any, with_nulls: bool = False) -> Column:
    """The other rows. The audit leaves out null slicers, a repair keeps them."""
    rest = ~equals_level(slicer, level)
    return rest if with_nulls else rest & _col(slicer).isNotNull()


def window_pred(entity_col: str, entity: Any, time_col: str, start: int, end: int) -> Column:
    """Rows of one entity between two times, both included."""
    return equals_level(entity_col, entity) & F.coalesce(_col(time_col).between(start, end), F.lit(False))


def as_number(c: Column) -> Column:
    """The value as double; text that is no number, and NaN, become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def is_whole(c: Column) -> Column:
    """Whether every value of a group is integer-valued (an aggregate)."""
    return F.coalesce(F.bool_and((c % 1) == 0), F.lit(True))
