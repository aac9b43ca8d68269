"""Description of a table to audit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class AuditConfig:
    """What the engine must know about a table.

    ``row_id`` is the column (or columns) that identify a row; all sampling hashes
    it. ``load``, ``inject`` and ``analyze`` are plain DataFrame functions.
    """

    name: str
    target: str
    row_id: tuple[str, ...]
    numeric_features: tuple[str, ...] = ()
    categorical_features: tuple[str, ...] = ()
    id_cols: tuple[str, ...] = ()
    entity_col: str | None = None
    time_col: str | None = None
    top_k: dict[str, int] = field(default_factory=dict)
    load: Callable[[SparkSession, str], DataFrame] | None = None
    inject: Callable[[DataFrame, int], tuple[DataFrame, DataFrame]] | None = None
    analyze: Callable[..., DataFrame] | None = None

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric_features + self.categorical_features
