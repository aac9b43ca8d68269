"""Frozen repairs on a stream.

The audit itself is a batch job. Once its findings are frozen, repairs that are a
plain column expression keep no state and run unchanged on a streaming table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row

from tabaudit.operators.repair import apply_all

STATELESS = ("subtract", "divide", "impute_missing", "divide_window", "divide_window_multi")


def repair_stream(stream: DataFrame, findings: Sequence[Row], keys: Sequence[str], seed: int = 0) -> DataFrame:
    """Apply frozen findings to a stream; repairs that need other rows are refused."""
    needs_rows = sorted({f["repair"]["type"] for f in findings if f["repair"] is not None} - set(STATELESS) - {"flag_entity", "flag_fd"})
    if needs_rows:
        raise ValueError(f"these repairs need other rows and only work on a table: {needs_rows}")
    return apply_all(stream, findings, keys, seed=seed)
