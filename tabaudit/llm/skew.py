"""Joins of many rows with a table of one row per key, where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: More than one in so many rows makes a key hot; so there are fewer hot keys than this, whatever the input.
HOT_SHARE = 10_000


def join_hot(rows: DataFrame, table: DataFrame, left: str, right: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` on ``left`` = ``right`` (names that do not clash); no task gets a hot key's rows whole.

    ``table`` has one row per key; ``count`` is its bound on the key's rows, ``total`` the
    sum of these. The rows of hot keys stay where they are and meet the hot part of
    ``table``, fewer than HOT_SHARE rows, by broadcast; the others are shuffled. Both
    inputs are read twice, so they should be written tables. A null key meets nothing.
    """
    is_hot = F.col(count) * HOT_SHARE > total
    hot, mild = F.broadcast(table.filter(is_hot)), table.filter(~is_hot)
    on = F.col(left) == F.col(right)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(mild, on))
