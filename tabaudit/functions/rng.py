"""Hash uniforms: randomness that depends on the row identity and a salt only.

The same row gets the same draw on every executor, in every retry and for every
partitioning, so a recomputed task never changes the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 12
SCALE = float(16**HEX_DIGITS)


def key_text(keys: str | Sequence[str]) -> Column:
    """The row identity as text; several key columns are joined by '-'.

    Different keys have different texts: where there are several columns, a backslash or '-'
    in a value is written after a backslash, and a null as a backslash alone.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    if len(names) == 1:
        return F.concat_ws("-", F.col(names[0]).cast("string"))

    def part(n: str) -> Column:
        text = F.replace(F.col(n).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit("-"), F.lit("\\-")), F.lit("\\"))

    return F.concat_ws("-", *map(part, names))


def key_sql(keys: Sequence[str]) -> str:
    """``key_text`` as Spark SQL."""
    texts = [f"cast(`{k}` as string)" for k in keys]
    if len(texts) > 1:
        texts = [rf"coalesce(replace(replace({t}, '\\', '\\\\'), '-', '\\-'), '\\')" for t in texts]
    return f"concat_ws('-', {', '.join(texts)})"


def uniform(key: Column, salt: Column | str) -> Column:
    """A number in [0, 1) that is a pure function of (key, salt)."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.md5(F.concat(key, F.lit("-"), salt))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(SCALE)
