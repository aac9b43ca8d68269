"""Cutting lineage between the stages of a long job.

A stage result is written to the folder named by ``spark.checkpoint.dir``
(shared by all executors) and read back. Losing an executor costs a re-read, and
the reader knows the file sizes, so Spark broadcasts a result only when it is
small enough to.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: A stage result of up to so many rows may be broadcast whatever the session's threshold (a few MB).
FEW_ROWS = 50_000


_held: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Stage results that are written inside are removed at the end; what is still wanted has to be collected before."""
    _held.append([])
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        for path in _held.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for stage results; a temporary one only in local mode."""
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        folder = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tabaudit-stages-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def cut(df: DataFrame, spread: str | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` once and return it as a fresh scan of what was written.

    ``spread`` names a column to spread the files by, for a result that is small
    on disk but fans out when it is read. ``by`` names a column of few values that
    gets a folder for each, so that a reader of one value reads no other.
    """
    spark = df.sparkSession
    if spread:
        df = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), spread)
    path = f"{stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    if _held:
        _held[-1].append(path)
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A stage result to join large rows with: marked for broadcast if it has few ``rows``, so that it filters in the scan and the large rows stay where they are."""
    return F.broadcast(df) if df.count() <= rows else df
