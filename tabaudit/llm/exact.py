"""Exact deduplication by two-pass Bloom filtering.

Pass one builds a Bloom filter in two layers: a slot's first layer is set by the first
hash that reaches it, the second layer by any later one. Tasks build both layers of
their rows, and layers merge by ``second = a2 | b2 | (a1 & b1)``. A hash that occurs
twice has all its slots in the second layer. Pass two probes the second layer: rows
that miss it are unique and pass straight through; only the others, as (digest, id),
are shuffled and grouped. Texts never are.

The second layer is broadcast; its size is bounded by ``max_bits``. Beyond about a
tenth of that many rows it fills up and lets more unique rows through to the
grouping, which stays exact: the bound costs shuffle of 40-byte rows, never results.

Edge cases: a null text counts as empty; of equal texts the smallest id stays, nulls
last; if that id is repeated on equal rows, one of them stays; an empty table gives
an empty result; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.native import SPACE_RUN, text_of
from tabaudit.llm.skew import join_hot

#: Slots per hash; bits per expected row; bound of the filter's bits (16 MB a layer).
SLOTS, BITS_A_ROW, MAX_BITS = 4, 16, 1 << 27
#: Bits of a segment, the unit in which layers are merged; tasks merged in one go.
SEGMENT_BITS, MERGE = 1 << 18, 64


def digest(text: str = "text") -> Column:
    """SHA-256 of the text with each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(text_of(text), SPACE_RUN, " ").cast("binary"), 256)


def _slots(digests: pa.ChunkedArray | pa.Array, bits: int) -> np.ndarray:
    """(rows, SLOTS) slot numbers from the 32 digest bytes."""
    flat = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)
    return (flat & np.uint64(bits - 1)).astype(np.int64)


def _layers(batches: Iterator[pa.RecordBatch], bits: int, segment: int) -> Iterator[pa.RecordBatch]:
    first, second = np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)
    seen = False
    for b in batches:
        if not b.num_rows:
            continue
        seen = True
        # a hash may name a slot twice: it still counts once there
        s = np.sort(_slots(b.column(0), bits), axis=1)
        own = np.ones(s.shape, dtype=bool)
        own[:, 1:] = s[:, 1:] != s[:, :-1]
        at, n = np.unique(s[own], return_counts=True)
        second[at[(n > 1) | first[at]]] = True
        first[at] = True
    if seen:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        starts = [i for i in range(0, bits, segment) if first[i : i + segment].any()]
        packed = [(np.packbits(first[i : i + segment]).tobytes(), np.packbits(second[i : i + segment]).tobytes()) for i in starts]
        yield pa.record_batch({"segment": pa.array([i // segment for i in starts], pa.int32()), "part": pa.array([part] * len(starts), pa.int32()),
                               "first": pa.array([x for x, _ in packed], pa.binary()), "second": pa.array([y for _, y in packed], pa.binary())})


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    first = second = None
    for a, b in zip(rows["first"], rows["second"]):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        first, second = (a, b) if first is None else (first | a, second | b | (first & a))
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "part": rows["part"].iloc[:1] // MERGE, "first": [first.tobytes()], "second": [second.tobytes()]})


def possibly_repeated(hashed: DataFrame, column: str, max_bits: int = MAX_BITS) -> DataFrame:
    """``hashed`` with ``maybe``: false only where the 32-byte ``column`` is surely unique."""
    rows, spark = hashed.count(), hashed.sparkSession
    bits = 1 << 15
    while bits < min(rows * BITS_A_ROW, max_bits):
        bits *= 2
    segment = min(bits, SEGMENT_BITS)
    layer = "segment int, part int, first binary, second binary"
    merged = hashed.select(column).mapInArrow(lambda it: _layers(it, bits, segment), layer)
    tasks = hashed.rdd.getNumPartitions()
    while tasks > 1:  # each step merges up to MERGE tasks' layers of a segment
        merged = merged.groupBy("segment", F.floor(F.col("part") / MERGE).alias("_to")).applyInPandas(_merge, layer)
        tasks = -(-tasks // MERGE)
    filled = np.zeros(bits, dtype=bool)  # bounded: max_bits
    for r in merged.select("segment", "second").toLocalIterator():
        filled[r["segment"] * segment : (r["segment"] + 1) * segment] = np.unpackbits(np.frombuffer(r["second"], np.uint8)).astype(bool)
    shared = spark.sparkContext.broadcast(np.packbits(filled).tobytes())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layer2 = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            s = _slots(b.column(b.schema.get_field_index(column)), bits) if b.num_rows else np.zeros((0, SLOTS), np.int64)
            hit = ((layer2[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], names=[*b.schema.names, "maybe"])

    from pyspark.sql.types import BooleanType, StructField, StructType

    return hashed.mapInArrow(probe, StructType([*hashed.schema.fields, StructField("maybe", BooleanType())]))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    hashed = cut(docs.select(F.col(doc_id).alias("id"), F.unhex(digest(text)).alias("sha")))
    probed = cut(possibly_repeated(hashed, "sha", max_bits))
    alone = probed.filter(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    # equal rows are counted first, so that neither a hot text nor a repeated row meets in one task
    rows = cut(probed.filter("maybe").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n")))
    groups = cut(rows.groupBy(F.col("sha").alias("s")).agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("ids")))
    both = join_hot(rows, groups, "sha", "s", "ids", rows.count()).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    shared = both.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "sha")
    return alone.unionByName(shared).select(F.col("id").alias(doc_id), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))
