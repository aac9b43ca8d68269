"""Counting keys over a corpus, block by block, with the totals sent back to each block.

Texts are dealt once into blocks of bounded size, kept as a table bucketed by block in
the shared warehouse, so that joining answers to blocks does not move the texts again.
A block's task sends the distinct keys it has (sorted 64-bit numbers, with a payload
each) in slices of the key range; a slice meets its likes from all blocks in one task of
bounded size, which answers each block in the order of the keys it sent. A frequent key
is one entry a block, so no key is hot. Slices grow in number with the corpus.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut

#: Text bytes of a block; keys that a slice should hold; bits by which keys exceed their number.
BLOCK_BYTES, SLICE_KEYS, SPARE_BITS = 3_000_000, 1_500_000, 24


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes: the high bytes of small ones compress away."""
    return np.ascontiguousarray(x.reshape(-1, 1).view(np.uint8).T).tobytes()


def unplanes(raw: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))], names=["block", "ids", "texts"])

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(i)
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield row()
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield row()


@contextmanager
def block_table(docs: DataFrame, doc_id: str, text: str) -> Iterator[DataFrame]:
    """Blocks (block, ids, texts) of ``docs`` as a bucketed table, dropped at the end."""
    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text).cast("binary")).mapInArrow(_pack_blocks, "block long, ids array<bigint>, texts array<binary>")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        rows.write.bucketBy(buckets, "block").option("compression", "zstd").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"drop table if exists {name}")


class Slicing:
    """How keys are cut down and sliced: from an upper bound of how many there are."""

    def __init__(self, keys: int) -> None:
        self.slice_bits = max(0, math.ceil(math.log2(max(keys, 1) / SLICE_KEYS))) if keys > SLICE_KEYS else 0
        self.bits = min(64, 8 * math.ceil((math.log2(max(keys, 2)) + SPARE_BITS) / 8))

    def keys(self, hashes: np.ndarray, exact: bool = False) -> np.ndarray:
        """Hashes cut to as many bits as their number needs (``exact``: all 64)."""
        return hashes if exact else hashes & ~np.uint64((1 << (64 - self.bits)) - 1)

    def entries(self, kind: int, block: int, keys: np.ndarray, *payload: np.ndarray) -> list[tuple]:
        """(kind, slice, block, keys, payload) rows of sorted distinct keys."""
        if not len(keys):
            return []
        edges = [0, *(np.searchsorted(keys, np.arange(1, 1 << self.slice_bits, dtype=np.uint64) << np.uint64(64 - self.slice_bits)).tolist() if self.slice_bits else []), len(keys)]
        return [(kind, s, block, planes(np.diff(keys[a:z], prepend=np.uint64(0))), [planes(p[a:z]) for p in payload]) for s, (a, z) in enumerate(zip(edges, edges[1:])) if z > a]


ENTRY = "kind int, slice int, block long, keys binary, payload array<binary>"


def entry_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.binary()))
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "slice", "block", "keys", "payload"])


REPLY = "kind int, slice int, block long, data binary, distinct long, total long"


def answer(entries: DataFrame, combine: Callable[[int, np.ndarray, list[list[bytes]], np.ndarray, np.ndarray], tuple[np.ndarray, int, int]]) -> DataFrame:
    """Answers to all entries, written once.

    ``combine(kind, inverse, payloads, blocks, counts)`` gives one number per entry key (in
    the order of the rows, then of their keys) and two totals of the slice; ``inverse``
    numbers the distinct keys, ``blocks`` names the block of each key.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(unplanes(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
        n = np.array([len(k) for k in keys])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        out, distinct, total = combine(int(rows["kind"].iloc[0]), inverse, [list(p) for p in rows["payload"]], np.repeat(rows["block"].to_numpy(), n), n)
        parts = np.split(out, np.cumsum(n)[:-1])
        return pd.DataFrame({"kind": rows["kind"], "slice": rows["slice"], "block": rows["block"], "data": [planes(p) for p in parts], "distinct": [distinct] + [0] * (len(n) - 1), "total": [total] + [0] * (len(n) - 1)})

    return cut(entries.groupBy("kind", "slice").applyInPandas(run, REPLY))


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """Blocks with all answers to them; only the answers are shuffled."""
    per = replies.groupBy("block").agg(F.collect_list(F.struct("kind", "slice", "data")).alias("replies"))
    return blocks.join(per.hint("shuffle_hash"), "block", "left")


def block_rows(b: pa.RecordBatch) -> Iterator[tuple[int, list, list[bytes], dict[int, list[bytes]]]]:
    """(block, ids, texts, answers by kind in the order of the slices) of a batch."""
    at = {n: i for i, n in enumerate(b.schema.names)}
    for r in range(b.num_rows):
        answers: dict[int, list] = {}
        if "replies" in at:
            for x in b.column(at["replies"])[r].as_py() or []:
                answers.setdefault(x["kind"], []).append((x["slice"], x["data"]))
        yield b.column(at["block"])[r].as_py(), b.column(at["ids"])[r].as_py(), b.column(at["texts"])[r].as_py(), {k: [d for _, d in sorted(v)] for k, v in answers.items()}


def joined(parts: list[bytes] | None, kind) -> np.ndarray:
    return np.concatenate([unplanes(p, kind) for p in parts]) if parts else np.zeros(0, kind)
