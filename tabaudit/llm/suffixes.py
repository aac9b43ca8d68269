"""Removal of bytes that lie in repeated 200-byte strings, by induced suffix sorting.

Whether a suffix has a common prefix of ``LENGTH`` bytes with another is decided as in
induced sorting: only some suffixes are sorted themselves, the others follow from them.

* The sorted ones (as the leftmost S* suffixes) start where a hash is least among the next
  ``STEPS[0]`` places, a local property, so equal strings have equal starts. Each suffix
  belongs to the first such start behind it, its distance being less than ``STEPS[0]``.
* A suffix tuple stands for the consecutive suffixes that belong to one start. It carries the
  common prefix of all of them (the *core*) and the whole that they cover (the *context*).
  Sorted by context, equal neighbours prove common prefixes of ``LENGTH`` bytes for every
  suffix of the tuple; sorted by core, no equal neighbour proves that none has one.
* What is left open, equal cores in different contexts, is induced: the tuple is split into
  tuples of ``STEPS[1]`` suffixes by their distance from the start, whose common prefixes are
  longer, and these into single suffixes, where core and context are the same.

Tuples are sorted externally: their keys, packed block by block, are dealt to slices of the
key range (see ``blocks``), which Spark's shuffle writes to disk and each of which is sorted
by one task of bounded size; a slice answers every tuple whether its neighbours are equal.
The text is never larger in memory than a buffer of ``BUFFER`` suffixes, so texts and shards
may be of any size. A key is one entry a block, so none is hot. Order is that of hashes and not of
letters, since only common prefixes matter; contexts and single suffixes are compared by 96
bits, cores by 40 or more, as these only select.

Edge cases: a null text is empty; a text of less than ``LENGTH`` bytes keeps all; rows that
repeat an id are texts each; a text repeated whole is removed everywhere; an empty table
gives an empty result; ids are whole numbers; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.blocks import ENTRY, Slicing, answer, block_rows, block_table, entry_batch, joined, unplanes, with_replies
from tabaudit.llm.hashing import mix

LENGTH, STEPS, SEED_BYTES, BUFFER = 200, (96, 12, 1), 12, 1 << 20
_RNG = np.random.default_rng(20_250_117)
_BYTES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_BASES = (0x9E6D62D06F6A9A9B, 0xD2B74407B1CE6E93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_SHAPE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_POWERS: dict[tuple, np.ndarray] = {}
_LOW32 = np.uint64(0xFFFFFFFF)
#: Kinds of entries, by level: contexts and cores.
_CONTEXT, _CORE = 10, 20


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        x = np.full(max(n, 2 * BUFFER + LENGTH), base, np.uint64)
        x[0] = 1
        _POWERS[base] = np.multiply.accumulate(x)
    return _POWERS[base][:n]


class _Prefix:
    """Hashes of any strings of a buffer from one pass over it (which: of two independent ones)."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * _powers(_BASES[which], len(data)), out=self.sums[1:])
        self.back = _powers(_INVERSES[which], len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def rolling(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]


def _sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of ``size`` numbers from each place on (less at the end), by blocks."""
    n = -(-len(x) // size) * size + size
    y = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    y[: len(x)] = x
    y = y.reshape(-1, size)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(x)], ahead[size - 1 : size - 1 + len(x)])


@dataclass
class _Tuples:
    """Suffix tuples: the buffer, first and last suffix, and the sorted start they belong to."""

    buffer: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray

    def __getitem__(self, which) -> _Tuples:
        return _Tuples(self.buffer[which], self.first[which], self.last[which], self.start[which])

    def split(self, step: int) -> _Tuples:
        """The same suffixes, in tuples by their distance from the start divided by ``step``."""
        low, high = (self.start - self.last) // step, (self.start - self.first) // step
        n = high - low + 1
        j = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        b, f, z, s = (np.repeat(x, n) for x in (self.buffer, self.first, self.last, self.start))
        return _Tuples(b, np.maximum(f, s - step * j - step + 1), np.minimum(z, s - step * j), s)


class _Texts:
    """The texts of a block, in buffers of chunks that overlap by what a suffix needs."""

    def __init__(self, texts: list[bytes]) -> None:
        self.texts, self.buffers, now, size = texts, [], [], 0
        for d, t in enumerate(texts):
            for c in range(0, len(t) - LENGTH + 1, BUFFER):
                now.append((d, c, min(len(t), c + BUFFER + LENGTH - 1)))
                size += now[-1][2] - c
                if size >= BUFFER:
                    self.buffers.append(now)
                    now, size = [], 0
        if now:
            self.buffers.append(now)

    def data(self, b: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.texts[d][c:e] for d, c, e in self.buffers[b]), np.uint8)

    def tuples(self) -> _Tuples:
        """All suffixes that are long enough, by the start they belong to."""
        out = []
        for b, chunks in enumerate(self.buffers):
            x = self.data(b)
            h = mix(_Prefix(x).rolling(SEED_BYTES)) & ~_LOW32
            least = _sliding_least(h | np.arange(len(h), dtype=np.uint64), STEPS[0])
            n = np.array([e - c for _, c, e in chunks])
            at = np.concatenate([np.arange(a, a + k - LENGTH + 1) for a, k in zip((np.cumsum(n) - n).tolist(), n.tolist())])
            s = (least[at] & _LOW32).astype(np.int64)
            new = np.ones(len(at) + 1, bool)
            new[1:-1] = (np.diff(s) != 0) | (np.diff(at) != 1)
            edge = np.flatnonzero(new)
            out.append((np.full(len(edge) - 1, b, np.int32), at[edge[:-1]], at[edge[1:] - 1], s[edge[:-1]]))
        return _Tuples(*[np.concatenate(x) for x in zip(*out)]) if out else _Tuples(*[np.zeros(0, np.int64)] * 4)

    def keys(self, t: _Tuples, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each tuple: context, a second hash of it, core."""
        context, check, core = np.zeros(len(t.first), np.uint64), np.zeros(len(t.first), np.uint32), np.zeros(len(t.first), np.uint64)
        edge = np.searchsorted(t.buffer, np.arange(len(self.buffers) + 1))
        for b, (i, j) in enumerate(zip(edge, edge[1:])):
            if i == j:
                continue
            x, (f, z, s) = self.data(b), (v[i:j] for v in (t.first, t.last, t.start))
            p = _Prefix(x)
            context[i:j] = mix(p.of(f, z + LENGTH) + (s - f).astype(np.uint64) * _SHAPE[0] + (z - f).astype(np.uint64) * _SHAPE[1])
            near = s - step * ((s - z) // step)
            if step > 1:
                core[i:j] = mix(p.of(near, near - step + 1 + LENGTH))
            check[i:j] = (mix(_Prefix(x, 1).of(f, z + LENGTH)) >> np.uint64(32)).astype(np.uint32)
        return context, check, core

    def spans(self, t: _Tuples) -> list[tuple[int, int, int]]:
        """(document, first byte, end) of what the tuples cover, in order, not merged."""
        out, edge = [], np.searchsorted(t.buffer, np.arange(len(self.buffers) + 1))
        for b, (i, j) in enumerate(zip(edge, edge[1:])):
            if i < j:
                n = np.array([e - c for _, c, e in self.buffers[b]])
                begin = np.cumsum(n) - n
                k = np.searchsorted(begin, t.first[i:j], "right") - 1
                doc, move = np.array([d for d, _, _ in self.buffers[b]])[k], np.array([c for _, c, _ in self.buffers[b]])[k] - begin[k]
                out.append((doc, t.first[i:j] + move, t.last[i:j] + move + LENGTH))
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


class _View:
    """What a block knows from the answers to its tuples so far."""

    def __init__(self, texts: list[bytes], said: dict[int, list[bytes]], cutting: Slicing, levels: int) -> None:
        self.texts, self.cutting, self.sure = _Texts(texts), cutting, []
        now = self.texts.tuples()
        for level in range(levels):
            context, _, core = self.texts.keys(now, STEPS[level])
            repeated = self._said(said, _CONTEXT + level, context)
            self.sure.append(now[repeated])
            if level + 1 == len(STEPS):
                break
            now = now[self._said(said, _CORE + level, cutting.keys(core))].split(STEPS[level + 1])
        self.now, self.level = now, levels

    @staticmethod
    def _said(said: dict[int, list[bytes]], kind: int, keys: np.ndarray) -> np.ndarray:
        return joined(said.get(kind), np.uint8).astype(bool)[np.unique(keys, return_inverse=True)[1]] if len(keys) else np.zeros(0, bool)

    def entries(self, block: int) -> list[tuple]:
        if not len(self.now.first):
            return []
        step = STEPS[self.level]
        context, check, core = self.texts.keys(self.now, step)
        keys, first, n = np.unique(context, return_index=True, return_counts=True)
        out = self.cutting.entries(_CONTEXT + self.level, block, keys, check[first], np.minimum(n, 2).astype(np.uint8))
        if step > 1:
            cores = self.cutting.keys(core)
            order = np.lexsort((context, cores))
            low = np.flatnonzero(np.append(True, np.diff(cores[order]) != 0))
            high = np.append(low[1:], len(order)) - 1
            one = context[order[low]] == context[order[high]]
            out += self.cutting.entries(_CORE + self.level, block, cores[order[low]], np.where(one, context[order[low]], np.uint64(0)))
        return out

    def removed(self) -> list[np.ndarray]:
        """Per text: starts and ends of maximal runs in an array of pairs."""
        found = [self.texts.spans(t) for t in self.sure]
        doc, start, end = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        out = []
        edge = np.searchsorted(doc, np.arange(len(self.texts.texts) + 1))
        for i, j in zip(edge, edge[1:]):
            reach = np.maximum.accumulate(end[i:j])
            new = np.append(True, start[i + 1 : j] > reach[:-1])[: j - i]
            low = np.flatnonzero(new)
            out.append(np.stack([start[i:j][low], reach[np.append(low[1:], j - i)[: len(low)] - 1]], axis=1) if len(low) else np.zeros((0, 2), np.int64))
        return out


def _combine(kind: int, inverse: np.ndarray, payloads: list, blocks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Contexts: whether another tuple has it; cores: whether it stands in different contexts."""
    if kind < _CORE:
        check = np.concatenate([unplanes(p[0], np.uint32) for p in payloads])
        n = np.concatenate([unplanes(p[1], np.uint8) for p in payloads])
        _, which = np.unique(inverse.astype(np.uint64) << np.uint64(32) | check, return_inverse=True)
        return (np.bincount(which, weights=n) > 1)[which].astype(np.uint8), 0, 0
    context = np.concatenate([unplanes(p[0], np.uint64) for p in payloads])
    order = np.argsort(inverse, kind="stable")
    low = np.flatnonzero(np.append(True, np.diff(inverse[order]) != 0))
    least, most = np.minimum.reduceat(context[order], low), np.maximum.reduceat(context[order], low)
    return ((least != most) | (least == 0))[inverse].astype(np.uint8), 0, 0


_RESULT = "id long, n_bytes long, n_removed long, kept binary, removed array<struct<start:bigint,end:bigint>>"


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, kept (bytes left), removed (maximal runs of bytes).

    ``then`` is applied to these rows before they are written.
    """
    with block_table(docs, doc_id, text) as blocks:
        size = blocks.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))).first()[0] or 0
        cutting = Slicing(size // 6)

        def send(level: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for block, _, texts, said in block_rows(b):
                        if rows := _View(texts, said, cutting, level).entries(block):
                            yield entry_batch(rows)

            return run

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, ids, texts, said in block_rows(b):
                    runs, kept, gone = _View(texts, said, cutting, len(STEPS)).removed(), [], []
                    for t, r in zip(texts, runs):
                        ends = [0, *r[:, 1].tolist()]
                        kept.append(b"".join(t[a:z] for a, z in zip(ends, [*r[:, 0].tolist(), len(t)])))
                        gone.append([{"start": a, "end": z} for a, z in r.tolist()])
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()), pa.array(kept, pa.binary()),
                                           pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "n_bytes", "n_removed", "kept", "removed"])

        said = None
        for level in range(len(STEPS)):
            rows = blocks.select("block", "ids", "texts") if said is None else with_replies(blocks, said)
            more = answer(rows.mapInArrow(send(level), ENTRY), _combine)
            said = more if said is None else said.unionByName(more)
        done = with_replies(blocks, said).mapInArrow(finish, _RESULT)
        return cut(then(done.withColumnRenamed("id", doc_id)))
