"""Removal of word sequences that repeat across the corpus, by fixed-block anchors.

The unit of repetition is a window of ``WINDOW`` words. Every text is also cut into
blocks of ``ANCHOR`` words that do not overlap: the anchors. Any window holds a whole
anchor of its own text, so a repeated window shares those ten words with each of its
other occurrences. All anchors are indexed and every text probes the index with all its
rolling ten-word windows. Places hit by an anchor that lies elsewhere too are extended to
both sides: windows that hold a hit are compared as wholes, which gives the maximal exact
repeats, and of equal windows the earliest stays (smaller id, null first, then earlier
start). Everything is judged on the input.

Keys travel packed, block by block (see ``blocks``). Ten-word keys only select candidates
and are cut to the bits their number needs; whole windows are compared by 64 bits of a
second hash on top of that.

Edge cases: a null text has no words; words stay as they are; rows with one id are taken
in input order; a very long text stays in one block; an empty table gives an empty
result; ids are whole numbers; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.blocks import ENTRY, Slicing, answer, block_rows, block_table, entry_batch, joined, unplanes, with_replies
from tabaudit.llm.hashing import window_hashes, window_starts, word_hashes

WINDOW, ANCHOR = 20, 10
_HIT, _FIRST = 1, 2
_NULL = np.iinfo(np.int64).min


def _rolling(words: np.ndarray, counts: np.ndarray, cutting: Slicing) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all ten-word windows, their distinct keys, and which key each start has."""
    at = window_starts(counts, ANCHOR)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, inverse = np.unique(cutting.keys(window_hashes(words, ANCHOR)[at]), return_inverse=True)
    return at, keys, inverse


def _probes(cutting: Slicing):
    """Sends a block's rolling keys; flag 1: it is an anchor here, flag 2: more than once here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, _, texts, _ in block_rows(b):
                words, counts = word_hashes(texts)
                at, keys, inverse = _rolling(words, counts, cutting)
                if len(at):
                    begin = np.repeat(np.cumsum(counts) - counts, counts)[at]
                    flags = np.bincount(inverse[(at - begin) % ANCHOR == 0], minlength=len(keys)).clip(0, 1) + 2 * (np.bincount(inverse, minlength=len(keys)) > 1)
                    yield entry_batch(cutting.entries(_HIT, block, keys, flags.astype(np.uint8)))

    return run


def _combine(kind: int, inverse: np.ndarray, payloads: list, blocks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int, int]:
    if kind == _HIT:  # repeated, and an anchor somewhere
        flags = np.concatenate([unplanes(p[0], np.uint8) for p in payloads])
        times = np.bincount(inverse, weights=1 + (flags >> 1))
        anchored = np.bincount(inverse, weights=flags & 1) > 0
        return ((times > 1) & anchored)[inverse].astype(np.uint8), 0, 0
    ids = np.concatenate([unplanes(p[0], np.int64) for p in payloads])
    order = np.lexsort((blocks, ids, inverse))
    first = np.ones(len(order), bool)
    first[1:] = inverse[order][1:] != inverse[order][:-1]
    out = np.zeros(len(order), np.uint8)
    out[order[first]] = 1
    return out, 0, 0


def _candidates(ids: list, texts: list[bytes], hits: list[bytes] | None, cutting: Slicing):
    """Windows that hold a hit: starts, keys, key of each, first start of each key here, and its id; and the word counts."""
    words, counts = word_hashes(texts)
    at, keys, inverse = _rolling(words, counts, cutting)
    hit = np.zeros(len(words) + 1, np.int64)
    if len(at):
        hit[at + 1] = joined(hits, np.uint8)[inverse]
    upto = np.cumsum(hit)  # hits that start before a place
    start = window_starts(counts, WINDOW)
    start = start[upto[start + WINDOW - ANCHOR + 1] - upto[start] > 0]
    doc = np.searchsorted(np.cumsum(counts), start, "right")
    number = np.array([_NULL if i is None else i for i in ids], dtype=np.int64)[doc]
    hashes = window_hashes(words, WINDOW)[start] if len(start) else np.zeros(0, np.uint64)
    order = np.lexsort((start, number, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    which = np.zeros(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return counts, start, hashes[order[new]], which, order[new], number[order[new]]


def _firsts(cutting: Slicing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, texts, said in block_rows(b):
                _, start, keys, _, _, number = _candidates(ids, texts, said.get(_HIT), cutting)
                if len(start):
                    yield entry_batch(cutting.entries(_FIRST, block, keys, number))

    return run


def _remove(cutting: Slicing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, ids, texts, said in block_rows(b):
                counts, start, _, which, first, _ = _candidates(ids, texts, said.get(_HIT), cutting)
                stays = np.zeros(len(start), bool)
                stays[first[joined(said.get(_FIRST), np.uint8).astype(bool)]] = True
                edge = np.zeros(int(counts.sum()) + 1, np.int64)
                np.add.at(edge, start[~stays], 1)
                np.add.at(edge, start[~stays] + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                ends, kept, spans, removed = np.cumsum(counts), [], [], []
                for t, n, z in zip(texts, counts.tolist(), ends.tolist()):
                    g, w = gone[z - n : z], t.split()
                    removed.append(int(g.sum()))
                    if removed[-1]:
                        w = [x for x, y in zip(w, g.tolist()) if not y]
                        turn = np.flatnonzero(np.diff(g.astype(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()
                        spans.append([{"start": a, "end": e} for a, e in zip(turn[::2], turn[1::2])])
                    else:
                        spans.append([])
                    kept.append(b" ".join(w))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                                       pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "n_words", "n_removed", "kept_text", "removed"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (words joined by one space), removed (spans of words).

    ``then`` is applied to these rows before they are written.
    """
    with block_table(docs, doc_id, text) as blocks:
        # at most a window per two bytes of text; words are counted in the blocks themselves
        size = blocks.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))).first()[0] or 0
        cutting = Slicing(size // 6)
        hits = answer(blocks.select("block", "ids", "texts").mapInArrow(_probes(cutting), ENTRY), _combine)
        firsts = answer(with_replies(blocks, hits).mapInArrow(_firsts(cutting), ENTRY), _combine)
        done = with_replies(blocks, hits.unionByName(firsts)).mapInArrow(_remove(cutting), "id long, n_words long, n_removed long, kept_text string, removed array<struct<start:bigint,end:bigint>>")
        return cut(then(done.withColumnRenamed("id", doc_id)))
