"""Order-preserving packing of token streams into sequences of bounded length.

Documents are tokenised in the order of their input partition and laid end to end;
dynamic programming chooses where one sequence ends and the next begins. A cut costs
nothing at a document's end, little at a sentence's end and more elsewhere; a sequence
costs its padding to the full length, or none if its length is a power of two, plus a
small fixed price that keeps tiny sequences rare. The best previous cut for padded
sequences is the minimum of ``cost + position`` over a sliding window, kept in a
monotone queue; unpadded lengths are a handful of direct look-ups. Every position is
decided once, so the work is linear in the tokens.

A task holds one chunk of the stream at a time and carries what follows its last cut
to the next chunk; nothing is shuffled, and a lost task is simply run again with the
same result, as only its own partition's order matters.

Words are tokenised once per worker: white space always separates tokens in the
tokenizers this accepts, so a word's ids do not depend on its neighbours (checked on
each text in the tests). The word cache is bounded and emptied when full.

Edge cases: a null or empty text is only its closing id; repeated rows are packed each;
a text longer than a sequence is cut; an empty table gives an empty result; other
input columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Tokens of a sequence, and the id that closes a document.
LENGTH, END_ID = 2048, 1
#: Prices in tokens: a sequence, a cut at a sentence's end, a cut anywhere else.
SEQUENCE, SENTENCE, INSIDE = 8, 8, 64
#: Shortest sequence that goes unpadded before the stream's end; largest gap between allowed cuts.
LEAST_POWER, GAP = 64, 256
#: Tokens of a chunk, words looked up at once, words kept in the cache.
CHUNK, LOOKUP, CACHE = 1 << 20, 700_000, 900_000


class WordIds:
    """Token ids of words, each tokenised once (bounded)."""

    def __init__(self, spec: str, limit: int = CACHE) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.limit = limit
        bar = self.encode("|")
        self.bar = bar[0] if len(bar) == 1 else None
        # where case does not count, words that differ by it share an entry
        self.fold = bytes.lower if self.encode("QUICK Fox") == self.encode("quick fox") else bytes
        vocab = self.tok.get_vocab()
        self.sentence = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.sentence[[i for s, i in vocab.items() if s.removesuffix("</w>").endswith((".", "!", "?"))]] = True
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0
        self._add([b""], np.zeros(1, np.int64), np.zeros(0, np.int32))  # what an empty text is split into

    def encode(self, text: str) -> list[int]:
        return self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without places in the text

    def _add(self, words: list[bytes], lens: np.ndarray, new: np.ndarray) -> None:
        """Words, how many ids each has, and their ids end to end."""
        n = len(self.at)
        while n + len(words) > len(self.starts):
            self.starts, self.lens = np.concatenate([self.starts, self.starts * 0]), np.concatenate([self.lens, self.lens * 0])
        self.starts[n : n + len(words)] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + len(words)] = lens
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat * 0])
        self.flat[self.used : self.used + len(new)] = new
        self.used += len(new)
        self.at.update(zip(words, range(n, n + len(words))))

    def learn(self, words: list[bytes]) -> None:
        """Tokenises new words: many in one call, told apart by a bar standing alone between them."""
        plain = [w for w in words if b"|" not in w] if self.bar is not None else []
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            ids = np.array(self.encode(b" | ".join(part).decode() + " |"), dtype=np.int32)
            bars = np.flatnonzero(ids == self.bar)
            if len(bars) == len(part):
                self._add(part, np.diff(bars, prepend=-1) - 1, ids[ids != self.bar])
        if rest := [w for w in words if w not in self.at]:
            ids = [self.encode(w.decode()) for w in rest]
            self._add(rest, np.fromiter(map(len, ids), np.int64, len(ids)), np.array([i for x in ids for i in x], np.int32))

    def documents(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (strings) end to end, each closed by ``end``; and the number of each text's ids.

        Words are told apart and numbered by Arrow, so only distinct ones are looked up.
        """
        if len(self.at) > self.limit:
            self.clear()
        trimmed = pc.ascii_trim_whitespace(texts)
        split = pc.ascii_split_whitespace(pc.ascii_lower(trimmed) if self.fold is bytes.lower else trimmed)
        words = split.flatten().dictionary_encode()
        known, at = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), self.at
        if new := [w for w in known if w not in at]:
            self.learn(new)
        idx = np.fromiter(map(at.__getitem__, known), np.int64, len(known))[words.indices.to_numpy()]
        lens = self.lens[idx]
        upto = np.concatenate([[0], np.cumsum(lens)])
        total = int(upto[-1])
        ids = self.flat[np.repeat(self.starts[idx] - upto[:-1], lens) + np.arange(total)]
        ends = upto[np.cumsum(pc.list_value_length(split).to_numpy())]
        sizes = np.diff(np.concatenate([[0], ends])) + 1
        return np.insert(ids, ends, end).astype("<u4"), sizes


def choose_cuts(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, final: bool, length: int = LENGTH) -> np.ndarray:
    """Cut positions of least cost in a stream of ``n`` ids. Unless ``final``, the last may lie before ``n``."""
    price = {}
    at = np.union1d(np.concatenate([[0], doc_ends]), sentence_ends)
    at = at[at <= n]
    gaps = np.diff(np.concatenate([at, [n]]))
    inner = [np.arange(a + GAP, a + g, GAP) for a, g in zip(at[gaps > GAP], gaps[gaps > GAP])]
    at = np.unique(np.concatenate([at, *inner, [n]]))
    price = np.full(len(at), INSIDE)
    price[np.isin(at, sentence_ends, assume_unique=False)] = SENTENCE
    price[np.isin(at, doc_ends)] = 0
    if final:
        price[-1] = 0
    pos, cost = at.tolist(), price.tolist()
    index = {p: i for i, p in enumerate(pos)}
    powers = [1 << k for k in range(length.bit_length()) if LEAST_POWER <= 1 << k < length]
    best, back, key = [0.0] * len(pos), [0] * len(pos), [0.0] * len(pos)
    queue: deque[int] = deque()
    for j in range(1, len(pos)):
        p, k = pos[j], best[j - 1] + pos[j - 1]
        key[j - 1] = k
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j - 1)
        while pos[queue[0]] < p - length:
            queue.popleft()
        i = queue[0]
        c = key[i] + length - p
        for w in powers:
            q = index.get(p - w)
            if q is not None and best[q] < c:
                c, i = best[q], q
        best[j], back[j] = c + cost[j] + SEQUENCE, i
    last = len(pos) - 1
    if not final:  # the rest is carried: end at the cheapest cut, counting what is left over as unpadded
        near = [j for j in range(len(pos)) if pos[j] > n - length]
        last = min(near, key=lambda j: best[j] - (pos[j] - n) * SEQUENCE / length)
    out = []
    while last > 0:
        out.append(pos[last])
        last = back[last]
    out.reverse()
    if final and out:
        # the remainder may do without padding as a sum of powers of two
        a, r = (out[-2] if len(out) > 1 else 0), out[-1] - (out[-2] if len(out) > 1 else 0)
        parts = [1 << k for k in range(r.bit_length() - 1, -1, -1) if r >> k & 1]
        if len(parts) > 1 and (length - r) > (len(parts) - 1) * (INSIDE + SEQUENCE):
            out[-1:] = (a + np.cumsum(parts)).tolist()
    return np.array(out, dtype=np.int64)


class _Stream:
    """Ids that await their cuts, and the documents they belong to."""

    def __init__(self, words: WordIds, part: int, length: int) -> None:
        self.words, self.length, self.next = words, length, part << 40
        self.ids, self.docs = np.zeros(0, "<u4"), []  # docs: (id, ids before, ids here, ids in all)

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids])
        self.docs += [(d, 0, s, s) for d, s in zip(doc_ids, sizes.tolist())]

    def flush(self, final: bool, kind: pa.DataType) -> pa.RecordBatch | None:
        n = len(self.ids)
        if not n:
            return None
        ends = np.cumsum([d[2] for d in self.docs])
        sentences = np.flatnonzero(self.words.sentence[self.ids]) + 1
        cuts = choose_cuts(n, ends, sentences, final, self.length)
        done = int(cuts[-1]) if len(cuts) else 0
        if not done:
            return None
        stop = np.unique(np.concatenate([cuts, ends[ends <= done]]))
        start = np.concatenate([[0], stop[:-1]])
        doc, seq = np.searchsorted(ends, start, "right"), np.searchsorted(cuts, start, "right")
        before, here, total = (np.array([d[k] for d in self.docs], dtype=np.int64) for k in (1, 2, 3))
        seq_start = np.concatenate([[0], cuts[:-1]])
        raw = pa.BinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer((np.concatenate([[0], stop]) * 4).astype("<i8")), pa.py_buffer(self.ids[:done].tobytes())])
        ids = [d[0] for d in self.docs]
        batch = pa.record_batch([
            pa.array([ids[k] for k in doc.tolist()], kind), pa.array(start - (ends - here)[doc] + before[doc]), pa.array(stop - start), raw.cast(pa.binary()),
            pa.array(total[doc]), pa.array(seq + self.next), pa.array(start - seq_start[seq]),
        ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        self.next += len(cuts)
        first = int(np.searchsorted(ends, done, "right"))
        rest = self.docs[first:]
        if rest:
            d, b, h, t = rest[0]
            used = done - int(ends[first] - h)
            rest[0] = (d, b + used, h - used, t)
        self.ids, self.docs = self.ids[done:], rest
        return batch


_WORKER: dict[str, WordIds] = {}


def _words(spec: str, name: str) -> WordIds:
    """One word table per worker process and tokenizer."""
    if name not in _WORKER:
        _WORKER[name] = WordIds(spec)
    return _WORKER[name]


def packer(spec: Callable[[], str], name: str, kind: pa.DataType, length: int = LENGTH, end: int = END_ID) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task: batches of (id, text as binary) in, batches of pieces out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, ctx = _words(spec(), name), TaskContext.get()
        stream = _Stream(words, ctx.partitionId() if ctx else 0, length)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), pc.fill_null(b.column(1), b"")
            size = np.cumsum(pc.binary_length(texts).to_numpy())
            k = 0
            while k < len(ids):
                stop = int(np.searchsorted(size, (size[k - 1] if k else 0) + LOOKUP * 6)) + 1
                group = texts.slice(k, stop - k)
                stream.add(ids[k:stop], *words.documents(group.view(pa.string()), end))
                k += len(group)
                if len(stream.ids) >= CHUNK and (out := stream.flush(False, kind)) is not None:
                    yield out
        if (out := stream.flush(True, kind)) is not None:
            yield out

    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    ``tokenizer``: path of a ``tokenizers`` file whose words are split at white space;
    its content, of fixed size, is broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    with open(tokenizer) as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType
    schema = StructType([StructField("doc_id", kind), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType()),
                         StructField("doc_tokens", LongType()), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    rows = docs.select(docs[doc_id], docs[text].cast("binary"))
    return rows.mapInArrow(packer(lambda: spec.value, tokenizer, to_arrow_type(kind), length, end), schema)
