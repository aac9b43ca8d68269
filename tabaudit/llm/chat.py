"""Chat formatting by token-level assembly.

Each turn is encoded by itself, segment by segment; reserved ids beyond the
vocabulary mark where a turn opens, where its text begins and where it closes, so no
content can produce them. Control strings (what reserved ids are rendered as) and
backslashes that occur in content are escaped by a backslash, so the rendered text
is unambiguous too and content comes back exactly. The loss mask marks the text of
assistant turns: +1 where a segment begins, -1 where it ends, summed up.

A conversation is one training sequence. Turns are encoded where they lie; then a
conversation's turns, as ids, meet in order in one task, which streams them: a
conversation of more than ``row_tokens`` ids is written as several rows of whole
turns (``part``), so memory stays bounded however long it is.

Edge cases: null role or text counts as empty; turns are ordered by turn (null
first), then role, then text, and equal rows are turns each; a null conv_id is a
conversation of its own; an empty table gives an empty result; other input columns
are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tabaudit.llm.native import text_of

#: Rendering of the reserved ids, in the order of their numbers after the vocabulary.
CONTROLS = ("<turn>", "<text>", "</turn>")
LEARNED_ROLE = "assistant"
ROW_TOKENS = 1 << 20
#: Characters that are encoded, and ids that are decoded, in one call of the tokenizer (one text or turn may have more).
CALL_CHARS, CALL_IDS = 1 << 18, 1 << 16
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_UNESCAPE = re.compile(r"\\(" + _ESCAPE.pattern + ")")


def escape(s: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], s)


def stretches(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of successive stretches of at most ``most`` in all; an item above that is a stretch of its own."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


class Codec:
    """A byte-level tokenizer and the reserved ids behind its vocabulary."""

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.open, self.text, self.close = range(size, size + 3)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]  # without places in the text

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


_WORKER: dict[str, Codec] = {}


def _codec(spec: Callable[[], str], name: str) -> Codec:
    if name not in _WORKER:
        _WORKER[name] = Codec(spec())
    return _WORKER[name]


def _chars(b: pa.RecordBatch) -> list[int]:
    return pc.add(pc.utf8_length(b.column(2)), pc.utf8_length(b.column(3))).to_pylist()


def _encoder(spec: Callable[[], str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(spec, name)
        for b in (b.slice(i, j - i) for b in batches for i, j in stretches(_chars(b), CALL_CHARS)):
            roles, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            r, t = c.encode([escape(x) for x in roles]), c.encode([escape(x) for x in texts])
            ids = [np.array([c.open, *x, c.text, *y, c.close], dtype="<u4").tobytes() for x, y in zip(r, t)]
            learn = [len(y) if role == LEARNED_ROLE else 0 for role, y in zip(roles, t)]
            yield pa.record_batch([*b.columns[:2], pa.array(roles), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts]), pa.array(ids, pa.binary()), pa.array(learn, pa.int32())],
                                  names=["conv_id", "turn", "role", "text_order", "ids", "learn"])

    return run


def _assembler(row_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, start, turns, size = None, 0, 0, [], 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(x for x, _ in turns), "<u4")
            ends = np.cumsum([len(x) // 4 for x, _ in turns])
            step = np.zeros(len(ids) + 1, np.int8)
            for e, (_, n) in zip(ends.tolist(), turns):
                if n:  # the text stands before the closing id
                    step[e - 1 - n] += 1
                    step[e - 1] -= 1
            mask = np.cumsum(step[:-1], dtype=np.int8)
            return pa.record_batch([pa.array([now], kind), pa.array([part], pa.int32()), pa.array([start], pa.int64()), pa.array([len(turns)], pa.int64()),
                                    pa.array([ids.tobytes()], pa.binary()), pa.array([np.packbits(mask.astype(bool)).tobytes()], pa.binary())],
                                   names=["conv_id", "part", "start", "n_turns", "ids", "loss_mask"])

        began = False
        for b in batches:
            kind = b.schema.field(0).type
            for conv, ids, learn in zip(*b.columns):
                conv, ids, learn = conv.as_py(), ids.as_py(), learn.as_py()
                fresh = not began or conv != now
                if turns and (fresh or size + len(ids) // 4 > row_tokens):
                    yield row()
                    part, start, turns, size = part + 1, start + size, [], 0
                if fresh:
                    now, part, start, began = conv, 0, 0, True
                turns.append((ids, learn))
                size += len(ids) // 4
        if turns:
            yield row()

    return run


def _with_spec(df: DataFrame, tokenizer: str) -> Callable[[], str]:
    with open(tokenizer) as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size
    return lambda: shared.value


def format_chat(conv: DataFrame, tokenizer: str, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """Rows conv_id, part, start, n_turns, ids (little-endian unsigned 32 bits), loss_mask (one bit an id).

    ``tokenizer``: path of a byte-level ``tokenizers`` file. The rows of a conversation
    lie in one partition, in order of ``part``.
    """
    kind = conv.schema["conv_id"].dataType
    rows = conv.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    schema = StructType([rows.schema["conv_id"], rows.schema["turn"], rows.schema["role"], StructField("text_order", rows.schema["text"].dataType), StructField("ids", BinaryType()), StructField("learn", IntegerType())])
    turns = rows.mapInArrow(_encoder(_with_spec(conv, tokenizer), tokenizer), schema)
    dealt = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text_order").select("conv_id", "ids", "learn")
    out = StructType([StructField("conv_id", kind), StructField("part", IntegerType()), StructField("start", LongType()), StructField("n_turns", LongType()), StructField("ids", BinaryType()), StructField("loss_mask", BinaryType())])
    return dealt.mapInArrow(_assembler(row_tokens), out)


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of what the formatted rows say, decoded and unescaped; parts are streamed in order."""
    spec = _with_spec(formatted, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _codec(spec, tokenizer)
        out: list[tuple] = []
        state = None

        def close() -> None:
            conv, turns, h, n, g, chars = state
            out.append((conv, turns, h.hexdigest(), n, g.hexdigest(), chars))

        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            cols = [b.column(n) for n in ("conv_id", "part", "ids", "loss_mask")]
            for conv, part, raw, bits in zip(*cols):  # a row at a time: some have millions of ids
                conv, part, raw, bits = conv.as_py(), part.as_py(), raw.as_buffer(), bits.as_buffer()
                if part == 0:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(raw, "<u4")
                mask = np.unpackbits(np.frombuffer(bits, np.uint8))[: len(ids)].astype(bool)
                o, t, e = (np.flatnonzero(ids == x) for x in (c.open, c.text, c.close))
                for i, j in stretches((e - o).tolist(), CALL_IDS):
                    roles = c.decode([ids[a + 1 : z].tolist() for a, z in zip(o[i:j], t[i:j])])
                    texts = c.decode([ids[a + 1 : z].tolist() for a, z in zip(t[i:j], e[i:j])])
                    for role, text in zip(roles, texts):
                        state[1] += 1
                        state[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                        state[5] += sum(map(len, CONTROLS)) + len(role) + len(text)
                # what is learned is read from the mask alone
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                first, last = edge[::2], edge[1::2]
                for i, j in stretches((last - first).tolist(), CALL_IDS):
                    for s in c.decode([ids[a:z].tolist() for a, z in zip(first[i:j], last[i:j])]):
                        s = unescape(s)
                        state[3] += len(s)
                        state[4].update(s.encode())
            if len(out) >= 10_000:
                yield batch(out, kind)
                out = []
        if state:
            close()
        if out:
            yield batch(out, kind)

    def batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    from pyspark.sql.types import StringType

    schema = StructType([formatted.schema["conv_id"], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])
    return formatted.mapInArrow(run, schema)
