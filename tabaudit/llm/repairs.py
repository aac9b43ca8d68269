"""Repair of conversation structure by a grammar-compressed dynamic programme.

A row is a symbol: what its role begins with (system, user, assistant, other) and
whether it has to go (blank or a repetition) or is truncated. The cheapest edits that
bring a conversation to the role initials ``(s?(ua)+)?`` are a product of one 4 x 4 matrix
a symbol over (cost, edits), with the states nothing, s, u, a: minimum for sum, and
concatenation for product. Equal costs go to the ASCII-least edits; from one state equal
costs never have edits of which one begins with the other (more edits of that kind are
inserts and cost more), so this order is kept by concatenation and products may be formed
in any grouping.

That is used twice. Symbol sequences of all conversations are compressed by one Re-Pair
grammar: the commonest neighbours, counted over the corpus, become a rule, and rules pair
in turn. Each rule's matrix is computed once, bottom-up, its edits held as a rope (two
ropes of its parts), and serves every conversation it occurs in. And a long conversation
is cut into segments, which are whole matrices themselves.

Rows are dealt by ranges of (conversation, turn, role, digest of the text, row), so a
conversation with a third of all rows lies in many tasks; a row that repeats an earlier
one is found by an aggregation of digests and told by a marker that sorts beside it, so
texts are shuffled once. A conversation that lies within one segment is repaired where it
is; of the others only compressed segments meet, in order, as a single result (one string
of edits, one digest) is asked for each; their texts are streamed.

Bounds: the grammar has at most ``RULES`` rules (what is not compressed is only multiplied
symbol by symbol), segments ``SEGMENT_ROWS`` rows or about ``SEGMENT_CHARS`` characters.

Edge cases: a null role or text is one space, a null turn comes first, null ids are one
conversation; equal turns are ordered by role, then by digest of the text; a conversation
without rows (see ``dropped``) gives zeros, no edits and the digest of nothing; an empty
table gives an empty result; other input columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabaudit.functions.lineage import cut
from tabaudit.llm.skew import join_hot

ROLES = {"s": 0, "u": 1, "a": 2}
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 20
RULES, ROUNDS, LEAST_PAIRS = 2048, 14, 2
_START, _S, _U, _A = range(4)
#: Symbols are characters of the private area: role class + 4 if truncated, 8 for a row that has to go; then the rules.
_BASE, _GONE, _SYMBOLS = 0xE000, 8, 9
_WORD, _LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
_NEXT = {_START: _U, _S: _U, _U: _A, _A: _U}


# ---- ropes and matrices

def _leaves(rope) -> Iterator[str]:
    todo = [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo += (x[1], x[0])


def _join(a, b):
    return b if a == "" else a if b == "" else (a, b)


def _less(a, b) -> bool:
    """Whether rope a spells less than rope b; shared parts are not read."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, str) and isinstance(y, str):
            k = min(len(x), len(y))
            if x[:k] != y[:k]:
                return x[:k] < y[:k]
            if len(x) > k:
                left.append(x[k:])
            if len(y) > k:
                right.append(y[k:])
        elif isinstance(x, str):
            left.append(x)
            right += (y[1], y[0])
        else:
            right.append(y)
            left += (x[1], x[0])
    return not left and bool(right)


def _better(new, old) -> bool:
    return old is None or new[0] < old[0] or new[0] == old[0] and _less(new[1], old[1])


def product(a: list, b: list) -> list:
    """Min-plus product of matrices of (cost, rope) or None."""
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if (x := a[i][k]) is not None:
                for j in range(4):
                    if (y := b[k][j]) is not None and (out[i][j] is None or x[0] + y[0] <= out[i][j][0]):
                        z = (x[0] + y[0], _join(x[1], y[1]))
                        if _better(z, out[i][j]):
                            out[i][j] = z
    return out


def _inserts() -> list:
    out = [[None] * 4 for _ in range(4)]
    for i in range(4):
        at, n = i, 0
        while out[i][at] is None:
            out[i][at] = (INSERT * n, "I" * n)
            at, n = _NEXT[at], n + 1
    return out


INSERTS = _inserts()


def symbol_matrix(symbol: int) -> list:
    """Any inserts, then one edit of the row."""
    m = [[None] * 4 for _ in range(4)]
    role, more = symbol % 4, TRUNCATED * (symbol // 4 == 1)

    def offer(i: int, j: int, cost: int, edit: str) -> None:
        if _better((cost, edit), m[i][j]):
            m[i][j] = (cost, edit)

    for i in range(4):
        offer(i, i, DELETE, "D")
        if symbol != _GONE:
            to = _NEXT[i]
            offer(i, to, more, "K") if role == (1 if to == _U else 2) else offer(i, to, REROLE + more, "R")
            if role == 0 and i == _START:
                offer(i, _S, more, "K")
    return product(INSERTS, m)


@lru_cache(maxsize=4)
def matrices(rules: tuple) -> list:
    """Matrices of all symbols, then of the rules, each from its two parts."""
    out = [symbol_matrix(s) for s in range(_SYMBOLS)]
    for a, b in rules:
        out.append(product(out[a], out[b]))
    return out


def _times(sequence: str, of: list) -> list | None:
    m = None
    for c in sequence:
        x = of[ord(c) - _BASE]
        m = x if m is None else product(m, x)
    return m


def _best_end(row: list) -> int:
    """The final state (nothing or a) that is cheapest."""
    a, b = row[_START], row[_A]
    return _A if a is None or b is not None and _better(b, a) else _START


# ---- rows to segments

def with_damage(conv: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32('conv_id:turn') mod 20 (copies 0: dropped)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    return conv.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Each copy a row of its own, with a number and the digest of its text; written once, so that numbers stay."""
    many = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role"), "text", F.explode(F.sequence(F.lit(0), F.greatest("copies", F.lit(1)) - 1)).alias("copy"), (F.col("copies") == 0).alias("dropped"))
    digest = F.when(F.col("dropped"), F.lit("")).otherwise(F.sha2("text", 256))
    return cut(many.select("conv_id", "turn", "role", F.when(~F.col("dropped"), F.col("text")).alias("text"), digest.alias("digest"), "dropped", F.monotonically_increasing_id().alias("row")))


def _repeats(rows: DataFrame) -> DataFrame:
    """The rows whose role and text an earlier row of the conversation has, without texts."""
    key = F.sha2(F.concat(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")), F.lit("\n"), F.col("digest"), F.col("role")), 256)
    keyed = rows.filter("not dropped").select("conv_id", "turn", "role", "digest", "row", key.alias("key"), F.struct("turn", "row").alias("at"))
    first = cut(keyed.groupBy(F.col("key").alias("f_key")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    total = first.agg(F.sum("members")).first()[0] or 0
    return join_hot(keyed, first, "key", "f_key", "members", total).filter(F.col("at") != F.col("first"))


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc(), F.col("row").asc(), F.col("marker").desc()]


_SEGMENT_FIELDS = [("partition", "int"), ("segment", "int"), ("edge", "boolean"), ("symbols", "string"), ("roles", "array<string>"), ("texts", "array<string>"), ("first_turn", "bigint"), ("last_turn", "bigint"), ("changes", "bigint"),
                   ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"), ("first_initial", "string"), ("last_initial", "string")]
_LEGAL = {"su", "ua", "au"}


def _typed(fields: list[tuple[str, str]], head: T.StructField) -> T.StructType:
    out = T.StructType([head])
    for name, kind in fields:
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


class _Segment:
    def __init__(self, conv, part: int, number: int) -> None:
        self.conv, self.part, self.number, self.edge = conv, part, number, False
        self.symbols, self.roles, self.texts, self.chars = [], [], [], 0
        self.turns: list = [None, None, 0]  # first, last, changes between
        self.faults, self.illegal = [0, 0, 0], 0

    def add(self, turn, role: str, text: str, repeated: bool) -> None:
        blank, last = not _WORD.search(text), _LAST.search(text)
        fault = 0 if blank else 1 if repeated else 2 if last[1] not in ".!?" else None
        if fault is not None:
            self.faults[fault] += 1
        self.symbols.append(chr(_BASE + (_GONE if fault in (0, 1) else ROLES.get(role[:1], 3) + 4 * (fault == 2))))
        if self.roles and self.roles[-1][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.roles.append(role)
        self.texts.append("" if fault in (0, 1) else text)  # it goes in any case
        self.chars += len(text)
        if turn is not None:
            if self.turns[0] is None:
                self.turns = [turn, turn, 0]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]

    def row(self) -> tuple:
        ends = [self.roles[0][:1], self.roles[-1][:1]] if self.roles else [None, None]
        return (self.conv, self.part, self.number, self.edge, "".join(self.symbols), self.roles, self.texts, *self.turns, *self.faults, self.illegal, *ends)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _assembler(schema: T.StructType, most_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kinds, part, now, waiting, size, marked, begun = _arrow(schema), TaskContext.get().partitionId(), None, [], 0, None, False
        for b in batches:
            for conv, turn, role, text, dropped, row, marker in zip(*[b.column(i).to_pylist() for i in range(7)]):
                if now is None or conv != now.conv:
                    if now is not None:
                        now.edge = now.edge or not begun  # an earlier task may hold more of it
                        begun = True
                        waiting.append(now.row())
                        size += now.chars + 50 * len(now.roles)
                    now = _Segment(conv, part, now.number + 1 if now else 0)
                elif len(now.symbols) >= most_rows or now.chars >= SEGMENT_CHARS:
                    now.edge = True
                    waiting.append(now.row())
                    size += now.chars + 50 * len(now.roles)
                    now = _Segment(conv, part, now.number + 1)
                    now.edge = True
                if size >= SEGMENT_CHARS:
                    yield _batch(waiting, kinds)
                    waiting, size = [], 0
                if marker:
                    marked = row
                elif not dropped:
                    now.add(turn, role, text, marked == row)
        if now is not None:
            now.edge = True  # a later task may hold more of it
            waiting.append(now.row())
        if waiting:
            yield _batch(waiting, kinds)

    return run


def segments(rows: DataFrame, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows of with_damage() as segments of conversations, in order, written; ``edge`` marks those that may not be a whole conversation."""
    numbered = _numbered(rows)
    marks = _repeats(numbered).select("conv_id", "turn", "role", F.lit(None).cast("string").alias("text"), "digest", F.lit(False).alias("dropped"), "row", F.lit(1).alias("marker"))
    both = numbered.withColumn("marker", F.lit(0)).unionByName(marks)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(parts, *_order()[:-1]).sortWithinPartitions(*_order())
    schema = _typed(_SEGMENT_FIELDS, T.StructField("conv_id", rows.schema["conv_id"].dataType))
    return cut(dealt.select("conv_id", "turn", "role", "text", "dropped", "row", "marker").mapInArrow(_assembler(schema, most_rows), schema))


# ---- the grammar

def learn_grammar(sequences: DataFrame, column: str = "symbols") -> tuple:
    """Re-Pair rules (left, right) over all sequences, in order of their making.

    A round counts neighbours over the corpus and makes rules of the commonest that have
    no symbol in common, so that they can be replaced in any order. Neighbours that
    overlap (aaa) are counted twice, which matters for the choice only.
    """
    now = cut(sequences.filter(F.length(column) > 1).groupBy(F.col(column).alias("q")).agg(F.count(F.lit(1)).alias("n")))
    rules: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        pairs = now.filter(F.length("q") > 1).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("q") - 1), lambda i: F.substr("q", i, F.lit(2)))).alias("pair"))
        counts = pairs.groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_PAIRS).orderBy(F.col("n").desc(), "pair").limit(RULES)
        used, new = set(), []
        for r in counts.collect():  # RULES rows at most
            if not used & set(r["pair"]) and len(rules) + len(new) < RULES:
                used |= set(r["pair"])
                new.append(r["pair"])
        if not new:
            break
        q = F.col("q")
        for pair in new:
            q = F.replace(q, F.lit(pair), F.lit(chr(_BASE + _SYMBOLS + len(rules))))
            rules.append((ord(pair[0]) - _BASE, ord(pair[1]) - _BASE))
        now = cut(now.select(q.alias("q"), "n"))
    return tuple(rules)


def compress(sequence: str, rules: tuple) -> str:
    """The sequence with the rules applied in the order of their making."""
    if len(sequence) > 1:
        for k, (a, b) in enumerate(rules):
            pair = chr(_BASE + a) + chr(_BASE + b)
            if pair in sequence:
                sequence = sequence.replace(pair, chr(_BASE + _SYMBOLS + k))
                if len(sequence) == 1:
                    break
    return sequence


# ---- repair

def _repaired(roles: list[str], texts: list[str], edits: str, state: int) -> tuple[list[str], int]:
    """role:text lines, and the state after them."""
    out, at = [], 0
    for e in edits:
        if e != "I":
            role, text = roles[at], texts[at]
            at += 1
        if e == "D":
            continue
        if e == "K" and state == _START and role[:1] == "s":
            state = _S
        else:
            state = _NEXT[state]
        if e == "K":
            out.append(f"{role}:{text}")
        else:
            out.append(("user" if state == _U else "assistant") + ":" + ("" if e == "I" else text))
    return out, state


def _gaps(first, last, changes: int) -> int:
    return 0 if first is None else last - first + 1 - (changes + 1)


_RESULT_FIELDS = [("gaps", "bigint"), ("blank", "bigint"), ("duplicate", "bigint"), ("truncated", "bigint"), ("illegal", "bigint"), ("cost", "bigint"), ("audit", "string"), ("repaired_sha256", "string")]


def _solve_whole(rules: tuple, schema: T.StructType):
    """Conversations that are one segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kinds, known = matrices(rules), _arrow(schema), {}
        for b in batches:
            col, out = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}, []
            for k, q in enumerate(col["symbols"]):
                if q not in known:
                    if len(known) > 50_000:
                        known.clear()
                    m = product(_times(compress(q, rules), of), INSERTS) if q else INSERTS
                    end = _best_end(m[_START])
                    known[q] = m[_START][end][0], "".join(_leaves(m[_START][end][1]))
                cost, edits = known[q]
                lines, _ = _repaired(col["roles"][k], col["texts"][k], edits, _START)
                out.append((col["conv_id"][k], _gaps(col["first_turn"][k], col["last_turn"][k], col["changes"][k]), *[col[n][k] for n in ("blank", "duplicate", "truncated", "illegal")], cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
            if out:
                yield _batch(out, kinds)

    return run


_PIECE_FIELDS = [("partition", "int"), ("segment", "int"), ("state", "int"), ("edits", "string"), ("totals", "array<bigint>")]


def _solve_long(rules: tuple, schema: T.StructType):
    """Edits of each segment of conversations whose compressed segments come in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kinds, rows = matrices(rules), _arrow(schema), []

        def done() -> Iterator[pa.RecordBatch]:
            # forwards: the best way to each state; backwards: which states it went through
            best, ways = [(0, ""), None, None, None], []
            mats = [_times(r["symbols"], of) if r["symbols"] else None for r in rows]
            for k, m in enumerate(mats):
                last = product(m, INSERTS) if m is not None and k == len(mats) - 1 else m if m is not None else INSERTS if k == len(mats) - 1 else None
                mats[k] = last
                new, via = [None] * 4, [None] * 4
                for i in range(4):
                    for j in range(4):
                        x = best[i] and ((last[i][j]) if last is not None else (0, "") if i == j else None)
                        if x and _better(z := (best[i][0] + x[0], _join(best[i][1], x[1])), new[j]):
                            new[j], via[j] = z, i
                best = new
                ways.append(via)
            end = _best_end(best)
            path = [end]
            for via in reversed(ways):
                path.append(via[path[-1]])
            path.reverse()
            totals = [sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal")]
            turned = [r for r in rows if r["first_turn"] is not None]
            spoken = [r for r in rows if r["first_initial"] is not None]
            totals[3] += sum(a["last_initial"] + b["first_initial"] not in _LEGAL for a, b in zip(spoken, spoken[1:]))
            changes = sum(r["changes"] for r in turned) + sum(a["last_turn"] != b["first_turn"] for a, b in zip(turned, turned[1:]))
            gaps = _gaps(turned[0]["first_turn"], turned[-1]["last_turn"], changes) if turned else 0
            out = []
            for k, (r, i, j, m) in enumerate(zip(rows, path, path[1:], mats)):
                edits = "".join(_leaves(m[i][j][1])) if m is not None else ""
                out.append((r["conv_id"], r["partition"], r["segment"], i, edits, [gaps, *totals, best[end][0]] if k == 0 else None))
                if len(out) >= 1000:
                    yield _batch(out, kinds)
                    out = []
            if out:
                yield _batch(out, kinds)

        for b in batches:
            names = b.schema.names
            for values in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                r = dict(zip(names, values))
                if rows and r["conv_id"] != rows[0]["conv_id"]:
                    yield from done()
                    rows = []
                r["symbols"] = compress(r["symbols"], rules)
                rows.append(r)
        if rows:
            yield from done()

    return run


def _apply_pieces():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            lines = ["\n".join(_repaired(r, t, e, s)[0]) for r, t, e, s in zip(col["roles"], col["texts"], col["edits"], col["state"])]
            kept = [any(x != "D" for x in e) for e in col["edits"]]
            yield pa.record_batch([*[b.column(b.schema.names.index(n)) for n in ("conv_id", "partition", "segment", "edits", "totals")], pa.array(lines, pa.string()), pa.array(kept)],
                                  names=["conv_id", "partition", "segment", "edits", "totals", "lines", "kept"])

    return run


def _finish(schema: T.StructType):
    """One row a conversation from its repaired segments, which come in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, now, out = _arrow(schema), None, []

        def close() -> None:
            conv, totals, audit, digest, _ = now
            out.append((conv, *totals, "".join(audit), digest.hexdigest()))

        for b in batches:
            for conv, edits, totals, lines, kept in zip(*[b.column(b.schema.names.index(n)).to_pylist() for n in ("conv_id", "edits", "totals", "lines", "kept")]):
                if totals is not None:  # its first segment
                    if now:
                        close()
                    now = [conv, totals, [], hashlib.sha256(), False]
                now[2].append(edits)
                if kept:
                    now[3].update((("\n" if now[4] else "") + lines).encode())
                    now[4] = True
            if len(out) >= 1000:
                yield _batch(out, kinds)
                out = []
        if now:
            close()
        if out:
            yield _batch(out, kinds)

    return run


def repair(rows: DataFrame, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows``: conv_id, turn, role, text, copies (how often the row stands there; 0 keeps only the conversation).
    """
    seg = segments(rows, most_rows)
    rules = learn_grammar(seg)
    head = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    result = _typed(_RESULT_FIELDS, head)
    whole = seg.filter("not edge").mapInArrow(_solve_whole(rules, result), result)
    narrow = [c for c in seg.columns if c not in ("roles", "texts", "edge")]
    order = ["conv_id", "partition", "segment"]
    edge = seg.filter("edge")
    piece = _typed(_PIECE_FIELDS, head)
    pieces = edge.select(*narrow).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_solve_long(rules, piece), piece)
    joined = edge.select("conv_id", "partition", "segment", "roles", "texts").join(pieces.drop("conv_id"), ["partition", "segment"])
    lined = _typed([("partition", "int"), ("segment", "int"), ("edits", "string"), ("totals", "array<bigint>"), ("lines", "string"), ("kept", "boolean")], head)
    long = joined.mapInArrow(_apply_pieces(), lined).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_finish(result), result)
    return whole.unionByName(long)
