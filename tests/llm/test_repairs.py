"""Conversation repair: the matrix products against a plain search, and edge rows."""
import hashlib
import re
import zlib
from itertools import product as cross

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.llm import repairs

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def matrix_edits(symbols, rules=()):
    of = repairs.matrices(tuple(rules))
    q = repairs.compress("".join(chr(0xE000 + s) for s in symbols), tuple(rules))
    m = repairs.product(repairs._times(q, of), repairs.INSERTS) if q else repairs.INSERTS
    cost, rope = m[0][repairs._best_end(m[0])]
    return cost, "".join(repairs._leaves(rope))


def all_edits(symbols, most):
    """Every edit string up to a length, its cost if it is legal."""
    best = None
    for n in range(len(symbols), most + 1):
        for edits in cross("DIKR", repeat=n):
            if sum(e != "I" for e in edits) != len(symbols):
                continue
            at, cost, options = 0, 0, [""]
            for e in edits:
                if e == "I":
                    cost, options = cost + 2, [o + r for o in options for r in "ua"]
                    continue
                s = symbols[at]
                at += 1
                if e == "D":
                    cost += 3
                    continue
                if s == 8:
                    break
                cost += (s // 4) + (2 if e == "R" else 0)
                options = [o + r for o in options for r in ("ua" if e == "R" else "suao"[s % 4])]
            else:
                if any(LEGAL.match(o) for o in options):
                    best = min(best or (cost, "".join(edits)), (cost, "".join(edits)))
    return best


@pytest.mark.parametrize("symbols", [[], [2], [8], [1, 2], [2, 1], [0, 2, 1], [5, 5], [1, 1, 2], [7, 4, 6], [0, 0, 2], [6, 8, 1], [3, 1, 5]])
def test_against_all_edits(symbols):
    assert matrix_edits(symbols) == all_edits(symbols, len(symbols) + 3)


def plain(rows):
    """rows of one conversation after damage, in order: (turn, role, text)."""
    add = lambda v, c, e: (v[0] + c, v[1] + e) if v else None
    least = lambda *x: min((v for v in x if v), default=None)

    def closed(p):
        return [p[0], p[1], least(p[2], add(p[0], 2, "I"), add(p[1], 2, "I"), add(p[3], 2, "I")), least(p[3], add(p[2], 2, "I"), add(p[0], 4, "II"), add(p[1], 4, "II"))]

    p, faults, seen = [(0, ""), None, None, None], [], set()
    for _, role, text in rows:
        words = brute.WORD.findall(text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1][-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        q, ok, tr, c = closed(p), fault in ("", "truncated"), int(fault == "truncated"), role[:1]
        to_u = least(q[0], q[1], q[3])
        p = [add(q[0], 3, "D"), least(add(q[1], 3, "D"), add(q[0], tr, "K") if ok and c == "s" else None),
             least(add(q[2], 3, "D"), add(to_u, tr + 2 * (c != "u"), "K" if c == "u" else "R") if ok else None),
             least(add(q[3], 3, "D"), add(q[2], tr + 2 * (c != "a"), "K" if c == "a" else "R") if ok else None)]
    q = closed(p)
    cost, edits = least(q[0], q[3])
    lines, at, now = [], 0, ""
    for e in edits:
        role, text = rows[at][1:] if e != "I" else ("", "")
        at += e != "I"
        if e != "D":
            now = "s" if e == "K" and not now and role[:1] == "s" else "a" if now == "u" else "u"
            lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[now]) + ":" + text)
    turns = [t for t, _, _ in rows if t is not None]
    ini = [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:])), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1))
    for v in out.values():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return out


def frame(spark, rows):
    clash = ["partition", "segment", "edge", "symbols", "row", "marker", "digest", "copies", "key", "cost", "audit"]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("clash").alias(c) for c in clash])


def made(n, seed):
    rng = np.random.default_rng(seed)
    texts = ["Fine.", "Why?", "cut off", "", " \t", "Fine.", "No!", "Yes .\n", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", "User"]
    rows = []
    for c in range(n):
        for t in range(rng.integers(1, 9)):
            rows.append((c, t if rng.random() < 0.9 else t + 2, roles[rng.choice(6, p=[0.4, 0.38, 0.1, 0.06, 0.03, 0.03])], texts[rng.integers(9)] + (f" {t}." if rng.random() < 0.4 else "")))
    rows += [(None, None, None, None), (None, 3, "user", "a?"), (None, None, "user", "hello."), (None, 1, None, "x."), (None, 1, None, "x."), (None, 1, None, "y."), (-1, None, "user", None)]
    return rows


@pytest.mark.parametrize("most_rows", [repairs.SEGMENT_ROWS, 3])
def test_against_the_plain_version(spark, most_rows):
    rows = made(150, 5) + [(1000, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 40}" + "." * (t % 7 > 0)) for t in range(700)]
    out = repairs.repair(repairs.with_damage(frame(spark, rows)), most_rows)
    got = {r["conv_id"]: tuple(r[1:]) for r in out.collect()}
    want = {c: plain(v) for c, v in damaged(rows).items()}
    assert got == want and len(got) == out.count()


def test_grammar_is_small_and_shared(spark):
    q = "".join(chr(0xE000 + s) for s in (0, 1, 2, 1, 2))
    rules = repairs.learn_grammar(spark.createDataFrame([(q,)] * 5 + [(q[1:] * 50,)], "symbols string"))
    assert 2 < len(rules) < 12 and len(repairs.compress(q[1:] * 50, rules)) <= 4
    assert matrix_edits([1, 2] * 100, rules) == (0, "K" * 200)


def test_no_rows(spark):
    assert repairs.repair(repairs.with_damage(frame(spark, []))).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    out = repairs.repair(repairs.with_damage(frame(spark, [(5, gone, "user", "x.")]))).collect()
    assert [tuple(r) for r in out] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
