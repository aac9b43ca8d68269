"""Plain versions of the operators, for small inputs."""
import math
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_classes(docs):
    """docs: list of (id, text). Per row: (class id, links)."""
    sets = [shingles(t) for _, t in docs]
    links = [{j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)} for i, a in enumerate(sets)]
    seen, out = {}, []
    for i in range(len(docs)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            low = min((docs[j][0] for j in group if docs[j][0] is not None), default=None)
            seen |= {j: low for j in group}
        out.append((seen[i], len(links[i])))
    return out


def base_scores(docs):
    toks = {k: words((t or "").translate(LOWER)) + [None] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    c = Counter(w for k in toks if not held[k] for w in toks[k])
    n, v = sum(c.values()), len(c)
    return {k: (held[k], len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for k, w in toks.items()}


def tree_scores(docs, least, divergence, weights, order=2):
    """log10 probability of each text: the suffix tree with dictionaries.

    It grows to ``order``, or without it as the operator's does, to the first length of which no context is kept.
    """
    if order is None:
        last, order = None, 1
        while True:
            out = tree_scores(docs, least, divergence, weights, order)
            if not any(len(c) == order for c in out[1]):
                return last or out
            last, order = out, order + 1
    toks = {k: words((t or "").translate(LOWER)) + [None] for k, t in docs.items()}
    train = [k for k in toks if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(tuple(toks[k][i - n : i + 1]) for k in train for i in range(len(toks[k])) for n in range(order + 1) if i >= n)
    size = sum(len(toks[k]) for k in train)
    types = sum(1 for g in count if len(g) == 1)
    kept = {}

    def p(gram, upto):
        out = (count[gram[-1:]] + 1) / (size + types + 1)
        for n in range(1, min(upto, len(gram) - 1) + 1):
            ctx = gram[-1 - n : -1]
            if ctx in kept:
                w = kept[ctx]
                out = w * count[gram[-1 - n :]] / count[ctx] + (1 - w) * out
        return out

    for n in range(1, order + 1):
        gains = {}
        for k in train:
            for i in range(n, len(toks[k])):
                g = tuple(toks[k][i - n : i + 1])
                if count[g[:-1]] >= least:
                    base, share = p(g, n - 1), (count[g] - 1) / max(count[g[:-1]] - 1, 1)
                    gains.setdefault(g[:-1], []).append([math.log(w * share / base + 1 - w) for w in weights])
        for ctx, rows in gains.items():
            total = np.sum(rows, axis=0)
            if total.max() >= divergence * len(rows):
                kept[ctx] = weights[int(total.argmax())]
    return {k: sum(math.log10(p(tuple(t[max(0, i - order) : i + 1]), order)) for i in range(len(t))) for k, t in toks.items()}, kept


def check_pieces(rows, docs, tokenizer, length=2048):
    """rows: op10's; docs: id -> list of texts. Returns padding per token."""
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(by) == set(docs)
    for k, texts in docs.items():
        want = []
        for t in texts:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want.append(ids)
        got = sorted(by[k], key=lambda r: r["start"])
        if len(texts) == 1:
            pos = 0
            for r in got:
                assert (r["start"], r["doc_tokens"]) == (pos, len(want[0]))
                pos += r["length"]
                assert zlib.crc32(want[0][r["start"] : pos].tobytes()) == r["ids_crc32"]
            assert pos == len(want[0])
        else:
            assert sum(r["length"] for r in got) == sum(map(len, want))
    total = padding = 0
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        pos = 0
        for r in s:
            assert r["offset"] == pos
            pos += r["length"]
        assert pos <= length
        total += pos
        padding += 0 if pos & (pos - 1) == 0 else length - pos
    return padding / total
