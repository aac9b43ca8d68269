"""Bytes in repeated strings, against a plain version."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.llm import suffixes


def plain(texts, length=suffixes.LENGTH):
    """Per text: n_bytes, n_removed, n_spans, kept bytes."""
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [np.zeros(len(t) + 1, bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    return [(len(t), int(g.sum()), int((np.diff(g.astype(int)) == -1).sum()), bytes(np.frombuffer(t, np.uint8)[~g[:-1]])) for t, g in zip(texts, gone)]


def made(seed, n=70):
    rng = np.random.default_rng(seed)
    word = lambda k: bytes(rng.integers(97, 123, k, dtype=np.uint8))
    passages = [word(int(k)) for k in (150, 199, 200, 201, 230, 350, 600, 1500)]
    texts = [b"", b"short", b"a" * 150, b"a" * 700, b"a" * 900, b"ab" * 400, b"ab" * 99 + b"a", "é中\U0001f600".encode() * 80, "é中\U0001f600".encode() * 40]
    for _ in range(n):
        t = b""
        for _ in range(rng.integers(1, 6)):
            p = passages[rng.integers(len(passages))]
            a = int(rng.integers(0, 40)) * int(rng.random() < 0.5)
            z = len(p) - int(rng.integers(0, 120)) * int(rng.random() < 0.5)
            t += [word(int(rng.integers(0, 300))), p[a:z], p][rng.integers(3)]
        if t and rng.random() < 0.3:
            b = bytearray(t)
            b[rng.integers(len(b))] = 33
            t = bytes(b)
        texts.append(t)
    return texts + texts[20:23]


def rows_of(spark, texts):
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "doc_id long, text binary").repartition(3)
    return df.select("doc_id", F.col("text").cast("string").alias("text"), *[F.lit("clash").alias(c) for c in ("id", "block", "texts", "kept", "removed", "n_bytes")])


@pytest.mark.parametrize("buffer", [suffixes.BUFFER, 300])
def test_against_the_plain_version(spark, buffer, monkeypatch):
    monkeypatch.setattr(suffixes, "BUFFER", buffer)
    for seed in (1, 2, 3):
        texts = made(seed)
        assert local(texts) == plain(texts)


def local(texts):
    """The rounds in one process, each text a block of its own or all one block."""
    cutting = suffixes.Slicing(10_000)
    blocks = [texts[: len(texts) // 2], *[[t] for t in texts[len(texts) // 2 :]]]
    said = [{} for _ in blocks]
    for level in range(len(suffixes.STEPS)):
        sent = [(b, e) for b, t in enumerate(blocks) for e in suffixes._View(t, said[b], cutting, level).entries(b)]
        for kind in {e[0] for _, e in sent}:
            mine = [(b, e) for b, e in sent if e[0] == kind]
            keys = [np.cumsum(suffixes.unplanes(e[3], np.uint64), dtype=np.uint64) for _, e in mine]
            n = np.array([len(k) for k in keys])
            out, _, _ = suffixes._combine(kind, np.unique(np.concatenate(keys), return_inverse=True)[1], [e[4] for _, e in mine], np.zeros(0), n)
            for (b, _), part in zip(mine, np.split(out, np.cumsum(n)[:-1])):
                said[b][kind] = [part.tobytes()]
    got = []
    for b, t in enumerate(blocks):
        for x, runs in zip(t, suffixes._View(t, said[b], cutting, len(suffixes.STEPS)).removed()):
            ends = [0, *runs[:, 1].tolist()]
            kept = b"".join(x[a:z] for a, z in zip(ends, [*runs[:, 0].tolist(), len(x)]))
            got.append((len(x), len(x) - len(kept), len(runs), kept))
    return got


def test_on_spark(spark):
    texts = [t for t in made(4, 120)]
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in suffixes.remove_repeats(rows_of(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == plain(texts)


def test_edges(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, None), (1, ""), (None, "x" * 300), (2, "y" * 199), (3, long), (4, long), (4, long[:100_000])]
    out = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["removed"])) for r in out) == sorted((str(i), len(t or ""), 0 if len(t or "") < 200 else len(t), int(len(t or "") >= 200)) for i, t in rows)
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    from tabaudit.llm.queries import all_queries

    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {d: (*r[:3], hashlib.sha256(r[3]).hexdigest()) for (d, _), r in zip(docs, plain([t for _, t in docs]))}
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in all_queries()["op11_suffix_dedup"](spark, folder).collect()}
    assert got == want and sum(r[1] for r in got.values()) > 0
