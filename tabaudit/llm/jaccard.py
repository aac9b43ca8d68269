"""N-gram Jaccard self-join by MinHash bands, with exact verification.

Documents are sets of ``WORDS``-word shingles. Documents of the same set are one node.
Each node has ``TREES`` bands of the same number of MinHash values, the most (up to
``DEPTH``) with which pairs at the threshold share a band with the target recall
(``prefix_depth``). Pairs that meet are verified on their whole shingle sets.

Pairs are never rows. A trie node's members are dealt into blocks, and the blocks of
each pair of blocks are compared in one task as a small matrix; a pair counts in the
first tree where it meets and nowhere else. Out of a comparison come, per member, the
number of documents it is linked with, and one edge to the smallest member it is
connected with. Trie nodes with thousands of members thus become many bounded tasks.
Counting the links of g near copies takes on the order of g^2 comparisons of bits, in
blocks; that is the price of an exact count.

Edge cases: one to four words are one shingle; a null text or one without words has no
shingles, is linked with nothing and is its own class; null ids stay and take their
class's smallest id; equal rows are copies of each other; an empty table gives an empty
result; other input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.functions.lineage import cut
from tabaudit.llm.graph import components
from tabaudit.llm.hashing import mix, window_hashes, window_starts, word_hashes

WORDS, TREES, DEPTH = 5, 16, 6
#: Similarity as a fraction (at least 4/5), and the share of pairs at it that must meet.
NEAR, RECALL = (4, 5), 0.9999
#: Members of a block; texts hashed at once (bytes).
BLOCK, GROUP_BYTES = 256, 4_000_000
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, (TREES, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(near: float, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix on which pairs of similarity ``near`` still meet in some tree with this recall."""
    while depth > 1 and 1 - (1 - near**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and their number per text."""
    h, counts = word_hashes(texts)
    size = np.minimum(counts, WORDS)
    starts = np.cumsum(counts) - counts
    at = window_starts(counts, WORDS)
    doc = np.searchsorted(np.cumsum(counts), at, "right")
    val = window_hashes(h, WORDS)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        one = np.array([mix(np.array([window_hashes(h[s : s + n], int(n))[0] + np.uint64(n)]))[0] for s, n in zip(starts[short], size[short])], dtype=np.uint64)
        val, doc = np.concatenate([val, one]), np.concatenate([doc, short])
    order = np.lexsort((val, doc))
    val, doc = val[order], doc[order]
    if len(val):
        new = np.ones(len(val), bool)
        new[1:] = (val[1:] != val[:-1]) | (doc[1:] != doc[:-1])
        val, doc = val[new], doc[new]
    return val, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def _groups(texts: list[bytes]) -> Iterator[slice]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_BYTES or i == len(texts) - 1:
            yield slice(at, i + 1)
            at, size = i + 1, 0


def _fingerprints(val: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that stand for a set; 0 for the empty one."""
    full, at = n > 0, np.cumsum(n) - n
    out = []
    for salt in (0x51ED2701, 0x2545F491):
        f = np.zeros(len(n), np.uint64)
        if len(val):
            f[full] = mix(np.add.reduceat(mix(val ^ np.uint64(salt)), at[full]) + n[full].astype(np.uint64))
        out.append(f.astype(np.int64))
    return out[0], out[1]


def _sign(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            for s in _groups(texts):
                val, n = shingle_sets(texts[s])
                f1, f2 = _fingerprints(val, n)
                full, at = n > 0, np.cumsum(n) - n
                keys = np.zeros((len(n), TREES), np.uint64)
                if len(val):
                    for t in range(TREES):
                        k = np.full(int(full.sum()), t + 1, np.uint64)
                        for d in range(depth):
                            k = mix(k * np.uint64(31) + np.minimum.reduceat(val * _FACTORS[t, d], at[full]))
                        keys[full, t] = k
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.astype(np.int64).ravel()), TREES).cast(pa.list_(pa.int64()))
                id_, digest = (b.column(k).slice(s.start, s.stop - s.start) for k in (0, 2))
                yield pa.record_batch([id_, digest, pa.array(n), pa.array(f1), pa.array(f2), lists], names=["id", "digest", "n", "node", "f2", "keys"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or b"" for x in b.column(0).to_pylist()]
        for s in _groups(texts):
            val, n = shingle_sets(texts[s])
            f1, _ = _fingerprints(val, n)
            ends = np.concatenate([[0], np.cumsum(n)])
            yield pa.record_batch([pa.array(f1), pa.array([val[a:z].astype("<u8").tobytes() for a, z in zip(ends, ends[1:])], pa.binary())], names=["node", "shingles"])


def _meet(keys: np.ndarray, side: np.ndarray, tree: int, two: bool) -> np.ndarray:
    """Pairs (i, j) that this unit compares: they meet in ``tree`` and in none before."""
    ok = np.triu(np.ones((len(side), len(side)), bool), 1)
    if two:
        ok &= side[:, None] != side[None, :]
    for t in range(tree):
        ok &= keys[:, None, t] != keys[None, :, t]
    return ok


def _units(b: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    at = {n: i for i, n in enumerate(b.schema.names)}
    for r in range(b.num_rows):
        rows = b.column(at["rows"])[r].values
        yield r, {n: rows.field(n) for n in [f.name for f in rows.type]} | {k: b.column(at[k])[r].as_py() for k in ("tree", "a", "b")}


def _keys(u: dict) -> np.ndarray:
    return u["keys"].flatten().to_numpy(zero_copy_only=False).reshape(-1, TREES)


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of units that have a pair to compare there."""
    for b in batches:
        rows, nodes = [], []
        for r, u in _units(b):
            ok = _meet(_keys(u), u["side"].to_numpy(), u["tree"], u["a"] != u["b"])
            hit = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
            rows.append(np.full(len(hit), r))
            nodes.append(u["node"].to_numpy()[hit])
        r = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        yield pa.record_batch([b.column(b.schema.get_field_index(k)).take(r) for k in ("key", "tree", "a", "b")] + [pa.array(np.concatenate(nodes) if nodes else np.zeros(0, np.int64))], names=["key", "tree", "a", "b", "node"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Common shingles of all pairs, over slices of the shingles that two members or more have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    val, inv, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    keep = n[inv] > 1
    col, row = place[inv[keep]], owner[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width, wide = 8192, int((n > 1).sum())
    for c in range(0, wide, width):
        a, z = np.searchsorted(col, [c, c + width])
        m = np.zeros((len(sets), min(width, wide - c)), np.float32)
        m[row[a:z], col[a:z] - c] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per unit and linked member: documents it is linked with, and the smallest member it is connected with."""
    for b in batches:
        out = [], [], []
        for _, u in _units(b):
            ok = _meet(_keys(u), u["side"].to_numpy(), u["tree"], u["a"] != u["b"])
            sets = [np.frombuffer(x.as_py(), "<u8") for x in u["shingles"]]
            size = np.array([len(s) for s in sets])
            common = _overlaps(sets)
            link = ok & (NEAR[1] * common >= NEAR[0] * (size[:, None] + size[None, :] - common))
            link |= link.T
            at = np.flatnonzero(link.any(axis=1))
            if not len(at):
                continue
            node, copies = u["node"].to_numpy(), u["copies"].to_numpy()
            root = node.copy()
            while True:  # spreads the smallest node over what is connected
                low = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1)
                new = np.minimum(root, low)
                if (new == root).all():
                    break
                root = new
            out[0].append(node[at])
            out[1].append((link[at] * copies[None, :]).sum(axis=1))
            out[2].append(root[at])
        yield pa.record_batch([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names=["node", "links", "root"])


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("binary"))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, class_id (smallest id of the documents it is connected with) and n_links
    (other documents of similarity NEAR or more, copies included)."""
    return _classes(docs, doc_id, text).select(F.col("id").alias(doc_id), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per input row: id, digest of its text, root (a node that stands for its class; null without shingles), class_id, n_links."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("binary").alias("text"), _digest(text).alias("digest"))
    kind = rows.schema["id"].dataType.simpleString()
    depth = prefix_depth(NEAR[0] / NEAR[1])
    signed = cut(rows.mapInArrow(_sign(depth), f"id {kind}, digest long, n long, node long, f2 long, keys array<bigint>"))
    # the set's 128 bits name a node; hot copies are aggregated before they move
    nodes = cut(signed.filter("n > 0").groupBy("node", "f2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("keys").alias("keys")))
    met = nodes.select("node", "copies", "keys", F.posexplode("keys").alias("tree", "key"))
    crowd = met.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = met.join(crowd, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    unit = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = unit.select("key", "tree", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"), "side", "node", "copies", "keys")
    unit = cut(unit)
    by = ["key", "tree", "a", "b"]
    light = unit.groupBy(*by).agg(F.collect_list(F.struct("node", "side", "keys")).alias("rows")).filter(F.size("rows") > 1)
    needed = cut(light.mapInArrow(_needed, "key long, tree int, a int, b int, node long"))
    wanted = needed.select("node").distinct().join(nodes.select("node", "least"), "node").select(F.col("least").alias("w")).distinct()
    sets = rows.join(wanted, F.col("id").eqNullSafe(F.col("w")), "left_semi").select("text").mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"])
    heavy = needed.join(unit.select("key", "a", "b", "node", "side", "copies", "keys"), ["key", "a", "b", "node"]).join(sets, "node")
    heavy = heavy.groupBy(*by).agg(F.collect_list(F.struct("node", "side", "copies", "keys", "shingles")).alias("rows"))
    found = cut(heavy.mapInArrow(_verify, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select("node", "least", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(least, "root").select(F.col("node").alias("m"), "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("id", "digest", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, F.col("node") == F.col("m"), "left")
    return out.select("id", "digest", "root", "class_id", "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id (a null id last), then the smallest digest
    of its text. Equal texts with the same id count as one, and so do those without shingles; of such rows the one stays
    whose columns have the smallest hash."""
    c = _classes(docs, doc_id, text)
    first = F.min(F.struct(F.col("id").isNull(), "id", "digest")).alias("k")
    keep = c.filter("root is not null").groupBy("root").agg(first).select("k.id", "k.digest").unionByName(c.filter("root is null").select("id", "digest").distinct())
    # rows of one id and text are told apart by all their columns; only those that nothing tells apart are compared whole
    here = docs.select("*", _digest(text).alias("__text"), F.xxhash64(*docs.columns).alias("__whole"))
    rows = here.groupBy(F.col(doc_id).alias("r_id"), F.col("__text").alias("r_digest"), F.col("__whole").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    rows = rows.groupBy("r_id", "r_digest").agg(F.min(F.struct("h", "n")).alias("x"))
    keep = cut(keep.join(rows, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("x.h").alias("__h"), F.col("x.n").alias("__n")))
    on = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")) & (F.col("__whole") == F.col("__h"))
    alone, repeated = (here.join(keep.filter(f), on, "left_semi") for f in ("__n = 1", "__n > 1"))
    return alone.unionByName(repeated.dropDuplicates([doc_id, "__text", "__whole"])).select(*docs.columns)
