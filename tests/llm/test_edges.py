"""Nulls, empty and very long texts, ties and repeated rows, empty tables, clashing column names."""
import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabaudit.llm import chat, exact, graph, jaccard, lines, mixing, packing, quality, substring, suffix_tree, urls
from tabaudit.llm.queries import vocabulary

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
LINE = "one two three four five six seven"
ROWS = [
    (3, "same text here for all of us to read", "b"), (1, "same  text\there for all of us to read", "a"), (1, "same  text\there for all of us to read", "a"),
    (2, None, None), (4, "", "b"), (5, " \t ", "b"), (None, "same text here for all of us to read", None), (6, LONG, "c"), (7, LONG, "c"),
    (8, "İŞ Σίσυφος it's 12\u00a0ok <|endoftext|> a|b " + "x" * 5000, "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with outputs and with names used inside
    d = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    clash = ["id", "node", "keep_id", "n_words", "size", "target", "kept", "class_id", "rule", "host", "n_lines", "taken", "_w", "h", "best", "sha", "repetitions"]
    return d.select("*", *[F.lit("clash").alias(c) for c in clash])


def test_exact(docs):
    rows = exact.exact_groups(docs).collect()
    assert len(rows) == len(ROWS)
    same = [r for r in rows if r["keep_id"] == 1]
    assert len(same) == 4 and {r["group_size"] for r in same} == {4} and sum(r["kept"] for r in same) == 1
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == [1, 2, 5, 6, 8]


def test_exact_with_a_full_filter(docs, spark):
    """A filter far too small lets everything through to the exact step."""
    many = spark.range(3000).select("id", F.concat(F.lit("t"), (F.col("id") % 2900).cast("string")).alias("text"))
    rows = exact.exact_groups(many, "id", "text", max_bits=1 << 8)
    assert rows.filter("kept").count() == 2900


def test_quality(docs):
    out = quality.quality(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ROWS) and rows[2]["n_words"] == 0 and not rows[2]["kept"] and rows[6]["n_words"] == 30_000
    w = brute.words(LONG)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    assert rows[6]["n_repeat_words"] == len({i + k for s in at.values() if len(s) > 1 for i in s for k in range(3)})


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {0}
    assert sum(r["repetitions"] for r in rows) == mixing.repeated(docs).count()


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.COM/En/x"), (4, "x://a.b.com/en?q"), (5, "http://a.b.com/en/" + "d/" * 3000), (6, "http://b.com."), (6, "http://b.com")], "page_id int, url string").withColumn("rule", F.lit(0))
    rules = spark.createDataFrame([("com", "/", "allow"), ("b.com", "/e", "block"), ("b.com", "/en/d", "allow"), (None, None, "block"), ("b.com", "", None)], "host string, path string, action string")
    got = {(r["page_id"], r["host"]): (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()}
    assert got == {(1, ""): ("", "block"), (2, ""): ("", "block"), (3, "a.example.com"): ("com/", "allow"), (4, "a.b.com"): ("b.com/e", "block"), (5, "a.b.com"): ("b.com/en/d", "allow"), (6, "b.com."): ("", "block"), (6, "b.com"): ("b.com", "allow")}
    assert urls.filter_urls(pages, rules.limit(0)).filter("verdict = 'allow' and rule is null").count() == 7


def test_lines(spark):
    rows = [(1, f"{LINE}\n\nshort line"), (2, f"one two three four five six 7\nshort line\n{LINE} eight"), (3, "one two 3 four five six 7"), (4, f"{LINE}\n{LINE}"), (5, None), (5, None), (6, "short lime")]
    out = {(r["id"]): (r["n_lines"], r["kept"]) for r in lines.judge_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (3, [0, 1, 2]), 2: (3, []), 3: (1, []), 4: (2, []), 5: (1, [0]), 6: (1, [0])}
    texts = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x"))).collect()}
    assert texts[1] == rows[0][1] and texts[2] == "" and texts[6] == "short lime"


def test_lines_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 50, n)] for n in rng.integers(5, 14, 12)]
    made = []
    for _ in range(160):
        w = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 3)):
            i = rng.integers(len(w))
            w[i : i + 1] = [[], [w[i], "new"], [f"z{rng.integers(4)}"]][rng.integers(3)]
        made.append(" ".join(w))

    def near(a, b):
        if a == b:
            return True
        a, b = a.split(), b.split()
        if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        d = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (x != y)))
            d = np.array(new)
        return d[-1] <= 1

    want = [not any(near(made[j], made[i]) for j in range(i)) for i in range(len(made))]
    out = lines.judge_lines(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    assert [bool(r["kept"]) for r in sorted(out, key=lambda r: r["id"])] == want and 0 < sum(want) < len(want)


def test_jaccard(docs):
    rows = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    data = [(d, t) for d, t, _ in ROWS]
    assert rows == sorted(((d, d if c is None and not brute.shingles(t) else c, n) for (d, t), (c, n) in zip(data, brute.jaccard_classes(data))), key=str)


def test_a_large_group_of_near_copies(spark):
    """More members than a block, so that pairs of blocks are compared."""
    stem = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*stem[: 10 + i % 100], f"new{i}", *stem[10 + i % 100 :]])) for i in range(700)]
    out = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in out} == {0} and {r["n_links"] for r in out} == {699}


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 300), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(201)}, 300: 300, 400: 300, 500: 300}


def test_substring(docs, spark):
    rows = {(r["doc_id"], r["n_words"]): r for r in substring.remove_repeats(docs).collect()}
    assert rows[7, 30_000]["n_removed"] == 30_000 and rows[7, 30_000]["kept_text"] == "" and rows[2, 0]["kept_text"] == ""
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(30)]
    two = spark.createDataFrame([(1, " ".join([*b[:7], *a, *b[7:]])), (2, " ".join([*b[7:20], *a[3:33], "x"])), (3, " ".join([*a[:19], "y"]))], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["removed"]] for r in substring.remove_repeats(two).collect()}
    assert got == {1: [], 2: [(13, 43)], 3: []}


def test_suffix_tree(docs):
    rows = suffix_tree.score(docs).collect()
    assert len(rows) == len(ROWS) and all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 4, 5)} == {1}


def test_chat(spark):
    nasty = "\\<turn>\\\\ </turn><text> <|endoftext|> é\U0001f600"
    rows = [(1, 2, "assistant", nasty), (1, 1, "user", None), (1, None, nasty, "first"), (1, 2, "assistant", "a tie"), (None, 1, None, "x"), (2, 1, "assistant", ""), (2, 1, "assistant", "")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    words = vocabulary("byte_bpe_50k.json")
    whole = {tuple(r) for r in chat.read_back(chat.format_chat(conv, words), words).collect()}
    parts = {tuple(r) for r in chat.read_back(chat.format_chat(conv, words, row_tokens=3), words).collect()}
    assert whole == parts and {(r[0], r[1], r[3]) for r in whole} == {(1, 4, len(nasty) + 5), (None, 1, 0), (2, 2, 0)}
    assert chat.unescape(chat.escape(nasty)) == nasty


def test_packing(docs):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    rows = packing.pack(docs.filter("doc_id is not null"), path).withColumn("ids_crc32", F.crc32("ids")).collect()
    texts = {}
    for d, t, _ in ROWS:
        if d is not None:
            texts.setdefault(d, []).append(t)
    brute.check_pieces(rows, texts, Tokenizer.from_file(path))
    assert packing.pack(docs, path).filter("doc_id is null").count() >= 1


def test_cuts_are_the_best(spark):
    """The queue's answer costs what trying all cuts costs."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        ends = np.unique(np.append(rng.integers(1, 300, 6), 300))
        sentences = np.unique(rng.integers(1, 300, 25))
        cuts = packing.choose_cuts(300, ends, sentences, False, 64)
        price = lambda p: 0 if p in ends else packing.SENTENCE if p in sentences else packing.INSIDE
        cost = lambda cs: sum((64 - (b - a)) + price(b) + packing.SEQUENCE for a, b in zip([0, *cs], cs))
        best = {0: 0.0}
        for p in sorted({*ends.tolist(), *sentences.tolist()}):
            options = [best[q] + 64 - (p - q) + price(p) + packing.SEQUENCE for q in best if 0 < p - q <= 64]
            if options:
                best[p] = min(options)
        if int(cuts[-1]) in best and np.diff(np.concatenate([[0], cuts])).max() <= 64:
            assert cost(cuts.tolist()) <= best[int(cuts[-1])] + 1e-9


@pytest.mark.parametrize("final", [True, False])
def test_cuts_with_powers_and_gaps_are_the_best(final):
    """Unpadded lengths, cuts inside long sentences and the stream's end, against all pairs of positions."""
    rng, length, used = np.random.default_rng(7), 512, set()
    for _ in range(25):
        n = int(rng.integers(900, 3000))
        ends = np.unique(np.append(rng.integers(1, n, rng.integers(0, 6)), n))
        sentences = np.unique(rng.integers(1, n, rng.integers(0, 12)))
        at = sorted({0, n, *ends.tolist(), *sentences.tolist()})
        at = sorted({*at, *[x for a, z in zip(at, at[1:]) for x in range(a + packing.GAP, z, packing.GAP)]})
        price = {p: 0 if p in ends or final and p == n else packing.SENTENCE if p in sentences else packing.INSIDE for p in at}
        powers = [1 << k for k in range(9) if packing.LEAST_POWER <= 1 << k < length]
        pad = lambda w: 0 if w in powers else length - w  # noqa: E731, B023
        best = {0: 0.0}
        for p in at[1:]:
            best[p] = min(best[q] + pad(p - q) + price[p] + packing.SEQUENCE for q in at if q in best and 0 < p - q <= length)
        cuts = packing.choose_cuts(n, ends, sentences, final, length).tolist()
        widths = np.diff([0, *cuts])
        assert widths.max() <= length and widths.min() > 0
        used |= set(widths.tolist()) & set(powers)
        if final:  # the last sequence may be cut in powers of two, which only lowers the price
            assert cuts[-1] == n
            cuts = [c for c in cuts if c in best]
            low = max((c for c in cuts if c < n and n - c <= length), default=0)
            head = [c for c in cuts if c <= low]
            assert sum(pad(b - a) + price[b] + packing.SEQUENCE for a, b in zip([0, *head], head)) == pytest.approx(best[low] if head else 0)
        else:
            assert sum(pad(b - a) + price[b] + packing.SEQUENCE for a, b in zip([0, *cuts], cuts)) == pytest.approx(best[cuts[-1]])
    assert used


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    path = vocabulary("word_bpe_49k.json")
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    byte = vocabulary("byte_bpe_50k.json")
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "allow")], "host string, path string, action string")
    for df in (exact.exact_groups(none), quality.quality(none), mixing.mix(none), lines.judge_lines(none), jaccard.jaccard_classes(none), substring.remove_repeats(none),
               suffix_tree.score(none), packing.pack(none, path), chat.read_back(chat.format_chat(conv, byte), byte), urls.filter_urls(pages, rules)):
        assert df.count() == 0
