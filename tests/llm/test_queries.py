"""The registered queries against SQL or plain versions, on the smallest tables."""
import brute
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tabaudit.llm import mixing, suffix_tree
from tabaudit.llm.queries import all_queries, all_sql, vocabulary
from tabaudit.llm.twins import lines_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_matches_sql(spark, name):
    assert compare(all_queries()[name](spark, FOLDER), duck(FOLDER), all_sql()[name]) is None


def test_jaccard(spark, docs):
    rows = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in all_queries()["op8_ngram_jaccard"](spark, FOLDER).collect()}
    keys = sorted(docs)
    assert [rows[k] for k in keys] == brute.jaccard_classes([(k, docs[k]) for k in keys])


def test_suffix_tree(spark, docs):
    base = brute.base_scores(docs)
    model, kept = brute.tree_scores(docs, suffix_tree.LEAST, suffix_tree.DIVERGENCE, suffix_tree.WEIGHTS.tolist(), order=None)
    assert {len(c) for c in kept} == {1, 2, 3, 4}  # as README says, the one kept context of length 6 behind an empty length is not reached
    rows = all_queries()["op3_lm_scoring"](spark, FOLDER).collect()
    assert len(rows) == len(docs) and len(kept) > 20
    for r in rows:
        held, n, known, size, score = base[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, size)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["score"] == pytest.approx(model[r["doc_id"]], rel=2e-3)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    rows = all_queries()["op10_packing"](spark, FOLDER).collect()
    assert brute.check_pieces(rows, {k: [t] for k, t in docs.items()}, Tokenizer.from_file(vocabulary("word_bpe_49k.json"))) < 0.03


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage's output against SQL or a plain version on that stage's input."""
    import duckdb
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    now = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES):
        before = now
        stage(spark, now, FOLDER).write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        con = duckdb.connect()
        con.register("documents", before.toPandas())
        if k < 4:
            assert now.columns == before.columns
        ids = sorted(r[0] for r in now.select("doc_id").collect())
        if k == 0:
            assert ids == sorted(r[0] for r in con.sql(f"select doc_id from ({all_sql()['op9_quality_rules']}) where kept").fetchall())
        if k == 1:
            gone = {r[0]: {int(x) for x in r[1].split(",") if x} for r in con.sql(f"select doc_id, removed_lines from ({lines_sql("documents")})").fetchall()}
            want = {}
            for d, t in before.select("doc_id", "text").collect():
                left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d])
                if brute.words(left):
                    want[d] = left
            assert {r["doc_id"]: r["text"] for r in now.collect()} == want
            assert now.filter(F.length("text") != F.col("n_chars")).count() == 0
        if k == 2:
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            assert ids == sorted(d for (d, _), (c, _) in zip(rows, brute.jaccard_classes(rows)) if d == c)
        if k == 3:
            took = con.sql(f"select doc_id, taken // greatest(size, 1) from ({all_sql()['op7_mixing']})").fetchall()
            assert ids == sorted(d for d, n in took for _ in range(n))
        if k == 4:
            texts = {}
            for d, t in before.select("doc_id", "text").collect():
                texts.setdefault(d, []).append(t)
            brute.check_pieces([r.asDict() for r in now.collect()], texts, Tokenizer.from_file(vocabulary("word_bpe_49k.json")))


def test_mix_hits_its_targets(spark):
    out = mixing.mix(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("want"), F.max("size").alias("most"), F.max("repetitions").alias("n")).collect():
        assert abs(r["t"] - r["want"]) <= r["most"] and r["n"] <= 2
