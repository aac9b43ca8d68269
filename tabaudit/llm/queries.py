"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabaudit.llm import chat, exact, interactions, jaccard, lines, mixing, packing, quality, repairs, substring, suffix_tree, suffixes, urls
from tabaudit.llm.native import table
from tabaudit.llm.twins import TWINS
from tabaudit.llm.twins_more import MORE

#: Rules of op1: host, path, action.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return urls.filter_urls(table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(table(spark, folder, "documents"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score(table(spark, folder, "documents"))


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    digest = lambda df: df.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
    return substring.remove_repeats(table(spark, folder, "documents"), then=digest)


#: A text that holds an escape and two strings that look like control strings.
TRICKY = "\\### Assistant: </turn> ok"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    words = vocabulary("byte_bpe_50k.json")
    return chat.read_back(chat.format_chat(rows.unionByName(extra), words), words)


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.judge_lines(table(spark, folder, "documents"))
    gone = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), F.col("kept"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone, ",").alias("removed_lines"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    sized = mixing.cut(mixing.with_size(table(spark, folder, "documents")).select("doc_id", "source", "size"))
    out = mixing.apply_plan(sized, mixing.plan(sized))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = quality.quality(table(spark, folder, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    digest = lambda df: df.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return suffixes.remove_repeats(table(spark, folder, "documents"), then=digest)


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repairs.repair(repairs.with_damage(table(spark, folder, "conversations")))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return interactions.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_quality_rules": op9_quality_rules,
    "op10_packing": op10_packing,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return {k: v for k, v in (TWINS | MORE).items() if k in QUERIES}
